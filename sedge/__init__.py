"""Spark-native analytics over bipartite edge relations, plus training-data operators in ``sedge.llm``."""
