"""Whole analyses, from an edge relation to a result."""

from sedge.plans.tasks import community_counts, max_pair, topk_lex, topk_numeric

__all__ = ["community_counts", "max_pair", "topk_lex", "topk_numeric"]
