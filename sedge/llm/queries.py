"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from sedge.llm import archives, fingerprints, languages, media, mixing, neardups, pieces, quality, sharding, substrings

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_mixing": mixing.op4_mixing,
    "op5_media": media.op5_media,
    "op6_warc": archives.op6_warc,
    "op7_languages": languages.op7_languages,
    "op8_sharding": sharding.op8_sharding,
    "op9_neardups": neardups.op9_neardups,
    "op10_substrings": substrings.op10_substrings,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE,
    "op6_warc": archives.ORACLE,
    "op8_sharding": sharding.ORACLE,
    "op10_substrings": substrings.ORACLE,
}
