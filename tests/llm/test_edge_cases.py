"""Every operator on awkward rows, on no rows and among clashing columns; and what its contract says of them."""

import hashlib
import zlib
from collections import Counter

import pytest
from conftest_llm import rows
from pyspark.sql import functions as F

import corpus_pipeline
from sedge.llm import fingerprints, languages, media, mixing, neardups, pieces, quality, sharding, substrings


def languages_of(d):
    return languages.identify(d, languages.train(d, 20))


def quality_of(d):
    vectors = quality.word_vectors(d)
    labels = d.sparkSession.createDataFrame([(i, i % 2) for i in range(2, 13)], "doc_id long, quality int")
    return quality.score(d, vectors, quality.train(d, labels, vectors))


OPERATORS = {
    "quality": quality_of, "fingerprints": fingerprints.fingerprint_documents, "pieces": lambda d: pieces.encode_texts(d, pieces.model_path()), "mixing": mixing.mix, "media": lambda d: media.text_media(d, keep=True),
    "languages": languages_of, "sharding": sharding.shard_documents, "neardups": neardups.near_duplicates, "substrings": substrings.without_repeats,
}


@pytest.fixture(scope="module")
def results(docs):
    found = {}
    return lambda name: found.setdefault(name, OPERATORS[name](docs).collect())


@pytest.mark.parametrize("name", list(OPERATORS))
def test_awkward_rows(docs, no_docs, odd_columns, results, name):
    got = results(name)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert OPERATORS[name](no_docs).count() == 0
    assert sorted(map(repr, OPERATORS[name](odd_columns.orderBy(F.desc("doc_id"))).collect())) == sorted(map(repr, got))


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_defined_results(docs, results):
    text = texts(docs)
    for r in results("languages"):
        assert (r.lang_pred == "und" and r.score == 0) == (not any(c.isalpha() for c in text[r.doc_id]))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    for r in results("quality"):
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    for r in results("sharding"):
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for r in results("mixing"):
        assert r.size == len(text[r.doc_id].encode().split()) and r.taken == r.size * r.copies <= 2 * r.size
    classes = {r.doc_id: (r.class_id, r.kept) for r in results("neardups")}
    assert classes[11] == (1, False) and classes[6] == (5, False) and classes[3] == (2, False)
    assert classes[None] == (None, True) and classes[12] == (12, True) and classes[4] == (4, True)
    for r in results("substrings"):
        assert r.n_removed == (r.n_words if r.doc_id == 6 else 0)
        if r.doc_id != 6:
            assert r.kept_sha256 == hashlib.sha256(b" ".join(text[r.doc_id].encode().split())).hexdigest()


def test_fingerprints(docs, results):
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = {r.doc_id: r for r in results("fingerprints")}
    for i, row in enumerate(order):
        if row.doc_id == 6:  # repeated: its own next once
            continue
        own, after = row.text or "", order[(i + 1) % len(order)].text or ""
        quarter = len(own) // 4
        r = got[row.doc_id]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256((own[: len(own) - quarter] + after[:quarter]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[1].fingerprint == got[11].fingerprint and got[2].fingerprint == got[3].fingerprint == "." * 512
    assert got[5].near_next == 1 and got[2].near_next == 1 and got[5].near_edited > 0.2


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, no_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    filled = docs.withColumn("lang", F.coalesce("lang", F.lit("en")))
    got = stage(spark, filled, "")
    empty = stage(spark, no_docs, "")
    assert empty.count() == 0
    if k < 4:
        assert got.columns == empty.columns == docs.columns
        more = stage(spark, filled.withColumn("_id", F.lit(7)).withColumn("tag", F.lit("x")), "")
        assert more.columns == [*docs.columns, "_id", "tag"] and rows(more.select(docs.columns)) == rows(got)
    ids = Counter(r.doc_id for r in got.collect())
    want = Counter(r.doc_id for r in docs.collect())
    if name == "language_id":
        assert want - ids == Counter([2, 3, 4, 10])
    elif name == "near_dedup":
        assert ids == Counter([1, 2, 4, 5, 7, 8, 9, 10, None, 12])
    elif name in ("substring_dedup", "encode"):
        assert ids == want
    if name == "substring_dedup":
        assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()}[6] == ("", 0)
        assert rows(got.filter("doc_id <> 6 OR doc_id IS NULL")) == rows(filled.filter("doc_id <> 6 OR doc_id IS NULL"))
