"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from conftest_llm import SMOKE
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from sedge.llm import languages, mixing, neardups, pieces, quality, sharding, substrings
from sedge.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, LARGER).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall()
    held = [(got[i].score, q) for i, q in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    good, bad = ([s for s, q in held if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.93


def test_quality_without_labels(spark, smoke):
    assert {r.score for r in quality.score(smoke.limit(3), np.zeros((quality.BUCKETS + 1, quality.DIMS)), None).collect()} == {0.5}


def test_languages_held_out(spark):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{LARGER}/documents.parquet'").fetchall())
    held = [r for r in QUERIES["op7_languages"](spark, LARGER).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_languages_none_learned(spark, smoke):
    assert {r.lang_pred for r in languages.identify(smoke.limit(5), None).collect()} == {"und"}


def test_fingerprints_follow_edits(spark):
    got = QUERIES["op2_fingerprints"](spark, SMOKE).collect()
    assert np.mean([r.near_edited for r in got]) > 0.25 > 0.05 > np.mean([r.near_next for r in got])


@pytest.fixture(scope="module")
def codec():
    with open(pieces.model_path(), "rb") as f:
        return pieces.MergeCodec(f.read())


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁aeinorst.,!?0123\n\t²éß日😀\x00"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_codec_matches_library(text):
    c = _codec()
    ids = c.encode(text)
    assert ids == c.library.encode(text)
    assert c.decode(ids).decode() == c.library.decode(ids)
    c.check([text], [ids], [c.decode(ids)])
    if ids:
        with pytest.raises(ValueError, match="encodes"):
            c.check([text + "x"], [ids], [c.decode(ids)])
        with pytest.raises(ValueError, match="decodes"):
            c.check([text], [ids], [c.decode(ids) + b"x"])


def _codec(found=[]):  # noqa: B006
    if not found:
        with open(pieces.model_path(), "rb") as f:
            found.append(pieces.MergeCodec(f.read()))
    return found[0]


def test_codec_agendas_agree(codec):
    rng = random.Random(3)
    for n in (1, 2, 5, 40, 48, 49, 300):
        part = "▁" + "".join(rng.choice("aeinorsth") for _ in range(n))
        assert codec.short(part) == codec.long(part)


def test_encode_documents(spark, smoke):
    lib = SentencePieceProcessor(model_file=pieces.model_path())
    text = {r.doc_id: r.text for r in smoke.collect()}
    for r in QUERIES["op3_sentencepiece"](spark, SMOKE).collect():
        ids = lib.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_mix_targets(spark):
    rng = random.Random(5)
    data = [(i, "w " * rng.randint(0, 60), s) for i, s in enumerate(rng.choices(["a", "b", "é", "z", None], [50, 1, 3, 30, 2], k=3000))]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in data}
    size, target, taken = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        size[s], taken[s] = size.get(s, 0) + r.size, taken.get(s, 0) + r.taken
        target[s] = r.target
    weight = dict(zip(["a", "b", "z", "é", None], [5, 2, 1, 5, 2], strict=True))
    want, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        free = [s for s in size if s not in capped]
        want = {s: 2.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in size}
        over = {s for s in free if want[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)
    again = mixing.mix(spark.createDataFrame(data[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(again) == sorted(got)


def test_mixed_rows(spark, smoke):
    copies = {r.doc_id: r.copies for r in mixing.mix(smoke).collect()}
    rows = mixing.mixed(smoke).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {i: n for i, n in copies.items() if n}


def test_shards(spark, smoke):
    got = sharding.shard_documents(smoke).collect()
    for s in range(24):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    weights = [1.0, 3.0]
    ids = spark.range(20_000)
    from pyspark.sql import functions as F

    share = sharding.rendezvous(ids, F.col("id"), weights).groupBy("shard").count().collect()
    assert {r.shard: r["count"] / 20_000 for r in share}[1] == pytest.approx(0.75, abs=0.02)


def brute_classes(texts, k=5, similar=0.8):
    def shingles(t):
        w = t.encode().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if texts[a] == texts[b] or (both and both >= similar * (len(sets[a]) + len(sets[b]) - both)):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: root(i) for i in texts}


def test_neardups_brute_force(spark):
    """Families around one text, chains that only neighbours link, exact copies, and texts apart."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    chain = rng.choices(words, k=100)
    for step in range(15):
        texts.append(" ".join(chain[:100]))
        chain = chain[3:] + [f"c{step}", f"d{step}", f"e{step}"]
    texts += texts[:5] + [" ".join(rng.choices(words, k=50)) for _ in range(30)] + ["", "", "a b", "a b", "a  b", "b a"]
    order = rng.sample(range(1000), len(texts))
    want = brute_classes(dict(zip(order, texts, strict=True)))
    got = neardups.near_duplicates(spark.createDataFrame(list(zip(order, texts, strict=True)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_neardups_documents(spark, smoke):
    want = brute_classes({r.doc_id: r.text or "" for r in smoke.collect()})
    assert {r.doc_id: r.class_id for r in QUERIES["op9_neardups"](spark, SMOKE).collect()} == want


def test_prob_minhash_estimates():
    """Registers agree as often as the probability Jaccard similarity says."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    x, y = dict(zip(h[:40].tolist(), 1 + np.log(a), strict=True)), dict(zip(h[20:].tolist(), 1 + np.log(b), strict=True))
    every = x.keys() | y.keys()
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in x.keys() & y.keys())
    one, two = neardups.prob_minhash([(h[:40], a), (h[20:], b)], 4000)
    assert np.mean(one == two) == pytest.approx(want, abs=0.03)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 5), (200, 201), (300, 300)]
    got = neardups.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.label for r in got} == {**{i: 0 for i in range(61)}, 100: 0, 200: 200, 201: 200}


@settings(max_examples=4, deadline=None)
@given(st.randoms(use_true_random=False))
def test_substrings_brute_force(rng):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    span, mini = 6, 2
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(25)]
    first, want = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - span + 1):
            first.setdefault(tuple(w[p : p + span]), i)
    for i, t in enumerate(texts):
        w = t.split()
        gone = {q for p in range(len(w) - span + 1) if first[tuple(w[p : p + span])] < i for q in range(p, p + span)}
        want[i] = " ".join(x for q, x in enumerate(w) if q not in gone)
    got = substrings.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), span, mini, keep=True)
    assert {r.doc_id: bytes(r.kept).decode() for r in got.collect()} == want
