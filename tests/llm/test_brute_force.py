"""Operators without an SQL statement against slow versions of their own, and rows made to be hard."""

import hashlib
import random
import re
import struct
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from conftest_llm import SMOKE
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from test_llm_operators import brute_classes
from test_whole_job import brute_kept

import corpus_pipeline
from sedge.llm import archives, fingerprints, languages, media, mixing, pieces, quality, sharding, substrings

TEXTS = ["", "one", "Der Wald, der Wald; der See.", "a b a b a b c d e f g a b", "x1 Y2 ++ 世界 世界 é é"]


def test_quality_brute_force(spark):
    data = [x.encode() for x in TEXTS]
    columns, signs = quality.random_entries()
    want = np.zeros((quality.BUCKETS + 1, quality.DIMS), np.int64)
    for x in data:
        for row in quality.buckets([x])[:2]:
            for i, j in ((i, j) for i in range(len(row)) for j in range(len(row)) if i != j and abs(i - j) <= quality.NEAR):
                for e in range(quality.ENTRIES):
                    want[row[i], columns[row[j], e]] += signs[row[j], e]
    assert np.array_equal(quality.context_sums(data, (columns, signs)), want)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    vectors = quality.word_vectors(docs)
    assert np.array_equal(vectors, quality.unit_rows(want.astype(float)))
    features = quality.pooled(data, vectors)
    for x, got in zip(data, features, strict=True):
        rows = quality.buckets([x])[:2]
        means = [sum((vectors[k] for k in row), np.zeros(quality.DIMS)) / max(1, len(row)) for row in rows]
        lengths = [float(np.sqrt((m * m).sum())) for m in means]
        assert got == pytest.approx([*means[0], *means[1], *lengths, np.log1p(len(rows[0])), len(set(rows[0].tolist())) / max(1, len(rows[0]))], abs=1e-6)
    net = quality.fit(np.vstack([features, features + 0.1]), np.array([0, 1] * len(data)))
    score = {r.doc_id: r.score for r in quality.score(docs, vectors, net).collect()}
    for i, x in enumerate(features.astype(float)):
        hidden = [np.tanh(sum((x[k] - net.mean[k]) / net.scale[k] * net.w1[k, j] for k in range(x.size)) + net.b1[j]) for j in range(quality.HIDDEN)]
        assert score[i] == pytest.approx(1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2) / net.temperature)), abs=1e-6)


def order_minhash(text):
    """Elements one by one: k-mers numbered by occurrence, the least of each stratum, pairs in text order."""

    def xx(*values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed)
        return seed

    tokens = re.findall(fingerprints.TOKENS, text, re.ASCII)
    low, seen, least = (1 << fingerprints.HASH_BITS) - 1, Counter(), {}
    for i, token in enumerate(tokens):
        h = xx(*(t.encode() for t in tokens[i : i + fingerprints.K])) & low
        again, seen[h] = seen[h], seen[h] + 1
        h = h if not again else xx(struct.pack("<q", h), struct.pack("<i", again)) & low
        stratum = h * 2 * fingerprints.SLOTS >> fingerprints.HASH_BITS
        least[stratum] = min(least.get(stratum, (h, i)), (h, i))
    out = []
    for j in range(fingerprints.SLOTS):
        pair = sorted((i, h) for h, i in (least[s] for s in (2 * j, 2 * j + 1) if s in least))
        out.append(f"{xx(*(struct.pack('<q', h) for _, h in pair)):016X}" if pair else "." * 16)
    return "".join(out)


def test_fingerprints_brute_force(spark, smoke):
    rng = random.Random(4)
    texts = [*TEXTS, "w " * 300, " ".join(rng.choice("abcd") for _ in range(500)), *[r.text for r in smoke.limit(20).collect()]]
    df = fingerprints.with_order_minhash(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "s")
    got = {r.i: r.x for r in df.select("i", fingerprints.as_text(F.col("s")).alias("x")).collect()}
    assert got == {i: order_minhash(t) for i, t in enumerate(texts)}


def test_fingerprints_without_spaces(spark):
    """One character more in a text without spaces leaves most of it as it was; ids may be text."""
    rng = random.Random(6)
    text = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(4000))
    rows = [("b", text), ("a", "x" + text), ("c", text[:2000] + "y" + text[2000:]), (None, text)]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id string, text string"))
    assert all(r.near_next > 0.8 for r in got.collect()) and got.count() == 4


def test_tiles_brute_force(smoke):
    def shares(cells, size):
        out = np.zeros((cells, size))
        for i in range(cells):
            for k in range(size):
                out[i, k] = max(0.0, min(k + 1, (i + 1) * size / cells) - max(k, i * size / cells)) * cells / size
        return out

    for r in media.text_media(smoke.limit(30), keep=True).collect():
        image = media.decode(bytes(r.media)).astype(float)
        h, w, _ = image.shape
        small = np.einsum("ik,klc,jl->ijc", shares(8, h), image, shares(8, w))
        tile = np.frombuffer(bytes(r.tile)[-192:], np.uint8).reshape(8, 8, 3)
        assert np.abs(tile - small).max() <= 0.5 + 1e-6
        grey = np.round(np.einsum("ik,klc,jl->ijc", shares(8, h), image, shares(9, w)) @ [0.299, 0.587, 0.114], 6)
        assert r.feature == np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()
        assert bytes(r.media)[:2] == (b"P6" if r.payload_bytes // 192 % 2 else b"BM")


def test_bmp_kinds():
    image = np.random.default_rng(3).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    assert np.array_equal(media.decode(media.encode_bmp(image)), image)
    head = lambda depth, packed, start, size: b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + size, 0, 0, start, 40, 5, -4, 1, depth, packed, size, 0, 0, 0, 0)
    red_first = head(32, 3, 66, 80) + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + b"".join(bytes([*p, 0]) for p in image.reshape(-1, 3).tolist())
    assert np.array_equal(media.decode(red_first), image)
    five = head(16, 0, 54, 48) + b"".join(struct.pack("<5H", *[31 << 10] * 5) + b"\0\0" for _ in range(4))
    assert (media.decode(five) == [255, 0, 0]).all()
    palette = b"".join(bytes([k, 2 * k % 256, 3 * k % 256, 0]) for k in range(256))
    indexed = head(8, 0, 54 + 1024, 32) + palette + b"".join(bytes(range(4 * y, 4 * y + 5)) + b"\0" * 3 for y in range(4))
    assert media.decode(indexed)[2].tolist() == [[3 * k, 2 * k, k] for k in range(8, 13)]
    for bad in (red_first[:60], head(32, 1, 54, 80) + b"\0" * 80, head(24, 0, 54, 80) + b"\0" * 10):
        with pytest.raises(ValueError, match="BMP"):
            media.decode(bad)


def test_languages_brute_force(smoke):
    model = languages.train(smoke, 40)
    texts = [r.text for r in smoke.limit(40).collect() if r.text and any(c.isalpha() for c in r.text)]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        data = b" " + bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in text.lower().encode()) + b" "
        x = np.zeros(languages.WIDTH + 1)
        for i in range(len(data) - 2):
            if data[i : i + 3] != b"   ":
                x[int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32 >> 20] += 1
        x = np.sqrt(x)
        x /= np.sqrt((x * x).sum())
        x[-1] = 1
        margins = [float(w @ x) for w in model.family] if len(model.families) > 1 else [0.0]
        family = int(np.argmax(margins))
        share = 1 / sum(np.exp(4 * (m - margins[family])) for m in margins)
        own = model.languages[model.families[family]]
        votes = Counter({k: 0.0 for k in range(len(own))})
        for (p, q), w in zip(combinations(range(len(own)), 2), model.pairs[model.families[family]], strict=True):
            s = 1 / (1 + np.exp(-4 * float(w @ x)))
            votes[p] += s
            votes[q] += 1 - s
        best = max(votes, key=votes.get)
        assert name == own[best] and score == pytest.approx(share * (votes[best] / (len(own) - 1) if len(own) > 1 else 1), abs=1e-3)


def test_language_stage_odd_columns(spark, docs):
    odd = docs.withColumn("x.y", F.lit(1)).withColumn("a`b", F.struct(F.lit(2).alias("b b"))).withColumn("when", F.current_timestamp())
    odd = odd.select("when", *[F.col(f"`{c.replace('`', '``')}`") for c in odd.columns if c != "when"])
    for stage in (corpus_pipeline.language_id, corpus_pipeline.substring_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mix):
        got = stage(spark, odd, "")
        assert got.columns == odd.columns and got.count() > 0
        assert {r["a`b"]["b b"] for r in got.collect()} == {2}


def test_slots_of_hot_keys(spark):
    """A key of very many rows, some of one size and some equal throughout, is numbered as any other."""
    rows = [(None, i % 7 if i % 3 else 5, i % 11 if i % 2 else 4) for i in range(3000)] + [(i, 1, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long").repartition(5)
    placed = sharding.rendezvous(df, F.col("doc_id"), [1.0] * 3)
    got = sharding.with_slots(placed, ["doc_id", "size", "text_crc32"], hot=40).collect()
    for s in range(3):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.place, r.size, r.text_crc32) for r in own]
        assert order == sorted(order)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(rows)


def test_substrings_many_cases(spark):
    """A hundred cases of their own words: passages repeated in one text and across texts, in equal and other surroundings."""
    rng = random.Random(19)
    texts = {}
    for case in range(100):
        vocabulary = [f"{case}.{k}" for k in range(rng.choice((3, 12, 400)))]
        blocks = [rng.choices(vocabulary, k=rng.randint(2, 12)) for _ in range(4)]
        for k in range(rng.randint(2, 5)):
            texts[10 * case + k] = " ".join(w for _ in range(rng.randint(1, 5)) for w in rng.choice(blocks))
    order = rng.sample(sorted(texts), len(texts))
    texts = dict(zip(order, texts.values(), strict=True))
    got = substrings.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 6, 2, keep=True)
    assert {r.doc_id: bytes(r.kept).decode() for r in got.collect()} == brute_kept(texts, 6)


def test_words_are_compared():
    """Words that differ stay, whatever digests said; a run long enough inside goes."""
    words = [b"a", b"b", b"c", b"d", b"e", b"f"]
    proof = [{"at": 0, "n": 6, "src_at": 62, "block": 0, "words": b" ".join([b"x"] * 62 + [b"a", b"b"])}, {"at": 0, "n": 6, "src_at": 62, "block": 1, "words": b"c x e f"}]
    assert substrings.staying(words, proof, 3) == [b"d", b"e", b"f"]
    assert substrings.staying(words, proof, 4) == words
    proof[1]["words"] = b"c d e f g"
    assert substrings.staying(words, proof, 6) == []


def test_file_systems():
    assert archives.file_system("/a/b")[1] == archives.file_system("file:///a/b")[1] == archives.file_system("file:/a/b")[1] == "/a/b"
    with pytest.raises(ValueError, match="file system"):
        archives.file_system("odd://a/b")


def test_pipeline_brute_force(spark, smoke):
    """Every stage by a slow version of it, over all documents of the smallest tables."""
    rows = {r.doc_id: r for r in smoke.collect()}
    told = {r.doc_id: r.lang_pred for r in languages.identify(smoke, languages.train(smoke)).collect()}
    texts = {i: r.text for i, r in rows.items() if r.text and re.search(r"[^\W\d_]", r.text) and told[i] != "und"}
    texts = {i: texts[i] for i, c in brute_classes(texts).items() if i == c}
    clean = brute_kept({i: " ".join(x.decode() for x in t.encode().split()) for i, t in texts.items()}, substrings.SPAN)
    texts = {i: t if len(t.encode().split()) == len(clean[i].encode().split()) else clean[i] for i, t in texts.items()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, rows[i].source) for i, t in texts.items()])
    base = {r[0]: r[4] // r[1] for r in con.execute(mixing.ORACLE).fetchall() if r[1]}
    library = SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter()
    for i, t in texts.items():
        ids = library.encode(t)
        want[i, len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += base.get(i, 0)
    got = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMOKE).collect())
    sized = {k: n for k, n in got.items() if texts[k[0]].encode().split()}
    assert sized == {k: n for k, n in want.items() if n}
