"""Results that must be whole where a document repeats itself, or holds what others hold in other places."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_llm_operators import brute_classes

import corpus_pipeline
from sedge.llm import languages, neardups, substrings


def brute_kept(texts, span):
    """The kept words of each text: none that lies in a window that also starts in a text of smaller id."""
    first, kept = {}, {}
    for i, t in sorted(texts.items()):
        w = t.split()
        for p in range(len(w) - span + 1):
            first.setdefault(tuple(w[p : p + span]), i)
    for i, t in texts.items():
        w = t.split()
        gone = {q for p in range(len(w) - span + 1) if first[tuple(w[p : p + span])] < i for q in range(p, p + span)}
        kept[i] = " ".join(x for q, x in enumerate(w) if q not in gone)
    return kept


def test_substrings_block_twice(spark):
    """A later document holds a block twice, in equal surroundings that no smaller document has."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(100_000)]
    texts = {}
    for case in range(12):
        a, x, b, c, d = (rng.choices(vocabulary, k=n) for n in (40, 60, 40, 40, 40))
        texts[10 * case] = " ".join(a + x + d)
        texts[10 * case + 5] = " ".join((b + x + c) * 2)
        texts[10 * case + 7] = " ".join(b + x + d + c + x + a)
    got = substrings.without_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep=True)
    assert {r.doc_id: bytes(r.kept).decode() for r in got.collect()} == brute_kept(texts, substrings.SPAN)


def test_neardups_repeated_lines(spark):
    """Near copies that differ in how often a line repeats."""
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(100_000)]
    texts = []
    for times in (1, 30, 200, 500):
        for n, k in ((110, 20), (120, 12)):
            for _ in range(5):
                base, line = rng.choices(vocabulary, k=n), rng.choices(vocabulary, k=k)
                texts += [" ".join(base), " ".join(base + line * times)]
    texts = dict(enumerate(texts))
    got = neardups.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = brute_classes(texts)
    assert set(want.values()) == set(range(0, len(texts), 2))
    assert {r.doc_id: r.class_id for r in got} == want


def test_language_decides(spark, smoke):
    """The language told is written where none is given; given ones stay."""
    model = languages.train(smoke)
    told = {r.doc_id: r.lang_pred for r in languages.identify(smoke, model).collect()}
    given = {r.doc_id: r.lang for r in smoke.collect()}
    got = languages.with_language(smoke.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), model)
    assert {r.doc_id: r.lang for r in got.collect()} == {i: told[i] if i % 2 or given[i] is None else given[i] for i in told if told[i] != "und"}


def test_language_unlabelled(spark, docs):
    """Where no text has a language, those with a letter stay."""
    got = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert Counter(r.doc_id for r in docs.collect()) - Counter(r.doc_id for r in got.collect()) == Counter([2, 3, 4, 10])
    assert {r.lang for r in got.collect()} == {None}


def test_neardups_clashing_ids(spark):
    """Different texts of one doc_id are judged apart, whatever the order of the rows."""
    rng = random.Random(17)
    x, y, z = (" ".join(f"w{rng.randrange(100_000)}" for _ in range(120)) for _ in range(3))
    data = [(1, x, "a"), (2, x + " more", "a"), (2, y, "a"), (2, y, "b"), (3, y + " more", "a"), (4, z, "a"), (4, "", "a"), (4, None, "a"), (None, x, "a"), (None, x, "a")]

    def left(some):
        got = neardups.without_near_duplicates(spark.createDataFrame(some, "doc_id long, text string, source string"))
        assert got.columns == ["doc_id", "text", "source"]
        return Counter(tuple(r) for r in got.collect())

    found = left(data)
    assert Counter((i, t or "") for (i, t, _), n in found.items() for _ in range(n)) == Counter([(1, x), (2, y), (4, z), (4, ""), (None, x), (None, x)])
    assert left(data[::-1]) == found
