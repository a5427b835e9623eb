"""Near-duplicate classes: ProbMinHash sketches of the sets of word shingles, banding, exact verification, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from sedge.llm.work import discard, fields, full_text, mapped, numbered, settled, table, written

#: Words of a shingle, least similarity of a link, bands and registers of a band. Two texts at the least
#: similarity share no band with probability (1 - 0.8**4)**20, under 3 in 100,000.
WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 20, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of ``k`` words and how often each occurs; fewer words form one run."""
    from xxhash import xxh64_intdigest

    words = text.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        total = total * _B + hashes[j : j + n]
    return np.unique(_mix(total + np.uint64(min(k, len(words)))), return_counts=True)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """A row of ``size`` registers for each weighted set of hashes.

    Every element sends Poisson arrivals at the rate of its weight, 1 + ln(count), to random registers; a
    register keeps the element that arrives first. Registers of two sets agree with the probability
    Jaccard similarity of the sets. An element stops once it is later than every register of its set. All
    sets go round by round together; an empty set has registers of its own that agree with no other's.
    """
    docs = len(sets)
    owner = np.repeat(np.arange(docs), [h.size for h, _ in sets])
    h = np.concatenate([h for h, _ in sets]) if docs else np.zeros(0, np.uint64)
    rate = 1 + np.log(np.concatenate([c for _, c in sets]).astype(np.float64)) if docs else np.zeros(0)
    first = np.full(docs * size, np.inf)
    out = np.zeros(docs * size, np.uint64)
    time, i = np.zeros(h.size), np.uint64(0)
    with np.errstate(over="ignore"):
        while h.size:
            i += np.uint64(1)
            u = _mix(h + i * _A)
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            cell = owner * size + ((_mix(u ^ _B) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(first, cell, time)
            won = time == first[cell]
            out[cell[won]] = h[won]
            late = first.reshape(docs, size).max(axis=1)
            alive = time < late[owner]
            h, owner, rate, time = h[alive], owner[alive], rate[alive], time[alive]
    return out.reshape(docs, size)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.zeros((len(registers), bands), np.uint64)
    parts = registers.reshape(len(registers), bands, rows)
    for j in range(rows):
        total = _mix(total * _B + parts[:, :, j])
    return _mix(total + np.arange(1, bands + 1, dtype=np.uint64) * _A).view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, same (digest of the text), n (distinct shingles), bands (keys; none for a text without words).
    Every shingle weighs 1, however often it occurs: a link is defined by the Jaccard similarity of the sets, so
    the bands have to follow the same measure."""

    def make():
        def step(batch):
            texts = batch.column(1).to_pylist()
            sets = [(h, np.ones_like(c)) for h, c in (shingles(x, k) for x in texts)]
            some = [i for i, s in enumerate(sets) if s[0].size]
            registers = prob_minhash([sets[i] for i in some], bands * rows)
            keys = band_keys(registers, bands, rows)
            lists = [[]] * len(texts)
            for i, row in zip(some, keys.tolist(), strict=True):
                lists[i] = row
            return {"doc_id": batch.column(0), "same": pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary()), "n": [s[0].size for s in sets], "bands": lists}

        return step

    return mapped(docs.select("doc_id", full_text().cast("binary").alias("text")), make, fields(doc_id=docs.schema["doc_id"].dataType, same="binary", n="int", bands="array<long>"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id and its sorted shingle hashes (eight bytes each) for the documents whose doc_id is in ``wanted`` (id)."""

    def make():
        def step(batch):
            return {"id": batch.column(0), "words": pa.array([shingles(x, k)[0].tobytes() for x in batch.column(1).to_pylist()], pa.binary())}

        return step

    rows = docs.select("doc_id", full_text().cast("binary").alias("text")).join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("id"), "left_semi")
    return mapped(rows, make, fields(id=docs.schema["doc_id"].dataType, words="binary"))


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``both``, how many shingles their sets share, and the sizes ``na`` and ``nb``."""

    def make():
        def step(batch):
            x, y = ([np.frombuffer(w, np.uint64) for w in batch.column(k).to_pylist()] for k in (2, 3))
            both = [np.intersect1d(p, q, assume_unique=True).size for p, q in zip(x, y, strict=True)]
            return {"a": batch.column(0), "b": batch.column(1), "both": both, "na": [p.size for p in x], "nb": [q.size for q in y]}

        return step

    left, right = sets.select(F.col("id").alias("a"), F.col("words").alias("x")), sets.select(F.col("id").alias("b"), F.col("words").alias("y"))
    kind = sets.schema["id"].dataType
    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), make, fields(a=kind, b=kind, both="int", na="int", nb="int"))


def linked(pairs: DataFrame, similar: float) -> DataFrame:
    """Those of the measured pairs whose Jaccard similarity is ``similar`` or more."""
    return pairs.filter(F.col("both") >= F.lit(similar) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def alone_counts(sets: DataFrame) -> DataFrame:
    """id and ``alone``: how many of its shingles no other of the sets has (0: no row)."""

    def make():
        def step(batch):
            parts = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            return {"id": batch.column(0).take(pa.array(np.repeat(np.arange(len(parts)), [x.size for x in parts]))), "word": np.concatenate(parts)}

        return step

    words = mapped(sets, make, fields(id=sets.schema["id"].dataType, word="long"))
    return words.groupBy("word").agg(F.min("id").alias("id"), F.count("*").alias("times")).filter("times = 1").groupBy("id").agg(F.count("*").alias("alone"))


def components(edges: DataFrame) -> DataFrame:
    """id and ``label``, the least id of its component, for every node of ``edges`` (a, b).

    Each round a node takes the least label next to it and then that label's label; the rounds end when none
    changes. Rounds are written, and what is kept is the last round, one row a node.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_b")).select("id", F.least("id", "_b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "_near").alias("_new"))
        up = labels.select(F.col("id").alias("_new"), F.col("label").alias("_up"))
        new = written(step.join(up, "_new", "left").select("id", F.col("label").alias("_old"), F.least("_new", "_up").alias("label")), "labels")
        discard(labels)
        labels = new
        if new.filter("label <> _old").isEmpty():
            discard(both)
            return labels.select("id", "label")


def near_duplicates(docs: DataFrame, k: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), kept (whether it is that document).

    A link joins two texts whose sets of ``k``-word shingles have a Jaccard similarity of ``similar`` or more;
    classes are the components of the links. Equal texts are one class throughout; a null text is empty, and
    a text without words is like its equals only. Fewer than ``k`` words are one shingle. Equal rows are one
    document; different texts of one doc_id are documents of their own, ordered by doc_id and then by the SHA-256 of
    the text. A null doc_id stands alone (class_id null, kept). An empty table gives no rows. Only doc_id and
    text are read.
    """
    own = own_id(docs, "doc_id", "text")
    named = docs.select("doc_id", own.alias("own"), full_text().alias("text"))
    found = settled("near-duplicates", lambda: classes(named.select(F.col("own").alias("doc_id"), "text"), k, similar, bands, rows))
    out = named.select("doc_id", "own").join(found.withColumnRenamed("doc_id", "_own"), F.col("own") == F.col("_own"), "left")
    first = F.col("class_id.id") if isinstance(found.schema["class_id"].dataType, StructType) else F.col("class_id")
    return out.select("doc_id", first.alias("class_id"), F.coalesce(F.col("own") == F.col("class_id"), F.lit(True)).alias("kept"))


def own_id(docs: DataFrame, key: str, text: str) -> Column:
    """What tells documents apart: the doc_id, or (id, digest of the text) where a doc_id repeats."""
    known = F.col(key).isNotNull()
    if docs.filter(known).groupBy(key).count().filter("count > 1").isEmpty():
        return F.col(key)
    return F.when(known, F.struct(F.col(key).alias("id"), F.sha2(full_text(text).cast("binary"), 256).alias("digest")))


def classes(docs: DataFrame, k: int, similar: float, bands: int, rows: int) -> DataFrame:
    """doc_id and class_id of every document of known id.

    Equal texts count once, by their least id. Texts that share a band are compared in two steps. First each
    with the hub of the band's bucket, the text with the fewest shingles that no other text at hand has: copies of
    one text thus link up with it, or with the least changed of them, in as many comparisons as they are. Then, of
    a bucket that still holds several components, everything outside its largest component with all of other
    components. Every pair that shares a band is so compared or already in one class.
    """
    sk = written(sketches(docs, k, bands, rows).filter("doc_id IS NOT NULL"), "sketches")
    same = written(sk.groupBy("same").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("n", "bands"), "doc_id").alias("of")).select("same", "id", "of.*"), "distinct-texts")
    # Nothing but ids goes along until the buckets of one text, which are nearly all, are gone. What is joined back
    # is written first: a join of two shuffles splits a hot key, one of a shuffle and an aggregate can't.
    every = same.select("id", F.explode("bands").alias("bucket"))
    shared = written(every.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").drop("size"), "shared-buckets")
    members = written(every.join(shared, "bucket"), "bucket-members")
    sets = written(shingle_sets(docs, members.select("id").distinct(), k).dropDuplicates(["id"]), "shingle-sets")
    alone = written(alone_counts(sets), "alone")
    members = members.join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    hubs = written(members.groupBy("bucket").agg(F.min(F.struct("alone", "id"))["id"].alias("hub")), "hubs")
    buckets = written(members.join(hubs, "bucket"), "buckets")
    star = written(measured(buckets.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), sets), "star")
    first = components(linked(star, similar))
    inner = star.select(F.col("a").alias("id"), F.col("b").alias("hub"), "both", F.col("na").alias("n"))
    placed = buckets.join(first, "id", "left").withColumn("label", F.coalesce("label", "id"))
    pairs = written(open_pairs(placed.join(inner, ["id", "hub"], "left"), similar), "pairs")
    more = linked(measured(pairs, sets), similar).join(first.select(F.col("id").alias("a"), F.col("label").alias("_a")), "a", "left").join(first.select(F.col("id").alias("b"), F.col("label").alias("_b")), "b", "left")
    second = components(more.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    label = first.select("id", F.col("label").alias("_first"))
    last = second.select(F.col("id").alias("_mid"), F.col("label").alias("_second"))
    found = same.select("same", "id").join(label, "id", "left").withColumn("_mid", F.coalesce("_first", "id")).join(last, "_mid", "left").select("same", F.coalesce("_second", "_mid").alias("class_id"))
    return sk.select("doc_id", "same").join(written(found, "classes"), "same").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def open_pairs(placed: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket, other than those with its hub.

    In a bucket all but the largest component are set against the rest, and the join itself drops pairs that
    can't be linked. Of a text with n shingles, ``both`` are shared with the bucket's hub and ``alone`` occur in
    no other text at hand. Two texts share at most the lesser ``both`` of the hub's shingles, and of others at
    most the lesser n - both - alone; where that is too little for a link they needn't be compared. So the many
    variants of one text that are too far from it for a link aren't compared among each other. Two texts of
    several common buckets are a pair in the first of them only.
    """
    parts = placed.groupBy("bucket", "label").agg(F.count("*").alias("_members"))
    by = W.partitionBy("bucket")
    parts = parts.withColumn("_parts", F.count("*").over(by)).filter("_parts > 1").withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_members"), "label")))
    rows = placed.filter("id <> hub").filter(F.col("n") - F.col("alone") >= F.lit(similar) * F.col("n"))
    rows = rows.withColumn("other", F.col("n") - F.col("both") - F.col("alone")).join(parts.select("bucket", "label", "_rank"), ["bucket", "label"])
    open_ids = rows.select("id").distinct()
    listed = placed.join(open_ids, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    rows = rows.join(listed, "id")

    def side(x: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(x + c) for c in ("bucket", "id", "n", "both", "other", "_rank", "buckets")])

    most = F.least("aboth", "bboth") + F.least("aother", "bother")
    possible = most >= F.lit(similar) * (F.col("an") + F.col("bn") - most)
    once = F.get(F.array_intersect("abuckets", "bbuckets"), F.lit(0)) == F.col("abucket")
    joined = side("a").filter("a_rank > 1").join(side("b"), (F.col("abucket") == F.col("bbucket")) & (F.col("b_rank") < F.col("a_rank")) & possible & once)
    return joined.select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b")).distinct()


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one of least doc_id; its columns unchanged.

    Where a doc_id repeats, its different texts are documents of their own (see ``near_duplicates``): each stays or
    goes as its own text is judged. Of rows of one doc_id and one text (null is empty) one stays, that of the
    least hash of all columns but maps.
    """
    rows, key, text = numbered(docs), f"c{docs.columns.index('doc_id')}", f"c{docs.columns.index('text')}"
    own = own_id(rows, key, text)
    named = rows.withColumn("own", own)
    found = settled("near-duplicates", lambda: classes(named.select(F.col("own").alias("doc_id"), F.col(text).alias("text")), WORDS, SIMILAR, BANDS, ROWS))
    gone = found.filter("doc_id <> class_id").select("doc_id")
    kept = named.join(gone, F.col("own") == F.col("doc_id"), "left_anti")
    if not isinstance(found.schema["doc_id"].dataType, StructType):
        return kept.select(*rows.columns).toDF(*docs.columns)
    kept = kept.withColumn("again", F.when(F.col("own").isNull(), F.monotonically_increasing_id()))
    order = F.xxhash64(*[f.name for f in rows.schema if not _has_map(f.dataType)])
    return kept.groupBy("own", "again").agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*").toDF(*docs.columns)


def _has_map(kind: DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return isinstance(kind, MapType) or any(map(_has_map, inner))


def op9_neardups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
