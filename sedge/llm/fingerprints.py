"""Order MinHash fingerprints with built-in functions only.

A text is cut into tokens, every ``K`` consecutive tokens are a k-mer, and a k-mer's n-th occurrence is an element
of its own. A run of up to ``TOKEN`` characters between white space is a token; of a longer run, as in scripts without
spaces, every character is one, so that cuts depend on what is there and not on where the run began. Elements are
hashed once and dealt by hash into ``SLOTS * 2`` strata; the least element of each is kept. The two kept elements of a
slot are put in text order and hashed together, so a slot agrees only if both texts select the same elements in the
same order: the share of agreeing slots falls with moved as well as with changed passages, as the edit distance does.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sedge.llm.work import discard, full_text, table, written

#: Tokens a k-mer has; slots of a fingerprint, two strata each; characters of a token at most.
K, SLOTS, TOKEN = 2, 32, 16
TOKENS = rf"(?<!\S)\S{{1,{TOKEN}}}(?!\S)|\S"
#: An element is packed into a long: 33 bits of hash (the leading ones are the stratum), 30 bits of position, more
#: than a row's array of longs can have.
HASH_BITS, PLACE_BITS = 33, 30
#: From this bit on, the stratum.
STRATUM_BIT = HASH_BITS + PLACE_BITS - (2 * SLOTS - 1).bit_length()
#: Bytes of a run of neighbouring documents, runs at most, cells that a run is put together from, and bytes of a task.
RUN, RUNS, FINER, TASK = 4 << 20, 50_000, 8, 64 << 20

_PLACE = (1 << PLACE_BITS) - 1


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.bitwiseAND(F.lit((1 << HASH_BITS) - 1)), PLACE_BITS).bitwiseOR(place)


def _leads(x: Column, before: Column) -> Column:
    """Whether ``x`` is of another stratum than the element before it (null: there is none)."""
    return F.coalesce(x.bitwiseXOR(before) >= (1 << STRATUM_BIT), F.lit(True))


def with_order_minhash(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, an array of ``SLOTS`` longs; a slot without elements is null.

    ``text`` is a string column without nulls. A text without tokens has nulls only, one of fewer than ``K``
    tokens has shorter k-mers. What is used twice is a column of its own, so that the optimizer doesn't repeat it
    inside a lambda.
    """
    t, s, c, d = (F.col(f"_{out}_{x}") for x in "tscd")
    df = df.withColumn(f"_{out}_t", F.regexp_extract_all(F.col(text), F.lit(TOKENS), F.lit(0)))
    kmers = F.transform(t, lambda x, i: _packed(F.xxhash64(x, *[F.get(t, i + k) for k in range(1, K)]), i.bitwiseAND(F.lit(_PLACE)).cast("long")))
    df = df.withColumn(f"_{out}_s", F.sort_array(kmers)).drop(f"_{out}_t")

    # Sorted, the least of a stratum comes first in it, and a k-mer that comes again follows its equal.
    def wanted(x: Column, i: Column) -> Column:
        apart = x.bitwiseXOR(F.get(s, i - 1))
        return F.coalesce((apart >= (1 << STRATUM_BIT)) | (apart <= _PLACE), F.lit(True))

    df = df.withColumn(f"_{out}_c", F.filter(s, wanted)).drop(f"_{out}_s")

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y) <= _PLACE, F.lit(False))

    def numbered(x: Column, i: Column) -> Column:
        """A repeated k-mer with its occurrence number hashed in; doubling steps find where its run begins."""
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(PLACE_BITS))])
        back = F.aggregate(steps, F.lit(0), lambda n, step: F.when((i - n - step >= 0) & equal(x, F.get(c, i - n - step)), n + step).otherwise(n))
        first = F.transform(F.array(back), lambda n: n + F.when(_leads(F.get(c, i - n), F.get(c, i - n - 1)), F.lit(0)).otherwise(F.lit(1)))
        return _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), F.get(first, F.lit(0))), x.bitwiseAND(F.lit(_PLACE)))

    every = F.sort_array(F.transform(c, lambda x, i: F.when(_leads(x, F.get(c, i - 1)), x).otherwise(numbered(x, i))))
    df = df.withColumn(f"_{out}_d", every).drop(f"_{out}_c")
    least = F.filter(d, lambda x, i: _leads(x, F.get(d, i - 1)))

    def joined(a: Column, b: Column) -> Column:
        """The hash of a slot's one or two elements in text order."""
        x, y = F.shiftright(a, PLACE_BITS), F.shiftright(b, PLACE_BITS)
        return F.when(b.isNull(), F.xxhash64(x)).when(a.bitwiseAND(F.lit(_PLACE)) <= b.bitwiseAND(F.lit(_PLACE)), F.xxhash64(x, y)).otherwise(F.xxhash64(y, x))

    def slot(kept: Column, j: Column) -> Column:
        pair = F.filter(kept, lambda x: F.shiftright(x, STRATUM_BIT + 1) == j)
        return F.get(F.transform(F.array(pair), lambda p: F.when(F.size(p) > 0, joined(F.get(p, F.lit(0)), F.get(p, F.lit(1))))), F.lit(0))

    def slots(kept: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(SLOTS - 1))
        full = F.transform(numbers, lambda j: joined(F.get(kept, 2 * j), F.get(kept, 2 * j + 1)))
        return F.when(F.size(kept) == 2 * SLOTS, full).otherwise(F.transform(numbers, lambda j: slot(kept, j)))

    # Bound as the one element of an array, the kept elements are found once a text and not once a slot.
    return df.withColumn(out, F.get(F.transform(F.array(least), slots), F.lit(0))).drop(f"_{out}_d")


def as_text(slots: Column) -> Column:
    """16 hex digits a slot; a slot without elements is 16 dots."""
    return F.array_join(F.transform(slots, lambda x: F.coalesce(F.lpad(F.hex(x), 16, "0"), F.lit("." * 16))), "")


def likeness(a: Column, b: Column) -> Column:
    """Agreeing slots among those either text fills; 1 where neither fills any."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda x: x))
    return F.when(filled == 0, F.lit(1.0)).otherwise(agree / F.greatest(filled, F.lit(1)))


def sort_key(df: DataFrame, key: str, text: str) -> Column:
    """Text that sorts as ``key`` does, null first, and rows of one key by a hash of ``text``: integers by number, ids
    of other types by their text."""
    if isinstance(df.schema[key].dataType, IntegralType):
        own = F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        own = F.col(key).cast("string")
    return F.concat(F.coalesce(F.concat(F.lit("1"), own), F.lit("0")), F.lit("\0"), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def _located(key: Column, bounds: list[str]) -> Column:
    """The index of the last of the ascending ``bounds`` that is not above ``key``, by bisection."""
    array = F.from_json(F.lit(json.dumps(bounds)), "array<string>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.get(F.transform(F.array(array), lambda b: F.aggregate(steps, F.lit(0), lambda p, step: F.when((p + step < F.size(b)) & (F.get(b, p + step) <= key), p + step).otherwise(p))), F.lit(0))


def in_runs(rows: DataFrame, key: str, text: str, run: int = RUN) -> DataFrame:
    """``rows`` dealt into runs of neighbouring ``key``: ``_run``, and ``_ghost``.

    Bounds are keys of the table, picked by hash; cells between them are put together into runs of about
    ``run`` bytes of text, more where there would be over ``RUNS``. The rows at a bound are also sent to the run
    before as ghosts (1), and those of the least key to the last run (2), so a run holds every successor of its
    rows. Keys and lengths alone are read for this, and at most about ``FINER * RUNS`` keys collected. Runs are
    dealt into as many partitions as their bytes need, at least those of the session's shuffles.
    """
    spark = rows.sparkSession
    sizes = written(rows.select(key, F.octet_length(text).cast("long").alias("bytes")), "run-sizes")
    n, total, least = sizes.agg(F.count("*"), F.sum("bytes"), F.min(key)).first()
    run = max(run, (total or 0) // RUNS)
    apart = max(1, n * run // max(1, FINER * (total or 0)))
    cells = sorted({least, *(r[0] for r in sizes.filter(F.pmod(F.xxhash64(key), F.lit(apart)) == 0).select(key).distinct().collect())}) if n else [""]
    held = dict(sizes.groupBy(_located(F.col(key), cells).alias("cell")).agg(F.sum("bytes")).collect())
    discard(sizes)
    bounds, filled = cells[:1], held.get(0, 0)
    for i, bound in enumerate(cells[1:], 1):
        if filled + held.get(i, 0) > run:
            bounds.append(bound)
            filled = 0
        filled += held.get(i, 0)
    placed = rows.withColumn("_run", _located(F.col(key), bounds)).withColumn("_first", F.get(F.from_json(F.lit(json.dumps(bounds)), "array<string>"), "_run") == F.col(key))
    before = F.when(F.col("_run") > 0, F.struct((F.col("_run") - 1).alias("run"), F.lit(1).alias("ghost"))).otherwise(F.struct(F.lit(len(bounds) - 1).alias("run"), F.lit(2).alias("ghost")))
    own = F.struct(F.col("_run").alias("run"), F.lit(0).alias("ghost"))
    copied = placed.withColumn("_at", F.explode(F.when(F.col("_first"), F.array(own, before)).otherwise(F.array(own)))).drop("_run", "_first").select("*", F.col("_at.run").alias("_run"), F.col("_at.ghost").alias("_ghost")).drop("_at")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // TASK)
    return copied.repartition(parts, "_run")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points replaced by the first of the next document's, in
    order of doc_id (null first; ids that are no integers by their text; rows of one doc_id by a hash of the text,
    then by the text), the first following the last. A null text is empty; a table of one row is its own next; an
    empty table gives no rows. Only doc_id and text are read, and the texts are shuffled once.
    """
    rows = docs.select("doc_id", full_text().alias("text"))
    rows = in_runs(rows.withColumn("_key", sort_key(rows, "doc_id", "text")), "_key", "text")
    rows = with_order_minhash(rows, "text", "slots")
    order = W.partitionBy("_run").orderBy((F.col("_ghost") == 2), "_key", "_ghost", "text")
    rows = rows.withColumn("_next", F.lead("text").over(order)).withColumn("next_slots", F.lead("slots").over(order)).filter("_ghost = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_quarter")).cast("int")), F.substring("_next", F.lit(1), F.col("_quarter")))
    rows = rows.select("doc_id", "n_chars", "slots", "next_slots", edited.alias("edited"))
    rows = with_order_minhash(rows, "edited", "edited_slots")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("slots")).alias("fingerprint"),
        as_text(F.col("edited_slots")).alias("edited_fingerprint"), likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"), likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
