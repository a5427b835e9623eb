"""Substring dedup: repeated word spans found by compacting a De Bruijn graph of word windows.

An edge of the graph is a window of ``span`` consecutive words. Windows of a text that share their minimizer (the
least hash among their ``mini``-word parts) follow each other and form a path; equal windows have equal
minimizers, so equal windows meet under one minimizer wherever they stand. A path is keyed by its minimizer and
a digest of its words: equal paths compact into the first document that has them, in joins on those keys. A
minimizer under which different paths meet is a branching place; only there the paths are opened into their
windows, which meet by digest again. Source coordinates (document, first word) travel along, and at the end the
words of every repeated run are held against those at its source coordinates.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.work import fields, full_text, mapped, numbered, settled, table, written

SPAN, MINI = 50, 12
#: Words of a block of source words; parts that the paths of a branching minimizer are dealt into.
BLOCK, PARTS = 64, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as longer batches come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size < n:
            n = 2 * n
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def word_paths(docs: DataFrame, span: int, mini: int) -> DataFrame:
    """The paths of each text: mini (hash), path (digest of the words), doc_id, at (tag and first word), n (windows)."""

    def make():
        from xxhash import xxh64_intdigest

        powers = _Powers()

        def step(batch):
            texts = [x.split() for x in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in texts])
            if not (sizes >= span).any():
                return None
            ends = np.cumsum(sizes)
            words = [w for x in texts for w in x]
            up, down = powers.upto(len(words) + 1)
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)) * up[: len(words)], out=sums[1:])
            part = _mix((sums[mini:] - sums[:-mini]) * down[: len(words) - mini + 1])
            least = _least(part, span - mini + 1)
            owner = np.repeat(np.arange(len(texts)), sizes)[: least.size]
            place = np.arange(least.size)
            whole = np.flatnonzero(place + span <= ends[owner])
            owner, least = owner[whole], least[whole]
            new = np.ones(whole.size, bool)
            new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, whole.size))
            first, owner = whole[starts], owner[starts]
            paths = [hashlib.blake2b(b" ".join(words[a:b]), digest_size=8).digest() for a, b in zip(first.tolist(), (first + counts + span - 1).tolist(), strict=True)]
            tags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            at = (tags << 32) | (first - (ends - sizes)[owner])
            return {"mini": least[starts].view(np.int64), "path": np.frombuffer(b"".join(paths), "<i8"), "doc_id": batch.column(0).take(pa.array(owner)), "at": at, "n": counts.astype(np.int32)}

        return step

    kind = docs.schema["doc_id"].dataType
    return mapped(docs.filter(F.col("doc_id").isNotNull()), make, fields(mini="long", path="long", doc_id=kind, at="long", n="int"))


def _windows(texts: DataFrame, span: int) -> DataFrame:
    """Each window of the listed paths of a text: window (16-byte digest), doc_id, at."""

    def make():
        def step(batch):
            out, rows, at = [], [], []
            for i, (text, tag, firsts, counts) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 1, 3, 4)), strict=True)):
                words = text.split()
                wanted = sorted({p for a, n in zip(firsts, counts, strict=True) for p in range(a, a + n)})
                out += [hashlib.blake2b(b" ".join(words[p : p + span]), digest_size=16).digest() for p in wanted]
                rows += [i] * len(wanted)
                at += [(tag << 32) | p for p in wanted]
            return {"window": pa.array(out, pa.binary()), "doc_id": batch.column(0).take(pa.array(rows, pa.int32())), "at": pa.array(at, pa.int64())} if rows else None

        return step

    return mapped(texts, make, fields(window="binary", doc_id=texts.schema["doc_id"].dataType, at="long"))


def _tag(at: str) -> Column:
    return F.shiftright(at, 32).cast("int")


def _word(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _texts(docs: DataFrame) -> DataFrame:
    text = full_text()
    return docs.select("doc_id", F.hash(text).alias("tag"), text.cast("binary").alias("text"))


def _listed(spans: DataFrame) -> DataFrame:
    """One row per text with the list of its spans; a text has no more of them than words."""
    return spans.groupBy("doc_id", _tag("at").alias("tag")).agg(F.collect_list(_word("at")).alias("firsts"), F.collect_list("n").alias("counts")).hint("shuffle_hash")


def repeated_spans(docs: DataFrame, span: int = SPAN, mini: int = MINI, texts: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, at, n, src, src_at): ``n`` windows of a document from word ``at`` on whose words also stand
    in document ``src``, of smaller id, from ``src_at`` on. ``at`` holds the text's tag and the word's index."""
    texts = _texts(docs) if texts is None else texts
    paths = written(word_paths(_texts(docs), span, mini), "paths")
    # What is joined back is written first: a join of two shuffles splits a hot key, one of a shuffle and an aggregate can't.
    met = written(paths.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("mini"), "shared-minis")
    shared = written(paths.join(met, "mini", "left_semi"), "shared-paths")
    firsts = written(shared.groupBy("mini", "path").agg(F.min("doc_id").alias("src"), F.min_by("at", "doc_id").alias("src_at"), F.max("doc_id").alias("hi")), "first-paths")
    again = firsts.filter("src < hi").select("mini", "path", "src", "src_at")
    equal = shared.join(again, ["mini", "path"]).filter("doc_id > src").select("doc_id", "at", "n", "src", "src_at")
    branching = firsts.groupBy("mini").agg(F.count("*").alias("ways"), F.min("src").alias("lo"), F.max("src").alias("hi")).filter("ways > 1 AND lo < hi").select("mini")
    # A very common passage has paths without number under one minimizer: they are dealt into parts, and the
    # minimizers, a few bytes each, are copied to every part.
    parts = written(branching, "branching").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # A document may hold a path in several places, and none of them has been held against other paths yet.
    places = firsts.withColumn("part", F.pmod("path", F.lit(PARTS)).cast("int")).join(parts, ["mini", "part"], "left_semi").select("mini", "path", F.col("src").alias("doc_id"))
    opened = shared.join(places, ["mini", "path", "doc_id"], "left_semi").select("doc_id", "at", "n")
    windows = written(_windows(texts.join(_listed(opened), ["doc_id", "tag"]), span), "windows")
    first = written(windows.groupBy("window").agg(F.min("doc_id").alias("src"), F.min_by("at", "doc_id").alias("src_at"), F.max("doc_id").alias("hi")).filter("src < hi").drop("hi"), "first-windows")
    single = windows.join(first, "window").filter("doc_id > src").select("doc_id", "at", F.lit(1).alias("n"), "src", "src_at")
    return equal.unionByName(single)


def runs(spans: DataFrame, span: int) -> DataFrame:
    """The spans of a document that follow each other in one source, as one: doc_id, tag, at, n (words), src, src_tag,
    src_at. A document has no more spans than words."""
    lists = spans.groupBy("doc_id", _tag("at").alias("tag")).agg(F.collect_list(F.struct(_word("at").alias("at"), "n", "src", _tag("src_at").alias("src_tag"), _word("src_at").alias("src_at"))).alias("spans"))

    def make():
        def step(batch):
            out = {"row": [], "at": [], "n": [], "src": [], "src_tag": [], "src_at": []}
            for i, found in enumerate(batch.column(2).to_pylist()):
                keyed = sorted(((repr(x["src"]), x["src_tag"], x["src_at"] - x["at"], x["at"], x["n"]), k) for k, x in enumerate(found))
                for _, line in groupby(keyed, key=lambda x: x[0][:3]):
                    end = -1
                    for (_, src_tag, shift, at, n), k in line:
                        if at <= end:
                            out["n"][-1] = max(end, at + n) - out["at"][-1]
                        else:
                            for name, value in zip(out, (i, at, n, found[k]["src"], src_tag, at + shift), strict=True):
                                out[name].append(value)
                        end = max(end, at + n)
            own = pa.array(out.pop("row"), pa.int32())
            return {"doc_id": batch.column(0).take(own), "tag": batch.column(1).take(own), **out, "n": [n + span - 1 for n in out["n"]]}

        return step

    kind = spans.schema["doc_id"].dataType
    return mapped(lists, make, fields(doc_id=kind, tag="int", at="int", n="int", src=kind, src_tag="int", src_at="int"))


def proofs(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, tag and of each run its source words: a list of (at, n, src_at, block, words).

    Sources are cut into blocks of ``BLOCK`` words and only those asked for are written, each once, however many
    documents ask; a block is a few hundred bytes, and a popular one is an ordinary skewed key of a join of
    two written tables.
    """
    first, last = (F.expr(x).cast("int") for x in (f"src_at div {BLOCK}", f"(src_at + n - 1) div {BLOCK}"))
    asked = found.withColumn("block", F.explode(F.sequence(first, last)))
    wanted = asked.groupBy(F.col("src").alias("doc_id"), F.col("src_tag").alias("tag")).agg(F.collect_set("block").alias("blocks")).hint("shuffle_hash")

    def make():
        def step(batch):
            rows, blocks, words = [], [], []
            for i, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                every = text.split()
                rows += [i] * len(own)
                blocks += own
                words += [b" ".join(every[b * BLOCK : (b + 1) * BLOCK]) for b in own]
            at = pa.array(rows, pa.int32())
            return {"src": batch.column(0).take(at), "src_tag": batch.column(1).take(at), "block": blocks, "words": words}

        return step

    kind = texts.schema["doc_id"].dataType
    cut = mapped(texts.join(wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "blocks"), make, fields(src=kind, src_tag="int", block="int", words="binary"))
    held = written(cut.dropDuplicates(["src", "src_tag", "block"]), "source-blocks")
    joined = asked.join(held, ["src", "src_tag", "block"])
    return joined.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n", "src_at", "block", "words")).alias("proofs")).hint("shuffle_hash")


def staying(words: list[bytes], proof: list[dict], span: int) -> list[bytes]:
    """``words`` without those of runs of ``span`` or more that equal the source's words."""
    stay = np.ones(len(words), bool)
    for (at, n, src_at), parts in groupby(sorted(proof, key=lambda x: (x["at"], x["n"], x["src_at"], x["block"])), key=lambda x: (x["at"], x["n"], x["src_at"])):
        source, shift = [], 0
        for part in parts:
            shift = shift if source else src_at - part["block"] * BLOCK
            source += part["words"].split(b" ")
        own, theirs = words[at : at + n], source[shift : shift + n]
        if own == theirs:
            stay[at : at + n] = False
            continue
        at_run = at
        for same, run in groupby(a == b for a, b in zip(own, theirs, strict=False)):
            length = len(list(run))
            if same and length >= span:
                stay[at_run : at_run + length] = False
            at_run += length
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def repeats(docs: DataFrame, span: int, mini: int) -> DataFrame:
    """doc_id, tag and proofs of the documents that repeat words of others."""
    if not 1 <= mini <= span:
        raise ValueError("mini must be from 1 to span")
    texts = _texts(docs)
    found = settled("repeated-runs", lambda: runs(repeated_spans(docs, span, mini, texts), span))
    return proofs(texts, found)


def without_repeats(docs: DataFrame, span: int = SPAN, mini: int = MINI, keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with ``keep``, kept (the words kept, as UTF-8).

    A word goes if it lies in a window of ``span`` words of its document that also starts in a document of
    smaller id, as the input stands. A null or empty text has no words; a document of fewer than ``span``
    words, or of null id, loses none and is no source. Repeated rows of one id are judged alike and never
    against each other; texts may be of any length, tables empty. Only doc_id and text are read.
    """
    found = repeats(docs, span, mini)

    def make():
        def step(batch):
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, proof in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                left = staying(words, proof, span) if proof else words
                kept = b" ".join(left)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if keep else None)
            return {"doc_id": batch.column(0), **out}

        return step

    joined = _texts(docs).join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "proofs")
    rows = mapped(joined, make, fields(doc_id=docs.schema["doc_id"].dataType, n_words="long", n_removed="long", kept_sha256="string", kept="binary"))
    return rows if keep else rows.drop("kept")


def cleaned(docs: DataFrame, span: int = SPAN, mini: int = MINI) -> DataFrame:
    """``docs`` with the repeated words of each text removed, as ``without_repeats`` judges them.

    A text that loses words becomes the kept ones joined by one space, and ``n_chars``, where there is such a
    column, its code points; every other row and column stays as it is. No row is dropped.
    """
    names = docs.columns
    at, key = names.index("text"), F.col(f"c{names.index('doc_id')}")
    rows = numbered(docs)
    tagged = rows.withColumn("tag", F.hash(full_text(f"c{at}")))
    found = repeats(docs, span, mini).withColumnRenamed("tag", "own_tag")
    joined = tagged.join(found, (key == F.col("doc_id")) & (F.col("tag") == F.col("own_tag")), "left").select(*rows.columns, "proofs")

    def make():
        def step(batch):
            texts, sizes = batch.column(at).to_pylist(), {}
            for i, proof in enumerate(batch.column(len(names)).to_pylist()):
                if proof:
                    words = texts[i].encode().split()
                    left = staying(words, proof, span)
                    if len(left) < len(words):
                        texts[i] = b" ".join(left).decode()
                        sizes[i] = len(texts[i])
            out = {f"c{k}": batch.column(k) for k in range(len(names))}
            out[f"c{at}"] = texts
            if "n_chars" in names and sizes:
                count = f"c{names.index('n_chars')}"
                out[count] = [sizes.get(i, v) for i, v in enumerate(out[count].to_pylist())]
            return out

        return step

    return mapped(joined, make, rows.schema).toDF(*names)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled("op10-substrings", lambda: without_repeats(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM win JOIN firsts USING (h), range(50) AS t(k) WHERE d < doc_id),
each_word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.j) AS text
  FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
