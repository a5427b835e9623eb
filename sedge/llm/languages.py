"""Language identification in two steps: the family by linear SVMs, then the language within it by one-versus-one SVMs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.llm.work import fields, mapped, numbered, table

#: ISO 639-1 codes by branch. A code not listed is of the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr tt uz",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

#: Columns of the hashed trigram counts, and rows turned into a dense block at a time.
WIDTH, BLOCK = 4096, 256
#: Rows a language may give to the sample that is fit on, about.
PER_LANGUAGE = 600

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters becomes a space; bytes of longer characters stay.
_PLAIN = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of damped counts of lower-case byte trigrams over whole texts."""
    out = np.empty((len(texts), WIDTH), np.float32)
    for a in range(0, len(texts), BLOCK):
        plain = [b" " + x.lower().encode().translate(_PLAIN) + b" " for x in texts[a : a + BLOCK]]
        data = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(plain), dtype=np.int64), [len(x) for x in plain])
        code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        cell = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        keep = (owner[:-2] == owner[2:]) & (code != 0x202020)
        counts = np.bincount((owner[:-2] * WIDTH + cell)[keep], minlength=len(plain) * WIDTH).reshape(-1, WIDTH)
        block = np.sqrt(counts).astype(np.float32)
        out[a : a + BLOCK] = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    return out


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge, classes of equal weight) by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        v /= np.linalg.norm(v) or 1
    rate = np.float32(1 / (2 * float(np.linalg.norm(x.T @ (share * (x @ v)))) * 1.1 + penalty))
    w, z, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (np.float32(penalty) * z - 2 * (x.T @ (share * slack * y)))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + np.float32((t - 1) / after) * (new - w), new, after
    return w


@dataclass
class Model:
    """Weights: ``family`` one row per family against the rest, ``pairs`` of each family one row per pair of its languages."""

    families: list[str]
    family: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[str, np.ndarray]
    slope: float = 4.0

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a in range(0, len(texts), BLOCK):
            x = features(texts[a : a + BLOCK])
            x = np.hstack([x, np.ones((len(x), 1), np.float32)])
            first = self._share(x @ self.family.T) if len(self.families) > 1 else np.ones((len(x), 1))
            chosen = first.argmax(1)
            for i, k in enumerate(chosen):
                name = self.families[k]
                own = self.languages[name]
                best, inner = 0, 1.0
                if len(own) > 1:
                    won = np.zeros(len(own))
                    for (p, q), m in zip(combinations(range(len(own)), 2), self.pairs[name] @ x[i], strict=True):
                        s = 1 / (1 + np.exp(-np.clip(self.slope * m, -30, 30)))
                        won[p] += s
                        won[q] += 1 - s
                    best = int(won.argmax())
                    inner = won[best] / (len(own) - 1)
                names.append(own[best])
                scores.append(round(float(np.clip(first[i, k] * inner, 0, 1)), 5))
        return names, scores

    def _share(self, margins: np.ndarray) -> np.ndarray:
        e = np.exp(np.clip(self.slope * (margins - margins.max(1, keepdims=True)), -60, 0))
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    known = sorted(set(langs))
    by = {}
    for code in known:
        by.setdefault(FAMILY.get(code, "other"), []).append(code)
    names, of = sorted(by), np.array(langs)
    family_of = np.array([FAMILY.get(c, "other") for c in langs])
    family = np.stack([fit_svm(x, family_of == n) for n in names]) if len(names) > 1 else np.zeros((len(names), x.shape[1] + 1), np.float32)
    pairs = {}
    for n in names:
        rows = [fit_svm(x[m], of[m] == p) for p, q in combinations(by[n], 2) for m in [(of == p) | (of == q)]]
        pairs[n] = np.stack(rows) if rows else np.zeros((0, x.shape[1] + 1), np.float32)
    return Model(names, family, by, pairs)


def _remainder(k: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(k))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of labelled documents outside the held-out fold: of each language the
    ``per_language`` texts of least hash of doc_id and text. None if there are none.

    Hashes well above the bound are left out before texts move; the bound itself is exact, and equal texts
    count once, so neither a doc_id of very many rows nor the order of tasks changes the model.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").filter(_remainder(5) != 0)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2 * per_language / n))]), F.col("lang"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text")).filter(F.pmod("_h", F.lit(1 << 30)) / float(1 << 30) < share)
    rows = rows.groupBy("lang", "text").agg(F.min(F.pmod("_h", F.lit(1 << 30))).alias("_h")).withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_h", "text")))

    def make():
        def step(batch):
            pairs = [(t, g) for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if _LETTER.search(t)]
            blocks = (features([t for t, _ in pairs[a : a + BLOCK]]).astype(np.float16) for a in range(0, len(pairs), BLOCK))
            return {"lang": [g for _, g in pairs], "x": [v.tobytes() for block in blocks for v in block]} if pairs else None

        return step

    got = mapped(rows.filter(F.col("_n") <= per_language).select("text", "lang"), make, fields(lang="string", x="binary")).collect()
    got.sort(key=lambda r: (r["lang"], r["x"]))
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32), [r["lang"] for r in got]) if got else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter (or nothing was learned), else
    a learned language; ``score`` is the share of the family times the share of pairwise votes. Nothing but
    the text is an input. A null doc_id is not held out. Repeated rows give equal rows, an empty table none.
    """

    def make():
        def step(batch):
            texts = batch.column(1).to_pylist()
            has = [i for i, x in enumerate(texts) if x and model is not None and _LETTER.search(x)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i, n, s in zip(has, *model.predict([texts[i] for i in has]), strict=True) if has else ():
                names[i], scores[i] = n, s
            return {"doc_id": batch.column(0), "lang_pred": names, "score": scores}

        return step

    rows = mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, fields(doc_id=docs.schema["doc_id"].dataType, lang_pred="string", score="double"))
    return rows.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the texts that have no letter or are told to be ``und``, its columns unchanged. A null
    ``lang`` becomes the language told; one that is given stays. Without a model no language is told: every
    text with a letter stays as it is."""
    names = docs.columns
    at, lang = names.index("text"), names.index("lang")

    def make():
        def step(batch):
            texts = batch.column(at).to_pylist()
            has = [i for i, x in enumerate(texts) if x and _LETTER.search(x)]
            told = dict.fromkeys(has)
            if has and model is not None:
                told = {i: n for i, n in zip(has, model.predict([texts[i] for i in has])[0], strict=True) if n != "und"}
            if not told:
                return None
            part = batch.take(np.array(list(told)))
            out = {f"c{i}": part.column(i) for i in range(len(names))}
            out[f"c{lang}"] = [n if g is None else g for g, n in zip(part.column(lang).to_pylist(), told.values(), strict=True)]
            return out

        return step

    rows = numbered(docs)
    return mapped(rows, make, rows.schema).toDF(*names)


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
