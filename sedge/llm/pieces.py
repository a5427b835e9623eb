"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback."""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.work import fields, kept_in_process, mapped, table

SPACE = "▁"
#: Symbols up to which the agenda is a list, entries remembered at a time, and parts looked up between two looks at their number.
SHORT, MOST, STEP = 48, 300_000, 50_000
#: Ways to cut a text where no merge can cross, finest first; a model takes the first under which every piece is one part.
CUTS = (rf"{SPACE}*(?:[^\W\d_¹²³]+|(?:[^\w{SPACE}]+|[\d_¹²³]+)+)|{SPACE}+", rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", r"(?s:.+)")

#: The first of these for ASCII alone, where its classes are letters and all else.
ASCII_CUT = rf"{SPACE}*(?:[A-Za-z]+|[^A-Za-z{SPACE}]+)|{SPACE}+"


class _Parts(dict):
    """Packed ids by part, spaces unmarked; a part met first is recalled, and kept if it is not long."""

    def __init__(self, recall):
        super().__init__()
        self.recall = recall

    def __missing__(self, part: str) -> bytes:
        ids = self.recall(part)
        if len(part) <= 64:
            self[part] = ids
        return ids


class MergeCodec:
    """Encoder and decoder of one model, from the bytes of its file.

    Only models with the identity normalizer, a dummy prefix and kept white space are taken. ``known`` parts
    are remembered: ``MOST`` at a time, and as many from before (``past``), which come back as they are met.
    Ids are packed as 4 bytes each, so a text's are those of its parts end to end, without an object per id.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        if lib.normalize(" ﬁ  x ") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}" or any(lib.is_unused(i) for i in range(n)):
            raise ValueError("only identity-normalized models without unused pieces are supported")
        self.id_of = {names[i]: i for i in range(n) if i not in special}
        self.score = {p: -lib.get_score(i) for p, i in self.id_of.items() if len(p) > 1}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.text = [bytes([int(x[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.bytes_of = pa.array(self.text, pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(n)], pa.large_binary())
        self.cut = next(c for c in map(re.compile, CUTS) if all(c.fullmatch(p) and c.match(p).end() == len(p) and len(c.findall(p)) == 1 for p in self.id_of))
        self.ascii_cut = re.compile(ASCII_CUT) if self.cut.pattern == CUTS[0] else self.cut
        self.ascii_kinds, self.kinds = kinds(self.ascii_cut, 128), None
        self.known, self.past = _Parts(self.recall), {}

    def merge(self, part: str) -> tuple[int, ...]:
        """Ids of one part: the agenda holds adjacent pairs that form a piece, best score first, leftmost on a
        tie; a popped pair counts only if both symbols are as they were when it was entered."""
        symbols = self.short(part) if len(part) <= SHORT else self.long(part)
        out: list[int] = []
        for s in symbols:
            if (r := self.id_of.get(s)) is not None:
                out.append(r)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def short(self, part: str) -> list[str]:
        """The agenda as a list of the scores of all adjacent pairs, best taken first, for a few symbols."""
        score, none = self.score.get, float("inf")
        symbols = list(part)
        agenda = [score(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            symbols[i] = made = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(made + symbols[i + 1], none)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + made, none)
        return symbols

    def long(self, part: str) -> list[str]:
        """The agenda as a heap, for any number of symbols."""
        score = self.score.get
        symbols, n = list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := score(a + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := score(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := score(symbols[h] + symbols[i])) is not None:
                heapq.heappush(agenda, (r, h, symbols[h], symbols[i]))
        return [s for s in symbols if s]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of whole texts, end to end, and the place where each text's begin, with that of the end. Each different part
        of these texts is looked up once. A space and its mark are one symbol, and only parts to be merged are marked."""
        parts, first = self.parts([x.replace(SPACE, " ") for x in texts])
        coded = parts.dictionary_encode()
        different, packed = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), []
        for k in range(0, len(different), STEP):
            if len(self.known) > MOST:
                self.past, self.known = self.known, _Parts(self.recall)
            packed.extend(map(self.known.__getitem__, different[k : k + STEP]))
        data, at = run_together(pa.array(packed, pa.large_binary()), coded.indices)
        return np.frombuffer(data, np.int32), (at[first] // 4).tolist()

    def parts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """What ``cut`` finds in all these texts with their dummy prefixes, and the number of each one's first part, with
        that of all. A part begins where the kind of character changes, but not after a space."""
        whole = "".join([" " + x for x in texts if x])
        length = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
        data = whole.encode()
        if whole.isascii():
            kind = self.ascii_kinds[np.frombuffer(data, np.uint8)]
        else:
            self.kinds = kinds(self.cut) if self.kinds is None else self.kinds
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            del whole
            kind = self.kinds[points]
        begins = np.ones(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:-1])
        begins[1:-1] &= kind[:-1] != 0
        starts = np.cumsum(length) - length
        begins[starts] = True
        at = np.flatnonzero(begins)
        first = np.searchsorted(at, np.append(starts, len(kind)))
        if len(kind) < len(data):
            wide = 1 + (points > 0x7F).view(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
            at[1:] = np.cumsum(np.add.reduceat(wide, at[:-1], dtype=np.int64))
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), first

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def recall(self, part: str) -> bytes:
        if (ids := dict.get(self.past, part)) is None:
            ids = array("i", self.merge(part.replace(" ", SPACE))).tobytes()
        return ids

    def check(self, texts: list[str], ids: list, decoded: list[bytes]) -> None:
        """Hold whole encodings and decoded texts of a batch against the library's."""
        for text, own, spelled in zip(texts, ids, decoded, strict=True):
            if not np.array_equal(own, self.library.encode(text.encode(), return_type="numpy")):
                raise ValueError(f"encodes other than the sentencepiece library: {text[:80]!r}")
            if spelled != self.library.decode(own).encode():
                raise ValueError(f"decodes other than the sentencepiece library: {spelled[:80]!r}")

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int32), [0, len(ids)])[0]

    def decode_all(self, ids: np.ndarray, ends: list[int]) -> list[bytes]:
        """UTF-8 bytes of the texts whose ids lie between one end and the next; the space of the dummy prefix goes, bytes
        that form no character become U+FFFD."""
        out = []
        for data, at in zip(spelled(self.bytes_of, ids, ends), ends, strict=False):
            data = bytes(data[1:] if data[:1] == b" " and self.text[ids[at]][:1] == b" " else data)
            try:
                data.decode()
            except UnicodeDecodeError:
                data = data.decode(errors="replace").encode()
            out.append(data)
        return out


def kinds(cut: re.Pattern, n: int = 0x110000) -> np.ndarray:
    """Kinds of the first ``n`` code points under a cut: 0 for the space, which goes with what follows, 1 for what a letter
    runs on with, 2 for all else. Under coarser cuts there is only 1, or 0 and 1."""
    out = np.full(n, 2, np.uint8)
    every = "".join(map(chr, range(n))).replace(SPACE, "!")
    for run in cut.finditer(every):
        if cut.fullmatch("a" + every[run.start()]):
            out[run.start() : run.end()] = 1
    for c in (" ", SPACE):
        if ord(c) < n:
            out[ord(c)] = 1 if cut.fullmatch("a" + SPACE) else 0
    return out


def run_together(values: pa.Array, which: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values of these numbers end to end, and where each begins, with the end."""
    found = values.take(which)
    _, offsets, data = found.buffers()
    at = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    return memoryview(data or b"")[: at[-1]], at


def spelled(names: pa.Array, ids: np.ndarray, ends: list[int]) -> list[memoryview]:
    """The names of the ids run together, from one end to the next."""
    data, at = run_together(names, pa.array(ids))
    at = at[ends].tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def encode_texts(docs: DataFrame, model_path: str, check: bool = True, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids.

    No begin or end ids, no sampling. A null text is empty and has no ids. ``check`` holds every Arrow batch
    against the library, whole encodings and decoded texts, and fails on a difference, so a result is never
    silently other than the library's. Repeated rows give repeated rows, an empty table none. The model file is read on
    the driver and travels with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    name = f"merge codec {hashlib.sha256(model).hexdigest()}"

    def make():
        codec = kept_in_process(name, lambda: MergeCodec(model))

        def step(batch):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids, ends = codec.encode_all(texts)
            decoded = codec.decode_all(ids, ends)
            if check:
                codec.check(texts, [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)], decoded)
            return {
                "doc_id": batch.column(0),
                "n_tokens": np.diff(ends),
                "ids_sha256": [hashlib.sha256(x[:-1]).hexdigest() for x in spelled(codec.decimal, ids, ends)],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
                "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)) if keep_ids else [None] * len(texts),
            }

        return step

    rows = mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), make, fields(doc_id=docs.schema["doc_id"].dataType, n_tokens="long", ids_sha256="string", decoded_sha256="string", ids="array<int>"))
    return rows if keep_ids else rows.drop("ids")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), model_path(), keep_ids=False)
