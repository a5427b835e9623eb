"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, and kept as NPY tiles with a difference hash."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.work import fields, mapped, settled, table, written

#: A payload is padded with spaces to a positive multiple of this many bytes: rows of 8 RGB pixels, 8 rows at least.
UNIT, WIDTH = 192, 8
TILE = 8

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def encode_ppm(samples: np.ndarray) -> bytes:
    """(height, width, 3) or (height, width) uint8 samples as binary PPM or PGM."""
    height, width = samples.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if samples.ndim == 3 else 5, width, height) + samples.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 16-bit samples are scaled to 8, bitmaps to 0 and 255
    (in a bitmap 1 is black). Raises ValueError where the header or the raster is short or wrong."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise ValueError("short Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = (*fields, 1)[:3]
    if width < 1 or height < 1 or not 1 <= top <= 65535:
        raise ValueError("bad Netpbm header")
    bands = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * bands
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = np.array(list(re.sub(rb"\s", b"", body)[:count]) if kind == b"P1" else body.split()[:count], dtype=np.int64)
        values = values - 48 if kind == b"P1" else values
    elif kind == b"P4":
        stride = (width + 7) // 8
        raster = np.frombuffer(data, np.uint8, offset=at + 1)
        if raster.size < stride * height:
            raise ValueError("short Netpbm raster")
        values = np.unpackbits(raster[: stride * height].reshape(height, stride), axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.uint8 if top < 256 else np.dtype(">u2")
        values = np.frombuffer(data, np.uint8, offset=at + 1)
        values = values[: count * np.dtype(kind_of).itemsize]
        if values.size < count * np.dtype(kind_of).itemsize:
            raise ValueError("short Netpbm raster")
        values = values.view(kind_of)
    if values.size < count or (values.size and (values.min() < 0 or values.max() > top)):
        raise ValueError("bad Netpbm raster")
    if kind in (b"P1", b"P4"):
        values = 255 * (1 - values.astype(np.int64))
    elif top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    shape = (height, width, 3) if bands == 3 else (height, width)
    return values.astype(np.uint8, copy=False).reshape(shape)


def encode_bmp(samples: np.ndarray) -> bytes:
    """(height, width, 3) uint8 samples as a 24-bit BMP, its rows from the bottom up and padded to four bytes."""
    height, width = samples.shape[:2]
    body = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    body[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 0, 0, 0, 0) + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 16, 24 or 32 bits, bit fields and all, as (height, width, 3) in RGB order.
    Raises ValueError for other kinds and where bytes are missing."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, header, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (8, 16, 24, 32) or (packed == 3 and (depth not in (16, 32) or len(data) < 66)) or width < 1 or height == 0:
        raise ValueError("unsupported BMP")
    stride, rows = (width * depth // 8 + 3) // 4 * 4, abs(height)
    if start > len(data) or len(data) - start < stride * rows:
        raise ValueError("short BMP raster")
    raster = np.frombuffer(data, np.uint8, count=stride * rows, offset=start).reshape(rows, stride)
    if depth == 8:
        if not 14 + header <= start:
            raise ValueError("bad BMP palette")
        colours = np.frombuffer(data, np.uint8, count=min(start - 14 - header, 1024), offset=14 + header)
        palette = np.zeros((256, 4), np.uint8)
        palette[: colours.size // 4] = colours[: colours.size // 4 * 4].reshape(-1, 4)
        image = palette[raster[:, :width]][:, :, 2::-1]
    elif depth == 16 or packed == 3:
        values = np.ascontiguousarray(raster[:, : width * depth // 8]).view("<u2" if depth == 16 else "<u4").astype(np.int64)
        image = np.empty((rows, width, 3), np.uint8)
        for k, mask in enumerate(struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)):
            low = mask & -mask
            image[:, :, k] = ((values & mask) // low * 255 + mask // low // 2) // (mask // low) if mask else 0
    else:
        image = raster[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target cell, exact for cells that cut pixels: the integral image is
    piecewise bilinear, so it is read at fractional corners. Only its rows next to a corner are made, so a high
    image needs no more memory than a low one beside itself."""
    planes = image[:, :, None] if image.ndim == 2 else image
    h, w, bands = planes.shape
    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    y, x = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    fy, fx = (ys - y)[:, None, None], (xs - x)[None, :, None]
    wanted = np.unique(np.concatenate([y, y + 1]))  # rows of the integral image; row k sums the pixels above k
    total = np.zeros((wanted.size, w + 1, bands))
    for k in range(1, wanted.size):
        total[k, 1:] = total[k - 1, 1:] + planes[wanted[k - 1] : wanted[k]].sum(axis=0, dtype=np.float64)
    np.cumsum(total, axis=1, out=total)
    rows = total[np.searchsorted(wanted, y)] * (1 - fy) + total[np.searchsorted(wanted, y + 1)] * fy
    corners = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    out = (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / ((h / height) * (w / width))
    return out if image.ndim == 3 else out[:, :, 0]


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex of side * side bits: of each row of a (side, side + 1) thumbnail, whether a cell is darker than the next."""
    small = np.round(grey(area_resize(image, side, side + 1)), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray, side: int = TILE) -> np.ndarray:
    return np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8)


def image_features(df: DataFrame, key: str, content: str) -> DataFrame:
    """Decode a binary column of images: key, height, width, bands, tile (NPY bytes), feature, error.

    A null, empty or broken image keeps its row: the measures are null and ``error`` says why.
    """

    def make():
        def step(batch):
            out = {k: [] for k in ("height", "width", "bands", "tile", "feature", "error")}
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    row = (*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, npy(tile_of(image)), difference_hash(image), None)
                except ValueError as e:
                    row = (None, None, None, None, None, str(e))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return {"key": batch.column(0), **out}

        return step

    schema = fields(key=df.schema[key].dataType, height="int", width="int", bands="int", tile="binary", feature="string", error="string")
    return mapped(df.select(key, content), make, schema).withColumnRenamed("key", key)


def stored_media(docs: DataFrame) -> DataFrame:
    """Each text as an image of 8-bit RGB samples, 8 pixels a row: doc_id, n_bytes, media.

    The payload is the text in UTF-8 and spaces up to a positive multiple of 192 bytes; an odd number of such
    units makes a PPM, an even one a BMP, so equal texts are equal files.
    """

    def make():
        def step(batch):
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                text = text or b""
                padded = text + b" " * (UNIT - len(text) if not text else -len(text) % UNIT)
                sizes.append(len(text))
                media.append((encode_ppm if len(padded) // UNIT % 2 else encode_bmp)(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3)))
            return {"doc_id": batch.column(0), "n_bytes": sizes, "media": pa.array(media, pa.binary())}

        return step

    return mapped(docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")), make, fields(doc_id=docs.schema["doc_id"].dataType, n_bytes="long", media="binary"))


def media_tiles(stored: DataFrame, keep: bool = False) -> DataFrame:
    """What ``stored_media`` stored, decoded: the payload's measures, and the tile (NPY) and feature of each image;
    with ``keep`` also media."""

    def make():
        def step(batch):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "tile_sha256")}
            for media in batch.column(2).to_pylist():
                image = decode(media)
                payload, tile = image.tobytes(), npy(tile_of(image))
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), tile, hashlib.sha256(tile).hexdigest())
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return {"doc_id": batch.column(0), "n_bytes": batch.column(1), **out, "media": batch.column(2) if keep else pa.nulls(batch.num_rows, pa.binary())}

        return step

    kind = stored.schema["doc_id"].dataType
    schema = fields(doc_id=kind, n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string", tile="binary", tile_sha256="string", media="binary")
    rows = mapped(stored.select("doc_id", "n_bytes", "media"), make, schema)
    return rows if keep else rows.drop("media")


def text_media(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Each text stored as an image of 8-bit RGB samples and read back.

    One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, tile (NPY), tile_sha256; with ``keep`` also media. The images are written as a table
    first and read from there. A null text is empty; the payload of an empty text is 192 spaces. Texts of any
    length are whole: the image is 8 pixels wide and as high as it must be. Repeated rows give repeated rows, an
    empty table none. Only doc_id and text are read.
    """
    return media_tiles(written(stored_media(docs), "media", "zstd"), keep)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled("op5-tiles", lambda: text_media(table(spark, sf_dir, "documents"))).drop("tile")
