import base64
import gzip
import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest
from conftest_llm import SMOKE, rows

from sedge.llm import archives, media
from sedge.llm.queries import QUERIES


def test_netpbm_kinds():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    assert np.array_equal(media.decode(media.encode_ppm(grey)), grey)
    rgb = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    assert np.array_equal(media.decode(media.encode_ppm(rgb)), rgb)
    assert media.decode(b"P1\n# bits\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4 9 1\n" + bytes([0b10000000, 0b10000000])).tolist() == [[0, 255, 255, 255, 255, 255, 255, 255, 0]]
    assert media.decode(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"", b"P7", b"P6 2 2 255\nxx", b"P2 1 1 5\n9", b"P5 0 1 255\n"):
        with pytest.raises(ValueError, match="."):
            media.decode(bad)


@pytest.mark.parametrize(("depth", "up"), [(24, True), (24, False), (32, True)])
def test_bmp(depth, up):
    image = np.random.default_rng(1).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    rows_ = image[::-1] if up else image
    body = b""
    for row in rows_:
        line = b"".join(bytes(p[::-1]) + b"\0" * (depth == 32) for p in row)
        body += line + b"\0" * (-len(line) % 4)
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3 if up else -3, 1, depth, 0, len(body), 0, 0, 0, 0)
    assert np.array_equal(media.decode(head + body), image)


def test_area_resize():
    image = np.random.default_rng(2).integers(0, 256, (12, 20)).astype(np.uint8)
    assert media.area_resize(image, 3, 5) == pytest.approx(image.reshape(3, 4, 5, 4).mean(axis=(1, 3)))
    assert media.area_resize(image, 7, 9).mean() == pytest.approx(image.mean())
    fine = np.kron(image, np.ones((7, 9)))
    assert media.area_resize(image, 7, 9) == pytest.approx(fine.reshape(7, 12, 9, 20).mean(axis=(1, 3)))


def test_round_trip(spark, smoke):
    got = {r.doc_id: r for r in media.text_media(smoke, keep=True).collect()}
    for d in smoke.collect():
        r, text = got[d.doc_id], d.text.encode()
        payload = text + b" " * (-len(text) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert media.decode(r.media).tobytes() == payload and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert np.load(io.BytesIO(r.tile)).shape == (8, 8, 3) and len(r.feature) == 16
    assert {r.doc_id: r.feature for r in QUERIES["op5_media"](spark, SMOKE).collect()} == {i: r.feature for i, r in got.items()}


def test_broken_images_keep_rows(spark):
    df = spark.createDataFrame([(1, b"P5 2 2 255\nabcd"), (2, b"junk"), (3, None)], "k int, img binary")
    got = {r.k: r for r in media.image_features(df, "k", "img").collect()}
    assert got[1].width == 2 and got[1].error is None and got[2].error and got[3].width is None


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_package(zip64):
    records = [(archives.record(i, f"http://x/{i}", b"p" * i, archives.base32_sha1(b"p" * i)), "response") for i in range(5)]
    data = archives.package(records, zip64)
    z = archives.ZipPackage(io.BytesIO(data), len(data))
    assert set(z.members) == {archives.DATA, archives.INDEX}
    lines = [x.split() for x in z.read(archives.INDEX).decode().splitlines()]
    for i, (at, n, kind) in enumerate(lines):
        fields, _, payload = archives.parse_record(z.read(archives.DATA, int(at), int(n)))
        assert (kind, payload, fields["warc-record-id"]) == ("response", b"p" * i, f"<urn:page:{i}>")
    with pytest.raises(ValueError, match="range"):
        z.read(archives.DATA, 0, 1 << 30)


def test_zip64_directory():
    """An end record with full fields, as archives of over 65,535 members have."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(70_000):
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"here")
        z.comment = b"PK\5\6 in a comment"
    data = out.getvalue()
    z = archives.ZipPackage(io.BytesIO(data), len(data))
    assert len(z.members) == 70_001 and z.read("last") == b"here"


def test_zip_refusals():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"x" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError, match="stored"):
        archives.ZipPackage(io.BytesIO(data), len(data)).read("packed")
    with pytest.raises(ValueError, match="end of central"):
        archives.ZipPackage(io.BytesIO(b"no archive"), 10)


def test_pages(spark):
    data = [(1, "http://a", "x"), (2, "http://b\r\nEvil: 1", "x"), (3, None, None), (4, "u", ""), (5, "u", "Größe " * 5000), (5, "u", "Größe " * 5000), (None, "u", "x"), (None, "u", "alone"), (9, "u", "y\r\n\r\nz")]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(data, schema)
    got = archives.archive_pages(pages).collect()
    want = []
    for i, _, html in data:
        payload = (html or "").encode()
        same = [j for j, _, h in data if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        refers = None if i == first or first is None else first
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert archives.archive_pages(spark.createDataFrame([], schema)).count() == 0
    odd = pages.withColumn("payload", pages.page_id).withColumn("_digest", pages.url).withColumn("path", pages.url)
    assert rows(archives.archive_pages(odd)) == rows(archives.archive_pages(pages))


def test_damage_is_found():
    data = archives.record(1, "u", b"payload", archives.base32_sha1(b"payload"))
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError, match="WARC"):
        archives.parse_record(gzip.compress(b"no record"))
