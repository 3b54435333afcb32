"""Decoders of any bytes, scaling by the stated maximum, and features against naive loops."""

import io
import random
import struct

import numpy as np
import pytest

from gleanery.llm import media


def bmp(pixels, bits, flip=False, palette=None):
    """Rows of pixels (indexes, or colours) as BMP."""
    h, w = len(pixels), len(pixels[0])
    body = b""
    for row in pixels if flip else pixels[::-1]:
        raw = bytes(row) if bits == 8 else b"".join(bytes(p[::-1]) + b"\0" * (bits // 8 - 3) for p in row)
        body += raw + b"\0" * (-len(raw) % 4)
    table = b"".join(bytes(c[::-1]) + b"\0" for c in palette or [])
    start = 54 + len(table)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(body), 0, 0, start, 40, w, -h if flip else h, 1, bits, 0, len(body), 0, 0, len(palette or []), 0) + table + body


def test_bmp_of_all_kinds():
    rnd = random.Random(1)
    pixels = [[[rnd.randrange(256) for _ in range(3)] for _ in range(5)] for _ in range(4)]
    for bits in (24, 32):
        for flip in (False, True):
            assert media.decode(bmp(pixels, bits, flip)).tolist() == pixels
    palette = [[rnd.randrange(256) for _ in range(3)] for _ in range(7)]
    indexes = [[rnd.randrange(7) for _ in range(5)] for _ in range(3)]
    assert media.decode(bmp(indexes, 8, palette=palette)).tolist() == [[palette[i] for i in row] for row in indexes]
    with pytest.raises(ValueError):
        media.decode(bmp([[7, 1]], 8, palette=palette))


@pytest.mark.parametrize("data", [b"P2 1 1 255 300", b"P1 1 1 7", b"P2 1 1 255 -1", b"P2 1 1 255 1_0", b"P5 1 1 15\n\x10", b"P5 1 1 0\n\x00", b"P5 1 1 255x\x00", b"P5 99999999999 1 255\n", b"P4 9 1\n\x00", b"", b"P", b"BM", b"P2 1 1 255"])
def test_malformed_images_raise_value_error(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_any_bytes_are_an_image_or_a_value_error():
    rnd = random.Random(3)
    seeds = [b"P1 3 2\n101 010", b"P2 2 2 15\n1 2 3 4", b"P3 1 1 255 1 2 3", b"P4 9 2\n" + b"\x81" * 4, b"P5 2 2 255\nabcd", b"P5 2 1 999\n\x01\x02\x01\x02", b"P6 1 2 255\nabcdef", bmp([[0, 1], [1, 0]], 8, palette=[[1, 2, 3], [4, 5, 6]]), bmp([[[1, 2, 3]]], 24), bmp([[[1, 2, 3]]], 32)]
    good = 0
    for _ in range(20_000):
        data = bytearray(rnd.choice(seeds))
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(data) + 1)
            data[at : at + rnd.randrange(3)] = rnd.choice([bytes([rnd.randrange(256)]), b"", b"9", b" ", b"\xff\xff\xff\x7f"])
            data = data or bytearray(b"P")
        try:
            image, top = media.decode_scaled(bytes(data))
            assert image.size and image.dtype in (np.uint8, np.uint16) and int(image.max()) <= top
            assert len(media.difference_hash(image)) == 16 and len(media.tile(image, 4, top)) > 16
            good += 1
        except ValueError:
            pass
    assert good > 1000


def naive_resize(image, height, width):
    h, w = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            total = 0.0
            for y in range(int(y0), min(h, int(np.ceil(y1)))):
                for x in range(int(x0), min(w, int(np.ceil(x1)))):
                    total += float(image[y, x]) * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
            out[i, j] = total / ((y1 - y0) * (x1 - x0))
    return out


def test_tiles_scale_by_the_maximum():
    rng = np.random.default_rng(2)
    for top in (15, 255, 1023, 65535):
        image = rng.integers(0, top + 1, (11, 13))
        data = b"P5 13 11 %d\n" % top + image.astype(">u2" if top > 255 else "u1").tobytes()
        found, said = media.decode_scaled(data)
        assert (found == image).all() and said == top
        tile = np.load(io.BytesIO(media.tile(found, 8, said)))
        assert np.abs(tile - naive_resize(image, 8, 8) * 255 / top).max() <= 0.5 + 1e-6 and tile.max() > 100


def test_the_query_feature_is_its_naive_form(spark):
    from gleanery.llm import queries

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op10_media_columns(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(rows)
    for i in sorted(rows)[:25]:
        raw = (rows[i] or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 576)
        small = np.rint(naive_resize(image, 8, 9) * 256)
        bits = "".join("1" if small[y, x + 1] > small[y, x] else "0" for y in range(8) for x in range(8))
        assert got[i]["feature"].split(":")[0] == f"{int(bits, 2):016x}"


def test_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (2, b"junk", 6, "y"), (3, b"P2 1 1 15 15", 7, "z")], "id long, media binary, height int, other string")
    got = {r["id"]: r for r in media.decode_media(df, 2).collect()}
    assert [got[i]["height"] for i in (1, 2, 3)] == [None, None, 1] and got[3]["other"] == "z"
    assert np.load(io.BytesIO(bytes(got[3]["tile"]))).tolist() == [[255, 255], [255, 255]]
