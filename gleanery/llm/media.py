"""Media columns: Netpbm and BMP to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

The decoders take binary PGM (P5), PPM (P6), PBM (P4) and their plain forms (P1-P3), and uncompressed
BMP of 8, 24 or 32 bits in either row order. ``resize`` weighs each source sample by the area it shares
with the target: the integral image is read at fractional corners. A tile is the resized image as the bytes
of an NPY file; its difference hash has a bit for each pair of neighbours in a row that rises.

``payload_images`` stores bytes losslessly as a PGM image 576 samples wide: the payload is padded with bytes
255 up to a positive multiple of 576. All passes are narrow: no shuffle, memory bounded by a slice of rows.

Cases: a null text is the empty text, whose payload is 576 bytes 255; equal texts give equal values;
rows repeated stay repeated; a null doc_id stays null; extra columns are ignored; an empty table gives no rows.
Any bytes that aren't such an image, samples over the stated maximum and pixels beyond the palette among them, raise ValueError
in ``decode``; ``decode_media`` gives null there, and for null.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_batches, text_of

WIDTH, TILE = 576, 32
_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])+([0-9]{1,10})(?![0-9])")


def decode(data: bytes) -> np.ndarray:
    """An image as uint8 or uint16 samples, height x width (grey) or height x width x 3. Any other bytes raise ValueError."""
    return decode_scaled(data)[0]


def decode_scaled(data: bytes) -> tuple[np.ndarray, int]:
    """The image and the sample that stands for full brightness."""
    if data[:2] == b"BM":
        return _bmp(data), 255
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> tuple[np.ndarray, int]:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head if len(head) == 3 else (*head, 255)
    planes = 3 if kind in (3, 6) else 1
    if not 0 < top < 65536 or w < 1 or h < 1:
        raise ValueError("Netpbm header out of range")
    if kind > 3 and not data[at : at + 1].isspace():
        raise ValueError("broken Netpbm header")
    n, kindof = w * h * planes, np.dtype(np.uint16 if top > 255 else np.uint8)
    if kind == 1:  # digits may touch
        bits = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n], np.uint8)
        if ((bits != 48) & (bits != 49)).any():
            raise ValueError("a sample is no bit")
        flat = (49 - bits) * np.uint8(255)
    elif kind in (2, 3):
        said = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]
        if not all(x.isdigit() and len(x) < 10 for x in said):
            raise ValueError("a sample is no number")
        flat = np.array([int(x) for x in said], dtype=np.int64)
    elif kind == 4:
        row = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: row * h] if len(data) > at + 1 else np.zeros(0, np.uint8)
        if len(raw) < row * h:
            raise ValueError("image is cut short")
        flat = ((1 - np.unpackbits(raw.reshape(h, row), axis=1)[:, :w]) * 255).ravel()
    else:
        stored = kindof.newbyteorder(">")
        if len(data) - at - 1 < n * stored.itemsize:
            raise ValueError("image is cut short")
        flat = np.frombuffer(data, stored, n, at + 1)
    if len(flat) < n:
        raise ValueError("image is cut short")
    if top not in (255, 65535) or kind in (2, 3):
        if (flat > top).any():
            raise ValueError("a sample is over the maximum")
    return flat.astype(kindof, copy=False).reshape((h, w, 3) if planes == 3 else (h, w)), top


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("BMP is cut short")
    u = lambda at, n, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, header, w, h, bits, packed = u(10, 4), u(14, 4), u(18, 4, True), u(22, 4, True), u(28, 2), u(30, 4)
    if header < 40 or packed or bits not in (8, 24, 32) or w < 1 or not h:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    row = (w * bits // 8 + 3) // 4 * 4
    if start < 14 + header or len(data) < start + row * abs(h):
        raise ValueError("BMP is cut short")
    rows = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = u(46, 4) or 256
        if colours > 256 or 14 + header + 4 * colours > start or int(rows.max()) >= colours:
            raise ValueError("a pixel is beyond the palette")
        table = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
        return table[rows]
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey uint8 image as binary PGM."""
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + image.astype(np.uint8, copy=False).tobytes()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-weighted mean of each target cell, as float64, from the integral image; colour is averaged first."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    h, w = grey.shape
    if float(grey.max(initial=0)) <= 255 and grey.dtype == np.uint8 and h * w < 2**23:
        sums = np.zeros((h + 1, w + 1), np.int32)
    else:
        sums = np.zeros((h + 1, w + 1), np.float64)
    np.cumsum(grey, axis=1, out=sums[1:, 1:], dtype=sums.dtype)
    np.cumsum(sums[1:, 1:], axis=0, out=sums[1:, 1:])

    def corners(n: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, low + 1, at - low

    y0, y1, fy = corners(h, height)
    x0, x1, fx = corners(w, width)
    rows = sums[y0] * (1 - fy)[:, None] + sums[y1] * fy[:, None]
    grid = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return np.diff(np.diff(grid, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each of 8 x 9 area means is below its right neighbour, row by row."""
    small = np.rint(resize(image, 8, 9) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def tile(image: np.ndarray, side: int = TILE, top: int = 255) -> bytes:
    """The image resized to a square of uint8, ``top`` becoming 255, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize(image, side, side) * (255 / top)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload_image(text: bytes) -> bytes:
    """Bytes as a PGM image, padded with 255 to a positive multiple of its width."""
    rows = max(1, -(-len(text) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + text + b"\xff" * (rows * WIDTH - len(text))


def payload_images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a PGM image) for every text of ``docs`` (doc_id, text)."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        return pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(payload_image, texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("bytes")), encode, "doc_id bigint, n_bytes bigint, media binary")


def decode_media(images: DataFrame, side: int = TILE) -> DataFrame:
    """For every ``media`` its height, width, samples (bytes in row order), NPY tile and difference hash, beside its other columns (but those of these names)."""
    made_names = ["height", "width", "samples", "tile", "dhash"]
    kept = [c for c in images.columns if c not in ("media", *made_names)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for m in batch.column(batch.num_columns - 1).to_pylist():
            try:
                image, top = decode_scaled(m or b"")
                rows.append((image.shape[0], image.shape[1], image.tobytes(), tile(image, side, top), difference_hash(image)))
            except ValueError:
                rows.append((None,) * 5)
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()))]
        return pa.record_batch([*batch.columns, *made], names=[*kept, "media", *made_names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*kept, "media").schema)
    return map_batches(images.select(*kept, "media"), run, schema + ", height int, width int, samples binary, tile binary, dhash string")


def media_digest(docs: DataFrame) -> DataFrame:
    """Digests of what ``payload_images`` stores and ``decode_media`` reads back, made in one pass so that no image leaves its worker."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            media = payload_image(text)
            image = decode(media)
            payload = image.tobytes()
            rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image)}:{zlib.crc32(tile(image)):08x}"))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("bytes")), run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
