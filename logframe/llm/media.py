"""Media columns: Netpbm and BMP decoded to arrays, area-resized, kept as NPY tiles with difference hashes.

``decode_image`` reads P1 to P6 and uncompressed BMP of 8, 24 and 32 bits; sizes are held
against the data before anything is decoded, so memory follows the bytes that are there.
Resizing averages exact areas through an integral image. A difference hash compares
neighbouring columns of the 9 x 8 grey image. Broken, truncated, empty and null media give
null results with the reason in ``error``; they never end a job.

``text_media`` takes a null text as an empty one, which is one row of blanks. Repeated rows
give repeated results, an empty table an empty one; extra columns are ignored there and
kept by ``decode_media``, but for those named as its results, which are replaced.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import with_fields

#: A payload row of 64 RGB pixels.
ROW_BYTES, ROW_PIXELS = 192, 64
TILE = 32
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 for (h, w, 3), P5 for (h, w); 8 bits."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP of (h, w, 3)."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), dtype=np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + rows.size, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at = data[1] - 48, 2
    sizes = []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit() or len(m[1]) > 9:
            raise ValueError("broken header")
        sizes.append(int(m[1]))
        at = m.end()
    w, h, top = (*sizes, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    n = w * h * channels
    if not n or not 1 <= top <= 65535:
        raise ValueError("no pixels" if not n else f"maximum {top}")
    # a plain sample takes a byte at least, packed bits an eighth of one, and large samples two
    if ((w + 7) // 8 * h if kind == 4 else n * (2 if kind > 4 and top > 255 else 1)) > len(data) - at:
        raise ValueError("too few samples")
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([int(c) for c in re.findall(rb"[01]", body)] if kind == 1 else body.split(), dtype=np.int64)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1)
        values = np.unpackbits(packed.reshape(h, -1), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(values) < n:
        raise ValueError("too few samples")
    values = values[:n]
    if kind in (2, 3, 5, 6) and (int(values.max()) > top or int(values.min()) < 0):
        raise ValueError("sample above the maximum")
    if kind in (1, 4):
        values = 1 - values
    if top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    pixels = values.astype(np.uint8).reshape(h, w, channels)
    return pixels if channels == 3 else pixels[:, :, 0]


def _bmp(data: bytes) -> np.ndarray:
    offset, header, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits with compression {packed}")
    if w < 1 or not h:
        raise ValueError("no pixels")
    stride = (w * bits // 8 + 3) // 4 * 4
    if stride * abs(h) > len(data) - offset:
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:, : w * bits // 8]
    if bits == 8:
        start = 14 + header
        if offset < start:
            raise ValueError("pixels before the end of the header")
        palette = np.frombuffer(data, np.uint8, (offset - start) // 4 * 4, start).reshape(-1, 4)
        pixels = palette[rows][:, :, 2::-1]
    else:
        pixels = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(pixels[::-1] if h > 0 else pixels)


def decode_image(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) samples of 8 bits."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact mean over each target cell's area, as float64, from one integral image per channel.

    Of the integral image only the rows next to the cells' edges are kept.
    """
    h, w = pixels.shape[:2]
    planes = pixels.reshape(h, w, -1)
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    low = np.minimum(ys.astype(np.int64), h - 1)
    rows = np.unique(np.concatenate(([0], low, low + 1)))  # the last is h
    sums = np.add.reduceat(planes, rows[:-1], axis=0, dtype=np.float64).cumsum(axis=0)
    integral = np.zeros((len(rows), w + 1, planes.shape[2]))
    integral[1:, 1:] = sums.cumsum(axis=1)

    def at(edges: np.ndarray, array: np.ndarray, known: np.ndarray) -> np.ndarray:
        below = np.minimum(edges.astype(np.int64), known[-1] - 1)
        part = (edges - below).reshape(-1, *[1] * (array.ndim - 1))
        i = np.searchsorted(known, below)
        return array[i] * (1 - part) + array[i + 1] * part

    corners = at(xs, at(ys, integral, rows).swapaxes(0, 1), np.arange(w + 1)).swapaxes(0, 1)
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    means = cells / ((h / height) * (w / width))
    return means if pixels.ndim == 3 else means[:, :, 0]


def difference_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: in each of 8 rows, whether each of 8 cells is darker than the next."""
    grey = pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The area-resized square tile in NPY format, 8 bits a sample."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(np.round(area_resize(pixels, side, side), 6)), 0, 255).astype(np.uint8))
    return out.getvalue()


def decode_media(media: DataFrame, column: str = "media", side: int = TILE) -> DataFrame:
    """``media`` with width, height, channels, tile (NPY bytes), dhash and error; columns of these names are replaced."""
    added = ["width", "height", "channels", "tile", "dhash", "error"]
    kept = media.drop(*added)
    schema = with_fields(kept.schema, "width int, height int, channels int, tile binary, dhash string, error string")
    where = kept.columns.index(column)

    def one(data: bytes | None) -> tuple:
        try:
            pixels = decode_image(data or b"")
            if not pixels.size:
                raise ValueError("no pixels")
            return pixels.shape[1], pixels.shape[0], 3 if pixels.ndim == 3 else 1, npy_tile(pixels, side), difference_hash(pixels), None
        except (ValueError, TypeError, IndexError, OverflowError, MemoryError, struct.error) as e:
            return None, None, None, None, None, str(e) or type(e).__name__

    def run(batches):
        for batch in batches:
            rows = list(zip(*[one(v.as_py()) for v in batch.column(where)], strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            arrays = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added])

    return kept.mapInArrow(run, schema)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the text's bytes with blanks up to a positive multiple of ROW_BYTES."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES)


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: bool = False) -> DataFrame:
    """Every text stored as a P6 image of 64-pixel rows, read back, hashed and described.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (difference hash of the decoded image, and the digest of its NPY tile); with ``tile`` that tile, too.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["tile"] * tile]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * tile]

    def one(text: str | None) -> tuple:
        n, payload = payload_of(text)
        stored = encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3))
        pixels = decode_image(stored)
        back = pixels.tobytes()
        made = npy_tile(pixels)
        feature = difference_hash(pixels) + hashlib.sha256(made).hexdigest()[:16]
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, *[made] * tile

    def run(batches):
        for batch in batches:
            rows = list(zip(*[one(v.as_py()) for v in batch.column(1)], strict=True)) or [()] * (len(names) - 1)
            arrays = [pa.array(x, k) for x, k in zip(rows, kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", tile binary" * tile
    )
