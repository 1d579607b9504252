"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles, difference hashes.

`decode` reads PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed BMP (1, 4, 8, 24 and 32 bits, both row orders;
channel masks only where they name the usual order).
`area_resize` averages each target cell's exact area through an integral image. `to_tiles` cuts an array into tiles
of a bounded number of rows, each a complete NPY file; a stored form is those files one after the other.
Everything works on one document at a time, so memory is bounded by the largest document.

Damaged or foreign bytes decode to None. A null or empty text is one row of zeros. Equal texts get equal values;
null ids and other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, text_bytes, written

WIDTH = 64
TILE_ROWS = 1024


def _tokens(data: bytes, wanted: int, at: int) -> tuple[list[int], int]:
    """The next numbers of a Netpbm header; comments run from # to the line's end."""
    out: list[int] = []
    while len(out) < wanted:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise ValueError("a number was expected")
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap = kind in (b"P1", b"P4")
    sizes, at = _tokens(data, 2 if bitmap else 3, 2)
    w, h, top = sizes[0], sizes[1], 1 if bitmap else sizes[2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        flat = np.array([c - 48 for c in data[at:] if c in b"01"][: w * h], np.uint8)
    elif kind in (b"P2", b"P3"):
        flat = np.array(_tokens(data, w * h * depth, at)[0], np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        flat = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * depth, at + 1)
    if flat.size != w * h * depth:
        raise ValueError("too short")
    if bitmap:
        flat = (1 - flat) * np.uint8(255)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, header = struct.unpack_from("<I4x", data, 10)[0] if len(data) < 18 else struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("this BMP is not supported")
    if packed == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("only the common order of channels is supported")
    line = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if bits <= 8:
        palette = np.frombuffer(data, np.uint8, (start - 14 - header) // 4 * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        index = np.unpackbits(rows, axis=1)[:, :w] if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(abs(h), -1)[:, :w] if bits == 4 else rows[:, :w]
        return palette[index]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes | None) -> np.ndarray | None:
    """An image as (rows, columns) or (rows, columns, RGB); None where it can't be read."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, TypeError, IndexError, struct.error):
        return None


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def _edges(length: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(cells + 1) * (length / cells)
    whole = np.minimum(x.astype(np.int64), length - 1)
    return whole, x - whole


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of every cell of a rows x cols grid laid over a grey image: differences of the interpolated integral image."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    y, fy = _edges(h, rows)
    x, fx = _edges(w, cols)
    line = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    at = line[:, x] * (1 - fx) + line[:, x + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) * (rows * cols / (h * w))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 cells is brighter than its right neighbour (rounded, so that equal means tie)."""
    cells = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def to_tiles(image: np.ndarray, tile_rows: int = TILE_ROWS) -> list[bytes]:
    out = []
    for at in range(0, len(image), tile_rows):
        np.save(buffer := io.BytesIO(), np.ascontiguousarray(image[at : at + tile_rows]))
        out.append(buffer.getvalue())
    return out


def from_tiles(stored: bytes) -> np.ndarray:
    buffer, tiles = io.BytesIO(stored), []
    while buffer.tell() < len(stored):
        tiles.append(np.load(buffer))
    return np.concatenate(tiles)


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _store(batches):
    for b in small(batches):
        raws = b.column("raw").to_pylist()
        stored = []
        for raw in raws:
            payload = pad(raw)
            image = decode(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
            stored.append(b"".join(to_tiles(image)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "stored"])


def _features(batches):
    for b in small(batches):
        out: list[tuple] = []
        for stored in b.column("stored").to_pylist():
            image = from_tiles(stored)
            payload = image.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image)))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_tiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and each text as a stored form of NPY tiles."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("raw")).mapInArrow(_store, f"doc_id {kind}, n_bytes long, stored binary")


def op10(docs: DataFrame) -> DataFrame:
    """Write the tiles of every text to a table in the shared folder, read them back and take the features."""
    tiles = written(media_tiles(docs), "tiles")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return tiles.mapInArrow(_features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
