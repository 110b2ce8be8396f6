"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles.

A text becomes a picture losslessly: its UTF-8 bytes, filled up with spaces to whole rows of 64 RGB pixels, are
the samples of a binary PPM. The pictures are written as a binary column of a Parquet table in the shared folder
and read from there again; digests and the difference hash come from the bytes that were read, and the area-resized NPY
tiles are written to a table of their own and read back for the rest of the feature.

Pictures are resized from integral images of BAND rows at a time, which carry the last row's sums on, so memory beyond
the picture itself doesn't grow with it; values go from worker to Spark one long one at a time.

Defined results: a null or empty text is one row of spaces; equal texts give equal values whatever their ids; an
empty table gives an empty result; other columns are ignored. A text's bytes are held a few times over in one worker
(the text, its bytes, its picture, Arrow's copies), so executors need about six times the longest text.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from quern.llm.common import map_batches, materialize, table

WIDTH = 64
TILE = 16
#: Rows of a picture that are summed up at a time.
BAND = 1024


def to_ppm(raw: bytes, width: int = WIDTH) -> bytes:
    """A PPM whose samples are the bytes, filled up with spaces to whole rows, one at least."""
    fill = -len(raw) % (3 * width) if raw else 3 * width
    return b"".join((b"P6\n%d %d\n255\n" % (width, (len(raw) + fill) // (3 * width)), raw, b" " * fill))


def to_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP, rows from the bottom, each filled up to four bytes."""
    height, width, _ = pixels.shape
    pitch = (3 * width + 3) // 4 * 4
    body = np.zeros((height, pitch), np.uint8)
    body[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[:2], 2, []
    wanted = 2 if kind in (b"P1", b"P4") else 3
    while len(fields) < wanted:
        c = data[at : at + 1]
        if c == b"#":
            while data[at : at + 1] not in (b"\n", b"\r", b""):
                at += 1
        elif c.isspace():
            at += 1
        elif c.isdigit():
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            fields.append(int(data[at:end]))
            at = end
        else:
            raise ValueError("bad Netpbm header")
    width, height = fields[:2]
    most = fields[2] if wanted == 3 else 1
    bands = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        wide = most > 255
        flat = np.frombuffer(data, ">u2" if wide else np.uint8, width * height * bands, at + 1)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        flat = 1 - np.unpackbits(rows, axis=1)[:, :width].reshape(-1)
    elif kind == b"P1":
        bits = [b == ord("0") for b in data[at:] if b in b"01"]  # 1 is black
        flat = np.array(bits[: width * height], np.int64)
    else:
        flat = np.array(data[at:].split()[: width * height * bands], np.int64)
    if most != 255:
        flat = flat.astype(np.int64) * 255 // most
    return flat.astype(np.uint8, copy=False).reshape(height, width, bands)


def _bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    pitch = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, pitch * abs(height), start).reshape(abs(height), pitch)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(used, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Height x width x bands of 8-bit samples, of a Netpbm (P1 to P6) or BMP file."""
    if data[:2] == b"BM":
        return _bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def integral_rows(pixels: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows ``wanted`` (rising) of the integral image with a row and a column of zeros before it, made BAND rows at a time."""
    h, w, bands = pixels.shape
    out = np.zeros((len(wanted), w + 1, bands))
    above = np.zeros((w, bands))
    for lo in range(0, h, BAND):
        part = np.cumsum(pixels[lo : lo + BAND], axis=0, dtype=np.float64)
        np.cumsum(part, axis=1, out=part)
        part += above
        mine = np.flatnonzero((wanted > lo) & (wanted <= lo + len(part)))
        out[mine, 1:] = part[wanted[mine] - lo - 1]
        above = part[-1].copy()
    return out


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, exact at fractional edges, from integral images."""
    h, w, bands = pixels.shape

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(m + 1) * n / m
        lo = np.minimum(x.astype(np.int64), n - 1)
        return lo, x - lo

    (ys, fy), (xs, fx) = edges(h, height), edges(w, width)
    fy, fx = fy[:, None, None], fx[None, :, None]
    rows = integral_rows(pixels, ys) * (1 - fy) + integral_rows(pixels, ys + 1) * fy
    grid = rows[:, xs] * (1 - fx) + rows[:, xs + 1] * fx
    cells = np.diff(np.diff(grid, axis=0), axis=1) / (h * w / (height * width))
    return np.clip(np.rint(cells), 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether each of 8 x 9 grey cells is darker than its right neighbour."""
    small = area_resize(pixels, 8, 9).astype(np.int64)
    grey = small @ np.array([299, 587, 114]) if small.shape[2] == 3 else small[:, :, 0] * 1000
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, area_resize(pixels, side, side), allow_pickle=False)
    return out.getvalue()


#: Bytes of long values that leave a worker together.
FLUSH_BYTES = 16 << 20


def _slices(batch: pa.RecordBatch, column: int):
    """Slices of a batch whose values in a column, text or binary, add up to FLUSH_BYTES or are one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    lo = held = 0
    for k, n in enumerate(sizes):
        if k > lo and held + n > FLUSH_BYTES:
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += n
    if lo < len(sizes):
        yield batch.slice(lo)


def store(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PPM in a table of the shared folder."""

    def encode(batch):
        for part in _slices(batch, 1):
            media, sizes = [], []
            for text in part.column(1):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(to_ppm(raw))
            yield {"doc_id": part.column(0), "n_bytes": sizes, "media": media}

    df = map_batches(docs.select("doc_id", "text"), encode, f"doc_id {_id_type(docs)}, n_bytes long, media binary")
    return materialize(spark, df, "media")


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def describe(spark: SparkSession, media: DataFrame) -> DataFrame:
    """Decodes a column ``media`` and adds the payload's digests, a difference hash and an NPY tile, in a written table."""

    def read(batch):
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "difference_hash", "tile")}
        for value in batch.column(2):
            data = value.as_py()
            pixels = decode(data)
            flat = pixels.reshape(-1)  # a view of the picture's own bytes where it is contiguous
            out["payload_bytes"].append(flat.size)
            out["payload_sha256"].append(hashlib.sha256(flat).hexdigest())
            out["tail_crc32"].append(zlib.crc32(flat[-16:].tobytes()))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["difference_hash"].append(difference_hash(pixels))
            out["tile"].append(npy_tile(pixels))
        yield {"doc_id": batch.column(0), "n_bytes": batch.column(1), **out}

    described = map_batches(
        media.select("doc_id", "n_bytes", "media"),
        read,
        f"doc_id {_id_type(media)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, difference_hash string, tile binary",
    )
    return materialize(spark, described, "tiles")


def features(tiles: DataFrame) -> DataFrame:
    """Reads the tiles and adds ``feature``: the difference hash, and the mean of the tile's samples and its edges' strength by band."""

    def read(batch):
        found = []
        for dhash, data in zip(batch.column("difference_hash").to_pylist(), batch.column("tile").to_pylist(), strict=True):
            tile = np.load(io.BytesIO(data), allow_pickle=False).astype(np.int64)
            means = tile.sum((0, 1)) * 100 // (tile.shape[0] * tile.shape[1])
            edges = abs(np.diff(tile, axis=1)).sum((0, 1)) * 100 // (tile.shape[0] * (tile.shape[1] - 1))
            found.append(":".join([dhash, *(f"{m}/{e}" for m, e in zip(means, edges, strict=True))]))
        yield {**{c: batch.column(c) for c in batch.schema.names if c not in ("difference_hash", "tile")}, "feature": found}

    kept = [f for f in tiles.schema.fields if f.name not in ("difference_hash", "tile")]
    return map_batches(tiles, read, StructType([*kept, StructField("feature", StringType())]))


def op6_netpbm_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(describe(spark, store(spark, table(spark, sf_dir, "documents"))))
