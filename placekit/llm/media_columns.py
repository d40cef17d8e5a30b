"""Media columns: Netpbm and BMP decoded to arrays, area-resized by integral images, kept as NPY tiles.

A medium that is null, cut short, of no known format, or holds a sample that is no number or above its maximum gives
null results and an ``error``; an image without pixels is such a case. Equal bytes give equal results, ties between
neighbouring cells a 0 in the hash. Rows are handled 256 at a time: their media and pixels are held together. Null and empty
texts are one row of bytes 0; long ones are kept whole. An empty table gives an empty table. Extra columns are carried; one of the name of a result is an error.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import read_table

_HEAD = re.compile(rb"P([1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 2)


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 8 or 16 bits; bitmaps have 0 for black, 255 for white."""
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not a Netpbm head")
    kind, w, h, at, top = int(m[1]), int(m[2]), int(m[3]), m.end(), 1
    if kind not in (1, 4):
        t = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        if not t or not 0 < (top := int(t[1])) < 65536:
            raise ValueError("no maximum value")
        at = t.end()
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = h * w * (3 if kind in (3, 6) else 1)
    if not n:
        raise ValueError("no pixels")
    if n > 8 * len(data):  # a bit at least for each
        raise ValueError("cut short")
    if kind == 1:
        bits = re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:n]
        if bits.strip(b"01"):
            raise ValueError("a bit that is neither 0 nor 1")
        out = np.where(np.frombuffer(bits, np.uint8) == 48, 255, 0).astype(np.uint8)
    elif kind in (2, 3):
        words = re.sub(rb"#[^\n]*\n", b" ", data[at:]).split()[:n]
        if not all(w.isdigit() and len(w) < 9 for w in words):
            raise ValueError("a sample that is no number")
        out = np.array(words, dtype=np.int64)
    elif kind == 4:
        row = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, count=row * h, offset=at + 1).reshape(h, row)
        out = np.where(np.unpackbits(raw, axis=1)[:, :w] == 0, 255, 0).astype(np.uint8)
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count=n, offset=at + 1)
    if out.size != n:
        raise ValueError("cut short")
    if kind not in (1, 4) and int(out.max()) > top:
        raise ValueError("a sample above the maximum")
    return out.reshape(shape).astype(np.uint8 if top < 256 else np.uint16, copy=False)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, bottom-up or top-down, as (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    at, head = (int.from_bytes(data[i : i + 4], "little") for i in (10, 14))
    w, h = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise ValueError("a kind of BMP that isn't read")
    row = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, count=row * abs(h), offset=at).reshape(abs(h), row)
    raw = raw if h < 0 else raw[::-1]
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    index = raw[:, :w] if bits == 8 else np.unpackbits(raw, axis=1).reshape(abs(h), -1, bits)
    index = index if bits == 8 else (index * (1 << np.arange(bits - 1, -1, -1))).sum(2)[:, :w]
    palette = np.frombuffer(data, np.uint8, count=(int.from_bytes(data[46:50], "little") or 1 << bits) * 4, offset=14 + head).reshape(-1, 4)
    return palette[index][:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def _edges(n: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(out + 1) * n / out
    low = np.minimum(np.floor(at).astype(np.int64), n)
    return low, np.minimum(low + 1, n), at - low


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area of each target pixel, from the integral image at the targets' edges.

    Only the rows of the integral image that an edge touches are kept, so a tall image needs no
    copy in 8 bytes a pixel.
    """
    h, w = gray.shape
    lo, hi, part = _edges(h, height)
    rows = np.unique(np.concatenate([lo, hi]))
    sums = np.zeros((len(rows), w))
    for i in range(1, len(rows)):
        sums[i] = sums[i - 1] + gray[rows[i - 1] : rows[i]].sum(0, dtype=np.float64)
    integral = np.concatenate([np.zeros((len(rows), 1)), sums.cumsum(1)], 1)
    a, b = (np.searchsorted(rows, x) for x in (lo, hi))
    at = integral[a] + (integral[b] - integral[a]) * part[:, None]
    lo, hi, part = _edges(w, width)
    at = at[:, lo] + (at[:, hi] - at[:, lo]) * part
    return np.diff(np.diff(at, axis=0), axis=1) / (h / height * (w / width))


def to_gray(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(gray: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each cell of an 8 x 9 reduction is brighter than its left neighbour."""
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def media_features(df: DataFrame, media: str, tile: int = 32) -> DataFrame:
    """``df`` with height, width, pixels (raw samples), dhash, tile (NPY, tile x tile, 8 bits) and error."""
    extra = [pa.field(n, t) for n, t in (("height", pa.int64()), ("width", pa.int64()), ("pixels", pa.binary()), ("dhash", pa.string()), ("tile", pa.binary()), ("error", pa.string()))]
    names = {f.name for f in extra}
    if clash := names & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("null")
            pixels = decode(data)
            gray = to_gray(pixels)
            top = np.clip(np.rint(area_resize(gray, tile, tile)), 0, np.iinfo(pixels.dtype).max).astype(pixels.dtype)
            return *pixels.shape[:2], pixels.tobytes(), difference_hash(gray), npy_bytes(top), None
        except (ValueError, IndexError, OverflowError) as e:
            return None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(media)
            for lo in range(0, b.num_rows, 256):  # few rows at a time: their pixels are large
                part = b.slice(lo, 256)
                got = list(zip(*(one(x.as_py()) for x in part.column(at)), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, f.type) for v, f in zip(got, extra, strict=True))], names=[*part.schema.names, *(f.name for f in extra)])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, height long, width long, pixels binary, dhash string, tile binary, error string")


def write_tiles(df: DataFrame, path: str, keys: list[str], tile: str = "tile") -> None:
    """The NPY tiles of ``media_features`` with their keys, as Parquet; a tile is what ``numpy.load`` reads from its bytes."""
    df.select(*keys, F.col(tile).alias("tile"), "height", "width", "dhash", "error").write.mode("overwrite").parquet(path)


def store_texts(docs: DataFrame, row: int = 64) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, filled with bytes 0 to rows of ``row``, as a PGM image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(1).cast(pa.binary())]
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                media = []
                for t in part:
                    t = t.ljust(max(row, -(-len(t) // row) * row), b"\0")
                    media.append(encode_pgm(np.frombuffer(t, np.uint8).reshape(-1, row)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(map(len, part), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    made = media_features(store_texts(docs), "media")
    return made.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).cast("long").alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )


def digest(data: bytes) -> tuple[int, str, int]:
    """Length, sha256 and crc32 of the last 64 bytes, for tests."""
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])
