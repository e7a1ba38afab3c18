"""Media columns: bytes held as PNG images in a binary column, read back with checks, and hashed by low frequencies.

A payload (padded with zero bytes to a multiple of 64) is stored as an 8-bit grey image 64 samples wide. Each row takes the filter, of none, left and up, whose
bytes have the least sum of absolute values; average and Paeth are written on demand and always read. The reader walks the PNG chunks, tests each CRC, inflates IDAT and undoes the filters in
numpy: left and up by running sums over all rows at once, average and Paeth along the diagonals of a run of rows, since a sample waits only for those left of and above it (some 30
times slower, so not chosen by itself). The feature is a 64-bit sign hash
of the 8x8 low-frequency corner of the discrete cosine transform of a 32x32 area mean.

Null and empty payloads give one row of 64 zeros. Rows are independent: no shuffle, repeated rows give equal values, empty tables give no rows, very long payloads are stored
whole, and extra columns never reach the operator. Damaged images give null from ``decode_png`` (see ``decode_column``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """payload and zero bytes up to a positive multiple of width."""
    return payload + bytes(-len(payload) % width if payload else width)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one nearest to left + up - corner."""
    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(rows: np.ndarray, row_filter: int | None = None) -> np.ndarray:
    """Rows with their filter byte; the least sum of absolute values decides on it where it isn't given."""
    x = rows.astype(np.int16)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 1:] = x[:-1, :-1]
    guesses = {0: lambda: 0, 1: lambda: left, 2: lambda: up, 3: lambda: (left + up) >> 1, 4: lambda: _paeth(left, up, corner)}
    lines = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    best = None
    for kind in (0, 1, 2) if row_filter is None else (row_filter,):
        own = (x - guesses[kind]()).astype(np.uint8)
        cost = np.abs(own.view(np.int8).astype(np.int16)).sum(axis=1)
        better = np.ones(len(rows), bool) if best is None else cost < best
        lines[better, 0], lines[better, 1:] = kind, own[better]
        best = cost if best is None else np.minimum(best, cost)
    return lines


def encode_png(payload: bytes, width: int = WIDTH, row_filter: int | None = None, level: int = 1) -> bytes:
    """A grey 8-bit PNG of the payload's rows. row_filter: one of the five for all rows, or for each the best of none, left and up."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(rows, row_filter).tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Rows without their filter byte."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    if not kinds.any():
        return rows
    if kinds.max() <= 2:
        left, up = kinds == 1, kinds == 2
        rows[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
        # an up row is the last row of another kind and all up rows since, added up
        base = np.maximum.accumulate(np.where(up, -1, np.arange(len(rows))))
        sums = np.cumsum(np.where(up[:, None], rows, 0), axis=0, dtype=np.uint8)
        at = base[up]
        known = np.where((at >= 0)[:, None], rows[at] - sums[at], 0).astype(np.uint8)
        rows[up] = sums[up] + known
        return rows
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(kinds)], strict=True):
        kind = kinds[lo]
        if kind == 1:
            rows[lo:hi] = np.cumsum(rows[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            start = max(lo - 1, 0)
            rows[start:hi] = np.cumsum(rows[start:hi], axis=0, dtype=np.uint8)
        elif kind > 2:
            _along_diagonals(rows, lo, hi, kind)
    return rows


def _along_diagonals(rows: np.ndarray, lo: int, hi: int, kind: int) -> None:
    """Undo average or Paeth in the rows lo to hi: all samples of a diagonal at a time."""
    n, width = hi - lo, rows.shape[1]
    # one column to the left and one row above, of zeros or of the row before
    x = np.zeros((n + 1, width + 1), np.int16)
    x[1:, 1:] = rows[lo:hi]
    if lo:
        x[0, 1:] = rows[lo - 1]
    flat = x.ravel()
    for d in range(n + width - 1):
        first = max(0, d - width + 1)
        i = np.arange(first, min(n, d + 1))
        at = (i + 1) * (width + 1) + d - i + 1
        left, up = flat[at - 1], flat[at - width - 1]
        guess = (left + up) >> 1 if kind == 3 else _paeth(left, up, flat[at - width - 2])
        flat[at] = (flat[at] + guess) & 255
    rows[lo:hi] = x[1:, 1:]


def decode_png(media: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, one row each. ValueError if a chunk's checksum, order or size is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, ended = 8, [], None, False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not ended:
        raise ValueError("not a complete grey 8-bit image without interlace")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("samples are missing")
    return _unfilter(lines.reshape(height, width + 1))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


_BASIS = _cosines(32, 8)


def _shrink(rows: np.ndarray, side: int = 32) -> np.ndarray:
    """Area means of side x side cells; few rows are repeated first."""
    rows = np.repeat(rows, -(-side // len(rows)), axis=0) if len(rows) < side else rows
    edges = np.arange(side) * len(rows) // side
    counts = np.diff(np.append(edges, len(rows)))
    across = rows.reshape(len(rows), side, -1).sum(axis=2, dtype=np.int64) if rows.shape[1] % side == 0 else rows[:, np.arange(side) * rows.shape[1] // side].astype(np.int64)
    return np.add.reduceat(across, edges, axis=0) / (counts[:, None] * max(1, rows.shape[1] // side))


def dct_hash(rows: np.ndarray) -> str:
    """16 hex digits: signs of the 8x8 lowest frequencies against their median, the constant term apart."""
    low = (_BASIS @ _shrink(rows) @ _BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def media_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the digest columns, through the stored image."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n", "p", "psha", "crc", "m", "msha", "f")}
        for text in batch.column(1).cast(pa.binary()):
            raw = text.as_py() or b""
            media = encode_png(pad(raw))
            rows = decode_png(media)
            back = rows.tobytes()
            for k, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), dct_hash(rows)), strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=names)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text through its PNG; one row per input row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(media_rows, SCHEMA)


def media_column(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with the stored PNG as a binary column (replaces a column of that name)."""

    @F.pandas_udf("binary")
    def store(texts):
        return texts.map(lambda t: encode_png(pad((t or "").encode())))

    return docs.withColumn(media_col, store(F.col(text_col)))


def decode_column(df: DataFrame, media_col: str = "media", payload_col: str = "payload") -> DataFrame:
    """df with the samples' bytes read back; null where the image is null or damaged."""

    @F.pandas_udf("binary")
    def load(images):
        def one(m):
            try:
                return None if m is None else decode_png(bytes(m)).tobytes()
            except (ValueError, zlib.error, struct.error):
                return None

        return images.map(one)

    return df.withColumn(payload_col, load(F.col(media_col)))
