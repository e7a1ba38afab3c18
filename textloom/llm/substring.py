"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is 13 consecutive words of one document (words are ``[^\\x20\\x09-\\x0D]+``). Words covered by a window that also starts in a document
with a smaller doc_id are duplicate spans.

1. A map task cuts its documents into reference blocks of about CHUNK_WINDOWS windows and indexes each by window: the seeds. Each document is parsed
   greedily against the block (``factors_of``): where a window has a seed in a smaller document, the match is extended word by word in that source for as long as
   both go on alike; that longest factor, WINDOW words or more, becomes a span and parsing goes on behind it. The windows that lie across the border of two
   factors are looked up one by one.
2. Windows without a source in their own block meet those of all other blocks at the part of their hash, which holds the smallest document of
   each. A block sends a window at most once, for its smallest document, so no window, however common, makes a hot part; factors travel as (start,
   windows), by document.
3. Verdicts return packed and meet the texts in one shuffle, where factors and windows close up to spans.

A factor within a block is decided by the parse, a match across blocks by the lookup of each window: sources of other blocks are not at
hand there, so their factors are the runs of windows found. Both are exact, so are the spans.

Null and empty texts have no words. Rows with a null doc_id have no smaller document: they are returned whole and never serve as
reference. Repeated rows (same id and text) get the same answer, and a block parses them once; rows that share an id but not the text are never each other's
source. Very long texts are parsed whole: memory follows the longest text, not the table. Empty tables give no rows. Extra columns never reach
``dedup_substrings`` and are kept by ``cut_documents``, whatever their names. Hashes are 64 bits wide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Windows in a reference block, characters of text whose windows make one part.
CHUNK_WINDOWS, PART_CHARS = 600_000, 10_000_000
_PACKED = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("hashes", pa.binary()), ("salts", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("runs", pa.binary())])
_PACKED_SQL = "part int, known boolean, hashes binary, salts binary, ids binary, counts binary, places binary, runs binary"


def _narrow(values: np.ndarray) -> bytes:
    """u16 if all fit, else u32; _widen tells them apart by the count."""
    return values.astype("<u2" if values.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.uint32)


def _deltas(ids: np.ndarray) -> bytes:
    """Ascending ids: the first, then the distances, as narrow as they allow."""
    apart = np.diff(ids.view(np.uint64))
    top = int(apart.max(initial=0))
    return ids[:1].tobytes() + apart.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _undeltas(data: bytes, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = np.frombuffer(data[:8], np.uint64)
    if n > 1:
        out[1:] = np.frombuffer(data[8:], f"<u{(len(data) - 8) // (n - 1)}")
    return np.cumsum(out, dtype=np.uint64).view(np.int64)


def factors_of(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of a block, in windows: first window, number of windows and source window of each factor.

    hashes: of all windows of the block, document after document; docs: each window's document; ids: each document's id, ascending. A source lies in a document of a
    smaller id. A factor of n windows has n + WINDOW - 1 words."""
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none, none
    order = np.argsort(hashes, kind="stable")
    seeds = hashes[order]
    heads = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]])
    source = np.empty(len(hashes), np.int64)
    source[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    del seeds, order
    known = np.flatnonzero(ids[docs[source]] < ids[docs])
    if not len(known):
        return none, none, none
    at = source[known]
    goes_on = (known[1:] == known[:-1] + 1) & (at[1:] == at[:-1] + 1) & (docs[known[1:]] == docs[known[:-1]]) & (docs[at[1:]] == docs[at[:-1]])
    cut = np.flatnonzero(np.r_[True, ~goes_on])
    starts, lengths, sources = known[cut].tolist(), np.diff(np.append(cut, len(known))).tolist(), at[cut].tolist()
    # the first source may change although the one in use goes on alike: then the factor is longer than the run
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    reach = 0
    for start, n, src in zip(starts, lengths, sources):
        end = start + n
        if end <= reach:
            continue
        if start < reach:
            src, start = src + reach - start, reach
        x, y, step = end, src + end - start, 16
        limit = min(len(hashes) - x, len(hashes) - y)
        if limit > 0 and hashes[x] == hashes[y]:
            grown = 0
            while grown < limit:
                hi = min(grown + step, limit)
                same = (hashes[x + grown : x + hi] == hashes[y + grown : y + hi]) & (docs[x + grown : x + hi] == docs[start]) & (docs[y + grown : y + hi] == docs[src])
                if not same.all():
                    grown += int(np.argmin(same))
                    break
                grown, step = hi, step * 4
            end += grown
        reach = end
        out[0].append(start)
        out[1].append(end - start)
        out[2].append(src)
    return tuple(np.array(c, np.int64) for c in out)


def _pack_map(parts: int, window: int, chunk: int):
    def rows_of(key, docs, salts, ids, places, hashes, runs) -> Iterator[list]:
        """One packed row for each value of key (sorted): part of it, documents with their counts, places, and hashes or runs."""
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            held = docs[lo:hi]
            heads = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
            packed = b"" if hashes is None else hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 7 if parts <= 256 else 8].tobytes()
            yield [int(key[lo]), hashes is None, packed, salts[held[heads]].tobytes(), _deltas(ids[held[heads]]), _narrow(np.diff(np.r_[heads, len(held)])), _narrow(places[lo:hi]), b"" if runs is None else _narrow(runs[lo:hi])]

    def batches_of(rows: Iterator[list]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for row in rows:
            held.append(row)
            if len(held) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PACKED)], schema=_PACKED)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PACKED)], schema=_PACKED)

    def block(hashes, docs, places, salts, ids) -> Iterator[pa.RecordBatch]:
        """hashes and places of windows, docs: index into salts and ids, which are sorted by id."""
        starts, runs, _ = factors_of(hashes, docs, ids)
        part = ids[docs[starts]] % parts
        by = np.argsort(part, kind="stable")
        starts, runs, part = starts[by], runs[by], part[by]
        yield from batches_of(rows_of(part, docs[starts], salts, ids, places[starts], None, runs))
        edge = np.zeros(len(hashes) + 1, np.int8)
        edge[starts] += 1
        np.subtract.at(edge, starts + runs, 1)
        open_ = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
        hashes, docs, places = hashes[open_], docs[open_], places[open_]
        part = ((hashes >> np.uint64(56)).astype(np.int32) * parts >> 8) if parts <= 256 else ((hashes >> np.uint64(40)).astype(np.int64) * parts >> 24)
        by = np.argsort(part, kind="stable")
        yield from batches_of(rows_of(part[by], docs[by], salts, ids, places[by], hashes[by], None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            hashes, counts, places, salts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # documents in order of id, each once: a seed's first window is then of its smallest document
            rank = np.lexsort((salts, ids))
            starts, n = (np.cumsum(counts) - counts)[rank], counts[rank]
            once = np.r_[True, (ids[rank][1:] != ids[rank][:-1]) | (salts[rank][1:] != salts[rank][:-1])]
            rank, starts, n = rank[once], starts[once], n[once]
            take = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            docs = np.repeat(np.arange(len(rank), dtype=np.int32), n)
            hashes, places = hashes[take], places[take]
            del take
            yield from block(hashes, docs, places, salts[rank], ids[rank])

        for batch in batches:
            ids, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            for lo, hi, data, offsets in common.slices(batch.column(2)):
                starts, ends, firsts = common.word_spans(data, offsets)
                grams = common.ngram_hashes(common.word_hashes(data, starts, ends), window)
                at, docs = common.starts_of(firsts, window)
                if not len(at):
                    continue
                counts = np.bincount(docs, minlength=hi - lo)
                full = counts > 0
                held.append((grams[at], counts[full], (at - firsts[:-1][docs]).astype(np.uint32), salts[lo:hi][full], ids[lo:hi][full]))
                total += len(at)
                if total >= chunk:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def _match_block(dests: int):
    def packed(doc, salt, which, place, runs) -> Iterator[pa.RecordBatch]:
        """Verdicts by destination. doc, salt: of documents; which: each verdict's document."""
        dest = ((doc + salt) % dests)[which]
        order = np.lexsort((which, dest))
        which, place, dest = which[order], place[order], dest[order]
        runs = None if runs is None else runs[order]
        edges = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1], True]) if len(dest) else np.zeros(1, np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            heads = lo + np.flatnonzero(np.r_[True, which[lo + 1 : hi] != which[lo : hi - 1]])
            blobs = (doc[which[heads]].tobytes(), salt[which[heads]].tobytes(), _narrow(np.diff(np.r_[heads, hi])), _narrow(place[lo:hi]), b"" if runs is None else _narrow(runs[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([int(dest[lo])]), *(pa.array([b], pa.binary()) for b in blobs)], names=["dest", *_BLOBS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Factors go on to their texts; of a part's windows, those that start in a smaller document too."""
        hashes, docs, salts, counts, places = [], [], [], [], []
        for batch in batches:
            for r in range(batch.num_rows):
                part, known, packed_hashes, s, d, c, p, n = (batch.column(k)[r].as_py() for k in range(8))
                salt = np.frombuffer(s, np.uint32)
                doc = _undeltas(d, len(salt))
                count = _widen(c, len(doc)).astype(np.int64)
                place = _widen(p, int(count.sum()))
                if known:
                    yield from packed(doc, salt, np.repeat(np.arange(len(doc)), count), place, _widen(n, len(place)))
                    continue
                width = len(packed_hashes) // len(place)
                wide = np.zeros((len(place), 8), np.uint8)
                wide[:, :width] = np.frombuffer(packed_hashes, np.uint8).reshape(-1, width)
                if width < 8:
                    wide[:, 7] = part & 0xFF
                for column, value in zip((hashes, docs, salts, counts, places), (wide.view("<u8").ravel(), doc, salt, count, place), strict=True):
                    column.append(value)
                wide = packed_hashes = None
            batch = None  # not held while the next one comes
        if not hashes:
            return
        h = np.concatenate(hashes)
        hashes.clear()
        order = np.argsort(h).astype(np.int32 if len(h) < 1 << 31 else np.int64)
        h = h[order]
        again = np.r_[False, h[1:] == h[:-1]]
        del h
        shared = again | np.r_[again[1:], False]  # few windows are in two places; only of these is more looked at
        order, heads = order[shared], np.flatnonzero(~again[shared])
        del again, shared
        doc, salt, count, place = (np.concatenate(x) for x in (docs, salts, counts, places))
        which = np.searchsorted(np.cumsum(count), order, "right")
        own = doc[which]
        later = own > np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(own))))
        yield from packed(doc, salt, which[later], place[order[later]], None)

    return run


_BLOBS = ("ids", "salts", "counts", "places", "runs")
_VERDICTS = "dest long, " + ", ".join(f"{b} binary" for b in _BLOBS)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).bitwiseAND(0xFFFFFFFF).alias("salt"), F.col(text_col).alias("text"))


def duplicate_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk: int = CHUNK_WINDOWS, dests: int = 1) -> DataFrame:
    """Starts of the windows to remove, by (id, salt of the text), packed by dest = (id + salt) mod dests; several rows a dest."""
    parts = common.text_parts(docs, text_col, PART_CHARS)
    packed = _keyed(docs, id_col, text_col).filter("id is not null and text is not null").mapInArrow(common.frugal(_pack_map(parts, window, chunk)), _PACKED_SQL)
    return packed.repartition(parts, "part").mapInArrow(common.frugal(_match_block(dests)), _VERDICTS)


def _cut(window: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by dest, a dest's verdicts before its texts; the verdicts of one dest are held at a time. whole: uncut texts stay as they are, and the
        struct ``rest`` goes along."""
        dest, marks = None, {}
        names = ["doc_id", "n_words", "span_starts", "span_ends", "kept_text"]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.large_string())
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            taken: list[int] = []
            dests, kind = batch.column("dest").to_pylist(), batch.column("kind").to_pylist()
            blobs = [batch.column(c) for c in _BLOBS]
            docs, salts, texts = batch.column("id").to_pylist(), batch.column("salt").to_pylist(), batch.column("text").cast(pa.large_binary())
            for i, (d, k) in enumerate(zip(dests, kind, strict=True)):
                if d != dest:
                    dest, marks = d, {}
                if k == 0:
                    ids, salt, count, places, runs = (b[i].as_py() for b in blobs)
                    own, salt = np.frombuffer(ids, np.int64), np.frombuffer(salt, np.uint32)
                    count = _widen(count, len(own)).astype(np.int64)
                    places = _widen(places, int(count.sum())).astype(np.int64)
                    stops = places + window + (_widen(runs, len(places)).astype(np.int64) - 1 if runs else 0)
                    ends = np.cumsum(count)
                    for key, a, b in zip(zip(own.tolist(), salt.tolist(), strict=True), (ends - count).tolist(), ends.tolist(), strict=True):
                        marks.setdefault(key, []).append((places[a:b], stops[a:b]))
                    continue
                words, spans = (texts[i].as_py() or b"").split(), []
                if found := marks.get((docs[i], salts[i])):
                    begin, stop = (np.bincount(np.concatenate(x), minlength=len(words) + 1) for x in zip(*found, strict=True))
                    gone = np.cumsum(begin - stop)[:-1] > 0
                    spans = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
                if spans or not whole:
                    edges = [0, *spans, len(words)]
                    kept = b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]).decode()
                else:
                    kept = batch.column("text")[i].as_py()
                taken.append(i)
                for column, value in zip(out, (docs[i], len(words), spans[::2], spans[1::2], kept), strict=True):
                    column.append(value)
            if taken:
                more = [batch.column("rest").take(pa.array(taken))] if whole else []
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)] + more, names=names + ["rest"] * whole)

    return run


_RESULT = "doc_id long, n_words long, span_starts array<int>, span_ends array<int>, kept_text string"


def _together(docs: DataFrame, id_col: str, text_col: str, window: int, chunk: int, rest: list[str] | None) -> DataFrame:
    """Verdicts and texts, dealt and sorted so that each dest's verdicts come first."""
    dests = common.parts_for(docs)
    held = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(None).cast("int").alias("rest")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).bitwiseAND(0xFFFFFFFF).alias("salt"), F.col(text_col).alias("text"), held)
    none = lambda c: F.lit(None).cast(texts.schema[c].dataType).alias(c)
    marks = duplicate_windows(docs, id_col, text_col, window, chunk, dests).select("dest", F.lit(0).alias("kind"), *_BLOBS, none("id"), none("salt"), none("text"), none("rest"))
    dest = F.pmod(F.coalesce("id", F.lit(0)) + F.col("salt"), F.lit(dests))
    dealt = texts.select(dest.alias("dest"), F.lit(1).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in _BLOBS), "id", "salt", "text", "rest")
    return marks.unionByName(dealt).repartition(dests, "dest").sortWithinPartitions("dest", "kind")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, duplicate spans (word indexes, end exclusive) and the kept words joined by a space."""
    return _together(docs, id_col, text_col, window, chunk, None).mapInArrow(common.frugal(_cut(window, False)), _RESULT)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", window: int = WINDOW, chunk: int = CHUNK_WINDOWS) -> DataFrame:
    """docs with duplicate spans cut from the text and count_col, if there, set anew. Uncut texts stay as they are; a row whose text
    loses every word goes."""
    rest = [c for c in docs.columns if c != text_col]
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")).schema["rest"].dataType.simpleString()
    cut = _together(docs, id_col, text_col, window, chunk, rest).mapInArrow(common.frugal(_cut(window, True)), f"{_RESULT}, rest {kind}")
    touched = F.size("span_starts") > 0
    left = cut.filter(~touched | (F.col("kept_text") != ""))
    own = {c: F.col("rest").getField(c) for c in rest} | {text_col: F.col("kept_text")}
    if count_col in own:
        own[count_col] = F.when(touched, F.length("kept_text")).otherwise(own[count_col]).cast(docs.schema[count_col].dataType)
    return left.select(*[own[c].alias(c) for c in docs.columns])


def removed_words():
    """The number of words in the spans, as a column."""
    return F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's result for a small list of (doc_id, text), by plain dictionaries."""
    first: dict[tuple, int] = {}
    split = [(i, [] if t is None else t.encode().split()) for i, t in rows]
    for i, words in split:
        if i is not None:
            for k in range(len(words) - window + 1):
                w = tuple(words[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    return out
