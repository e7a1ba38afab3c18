"""Language-model scoring with a log-frequency Bloom filter.

Tokens are the A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text and one end token. The model interpolates three orders with the weights WEIGHTS:
``w1 * p(word) + w2 * (count(previous, word) - d) / count(previous) + w3 * (count(two before, word) - d) / count(two before)``, where the tokens before a text's first are end
tokens, p is the base probability and d is DISCOUNT. Every n-gram counts, those seen once too; the mass of the discounts is given to no word, so
probabilities add up to one at most. For p, a word that isn't in the filter counts as seen half a time.

Nothing that grows with the input reaches the driver or is broadcast: the filter is never in one place, n-grams travel to its slices.

1. Chunks. Map tasks, small partitions together in one, pack texts into compressed chunks of about CHUNK_BYTES, kept in the shared checkpoint folder, so that a chunk is the same whenever it is read.
2. Requests. Each chunk sends its distinct tokens, bigrams and trigrams, with how often its training documents hold them (0: only its other
   documents do), packed, to parts by hash: tokens whole, the longer ones by 40 hash bits and the part.
3. Bloom filter. A part adds up the counts. Of each n-gram seen, at any size of input, the keys (n-gram, 1) to (n-gram, level) go into
   the part's slices of the filter, one for each order, level being the logarithm of the count to base sqrt 2. A slice grows with its keys and always has 8 bits a key or more.
4. Answers. For each chunk the part finds the levels by probing (n-gram, 1), (n-gram, 2), ... until a key is absent, in the order they were asked for. For the base score,
   which needs exact counts of every token, those go along. Answers are checkpointed; the driver gets the two totals.
5. Scoring. Chunks meet their answers; their n-grams, sorted as before, tell each token's levels. An n-gram is asked for once a chunk, so no frequent one fills a part.

Null and empty texts hold the end token alone; very long texts are scored whole. Rows with a null doc_id are scored and train (their fold is -1). Repeated rows
count as often as they come. With no training text every count is 0. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the filter at least for each order (32 MB over all parts), probes a key, bits a key at least.
BITS, PROBES, BITS_A_KEY = 1 << 28, 4, 8
#: Tokens whose counts were once broadcast; nothing is any more.
FREQUENT = 1 << 17
#: Weights of one, two and three tokens; what is taken off the count of two and of three.
WEIGHTS, DISCOUNT = (0.6, 0.2, 0.2), 0.9
#: Times an n-gram must be seen to be kept: all are.
LEAST = 1
#: Text of a chunk.
CHUNK_BYTES = 8 << 20
_END = common.mix(np.array([0xE0D], np.uint64))[0]
_LOW = np.uint64((1 << 40) - 1)
_ZSTD, _ZSTD_TEXT = pa.Codec("zstd", 1), pa.Codec("zstd", 3)
_STEP = 1 << 18  # keys set or probed at a time


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents and each document's offsets, end tokens included."""
    starts, ends, firsts = common.word_spans(data, offsets)
    words = common.word_hashes(common.fold(data), starts, ends)
    out = np.full(len(words) + len(offsets) - 1, _END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))] = words
    return out, firsts + np.arange(len(firsts))


def bigrams(toks: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; each text ends with the end token, which so precedes the next text."""
    return common.mix(np.r_[_END, toks[:-1]][: len(toks)] * np.uint64(0xD1B54A32D192ED03) + toks)


def trigrams(toks: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Hash of each token with the two before, within its text: before a text's first token stand end tokens."""
    before = np.r_[common.mix(np.array([_END]) * np.uint64(3)), pairs[:-1]][: len(toks)]
    first = np.r_[_END, toks[:-1]][: len(toks)] == _END
    return common.mix(np.where(first, common.mix(np.array([_END]))[0], before) * np.uint64(0x94D049BB133111EB) + toks)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)).astype(np.int64) * parts) >> 24


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(counts) + 1e-9).astype(np.int64)


def count_at(levels: np.ndarray) -> np.ndarray:
    """Mean of a level's whole counts; 0 for level 0."""
    first, after = (np.ceil(2.0 ** ((levels + k) / 2) - 1e-9) for k in (-1, 0))
    return np.where(levels > 0, (first + after - 1) / 2, 0.0)


def _pressed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, the low ones first, compressed; planes of zeros at the top are left out."""
    top = int(values.max(initial=0))
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, : max(1, -(-top.bit_length() // 8))]
    raw = planes.T.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _opened(data: bytes, n: int) -> np.ndarray:
    """The n numbers of _pressed, as u64."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        raw = np.frombuffer(_ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
        out[:, : len(raw) // n] = raw.reshape(-1, n).T
    return out.view("<u8").ravel()


_CHUNKS = "chunk long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, size long, text binary"


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    serial = (task.partitionId() if task else 0) << 32
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        ids, folds, sizes, texts = zip(*held, strict=True)
        held.clear()
        text = np.concatenate(texts)
        lists = [pa.array([pa.concat_arrays(x)], pa.list_(k)) for x, k in ((ids, pa.int64()), (folds, pa.bool_()), ([pa.array(x) for x in sizes], pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), *lists, pa.array([len(text)], pa.int64()), pa.array([_ZSTD_TEXT.compress(text, asbytes=True)], pa.binary())], names=["chunk", "doc_ids", "held_out", "sizes", "size", "text"])

    for batch in batches:
        for lo, hi, data, offsets in common.slices(batch.column(2)):
            held.append((batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), np.diff(offsets), data))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield flush()
                size, serial = 0, serial + 1
    if held:
        yield flush()


def _ngrams(sizes: np.ndarray, size: int, text: bytes, parts: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Tokens of a chunk, its documents' offsets into them, and by order what n-grams are asked for by: tokens as they are, of longer ones the part and 40 bits."""
    data = np.frombuffer(_ZSTD.decompress(text, size, asbytes=True), np.uint8)
    toks, at = tokens(data, np.r_[0, np.cumsum(sizes)].astype(np.int64))
    pairs = bigrams(toks)
    return toks, at, [toks, *((part_of(h, parts).astype(np.uint64) << np.uint64(40)) | (h & _LOW) for h in (pairs, trigrams(toks, pairs)))]


def _edges(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """Where each part's keys begin, of sorted ones."""
    return np.searchsorted(keys >> np.uint64(40) if kind else part_of(keys, parts), np.arange(parts + 1))


_REQUESTS = "part int, chunk long, " + ", ".join(f"n{k} int, keys{k} binary, counts{k} binary" for k in range(3))


def _request(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1)
                sizes = r.column("sizes").flatten().to_numpy()
                _, at, keys = _ngrams(sizes, r.column("size")[0].as_py(), r.column("text")[0].as_py(), parts)
                learnt = np.repeat(r.column("held_out").flatten().fill_null(True).to_numpy(zero_copy_only=False) == 0, np.diff(at))
                asked = []
                for kind, own in enumerate(keys):
                    different = np.unique(own)
                    seen, times = np.unique(own[learnt], return_counts=True)
                    counts = np.zeros(len(different), np.int64)
                    counts[np.searchsorted(different, seen)] = times
                    asked.append((different, counts, _edges(different, kind, parts)))
                del keys, learnt
                rows = []
                for p in range(parts):
                    fields = []
                    for kind, (different, counts, edges) in enumerate(asked):
                        a, b = edges[p], edges[p + 1]
                        own = different[a:b] & _LOW if kind else different[a:b]
                        fields += [b - a, _pressed(np.diff(own, prepend=np.uint64(0))), _pressed(counts[a:b])]
                    if any(fields[::3]):
                        rows.append((p, r.column("chunk")[0].as_py(), *fields))
                kinds = [pa.int32(), pa.int64()] + [pa.int32(), pa.binary(), pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _REQUESTS.split(", ")])

    return run


_ANSWERS = "chunk long, part int, n0 int, n1 int, n2 int, levels0 binary, levels1 binary, levels2 binary, counts binary, total long, different long"


def _answer(parts: int, bits: int):
    """Sorted by part: counts added up, the part's slices of the filter built and probed, a row for each request."""

    def answered(held: list[dict]) -> pa.RecordBatch:
        levels, counts, total, different = [], [], 0, 0
        for kind in range(3):
            sizes = [r[f"n{kind}"] for r in held]
            asked = np.concatenate([np.cumsum(_opened(r[f"keys{kind}"], n), dtype=np.uint64) for r, n in zip(held, sizes, strict=True)])
            times = np.concatenate([_opened(r[f"counts{kind}"], n) for r, n in zip(held, sizes, strict=True)])
            keys, back = np.unique(asked, return_inverse=True)
            c = np.bincount(back, times, minlength=len(keys)).astype(np.int64)
            del asked, times
            if kind == 0:
                total, different = int(c.sum()), int((c > 0).sum())
            part = _slice(keys, c, kind, bits // parts)
            own = np.zeros(len(keys), np.uint8)
            for k in range(0, len(keys), _STEP):
                own[k : k + _STEP] = part.levels(keys[k : k + _STEP], kind)
            ends = np.cumsum(sizes)
            levels.append([_pressed(own[back[b - n : b]]) for b, n in zip(ends, sizes, strict=True)])
            if kind == 0:
                counts = [_pressed(c[back[b - n : b]]) for b, n in zip(ends, sizes, strict=True)]
        once = lambda x: pa.array([x] + [0] * (len(held) - 1), pa.int64())
        asked = [pa.array([r[f"n{k}"] for r in held], pa.int32()) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in held], pa.int64()), pa.array([r["part"] for r in held], pa.int32()), *asked, *(pa.array(x, pa.binary()) for x in (*levels, counts)), once(total), once(different)], names=[x.split()[0] for x in _ANSWERS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["part"] != r["part"]:
                    yield answered(held)
                    held = []
                held.append(r)
        if held:
            yield answered(held)

    return run


def positions(low: np.ndarray, part: np.ndarray, level: int | np.ndarray, probe: int, width: int) -> np.ndarray:
    """Bit of a key in the filter."""
    return part * width + (common.mix(low * np.uint64(0x2545F4914F6CDD1D) + np.uint64(probe * 977) + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(width)).astype(np.int64)


def _kind_salt(kind: int) -> np.uint64:
    return np.uint64(kind << 41)


def width_for(keys: int, parts: int, bits: int = BITS) -> int:
    """Bits of a part's slice: the filter has bits at least, and BITS_A_KEY for each key, however many there are."""
    return max(8, -(-max(bits, BITS_A_KEY * keys) // parts // 8) * 8)


class Model:
    """A filter of parts slices of width bits each, with the totals; frequent: tokens with their exact counts."""

    def __init__(self, bits: bytes, parts: int, width: int, total: int, different: int, frequent: np.ndarray, counts: np.ndarray, weights: tuple = WEIGHTS):
        self.bits, self.parts, self.width, self.weights = bits, parts, width, weights
        self.total, self.different = total, different
        order = np.argsort(frequent)
        self.frequent, self.counts = frequent[order], counts[order]

    def levels(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        """Level of each n-gram: how many of its keys, from the first, are present."""
        bits = np.frombuffer(self.bits, np.uint8)
        part, low = part_of(hashes, self.parts), (hashes & _LOW) + _kind_salt(kind)
        out, alive, level = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 1
        while len(alive):
            for probe in range(PROBES):
                at = positions(low[alive], part[alive], level, probe, self.width)
                alive = alive[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            out[alive] = level
            level += 1
        return out


def _slice(keys: np.ndarray, counts: np.ndarray, kind: int, least: int) -> Model:
    """A part's slice of the filter for one order, of least bits or more."""
    kept = counts >= LEAST
    low, levels = (keys[kept] & _LOW) + _kind_salt(kind), level_of(counts[kept])
    width = width_for(int(levels.sum()), 1, least)
    bits = np.zeros(width, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = low[levels >= level]
        for k in range(0, len(own), _STEP):
            for probe in range(PROBES):
                bits[positions(own[k : k + _STEP], np.int64(0), level, probe, width)] = True
    return Model(np.packbits(bits).tobytes(), 1, width, 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64))


def log10(toks: np.ndarray, levels: list[np.ndarray], end: int, total: int, different: int, weights: tuple) -> np.ndarray:
    """log10 probability of each token after those before it; levels: of its n-grams by order; end: that of the end token."""
    single, pairs, triples = (count_at(x) for x in levels)
    single = np.maximum(single, 0.5)  # never seen
    triples[pairs == 0] = 0  # an n-gram is never seen more often than its part
    end = count_at(np.array([end]))
    before = np.r_[end, single[:-1]][: len(toks)]
    first = np.r_[True, toks[:-1] == _END][: len(toks)]
    two_before = np.where(first, end, np.r_[0.0, pairs[:-1]][: len(toks)])
    alone = (single + 0.5) / (total + 0.5 * (different + 1))
    share = lambda n, of: np.minimum(np.maximum(n - DISCOUNT, 0) / np.maximum(of, 1), 1)
    return np.log10(weights[0] * alone + weights[1] * share(pairs, before) + weights[2] * share(triples, two_before))


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(parts: int, total: int, different: int, weights: tuple):
    """Sorted by chunk, its answers by part before its texts: scores and sums of log10(count + 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            for row, kind in enumerate(kinds):
                r = batch.slice(row, 1)
                if kind == 0:
                    held.append(r.select(["n0", "n1", "n2", "levels0", "levels1", "levels2", "counts"]).to_pylist()[0])
                    continue
                toks, at, keys = _ngrams(r.column("sizes").flatten().to_numpy(), r.column("size")[0].as_py(), r.column("text")[0].as_py(), parts)
                levels, exact, end = [], None, 0
                for kind_, own in enumerate(keys):
                    different_, back = np.unique(own, return_inverse=True)
                    told = np.concatenate([_opened(x[f"levels{kind_}"], x[f"n{kind_}"]) for x in held]).astype(np.int64)
                    levels.append(told[back])
                    if kind_ == 0:
                        exact = np.concatenate([_opened(x["counts"], x["n0"]) for x in held]).astype(np.int64)[back]
                        end = told[np.searchsorted(different_, _END)]
                held = []
                score = np.add.reduceat(log10(toks, levels, end, total, different, weights), at[:-1])
                base, known = np.add.reduceat(np.log10(exact + 0.5), at[:-1]), np.add.reduceat((exact > 0).astype(np.int64), at[:-1])
                yield pa.RecordBatch.from_arrays([r.column("doc_ids").flatten(), r.column("held_out").flatten(), pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(score)], names=[x.split()[0] for x in _RESULT.split(", ")])

    return run


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, frequent: int = FREQUENT, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a boolean column; its rows do not train.
    frequent has no effect any more: all exact counts are looked up at their part."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    parts, tasks = common.parts_for(docs, 16 << 20), common.tasks_for(docs, 16 << 20)
    chunks = common.checkpoint(texts.coalesce(tasks).mapInArrow(common.frugal(_chunk), _CHUNKS))
    asked = chunks.drop("doc_ids").mapInArrow(common.frugal(_request(parts)), _REQUESTS)
    answers = common.checkpoint(asked.repartition(parts, "part").sortWithinPartitions("part").coalesce(tasks).mapInArrow(common.frugal(_answer(parts, bits)), _ANSWERS))
    del asked
    common.release(docs.sparkSession)
    sums = answers.agg(F.sum("total").alias("total"), F.sum("different").alias("different")).first()
    total, different = sums.total or 0, sums.different or 0
    given = answers.drop("total", "different").withColumn("kind", F.lit(0))
    for c in chunks.columns[1:]:
        given = given.withColumn(c, F.lit(None).cast(chunks.schema[c].dataType))
    both = given.unionByName(chunks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    scored = common.frugal(_score(parts, total, different, weights))
    complete = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "part").coalesce(tasks).mapInArrow(scored, _RESULT)
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + 0.5 * (different + 1)))
    return complete.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def brute_force_base(rows: list[tuple[int, str | None, bool]]) -> dict[int, tuple]:
    """doc_id: (held_out, n_tokens, n_known, N, base score), by plain dictionaries."""
    fold = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())
    split = [(i, [*(t or "").encode().translate(fold).split(), None], h) for i, t, h in rows]
    counts: dict = {}
    for _, ws, h in split:
        for w in ws if not h else ():
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    down = n + 0.5 * (len(counts) + 1)
    return {i: (h, len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts.get(w, 0) + 0.5) / down) for w in ws)) for i, ws, h in split}


def brute_force_score(rows: list[tuple[int, str | None, bool]], weights: tuple = WEIGHTS) -> dict[int, float]:
    """doc_id: log10 probability of the text by the same model with exact counts and no filter; for tests."""
    fold = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())
    split = [(i, [None, None, *(t or "").encode().translate(fold).split(), None], h) for i, t, h in rows]
    counts: list[dict] = [{}, {}, {}]
    for _, ws, h in split:
        for k in range(2, len(ws)) if not h else ():
            for n in range(3):
                g = tuple(ws[k - n : k + 1])
                counts[n][g] = counts[n].get(g, 0) + 1
    total, different = sum(counts[0].values()), len(counts[0])
    seen = lambda g: c if (c := counts[len(g) - 1].get(g, 0)) >= LEAST else 0

    def p(ws, k):
        two = seen((None,)) if ws[k - 1] is None else seen((ws[k - 2], ws[k - 1]))
        out = weights[0] * (max(seen((ws[k],)), 0.5) + 0.5) / (total + 0.5 * (different + 1))
        out += weights[1] * min(max(seen((ws[k - 1], ws[k])) - DISCOUNT, 0) / max(seen((ws[k - 1],)), 1), 1)
        return out + weights[2] * min(max(seen(tuple(ws[k - 2 : k + 1])) - DISCOUNT, 0) / max(two, 1), 1)

    return {i: sum(math.log10(p(ws, k)) for k in range(2, len(ws))) for i, ws, _ in split}
