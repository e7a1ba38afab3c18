"""Quality classifier: random-indexing word vectors pooled per document, then a calibrated two-layer network.

1. Tokens are runs of letters, digits or other marks, A-Z lower-cased. Each has a word: its hash, 64 bits wide, so words are never merged. Shapes that lower-casing loses
   (a run of capitals, the token before again, a number and its length) are words too, next to the token's own.
2. Random indexing over all documents: every word has a sparse ternary index vector, drawn from its hash as the seed, so no table of them is needed and the vocabulary is
   open. A word's context vector is the sum of the index vectors of the tokens up to two places away. Context vectors are held for the FREQUENT
   (16,384) words with the most tokens in all documents, which bounds what is broadcast; map tasks sum small matrices, which are added up by range of words. A word's vector is its
   context vector at unit length, if it has one, plus its index vector.
3. A document is the mean of its tokens' vectors.
4. A two-layer numpy network learns on the driver from at most SAMPLE labelled documents outside the held-out fold (an even
   sample by a hash of the id); one fifth of them is kept from training to fit the temperature that calibrates the probabilities.

Scores use the text alone. Null and empty texts are the zero vector; very long texts are pooled whole. Where labels hold fewer than two classes every score is
the share of label 1 (0.5 without labels). Labels other than 0 and 1 are ignored; of several labels of one id the largest counts. A null doc_id is scored and never
trains. Repeated rows are scored alike; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FREQUENT, DIMENSIONS, NONZERO, REACH = 16_384, 64, 4, 2
#: Most labelled documents the network learns from; hidden units; threshold of a prediction.
SAMPLE, HIDDEN, THRESHOLD = 20_000, 32, 0.7
_RANGE = 512  # words in a row of partial sums
_CHUNK = 1_000_000  # tokens counted at a time


def index_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of words' index vectors, from their hashes."""
    seed = common.mix(words ^ np.uint64(0x1D8E4E27C47D124F))
    shift = np.arange(NONZERO, dtype=np.uint64)
    places = ((seed[:, None] >> (shift * np.uint64(6))) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    return places, 1.0 - 2.0 * ((seed[:, None] >> (shift + np.uint64(40))) & np.uint64(1)).astype(np.float64)


_CLASS = np.full(256, 3, np.uint8)
_CLASS[common._SPACE] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
#: Words of shapes: capitals, the same again, numbers by length up to 12.
_SHAPES = common.mix(np.arange(1, 16, dtype=np.uint64) + np.uint64(0x5A9E))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all documents in order, and each document's offsets."""
    kind = _CLASS[data]
    begins = kind > 0
    begins[1:] &= kind[1:] != kind[:-1]
    at = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[at] = kind[at] > 0
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    solid = np.add.reduceat((kind > 0).astype(np.int64), starts)  # a run's length: only white space follows within its span
    hashes = common.word_hashes(common.fold(data), starts, starts + solid)
    capital = np.add.reduceat(((data >= 0x41) & (data <= 0x5A)).astype(np.int64), starts)
    shape = np.zeros(len(starts), np.int64)
    digits, letters = kind[starts] == 2, kind[starts] == 1
    shape[digits] = 2 + np.minimum(solid[digits], 12)
    shape[letters & (solid > 1) & (capital * 2 > solid)] = 1
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & letters[1:]]
    same[firsts[:-1][firsts[:-1] < len(starts)]] = False
    shape[same] = 2
    extra = np.r_[0, np.cumsum(shape > 0)]
    out = np.empty(len(starts) + extra[-1], np.uint64)
    place = np.arange(len(starts)) + extra[:-1]
    out[place] = hashes
    shaped = np.flatnonzero(shape)
    out[place[shaped] + 1] = _SHAPES[shape[shaped] - 1]
    return out, firsts + extra[firsts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0

    def flush() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    for batch in batches:
        for _, _, data, offsets in common.slices(batch.column(0)):
            held.append(words_of(data, offsets)[0])
            total += len(held[-1])
            if total >= _CHUNK:
                yield flush()
                total = 0
    if held:
        yield flush()


class Vocabulary:
    """Frequent words, sorted by hash."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Each word's place, or the number of words where it isn't among them."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, len(self.words))


def _context(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = held.value
        n = len(vocabulary.words) + 1
        total = np.zeros(n * DIMENSIONS)
        for batch in batches:
            for _, _, data, offsets in common.slices(batch.column(0)):
                words, firsts = words_of(data, offsets)
                own = vocabulary.places(words)
                places, signs = index_vectors(words)
                doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
                for reach in range(1, REACH + 1):
                    near = np.flatnonzero(doc[reach:] == doc[:-reach])
                    for x, y in ((near, near + reach), (near + reach, near)):
                        known = own[x] < n - 1
                        x, y = x[known], y[known]
                        total += np.bincount((own[x][:, None] * DIMENSIONS + places[y]).ravel(), signs[y].ravel(), minlength=len(total))
        rows = [total[k : k + _RANGE * DIMENSIONS] for k in range(0, (n - 1) * DIMENSIONS, _RANGE * DIMENSIONS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], names=["range", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[k] = held.get(k, 0) + np.frombuffer(blob, "<f4").astype(float)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in held.values()], pa.binary())], names=["range", "sums"])


def word_vectors(texts: DataFrame, frequent: int = FREQUENT) -> tuple[Vocabulary, np.ndarray]:
    """The frequent words of the only column of texts, and [word, dimension] of their context vectors at unit length; the last row is zero. A bounded size whatever the corpus."""
    counts = texts.mapInArrow(common.frugal(_count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.checkpoint(counts, common.tasks_for(texts, 16 << 20))
    # how many words have how many tokens tells from where on to look, so that no partition sends more than it must
    size = F.floor(4 * F.log2("n")).alias("size")
    least, held = 0, 0
    for r in sorted(counts.groupBy(size).agg(F.count("*").alias("words")).collect(), reverse=True):
        least, held = r["size"], held + r.words
        if held >= frequent:
            break
    words = counts.filter(size >= least).orderBy(F.desc("n"), "word").limit(frequent).collect()
    vocabulary = Vocabulary(np.array([r.word for r in words], np.int64).view(np.uint64))
    context = np.zeros((len(words) + 1) * DIMENSIONS)
    if words:
        held = texts.sparkSession.sparkContext.broadcast(vocabulary)
        parts = texts.mapInArrow(common.frugal(_context(held)), "range int, sums binary").repartition(-(-len(words) // _RANGE), "range").mapInArrow(_add, "range int, sums binary")
        for r in parts.collect():
            own = np.frombuffer(r["sums"], "<f8")
            context[r["range"] * _RANGE * DIMENSIONS :][: len(own)] += own
    context = context.reshape(-1, DIMENSIONS)
    return vocabulary, (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled_vectors(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, context: np.ndarray) -> np.ndarray:
    """[document, dimension]: means of the tokens' vectors."""
    words, firsts = words_of(data, offsets)
    n = np.diff(firsts)
    out = np.zeros((len(n), DIMENSIONS), np.float32)
    if len(words):
        full = np.flatnonzero(n)
        places, signs = index_vectors(words)
        doc = np.repeat(np.arange(len(n)), n)
        own = np.bincount((doc[:, None] * DIMENSIONS + places).ravel(), signs.ravel() / np.sqrt(NONZERO), minlength=len(n) * DIMENSIONS).reshape(-1, DIMENSIONS)
        out[full] = (np.add.reduceat(context[vocabulary.places(words)], firsts[full], axis=0) + own[full]) / n[full, None]
    return out


def _pool(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.slices(batch.column(1)):
                sums = pooled_vectors(data, offsets, *held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([s.tobytes() for s in sums], pa.binary())], names=["doc_id", "row_key", "features"])

    return run


class Network:
    """Two layers: hidden ReLU units, then one logit divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.share = float(y.mean()) if len(y) else 0.5
        self.constant = len(y) < 10 or self.share in (0.0, 1.0)
        self.temperature = 1.0
        if self.constant:
            return
        order = rng.permutation(len(y))
        kept, used = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        z, step = (x - self.mean) / self.scale, 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
                step += 1
                inner = z[at] @ self.w[0] + self.w[1]
                active = np.maximum(inner, 0)
                error = (1 / (1 + np.exp(-np.clip(active @ self.w[2] + self.w[3], -30, 30))) - y[at]) / len(at)
                back = error[:, None] * self.w[2] * (inner > 0)
                for k, g in enumerate((z[at].T @ back, back.sum(axis=0), active.T @ error, error.sum(keepdims=True))):
                    g = g + 1e-4 * self.w[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if len(kept):
            logits = self.logits(x[kept])
            grid = np.exp(np.linspace(-2.5, 2.5, 101))
            self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, -np.where(y[kept] > 0.5, 1, -1) * logits / t).mean()))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if self.constant:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _apply(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), DIMENSIONS).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held.value.score(x))], names=["doc_id", "row_key", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, row_key (hash of id and text), score. held_out: a column over doc_id; such rows do not train."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"))
    vectors = spark.sparkContext.broadcast(word_vectors(texts.select("text")))
    pooled = common.checkpoint(texts.coalesce(common.tasks_for(docs, 16 << 20)).mapInArrow(common.frugal(_pool(vectors)), "doc_id long, row_key long, features binary"))
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")).filter("doc_id is not null")
    known = known.filter(~held_out) if held_out is not None else known
    fine = 1_000_000
    share = min(fine, sample * fine // max(1, known.count()))
    taught = pooled.join(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(fine)) < share), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "features", "label").collect()
    taught.sort(key=lambda r: r.doc_id)
    x = np.frombuffer(b"".join(bytes(r.features) for r in taught), np.float32).reshape(len(taught), DIMENSIONS).astype(float)
    network = spark.sparkContext.broadcast(Network(x, np.array([float(r.label) for r in taught])))
    del taught, x
    common.give_back()
    return pooled.mapInArrow(_apply(network), "doc_id long, row_key long, score double")
