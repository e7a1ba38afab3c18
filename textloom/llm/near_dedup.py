"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. A document is its set of distinct 5-word shingles (A-Z lower-cased). Equal sets collapse into one node at once, so
   copies cost nothing further.
2. One hash per shingle; its top byte picks one of 256 bins, each bin keeps its minimum. An empty bin borrows the bin that
   a fixed sequence of hashes of (bin, attempt) finds first (optimal densification). Bands of bins make bucket keys, as wide as
   a pair at the threshold allows to miss every bucket with probability 4e-5 at most: 32 bands of 8 at 0.85, 42 of 6 at 0.80.
3. Within a bucket each node is paired with the bucket's centre only (a star), so candidates grow linearly. Stars are
   confirmed on the full sets and closed into components.
4. What stars cannot see: two nodes of a bucket that the centre leaves apart. Only buckets that still hold more than one
   component are looked at again, split by a hash of the node into blocks of about BLOCK nodes; each pair of blocks is a key of its own, so a bucket
   of any size spreads over many tasks. There, nodes of different components are compared by size and by a 1024-bit parity sketch
   inside the join, and what passes is confirmed on the full sets. Nodes already together need no comparison. Each shingle flips one
   bit of the sketch, so two sketches never differ in more bits than the sets differ in shingles: the filter loses no pair.

The threshold is a parameter in percent. Sets of fewer than 6 shingles can only reach 0.85 (4 shingles: 0.80) by being equal, so they skip steps 2 to 4. Null and empty texts have no
shingles and link with nothing. A null doc_id never becomes a component's id. Repeated rows share one set and one component, and each is returned. Very long
texts are taken whole. Empty tables give no rows. Extra columns are ignored, whatever their names. Shingles and sets are held as 64-bit hashes.

Shuffles of buckets, texts and sets follow the input's size. Copies of one text never meet in a join of pairs; where rows return to their node, the node's answer is
checkpointed first, so that adaptive execution can split a node that a third of all rows hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, BINS = 5, 256
#: 100 * intersection >= PERCENT * union, unless another percent is given.
PERCENT = 85
#: Probability that a pair at the threshold shares no bucket, at most.
MISSED = 4e-5
SKETCH_BITS = 1024
#: Nodes of an open bucket in a block.
BLOCK = 512
#: Edges that a task writes when components are formed; so many at most are closed by one task.
EDGES = 250_000


def smallest(percent: int) -> int:
    """Shingles from which on different sets can reach percent: n of n + 1."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 31


def bands_of(percent: int) -> tuple[int, int]:
    """Bands and bins a band: the widest bands that miss at most MISSED of the pairs at percent."""
    rows = next((r for r in range(BINS, 1, -1) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED), 1)
    return BINS // rows, rows


def _attempts(tries: int = 4096) -> np.ndarray:
    """[attempt, bin]: the bin that an empty bin looks at."""
    n = np.arange(tries * BINS, dtype=np.uint64) + np.uint64(0x51ED270B)
    return (common.mix(common.mix(n) + np.uint64(7)) % np.uint64(BINS)).astype(np.int64).reshape(tries, BINS)


_LOOK: np.ndarray | None = None


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and each document's offsets into them."""
    data = common.fold(data)
    starts, ends, firsts = common.word_spans(data, offsets)
    words = common.word_hashes(data, starts, ends)
    at, docs = common.starts_of(firsts, size)
    hashes = common.ngram_hashes(words, size)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = []
        for d in short:
            h = np.uint64(counts[d])
            for w in words[firsts[d] : firsts[d + 1]]:
                h = common.mix(np.array([h]) * np.uint64(3) + w)[0]
            own.append(h)
        hashes, docs = np.append(hashes, np.array(own, np.uint64)), np.append(docs, short)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])]
        hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[document, bin] minima with every bin filled; documents must not be empty."""
    global _LOOK
    if _LOOK is None:
        _LOOK = _attempts()
    n = len(offsets) - 1
    docs = np.repeat(np.arange(n), np.diff(offsets))
    cell = docs * BINS + (hashes >> np.uint64(56)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # sorted, so a bin's first is its minimum
    out, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    out[cell[heads]], filled[cell[heads]] = hashes[heads], True
    empty = np.flatnonzero(~filled)
    for looked in _LOOK:
        if not len(empty):
            break
        row, own = np.divmod(empty, BINS)
        source = row * BINS + looked[own]
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    if len(empty):  # beyond the table: the next filled bin in a circle
        for e in empty:
            row, own = divmod(int(e), BINS)
            bins = np.flatnonzero(filled[row * BINS : (row + 1) * BINS])
            out[e] = out[row * BINS + bins[np.searchsorted(bins, own) % len(bins)]]
    return out.reshape(n, BINS)


_SIGNED = "doc_id long, row_key long, n long, node long, bands array<long>, sketch array<long>"


def _signed(percent: int):
    least, (bands_made, rows) = smallest(percent), bands_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in common.slices(batch.column(2)):
                hashes, at = shingle_sets(data, offsets)
                n = np.diff(at)
                sums = np.add.reduceat(np.append(common.mix(hashes ^ np.uint64(0xA5A5)), np.uint64(0)), at[:-1]) if len(n) else np.zeros(0, np.uint64)
                node = common.mix(sums + n.astype(np.uint64)).view(np.int64)
                large = np.flatnonzero(n >= least)
                bands, sketch = np.full(hi - lo, None, object), np.full(hi - lo, None, object)
                if len(large):
                    keep = np.repeat(n >= least, n)
                    sig = signatures(hashes[keep], np.r_[0, np.cumsum(n[large])])
                    key = np.zeros((len(large), bands_made), np.uint64)
                    cells = sig[:, : bands_made * rows].reshape(-1, bands_made, rows)
                    for r in range(rows):
                        key = common.mix(key * np.uint64(5) + cells[:, :, r])
                    key = common.mix(key + np.arange(bands_made, dtype=np.uint64))
                    flips = np.repeat(np.arange(len(large)), n[large]) * SKETCH_BITS + (common.mix(hashes[keep] + np.uint64(0x9D)) % np.uint64(SKETCH_BITS)).astype(np.int64)
                    odd = np.bincount(flips, minlength=len(large) * SKETCH_BITS).reshape(len(large), SKETCH_BITS) & 1
                    bits = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                    for d, k, s in zip(large, key.view(np.int64), bits, strict=True):
                        bands[d], sketch[d] = k, s
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(node), pa.array(list(bands), pa.list_(pa.int64())), pa.array(list(sketch), pa.list_(pa.int64()))], names=["doc_id", "row_key", "n", "node", "bands", "sketch"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in common.slices(batch.column(1)):
            hashes, at = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["node", "hashes"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (a, b): the greater root of an edge goes under the lesser one until no edge has two."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while (open_ := root[x] != root[y]).any():
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((top := root[root]) != root).any():
            root = top
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60, tasks: int | None = None, at_once: int = EDGES) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's least node. Up to at_once different edges are closed by one task, so that a small table
    costs the driver few jobs and plans; of more, large-star and small-star by turns. tasks: how many write the edges at most."""

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
        if small:
            both = both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        else:
            both = both.union(pairs.select(F.col("b"), F.col("a")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        moved = both.join(least, "x")
        if small:
            linked = moved.select(F.col("y").alias("a"), F.col("m").alias("b")).union(least.select(F.col("x").alias("a"), F.col("m").alias("b")))
        else:
            linked = moved.filter("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).union(least.filter("m < x").select(F.col("x").alias("a"), F.col("m").alias("b")))
        return linked.filter("a <> b").distinct()

    def digest(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = common.checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tasks)
    before = digest(now)
    if before[0] <= at_once:
        return common.checkpoint(now.coalesce(1).mapInArrow(common.frugal(_closed), "node long, root long"))
    for _ in range(rounds):
        now = common.checkpoint(star(star(now, False), True), 1 + before[0] // EDGES)
        after = digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those similar enough on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _may_match(n, m, percent: int):
    """Sizes alone allow the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def row_key(id_col: str, text_col: str):
    """A hash of the id and the text: tells rows of one id apart."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row_key. Sets of shingles link from a similarity of percent hundredths."""
    parts, tasks, few = common.parts_for(docs), common.tasks_for(docs, 16 << 20), common.tasks_for(docs, 64 << 20)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    signed = common.checkpoint(texts.coalesce(few).mapInArrow(common.frugal(_signed(percent)), _SIGNED))
    nodes = common.checkpoint(signed.filter(f"n >= {smallest(percent)}").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), few)
    buckets = nodes.select("node", F.explode("bands").alias("bucket")).repartition(parts, "bucket")
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("held")).filter("held > 1").select("bucket", "centre")
    members = common.checkpoint(buckets.join(centres, "bucket"), few)
    about = nodes.select("node", "n", "sketch")

    def seen(df: DataFrame, side: str) -> DataFrame:
        return df.join(about.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)

    # of sets that link, at most (100 - percent) / (100 + percent) of both sizes together differs
    apart = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    may_link = _may_match(F.col("na"), F.col("nb"), percent) & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))
    stars = members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    stars = common.checkpoint(seen(seen(stars, "a"), "b").filter(may_link).select("a", "b"), few)
    held = members.select("node").distinct()
    wanted = texts.repartition(parts, "row_key").join(nodes.join(held, "node", "left_semi").select("node", "row_key"), "row_key")
    sets = wanted.select("node", "text").mapInArrow(common.frugal(_sets), "node long, hashes array<long>")
    sets = common.checkpoint(sets.repartition(parts, "node").groupBy("node").agg(F.any_value("hashes").alias("hashes")), tasks)  # repeated rows share their key
    links = common.checkpoint(_confirmed(stars, sets, percent), tasks)
    common.release(docs.sparkSession)
    roots = components(links, tasks=few)
    told = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = told.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("lo <> hi").select("bucket", "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    open_ = common.checkpoint(told.join(mixed, "bucket").join(about, "node").withColumn("own", own), few)
    at = lambda lo, hi: F.explode(F.sequence(lo, hi))
    left = open_.select("bucket", F.col("own").alias("lo"), at(F.col("own"), F.col("blocks") - 1).alias("hi"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = open_.select(F.col("bucket").alias("bucket_"), at(F.lit(0), F.col("own")).alias("lo_"), F.col("own").alias("hi_"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    met = (F.col("bucket") == F.col("bucket_")) & (F.col("lo") == F.col("lo_")) & (F.col("hi") == F.col("hi_"))
    close = ((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b"))) & (F.col("ra") != F.col("rb")) & may_link
    pairs = left.join(right, met & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = common.checkpoint(_confirmed(pairs, sets, percent), tasks)
    roots = components(links.union(more), tasks=few)
    named = roots.join(nodes.select("node", "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    by_node = named.join(least, "root").select("node", "component")
    copies = signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    final = common.checkpoint(copies.join(by_node, "node", "left").select("node", F.coalesce("component", "least").alias("component")), few)
    out = signed.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(final, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "row_key")


def brute_force(rows: list[tuple], percent: int = PERCENT) -> list[tuple]:
    """The contract's result for a small list of (doc_id, text), by comparing all pairs."""
    fold = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(fold).split()
        sets.append({tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(sets[k]), i if not sets[k] else least.get(top(k)), i is not None and (not sets[k] or i == least[top(k)])) for k, (i, _) in enumerate(rows)]
