"""Best-fit packing of documents into token sequences by bin completion.

Pieces are dealt evenly into blocks of about BLOCK. A block starts from best-fit decreasing as its incumbent; if that misses the lower bound (``lower_bound``), branch
and bound looks for fewer sequences. A node completes the sequence of the largest unplaced piece. Its branches are the undominated fillings of the room left, those
without waste by two and three pieces first, then the reachable sums, largest first, with the largest pieces that make each: a piece that fits alone dominates every filling of no larger sum, and a filling is dominated by one whose
pieces can take its own in groups. A branch whose waste exceeds what the wanted number of sequences allows is pruned. The lower bound is tried first, then
numbers halfway to the incumbent.

Where one sequence too many is left, the sequences with waste and some full ones are completed anew on their own.

Bin packing has no fast exact way, so the search ends after a number of steps (STEPS and STEPS_EACH for each sequence of the incumbent, for each number tried); the incumbent
is always complete, so no piece is ever left out. Blocks cost at most part of one sequence each against packing everything together.

Null and empty texts have the end id alone, so one piece of length 1. Very long texts are encoded whole and cut into pieces. Repeated rows are packed as often as they
come, a null doc_id is kept as null. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY, END = 4096, 1
#: Pieces in a block; steps of a search, and more for each sequence.
BLOCK, STEPS, STEPS_EACH = 16_384, 50_000, 100
#: Full sequences that join those with waste when these are completed anew, one number after the other.
SOME = (4, 32, 256)
#: Sequences above the lower bound up to which that is tried.
FEW = 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def _pieces(path: str, capacity: int):
    tail = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, texts in bpe.text_groups(batch.column(1)):
                rows = []
                for doc, own in zip(ids[lo:], coder.encode_all(texts)):
                    own += tail
                    for k in range(0, len(own), 4 * capacity):
                        part = own[k : k + 4 * capacity]
                        rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing. lengths: descending. Sequences as lists of lengths."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask, out = 0, []
    for n in lengths:
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            own = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, own = capacity, []
            out.append(own)
        own.append(n)
        room[r - n].append(own)
        mask |= 1 << (r - n)
    return out


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences needed at least: for each limit, pieces that must stand alone or nearly so, and what the room beside them can't take."""
    counts = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    limits = np.arange(capacity // 2 + 1)
    above = capacity - limits  # longer ones stand alone
    alone = number[-1] - number[above]
    large = number[above] - number[capacity // 2]
    beside = large * capacity - (total[above] - total[capacity // 2])
    small = total[capacity // 2] - np.where(limits > 0, total[limits - 1], 0)
    return int((alone + large + np.maximum(0, -((beside - small) // capacity))).max(initial=0))


class Stock:
    """Pieces not placed yet, by length; a bit for each length, both ways round."""

    def __init__(self, lengths: list[int], capacity: int, steps: int):
        self.capacity, self.steps, self.left = capacity, steps, 0
        self.counts, self.mask, self.mirror = [0] * (capacity + 1), 0, 0
        for n in lengths:
            self.put(n)

    def put(self, n: int) -> None:
        if not self.counts[n]:
            self.mask |= 1 << n
            self.mirror |= 1 << (self.capacity - n)
        self.counts[n] += 1
        self.left += 1

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        self.left -= 1
        if not self.counts[n]:
            self.mask &= ~(1 << n)
            self.mirror &= ~(1 << (self.capacity - n))

    def pairs(self, total: int, largest: int, used: int) -> Iterator[tuple[int, int]]:
        """Two pieces of a sum, the larger at most largest, of which used are taken already."""
        hit = self.mask & (self.mirror >> (self.capacity - total)) & ((2 << min(largest, total - 1)) - 1)
        while hit:
            self.steps -= 1
            n = hit.bit_length() - 1
            m = total - n
            if n < m:
                return
            hit ^= 1 << n
            if self.counts[n] >= 1 + (n == m) + (used if n == largest else 0) and (m != largest or n == m or self.counts[m] > used):
                yield n, m

    def sums(self, total: int, pieces: int, largest: int, used: int = 0, until: int = 0) -> Iterator[tuple[int, ...]]:
        """So many pieces of a sum, descending, none above largest."""
        if pieces == 2:
            yield from self.pairs(total, largest, used)
            return
        fit = self.mask & ((2 << min(largest, total - pieces + 1)) - 1)
        while fit and self.steps > until:
            self.steps -= 1
            n = fit.bit_length() - 1
            if n * pieces < total:
                return
            fit ^= 1 << n
            own = used + 1 if n == largest else 1
            if self.counts[n] >= own:
                for rest in self.sums(total - n, pieces - 1, n, own):
                    yield (n, *rest)

    def fillings(self, room: int, waste: int) -> Iterator[tuple[int, ...]]:
        """Undominated fillings of room that waste no more than waste: without waste by two and by three pieces, then the largest reachable sums, one filling each."""
        fit = self.mask & ((2 << room) - 1)
        if not fit:
            if room <= waste:
                yield ()
            return
        alone = fit.bit_length() - 1
        if self.steps <= 0:
            own = self.greedy(room)
            if room - sum(own) <= waste:
                yield own
            return
        told: list[tuple[int, ...]] = []
        if alone < room:
            until = self.steps - 200
            for own in chain(self.sums(room, 2, alone), self.sums(room, 3, alone, until=until), self.reachable(room, max(alone, room - waste - 1))):
                self.steps -= 1 + len(told)
                if not any(dominates(b, own) for b in told):
                    told.append(own)
                    yield own
                if self.steps <= 0:
                    break
        if room - alone <= waste:
            yield (alone,)

    def reachable(self, room: int, above: int) -> Iterator[tuple[int, ...]]:
        """A filling for each sum above ``above`` and up to room that the pieces left can make, largest sum first, of pieces as large as can be."""
        full, bits, past = (2 << room) - 1, 1, []
        fit = self.mask & full
        while fit and not bits >> room:
            n = fit.bit_length() - 1
            fit ^= 1 << n
            past.append((n, bits))
            for _ in range(min(self.counts[n], room // n)):
                more = (bits | bits << n) & full
                if more == bits:
                    break
                bits = more
        self.steps -= 20 + len(past) // 4
        bits >>= above + 1
        while bits:
            total = above + bits.bit_length()
            bits ^= 1 << (total - above - 1)
            own, left = [], total
            for n, before in reversed(past):
                while not before >> left & 1:
                    own.append(n)
                    left -= n
            yield tuple(reversed(own))

    def greedy(self, room: int) -> tuple[int, ...]:
        """Always the largest piece that fits."""
        own: list[int] = []
        while fit := self.mask & ((2 << room) - 1):
            n = fit.bit_length() - 1
            self.take(n)
            own.append(n)
            room -= n
        for n in own:
            self.put(n)
        return tuple(own)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """The pieces of b, in groups, fit into pieces of a. Both descending."""
    room = list(a)
    if len(b) < len(a):
        return False

    def place(k: int) -> bool:
        if k == len(b):
            return True
        for r in {x for x in room if x >= b[k]}:
            j = room.index(r)
            room[j] -= b[k]
            if place(k + 1):
                return True
            room[j] += b[k]
        return False

    return place(0)


def bin_completion(lengths: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Sequences (lists of lengths) holding all lengths; as few as the search finds."""
    best = best_fit(sorted(lengths, reverse=True), capacity)
    least = low = lower_bound(lengths, capacity)
    while low < len(best):
        found = complete(lengths, capacity, low, steps + STEPS_EACH * len(best))
        if found is None:
            low = (low + len(best) + 1) // 2
        else:
            best = found
    # what is left is often one sequence: the sequences with waste and some of the finest pieces are completed anew
    for some in SOME:
        while least < len(best) <= least + FEW:
            best.sort(key=lambda own: (sum(own) == capacity, -len(own)))
            wasteful = sum(sum(own) < capacity for own in best)
            part, rest = best[: wasteful + some], best[wasteful + some :]
            pieces = [n for own in part for n in own]
            found = complete(pieces, capacity, len(part) - 1, steps) if lower_bound(pieces, capacity) < len(part) else None
            if found is None:
                break
            best = found + rest
    return best


def complete(lengths: list[int], capacity: int, sequences: int, steps: int) -> list[list[int]] | None:
    """So many sequences at most, if the search finds them within its steps."""
    slack = sequences * capacity - sum(lengths)
    stock, wasted = Stock(lengths, capacity, steps), 0
    path: list[tuple[int, Iterator, tuple[int, ...]]] = []  # largest piece, fillings still to try, filling taken
    while stock.left:
        stock.steps -= 1
        top = stock.mask.bit_length() - 1
        stock.take(top)
        options = stock.fillings(capacity - top, slack - wasted)
        while (own := next(options, None)) is None:
            stock.put(top)
            if not path or stock.steps <= 0:
                return None
            top, options, last = path.pop()
            for n in last:
                stock.put(n)
            wasted -= capacity - top - sum(last)
        for n in own:
            stock.take(n)
        wasted += capacity - top - sum(own)
        path.append((top, options, own))
    return [[top, *own] for top, _, own in path]


def _pack_blocks(capacity: int, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        blocks = table["block"].to_numpy()
        for block in np.unique(blocks):
            own = table.filter(pa.array(blocks == block))
            lengths = own["length"].to_numpy()
            by: dict[int, list[int]] = {}
            for k, n in enumerate(lengths.tolist()):
                by.setdefault(n, []).append(k)
            sequence, offset = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for s, held in enumerate(bin_completion(lengths.tolist(), capacity, steps)):
                at = 0
                for n in held:
                    k = by[n].pop()
                    sequence[k], offset[k] = (int(block) << 32) + s, at
                    at += n
            yield from own.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).combine_chunks().to_batches(8192)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, block: int = BLOCK, steps: int = STEPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or bpe.default_path()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = common.checkpoint(texts.coalesce(common.tasks_for(docs, 16 << 20)).mapInArrow(common.frugal(_pieces(path, capacity), tables=True), _PIECES))
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("block", F.monotonically_increasing_id() % blocks) if blocks > 1 else pieces.withColumn("block", F.lit(0).cast("long"))
    return dealt.repartition(blocks, "block").mapInArrow(_pack_blocks(capacity, steps), _PACKED)
