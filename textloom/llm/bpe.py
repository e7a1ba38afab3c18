"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts texts into chunks of about 512 bytes at places that depend on nearby bytes only, so equal
passages fall into equal chunks wherever they stand. A worker encodes each distinct chunk once and keeps it in a bounded
table shared by all its documents. A chunk's encoding is exact between its first and last ASCII white space; what lies
outside is kept as raw ends. Joins are repaired by encoding again the left end, any chunk without white space, and the right
end together, growing until white space is met on both sides. There the results agree exactly with encoding the whole text,
because this tokenizer's normaliser and splitter never join or compare characters across white space.

Words go through the tokenizers library itself: ordinary Latin words are lower-cased and split here and the library's own BPE
model encodes each distinct piece once; any other word (unusual letters, marks, special-token strings) is encoded by the
unchanged tokenizer.

Null and empty texts give no ids. Rows are independent; extra columns never reach the operator.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"
#: Entries a worker keeps of words, of word pieces and of chunks; a full table is emptied.
WORDS, PIECES, CHUNKS = 500_000, 500_000, 20_000
#: Rolling-hash cut: one place in so many, 16 bytes deep.
CHUNK_BYTES, DEPTH = 512, 16
_ODD = re.compile("[^!-~À-ÖØ-öø-ÿ\n]")
_SPLIT = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
_MARK = b"\xff" * 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    """Ids (little-endian u32 bytes) of texts and words, equal to the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ends = spec["model"].get("end_of_word_suffix")
        if self.full.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids must stay under 65,536")
        self.names = [b""] * self.full.get_vocab_size(with_added_tokens=True)
        for name, k in self.full.get_vocab(with_added_tokens=True).items():
            self.names[k] = name.encode()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.last = np.array([bool(ends) and n.endswith(ends.encode()) for n in self.names])
        spec |= {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.model = Tokenizer.from_str(json.dumps(spec))
        if resize := getattr(self.model.model, "_resize_cache", None):
            resize(0)  # a piece is encoded once here, so the model's own table never helps
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"\n": _MARK}

    def _learn_pieces(self, new: list[str]) -> None:
        (found,) = self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)  # without the places in the text
        ids = np.array(found.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary has no word ends")
        data, at = ids.tobytes(), 0
        for piece, end in zip(new, (ends * 4).tolist(), strict=True):
            self.pieces[piece] = data[at:end]
            at = end

    def learn(self, words: set[bytes]) -> None:
        """Encode words that the table lacks."""
        if len(self.words) + len(words) > WORDS:
            self.words.clear()
        if len(self.pieces) > PIECES:
            self.pieces = {"\n": _MARK}
        plain, odd = list(words), []
        joined = b"\n".join(plain)
        if _ODD.search(joined.decode()) or any(x in joined for x in self.special):
            odd = [w for w in plain if _ODD.search(w.decode()) or any(x in w for x in self.special)]
            plain = list(words.difference(odd))
            joined = b"\n".join(plain)
        if plain:
            split = _SPLIT.findall(joined.decode().lower())
            new = list(set(split).difference(self.pieces))
            if new:
                self._learn_pieces(new)
            # ids stay under 2**16, so the mark cannot occur among them
            self.words.update(zip(plain, b"".join(map(self.pieces.__getitem__, split)).split(_MARK), strict=True))
        for w, e in zip(odd, self.full.encode_batch([w.decode() for w in odd], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Words are what ASCII white space separates."""
        found: list[tuple[list[bytes], list, list[int]]] = []
        new: set[bytes] = set()
        for t in texts:  # one look into the table a word: with so many words it is the looks that take time
            ws = t.split()
            own = list(map(self.words.get, ws))
            lacking = list(compress(range(len(ws)), map(is_, own, repeat(None))))
            new.update(map(ws.__getitem__, lacking))
            found.append((ws, own, lacking))
        if new:
            self.learn(new)
            for ws, own, lacking in found:
                for k in lacking:
                    own[k] = self.words[ws[k]]
        return [b"".join(own) for _, own, _ in found]

    def decode(self, ids: bytes) -> bytes:
        """The decoder of a vocabulary without one: tokens' names joined by a space."""
        return b" ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cuts(data: np.ndarray, size: int = CHUNK_BYTES) -> np.ndarray:
    """Content-defined cut places inside data, never within a character."""
    if len(data) <= DEPTH:
        return np.zeros(0, np.int64)
    h, step, base = common._VALUES[data] + data, 1, np.uint32(0x9E3779B1)
    h = (h >> np.uint64(20)).astype(np.uint32)
    while step < DEPTH:
        h[step:] = h[step:] + base * h[:-step]
        base, step = np.uint32((int(base) ** 2) & 0xFFFFFFFF), step * 2
    at = np.flatnonzero((h >> np.uint32(8)) % np.uint32(size) == 0) + 1
    at = at[(at > DEPTH) & (at < len(data))]
    return at[(data[at] & 0xC0) != 0x80]


_FIRST, _LAST = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[\x20\x09-\x0D][^\x20\x09-\x0D]*\Z")


class ChunkEncoder:
    """Whole texts by chunks; the table holds chunk -> (raw left end, ids, raw right end), or None without white space."""

    def __init__(self, path: str, size: int = CHUNK_BYTES):
        self.words, self.size, self.table = encoder(path), size, {}
        self.made = self.reused = 0

    def _learn(self, chunks: set[bytes]) -> None:
        if len(self.table) + len(chunks) > CHUNKS:
            self.table.clear()
        ends: list[tuple[bytes, int, int]] = []
        for c in chunks:
            m = _FIRST.search(c)
            if m is None:
                self.table[c] = None
            else:
                ends.append((c, m.start(), _LAST.search(c).start()))
        for (c, a, b), ids in zip(ends, self.words.encode_all([c[a:b] for c, a, b in ends]), strict=True):
            self.table[c] = (c[:a], ids, c[b:])

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        dealt = []
        for t in texts:
            edges = [0, *cuts(np.frombuffer(t, np.uint8), self.size).tolist(), len(t)]
            dealt.append([t[a:b] for a, b in zip(edges, edges[1:])])
        total = sum(map(len, dealt))
        new = {c for cs in dealt for c in cs if c not in self.table}
        if len(self.table) + len(new) > CHUNKS:
            self.table.clear()
            new = {c for cs in dealt for c in cs}
        self._learn(new)
        self.made, self.reused = self.made + len(new), self.reused + total - len(new)
        joins: list[bytes] = []
        plans: list[list] = []
        for cs in dealt:
            open_, plan = b"", []
            for c in cs:
                held = self.table[c]
                if held is None:  # no white space yet: the join grows
                    open_ += c
                    continue
                joins.append(open_ + held[0])
                plan += (len(joins) - 1, held[1])
                open_ = held[2]
            joins.append(open_)
            plan.append(len(joins) - 1)
            plans.append(plan)
        repaired = self.words.encode_all(joins)
        return [b"".join([repaired[p] if isinstance(p, int) else p for p in plan]) for plan in plans]


@cache
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


common.TABLES += [encoder.cache_clear, chunk_encoder.cache_clear]


def text_groups(texts: pa.Array, limit: int = common.SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """First row and the texts of runs of about limit bytes; null as empty."""
    for lo, hi, data, offsets in common.slices(texts, limit):
        raw, at = data.tobytes(), offsets.tolist()
        yield lo, [raw[a:b] for a, b in zip(at, at[1:])]


_ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_encoder(path)
        for batch in batches:
            for lo, texts in text_groups(batch.column(1)):
                ids = coder.encode_all(texts)
                back = [coder.words.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(b).hexdigest() for b in back])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, one row per document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_round_trip(path or default_path()), _ENCODED)


def encode_column(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with an array of ids (replaces a column of that name)."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([np.frombuffer(i, "<i4") for i in chunk_encoder(path).encode_all([(t or "").encode() for t in texts])])

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode_column(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the decoded text of an array of ids; null ids give null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda i: None if i is None else encoder(path).decode(np.asarray(i, "<u4").tobytes()).decode())

    return df.withColumn(text_col, text(F.col(ids_col)))
