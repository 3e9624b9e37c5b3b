"""Byte-level BPE encoding and decoding in length-bucketed padded numpy matrices.

The distinct pre-tokens of a batch that are not in the cache are sorted into buckets by
byte length and laid out as padded matrices, a row each. In each round every row merges its
leftmost pair of minimum rank; rows without a pair left are done. Ranks of pairs come from a hash
table in numpy arrays; after a merge only the two pairs that touch the new token are looked up.

Buckets go on by doubling, so a pre-token of any length is a row of some matrix; the wider it is
the fewer rows it has. Up to ``NARROW`` columns each round compacts the matrix by one column. Wider
ones keep the least rank of each block of about the root of the width, so that a round reads
and writes a few blocks of a row, and are compacted whenever half of their tokens have been merged
away; the merges and their order are the same.

A pre-token that is in the vocabulary as a whole is that one token.

Defined cases: a null or empty text has no tokens and decodes to no bytes; very long texts and
pre-tokens are encoded whole; special strings are ordinary text; repeated rows give a row each;
extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rank of a pair that does not merge.
NONE = np.int32(2**31 - 1)
#: Upper byte lengths of the first buckets; from there on they double.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
NARROW = BUCKETS[-1]
#: Longest pre-token, in characters, that the cache keeps.
KEPT = 256
#: Cells of one matrix at most.
CELLS = 2_000_000


class PairTable:
    """Open-addressing hash table (left, right) -> rank in two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):  # one key per free slot and round; the others probe on
            slots = at[todo]
            free = self.keys[slots] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            won = free & first
            self.keys[slots[won]], self.ranks[slots[won]] = keys[todo[won]], rank[todo[won]]
            todo = todo[~won]
            taken = self.keys[at[todo]] >= 0
            at[todo[taken]] = (at[todo[taken]] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for pairs without one or with padding (-1)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self.slot(keys[todo])
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for the ranks of a .tiktoken file; one per worker."""

    def __init__(self, vocabulary: str, pattern: str, most: int = 300_000):
        import regex

        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.cache: dict[str, bytes] = {}
        self.most = most

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of pieces of any length."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        begin, widths = 0, list(BUCKETS)
        while widths[-1] < lengths.max(initial=0):
            widths.append(2 * widths[-1])
        for most in widths:
            stop = int(np.searchsorted(lengths[order], most, side="right"))
            step = max(1, CELLS // most)
            merge = self._merge_matrix if most <= NARROW else self._merge_wide
            for a in range(begin, stop, step):
                merge(pieces, order[a : min(a + step, stop)], most, out)
            begin = max(begin, stop)
        return out

    def _merge_matrix(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        n = np.array([len(pieces[i]) for i in rows], np.int64)
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.single[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        rank = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = rank.argmin(axis=1)  # the leftmost of equal ranks
            every = np.arange(len(rows))
            new = rank[every, best]
            done = new == NONE
            if done.any():
                for i, r, m in zip(rows[done].tolist(), ids[done].astype("<u4"), n[done].tolist(), strict=True):
                    out[i] = r[:m].tobytes()
                rows, ids, rank, n, best, new = (x[~done] for x in (rows, ids, rank, n, best, new))
                every = np.arange(len(rows))
                if not len(rows):
                    return
            ids[every, best] = new
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            n = n - 1
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), axis=1) if len(columns) else np.full((len(rows), 1), NONE, np.int32)
            for at, left in ((best - 1, best - 1), (best, best)):
                ok = (left >= 0) & (left + 1 < ids.shape[1])
                r, c = every[ok], at[ok]
                rank[r, c] = self.pairs.rank(ids[r, c], ids[r, c + 1])

    def _merge_wide(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        alive = [self.single[np.frombuffer(pieces[i], np.uint8)] for i in rows]
        while len(rows):
            rows, alive = self._halve(rows, alive, width, out)
            width = max((len(x) for x in alive), default=0)

    def _halve(self, rows: np.ndarray, tokens: list[np.ndarray], width: int, out: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Up to ``width / 2`` rounds on a fresh matrix; returns the rows that are not done.

        Merged-away columns stay until then, as -1; ``after`` and ``before`` link the others.
        """
        side = 1 << (width.bit_length() + 1) // 2
        width = -(-width // side) * side
        n = np.array([len(t) for t in tokens])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = np.concatenate(tokens)
        rank = np.full((len(rows), width), NONE, np.int32)
        rank[:, :-1] = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (len(rows), 1))
        after[np.arange(len(rows)), n - 1] = -1
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (len(rows), 1))
        cut = rank.reshape(len(rows), -1, side)
        low = cut.min(axis=2)
        every, left = np.arange(len(rows)), []
        for _ in range(max(1, width // 2)):
            block = low[every].argmin(axis=1)  # the leftmost of equal ranks
            new = low[every, block]
            done = new == NONE
            if done.any():
                for i in every[done].tolist():
                    out[rows[i]] = ids[i][ids[i] >= 0].astype("<u4").tobytes()
                every, block, new = every[~done], block[~done], new[~done]
                if not len(every):
                    return rows[:0], left
            at = block * side + cut[every, block].argmin(axis=1)
            gone = after[every, at]
            following, previous = after[every, gone], before[every, at]
            ids[every, at], ids[every, gone] = new, -1
            rank[every, gone] = NONE
            after[every, at] = following
            more, some = following >= 0, previous >= 0
            before[every[more], following[more]] = at[more]
            rank[every, at] = self.pairs.rank(new, np.where(more, ids[every, following], -1))
            rank[every[some], previous[some]] = self.pairs.rank(ids[every[some], previous[some]], new[some])
            for column in (at, gone, np.where(some, previous, at)):
                low[every, column // side] = cut[every, column // side].min(axis=1)
        return rows[every], [ids[i][ids[i] >= 0] for i in every]

    def encode_pretokens(self, pretokens: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        short: list[tuple[str, bytes]] = []
        for s in pretokens:
            b = s.encode()
            if (r := self.ranks.get(b)) is not None:
                out[s] = r.to_bytes(4, "little")
            else:
                short.append((s, b))
        out.update(zip((s for s, _ in short), self.merge_rows([b for _, b in short]), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        if len(self.cache) > self.most:
            self.cache.clear()
        new = {p for c in cut for p in c if p not in self.cache}
        found = self.encode_pretokens(new)
        lookup = self.cache
        lookup.update(found)
        out = [b"".join(map(lookup.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > KEPT:
                del lookup[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(vocabulary: str, pattern: str) -> ByteBPE:
    return ByteBPE(vocabulary, pattern)


def _groups(values: list, most: int = 2_000_000) -> Iterator[list]:
    """Consecutive values of at most ``most`` characters together, or one alone."""
    group, size = [], 0
    for v in values:
        if group and size + len(v) > most:
            yield group
            group, size = [], 0
        group.append(v)
        size += len(v)
    if group:
        yield group


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            at = 0
            for group in _groups([t or "" for t in b.column(1).to_pylist()]):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(group)), pa.array(bpe.encode(group), pa.binary())], names=["doc_id", "ids"])
                at += len(group)

    return _texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes of each list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them.

    Encodes and decodes in one worker, so that ids and bytes need not cross to the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for group in _groups([t or "" for t in b.column(1).to_pylist()]):
                for ids in bpe.encode(group):
                    n.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
