"""Cost-balanced packing of documents into sequences of at most ``capacity`` tokens.

The cost of a piece of n tokens is ``linear * n + quadratic * n ** 2`` (attention within
the piece). Documents are packed in windows of ``window`` documents of one input partition.
Within a window, documents longer than the capacity give full sequences of their own; the
number of further sequences is the least that can hold what is left; documents go in
descending order of tokens to the open sequence of lowest cost that has room for them, and
the documents for which none has room are cut to fill the rooms left, largest first. So all
sequences are full but for the tokens that the last of a window would lack. As a sequence is
not padded at a power of two, that last one is dealt as a few sequences whose lengths are the
powers of two that add up to it, and no padding is left.

No row is shuffled: a hot source or group of copies has no effect, memory is bounded by a
window's tokens, and a lost executor repeats its own partition alone, with the same result.

Defined cases: a null or empty text is the end token alone; a very long text is encoded whole,
closes its window and fills sequences of its own but for its rest; repeated rows are packed each;
equal lengths keep the input's order; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import trimmed
from .token_count import byte_characters

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, pattern: str):
    """The byte-level BPE of ``vocabulary``, a tokenizer's .json file; one per worker.

    Vocabulary, order of the merges and special tokens are those of the file; a special string
    inside a text is its one token, as the file's own library has it by default. The ids come from
    another library that merges by the ids themselves, so the file's merges must be in the
    order of the ids that they give; if not, this raises.
    """
    import json

    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model, back = file["model"], byte_characters()
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if model["type"] != "BPE" or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError(f"{vocabulary}: no byte-level BPE whose merges follow its ids")
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def binary_parts(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences from 0.

    Each token of each document lies in exactly one piece.
    """
    pieces, full, rest = [], 0, []
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, full, 0))
            full += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    total = sum(n for n, _, _ in rest)
    room = np.array([capacity] * (total // capacity) + binary_parts(total % capacity), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, full + s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    uncut = []
    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        s = int(np.where(room >= n, cost, np.inf).argmin())
        if room[s] >= n:
            put(d, start, n, s)
        else:
            uncut.append((n, d, start))
    gaps = iter(np.argsort(-room, kind="stable").tolist())
    s = -1
    for n, d, start in uncut:
        while n:
            if s < 0 or not room[s]:
                s = next(gaps)
            take = min(n, int(room[s]))
            put(d, start, take, s)
            start, n = start + take, n - take
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, capacity: int = 2048, window: int = 4096, window_tokens: int = 8_000_000) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers.

    ``vocabulary`` is a tokenizer's .json file, ``pattern`` what its byte-level pre-tokenizer splits
    at. A window closes at ``window`` documents or ``window_tokens`` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        end = np.array([end_id], "<u4")
        base = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        n_tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal base, n_tokens
            pieces = pack([len(t) for t in tokens], capacity)
            pieces.sort(key=lambda p: (p[3], p[4]))
            d, start, length, seq, offset = zip(*pieces, strict=True)
            blobs = [tokens[i][a : a + n].tobytes() for i, a, n in zip(d, start, length, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in d], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(blobs, pa.binary()),
                    pa.array([len(tokens[i]) for i in d], pa.int64()),
                    pa.array([base + s for s in seq], pa.int64()),
                    pa.array(offset, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            base += max(seq) + 1
            ids.clear()
            tokens.clear()
            n_tokens = 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = encoder.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4")
                ids.append(doc_id)
                tokens.append(np.concatenate([found, end]))
                n_tokens += len(found) + 1
                if len(ids) == window or n_tokens >= window_tokens:
                    yield close()
        if ids:
            yield close()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lambda batches: trimmed(run(batches)), SCHEMA)
