"""Exact token counts by the whole-token shortcut.

Offline, each string that the vocabulary holds as a whole word is encoded alone; those that
give exactly one token are proven whole tokens. A text is cut at spaces (no pre-token
spans one), each distinct piece is counted once per cache, its pre-tokens that are proven
whole tokens count 1 directly, and only the rest are merged by the library.

A piece that is not plain ASCII and not itself a proven string, or that holds a special
string, is left to the library as a whole, so Unicode normalization, the library's own
tables of letters and special strings inside texts are always its own doing.

Defined cases: a null text is empty and has 0 bytes and tokens; repeated rows and ids give a
row each; very long texts and pieces are whole; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Pre-tokens of lower-cased ASCII text; fixed value of the vocabulary's pre-tokenizer.
ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s0-9a-z]+", re.ASCII)
#: What Python's \s and the library's may see differently stays with the library.
ODD = re.compile(r"[^\n\t\r\x21-\x7e]")


def byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WholeTokenCounter(dict):
    """Maps a piece of text without spaces to its number of tokens; bounded cache."""

    def __init__(self, vocabulary: str, word_end: str = "</w>", most: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = self.prove(word_end)
        self.merged: dict[str, int] = {}

    def prove(self, word_end: str) -> frozenset[str]:
        """The strings of the vocabulary that encode alone as exactly one token."""
        back, found = byte_characters(), []
        for token in self.library.get_vocab(with_added_tokens=False):
            if token.endswith(word_end) and all(c in back for c in token[: -len(word_end)]):
                try:
                    found.append(bytes(back[c] for c in token[: -len(word_end)]).decode())
                except UnicodeDecodeError:  # part of a character: no text encodes to it alone
                    continue
        return frozenset(s for s, e in zip(found, self.library.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)

    def merge(self, pretoken: str) -> int:
        if (n := self.merged.get(pretoken)) is None:
            if len(self.merged) >= self.most:
                self.merged.clear()
            n = self.merged[pretoken] = len(self.library.encode(pretoken, add_special_tokens=False).ids)
        return n

    def __missing__(self, piece: str) -> int:
        if piece in self.whole:
            n = 1
        elif ODD.search(piece) or any(s in piece for s in self.specials):
            n = len(self.library.encode(piece, add_special_tokens=False).ids)
        else:
            n = sum(1 if p in self.whole else self.merge(p) for p in ASCII_PRETOKEN.findall(piece.lower()))
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 256:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> WholeTokenCounter:
    return WholeTokenCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            counts = [counter.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
