"""The compressed index: posting lists as blobs, in blocks of bounded length.

``blobs(term, block, n, blob)``: block b of a term holds its postings with doc_id from ``b * SPAN``
up to the next block, encoded from the block's start, so a list of any length is many rows of at
most ``SPAN`` postings and a frequent term is no row or group that grows with the collection.
Lookup prunes by term; merging and appending touch only the blocks that both sides have.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import codec
from quern.functions.text import TextOptions
from quern.scratch import release, scratch_table

from .index import Index, lexicon_of, stats_of

SPAN = 65_536
KEY = ["term", "block"]


def posting_blocks(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, block, doc_ids, frequencies), ids ascending and counted from the block's start.

    Postings are unique per (term, doc_id), so a group has at most ``span`` rows. A posting is
    gathered and sorted as one long, the id above the frequency, which must be below 2 ** 47 at
    the usual span.
    """
    low = 63 - (span - 1).bit_length()
    block = F.expr(f"doc_id div {span}")
    bad = F.raise_error(F.lit(f"a frequency must be from 0 to {2**low - 1}")).cast("long")
    tf = F.when(F.col("tf").between(0, 2**low - 1), F.col("tf")).otherwise(bad)
    placed = postings.select("term", block.alias("block"), F.shiftleft(F.col("doc_id") - block * F.lit(span), low).bitwiseOR(tf).alias("p"))
    lists = placed.groupBy(*KEY).agg(F.sort_array(F.collect_list("p")).alias("p"))
    ids = F.transform("p", lambda p: F.shiftright(p, low))
    return lists.select(*KEY, ids.alias("doc_ids"), F.transform("p", lambda p: p.bitwiseAND(2**low - 1)).alias("frequencies"))


def compress(postings: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, block, n, blob); ids must not be negative."""
    blob = codec.encode(F.col("doc_ids"), F.col("frequencies"))
    return posting_blocks(postings, span).select(*KEY, F.size("doc_ids").cast("long").alias("n"), blob.alias("blob"))


def decompress(blobs: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, doc_id, tf) again: ids are added up within each block, so nothing is sorted."""
    each = blobs.select(*KEY, F.explode(codec.decode_postings(F.col("blob"))).alias("p"))
    return each.select("term", (F.col("block") * F.lit(span) + F.col("p.id")).alias("doc_id"), F.col("p.tf").alias("tf"))


def merge_compressed(parts: list[DataFrame], span: int = SPAN) -> DataFrame:
    """Blobs of the postings of all parts, frequencies of a (term, doc_id) added up.

    A block that only one part has passes as it is; the others are decoded, merged and encoded.
    A single part is returned unchanged. The parts are read once and their blobs written, by block.
    """
    if not parts:
        raise ValueError("nothing to merge")
    if len(parts) == 1:
        return parts[0]
    # the blobs of a block: one per part, so the list is short
    every = scratch_table(reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.collect_list(F.struct("n", "blob")).alias("b")))
    alone = every.filter(F.size("b") == 1).select(*KEY, F.col("b")[0]["n"].alias("n"), F.col("b")[0]["blob"].alias("blob"))
    shared = every.filter(F.size("b") > 1)
    postings = decompress(shared.select(*KEY, F.explode("b.blob").alias("blob")), span)
    again = compress(postings.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")), span)
    return alone.unionByName(again)


@dataclass(frozen=True)
class CompressedIndex:
    """Blobs, with lexicon, document lengths and collection statistics as in ``Index``."""

    blobs: DataFrame
    lexicon: DataFrame
    doc_stats: DataFrame
    stats: DataFrame
    options: TextOptions = TextOptions()

    @staticmethod
    def of(index: Index) -> CompressedIndex:
        return CompressedIndex(compress(index.postings), index.lexicon, index.doc_stats, index.stats, index.options)

    def blobs_of(self, term: str) -> DataFrame:
        """(block, n, blob) of a term; empty if it is unknown."""
        return self.blobs.filter(F.col("term") == term).select("block", "n", "blob")

    def postings_of(self, term: str) -> DataFrame:
        """(doc_id, tf) of a term, decoded; empty if it is unknown."""
        return decompress(self.blobs.filter(F.col("term") == term)).select("doc_id", "tf")

    def terms(self) -> DataFrame:
        return self.lexicon.select("term")

    def with_postings(self, postings: DataFrame, doc_stats: DataFrame) -> CompressedIndex:
        """With more (term, doc_id, tf) and (doc_id, doc_len), in known or new terms and documents."""
        return merge_compressed_indices([self, CompressedIndex(compress(postings), lexicon_of(postings), doc_stats, stats_of(doc_stats), self.options)])

    def plain(self) -> Index:
        """The index with decoded postings, for searching."""
        return Index(decompress(self.blobs), self.lexicon, self.doc_stats, self.stats, self.options)

    def save(self, path: str) -> None:
        """Blobs are sorted by term and block, so that a term's lookup prunes files and row groups.

        They are written once before that, since the ranges are sampled in a pass of its own; the
        lexicon and the statistics come from what is stored, so the collection is cleaned once.
        """
        blobs = scratch_table(self.blobs)
        blobs.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.mode("overwrite").parquet(f"{path}/blobs")
        blobs.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/lexicon")
        release(blobs)
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        stats_of(self.blobs.sparkSession.read.parquet(f"{path}/doc_stats")).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str, options: TextOptions = TextOptions()) -> CompressedIndex:
        return CompressedIndex(*[spark.read.parquet(f"{path}/{t}") for t in ("blobs", "lexicon", "doc_stats", "stats")], options)


def merge_compressed_indices(parts: list[CompressedIndex]) -> CompressedIndex:
    """One index over all parts; documents that several parts hold count once."""
    blobs = merge_compressed([p.blobs for p in parts])
    doc_stats = reduce(DataFrame.unionByName, [p.doc_stats for p in parts]).groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    return CompressedIndex(blobs, blobs.groupBy("term").agg(F.sum("n").alias("df")), doc_stats, stats_of(doc_stats), parts[0].options)
