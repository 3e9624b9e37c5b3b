"""Index build, merge, lookup and storage: four relations instead of in-memory tables.

``postings(term, doc_id, tf)``, ``lexicon(term, df)``, ``doc_stats(doc_id, doc_len)`` and
``stats(n, avgdl)``. Saved postings are range-partitioned and sorted by (term, doc_id), so the
lookup of a term prunes files and row groups, and a frequent term spans several files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import TextOptions, stem_each, word_count, words
from quern.sources.collection import sample_documents


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lexicon: DataFrame
    doc_stats: DataFrame
    stats: DataFrame
    options: TextOptions = TextOptions()
    #: The relations are tables, not plans over the collection.
    stored: bool = False

    def relations(self) -> tuple[DataFrame, ...]:
        return self.postings, self.lexicon, self.doc_stats, self.stats

    def cache(self) -> Index:
        return Index(*[df.cache() for df in self.relations()], self.options, True)

    def uncache(self) -> None:
        for df in self.relations():
            df.unpersist()

    def postings_of(self, term: str) -> DataFrame:
        """(doc_id, tf) of a term; empty if it is unknown."""
        return self.postings.filter(F.col("term") == term).select("doc_id", "tf")

    def terms(self) -> DataFrame:
        return self.lexicon.select("term")

    def term_info(self, terms: DataFrame) -> DataFrame:
        """(term, df) for the terms asked for; df is null where a term is unknown."""
        return terms.select("term").join(self.lexicon, "term", "left")

    def doc_lengths(self, ids: DataFrame) -> DataFrame:
        """(doc_id, doc_len) for the ids asked for; 0 where a document is unknown."""
        return ids.select("doc_id").join(self.doc_stats, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).cast("long").alias("doc_len"))

    def save(self, path: str) -> None:
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lexicon.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str, options: TextOptions = TextOptions()) -> Index:
        return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "lexicon", "doc_stats", "stats")], options, True)


def lexicon_of(postings: DataFrame) -> DataFrame:
    """A term's document frequency; postings are unique per (term, doc_id)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def stats_of(doc_stats: DataFrame) -> DataFrame:
    """One row: N, and the mean length, 0 without documents."""
    return doc_stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))


def postings_from_words(docs: DataFrame, found: Column, stemming: bool = False) -> DataFrame:
    """Partial counts per task, one shuffle on (term, doc_id): a frequent term is no hot key. Words
    are stemmed one to a row, so Python holds no text and no document's words."""
    each = docs.select("doc_id", F.explode(found).alias("term"))
    each = each.withColumn("term", stem_each("term")) if stemming else each
    return each.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def build_index(docs: DataFrame, options: TextOptions = TextOptions()) -> Index:
    """``docs`` has doc_id and text. Documents without tokens count in N and the mean length.

    Rows that repeat a doc_id are one document: frequencies add up, the longest row gives the length.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    postings = postings_from_words(docs, words(F.col("text"), options), options.stemming)
    doc_stats = docs.groupBy("doc_id").agg(F.max(word_count(F.col("text"))).alias("doc_len"))
    return Index(postings, lexicon_of(postings), doc_stats, stats_of(doc_stats), options)


def merge_postings(parts: list[DataFrame]) -> DataFrame:
    """Frequencies of a (term, doc_id) add up: associative, one aggregation for any number."""
    if not parts:
        raise ValueError("nothing to merge")
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def merge_lexicons(parts: list[DataFrame]) -> DataFrame:
    """Document frequencies of parts without common documents add up."""
    if not parts:
        raise ValueError("nothing to merge")
    return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df"))


def merge_indices(parts: list[Index]) -> Index:
    postings = merge_postings([p.postings for p in parts])
    doc_stats = reduce(DataFrame.unionByName, [p.doc_stats for p in parts]).groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    return Index(postings, lexicon_of(postings), doc_stats, stats_of(doc_stats), parts[0].options)


def build_sample_index(docs: DataFrame, k: int = 10_000, seed: int | None = None, options: TextOptions = TextOptions()) -> Index:
    """The index of ``k`` sampled documents (see ``sources.collection.sample_documents``)."""
    return build_index(sample_documents(docs, k, seed), options)


def posting_lists(postings: DataFrame) -> DataFrame:
    """(term, doc_ids, frequencies), ids ascending. An array holds a term's whole list: for export.
    The compressed index keeps lists in blocks of bounded length instead.

    A posting is gathered and sorted as one long, the id above the frequency, if both fit (ids from 0 below
    2 ** 43, frequencies below 2 ** 20). The others are gathered as they are and sorted in with the rest of their term.
    """
    low, kinds = 20, dict(postings.dtypes)
    doc_id, tf = F.col("doc_id"), F.col("tf")
    fits = F.coalesce(doc_id.between(0, 2 ** (63 - low) - 1) & tf.between(0, 2**low - 1), F.lit(False))
    packed = F.shiftleft(doc_id.cast("long"), low).bitwiseOR(tf.cast("long"))
    placed = postings.select("term", F.when(fits, packed).alias("p"), F.when(~fits, F.struct("doc_id", "tf")).alias("other"))
    lists = placed.groupBy("term").agg(F.sort_array(F.collect_list("p")).alias("p"), F.collect_list("other").alias("other"))

    def id_of(p: Column) -> Column:
        return F.shiftright(p, low).cast(kinds["doc_id"])

    def tf_of(p: Column) -> Column:
        return p.bitwiseAND(2**low - 1).cast(kinds["tf"])

    every = F.sort_array(F.concat(F.transform("p", lambda p: F.struct(id_of(p).alias("doc_id"), tf_of(p).alias("tf"))), "other"))
    alone = F.size("other") == 0
    return lists.select(
        "term",
        F.when(alone, F.transform("p", id_of)).otherwise(every["doc_id"]).alias("doc_ids"),
        F.when(alone, F.transform("p", tf_of)).otherwise(every["tf"]).alias("frequencies"),
    )


def index_summary(index: Index) -> DataFrame:
    """One row: terms, postings, and postings per term."""
    return index.lexicon.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"), F.coalesce(F.avg("df"), F.lit(0.0)).alias("avg_postings"))
