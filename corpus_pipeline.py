"""Corpus pipeline: quality classifier, line dedup, near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents`` (doc_id, text, lang, source, n_chars), and any further column of theirs
that does not clash with a name below passes through. The near-dedup stage takes its first links
from SimHash fingerprints in vantage-point trees and completes them by min-hash bands, as few pairs
of the similarity asked for have near fingerprints; every link is checked on the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, packing, quality, simhash
from quern.llm.common import read_table, release, scratch_table
from quern.llm.queries import pretoken_pattern, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; ``labels`` of ``sf_dir`` is what it learns from.

    The score reads the whole text alone. Null, empty and blank texts are scored as one passage
    without words; equal texts get equal scores, so copies and repeated rows stay or go together;
    rows without an id are scored like others; without any label all rows stay; an empty
    table gives none.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; ``n_chars`` follows the text. All rows stay.

    A null text stays null, with null ``n_chars``; a text whose lines would all go stays whole; a
    null source is the source ''; repeated rows count as pages each; very long texts are taken whole;
    an empty table gives none.
    """
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"), counts=False)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles) stays: its least doc_id.

    Texts without words, null ones among them, are one group; of repeated rows one stays; rows
    without an id come after all others of their group; very long texts are taken whole; an
    empty table gives none.
    """
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids; see ``packing`` for the columns.

    A null or empty text is the end token alone; a very long one fills sequences of its own;
    repeated rows are packed each; columns other than doc_id and text are not read; an
    empty table gives none.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), pretoken_pattern())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests/llm/test_pipeline.py
#: compares every stage's rows with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again for the next; a
    stage's rows are deleted when those of the next are written."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch_table(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
