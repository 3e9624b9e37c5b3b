"""Sources and sinks: tab-separated collections, query and judgement files, text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.scratch import scratch_table

MISSING = "Not existing document"
SPACE = r"[\s\x1c-\x1f]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Bytes of a table for each core below which its rows are dealt out after the scan.
SPREAD = 16 << 30
#: Bytes of such a table that one task gets, so that tasks do not grow with the table.
PART = 2 << 20


def strip(value: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def number(field: Column) -> Column:
    """A long: exact for whole numbers, towards zero for other decimal forms; null for what is no
    finite number or lies outside the range."""
    text = strip(field)
    near = text.try_cast("double")
    within = text.rlike(NUMBER) & (F.abs(near) < F.lit(2.0**63))
    return F.coalesce(text.try_cast("long"), F.when(within, near).try_cast("long"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, text) of the well-formed lines: two fields at a tab, a numeric id."""
    parts = lines.select(F.split(strip("value"), "\t").alias("f")).filter(F.size("f") == 2)
    return parts.select(number(F.col("f")[0]).alias("doc_id"), F.col("f")[1].alias("text")).filter("doc_id is not null")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` over all cores, in parts of ``PART`` bytes or less, if it is small for them.

    A file of one row group or one gzip stream is read by a single task, and what follows would
    run there too. What is counted by ``key`` and more afterwards needs no shuffle of its own: the texts
    are shuffled in place of their postings, which are several times as large. A table of ``SPREAD``
    bytes a core or more stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // PART)), key) if size < cores * SPREAD else df


def read_collection(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(doc_id, text) of a TSV file, gzip or plain.

    A gzip file is one split; ``partitions`` deals its rows out after the read.
    """
    docs = parse_lines(spark.read.text(path))
    return docs.repartition(partitions) if partitions else docs


def count_lines(spark: SparkSession, path: str) -> int:
    """All lines, malformed ones included."""
    return spark.read.text(path).count()


def chunk_of(docs: DataFrame, chunk_size: int, order: str = "doc_id") -> DataFrame:
    """``docs`` with ``chunk``: consecutive runs of ``chunk_size`` rows in the order of ``order``.

    The counts of range partitions give each its first row number, so no task sees all rows. The
    partitions are written, as a repeated range partitioning might cut elsewhere.
    """
    parts = scratch_table(docs.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    numbered = parts.withColumn("__i", within).join(F.broadcast(first), "__part")  # a row per partition
    return numbered.withColumn("chunk", ((F.col("__first") + F.col("__i")) / chunk_size).cast("long")).drop("__part", "__i", "__first")


def sample_documents(docs: DataFrame, k: int = 10_000, seed: int | None = None) -> DataFrame:
    """k documents, in the order of their ids: by hash of the id, or at random with a seed."""
    key = F.rand(seed) if seed is not None else F.md5(F.col("doc_id").cast("string").cast("binary"))
    return docs.orderBy(key).limit(k).orderBy("doc_id")


def documents_by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents asked for that exist, once each."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def texts_of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) for every id asked for, with a notice in place of an unknown document's text."""
    found = ids.select("doc_id").distinct().join(docs.select("doc_id", "text", F.lit(True).alias("__found")), "doc_id", "left")
    return found.select("doc_id", F.when(F.col("__found"), F.col("text")).otherwise(F.lit(MISSING)).alias("text"))


def with_text(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked results with their documents' texts."""
    return results.join(docs.select("doc_id", "text"), "doc_id")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of the two-field lines of a TSV file; an id that is no integer raises."""
    f = spark.read.text(path).select(F.split(strip("value"), "\t").alias("f")).filter(F.size("f") == 2)
    return f.select(whole(F.col("f")[0]).alias("query_id"), F.col("f")[1].alias("text"))


def whole(field: Column) -> Column:
    """An integer field; anything else raises, in every SQL mode."""
    found = strip(field).try_cast("long")
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), field)).cast("long"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of lines of exactly four fields; any other line raises."""
    f = spark.read.text(path).select(F.split(strip("value"), rf"(?U){SPACE}+").alias("f"), "value")
    bad = F.raise_error(F.concat(F.lit("not a judgement of four fields: "), "value"))
    f = f.select(F.when(F.size("f") == 4, F.col("f")).otherwise(bad.cast("array<string>")).alias("f"))
    return f.select(*[whole(F.col("f")[i]).alias(c) for i, c in ((0, "query_id"), (2, "doc_id"), (3, "relevance"))]).withColumn("relevance", F.col("relevance").cast("int"))


def write_pairs(df: DataFrame, path: str) -> None:
    """A two-column table as text lines ``key value``: the exchange form of lexicon and lengths."""
    a, b = df.columns
    df.select(F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")).alias("value")).write.mode("overwrite").text(path)


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", " ").alias("f"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, df); repeated terms add up."""
    f = _pairs(spark, path).select(F.col("f")[0].alias("term"), F.col("f")[1].cast("long").alias("df"))
    return f.groupBy("term").agg(F.sum("df").alias("df"))


def read_doc_stats(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc_len); of repeated ids, which text files keep in no order, the largest counts."""
    f = _pairs(spark, path).select(F.col("f")[0].cast("long").alias("doc_id"), F.col("f")[1].cast("long").alias("doc_len"))
    return f.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
