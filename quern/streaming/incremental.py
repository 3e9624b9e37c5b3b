"""Incremental indexing: a stream of documents appended to a stored index.

Merging is associative, so each micro-batch is indexed on its own and appended; readers add
up the parts. A batch id names its folder, so a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import TextOptions
from quern.operators.index import Index, build_index, lexicon_of, stats_of


def append_stream(docs: DataFrame, path: str, checkpoint: str, options: TextOptions = TextOptions(), **trigger) -> StreamingQuery:
    """Start indexing a streaming DataFrame (doc_id, text) into ``path``."""

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        part = build_index(batch, options)
        part.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
        part.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats/batch={batch_id}")

    return docs.writeStream.foreachBatch(index_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load_appended(spark: SparkSession, path: str, options: TextOptions = TextOptions()) -> Index:
    """The index over all batches so far."""
    postings = spark.read.parquet(f"{path}/postings").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    doc_stats = spark.read.parquet(f"{path}/doc_stats").groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    return Index(postings, lexicon_of(postings), doc_stats, stats_of(doc_stats), options)
