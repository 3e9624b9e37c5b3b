"""NDCG evaluation of ranked results against relevance judgements.

Of a query's judgements only their numbers per relevance are needed: the descending gains
are runs of equal values. Windows see these runs and the retrieved rows, never all judgements
of a query.

``ndcg_reference``: gains are the query's judged relevances in descending order; the
retrieved documents' relevances, padded with zeros, act as the scores that order those
gains, with tied scores sharing the mean gain (so an all-miss result is not 0). More
retrieved than judged documents, or a single judged one, give 0. ``ndcg_at_k`` is the
standard measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import Index
from .search import search_all_modes


BLOCK = 65_536  # positions whose discounts are added up at once


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with at least one judgement."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def discount(position: F.Column) -> F.Column:
    return F.log2(position + F.lit(1.0))


def _gains(qrels: DataFrame) -> DataFrame:
    """(query_id, gain, n, first, last): the runs of equal gains in descending order of the
    judgements, which have one row per (query_id, doc_id), and the positions they take."""
    order = Window.partitionBy("query_id").orderBy(F.col("gain").desc())
    counts = qrels.groupBy("query_id", F.col("relevance").alias("gain")).agg(F.count("*").alias("n"))
    return counts.withColumn("last", F.sum("n").over(order)).withColumn("first", F.col("last") - F.col("n") + 1)


def _discounts(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., discounts): the sum of the discounts of positions ``first`` to ``last``, which is
    added up in blocks of positions that are dealt over tasks."""
    blocks = runs.select(*by, "last", F.explode(F.sequence("first", "last", F.lit(BLOCK).cast("long"))).alias("at")).repartition(*by, "at")
    positions = F.sequence("at", F.least("last", F.col("at") + F.lit(BLOCK - 1)))
    one = F.aggregate(positions, F.lit(0.0), lambda total, p: total + F.lit(1.0) / discount(p))
    return blocks.select(*by, one.alias("part")).groupBy(*by).agg(F.sum("part").alias("discounts"))


def ndcg_reference(ranked: DataFrame, qrels: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ndcg) of every run; ``runs`` has the keys ``by`` (query_id among them) of all
    runs, results or not, of judged queries. ``ranked`` has by..., rank and doc_id.

    Retrieved documents of relevance 0 and all places without one are a single tie: it takes the
    gains and the discounts that the other retrieved documents leave.
    """
    qrels = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    gains = _gains(qrels)
    places = gains.join(_discounts(gains, ["query_id", "gain"]).withColumnRenamed("query_id", "q").withColumnRenamed("gain", "g"), (F.col("query_id") == F.col("q")) & F.col("gain").eqNullSafe(F.col("g")))
    ideal = places.groupBy("query_id").agg(
        F.sum("n").alias("n_judged"),
        F.coalesce(F.sum(F.when(F.col("gain").isNotNull(), F.col("n"))), F.lit(0)).alias("n_gains"),
        F.sum(F.col("gain") * F.col("n")).alias("gains"),
        F.sum(F.col("gain") * F.col("discounts")).alias("best"),
        F.sum("discounts").alias("discounts"),
    )
    got = ranked.join(qrels, ["query_id", "doc_id"], "left").select(*by, F.col("rank").alias("position"), F.coalesce("relevance", F.lit(0)).alias("got"))
    n_got = got.groupBy(*by).agg(F.count("*").alias("n_got"))
    hits = got.filter("got != 0").join(gains, "query_id").filter("position between first and last").join(ideal.select("query_id", "n_judged"), "query_id")
    order = Window.partitionBy(*by).orderBy(F.col("got").desc(), F.col("position"))
    hits = hits.withColumns({"mean_gain": F.avg("gain").over(Window.partitionBy(*by, "got")), "at": F.row_number().over(order), "n_hits": F.count("*").over(Window.partitionBy(*by))})
    # relevances below 0 come after the tie
    at = F.when(F.col("got") > 0, F.col("at")).otherwise(F.col("at") + F.col("n_judged") - F.col("n_hits"))
    hits = hits.groupBy(*by).agg(
        F.sum(F.col("mean_gain") / discount(at)).alias("hit_dcg"),
        F.sum(F.lit(1.0) / discount(at)).alias("hit_discounts"),
        F.sum("gain").alias("hit_gains"),
        F.count("gain").alias("n_hit_gains"),
    )
    left = {c: F.coalesce(c, F.lit(0)) for c in ("n_got", "hit_dcg", "hit_discounts", "hit_gains", "n_hit_gains")}
    sums = runs.join(ideal, "query_id").join(n_got, by, "left").join(hits, by, "left").withColumns(left)
    n_tied = F.col("n_gains") - F.col("n_hit_gains")
    tied = F.when(n_tied > 0, (F.col("gains") - F.col("hit_gains")) / n_tied * (F.col("discounts") - F.col("hit_discounts"))).otherwise(0.0)
    valid = (F.col("n_got") <= F.col("n_judged")) & (F.col("n_judged") > 1) & (F.col("best") > 0)
    return sums.select(*by, F.when(valid, (F.col("hit_dcg") + tied) / F.col("best")).otherwise(0.0).alias("ndcg"))


def ndcg_at_k(ranked: DataFrame, qrels: DataFrame, runs: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """(by..., ndcg): linear gain of the retrieved over the best possible, both to depth k."""
    qrels = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    gains = _gains(qrels).filter(F.col("first") <= k).withColumn("last", F.least("last", F.lit(k).cast("long")))
    best = runs.join(_discounts(gains, ["query_id", "gain"]).groupBy("query_id").agg(F.sum(F.col("gain") * F.col("discounts")).alias("best")), "query_id")
    got = ranked.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"]).groupBy(*by).agg(F.sum(F.col("relevance") / discount(F.col("rank"))).alias("dcg"))
    value = F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).otherwise(0.0)
    return best.join(got, by, "left").select(*by, value.alias("ndcg"))


BY = ["query_id", "query_type", "method"]


def all_runs(queries: DataFrame) -> DataFrame:
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("query_type"), F.lit(s).alias("method")) for m in ("conjunctive", "disjunctive") for s in ("tfidf", "bm25")])).alias("m")
    return queries.select("query_id", modes).select("query_id", "m.*")


def evaluate_all_queries(index: Index, queries: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, query_type, method, ndcg) of all judged queries in the four modes."""
    judged = judged_queries(queries, qrels)
    return ndcg_reference(search_all_modes(index, judged, k), qrels, all_runs(judged), BY)


def mean_ndcg(metrics: DataFrame) -> DataFrame:
    """(query_type, method, mean_ndcg)."""
    return metrics.groupBy("query_type", "method").agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"))
