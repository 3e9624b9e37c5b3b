"""Batch boolean retrieval and ranking.

All queries are answered in one plan: distinct query terms join the postings, each posting
is scored, one partial-then-final aggregation on (query, document) adds the scores up and counts
the matched terms, and a ranking window keeps k per query (Spark limits each task to k rows
per query before the shuffle). Order: score rounded to nine digits, then doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.functions.text import TextOptions, tokens
from quern.scratch import scratch_table

from .index import Index, lexicon_of, stats_of

MODES = ("conjunctive", "disjunctive")


def parse_queries(queries: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    """(query_id, tokens), by the same pipeline as documents; duplicates are kept."""
    return queries.select("query_id", tokens(F.col("text"), options).alias("tokens"))


def query_terms(queries: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    """(query_id, term, n_terms): distinct terms and their number, known or not."""
    distinct = parse_queries(queries, options).select("query_id", F.array_distinct("tokens").alias("terms"))
    return distinct.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def matches(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, n_terms, matched, tfidf, bm25) of every document with any query term.

    Which side is broadcast is the planner's choice by size; a stored index has its postings
    sorted by term, and the terms of a small query side prune them. An index that is still a plan
    over its collection gives only the postings of the terms asked for and the documents' lengths,
    each written once, so the collection is cleaned once whatever reads them.
    """
    terms = scratch_table(query_terms(queries, index.options))
    postings = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    lexicon, doc_stats, stats = index.lexicon, index.doc_stats, index.stats
    if not index.stored:
        postings, doc_stats = scratch_table(postings), scratch_table(doc_stats)
        lexicon, stats = lexicon_of(postings), stats_of(doc_stats)
    hits = postings.join(terms, "term").join(lexicon, "term")
    hits = hits.join(doc_stats, "doc_id", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0)))
    hits = hits.crossJoin(F.broadcast(stats))  # one row
    tf, df, n, dl, avg = (F.col(c) for c in ("tf", "df", "n", "doc_len", "avgdl"))
    return hits.groupBy("query_id", "doc_id").agg(
        F.first("n_terms").alias("n_terms"),
        F.count("*").alias("matched"),
        F.sum(scoring.score("tfidf", tf, df, n, dl, avg)).alias("tfidf"),
        F.sum(scoring.score("bm25", tf, df, n, dl, avg, k1, b)).alias("bm25"),
    )


def check(mode: str, method: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown query type {mode!r}; one of {MODES}")
    if method not in scoring.METHODS:
        raise ValueError(f"unknown scoring method {method!r}; one of {scoring.METHODS}")


def top(found: DataFrame, score: str, k: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), F.col("doc_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, mode: str = "conjunctive", method: str = "tfidf", k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, rank, doc_id, score. Conjunctive: all distinct terms of the query, so an
    unknown term leaves nothing; disjunctive: any. A query without tokens has no result.
    Scores of 0 and below are results too. Mode and method are checked at once.
    """
    check(mode, method)
    found = matches(index, queries, k1, b)
    if mode == "conjunctive":
        found = found.filter(F.col("matched") == F.col("n_terms"))
    return top(found, method, k, ["query_id"]).select("query_id", "rank", "doc_id", F.round(method, 6).alias("score"))


def search_all_modes(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, query_type, method, rank, doc_id, score for all four modes in one pass over the postings."""
    found = matches(index, queries)
    modes = F.array(*[F.struct(F.lit(m).alias("query_type"), F.lit(s).alias("method"), F.col(s).alias("s")) for m in MODES for s in scoring.METHODS])
    long = found.select("query_id", "doc_id", "matched", "n_terms", F.explode(modes).alias("m")).select("*", "m.*")
    long = long.filter((F.col("query_type") == "disjunctive") | (F.col("matched") == F.col("n_terms")))
    return top(long, "s", k, ["query_id", "query_type", "method"]).select("query_id", "query_type", "method", "rank", "doc_id", F.round("s", 6).alias("score"))
