"""Scoring expressions: natural logarithms, idf unsmoothed and not clamped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("tfidf", "bm25")


def idf(n: Column, df: Column) -> Column:
    return F.log(n.cast("double") / df)


def tfidf(tf: Column, df: Column, n: Column) -> Column:
    return (F.lit(1.0) + F.log(tf.cast("double"))) * idf(n, df)


def bm25(tf: Column, df: Column, n: Column, doc_len: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """No (k1 + 1) factor; 0 for a document of length 0."""
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * doc_len / avgdl)
    return F.when(doc_len == 0, F.lit(0.0)).otherwise(idf(n, df) * tf / norm)


def score(method: str, tf: Column, df: Column, n: Column, doc_len: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    if method == "tfidf":
        return tfidf(tf, df, n)
    if method == "bm25":
        return bm25(tf, df, n, doc_len, avgdl, k1, b)
    raise ValueError(f"unknown scoring method {method!r}; one of {METHODS}")
