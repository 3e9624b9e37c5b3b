"""What both vector searches share: valid vectors, query batches, blocks, the merge of tops.

Vectors of unequal length are compared as if the shorter ones ended in zeros. A row without
an id takes no part. Rows that repeat an id are candidates each, so an id may stand several times
among a query's results; all rows of the query's id are its own. Of rows that repeat the id of a
query the one with the smallest vector asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table


def valid(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def usable(vectors: DataFrame, vec_id: str, vector: str, drop_zero: bool) -> DataFrame:
    """(vec_id long, v) of the rows that take part; ``v`` keeps the components' type (float or
    double), so blocks of floats stay half the size. Narrow: no shuffle."""
    kind = dict(vectors.dtypes)[vector]
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    ok = F.col("vec_id").isNotNull() & valid(F.col("v"))
    if drop_zero:
        ok = ok & F.exists("v", lambda x: x != 0.0)
    return rows.filter(ok)


def asking(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of a query set, one row per id."""
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def sample(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, chosen by the hash of their id: the same at any partitioning."""
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(n)


def blocks(placed: DataFrame, by: list[str], keep: list[str], width: int, rows: int) -> DataFrame:
    """Pack rows (by..., vec_id, x binary) into written blocks of at most ``rows`` rows.

    Range partitioning includes vec_id, so a hot cell, or any number of equal vectors, is
    dealt over as many tasks as its size asks for. ``keep`` adds the ends of these columns.
    """
    ordered = placed.repartitionByRange(*by, "vec_id").sortWithinPartitions(*by, "vec_id")
    kinds = dict(placed.dtypes)
    schema = f"cell int, n int, {''.join(f'{c}_lo {kinds[c]}, {c}_hi {kinds[c]}, ' for c in keep)}ids binary, x binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cell, part in b.groupby("cell", sort=False):
                for a in range(0, len(part), rows):
                    p = part.iloc[a : a + rows]
                    ends = {f"{c}_{k}": f(p[c]) for c in keep for k, f in (("lo", min), ("hi", max))}
                    out.append({"cell": cell, "n": len(p), **ends, "ids": p["vec_id"].to_numpy(np.int64).tobytes(), "x": b"".join(p["x"])})
            yield pd.DataFrame(out)

    return scratch_table(ordered.mapInPandas(cut, schema))


def unpack(ids: bytes, x: bytes, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (as doubles) of a block whose components are stored as ``kind``."""
    return np.frombuffer(ids, np.int64), np.frombuffer(x, kind).reshape(-1, width).astype(np.float64)


class Top:
    """The k best of each query so far by (key ascending, vec_id ascending).

    Keys are doubles, or Python integers of any size where ``exact`` is set.
    """

    def __init__(self, n: int, k: int, exact: bool = False):
        self.k, self.none = k, 1 << 8192 if exact else np.inf
        self.keys = np.full((n, k), self.none, object if exact else np.float64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.extra = np.full((n, k), -1, np.int64)

    def worst(self) -> np.ndarray:
        return self.keys[:, -1]

    def add(self, query: int, keys: np.ndarray, ids: np.ndarray, extra: int = -1) -> None:
        """``extra`` is kept beside what ``keys`` and ``ids`` add."""
        more = np.concatenate([self.extra[query], np.full(len(ids), extra)])
        keys, ids = np.concatenate([self.keys[query], keys]), np.concatenate([self.ids[query], ids])
        best = np.lexsort((ids, keys)) if keys.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (keys[i], ids[i])))
        best = best[: self.k]
        self.keys[query], self.ids[query], self.extra[query] = keys[best], ids[best], more[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, key, extra) of what was found."""
        q, j = np.nonzero(self.keys < self.none)
        return q, self.ids[q, j], self.keys[q, j], self.extra[q, j]


def in_batches(queries: DataFrame, size: int, search: Callable[[pd.DataFrame], DataFrame]) -> DataFrame:
    """Union of ``search`` over query batches of about ``size`` rows each, the most that is
    held on the driver at once (a stated query set against all rows, in blocks)."""
    n = queries.count()
    parts = -(-n // size) if n else 1
    if parts == 1:
        return search(queries.toPandas())
    numbered = queries.withColumn("__batch", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    done = [scratch_table(search(numbered.filter(F.col("__batch") == i).drop("__batch").toPandas())) for i in range(parts)]
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def ranked(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query; every task gave at most k."""
    score = F.col("score").desc() if descending else F.col("score").asc()
    order = Window.partitionBy("query_id").orderBy(score, F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
