"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance d to it; the vectors of a pivot,
sorted by distance, are cut into blocks: annuli [lo, hi] of bounded size. For a query q at
distance D from the pivot the triangle inequality gives ``|q - x| >= D - hi`` and
``>= lo - D`` for every x of the annulus, so with ``q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2``
no score there exceeds ``(|q|^2 + max|x|^2 - gap^2) / 2``; also ``q.x <= q.pivot + |q| hi``.
A query expands annuli in the order of this bound, starting about its own distance, and
stops at the first whose bound is below its k-th best score. Ties at the bound are read on,
so equal scores go to the smaller vec_id exactly.

The first pass reads each query's best-bound blocks only and gives it a k-th best score to
start from; the second goes over the whole index, a partition a task, each task giving at
most k rows a query. Pivots are the ``pivots`` vectors of least hashed id: any set gives
exact results.

Components are integers. Scores are summed in doubles while no partial sum can reach 2^53;
beyond that in Python integers, slowly but exactly whatever their size. A score outside the
64-bit range counts as the nearest 64-bit integer.

Defined cases: see ``vectors``; fewer than k candidates give all; k = 0 and an empty table give
none; a vector whose scaled component passes the largest double takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Top, asking, blocks, in_batches, matrix, ranked, sample, unpack, usable

SLACK = 1e-9
#: Integers up to here are exact in the type.
SINGLE, DOUBLE = 2.0**24, 2.0**53
ENDS = ["cell", "d_lo", "d_hi", "norm_hi"]


class PivotIndex:
    """Blocks of integer vectors on disk; the pivots, a bounded number, on the driver."""

    def __init__(self, vectors: DataFrame, pivots: int = 64, block_rows: int = 2048):
        """``vectors``: vec_id long, v array<double> of integers."""
        spark = vectors.sparkSession
        size, largest = vectors.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
        self.width, self.largest = size or 1, largest or 0.0
        self.kind = "<f4" if self.largest <= SINGLE else "<f8"
        width, kind = self.width, self.kind
        chosen = sample(vectors, pivots).toPandas()
        self.pivots = matrix(chosen["v"], width) if len(chosen) else np.zeros((1, width))
        own = spark.sparkContext.broadcast(self.pivots)  # pivots * width doubles

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = own.value
            for b in batches:
                x = matrix(b["v"], width)
                with np.errstate(all="ignore"):  # squares of huge components: any cell will do
                    d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)))
                    cell = np.nan_to_num(d, nan=np.inf).argmin(1)
                    d = np.nan_to_num(np.sqrt(((x - p[cell]) ** 2).sum(1)), nan=np.inf)
                    norm = np.sqrt((x * x).sum(1))
                yield pd.DataFrame({"cell": cell.astype(np.int32), "d": d, "norm": norm, "vec_id": b["vec_id"], "x": [r.tobytes() for r in x.astype(kind)]})

        placed = vectors.mapInPandas(place, "cell int, d double, norm double, vec_id long, x binary")
        self.blocks = blocks(placed, ["cell", "d"], ["d", "norm"], width, block_rows)


def upper_bounds(pivots: np.ndarray, q: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (rows) in annuli (columns)."""
    with np.errstate(all="ignore"):
        p, nq = pivots[cell], (q * q).sum(1)[:, None]
        dot = q @ p.T
        dist = np.sqrt(np.maximum(0, nq - 2 * dot + (p * p).sum(1)))
        gap = np.maximum(0, np.maximum(dist - hi, lo - dist))
        ub = np.minimum((nq + norm * norm - gap * gap) / 2, dot + np.sqrt(nq) * hi)
        return np.nan_to_num(ub + SLACK * (1 + nq + norm * norm), nan=np.inf, posinf=np.inf)


def scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; Python integers where ``exact`` asks for them."""
    if not exact:
        return q @ x.T
    to_int, clip = np.frompyfunc(int, 1, 1), np.frompyfunc(lambda s: max(-(2**63), min(2**63 - 1, s)), 1, 1)
    return clip(to_int(q) @ to_int(x).T)


def scan(parts: Iterator[pd.DataFrame], index: tuple[np.ndarray, str, bool], ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Per-task search: the k best of each query among the blocks, none under ``least``."""
    pivots, kind, exact = index
    width, top = pivots.shape[1], Top(len(q), k, exact)
    floor = least.astype(np.float64)
    for part in parts:
        ub = np.maximum(upper_bounds(pivots, q, *(part[c].to_numpy() for c in ENDS)), -(2.0**63))
        for j in np.argsort(-ub.max(axis=0, initial=-np.inf), kind="stable"):
            # scores are kept negated: smaller is better; a bound equal to the k-th best is read
            worst = np.array([-np.inf if w == top.none else -float(w) for w in top.worst()]) if exact else -top.worst()
            active = np.flatnonzero(ub[:, j] >= np.maximum(worst, floor))
            if not len(active):
                continue
            own, x = unpack(part["ids"].iloc[j], part["x"].iloc[j], width, kind)
            for a, s in zip(active, scores(q[active], x, exact), strict=True):
                mine = (own != ids[a]) & (-s <= top.worst()[a]) & (s >= least[a])
                if mine.any():
                    top.add(a, -s[mine], own[mine])
    i, found, keys, _ = top.found()
    if len(i):
        yield pd.DataFrame({"query_id": ids[i], "vec_id": found, "score": np.array([-int(x) for x in keys], np.int64)})


def best_blocks(parts: Iterator[pd.DataFrame], pivots: np.ndarray, q: np.ndarray, k: int, most: int = 1024) -> Iterator[pd.DataFrame]:
    """Per task: for each query, numbered, the block of best bound among those of more than k
    rows, or among all where there are none; at most a row a query."""
    best = np.full(len(q), -np.inf)
    full = np.zeros(len(q), bool)
    ends = np.zeros((len(q), 3))
    for part in parts:
        for a in range(0, len(part), most):
            p = part.iloc[a : a + most]
            ub = upper_bounds(pivots, q, *(p[c].to_numpy() for c in ENDS))
            large = p["n"].to_numpy() > k
            if large.any():
                ub[:, ~large] = -np.inf
            j = ub.argmax(1)
            value, is_full = ub[np.arange(len(q)), j], large[j]
            better = (is_full & ~full) | ((is_full == full) & (value > best))
            best[better], full[better] = value[better], is_full[better]
            ends[better] = p[["cell", "d_lo", "d_hi"]].to_numpy()[j[better]]
    i = np.flatnonzero(best > -np.inf)
    if len(i):
        yield pd.DataFrame({"q": i, "full": full[i], "bound": best[i], "cell": ends[i, 0].astype(np.int32), "d_lo": ends[i, 1], "d_hi": ends[i, 2]})


def search(index: PivotIndex, queries: DataFrame, k: int = 10, batch: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every query (vec_id, v) against the index."""
    spark, schema = queries.sparkSession, "query_id long, vec_id long, score long"
    if k < 1:
        return ranked(spark.createDataFrame([], schema), 0, True)

    def one(batch_rows: pd.DataFrame) -> DataFrame:
        ids, q = batch_rows["vec_id"].to_numpy(np.int64), matrix(batch_rows["v"], index.width)
        exact = float(np.abs(q).max(initial=0)) * index.largest * index.width >= DOUBLE
        sent = spark.sparkContext.broadcast(((index.pivots, index.kind, exact), ids, q))  # at most batch rows
        least = np.full(len(ids), -np.inf, object if exact else np.float64)
        if len(ids):
            home = index.blocks.select(*ENDS, "n").mapInPandas(lambda p: best_blocks(p, sent.value[0][0], sent.value[2], k), "q long, full boolean, bound double, cell int, d_lo double, d_hi double")
            home = home.groupBy("q").agg(F.max_by(F.struct("cell", "d_lo", "d_hi"), F.struct("full", "bound")).alias("e")).select("e.*").distinct()
            near = index.blocks.join(home, ["cell", "d_lo", "d_hi"], "left_semi")
            nothing = np.full(len(ids), -np.inf, least.dtype)
            start = near.mapInPandas(lambda p: scan(p, *sent.value, nothing, k), schema)
            kth = ranked(start, k, True).filter(F.col("rank") == k).select("query_id", "score").toPandas()
            known = dict(zip(kth["query_id"].tolist(), kth["score"].tolist(), strict=True))
            least[:] = [known.get(i, -np.inf) for i in ids.tolist()]
        start_at = spark.sparkContext.broadcast(least)
        return index.blocks.mapInPandas(lambda p: scan(p, *sent.value, start_at.value, k), schema)

    return ranked(in_batches(asking(queries), batch, one), k, True)


def quantized(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): components floor(scale * x), x as double."""
    rows = usable(vectors, vec_id, vector, drop_zero=False)

    def scaled(x):
        y = F.lit(float(scale)) * x.cast("double")  # from 2^52 on, doubles are integers themselves
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)

    rows = rows.select("vec_id", F.transform("v", scaled).alias("v"))
    return rows.filter(F.forall("v", lambda x: F.abs(x) < F.lit(float("inf"))))
