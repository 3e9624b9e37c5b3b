"""Approximate nearest neighbours by learned partitions.

Fitted on a bounded sample (``sample_size`` vectors of least hashed id): a k-nearest-neighbour
graph, a balanced partitioning of that graph, and a small classifier (one hidden layer) that
learns each vector's partition from the partitions of its neighbours. Their number grows with
the root of the table, up to one for 32 vectors of the sample; from there on every partition of
more than ``part_rows`` rows is divided again by a classifier of its own, fitted in a task on at
most about ``sample_size`` of its rows. Then every row of the table is indexed in the partition
found most probable; a query goes to its most probable partitions and reranks their rows by
exact Euclidean distance in double precision.

How many partitions a query reads is measured on the table itself: up to ``tries`` vectors, held
out of the fitting, are searched in all partitions, and ``probes`` is the least number of most
probable partitions that holds the share ``recall`` of their true k nearest. ``measured`` and
``read`` keep the recall and the share of the table's rows that this gave.

A partition is stored in blocks of bounded size over as many tasks as it needs, so a hot
one (equal vectors by the thousand) is read by many tasks, each giving at most k rows a
query. Partitions of the index are not balanced: a query whose most probable ones hold too few
rows takes further ones, in order of probability, until they hold k rows of other ids.

Defined cases: see ``vectors``; zero vectors take no part; equal distances go to the smaller
vec_id; fewer than k candidates in the whole table give those; k = 0 and an empty table give
none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table
from .vectors import Top, asking, blocks, in_batches, matrix, ranked, sample, unpack, usable

#: Vectors of the sample for each partition at least.
SUPPORT = 32


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    k, norms = min(k, len(x) - 1), (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of about equal size that cut few edges of the graph.

    Starts from recursive halving along principal directions; then vertices move to the
    part that holds most of their neighbours, largest gain first, while it has room.
    """
    label, groups = np.zeros(len(x), np.int64), [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        g = groups.pop()
        centred = x[g] - x[g].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = g[np.argsort(centred @ axis, kind="stable")]
        groups += [order[: len(g) // 2], order[len(g) // 2 :]]
    for i, g in enumerate(groups):
        label[g] = i
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    edges = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        near = np.zeros((n, parts), np.int32)
        np.add.at(near, (edges[0], label[edges[1]]), 1)
        gain = near.max(1) - near[np.arange(n), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            for to in np.argsort(-near[v], kind="stable")[:3]:
                if near[v, to] > near[v, label[v]] and size[to] < room:
                    size[label[v]] -= 1
                    size[to] += 1
                    label[v], moved = to, moved + 1
                    break
        if not moved:
            break
    return label


class Router:
    """One hidden layer and a softmax over partitions, trained by Adam."""

    def __init__(self, width: int, parts: int, hidden: int = 128, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, (2 / width) ** 0.5, (width, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        self.shift, self.scale = np.zeros(width), 1.0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (x - self.shift) * self.scale
        h = np.maximum(0, x @ self.p[0] + self.p[1])
        z = h @ self.p[2] + self.p[3]
        e = np.exp(z - z.max(1, keepdims=True))
        return x, h, e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[2]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 2e-3) -> None:
        self.shift = x.mean(0)
        self.scale = 1.0 / max(float(np.std(x - self.shift)), 1e-300)
        r = np.random.default_rng(11)
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                z, h, y = self.forward(x[i])
                dz = (y - target[i]) / len(i)
                dh = (dz @ self.p[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((z.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def learn(x: np.ndarray, parts: int, graph_k: int = 10, hidden: int = 128) -> Router:
    """The router for the balanced partitioning of the neighbour graph of ``x``."""
    parts = max(1, min(parts, len(x)))
    router = Router(x.shape[1], parts, hidden)
    if len(x) < 2:
        return router
    graph = neighbour_graph(x, graph_k)
    label = balanced_partition(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), label] += 0.5
    router.fit(x, target)
    return router


@dataclass
class Routers:
    """The classifier of all rows, and those of the partitions that are divided again.

    Cells are the partitions that are left: ``first`` is the first cell of each partition.
    """

    top: Router
    below: dict[int, Router] = field(default_factory=dict)

    @property
    def first(self) -> np.ndarray:
        sizes = [self.below[i].p[3].size if i in self.below else 1 for i in range(self.top.p[3].size)]
        return np.concatenate([[0], np.cumsum(sizes)])

    def assign(self, x: np.ndarray) -> np.ndarray:
        part, first = self.top.probabilities(x).argmax(1), self.first
        cell = first[part]
        for i in np.unique(part):
            if i in self.below:
                cell[part == i] += self.below[i].probabilities(x[part == i]).argmax(1)
        return cell.astype(np.int32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p, first = self.top.probabilities(x), self.first
        out = np.repeat(p, np.diff(first), axis=1)
        for i, router in self.below.items():
            out[:, first[i] : first[i + 1]] *= router.probabilities(x)
        return out


class LearnedIndex:
    """Blocks of all rows by partition on disk; the classifiers on the driver."""

    def __init__(self, vectors: DataFrame, parts: int | None = None, sample_size: int = 8192, block_rows: int = 2048, k: int = 10, recall: float = 0.92, part_rows: int = 65_536, tries: int = 256):
        spark = vectors.sparkSession
        n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
        width = self.width = width or 1
        kind = self.kind = "<f4" if dict(vectors.dtypes)["v"] == "array<float>" else "<f8"
        chosen = sample(vectors, sample_size).toPandas()
        x = matrix(chosen["v"], width)
        held_out = len(x) // 8
        parts = parts or max(1, min(isqrt(n), (len(x) - held_out) // SUPPORT))
        self.routers = Routers(learn(x[held_out:], parts) if len(x) else Router(width, 1))
        sent = spark.sparkContext.broadcast(self.routers.top)  # fixed size: width, hidden, parts

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = matrix(b["v"], width)
                yield pd.DataFrame({"cell": sent.value.probabilities(x).argmax(1).astype(np.int32), "vec_id": b["vec_id"], "x": [r.tobytes() for r in x.astype(kind)]})

        placed = vectors.mapInPandas(place, "cell int, vec_id long, x binary")
        if n > part_rows:
            placed = self.divide(scratch_table(placed), part_rows, sample_size)
        self.blocks = blocks(placed, ["cell"], [], width, block_rows)
        self.sizes = np.zeros(self.routers.first[-1], np.int64)  # rows of each cell
        for cell, rows in self.blocks.groupBy("cell").agg(F.sum("n")).collect():
            self.sizes[cell] = rows
        self.probes, self.measured, self.read = len(self.sizes), 1.0, 1.0
        self.calibrate(chosen["vec_id"].to_numpy(np.int64)[: min(held_out, tries)], x[: min(held_out, tries)], k, recall)

    def divide(self, placed: DataFrame, part_rows: int, sample_size: int) -> DataFrame:
        """``placed`` with the partitions of more than ``part_rows`` rows cut into cells, each by
        a classifier fitted in a task on about ``sample_size`` of its rows."""
        width, kind, most = self.width, self.kind, sample_size // SUPPORT
        sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per partition
        large = {c: n for c, n in sizes.items() if n > part_rows}
        if large:
            rows = placed.sparkSession.createDataFrame([(c, min(1.0, sample_size / n), min(most, -(-n // part_rows))) for c, n in large.items()], "cell int, share double, parts int")
            part = placed.join(F.broadcast(rows), "cell")  # at most a row per partition
            part = part.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "x"), F.lit(1 << 20)) < F.col("share") * F.lit(1 << 20))

            def fit(group: pd.DataFrame) -> pd.DataFrame:
                group = group.sort_values(["vec_id", "x"])
                x = np.frombuffer(b"".join(group["x"]), kind).reshape(-1, width).astype(np.float64)
                return pd.DataFrame({"cell": group["cell"].iloc[:1].to_numpy(), "router": [pickle.dumps(learn(x, int(group["parts"].iloc[0])))]})

            found = part.groupBy("cell").applyInPandas(fit, "cell int, router binary").collect()  # a classifier of fixed size per partition
            self.routers.below = {r["cell"]: pickle.loads(r["router"]) for r in found}
        sent = placed.sparkSession.sparkContext.broadcast((self.routers.below, self.routers.first))

        def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            below, first = sent.value
            for b in batches:
                cell = first[b["cell"]]
                for c in set(b["cell"]) & below.keys():
                    rows = (b["cell"] == c).to_numpy()
                    x = np.frombuffer(b"".join(b["x"][rows]), kind).reshape(-1, width).astype(np.float64)
                    cell[rows] += below[c].probabilities(x).argmax(1)
                yield b.assign(cell=cell.astype(np.int32))

        return placed.mapInPandas(within, "cell int, vec_id long, x binary")

    def calibrate(self, ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> None:
        if not len(ids) or k < 1:
            return
        every = np.tile(np.arange(len(self.sizes)), (len(ids), 1))
        found = scanned(self, ids, q, every, k)
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        near = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("query_id", "cell").toPandas()  # tries * k rows
        if not len(near):
            return
        at = {i: j for j, i in enumerate(ids.tolist())}
        chosen = np.argsort(-self.routers.probabilities(q), axis=1, kind="stable")
        place = np.argsort(chosen, axis=1)  # of each cell among a row's choices
        needed = np.sort(place[[at[i] for i in near["query_id"]], near["cell"]])
        self.probes = int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1
        self.measured = float((needed < self.probes).mean())
        self.read = float(self.sizes[chosen[:, : self.probes]].sum(1).mean() / max(1, self.sizes.sum()))


def probed_cells(probabilities: np.ndarray, sizes: np.ndarray, probes: int, rows: np.ndarray) -> np.ndarray:
    """The cells that each query reads, padded with -1: its ``probes`` most probable ones,
    and as many more as it takes to hold ``rows`` rows, its own among them."""
    order = np.argsort(-probabilities, axis=1, kind="stable")
    short = np.cumsum(sizes[order], axis=1) < rows[:, None]
    needed = np.minimum(np.maximum(short.sum(1) + 1, probes), len(sizes))
    most = int(needed.max(initial=1))
    return np.where(np.arange(most) < needed[:, None], order[:, :most], -1)


def scan(parts: Iterator[pd.DataFrame], width: int, kind: str, ids: np.ndarray, q: np.ndarray, probed: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Per-task search: the k nearest of each query among the blocks of its cells."""
    top, norms = Top(len(q), k), (q * q).sum(1)
    asks, at = np.nonzero(probed >= 0)
    cells = probed[asks, at]
    order = np.argsort(cells, kind="stable")
    asks, cells = asks[order], cells[order]
    for part in parts:
        for cell, own, x in zip(part["cell"], part["ids"], part["x"], strict=True):
            active = asks[slice(*np.searchsorted(cells, [cell, cell + 1]))]
            if not len(active):
                continue
            own, x = unpack(own, x, width, kind)
            own_norms = (x * x).sum(1)
            rough = norms[active, None] - 2 * q[active] @ x.T + own_norms
            slack = 1e-9 * (norms[active] + own_norms.max() + 1)
            for a, r, s in zip(active, rough, slack, strict=True):
                other = own != ids[a]
                if (room := int(other.sum()) - k) > 0:  # what may be among the k best by exact distance
                    limit = min(np.partition(r[other], k - 1)[k - 1], top.worst()[a] ** 2) + 2 * s
                    other &= r <= limit
                if other.any():
                    gap = x[other] - q[a]
                    top.add(a, np.sqrt((gap * gap).sum(1)), own[other], cell)
    i, found, keys, cell = top.found()
    if len(i):
        yield pd.DataFrame({"query_id": ids[i], "vec_id": found, "score": keys, "cell": cell.astype(np.int32)})


def scanned(index: LearnedIndex, ids: np.ndarray, q: np.ndarray, probed: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, cell): each task's best of every query."""
    sent = index.blocks.sparkSession.sparkContext.broadcast((index.width, index.kind, ids, q, probed))
    return index.blocks.mapInPandas(lambda p: scan(p, *sent.value, k), "query_id long, vec_id long, score double, cell int")


def search(index: LearnedIndex, queries: DataFrame, k: int = 10, probes: int | None = None, batch: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (vec_id, v).

    ``probes`` defaults to what the index was calibrated to; a query reads more where these hold
    too few rows. Rows of the table that repeat a query's id should be in the query set too: they
    are no candidates, and their number is added to what the query must cover.
    """
    probes = probes or index.probes
    columns = ["query_id", "vec_id", "score"]
    if k < 1:
        return ranked(queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double"), 0, False)

    def one(rows: pd.DataFrame) -> DataFrame:
        ids, q = rows["vec_id"].to_numpy(np.int64), matrix(rows["v"], index.width)
        if not len(ids):
            return scanned(index, ids, q, np.zeros((0, 1), int), k).select(*columns)
        wanted = k + rows["own"].to_numpy()
        probed = [probed_cells(index.routers.probabilities(q[a : a + 256]), index.sizes, probes, wanted[a : a + 256]) for a in range(0, len(q), 256)]
        most = max(p.shape[1] for p in probed)
        probed = np.concatenate([np.pad(p, ((0, 0), (0, most - p.shape[1])), constant_values=-1) for p in probed])
        return scanned(index, ids, q, probed, k).select(*columns)

    # rows that repeat a query's id are not among its candidates, so that many more are looked for
    counts = queries.groupBy("vec_id").agg(F.count("*").alias("own"))
    return ranked(in_batches(asking(queries).join(counts, "vec_id"), batch, one), k, False)


def usable_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return usable(vectors, vec_id, vector, drop_zero=True)
