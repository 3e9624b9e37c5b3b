"""SimHash near-dedup: fingerprints, exact links by vantage-point trees, components.

1. Fingerprints (Arrow UDF): word shingles, XXH64 of each, majority per bit.
2. Distinct fingerprints: copies collapse before anything is compared.
3. A vantage-point tree over a bounded sample of the distinct fingerprints cuts the space
   into shards: at each node, ``d <= mu`` goes inside and ``d > mu`` outside. A fingerprint
   goes to its own shard and, where ``mu - radius < d <= mu``, to the outer side as well:
   two fingerprints within the radius that part at a node have the inner one in that band,
   so every such pair meets in some shard, whatever the sample was.
4. In each shard the same rule recurses in numpy down to small blocks, which are compared
   exactly. A shard gives each fingerprint's link to the smallest one it reaches within the
   shard: at most one row per fingerprint, never all pairs of a group.
   Shards that a bounded sample leaves too large get a tree of their own first.
5. Large-star/small-star rounds, each written, join the shards' links to components.

Defined cases: no words (null, empty or blank texts) give fingerprint zero, linked like any
other; very long texts are hashed whole, in pieces; extra columns are ignored by
``near_duplicates``; repeated rows share a fingerprint; a null doc_id takes its component's smallest
doc_id and counts for none (null if there is no other); an empty table gives none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, release, scratch_table, trimmed
from .shingle_sets import CHUNK, SEED, majority, similar_groups

#: Fingerprints compared all with all at a time.
BLOCK = 512
#: Points of a sample that a leaf of a tree stands for at least.
LEAST = 32


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of the words of ``text``: A-Z lower-cased, cut at ASCII white space."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # bytes: both know ASCII alone
    if not words:
        return 0
    if len(words) < shingle:
        return int.from_bytes(xxh64_digest(b" ".join(words), SEED), "big")
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for a in range(0, n, CHUNK):
        part = words[a : min(a + CHUNK, n) + shingle - 1]
        digests = b"".join([xxh64_digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)), strict=False)])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return majority(total, n)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """``docs`` with ``out``: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return trimmed(pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)) for texts in batches)

    return docs.withColumn(out, fp(F.col(text).cast("string")))


@dataclass
class Node:
    """A leaf if ``vantage`` is None."""

    leaf: int = -1
    vantage: np.uint64 | None = None
    mu: int = 0
    inner: Node | None = None
    outer: Node | None = None


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def split(points: np.ndarray, radius: int, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and radius ``mu`` that leave the larger side smallest; None if no
    choice tried takes a tenth off it."""
    best, least = None, 0.9 * len(points)
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        counts = np.bincount(distances(points, v), minlength=65).cumsum()
        for mu in {int(np.searchsorted(counts, len(points) * q)) for q in (0.4, 0.5, 0.6)}:
            band = counts[mu] - (counts[mu - radius] if mu >= radius else 0)
            larger = max(counts[mu], len(points) - counts[mu] + band)
            if larger < least:
                best, least = (v, mu), larger
    return best


def build_tree(sample: np.ndarray, leaf_size: int, radius: int) -> tuple[Node, int]:
    """(root, number of leaves) over a sample of distinct fingerprints in random order."""
    leaves = 0

    def grow(points: np.ndarray) -> Node:
        nonlocal leaves
        found = split(points, radius) if len(points) > leaf_size else None
        if not found:
            leaves += 1
            return Node(leaf=leaves - 1)
        v, mu = found
        d = distances(points, v)
        # the sample goes down as the queries do: leaves stand for what a shard will hold
        return Node(vantage=v, mu=mu, inner=grow(points[d <= mu]), outer=grow(points[d > mu - radius]))

    return grow(sample), leaves


def descend(node: Node, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, its points), for the points' own shards and those their bands reach."""
    if not len(points):
        return
    if node.vantage is None:
        yield node.leaf, points
        return
    d = distances(points, node.vantage)
    yield from descend(node.inner, points[d <= node.mu], radius)
    yield from descend(node.outer, points[d > node.mu - radius], radius)


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every link (and all that hangs on them) the smaller label, in place."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (low == labels[a]).all() and (low == labels[b]).all():
            return
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while (jump := labels[labels] != labels).any():
            labels[jump] = labels[labels[jump]]


def link(points: np.ndarray, radius: int) -> np.ndarray:
    """For sorted distinct points: the index of the smallest point that each one reaches."""
    labels = np.arange(len(points))

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        near = np.bitwise_count(points[left][:, None] ^ points[right][None, :]) <= radius
        i, j = np.nonzero(near)
        a, b = left[i], right[j]
        if (keep := a < b).any():
            _settle(labels, a[keep], b[keep])

    def go(index: np.ndarray) -> None:
        found = split(points[index], radius) if len(index) > BLOCK else None
        if found:
            d = distances(points[index], found[0])
            go(index[d <= found[1]])
            go(index[d > found[1] - radius])
            return
        for x in range(0, len(index), BLOCK):
            for y in range(x, len(index), BLOCK):
                compare(index[x : x + BLOCK], index[y : y + BLOCK])

    if len(points):
        go(np.arange(len(points)))
    return labels


def links(fps: DataFrame, radius: int, shard_size: int = 8192, sample_size: int = 65_536) -> DataFrame:
    """(u, v) with u > v: links that connect all distinct ``fp`` within ``radius`` bits.

    ``sample_size`` bounds what reaches the driver (8 bytes each); it only shapes the tree. Where
    the sample is too thin for shards of ``shard_size``, shards that came out larger are divided by
    trees of their own (``divided``).
    """
    n = fps.count()
    taken = fps.orderBy(F.xxhash64("fp")).limit(sample_size).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    leaf = max(LEAST, int(shard_size * len(taken) / max(n, 1)))
    root, leaves = build_tree(taken, leaf, radius)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, points in descend(root, b["fp"].to_numpy(np.int64).view(np.uint64), radius):
                yield pd.DataFrame({"shard": np.int64(shard), "fp": points.view(np.int64)})

    def within(shard: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(shard["fp"].to_numpy(np.int64).view(np.uint64))
        labels = link(points, radius)
        moved = labels != np.arange(len(points))
        u, v = points[moved].view(np.int64), points[labels[moved]].view(np.int64)
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    shards = fps.select("fp").mapInPandas(assign, "shard long, fp long")
    if leaf * n > shard_size * max(1, len(taken)):
        shards = divided(scratch_table(shards), leaves, radius, shard_size, sample_size)
    return shards.groupBy("shard").applyInPandas(within, "u long, v long")


def divided(shards: DataFrame, leaves: int, radius: int, shard_size: int, sample_size: int) -> DataFrame:
    """``shards`` (shard, fp; materialized) with those over ``shard_size`` rows cut again.

    Each gets a tree over about ``sample_size / 16`` of its own rows, built in a task. The trees
    together are at most ``leaves`` times a small tree, and so is what is broadcast. The same band
    rule holds on this level, so no pair within the radius is parted.
    """
    spark, most = shards.sparkSession, max(2 * LEAST, sample_size // 16)
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard_size)
    sampled = shards.join(F.broadcast(sizes), "shard")  # at most a row per leaf
    sampled = sampled.filter(F.pmod(F.xxhash64(F.lit("tree"), "fp"), F.lit(1 << 30)) < F.lit(float(most) * (1 << 30)) / F.col("n"))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(h=group["fp"].to_numpy(np.int64) * np.int64(0x5851F42D4C957F2D)).sort_values("h")
        points = group["fp"].to_numpy(np.int64).view(np.uint64)
        tree, _ = build_tree(points, max(LEAST, int(shard_size * len(points) / group["n"].iloc[0])), radius)
        return pd.DataFrame({"shard": group["shard"].iloc[:1].to_numpy(), "tree": [pickle.dumps(tree)]})

    trees = {r["shard"]: pickle.loads(r["tree"]) for r in sampled.groupBy("shard").applyInPandas(grow, "shard long, tree binary").collect()}
    sent = spark.sparkContext.broadcast(trees)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, group in b.groupby("shard", sort=False):
                if shard not in sent.value:
                    yield group
                    continue
                for leaf, points in descend(sent.value[shard], group["fp"].to_numpy(np.int64).view(np.uint64), radius):
                    yield pd.DataFrame({"shard": np.int64(leaves + (shard << 24) + leaf), "fp": points.view(np.int64)})

    return shards.mapInPandas(assign, "shard long, fp long")


def connect(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(u, v): each node u of ``edges`` (u > v) that is not the least of its component, with
    the least v of it, by alternating large-star and small-star rounds.

    The number of rounds grows with the logarithm of the largest component; past
    ``most_rounds`` this raises, it never returns components that have not settled. All tables of
    a round are written, so its joins have scans on both sides and adaptive execution can split
    the rows of a large component's hub.
    """

    def stars(pairs: DataFrame) -> DataFrame:
        return scratch_table(pairs.filter("u != v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = stars(edges)
    last = state(edges)
    for _ in range(most_rounds if last[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stars(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = scratch_table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = stars(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))
        release(edges, least, large, low)
        edges, now = small, state(small)
        if now == last:
            return edges
        last = now
    if last[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges


def with_components(rows: DataFrame, radius: int = 2, fp: str = "fp", doc_id: str = "doc_id", shard_size: int = 8192, sample_size: int = 65_536) -> DataFrame:
    """``rows`` (materialized: they are read twice) with ``component_id``.

    The mapping has one row per distinct fingerprint; joined to the rows it is on a unique
    key, so adaptive execution can split a hot fingerprint's rows.
    """
    fps = scratch_table(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first")))
    roots = connect(links(fps, radius, shard_size, sample_size))
    # nodes that are the least of a component of several are not in u; they join as themselves
    grouped = scratch_table(fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp")))
    of_root = scratch_table(grouped.groupBy("root").agg(F.min("first").alias("__component")))
    mapping = scratch_table(grouped.join(of_root, "root").select(F.col("fp").alias("__fp"), "__component"))
    release(fps, roots, grouped, of_root)
    joined = rows.join(mapping, rows[fp] == F.col("__fp"))
    return joined.withColumn("component_id", F.col("__component")).drop("__fp", "__component")


def hex_fingerprint(fp: str):
    """16 lowercase hexadecimal digits of a signed long."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; only 16 bytes a row are shuffled."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch_table(with_fingerprint(src, shingle=shingle).select("doc_id", "fp"))
    return with_components(rows, radius).select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The columns of ``docs``, one document of each group of near copies: its smallest doc_id.

    Near copies share ``similarity`` of their word shingles, or are linked by others that do.
    Fingerprints within ``radius`` bits, found by vantage-point trees as above, are the first
    candidates; since most pairs of that similarity lie further apart, min-hash bands give the
    others, and every link is checked on the shingle sets (see ``shingle_sets``).

    Rows without a doc_id come after all others of their group; texts without words, null ones
    among them, are copies of each other; very long texts are taken whole; of repeated rows and
    equal ids one stays; extra columns pass through; an empty table gives none.
    """
    names, row = docs.columns, free_name("__row", docs.columns)
    rows = scratch_table(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = similar_groups(rows, connect, lambda fps: links(fps, radius), row, "text", shingle, similarity)
    ids = rows.select(row, F.col("doc_id").alias("__id")).join(groups, row)
    kept = ids.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id"), F.col(row).alias("row"))).alias("m")).select(F.col("m.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*names)
