"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A row descends the tree level by level. At each level every child gets a draw
``-ln(u) / weight`` where ``u`` comes from the MD5 of the key and the child's path; the
smallest draw wins. A child's draw depends on nothing but the key, its own path and its
own weight, so a changed weight moves rows only between that child and its siblings, and a
new top-level child only takes rows. Everything is JVM-side expressions: no shuffle is
needed to place a row.

Defined cases: a null key hashes as the empty string (all such rows share one shard);
equal keys always share a shard; repeated rows get a slot each; a null text has size 1 and the CRC
of no bytes, 0; a very long text is read whole, for its size and CRC; other columns of the input
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table


@dataclass(frozen=True)
class Topology:
    """``regions[i][j][k]`` is the weight of a shard; shards are numbered depth first."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def balanced(regions: int, racks: int, shards: int) -> Topology:
        return Topology(tuple(tuple((1.0,) * shards for _ in range(racks)) for _ in range(regions)))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grow(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own.

        Every old node keeps its weight, so rows move only into the new shard. (A shard put
        into an existing rack would raise that rack's and its region's weight, and rows
        drawn to the region would also land in its older shards.)
        """
        return Topology((*self.regions, ((weight,),)))


def draw(key: Column, path: str, weight: float) -> Column:
    """Exponential draw of rate ``weight``: 52 bits of MD5 as a uniform number in (0, 1)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{path}")).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, path: str, weights: list[float]) -> Column:
    """Index of the child with the smallest draw; children of weight 0 get nothing."""
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError(f"node {path or 'root'} has no child of positive weight")
    if len(live) == 1:
        return F.lit(live[0][0])
    draws = [F.struct(draw(key, f"{path}{i}", w).alias("d"), F.lit(i).alias("i")) for i, w in live]
    return F.array_min(F.array(*draws))["i"]


def place(df: DataFrame, key: Column, topology: Topology, out: str = "shard") -> DataFrame:
    """Add ``out``: the shard of each row. Narrow: no shuffle.

    The chosen node of each level is a column of its own, so the branches of the next level
    are evaluated only for the one node that was chosen.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    region, rack = f"__{out}_region", f"__{out}_rack"
    weights = [[sum(r) for r in g] for g in topology.regions]
    df = df.withColumn(region, _pick(key, "", [sum(g) for g in weights]))

    def switch(col: Column, cases: list[Column]) -> Column:
        chosen = F.when(col == 0, cases[0])
        for i, case in enumerate(cases[1:], 1):
            chosen = chosen.when(col == i, case)
        return chosen

    df = df.withColumn(rack, switch(F.col(region), [_pick(key, f"{i}.", w) for i, w in enumerate(weights)]))
    first, by_region = 0, []
    for i, g in enumerate(topology.regions):
        by_rack = []
        for j, shards in enumerate(g):
            by_rack.append(_pick(key, f"{i}.{j}.", list(shards)) + F.lit(first))
            first += len(shards)
        by_region.append(switch(F.col(rack), by_rack))
    return df.withColumn(out, switch(F.col(region), by_region).cast("int")).drop(region, rack)


def number_slots(df: DataFrame, shard: str, row: str, buckets: int = 4096) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, without bringing a shard to one task.

    ``row`` is a number of each row's own, so rows that are equal otherwise part too. Rows fall into
    ``buckets`` hash buckets per shard; the counts of the buckets (a table of that fixed size
    times the shards) give each bucket's first slot, and a window numbers the rows of one
    bucket. ``df`` should be materialized: it is read twice.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))
    counts = df.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(shard, "__bucket").orderBy(row)
    return (
        df.withColumn("__i", F.row_number().over(within))
        .join(F.broadcast(first), [shard, "__bucket"])  # at most shards * buckets rows
        .withColumn("slot", F.col("__first") + F.col("__i") - F.lit(1))
        .drop("__bucket", "__i", "__first")
    )


def shard_documents(docs: DataFrame, topology: Topology) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    ``grown_shard`` is the shard under ``topology.grow()``. The text is read once, for its
    size and CRC; only narrow rows are shuffled.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1)).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
    )
    rows = place(rows, F.col("doc_id"), topology, "shard")
    rows = place(rows, F.col("doc_id"), topology.grow(), "grown_shard")
    rows = number_slots(scratch_table(rows.withColumn("__row", F.monotonically_increasing_id())), "shard", "__row")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
