"""Groups of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Links between fingerprints of two bits find few of these pairs, and at the 16 bits that
would find them all, triangle bounds prune nothing; see the README for figures. So the
dedup of the pipeline starts from the fingerprint links, takes its other candidates from min-hash
bands and checks each pair exactly.

1. Arrow UDF: hashes of the distinct shingles of the whole text, a 128-bit digest of that set,
   the SimHash fingerprint of all shingles and ``BANDS`` keys of ``ROWS`` min-hashes (a pair at
   0.8 shares none in 3 of a million cases).
2. Equal sets collapse to one node.
3. Nodes of equal fingerprints, and nodes of linked fingerprints, are checked by their sets, and
   the links that hold join components.
4. In each of ``rounds`` rounds every node of a bucket (a band's key) is paired with two
   nodes of the bucket drawn anew: rows grow with nodes, not with pairs. Pairs within one
   component go; the others are checked by their sets, and links that hold join components.
   Buckets of three or fewer nodes are covered whole; in larger ones later rounds draw from
   what the bucket's largest component does not hold, so a group of copies that is joined
   costs nothing more.
5. What the draws left open is checked whole: in every bucket of more than three nodes that
   still holds several components, each node outside the largest one meets all nodes of the
   bucket, block by block (``open_links``); in a very large one it meets those alone with which
   it shares a rare shingle, as any two similar sets do. So every pair that shares a bucket is either
   checked or already in one component; no pair of nodes is ever a row.

Defined cases: texts without words (null, empty, blank) have the empty set and are one node; very
long texts are taken whole, in pieces; repeated rows are one node; an empty table gives none; of
the input only the columns named in the call are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, scratch_table, trimmed

BANDS, ROWS = 24, 4
SEED = 42
#: Shingles hashed, and hashes permuted, at a time.
CHUNK, STEP = 65_536, 4096
_r = np.random.default_rng(17)
_A = _r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes of which ``ones`` have each bit set, highest bit first."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, in pieces; fewer words are one shingle, none are none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: both know ASCII alone
    if words and len(words) < shingle:
        yield np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    for a in range(0, len(words) - shingle + 1, CHUNK):
        part = words[a : min(a + CHUNK, len(words) - shingle + 1) + shingle - 1]
        found = zip(*(part[i:] for i in range(shingle)), strict=False)
        yield np.array([xxh64_intdigest(b" ".join(s), SEED) for s in found], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    parts = [np.unique(h) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def set_and_fingerprint(text: str | None, shingle: int) -> tuple[np.ndarray, int]:
    parts, ones, n = [], np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
        parts.append(np.unique(h))
    whole = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)
    return whole, majority(ones, n)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band, as signed longs; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[a : a + STEP, None] * _A + _B).min(axis=0), out=least)
    blob = least.tobytes()
    keys = np.array([xxh64_intdigest(blob[8 * ROWS * j : 8 * ROWS * (j + 1)], j) for j in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def signatures(shingle: int) -> Callable[[Column], Column]:
    """Column function: struct of the set's digest (a, b), the fingerprint and the band keys."""

    def of(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh3_128_digest

        digests, fps, keys = [], [], []
        for t in texts:
            hashes, fp = set_and_fingerprint(t, shingle)
            digests.append(np.frombuffer(xxh3_128_digest(hashes.tobytes()), np.int64))
            fps.append(fp)
            keys.append(band_keys(hashes))
        d = np.array(digests, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": d[:, 0], "b": d[:, 1], "fp": np.array(fps, np.uint64).view(np.int64), "keys": keys})

    @F.pandas_udf("a long, b long, fp long, keys array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return trimmed(map(of, batches))

    return sign


def sets(shingle: int) -> Callable[[Column], Column]:
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return trimmed(pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts], dtype=object) for texts in batches)

    return of


def star_ends(placed: DataFrame, number: int) -> DataFrame:
    """(band, key, p, q): two drawn members of each bucket. Round 0 takes the two extreme draws; later
    rounds, in buckets of more than three nodes that hold several components, one draw from
    outside the bucket's largest component and one from all."""
    draw, outside, mixed = F.xxhash64(F.lit(number), "band", "key", "node"), F.lit(True), None
    if number:
        counts = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
        mixed = counts.groupBy("band", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("n"))
        mixed = scratch_table(mixed.filter("n > 3 and comps > 1").select("band", "key", "main"))
        placed = placed.join(mixed, ["band", "key"])
        outside = F.col("comp") != F.col("main")
    member = F.struct("node", "comp")
    ends = scratch_table(placed.groupBy("band", "key").agg(F.min_by(member, F.when(outside, draw)).alias("p"), F.max_by(member, draw).alias("q")))
    release(mixed)
    return ends


def star_pairs(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, other): every node with the two drawn ones of each of its buckets, where they are of
    different components. Both sides are written tables, so a large bucket's rows can be split."""
    met = placed.join(ends, ["band", "key"]).select("node", "comp", F.explode(F.array("p", "q")).alias("end"))
    return met.filter("comp != end.comp").select("node", F.col("end.node").alias("other"))


def block_links(block: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(u, v): links from the nodes that ask to the others of the block, where they join
    components that the block's earlier links have not: at most one row per component."""
    asked, asks = block[~block["asks"]], block[block["asks"]]
    u, v, above = [], [], {}

    def root(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    if len(asked) and len(asks):
        size = asked["set"].map(len).to_numpy()
        hashes, codes = np.unique(np.concatenate(asked["set"].to_list()), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        nodes, comps = asked["node"].to_numpy(), asked["comp"].to_numpy()
        for node, comp, own in zip(asks["node"], asks["comp"], asks["set"], strict=True):
            known = np.zeros(len(hashes) + 1, bool)
            at = np.searchsorted(hashes, own)
            known[at[hashes[np.minimum(at, len(hashes) - 1)] == own]] = True
            both = np.add.reduceat(known[codes], starts, dtype=np.int64)
            near = np.flatnonzero((both >= similarity * (size + len(own) - both)) & (comps != comp))
            for other, first in zip(*np.unique(comps[near], return_index=True), strict=True):
                if root(int(other)) != root(int(comp)):
                    above[root(int(other))] = root(int(comp))
                    u.append(max(node, nodes[near[first]]))
                    v.append(min(node, nodes[near[first]]))
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def prefix_buckets(placed: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """(band, key, node, comp): the nodes of ``placed`` dealt anew, by the rarest hashes of their sets.

    With all hashes in one order, rarest first, two sets of at least ``similarity`` share one among
    the first ``n - ceil(similarity * n) + 1`` of each of them: more of the n may not be missing. A
    passage that many unlike texts share comes late in the order and brings none of them together.
    """
    nodes = placed.select("node", "comp").distinct()
    hashes = scratch_table(nodes.join(known, "node").select("node", "comp", F.size("set").alias("n"), F.explode("set").alias("key")))
    counts = scratch_table(hashes.groupBy("key").agg(F.count("*").alias("nodes")))
    order = Window.partitionBy("node").orderBy("nodes", "key")
    first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1
    ranked = hashes.join(counts.filter("nodes > 1"), "key")
    # hashes of one node alone come first and meet nothing: they only take places
    alone = hashes.join(counts.filter("nodes = 1"), "key", "left_semi").groupBy("node").agg(F.count("*").alias("taken"))
    ranked = ranked.join(alone, "node", "left").withColumn("place", F.row_number().over(order) + F.coalesce("taken", F.lit(0)))
    dealt = scratch_table(ranked.filter(F.col("place") <= first).select(F.lit(-1).alias("band"), "key", "node", "comp"))
    release(hashes, counts)
    return dealt


def open_links(placed: DataFrame, known: DataFrame, similarity: float, block_nodes: int = 256, block_hashes: int = 2**18, large: int = 1024) -> DataFrame:
    """(u, v): links that join all components of ``placed`` (band, key, node, comp) which share
    a bucket of more than three nodes and hold a pair of similar nodes there.

    Buckets of up to ``large`` nodes are checked as they are (``bucket_links``); the nodes of larger
    ones that hold several components meet by rare hashes instead, so that a passage which many
    unlike texts share does not bring them all together.
    """
    counts = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
    sizes = scratch_table(counts.groupBy("band", "key").agg(F.count("*").alias("comps"), F.sum("n").alias("n")).filter("n > 3 and comps > 1"))
    wide = sizes.filter(F.col("n") > large)
    small = placed.join(sizes.filter(F.col("n") <= large).select("band", "key"), ["band", "key"], "left_semi")
    found = bucket_links(placed, small, known, similarity, 3, block_nodes, block_hashes)
    if not wide.isEmpty():
        dealt = prefix_buckets(placed.join(wide.select("band", "key"), ["band", "key"], "left_semi"), known, similarity)
        by_hash = bucket_links(dealt, dealt, known, similarity, 1, block_nodes, block_hashes)
        both = scratch_table(found.union(by_hash).distinct())
        release(found, by_hash, dealt)
        found = both
    release(sizes)
    return found


def bucket_links(placed: DataFrame, chosen: DataFrame, known: DataFrame, similarity: float, least: int, block_nodes: int, block_hashes: int) -> DataFrame:
    """(u, v), written: links that join all components which share a bucket of more than ``least``
    nodes and hold a pair of similar nodes there; ``chosen`` has the rows of ``placed`` that are in
    the buckets to check.

    The nodes of a bucket are dealt to parts, and so are its nodes outside the largest
    component, which ask; a task gets one part of each, so neither a large bucket nor large
    sets gather in one task. A bucket of n nodes, m of which ask, takes about m * n /
    ``block_nodes`` rows.
    """
    sized = chosen.join(known.select("node", F.size("set").alias("hashes")), "node")
    counts = sized.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("hashes").alias("hashes"))
    mixed = counts.groupBy("band", "key").agg(F.max(F.struct("n", "comp", "hashes")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))

    def parts(n: Column, hashes: Column) -> Column:
        return F.greatest(F.ceil(n / block_nodes), F.ceil(hashes / block_hashes), F.lit(1)).cast("int")

    open_ones = mixed.filter((F.col("n") > least) & (F.col("comps") > 1))
    open_ones = scratch_table(open_ones.select(
        "band", "key", F.col("main.comp").alias("main"), parts(F.col("n"), F.col("hashes")).alias("parts"), parts(F.col("n") - F.col("main.n"), F.col("hashes") - F.col("main.hashes")).alias("ask_parts")
    ))
    met = placed.join(open_ones, ["band", "key"])
    part, ask_part = F.pmod(F.xxhash64(F.lit("part"), "node"), "parts").cast("int"), F.pmod(F.xxhash64(F.lit("ask"), "node"), "ask_parts").cast("int")
    ids = ["band", "key", "node", "comp"]
    asked = met.select(*ids, F.lit(False).alias("asks"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)).alias("ask_part"))
    asks = met.filter("comp != main").select(*ids, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), ask_part.alias("ask_part"))
    rows = asked.union(asks).join(known, "node")

    def within(block: pd.DataFrame) -> pd.DataFrame:
        return block_links(block, similarity)

    found = scratch_table(rows.groupBy("band", "key", "part", "ask_part").applyInPandas(within, "u long, v long").distinct())
    release(open_ones)
    return found


def fingerprint_pairs(nodes: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, other): nodes of equal fingerprints with the least of them, and the least nodes of
    fingerprints that ``close`` links; at most a row per node and one per link."""
    fps = scratch_table(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    equal = nodes.join(fps, "fp").filter("node != least").select("node", F.col("least").alias("other"))
    pairs = close(fps.select("fp"))
    linked = pairs.join(fps.select(F.col("fp").alias("u"), F.col("least").alias("node")), "u").join(fps.select(F.col("fp").alias("v"), F.col("least").alias("other")), "v")
    found = scratch_table(equal.union(linked.select("node", "other")))
    release(fps)
    return found


def similar_groups(rows: DataFrame, connect: Callable[[DataFrame], DataFrame], close: Callable[[DataFrame], DataFrame], row: str, text: str = "text", shingle: int = 5, similarity: float = 0.8, rounds: int = 2) -> DataFrame:
    """(``row``, __group): the group of every row of ``rows`` (materialized: read twice), as the
    smallest ``row`` in it. ``row`` is a unique long; ``connect`` maps links (u > v) to
    (u, v) with the least v of u's component, ``close`` fingerprints to links between them."""
    signed = scratch_table(rows.select(row, signatures(shingle)(F.col(text).cast("string")).alias("s")).select(row, "s.*"))
    # written, so that the join has no aggregate beside it and a hot set's rows can be split
    nodes = scratch_table(signed.groupBy("a", "b").agg(F.min(row).alias("node"), F.min_by("fp", row).alias("fp")))
    members = scratch_table(signed.select(row, "a", "b").join(nodes, ["a", "b"]).select(row, "node"))
    firsts = members.filter(F.col(row) == F.col("node")).select(row)
    keyed = signed.join(firsts, row, "left_semi").select(F.col(row).alias("node"), F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key")
    buckets = scratch_table(keyed.join(shared, ["band", "key"]))
    first_pairs = fingerprint_pairs(nodes.select("node", "fp"), close)
    release(signed, nodes)
    ends = first_pairs.select(F.explode(F.array("node", "other")).alias("node"))
    texts = rows.join(buckets.select("node").union(ends).select(F.col("node").alias(row)).distinct(), row, "left_semi")
    known = scratch_table(texts.select(F.col(row).alias("node"), sets(shingle)(F.col(text).cast("string")).alias("set")))
    left = known.select(F.col("node").alias("u"), F.col("set").alias("__x"))
    right = known.select(F.col("node").alias("v"), F.col("set").alias("__y"))
    size, other, both = F.size("__x"), F.size("__y"), F.size(F.array_intersect("__x", "__y"))
    placed, roots = buckets.withColumn("comp", F.col("node")), None

    def held(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()
        sized = pairs.join(left, "u").join(right, "v").filter(F.least(size, other) >= F.lit(similarity) * F.greatest(size, other))
        return scratch_table(sized.filter(both >= F.lit(similarity) * (size + other - both)).select("u", "v"))

    def joined(more: DataFrame) -> None:
        """Components by all links so far: those before, as stars, and ``more``."""
        nonlocal placed, roots
        if more.isEmpty():
            return release(more)
        old, roots = roots, connect(more if roots is None else roots.union(more))
        release(old, more)
        own = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, placed = placed, scratch_table(buckets.join(own, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("comp")))
        release(before)

    joined(held(first_pairs))
    release(first_pairs)
    for number in range(rounds):
        ends = star_ends(placed, number)
        joined(held(star_pairs(placed, ends)))
        release(ends)
    joined(open_links(placed, known, similarity))
    release(known, placed, buckets)
    if roots is None:
        return members.withColumnRenamed("node", "__group")
    own = roots.select(F.col("u").alias("node"), F.col("v").alias("__root"))
    return members.join(own, "node", "left").select(row, F.coalesce("__root", "node").alias("__group"))
