"""Both vector searches against brute force: odd vectors, ties, repeated ids, large scores, few
candidates, partitions divided again, and empty tables."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from quern.llm import ann, oracles, topk_index


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int")


def vectors(spark, n=400, width=8):
    x = np.random.default_rng(3).normal(size=(n, width)).astype(np.float32)
    x[10:200] = x[10]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [None] * width), (n + 2, [float("nan")] * width), (n + 3, [0.0] * width), (None, [1.0] * width)]
    return frame(spark, rows), x.astype(np.float64)


def values(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def best_products(rows, queries, k=10):
    """``rows``: (id, integers); of rows that repeat a query's id the smallest asks."""
    out = []
    for i in sorted({i for i, _ in rows if i in queries}):
        q = min(v for j, v in rows if j == i)
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_topk_is_exact(spark):
    df, x = vectors(spark)
    rows = topk_index.quantized(df).cache()
    index = topk_index.PivotIndex(rows, 8, 32)
    plain = [(i, [int(c) for c in v]) for i, v in zip([*range(400), 403], np.floor(1024 * np.vstack([x, np.zeros(x.shape[1])])))]
    assert values(topk_index.search(index, rows.filter("vec_id % 100 = 0"), 10, batch=3)) == best_products(plain, {0, 100, 200, 300})
    assert topk_index.search(index, rows, 0).count() == 0
    none = rows.limit(0)
    assert topk_index.search(topk_index.PivotIndex(none), none, 10).count() == 0


def test_topk_with_repeated_ids_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (1, [-4.0, 1.0]), (2, [0.0, 0.0])]
    df = topk_index.quantized(frame(spark, rows))
    got = values(topk_index.search(topk_index.PivotIndex(df, 2, 2), df, 10))
    assert got == best_products([(i, [int(1024 * c) for c in v]) for i, v in rows], {0, 1, 2})
    assert Counter(v for q, _, v, _ in got if q == 0) == {1: 3, 2: 1}
    duckdb.register("embeddings", df.sparkSession.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").toPandas())
    assert sorted(duckdb.sql(oracles.OP3).fetchall()) == [r for r in got if r[0] == 0]
    duckdb.unregister("embeddings")


@pytest.mark.parametrize("scale", [2.0**15, 2.0**21, 2.0**60])
def test_large_scores_are_exact(spark, scale):
    r = np.random.default_rng(4)
    x = np.floor(r.normal(size=(60, 3)) * 1024 * 8)
    x[1:4] = [[scale * 1024, 1, 0], [scale * 1024, 2, 0], [scale * 1024, 3, 0]]
    x[0] = [scale * 1024, 1, 0]
    rows = [(i, (v / 1024).tolist()) for i, v in enumerate(x)]
    df = topk_index.quantized(frame(spark, rows, "double"))
    want = best_products([(i, [int(c) for c in v]) for i, v in enumerate(x)], {0, 50}, 10)
    clipped = [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in want]
    got = values(topk_index.search(topk_index.PivotIndex(df, 4, 16), df.filter("vec_id in (0, 50)"), 10))
    if scale < 2.0**40:
        assert got == want and [v for q, r, v, _ in got if q == 0][:3] == [3, 2, 1]
    else:  # scores past 2^63 tie at it
        assert [s for *_, s in got if s >= 2**62] == [s for *_, s in clipped if s >= 2**62] and [v for q, r, v, _ in got if q == 0][:3] == [1, 2, 3]


def check_nearest(got, x, ids, queries, k, recall):
    hits = total = 0
    for i in queries:
        d = np.sqrt(((x - x[ids.index(i)]) ** 2).sum(1))
        near = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(near) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(d[ids.index(r.vec_id)], abs=1e-12) for r in mine)
        hits, total = hits + len({j for _, j in near} & {r.vec_id for r in mine}), total + len(near)
    assert hits >= recall * total


def clusters(n=1500, width=16, seed=9):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, width)) * 4
    return centres[r.integers(0, 30, n)] + r.normal(size=(n, width)) * 0.6


@pytest.mark.parametrize("part_rows", [65_536, 90])
def test_ann_recall_on_clusters(spark, part_rows):
    x = clusters().astype(np.float32)
    rows = ann.usable_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).cache()
    index = ann.LearnedIndex(rows, parts=None if part_rows > 1000 else 6, part_rows=part_rows)
    queries = list(range(0, 1500, 25))
    got = ann.search(index, rows.filter("vec_id % 25 = 0"), 10, batch=20).collect()
    check_nearest(got, x.astype(np.float64), list(range(1500)), queries, 10, 0.9)
    assert index.sizes.sum() == 1500 and index.measured >= 0.92
    assert len(index.sizes) > 20 and bool(index.routers.below) == (part_rows == 90)
    assert index.read < 0.3  # the share of rows that a query reads


def test_ann_with_odd_vectors_and_none(spark):
    df, x = vectors(spark)
    rows = ann.usable_vectors(df).cache()
    got = ann.search(ann.LearnedIndex(rows, parts=4, block_rows=64), rows.filter("vec_id % 100 = 0"), 10).collect()
    assert len(got) == 40
    for i in (200, 300):
        check_nearest([r for r in got if r.query_id == i], x, list(range(400)), [i], 10, 0.8)
    assert {r.score for r in got if r.query_id == 100} == {0.0}
    assert ann.search(ann.LearnedIndex(rows.limit(0)), rows.limit(0), 10).count() == 0
    assert ann.search(ann.LearnedIndex(rows, parts=4), rows, 0).count() == 0


def test_ann_finds_k_where_there_are_k(spark):
    """20 groups of 40 equal vectors and 60 outliers, every row a query."""
    r = np.random.default_rng(8)
    x = np.vstack([np.repeat(r.normal(size=(20, 8)) * 3, 40, axis=0), r.normal(size=(60, 8)) * 30]).astype(np.float32)
    rows = ann.usable_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).cache()
    index = ann.LearnedIndex(rows)
    for probes in (None, 1):
        got = Counter(r.query_id for r in ann.search(index, rows, 10, probes=probes).collect())
        assert got == dict.fromkeys(range(860), 10)
    few = rows.filter("vec_id < 6 or vec_id = 350")
    got = Counter(r.query_id for r in ann.search(ann.LearnedIndex(few, parts=4), few, 10, probes=1).collect())
    assert got == dict.fromkeys([0, 1, 2, 3, 4, 5, 350], 6)


def test_ann_with_repeated_ids(spark):
    x = clusters(200, 4).astype(np.float32)
    rows = [(i // 3, v.tolist()) for i, v in enumerate(x)]
    df = ann.usable_vectors(frame(spark, rows)).cache()
    index = ann.LearnedIndex(df, parts=5)
    got = ann.search(index, df.filter("vec_id < 10"), 10, probes=len(index.sizes)).collect()
    for i in range(10):
        q = min(v for j, v in rows if j == i)
        want = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), j) for j, v in rows if j != i)[:10]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [j for _, j in want]
        assert [r.score for r in mine] == pytest.approx([d for d, _ in want], abs=1e-12)
    got = Counter(r.query_id for r in ann.search(index, df, 10, probes=1).collect())
    assert set(got.values()) == {10}
