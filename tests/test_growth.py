"""What keeps time and memory of the index in step with the collection."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import compressed, index
from quern.sources import collection

PLAIN = text.TextOptions(stopwords=False, stemming=False)
ROWS = [(1, "apple banana apple"), (2, "apple cherry Äpfel"), (70_000, "apple date")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_decomposition_needs_no_python_and_equals_unicodedata(spark):
    texts = ["x".join(chr(i) for i in range(a, min(a + 999, 0x110000)) if not 0xD800 <= i < 0xE000) for a in range(1, 0x110000, 999)] + ["", "éﬁ ½㎯", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.ascii_text(F.col("t")).alias("a"))
    assert "Python" not in plan(df)
    assert all(r.a == (None if r.t is None else unicodedata.normalize("NFKD", r.t).encode("ascii", "ignore").decode()) for r in df.collect())


def test_urls_begin_inside_words_where_a_match_ended(spark):
    cases = {"a.bcd1e.fg h": "h", "xhttp://a.bc/d e": "x e", "www.com/x www.a.b1": "www a b1", "HTTPS://A.BC d": "d", "x-1.2.yz7": "7", "1.2.3": "1 2 3", "a  b. c": "a b c", "myvar var": "myvar"}
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").coalesce(1).select(text.clean(F.col("t"))).collect()]
    assert got == [*cases.values()]
    words = spark.createDataFrame([("a ab 1 12 _1a 1_ 7x é x" + "9" * 5000,)], "t string").select(text.words(F.col("t"), PLAIN).alias("w")).first()["w"]
    assert words == ["ab", "_1a", "7x", "x" + "9" * 5000]


def test_python_gets_single_words_to_stem(spark):
    assert "Python" not in plan(index.build_index(docs(spark), PLAIN).postings)
    stemmed = plan(index.build_index(docs(spark)).postings)
    assert "stem_each" in stemmed and "stem_all" not in stemmed


def test_large_tables_are_dealt_out_in_bounded_parts(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "d"))
    few = collection.spread(spark.read.parquet(str(tmp_path / "d")), "doc_id")
    postings = index.build_index(few, PLAIN).postings
    assert "RepartitionByExpression" in plan(few) and collection.PART <= 2 << 20 and collection.SPREAD > 6 << 30
    physical = postings._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1  # the texts', none of the postings


def test_saving_reads_the_collection_for_the_blobs_only(spark, tmp_path):
    whole = index.build_index(docs(spark), PLAIN)
    unread = whole.lexicon.select("term", F.raise_error(F.lit("read")).cast("long").alias("df"))
    compressed.CompressedIndex(compressed.compress(whole.postings), unread, whole.doc_stats, whole.stats.select(F.raise_error(F.lit("read")).cast("long").alias("n"), "avgdl"), PLAIN).save(str(tmp_path / "ix"))
    again = compressed.CompressedIndex.load(spark, str(tmp_path / "ix"), PLAIN)
    for name in ("lexicon", "stats"):
        assert sorted(map(tuple, getattr(again, name).collect())) == sorted(map(tuple, getattr(whole, name).collect()))


def test_merging_reads_the_parts_once(spark):
    parts = [compressed.compress(index.build_index(docs(spark).filter(F.col("doc_id") % 2 == i), PLAIN).postings) for i in (0, 1)]
    assert "regexp" not in plan(compressed.merge_compressed(parts))


def test_words_are_cut_without_passes_that_find_nothing(spark):
    cases = ["var x1 function", "Function.ab FUNCTION", "function.ab null", "wpb-js-composer xcomposer composer", "a <style b>push</style> c <i>onload</i>", "push.x y.com/z", "nullnull null", "café var-é", ".ab", "", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string").coalesce(1)
    found = df.select(text.words(F.col("t"), PLAIN).alias("w"), F.coalesce(text.tokenize(text.clean(F.col("t"))), F.array().cast("array<string>")).alias("e"))
    assert all(r.w == r.e for r in found.collect())
    assert [r.w for r in found.collect()][:4] == [["x1"], ["function"], ["ab"], ["xcomposer", "composer"]]
    physical = df.select(text.words(F.col("t"), PLAIN).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in physical and text.DOTTED in physical  # the condition for the other passes


def test_codec_sorts_no_rows_and_keeps_odd_lists(spark):
    postings = spark.createDataFrame([("a", d, 1 + d % 300) for d in range(0, 9000, 2)] + [("b", 65_535, 2**46), ("b", 65_536, 1), ("c", 0, 0)], "term string, doc_id long, tf long")
    again = compressed.decompress(compressed.compress(postings))
    assert "Window" not in plan(again)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, postings.collect()))
    with pytest.raises(Exception, match="a frequency must be from 0"):
        compressed.compress(postings.limit(1).withColumn("tf", F.lit(2**47))).collect()


def test_posting_lists_gather_longs_and_keep_odd_postings(spark):
    odd = [("a", 5, 2), ("a", -3, 1), ("a", 2**43 - 1, 2**20 - 1), ("a", 2**43, 1), ("a", 7, 2**20), ("a", 6, None), ("a", -(2**63), 4), ("a", 2**63 - 1, 1), ("b", 10, 1), ("b", 9, 3)]
    lists = index.posting_lists(spark.createDataFrame(odd, "term string, doc_id long, tf long"))
    found = {r.term: list(zip(r.doc_ids, r.frequencies, strict=True)) for r in lists.collect()}
    assert found == {t: sorted((d, f) for term, d, f in odd if term == t) for t in ("a", "b")}
    usual = index.posting_lists(spark.range(0, 4000, 1, 2).select(F.lit("a").alias("term"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("tf")))
    assert shuffled_bytes(usual) < 4000 * 12  # a struct of two longs takes 32 bytes and more


def shuffled_bytes(df):
    """Size of what the plan's first shuffle holds."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    while not plan.getClass().getSimpleName().startswith("ShuffleExchange"):
        plan = plan.plan() if plan.getClass().getSimpleName() == "ShuffleQueryStageExec" else plan.children().head()
    return plan.metrics().apply("dataSize").value()
