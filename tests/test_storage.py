"""Readers, chunks, the compressed index, streaming and the command line."""

import gzip

import pytest
from pyspark.sql import functions as F

from quern import cli, scratch
from quern.functions import codec, text
from quern.operators import compressed, index, search
from quern.plans import queries as plans
from quern.sources import collection
from quern.streaming import incremental

PLAIN = text.TextOptions(stopwords=False, stemming=False)
ROWS = [(1, "apple banana apple"), (2, "apple cherry"), (3, "banana"), (4, "!!!"), (5, None), (70_000, "apple date"), (200_000, "date apple apple")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines_of_a_collection(spark, tmp_path):
    lines = [
        "9007199254740993\texact", "9223372036854775807\tlargest", "9223372036854775808\ttoo large", "nan\tx", "inf\tx", "-Infinity\tx", "1e3\tpower", "7.9\ttowards zero",
        "\t 8 \t a text \t ", "12d\tx", "\t9\tx", "5", "", "6\ta\tb", "\x1c10\tten\x1f", "1e400\tx", "+11\tplus", "-2\tnegative",
    ]
    (tmp_path / "c.tsv").write_text("\n".join(lines) + "\n")
    want = [(9007199254740993, "exact"), (2**63 - 1, "largest"), (1000, "power"), (7, "towards zero"), (8, " a text"), (9, "x"), (10, "ten"), (11, "plus"), (-2, "negative")]
    assert rows(collection.read_collection(spark, str(tmp_path / "c.tsv"))) == sorted(want)
    with gzip.open(tmp_path / "c.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    packed = collection.read_collection(spark, str(tmp_path / "c.gz"), 3)
    assert rows(packed) == sorted(want) and packed.rdd.getNumPartitions() == 3
    assert collection.count_lines(spark, str(tmp_path / "c.tsv")) == len(lines)


def test_queries_and_judgements_are_stripped_of_all_white_space(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("1\tone two\t\n\t 2\tthree \n3\n4\ta\tb\n 5\tfive \n")
    assert rows(collection.read_queries(spark, str(tmp_path / "q.tsv"))) == [(1, "one two"), (2, "three"), (5, "five")]
    (tmp_path / "r.txt").write_text("\t1 0 7 2\n2\t0  9223372036854775807\t-1 \t\n")
    assert rows(collection.read_qrels(spark, str(tmp_path / "r.txt"))) == [(1, 7, 2), (2, 2**63 - 1, -1)]
    for bad in ("x\tquery\n", "1.5\tquery\n"):
        (tmp_path / "bad.tsv").write_text(bad)
        with pytest.raises(Exception, match="not an integer"):
            collection.read_queries(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "bad.txt").write_text("1 0 x 2\n")
    with pytest.raises(Exception, match="not an integer"):
        collection.read_qrels(spark, str(tmp_path / "bad.txt")).collect()


def test_text_tables_and_lookups(spark, tmp_path):
    lengths = spark.createDataFrame([(1, 3), (2, 2), (1, 5)], "doc_id long, doc_len long")
    collection.write_pairs(lengths, str(tmp_path / "lengths"))
    assert rows(collection.read_doc_stats(spark, str(tmp_path / "lengths"))) == [(1, 5), (2, 2)]
    ids = spark.createDataFrame([(2,), (2,), (99,)], "doc_id long")
    assert rows(collection.documents_by_ids(docs(spark), ids)) == [(2, "apple cherry")]
    assert rows(collection.texts_of_ids(docs(spark), ids)) == [(2, "apple cherry"), (99, collection.MISSING)]
    seeded = [rows(collection.sample_documents(docs(spark), 3, seed=5)) for _ in range(2)]
    assert len(seeded[0]) == 3 and set(seeded[0]) <= set(ROWS)


def test_chunks_are_runs_of_the_order(spark):
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("doc_id")).repartition(5)
    got = rows(collection.chunk_of(many, 300).select("doc_id", "chunk"))
    assert got == [(i, i // 300) for i in range(1000)]
    assert collection.chunk_of(many.limit(0), 300).count() == 0


def test_small_tables_are_spread_and_large_ones_left(spark, monkeypatch, tmp_path):
    docs(spark).coalesce(1).write.parquet(str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d"))
    assert collection.spread(one, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.doc_id for r in collection.spread(one, "doc_id").collect()) == [i for i, _ in ROWS]
    with monkeypatch.context() as few:
        few.setattr(collection, "PART", 1)
        assert collection.spread(one, "doc_id").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    monkeypatch.setattr(collection, "SPREAD", 0)
    assert collection.spread(one, "doc_id").rdd.getNumPartitions() == 1


def test_blocks_of_a_list(spark):
    built = index.build_index(docs(spark), PLAIN)
    blobs = compressed.compress(built.postings)
    apple = {(r.block, r.n) for r in blobs.filter("term = 'apple'").collect()}
    assert apple == {(0, 2), (1, 1), (3, 1)}  # document 70,000 is the first block's next, 200,000 the fourth
    assert rows(compressed.decompress(blobs)) == rows(built.postings)
    assert rows(compressed.decompress(blobs.limit(0))) == []
    with pytest.raises(Exception, match="not negative"):
        compressed.compress(spark.createDataFrame([("x", -5, 1)], "term string, doc_id long, tf long")).collect()


@pytest.mark.parametrize("blob", ["01", "0105", "01050607", "0200010002000300"])
def test_corrupt_blobs(spark, blob):
    df = spark.createDataFrame([(bytes.fromhex(blob),)], "b binary")
    if blob == "01":  # a width and no numbers: an empty list
        assert df.select(codec.decode(F.col("b"))[0].alias("i")).first()["i"] == []
    else:
        with pytest.raises(Exception, match="as many ids as frequencies"):
            df.select(*codec.decode(F.col("b"))).collect()


def test_decode_of_a_full_block(spark):
    ids = list(range(65_536))
    df = spark.createDataFrame([(ids, [i % 300 + 1 for i in ids])], "i array<long>, f array<long>").withColumn("b", codec.encode(F.col("i"), F.col("f")))
    found_ids, found_freqs = codec.decode(F.col("b"))
    assert df.select(((found_ids == F.col("i")) & (found_freqs == F.col("f"))).alias("same")).first()["same"]


def test_compressed_index(spark, tmp_path):
    whole = index.build_index(docs(spark), PLAIN)
    compressed.CompressedIndex.of(whole).save(str(tmp_path / "ix"))
    again = compressed.CompressedIndex.load(spark, str(tmp_path / "ix"), PLAIN)
    assert rows(again.plain().postings) == rows(whole.postings) and rows(again.terms()) == rows(whole.terms())
    assert rows(again.postings_of("apple")) == [(1, 2), (2, 1), (70_000, 1), (200_000, 2)]
    assert rows(again.postings_of("zebra")) == rows(again.blobs_of("zebra")) == []
    assert [r.block for r in again.blobs_of("date").orderBy("block").collect()] == [1, 3]
    q = spark.createDataFrame([(1, "apple date")], "query_id long, text string")
    assert rows(search.search(again.plain(), q, "disjunctive", "bm25")) == rows(search.search(whole, q, "disjunctive", "bm25"))


def test_compressed_merge_and_append(spark):
    parts = [index.build_index(docs(spark, ROWS[:4] + ROWS[5:6]), PLAIN), index.build_index(docs(spark, [(2, "apple apple"), (6, "banana"), ROWS[6]]), PLAIN)]
    packed = [compressed.CompressedIndex.of(p) for p in parts]
    merged, plain = compressed.merge_compressed_indices(packed), index.merge_indices(parts)
    for name in ("lexicon", "doc_stats", "stats"):
        assert rows(getattr(merged, name)) == rows(getattr(plain, name))
    assert rows(merged.plain().postings) == rows(plain.postings)
    assert rows(merged.postings_of("apple")) == [(1, 2), (2, 3), (70_000, 1), (200_000, 2)]
    more = packed[0].with_postings(parts[1].postings, parts[1].doc_stats)
    assert rows(more.blobs) == rows(merged.blobs) and rows(more.stats) == rows(merged.stats)
    assert compressed.merge_compressed([packed[0].blobs]) is packed[0].blobs
    with pytest.raises(ValueError):
        compressed.merge_compressed([])
    lists = [([1, 2, 3], [1, 2, 3]), ([2, 3, 4], [4, 5, 6])]
    blobs = [spark.createDataFrame([("t", i, f)], "term string, i array<long>, f array<long>").select("term", F.lit(0).cast("long").alias("block"), F.lit(3).cast("long").alias("n"), codec.encode(F.col("i"), F.col("f")).alias("blob")) for i, f in lists]
    both = compressed.merge_compressed(blobs)
    assert rows(compressed.decompress(both)) == [("t", 1, 1), ("t", 2, 6), ("t", 3, 8), ("t", 4, 6)] and both.first()["n"] == 4


def test_sample_index(spark):
    ix = index.build_sample_index(docs(spark), 3, options=PLAIN)
    assert ix.stats.first()["n"] == 3
    assert index.build_sample_index(docs(spark), 100, seed=1, options=PLAIN).stats.first()["n"] == len(ROWS)


def test_an_unstored_index_is_cleaned_once_per_search(spark, monkeypatch):
    ix = index.build_index(docs(spark), PLAIN)
    q = spark.createDataFrame([(1, "apple banana")], "query_id long, text string")
    found = search.search(ix, q, "disjunctive", "bm25")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(search.search(ix.cache(), q, "disjunctive", "bm25"))
    ix.uncache()
    cleaned = docs(spark).select(text.clean(F.col("text")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert cleaned.count("regexp_replace") == 5  # the chain stands in the plan once


def test_stream_is_indexed_by_batches(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "ix")
    for i, part in enumerate((ROWS[:3], ROWS[3:])):
        docs(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        incremental.append_stream(stream, path, str(tmp_path / "cp"), PLAIN).awaitTermination()
    got, want = incremental.load_appended(spark, path, PLAIN), index.build_index(docs(spark), PLAIN)
    for name in ("postings", "lexicon", "doc_stats", "stats"):
        assert rows(getattr(got, name)) == rows(getattr(want, name))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.tsv").write_text("1\tapple banana\n2\tapple cherry\n3\tcherry\n")
    (tmp_path / "q.tsv").write_text("1\tapple\n2\tcherry\n")
    (tmp_path / "r.txt").write_text("1 0 1 2\n1 0 2 1\n1 0 3 0\n")
    for more in ([], ["--compressed"]):
        cli.main(["build", str(tmp_path / "c.tsv"), str(tmp_path / "ix"), *more])
        cli.main(["search", str(tmp_path / "ix"), "cherry", "--mode", "disjunctive", *more])
        cli.main(["evaluate", str(tmp_path / "ix"), str(tmp_path / "q.tsv"), str(tmp_path / "r.txt"), *more])
        out = capsys.readouterr().out
        assert "|0       |1   |2     |" in out and "mean_ndcg" in out
    cli.main(["build", str(tmp_path / "c.tsv"), str(tmp_path / "one"), "--sample", "1"])
    assert index.Index.load(spark, str(tmp_path / "one")).stats.first()["n"] == 1


def test_conversation(spark):
    ix = index.build_index(docs(spark)).cache()
    given, said = iter(["", "apple cherry", "2", "bm25", "apple cherry", "9", "", "cherry", "", "", "zebra", "1", "1", "EXIT"]), []
    cli.converse(ix, spark, "conjunctive", "tfidf", 10, lambda _: next(given), said.append)
    ix.uncache()
    assert said[0].startswith("an empty query") and "document 2 " in said[1] and said.count("not one of the choices") == 1
    assert said[-1].startswith("no results") and any(s.startswith("1 results") for s in said)

    def ended(_):
        raise EOFError

    cli.converse(ix, spark, "conjunctive", "tfidf", 10, ended, said.append)


def test_registered_queries_have_sql():
    from quern.plans import oracles

    assert set(plans.queries()) >= set(oracles.oracle_sql())


def test_scratch_tables_are_released(spark):
    table = scratch.scratch_table(spark.range(3))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert table.count() == 3 and fs.exists(path)
    scratch.release(table, spark.range(1), None)
    assert not fs.exists(path)
