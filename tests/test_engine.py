"""Golden values, round trips, invariants and error cases of the retrieval engine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import codec, text
from quern.functions.stemmer import stem
from quern.operators import compressed, evaluate, index, search
from quern.plans import queries as plans
from quern.sources import collection

PLAIN = text.TextOptions(stopwords=False, stemming=False)


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i long, text string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_clean(spark):
    cases = {
        "Visit https://example.com": "visit", "Check www.example.org": "check", "Go to http://site.com/path": "go to",
        "<html>Test</html>": "test", "<script>alert('Hi');</script>": None, "<style>.hidden{display:none;}</style>": None,
        "Hello, world!": "hello world", "Special chars #$%&*@!": "special chars", "": None, None: None, "Café": "cafe",
    }
    assert column(spark, list(cases), text.clean(F.col("text"))) == list(cases.values())


def test_tokenize(spark):
    cases = {
        "This is a test.": ["This", "is", "test"], "word1, word2!": ["word1", "word2"], "Hello-world, split-me.": ["Hello", "world", "split", "me"],
        "Remove 123 and 4567.": ["Remove", "and"], "": [], "Just single letters: a b c.": ["Just", "single", "letters"],
    }
    assert column(spark, list(cases), text.tokenize(F.col("text"))) == list(cases.values())


def test_pipeline(spark):
    cases = {
        "Visit https://example.com today!": ["visit", "today"], "Check www.example.org carefully.": ["check", "care"],
        "Numbers 123 and punctuation!": ["number", "punctuat"], "Punctuation-in words, like this.": ["punctuat", "word", "like"],
        "Complex example: subdomain.example.com/path.": ["complex", "exampl"], "Another test with 5678!": ["anoth", "test"],
        "Empty input case": ["empti", "input", "case"], None: [],
    }
    assert column(spark, list(cases), text.tokens(F.col("text"))) == list(cases.values())


def test_stemmer():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "happy": "happi", "relational": "relat", "dies": "die", "sky": "sky"}
    assert {w: stem(w) for w in pairs} == pairs


def test_stemmer_and_its_sql_agree():
    import duckdb

    from quern.plans import oracles

    bases = "a by cr hop fil fall oper yel syz enjoy trouble str dy yy ayy relat sens pl_y x9y glee controll generous rate ti agree conflat".split()
    ends = "s ed ing eed ied ies sses y ly ational tional izer bli alli fulli logi ousness iciti ative ness ement ion sion e ell ll er ance ization".split()
    words = sorted({b + e for b in bases for e in ["", *ends]} | {b + e + f for b in bases for e in ends for f in ends} | {"skies", "dying", "howe", "succeed", "s", "ss", "ly"})
    values = ", ".join(f"('{w}')" for w in words)
    found = dict(duckdb.sql(f"WITH words AS (SELECT * FROM (VALUES {values}) AS t(term)), {oracles.stems('words')} SELECT term, stem FROM stems").fetchall())
    assert {w: stem(w) for w in words if stem(w) != found[w]} == {} and len(found) > 15_000


@pytest.mark.parametrize(("ids", "freqs"), [([1, 5, 10], [2, 3, 1]), ([10, 1000, 100000], [1, 2, 3]), ([1], [1]), ([], []), (list(range(1, 1001)), [i % 10 + 1 for i in range(1000)])])
def test_codec(spark, ids, freqs):
    df = spark.createDataFrame([(ids, freqs)], "i array<long>, f array<long>").withColumn("b", codec.encode(F.col("i"), F.col("f")))
    row = df.select(F.hex("b"), *codec.decode(F.col("b"))).first()
    assert (row[1], row[2]) == (ids, freqs)
    known = {(1, 5, 10): "01010405020301", (10, 1000, 100000): "0300000A0003DE0182B8000001000002000003"}
    assert row[0] == known.get(tuple(ids), row[0])


def test_codec_rejects(spark):
    df = spark.createDataFrame([([1, 5], [2])], "i array<long>, f array<long>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(codec.encode(F.col("i"), F.col("f"))).collect()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


ROWS = [(1, "apple banana apple"), (2, "apple cherry"), (3, "banana"), (4, "!!!"), (5, None)]


def test_merge_equals_build_of_all(spark):
    whole = index.build_index(docs(spark, ROWS), PLAIN)
    parts = [index.build_index(docs(spark, ROWS[:2]), PLAIN), index.build_index(docs(spark, ROWS[2:]), PLAIN)]
    merged = index.merge_indices(parts)
    for name in ("postings", "lexicon", "doc_stats", "stats"):
        assert sorted(getattr(whole, name).collect()) == sorted(getattr(merged, name).collect())
    with pytest.raises(ValueError):
        index.merge_postings([])
    assert sorted(compressed.decompress(compressed.compress(whole.postings)).collect()) == sorted(whole.postings.collect())


def test_save_and_load(spark, tmp_path):
    built = index.build_index(docs(spark, ROWS), PLAIN)
    built.save(str(tmp_path / "ix"))
    again = index.Index.load(spark, str(tmp_path / "ix"), PLAIN)
    assert sorted(again.postings.collect()) == sorted(built.postings.collect())
    collection.write_pairs(built.lexicon, str(tmp_path / "lex"))
    assert sorted(collection.read_lexicon(spark, str(tmp_path / "lex")).collect()) == sorted(built.lexicon.collect())


def test_search(spark):
    ix = index.build_index(docs(spark, ROWS), PLAIN)
    q = spark.createDataFrame([(1, "apple banana"), (2, "apple zebra"), (3, "")], "query_id long, text string")
    conj = [(r.query_id, r.doc_id) for r in search.search(ix, q).collect()]
    disj = [(r.query_id, r.doc_id) for r in search.search(ix, q, "disjunctive", "bm25").collect()]
    assert conj == [(1, 1)]
    assert set(conj) < set(disj) and {d for i, d in disj if i == 2} == {1, 2}
    with pytest.raises(ValueError):
        search.search(ix, q, "fuzzy")
    with pytest.raises(ValueError):
        search.search(ix, q, "conjunctive", "cosine")


def test_reference_ndcg_of_all_misses(spark):
    qrels = spark.createDataFrame([(1, d, r) for d, r in enumerate((3, 2, 1, 0))], "query_id long, doc_id long, relevance int")
    runs = spark.createDataFrame([(1,)], "query_id long")
    none = spark.createDataFrame([], "query_id long, rank int, doc_id long")
    assert evaluate.ndcg_reference(none, qrels, runs, ["query_id"]).first()["ndcg"] == pytest.approx(0.8069, abs=1e-4)
    best = spark.createDataFrame([(1, d + 1, d) for d in range(4)], "query_id long, rank int, doc_id long")
    assert evaluate.ndcg_at_k(best, qrels, runs, ["query_id"]).first()["ndcg"] == pytest.approx(1.0)


def test_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tone text\nbad\n x\tno id\n2\ttwo\n3\ta\tb\n")
    assert sorted(map(tuple, collection.read_collection(spark, str(tmp_path / "c.tsv")).collect())) == [(1, "one text"), (2, "two")]
    (tmp_path / "q.txt").write_text("1 0 7 2\n")
    assert tuple(collection.read_qrels(spark, str(tmp_path / "q.txt")).first()) == (1, 7, 2)
    (tmp_path / "q.txt").write_text("1 0 7\n")
    with pytest.raises(Exception, match="four fields"):
        collection.read_qrels(spark, str(tmp_path / "q.txt")).collect()


def test_all_labelled_documents_are_judged(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in (1, 2, 3, 21, 45)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = plans.qrels(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.doc_id, r.relevance) for r in got) == [(q, i, i % 2 * 2 + i % 3 // 2) for q in (1, 2, 3, 5) for i in (1, 2, 3, 21, 45)]
    assert sorted(r[0] for r in plans.judged_queries(spark, str(tmp_path)).collect()) == [1, 2, 3, 5]


def plain_ndcg(judged, found):
    """The measures' definitions over the whole list of judgements."""
    gains = sorted(judged.values(), reverse=True)
    got = [judged.get(d, 0) for d in found] + [0] * (len(gains) - len(found))

    def dcg(g):
        return sum(x / math.log2(i + 2) for i, x in enumerate(g))

    best, best10 = dcg(gains), dcg(gains[:10])
    tied = {s: [g for g, t in zip(gains, got) if t == s] for s in got}
    shared = [sum(tied[s]) / len(tied[s]) for s in sorted(got, reverse=True)] if len(got) == len(gains) else []
    reference = dcg(shared) / best if len(found) <= len(gains) and len(gains) > 1 and best > 0 else 0
    return reference, dcg([judged.get(d, 0) for d in found[:10]]) / best10 if best10 > 0 else 0


def test_ndcg_matches_its_definition_over_all_judgements(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 7)
    r = random.Random(4)
    judged = {q: {d: r.choice((0, 0, 1, 2, 3) if q % 2 else (-2, -1, 0, 0, 1, 3)) for d in r.sample(range(300), n)} for q, n in enumerate((1, 2, 9, 10, 11, 40, 41, 200, 201, 3, 30))}
    judged[9], judged[10] = dict.fromkeys(judged[9], 0), dict.fromkeys(judged[10], 2)
    found = {q: r.sample(range(300), r.choice((0, 3, 10))) if q % 3 else [*r.sample(sorted(j), min(len(j), 8)), 999][:10] for q, j in judged.items()}
    qrels = spark.createDataFrame([(q, d, x) for q, j in judged.items() for d, x in j.items()], "query_id long, doc_id long, relevance int")
    ranked = spark.createDataFrame([(q, i + 1, d) for q, f in found.items() for i, d in enumerate(f)], "query_id long, rank int, doc_id long")
    runs = spark.createDataFrame([(q,) for q in judged], "query_id long")
    for place, measure in enumerate((evaluate.ndcg_reference, evaluate.ndcg_at_k)):
        got = {x.query_id: x.ndcg for x in measure(ranked, qrels, runs, ["query_id"]).collect()}
        assert got == pytest.approx({q: plain_ndcg(judged[q], found[q])[place] for q in judged}, abs=1e-12)
