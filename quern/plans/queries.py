"""Registered queries of the retrieval engine over the harness tables.

Collection: ``documents``. Judgements: twice ``labels.quality`` plus ``labels.toxic`` of all
labelled documents, taken for each of four queries. Searches use the settings without stopwords and stemming, which SQL can restate; the
queries named ``stemmed_*`` use the full pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import codec, text
from quern.operators import compressed, evaluate, index, search
from quern.scratch import new_path
from quern.sources import collection

PLAIN = text.TextOptions(stopwords=False, stemming=False)
QUERIES = [(1, "thre thth"), (2, "tion ing"), (3, "thst eren ther"), (4, "best tion"), (5, "the thre the"), (6, "qqqq thre"), (7, "!!! 42")]
IDS = (0, 7, 42, 99, 7, 10**12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def query_set(spark: SparkSession, ids: tuple[int, ...] = ()) -> DataFrame:
    return spark.createDataFrame([q for q in QUERIES if not ids or q[0] in ids], "query_id long, text string")


def plain_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build_index(documents(spark, sf_dir), PLAIN)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("relevance"))
    return labels.crossJoin(F.broadcast(query_set(spark, (1, 2, 3, 5)).select("query_id")))  # four rows, whatever the table


def clean_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.clean(F.col("text")).alias("cleaned"))


def clean_pages(spark, sf_dir):
    pages = collection.spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", text.clean(F.col("html")).alias("cleaned"))


def tokenize_documents(spark, sf_dir):
    found = text.tokenize(text.ascii_text(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.array_join(found, " ").alias("tokens"))


def tokens_no_stopwords(spark, sf_dir):
    found = text.remove_stopwords(text.tokenize(text.clean(F.col("text"))))
    return documents(spark, sf_dir).select("doc_id", F.coalesce(F.array_join(found, " "), F.lit("")).alias("tokens"))


def stemmed_vocabulary(spark, sf_dir):
    built = index.build_index(documents(spark, sf_dir), text.TextOptions(stemming=False))
    return built.lexicon.select("term", text.stem_all(F.array("term"))[0].alias("stem"))


def stemmed_search(spark, sf_dir):
    built = index.build_index(documents(spark, sf_dir))
    return search.search(built, query_set(spark), "disjunctive", "bm25")


def doc_lengths(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("doc_len"))


def corpus_stats(spark, sf_dir):
    return plain_index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def postings(spark, sf_dir):
    return plain_index(spark, sf_dir).postings


def lexicon(spark, sf_dir):
    return plain_index(spark, sf_dir).lexicon


def posting_lists(spark, sf_dir):
    found = index.posting_lists(plain_index(spark, sf_dir).postings)
    return found.select("term", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"), F.array_join(F.col("frequencies").cast("array<string>"), ",").alias("frequencies"))


def index_stats(spark, sf_dir):
    return index.index_summary(plain_index(spark, sf_dir)).select("n_terms", "n_postings", F.round("avg_postings", 6).alias("avg_postings"))


def top_df_terms(spark, sf_dir):
    return plain_index(spark, sf_dir).lexicon.orderBy(F.desc("df"), "term").limit(20)


def parse_queries(spark, sf_dir):
    return search.parse_queries(query_set(spark), PLAIN).select("query_id", F.array_join("tokens", " ").alias("tokens"))


def term_lookup(spark, sf_dir):
    return plain_index(spark, sf_dir).postings_of("thre")


def term_lookup_missing(spark, sf_dir):
    terms = spark.createDataFrame([("thre",), ("qqqq",)], "term string")
    return plain_index(spark, sf_dir).term_info(terms)


def document_lengths_lookup(spark, sf_dir):
    ids = spark.createDataFrame([(i,) for i in sorted(set(IDS))], "doc_id long")
    return plain_index(spark, sf_dir).doc_lengths(ids)


def _search(ids, mode, method, **more):
    def run(spark, sf_dir):
        return search.search(plain_index(spark, sf_dir), query_set(spark, ids), mode, method, **more)

    return run


def search_batch_topk(spark, sf_dir):
    return search.search_all_modes(plain_index(spark, sf_dir), query_set(spark))


def codec_encode_hex(spark, sf_dir):
    return compressed.compress(plain_index(spark, sf_dir).postings).select("term", "block", "n", F.hex("blob").alias("blob"))


def codec_decode(spark, sf_dir):
    return compressed.decompress(compressed.compress(plain_index(spark, sf_dir).postings))


def codec_roundtrip(spark, sf_dir):
    lists = compressed.posting_blocks(plain_index(spark, sf_dir).postings)
    encoded = lists.withColumn("blob", codec.encode(F.col("doc_ids"), F.col("frequencies")))
    decoded = encoded.withColumn("again", codec.decode_lists(F.col("blob")))
    same = F.col("again") == F.struct("doc_ids", "frequencies")
    return decoded.agg(F.count("*").alias("n_blocks"), F.count_if(same).alias("n_same"))


def _stored_compressed(spark, sf_dir):
    path = new_path(spark)
    compressed.CompressedIndex.of(plain_index(spark, sf_dir)).save(path)
    return compressed.CompressedIndex.load(spark, path, PLAIN)


def compressed_save_load(spark, sf_dir):
    return _stored_compressed(spark, sf_dir).plain().postings


def compressed_term_lookup(spark, sf_dir):
    found = _stored_compressed(spark, sf_dir)
    decoded = found.postings_of("thre").select(F.lit("posting").alias("kind"), "doc_id", "tf", F.lit(None).cast("string").alias("blob"))
    blobs = found.blobs_of("thre").select(F.lit("blob").alias("kind"), F.col("block").alias("doc_id"), F.col("n").alias("tf"), F.hex("blob").alias("blob"))
    return decoded.union(blobs)


def compressed_search(spark, sf_dir):
    return search.search(_stored_compressed(spark, sf_dir).plain(), query_set(spark, (1, 2, 3)), "disjunctive", "bm25")


def merge_compressed(spark, sf_dir):
    parts = [compressed.CompressedIndex.of(p) for p in _halves(spark, sf_dir)]
    return compressed.merge_compressed_indices(parts).blobs.select("term", "block", "n", F.hex("blob").alias("blob"))


def compressed_append(spark, sf_dir):
    first, more = _halves(spark, sf_dir)
    return compressed.CompressedIndex.of(first).with_postings(more.postings, more.doc_stats).lexicon


def sample_index(spark, sf_dir):
    return index.build_sample_index(documents(spark, sf_dir), 100, options=PLAIN).lexicon


def index_terms(spark, sf_dir):
    return plain_index(spark, sf_dir).terms()


def _halves(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return [index.build_index(docs.filter(F.col("doc_id") % 2 == i), PLAIN) for i in (0, 1)]


def merge_indices(spark, sf_dir):
    return index.merge_indices(_halves(spark, sf_dir)).postings


def merge_lexicons(spark, sf_dir):
    return index.merge_lexicons([p.lexicon for p in _halves(spark, sf_dir)])


def fetch_documents_by_ids(spark, sf_dir):
    ids = spark.createDataFrame([(i,) for i in IDS], "doc_id long")
    return collection.texts_of_ids(documents(spark, sf_dir), ids)


def results_with_text(spark, sf_dir):
    return collection.with_text(_search((1,), "disjunctive", "bm25")(spark, sf_dir), documents(spark, sf_dir))


def sample_documents(spark, sf_dir):
    return collection.sample_documents(documents(spark, sf_dir), 100).select("doc_id")


def chunk_counts(spark, sf_dir):
    chunks = collection.chunk_of(documents(spark, sf_dir).select("doc_id"), 300)
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def judged_queries(spark, sf_dir):
    return evaluate.judged_queries(query_set(spark), qrels(spark, sf_dir)).select("query_id")


def _metrics(spark, sf_dir):
    return evaluate.evaluate_all_queries(plain_index(spark, sf_dir), query_set(spark), qrels(spark, sf_dir))


def ndcg_reference(spark, sf_dir):
    return _metrics(spark, sf_dir).withColumn("ndcg", F.round("ndcg", 6))


def ndcg_standard(spark, sf_dir):
    judged = evaluate.judged_queries(query_set(spark), qrels(spark, sf_dir))
    ranked = search.search_all_modes(plain_index(spark, sf_dir), judged)
    found = evaluate.ndcg_at_k(ranked, qrels(spark, sf_dir), evaluate.all_runs(judged), evaluate.BY)
    return found.withColumn("ndcg", F.round("ndcg", 6))


def mean_ndcg_by_mode(spark, sf_dir):
    return evaluate.mean_ndcg(_metrics(spark, sf_dir)).withColumn("mean_ndcg", F.round("mean_ndcg", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        clean_documents, clean_pages, tokenize_documents, tokens_no_stopwords, stemmed_vocabulary, stemmed_search, doc_lengths,
        corpus_stats, postings, lexicon, posting_lists, index_stats, top_df_terms, parse_queries, term_lookup, term_lookup_missing,
        document_lengths_lookup, search_batch_topk, codec_encode_hex, codec_decode, codec_roundtrip,
        compressed_save_load, compressed_term_lookup, compressed_search, merge_compressed, compressed_append, sample_index, index_terms, merge_indices, merge_lexicons,
        fetch_documents_by_ids, results_with_text, sample_documents, chunk_counts, judged_queries, ndcg_reference, ndcg_standard,
        mean_ndcg_by_mode,
    ]
    return {f.__name__: f for f in named} | {
        "search_conj_tfidf": _search((1, 2, 3), "conjunctive", "tfidf"),
        "search_conj_bm25": _search((1, 2, 3), "conjunctive", "bm25"),
        "search_disj_tfidf": _search((1, 2, 3), "disjunctive", "tfidf"),
        "search_disj_bm25": _search((1, 2, 3), "disjunctive", "bm25"),
        "search_dup_terms": _search((5,), "disjunctive", "tfidf"),
        "search_oov_conj": _search((4, 6), "conjunctive", "bm25"),
        "search_oov_disj": _search((4, 6), "disjunctive", "bm25"),
        "search_empty_query": _search((7,), "disjunctive", "tfidf"),
        "bm25_custom_params": _search((1, 2, 3), "disjunctive", "bm25", k1=0.9, b=0.4),
    }
