"""DuckDB SQL for the registered queries, put together from shared parts."""

from __future__ import annotations

from quern.functions.stemmer import IRREGULAR, STEP2, STEP3, STEP4
from quern.functions.stopwords import ENGLISH
from quern.functions.text import NOISE_WORDS

from .queries import IDS, QUERIES


def clean(col: str) -> str:
    c = f"regexp_replace(strip_accents({col}), '[^\\x00-\\x7F]', '', 'g')"
    steps = [
        ("<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "gs"),
        ("<[^>]+>", "g"),
        (r"\b(" + "|".join(NOISE_WORDS) + r")\b", "g"),
        (r"(https?://|www\.)?([a-z0-9-]+\.)+[a-z]{2,}(/[^\s\x1c-\x1f\x0b<>]*)?", "gi"),
        (r"[^\w\s\x0b\x1c-\x1f-]", "g"),
        (r"[\s\x0b\x1c-\x1f]+", "g"),
    ]
    for pattern, flags in steps:
        c = f"regexp_replace({c}, '{pattern}', ' ', '{flags}')"
    return f"nullif(lower(trim({c})), '')"


def tokenized(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '\\W+'), lambda w: length(w) >= 2 AND regexp_matches(w, '[A-Za-z]'))"


STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
TOKENS = tokenized(clean("text"))
KEPT = f"list_filter({TOKENS}, lambda t: t NOT IN ({STOP}))"
WORDS = "len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f]+'), lambda w: w != ''))"


def query_values(ids: tuple[int, ...] = ()) -> str:
    return "(VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in QUERIES if not ids or i in ids) + ") AS q(query_id, text)"


BASE = f"""postings AS (
  SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term, doc_id
), lexicon AS (
  SELECT term, count(*) AS df FROM postings GROUP BY term
), doc_stats AS (
  SELECT doc_id, ({WORDS})::BIGINT AS doc_len FROM documents
), stats AS (
  SELECT count(*) AS n, avg(doc_len) AS avgdl FROM doc_stats
)"""


def matches(ids: tuple[int, ...] = (), k1: float = 1.5, b: float = 0.75) -> str:
    idf = "ln(n::DOUBLE / df)"
    return f"""{BASE}, parsed AS (
  SELECT query_id, list_distinct({TOKENS}) AS terms FROM {query_values(ids)}
), wanted AS (
  SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM parsed
), found AS (
  SELECT query_id, doc_id, any_value(n_terms) AS n_terms, count(*) AS matched,
         sum((1 + ln(tf::DOUBLE)) * {idf}) AS tfidf,
         sum(CASE WHEN doc_len = 0 THEN 0 ELSE {idf} * tf / (tf + {k1} * ((1 - {b}) + {b} * doc_len / avgdl)) END) AS bm25
  FROM wanted JOIN postings USING (term) JOIN lexicon USING (term) JOIN doc_stats USING (doc_id), stats
  GROUP BY query_id, doc_id
)"""


def searched(ids: tuple[int, ...], mode: str, method: str, k1: float = 1.5, b: float = 0.75) -> str:
    only = "WHERE matched = n_terms" if mode == "conjunctive" else ""
    return f"""WITH {matches(ids, k1, b)}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({method}, 9) DESC, doc_id)::INT AS rank FROM found {only}
) SELECT query_id, rank, doc_id, round({method}, 6) AS score FROM ranked WHERE rank <= 10"""


MODES = "(VALUES ('conjunctive'), ('disjunctive')) AS m(query_type), (VALUES ('tfidf'), ('bm25')) AS s(method)"
ALL_MODES = """all_modes AS (
  SELECT query_id, query_type, method, doc_id, CASE method WHEN 'tfidf' THEN tfidf ELSE bm25 END AS s FROM found, MODES
  WHERE query_type = 'disjunctive' OR matched = n_terms
), top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_type, method ORDER BY round(s, 9) DESC, doc_id)::INT AS rank FROM all_modes
), best AS (
  SELECT * FROM top WHERE rank <= 10
)""".replace("MODES", MODES)

QRELS = """qrels AS (
  SELECT query_id, doc_id, quality * 2 + toxic AS relevance FROM labels, (VALUES (1), (2), (3), (5)) AS q(query_id)
), runs AS (
  SELECT * FROM (SELECT DISTINCT query_id FROM qrels), MODES
), ideal AS (
  SELECT r.*, relevance AS gain, row_number() OVER (PARTITION BY query_id, query_type, method ORDER BY relevance DESC, doc_id) AS position
  FROM runs r JOIN qrels USING (query_id)
)""".replace("MODES", MODES)

NDCG = f"""WITH {matches()}, {ALL_MODES}, {QRELS}, got AS (
  SELECT b.query_id, query_type, method, rank AS position, coalesce(relevance, 0) AS got
  FROM best b LEFT JOIN qrels q ON b.query_id = q.query_id AND b.doc_id = q.doc_id
), n_got AS (
  SELECT query_id, query_type, method, count(*) AS n_got FROM got GROUP BY ALL
), slots AS (
  SELECT i.*, coalesce(got, 0) AS got FROM ideal i LEFT JOIN got USING (query_id, query_type, method, position)
), shared AS (
  SELECT *, avg(gain) OVER (PARTITION BY query_id, query_type, method, got) AS mean_gain,
         row_number() OVER (PARTITION BY query_id, query_type, method ORDER BY got DESC, position) AS place FROM slots
), sums AS (
  SELECT query_id, query_type, method, sum(mean_gain / log2(place + 1)) AS dcg, sum(gain / log2(position + 1)) AS best, count(*) AS n FROM shared GROUP BY ALL
), metrics AS (
  SELECT query_id::BIGINT AS query_id, query_type, method,
         CASE WHEN coalesce(n_got, 0) <= n AND n > 1 AND best > 0 THEN dcg / best ELSE 0 END AS ndcg
  FROM sums LEFT JOIN n_got USING (query_id, query_type, method)
)"""

STANDARD = f"""WITH {matches()}, {ALL_MODES}, {QRELS}, top_ideal AS (
  SELECT query_id, query_type, method, sum(gain / log2(position + 1)) AS best FROM ideal WHERE position <= 10 GROUP BY ALL
), dcg AS (
  SELECT b.query_id, query_type, method, sum(relevance / log2(rank + 1)) AS dcg
  FROM best b JOIN qrels q ON b.query_id = q.query_id AND b.doc_id = q.doc_id GROUP BY ALL
)
SELECT query_id::BIGINT AS query_id, query_type, method, round(CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE 0 END, 6) AS ndcg
FROM top_ideal LEFT JOIN dcg USING (query_id, query_type, method)"""

BLOCKS = f"""WITH {BASE}, lists AS (
  SELECT term, doc_id // 65536 AS block, count(*) AS n, list(doc_id % 65536 ORDER BY doc_id) AS ids, list(tf ORDER BY doc_id) AS freqs FROM postings GROUP BY ALL
), nums AS (
  SELECT term, block, n, list_concat(list_transform(ids, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - ids[i - 1] END), freqs) AS v FROM lists
), sized AS (
  SELECT *, CASE WHEN list_max(v) < 256 THEN 1 WHEN list_max(v) < 65536 THEN 2 WHEN list_max(v) < 16777216 THEN 3 ELSE 4 END AS w FROM nums
), encoded AS (
  SELECT term, block, n, printf('%02X', w) || array_to_string(list_transform(v, lambda x: lpad(printf('%X', x), w * 2, '0')), '') AS blob FROM sized
)"""
ENCODED = f"{BLOCKS} SELECT * FROM encoded"


def marked(w: str) -> str:
    """The word with consonant y's as Y: at the start, and after a vowel."""
    return f"regexp_replace(regexp_replace({w}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"


def fits(w: str, pattern: str) -> str:
    return f"regexp_matches({marked(w)}, '{pattern.replace('V', '[aeiouy]').replace('C', '[^aeiouy]')}')"


def turns(w: str, at_least: int) -> str:
    return fits(w, "^C*" + "V+C+" * at_least)


def short(w: str) -> str:
    return f"({fits(w, 'CV[^aeiouywxY]$')} OR {fits(w, '^VC$')})"


def suffixes(table: list[tuple[str, str, str]]) -> str:
    """The first suffix that the word ends in decides: (suffix, replacement, condition)."""
    return "CASE " + " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {on} THEN left(w, -{len(s)}) || '{to}' ELSE w END" for s, to, on in table) + " ELSE w END"


def stems(words: str) -> str:
    """CTEs up to ``stems(term, stem)`` for the rows ``term`` of the CTE ``words``: the steps of the
    suffix stripping, each a table of its own."""
    longest = lambda table: sorted(table, key=lambda x: -len(x[0] if isinstance(x, tuple) else x))
    cut = "left(w, -CASE WHEN ends_with(w, 'ed') THEN 2 ELSE 3 END)"
    steps = [
        "CASE WHEN ends_with(w, 'sses') THEN left(w, -2) WHEN ends_with(w, 'ies') THEN left(w, CASE WHEN length(w) = 4 THEN -1 ELSE -2 END) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, -1) ELSE w END",
        f"""CASE WHEN ends_with(w, 'ied') THEN left(w, CASE WHEN length(w) = 4 THEN -1 ELSE -2 END)
             WHEN ends_with(w, 'eed') THEN CASE WHEN {turns("left(w, -3)", 1)} THEN left(w, -1) ELSE w END
             WHEN (ends_with(w, 'ed') OR ends_with(w, 'ing')) AND {fits(cut, "V")} THEN
               CASE WHEN regexp_matches({cut}, '(at|bl|iz)$') THEN {cut} || 'e'
                    WHEN length({cut}) > 1 AND right({cut}, 1) = left(right({cut}, 2), 1) AND {fits(cut, "C$")}
                    THEN CASE WHEN right({cut}, 1) IN ('l', 's', 'z') THEN {cut} ELSE left({cut}, -1) END
                    WHEN {fits(cut, "^C*V+C+V*$")} AND {short(cut)} THEN {cut} || 'e' ELSE {cut} END
             ELSE w END""",
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND {fits('left(w, -1)', 'C$')} THEN left(w, -1) || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {turns('left(w, -4)', 1)} THEN left(w, -2) ELSE w END",
        suffixes([(x, to, turns(f"left(w, -{3 if x == 'logi' else len(x)})", 1)) for x, to in longest(STEP2)]),
        suffixes([(x, to, turns(f"left(w, -{len(x)})", 1)) for x, to in STEP3]),
        suffixes([(x, "", turns(f"left(w, -{len(x)})", 2) + (" AND regexp_matches(left(w, -3), '[st]$')" if x == "ion" else "")) for x in longest(STEP4)]),
        f"CASE WHEN ends_with(w, 'e') AND ({turns('left(w, -1)', 2)} OR ({turns('left(w, -1)', 1)} AND NOT {short('left(w, -1)')})) THEN left(w, -1) ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {turns('left(w, -1)', 2)} THEN left(w, -1) ELSE w END",
    ]
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    ctes = [f"stem_0 AS (SELECT DISTINCT term, lower(term) AS w FROM {words})"]
    ctes += [f"stem_{i} AS MATERIALIZED (SELECT term, {step} AS w FROM stem_{i - 1})" for i, step in enumerate(steps, 1)]
    final = f"stems AS (SELECT term, CASE WHEN length(term) <= 2 THEN lower(term) ELSE CASE lower(term) {irregular} ELSE w END END AS stem FROM stem_{len(steps)})"
    return ", ".join([*ctes, final])


STEMMED = f"""WITH doc_words AS (
  SELECT doc_id, unnest({KEPT}) AS term FROM documents
), query_words AS (
  SELECT query_id, unnest({KEPT}) AS term FROM {query_values()}
), words AS (
  SELECT term FROM doc_words UNION SELECT term FROM query_words
), {stems("words")}, postings AS (
  SELECT stem AS term, doc_id, count(*) AS tf FROM doc_words JOIN stems USING (term) GROUP BY ALL
), lexicon AS (
  SELECT term, count(*) AS df FROM postings GROUP BY term
), doc_stats AS (
  SELECT doc_id, ({WORDS})::BIGINT AS doc_len FROM documents
), stats AS (
  SELECT count(*) AS n, avg(doc_len) AS avgdl FROM doc_stats
), wanted AS (
  SELECT DISTINCT query_id, stem AS term FROM query_words JOIN stems USING (term)
), found AS (
  SELECT query_id, doc_id, sum(CASE WHEN doc_len = 0 THEN 0 ELSE ln(n::DOUBLE / df) * tf / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl)) END) AS s
  FROM wanted JOIN postings USING (term) JOIN lexicon USING (term) JOIN doc_stats USING (doc_id), stats GROUP BY query_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id)::INT AS rank FROM found
) SELECT query_id, rank, doc_id, round(s, 6) AS score FROM ranked WHERE rank <= 10"""
VOCABULARY = f"WITH words AS (SELECT DISTINCT unnest({KEPT}) AS term FROM documents), {stems('words')} SELECT term, stem FROM stems"

IDS_SQL = ", ".join(f"({i}::BIGINT)" for i in sorted(set(IDS)))


def oracle_sql() -> dict[str, str]:
    return {
        "clean_documents": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
        "clean_pages": f"SELECT page_id, {clean('html')} AS cleaned FROM pages",
        "tokenize_documents": "SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, "
        + tokenized("regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')") + " AS t FROM documents)",
        "tokens_no_stopwords": f"SELECT doc_id, coalesce(array_to_string({KEPT}, ' '), '') AS tokens FROM documents",
        "stemmed_vocabulary": VOCABULARY,
        "stemmed_search": STEMMED,
        "doc_lengths": f"SELECT doc_id, ({WORDS})::BIGINT AS doc_len FROM documents",
        "corpus_stats": f"WITH {BASE} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
        "postings": f"WITH {BASE} SELECT * FROM postings",
        "lexicon": f"WITH {BASE} SELECT * FROM lexicon",
        "posting_lists": f"WITH {BASE} SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids, string_agg(tf::VARCHAR, ',' ORDER BY doc_id) AS frequencies FROM postings GROUP BY term",
        "index_stats": f"WITH {BASE} SELECT count(*) AS n_terms, sum(df)::BIGINT AS n_postings, round(avg(df), 6) AS avg_postings FROM lexicon",
        "top_df_terms": f"WITH {BASE} SELECT * FROM lexicon ORDER BY df DESC, term LIMIT 20",
        "parse_queries": f"SELECT query_id, coalesce(array_to_string({TOKENS}, ' '), '') AS tokens FROM {query_values()}",
        "term_lookup": f"WITH {BASE} SELECT doc_id, tf FROM postings WHERE term = 'thre'",
        "term_lookup_missing": f"WITH {BASE} SELECT term, df FROM (VALUES ('thre'), ('qqqq')) AS t(term) LEFT JOIN lexicon USING (term)",
        "document_lengths_lookup": f"WITH {BASE} SELECT doc_id, coalesce(doc_len, 0)::BIGINT AS doc_len FROM (VALUES {IDS_SQL}) AS t(doc_id) LEFT JOIN doc_stats USING (doc_id)",
        "search_conj_tfidf": searched((1, 2, 3), "conjunctive", "tfidf"),
        "search_conj_bm25": searched((1, 2, 3), "conjunctive", "bm25"),
        "search_disj_tfidf": searched((1, 2, 3), "disjunctive", "tfidf"),
        "search_disj_bm25": searched((1, 2, 3), "disjunctive", "bm25"),
        "search_dup_terms": searched((5,), "disjunctive", "tfidf"),
        "search_oov_conj": searched((4, 6), "conjunctive", "bm25"),
        "search_oov_disj": searched((4, 6), "disjunctive", "bm25"),
        "search_empty_query": searched((7,), "disjunctive", "tfidf"),
        "bm25_custom_params": searched((1, 2, 3), "disjunctive", "bm25", 0.9, 0.4),
        "search_batch_topk": f"WITH {matches()}, {ALL_MODES} SELECT query_id, query_type, method, rank, doc_id, round(s, 6) AS score FROM best",
        "codec_encode_hex": ENCODED,
        "codec_decode": f"WITH {BASE} SELECT * FROM postings",
        "codec_roundtrip": f"{BLOCKS} SELECT count(*) AS n_blocks, count(*) AS n_same FROM encoded",
        "compressed_save_load": f"WITH {BASE} SELECT * FROM postings",
        "compressed_term_lookup": f"{BLOCKS} SELECT 'posting' AS kind, doc_id, tf, NULL::VARCHAR AS blob FROM postings WHERE term = 'thre' UNION ALL SELECT 'blob', block, n, blob FROM encoded WHERE term = 'thre'",
        "compressed_search": searched((1, 2, 3), "disjunctive", "bm25"),
        "merge_compressed": ENCODED,
        "compressed_append": f"WITH {BASE} SELECT * FROM lexicon",
        "sample_index": "WITH documents AS (SELECT * FROM documents ORDER BY md5(doc_id::VARCHAR) LIMIT 100), " + f"{BASE} SELECT * FROM lexicon",
        "index_terms": f"WITH {BASE} SELECT term FROM lexicon",
        "merge_indices": f"WITH {BASE} SELECT * FROM postings",
        "merge_lexicons": f"WITH {BASE} SELECT * FROM lexicon",
        "fetch_documents_by_ids": f"SELECT t.doc_id, CASE WHEN d.doc_id IS NULL THEN 'Not existing document' ELSE text END AS text FROM (VALUES {IDS_SQL}) AS t(doc_id) LEFT JOIN documents d USING (doc_id)",
        "results_with_text": f"SELECT s.*, text FROM ({searched((1,), 'disjunctive', 'bm25')}) s JOIN documents USING (doc_id)",
        "sample_documents": "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR) LIMIT 100",
        "chunk_counts": "SELECT chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS chunk FROM documents) GROUP BY chunk",
        "judged_queries": f"WITH {QRELS} SELECT DISTINCT query_id::BIGINT AS query_id FROM qrels",
        "ndcg_reference": f"{NDCG} SELECT query_id, query_type, method, round(ndcg, 6) AS ndcg FROM metrics",
        "ndcg_standard": STANDARD,
        "mean_ndcg_by_mode": f"{NDCG} SELECT query_type, method, round(avg(ndcg), 6) AS mean_ndcg FROM metrics GROUP BY query_type, method",
    }
