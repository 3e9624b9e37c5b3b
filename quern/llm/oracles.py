"""DuckDB SQL for the operators that SQL can express."""

OP2 = r"""
WITH rows AS (
  SELECT page_id, url, strpos(url, '://') AS p FROM pages
), cut AS (
  SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM rows
), parsed AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), outcomes AS (
  SELECT doc_id AS page_id,
         max(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), sites AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS host FROM parsed
), counted AS (
  SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n
  FROM sites LEFT JOIN outcomes USING (page_id) GROUP BY host
), labels_of AS (
  SELECT *, string_split(host, '.') AS l, regexp_matches(host, '^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AS alone,
         list_contains(['co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz','co.in'],
                       array_to_string(string_split(host, '.')[-2:], '.')) AS two
  FROM counted
), hosts AS (
  SELECT host, bad, n,
         CASE WHEN alone THEN host WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN alone THEN host WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
  FROM labels_of
), domains AS (
  SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix
), overall AS (
  SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS prior FROM suffixes
), s_nodes AS (
  SELECT suffix, bad, n, prior FROM suffixes, overall
), s_rho AS (
  SELECT coalesce(sum(n * (bad / n - prior) * (bad / n - prior) - prior * (1 - prior))
         / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.001) AS rho FROM s_nodes WHERE n > 0
), s_post AS (
  SELECT suffix, (bad + prior * s) / (n + s) AS post
  FROM s_nodes, (SELECT 1 / least(greatest(rho, 0.001), 0.5) - 1 AS s FROM s_rho)
), d_nodes AS (
  SELECT domain, bad, n, post AS prior FROM domains JOIN s_post USING (suffix)
), d_rho AS (
  SELECT coalesce(sum(n * (bad / n - prior) * (bad / n - prior) - prior * (1 - prior))
         / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.001) AS rho FROM d_nodes WHERE n > 0
), d_post AS (
  SELECT domain, (bad + prior * s) / (n + s) AS post
  FROM d_nodes, (SELECT 1 / least(greatest(rho, 0.001), 0.5) - 1 AS s FROM d_rho)
), h_nodes AS (
  SELECT host, bad, n, post AS prior FROM hosts JOIN d_post USING (domain)
), h_rho AS (
  SELECT coalesce(sum(n * (bad / n - prior) * (bad / n - prior) - prior * (1 - prior))
         / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.001) AS rho FROM h_nodes WHERE n > 0
), h_beta AS (
  SELECT host, bad + prior * s AS a, n - bad + (1 - prior) * s AS b
  FROM h_nodes, (SELECT 1 / least(greatest(rho, 0.001), 0.5) - 1 AS s FROM h_rho)
), blocked AS (
  SELECT host FROM h_beta WHERE a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), distinct_places AS (
  SELECT DISTINCT host, path FROM parsed
), fitted AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM distinct_places JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')
                                   IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN fitted USING (host, path)
"""

OP3 = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asking AS (
  SELECT vec_id, min(v) AS v FROM valid WHERE vec_id % 100 = 0 GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM asking q JOIN valid c ON c.vec_id != q.vec_id
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ordered WHERE rank <= 10
"""

OP7 = """
WITH lines AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents
), per_page AS (
  SELECT coalesce(source, '') AS host,
         unnest(list_distinct(list_filter(list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x != ''))) AS line
  FROM lines
), hosts AS (
  SELECT coalesce(source, '') AS host, count(*) AS pages FROM documents GROUP BY ALL
), bad AS (
  SELECT host, list(line) AS bad
  FROM (SELECT host, line, count(*) AS c FROM per_page GROUP BY host, line HAVING count(*) >= 2) JOIN hosts USING (host)
  WHERE c::DOUBLE / pages > 0.05 GROUP BY host
), kept AS (
  SELECT doc_id, l, CASE WHEN bad IS NULL THEN l ELSE
           list_filter(l, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) END AS k
  FROM lines LEFT JOIN bad ON coalesce(lines.source, '') = bad.host
), whole AS (
  SELECT doc_id, l, CASE WHEN len(list_filter(k, lambda x: trim(x, ' ' || chr(9) || chr(13)) != '')) = 0 THEN l ELSE k END AS k FROM kept
)
SELECT doc_id, CASE WHEN l IS NULL THEN NULL ELSE coalesce(array_to_string(k, chr(10)), '') END AS text,
       coalesce(len(l), 0)::INT AS n_lines, coalesce(len(l) - len(k), 0)::INT AS dropped_lines
FROM whole
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_host_reputation": OP2, "op3_pivot_distance_topk": OP3, "op7_site_line_dedup": OP7}
