"""DuckDB SQL with the results of the operators that SQL can express."""

#: Control strings are broken after their first character, backslashes doubled.
_ESCAPED = r"""regexp_replace(regexp_replace(replace({x}, '\', '\\'),
    '(<)(\|(?:turn|body|end|image|audio|document|im_start|im_end|endoftext|startoftext)\|>|/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')"""

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(23 + length({_ESCAPED.format(x="role")}) + length({_ESCAPED.format(x="text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM d),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, edges.b FROM r JOIN edges ON r.c = edges.a)
SELECT d.doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""



def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds are unrolled: codebooks b0, assignments a0, codebooks b1, ..."""
    steps = [f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
p AS (SELECT row_number() OVER () AS row, vec_id, label, e, len(e) // {parts} AS d FROM v),
x AS (SELECT row, k, e[k * d + 1 : (k + 1) * d] AS x FROM p, range({parts}) t(k)),
s AS (SELECT e, d, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM p QUALIFY j < {entries}),
b0 AS (SELECT k, j, e[k * d + 1 : (k + 1) * d] AS y FROM s, range({parts}) t(k))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (SELECT row, k, min({{'far': far, 'j': j}}) AS m FROM (
      SELECT row, x.k, j, list_sum(list_transform(list_zip(x, y), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS far
      FROM x JOIN b{i} ON x.k = b{i}.k) GROUP BY row, k)""")
        if i < rounds:
            steps.append(f"""
u{i} AS (SELECT k, j, list(y ORDER BY pos) AS y FROM (
      SELECT x.k, m.j AS j, pos, CAST(sum(z) // count(*) - CASE WHEN sum(z) < 0 AND sum(z) % count(*) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS y
      FROM (SELECT row, k, unnest(x) AS z, generate_subscripts(x, 1) AS pos FROM x) x JOIN a{i} ON x.row = a{i}.row AND x.k = a{i}.k GROUP BY 1, 2, 3) GROUP BY k, j),
b{i + 1} AS (SELECT b{i}.k, b{i}.j, coalesce(u{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN u{i} ON b{i}.k = u{i}.k AND b{i}.j = u{i}.j)""")
    return f"""
WITH {",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY k, j)) AS digest FROM b{rounds}),
r AS (SELECT row, string_agg(printf('%02x', m.j), '' ORDER BY k) AS code, CAST(sum(m.far) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM r JOIN p USING (row), h
"""


def _level(table: str, prior: str, least: float = 0.001, most: float = 0.5) -> str:
    """Posterior mean and weight of a beta-binomial level (columns n, bad, the prior mean p and the weight above, above)."""
    noise = "n * p * (1 - p)"
    share = f"(SELECT least({most}, greatest({least}, coalesce(sum(pow(bad - n * p, 2) - {noise}) / sum((n - 1) * {noise}), {least}))) FROM {prior} WHERE n > 1)"
    return f"{table} AS (SELECT *, (w * p + bad) / (w + n) AS mean, w + n AS weight FROM (SELECT *, 1 / ({share} + 1 / (above + 1)) - 1 AS w FROM {prior}))"


URL_FILTERS = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
c AS (SELECT host, count(bad) AS n, count(*) FILTER (WHERE bad) AS bad,
             regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u LEFT JOIN o USING (page_id) GROUP BY host),
f AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name WHEN regexp_matches(name, '(^|[.])example[.](com|net|org)$') THEN regexp_extract(name, 'example[.](com|net|org)$')
             ELSE regexp_extract(name, '[^.]*$') END AS suffix FROM c),
g AS (SELECT host, n, bad, suffix, CASE WHEN name = suffix THEN name ELSE regexp_extract(left(name, length(name) - length(suffix) - 1), '[^.]*$') || '.' || suffix END AS domain FROM f),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM g GROUP BY ALL),
t0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM g GROUP BY ALL),
t1 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM t0) AS p, (SELECT sum(n) + 2.0 FROM t0) AS above FROM t0),
{_level("t", "t1")},
d1 AS (SELECT d0.*, t.mean AS p, t.weight AS above FROM d0 JOIN t USING (suffix)),
{_level("d", "d1")},
h1 AS (SELECT g.host, g.n, g.bad, d.mean AS p, d.weight AS above FROM g JOIN d USING (domain)),
{_level("h", "h1")},
k AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM h),
r(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
b AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 6) AS bad_bound
FROM u JOIN k USING (host) LEFT JOIN b ON u.host = b.host AND u.path = b.path
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_aggregate(w[i : i + m - 1], 'string_agg', ' '))) AS phrase FROM w, range(1, 6) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT f.lang, m, phrase, c AS a, n, string_split(phrase, ' ') AS w FROM f JOIN n USING (lang) WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, a, n, k, x.c AS l, y.c AS r, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.c AS HUGEINT) * y.c) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1 : k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT b.* FROM b ANTI JOIN c ON c.lang = b.lang AND 100 * c.a >= 100 * b.a AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000
"""

ORACLE_SQL = {"op1_chat_formatting": CHAT, "op4_near_dedup": NEAR_DUPLICATES, "op11_vector_codes": _vector_codes(), "op12_collocations": COLLOCATIONS, "op13_url_filters": URL_FILTERS}
