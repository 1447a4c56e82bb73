"""DuckDB SQL for name matching: token-set ratios of pairs, and the whole resolution of the stand-in sightings."""

from __future__ import annotations

#: Name key of a column `name` of the stand-ins (ASCII names).
NAME_KEY = "trim(regexp_replace(' ' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') || ' ', ' the ', ' ', 'g'))"


def ratio_steps(pairs: str, out: str, least: float = 88) -> str:
    """CTEs that score the pairs (a, b) of a CTE with their token-set ratio; `out` keeps those of `least` and more.

    The longest common subsequence of the remainders is found bit by bit, one list step per character (up to 62)."""
    return f"""{out}_w AS (SELECT a, b, list_sort(list_intersect(x, y)) AS s, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS l, list_sort(list_filter(y, lambda w: NOT list_contains(x, w))) AS r
  FROM (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM {pairs})),
{out}_t AS (SELECT a, b, length(array_to_string(s, ' ')) AS s, len(s) > 0 AS common_word, array_to_string(l, ' ') AS l, array_to_string(r, ' ') AS r FROM {out}_w),
{out}_u AS (SELECT *, CASE WHEN common_word THEN s + 1 ELSE 0 END AS p, CASE WHEN common_word AND (l = '' OR r = '') THEN 100.0 WHEN common_word THEN 200.0 * s / (2 * s + 1 + least(length(l), length(r))) ELSE 0.0 END AS floor FROM {out}_t),
{out}_m AS (SELECT a, b, floor, p, length(l) AS n, length(r) AS m, (1::BIGINT << length(l)) - 1 AS whole,
    list_transform(string_split(r, ''), lambda c: list_sum(list_transform(range(length(l)), lambda i: CASE WHEN l[i + 1] = c THEN 1::BIGINT << i ELSE 0::BIGINT END))::BIGINT) AS hits
  FROM {out}_u WHERE floor < 100 AND abs(length(l) - length(r)) <= (100 - {least}) / 100 * (2 * p + length(l) + length(r)) + 1e-6 AND l <> '' AND r <> ''),
{out}_c AS (SELECT *, n - bit_count(list_reduce(list_prepend(whole, hits), lambda row, h: ((row + (row & h)) | (row - (row & h))) & whole)) AS common FROM {out}_m),
{out} AS (SELECT a, b, max(score) AS score FROM (SELECT a, b, 200.0 * (p + common) / (2 * p + n + m) AS score FROM {out}_c UNION ALL SELECT a, b, floor FROM {out}_u) GROUP BY a, b HAVING max(score) >= {least})"""


FUZZY_PAIRS = f"""WITH p AS (SELECT DISTINCT p_name || ' ' || lower(replace(p_brand, '#', ' ')) AS a FROM part),
pairs AS (SELECT x.a, regexp_replace(y.a, '^(.)(.)(.*)$', '\\2\\1\\3s') AS b FROM p x, p y),
{ratio_steps("pairs", "scored")}
SELECT a AS left_text, b AS right_text, round(score, 3) AS score FROM scored"""

_SAME = {2: "w.k = i.k AND w.p = i.vp", 3: "w.t = i.t", 4: "w.b = i.b", 5: "w.k = i.k AND (w.p IS NULL OR i.vp IS NULL)"}


def _attach(i: int) -> str:
    """One round in which waiting rows look for a venue: by exact keys, else by name."""
    tiers = " UNION ALL ".join(f"SELECT w.id, {t} AS tier, i.entity FROM wait{i} w JOIN src{i} i ON {on} AND i.since < w.id" for t, on in _SAME.items())
    return f"""
hit{i} AS (SELECT id, arg_min(entity, {{'a': tier, 'b': entity}}) AS entity, min(tier) AS tier FROM ({tiers}) GROUP BY id),
rest{i} AS (SELECT * FROM wait{i} ANTI JOIN hit{i} USING (id)),
near{i} AS (SELECT w.id, arg_min(i.entity, {{'a': -score, 'b': i.entity}}) AS entity, 6 AS tier FROM rest{i} w JOIN close ON w.k = close.a JOIN src{i} i ON i.k = close.b
  WHERE i.since < w.id AND (w.p IS NULL OR i.vp IS NULL OR w.p = i.vp) GROUP BY w.id),
got{i} AS (SELECT * FROM hit{i} UNION ALL SELECT * FROM near{i}),
src{i + 1} AS (SELECT entity, k, t, b, vp, id AS since FROM got{i} JOIN wait{i} USING (id) JOIN venue USING (entity)),
wait{i + 1} AS (SELECT * FROM wait{i} ANTI JOIN got{i} USING (id))"""


def resolution(sightings: str, rounds: int = 4, fuzzy: bool = True) -> str:
    """CTEs of the whole resolution, without its last tier if not `fuzzy`.  `sightings`: name, c (confidence), p, t, b (postal code, phone, booking link or null), seq.

    `done` has one row per sighting: venue_id, kept_name, method."""
    held = " UNION ALL ".join(
        f"SELECT id, {t} AS tier, {key} AS key FROM placed WHERE {key} IS NOT NULL" for t, key in ((2, "k || chr(1) || p"), (3, "t"), (4, "b"), (5, "k || chr(1) || place"))
    )
    return f"""RECURSIVE
s AS (SELECT *, {NAME_KEY} AS k, {{'a': -c, 'b': seq}} AS o, c > 0.5 AS creator FROM ({sightings})),
nodes AS (SELECT row_number() OVER (ORDER BY o) AS id, * FROM (SELECT k, p, t, b, creator, min(o) AS o, arg_min(name, o) AS name FROM s GROUP BY k, p, t, b, creator)),
makers AS (SELECT * FROM nodes WHERE creator),
home AS (SELECT k, arg_min(p, id) AS home FROM makers WHERE p IS NOT NULL GROUP BY k),
placed AS (SELECT makers.*, coalesce(p, home, 'none') AS place FROM makers LEFT JOIN home USING (k)),
held AS ({held}),
first AS (SELECT tier, key, min(id) AS f FROM held GROUP BY tier, key),
parent AS (SELECT id, arg_min(f, tier) AS f, min(tier) AS tier FROM held JOIN first USING (tier, key) WHERE f < id GROUP BY id),
up(id, here) AS (SELECT id, id FROM makers UNION ALL SELECT up.id, f FROM up JOIN parent ON up.here = parent.id),
member AS (SELECT id, root, k, p, t, b FROM makers JOIN (SELECT id, min(here) AS root FROM up GROUP BY id) USING (id)),
sector AS (SELECT root, arg_min(p, id) FILTER (p IS NOT NULL) AS vp FROM member GROUP BY root),
known AS (SELECT root AS entity, k, vp, min(id) AS since FROM member JOIN sector USING (root) GROUP BY ALL),
names AS (SELECT DISTINCT k FROM nodes),
pairs AS (SELECT x.k AS a, y.k AS b FROM names x, names y),
{ratio_steps("pairs", "close") if fuzzy else "close AS (SELECT a, b, 0.0 AS score FROM pairs WHERE false)"},
link AS (SELECT q.id, arg_min(entity, {{'a': -score, 'b': entity}}) AS f FROM member q JOIN close ON q.k = close.a JOIN known ON known.k = close.b
  WHERE q.id = q.root AND since < q.id AND (q.p IS NULL OR vp IS NULL OR q.p = vp) GROUP BY q.id),
top(id, here) AS (SELECT root, root FROM sector UNION ALL SELECT top.id, f FROM top JOIN link ON top.here = link.id),
settled AS (SELECT member.* REPLACE (x.root AS root) FROM member JOIN (SELECT id AS own, min(here) AS root FROM top GROUP BY id) x ON member.root = own),
venue AS (SELECT root AS entity, arg_min(p, id) FILTER (p IS NOT NULL) AS vp FROM settled GROUP BY root),
src0 AS (SELECT root AS entity, k, t, b, vp, id AS since FROM settled JOIN venue ON entity = root),
wait0 AS (SELECT * FROM nodes WHERE NOT creator),
{",".join(_attach(i) for i in range(rounds))},
placement AS (
  SELECT settled.id, root, CASE WHEN settled.id = root THEN 0 WHEN link.id IS NOT NULL THEN 6 ELSE tier END AS how FROM settled LEFT JOIN link USING (id) LEFT JOIN parent USING (id)
  UNION ALL {" UNION ALL ".join(f"SELECT id, entity, tier FROM got{i}" for i in range(rounds))}),
ids AS (SELECT entity AS root, 'v' || lpad(CAST(row_number() OVER (ORDER BY entity) AS VARCHAR), 5, '0') AS venue_id, name AS kept_name FROM venue JOIN nodes ON id = entity),
done AS (SELECT venue_id, kept_name, CASE WHEN venue_id IS NULL THEN 'none' WHEN s.o = nodes.o THEN ['created', 'place_id', 'name_postal', 'phone', 'booking_link', 'name_exact', 'fuzzy_name'][how + 1]
    WHEN s.p IS NOT NULL THEN 'name_postal' WHEN s.t IS NOT NULL THEN 'phone' WHEN s.b IS NOT NULL THEN 'booking_link' ELSE 'name_exact' END AS method
  FROM s JOIN nodes ON s.k = nodes.k AND s.creator = nodes.creator AND s.p IS NOT DISTINCT FROM nodes.p AND s.t IS NOT DISTINCT FROM nodes.t AND s.b IS NOT DISTINCT FROM nodes.b
  LEFT JOIN placement ON placement.id = nodes.id LEFT JOIN ids USING (root))"""
