"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def url_filter(rules, listed) -> str:
    split = [(action, *key.partition("/")) for action, key in rules]
    return f"""
WITH r(action, host, path, rule) AS (VALUES {_values([(a, h, s + p, h + s + p) for a, h, s, p in split])}),
l(host) AS (VALUES {_values([(h,) for h in listed])}),
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path
  FROM u),
fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, fit.rule,
  coalesce(fit.action, CASE WHEN EXISTS (SELECT 1 FROM l WHERE p.host = l.host OR ends_with(p.host, '.' || l.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id)
"""


SOURCE_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR))) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM s),
l AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size,
    least(weight * (SELECT min_by(level, ratio) FROM l WHERE ratio >= level), CAST(3 * source_size AS DOUBLE)) AS target
  FROM l),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - CAST(w.whole * w.source_size AS DOUBLE) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


INFILLING = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS digest
  FROM documents),
h AS (
  SELECT doc_id, text, units, len(units) AS n,
    ('0x' || digest[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || digest[9:16])::BIGINT % (len(units) + 1) AS c2,
    ('0x' || digest[17:24])::BIGINT % 100 AS p, ('0x' || digest[25:32])::BIGINT % 100 AS o
  FROM d),
c AS (
  SELECT doc_id, text, n, o, (length(text) = 0 OR regexp_matches(text, '<[PSM]>') OR p >= 90) AS plain,
    CAST(coalesce(list_sum(list_transform(units[:least(c1, c2)], lambda u: length(u))), 0) AS BIGINT) AS x,
    CAST(coalesce(list_sum(list_transform(units[:greatest(c1, c2)], lambda u: length(u))), 0) AS BIGINT) AS y
  FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN x END AS prefix_chars, CASE WHEN NOT plain THEN y - x END AS middle_chars,
  sha256(CASE WHEN plain THEN text
    WHEN o < 20 THEN '<S>' || substr(text, y + 1) || '<P>' || substr(text, 1, x) || '<M>' || substr(text, x + 1, y - x)
    ELSE '<P>' || substr(text, 1, x) || '<S>' || substr(text, y + 1) || '<M>' || substr(text, x + 1, y - x) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""


COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS (
  SELECT lang, w[i] AS x, NULL AS y, NULL AS z, count(*) AS f FROM s GROUP BY ALL
  UNION ALL SELECT lang, w[i], w[i + 1], NULL, count(*) FROM s WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, w[i], w[i + 1], w[i + 2], count(*) FROM s WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
u AS (SELECT * FROM f WHERE y IS NULL), b AS (SELECT * FROM f WHERE y IS NOT NULL AND z IS NULL), t AS (SELECT * FROM f WHERE z IS NOT NULL),
cut AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM b JOIN u AS l ON l.lang = b.lang AND l.x = b.x JOIN u AS r ON r.lang = b.lang AND r.x = b.y
  WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lang = b.lang AND t.x = b.x AND t.y = b.y AND 100 * t.f >= 50 * b.f)
    AND NOT EXISTS (SELECT 1 FROM t WHERE t.lang = b.lang AND t.y = b.x AND t.z = b.y AND 100 * t.f >= 50 * b.f)
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f
  FROM t JOIN u AS l ON l.lang = t.lang AND l.x = t.x JOIN b AS r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f
  FROM t JOIN b AS l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN u AS r ON r.lang = t.lang AND r.x = t.z),
scored AS (
  SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cut),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM u GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang)
QUALIFY rank <= 2000
"""
