"""DuckDB SQL for the queries of this subpackage that SQL can express. It reads whole tables."""

from __future__ import annotations

from proofrecon.llm.secret_scan import RULES, Rule

OP1 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) ELSE w END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n_shingles + y.n_shingles - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b)
SELECT n.doc_id, n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n_shingles"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(concat('0x', substr(d, 5 * (k // 4) + 1, 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM p"""


def _op7(seed: int = 20_011, weights: int = 3, most: int = 3, rounds: int = 8) -> str:
    levels = ["l0 AS (SELECT 0.0::DOUBLE AS v)", "l1 AS (SELECT (SELECT sum(ss) FROM q)::DOUBLE / (SELECT sum(w) FROM q)::DOUBLE AS v)"]
    for k in range(2, rounds + 1):
        levels.append(
            f"l{k} AS (SELECT ((SELECT sum(ss) FROM q) - (SELECT coalesce(sum({most} * ss), 0) FROM q, l{k - 1} WHERE {most} * ss < v * w))::DOUBLE / "
            f"(SELECT sum(w) FROM q, l{k - 1} WHERE NOT ({most} * ss < v * w))::DOUBLE AS v)"
        )
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {weights} + 1 AS w FROM d GROUP BY source),
{", ".join(levels)},
t AS (SELECT source, ss AS source_size, CASE WHEN {most} * ss < v * w THEN ({most} * ss)::DOUBLE ELSE v * w END AS target FROM q, l{rounds}),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      row_number() OVER (PARTITION BY d.source ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) AS k,
      CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', d.source)), 1, 8)) AS BIGINT)::DOUBLE / 4294967296 AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) * size AS taken FROM r"""


def _spans(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'s': list_sum(list_transform(list_slice(gap, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(h, 1, i - 1), lambda x: length(x))), 0),
 'n': length(h[i]), 'g': length(g[i])}}), lambda z: z.g >= {rule.least})) AS z
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS h, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS gap FROM d) x WHERE len(h) > 0"""


def _op8() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(_spans(rule, k) for k, rule in enumerate(RULES))}),
x AS (SELECT doc_id, rank, kind, CAST(z.s AS BIGINT) AS a, CAST(z.s + z.n AS BIGINT) AS b FROM s),
f AS (SELECT doc_id, count(CASE WHEN rank = 0 THEN 1 END) AS n_assign, count(CASE WHEN rank = 1 THEN 1 END) AS n_access, count(CASE WHEN rank = 2 THEN 1 END) AS n_hex,
 string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, rank) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON f.doc_id = d.doc_id"""


OP11 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda s: array_to_string(w[s:s + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
d AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))) AS g FROM w, (SELECT DISTINCT n FROM x) y WHERE len(w) >= n),
h AS (SELECT DISTINCT d.k, d.s, d.n, x.item_id FROM d JOIN x ON d.g = x.g AND d.n = x.n),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM h) z GROUP BY k),
t AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.k = w.k LEFT JOIN t ON t.k = w.k"""

_LEAF = "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({c}), ':', {c}), '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n} AS VARCHAR)", "text")) + "))"
_CRC_TABLE = "SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
OP12 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.format(n="n_chars + 1")} END AS tampered FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, n, level, i, h) AS (SELECT lang, n, 0, i, leaf FROM p UNION ALL SELECT lang, (any_value(n) + 1) // 2, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, i // 2),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(n, level, i, h) AS (SELECT n, 0, i, h FROM s UNION ALL SELECT (any_value(n) + 1) // 2, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY i // 2),
top AS (SELECT h AS root FROM u WHERE n = 1),
a(k, lang, i, level, n, own, node, seen) AS (
 SELECT row_number() OVER (), lang, i, 0, n, leaf, coalesce(tampered, leaf), '' FROM p
 UNION ALL
 SELECT a.k, a.lang, a.i // 2, a.level + 1, (a.n + 1) // 2, a.own, sha256(CASE WHEN a.i % 2 = 0 THEN concat(a.node, t.h) ELSE concat(t.h, a.node) END), concat(a.seen, t.h)
 FROM a LEFT JOIN t ON t.lang IS NOT DISTINCT FROM a.lang AND t.level = a.level AND t.i = xor(a.i, 1) WHERE a.n > 1),
b(k, i, level, n, node, seen) AS (
 SELECT a.k, s.i, 0, s.n, a.node, a.seen FROM a JOIN s ON s.lang IS NOT DISTINCT FROM a.lang WHERE a.n = 1
 UNION ALL
 SELECT b.k, b.i // 2, b.level + 1, (b.n + 1) // 2, sha256(CASE WHEN b.i % 2 = 0 THEN concat(b.node, u.h) ELSE concat(u.h, b.node) END), concat(b.seen, u.h)
 FROM b LEFT JOIN u ON u.level = b.level AND u.i = xor(b.i, 1) WHERE b.n > 1),
o AS (SELECT *, row_number() OVER () AS k FROM p)
SELECT o.doc_id, o.leaf, s.h AS subroot, root, sha256(b.seen) AS proof_sha256, b.node AS folded_root, b.node = root AS verified
FROM o JOIN s ON s.lang IS NOT DISTINCT FROM o.lang JOIN b ON b.k = o.k AND b.n = 1, top"""

OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM d GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM d, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, p HAVING count(*) >= 100),
q AS (SELECT * FROM f, (VALUES (1), (2), (3), (4)) v(c) WHERE c < k),
c AS (SELECT q.lang, q.k, q.p, q.f AS a, c, x.f AS l, y.f AS r, n.n, (1000 * q.f * n.n) // (x.f * y.f) AS score
 FROM q JOIN n ON n.lang = q.lang JOIN f x ON x.lang = q.lang AND x.p = q.p[:c] JOIN f y ON y.lang = q.lang AND y.p = q.p[c + 1:]),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, c) AS best FROM c),
i AS (SELECT lang, unnest([p[:k - 1], p[2:]]) AS p, f FROM f WHERE k > 2),
s AS (SELECT lang, p, max(f) AS f FROM i GROUP BY lang, p),
e AS (SELECT m.*, array_to_string(m.p, ' ') AS phrase FROM m LEFT JOIN s ON s.lang = m.lang AND s.p = m.p WHERE best = 1 AND (s.f IS NULL OR 100 * s.f < 100 * m.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000"""


ORACLES = {"op1_minhash_dedup": OP1, "op2_warc_archive": OP2, "op7_source_mixing": _op7(), "op8_secret_scan": _op8(), "op11_winnowing_decontamination": OP11, "op12_merkle_manifest": OP12, "op13_suffix_collocations": OP13}
