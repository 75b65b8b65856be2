"""DuckDB SQL for the corpus queries that SQL expresses over whole tables."""

from __future__ import annotations

from cadenza.llm import urls
from cadenza.llm.secrets import RULES


def secret_scan() -> str:
    """Spans from the lengths of matches and of what lies between them, by rule."""
    parts = []
    for k, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, row, '{rule.kind}' AS kind, {k} AS rank, {str(rule.base).lower()} AS base,
 (list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS n, length(t[i]) AS tested
 FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, row, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '({p})', {rule.group + 1}) AS t, string_split_regex(text, '{p}') AS gaps FROM d))
 WHERE length(t[i]) >= {rule.least}""")  # fmt: skip
    text = "kind || ':' || s || ':' || (s + n)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in RULES if r.base)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents), f AS ({" UNION ALL ".join(parts)}),
 g AS (SELECT row, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY s, rank) FILTER (base), '')) AS base_sha256, string_agg({text}, ',' ORDER BY s, rank) AS spans FROM f GROUP BY row)
 SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES if r.base)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.row = g.row"""


TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

LINE_DEDUP = """WITH d AS (SELECT doc_id, coalesce(source, '') AS h, string_split(text, chr(10)) AS ls FROM documents), t AS (SELECT h, count(*) AS total FROM d GROUP BY h),
 u AS (SELECT h, unnest(list_distinct(list_transform(ls, lambda x: trim(x)))) AS l FROM d), f AS (SELECT h, l, count(*) AS n FROM u WHERE l <> '' GROUP BY h, l HAVING count(*) >= 3),
 b AS (SELECT h, list(l) AS bad FROM f JOIN t USING (h) WHERE n > total * 0.02 GROUP BY h),
 k AS (SELECT doc_id, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(bad, trim(x))) END AS kept FROM d LEFT JOIN b USING (h))
 SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped, CASE WHEN ls IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM k"""


def url_filter() -> str:
    """Rules, else the ratio of two Witten-Bell character models, order by order."""
    upper, lower = urls._UPPER, urls._LOWER
    fits = [(what, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for what, h, p in sorted(urls.RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits) + " END"
    kept = "".join("\\" + c if not c.isalnum() else c for c in urls.SYMBOLS[2:])
    steps, n = [], urls.ORDER
    for k in range(1, n + 1):
        mixed = lambda c: f"CASE WHEN n{c} + t{c} > 0 THEN (s.{c} + t{c} * p{c}) / (n{c} + t{c}) ELSE p{c} END AS p{c}"
        steps.append(f"""s{k} AS (SELECT right(gram, {k}) AS tail, left(right(gram, {k}), {k - 1}) AS bef, sum(a) AS a, sum(b) AS b FROM t GROUP BY 1, 2),
 c{k} AS (SELECT bef, sum(a) AS na, count(*) FILTER (a > 0) AS ta, sum(b) AS nb, count(*) FILTER (b > 0) AS tb FROM s{k} GROUP BY bef),
 o{k} AS (SELECT o.gram, {mixed("a")}, {mixed("b")} FROM o{k - 1} o JOIN s{k} s ON right(o.gram, {k}) = s.tail JOIN c{k} c ON s.bef = c.bef)""")  # fmt: skip
    return f"""WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest, regexp_replace(translate(coalesce(url, ''), '{upper}123456789', '{lower}000000000'), '[^{kept}]', '~', 'g') AS form FROM pages),
 p AS (SELECT page_id, form, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r AS (SELECT *, {case(1)} AS rule, {case(0)} AS v FROM p), f AS (SELECT form, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM r GROUP BY form),
 g AS (SELECT form, a, b, substr('{"^" * (n - 1)}' || form, i, {n}) AS gram FROM (SELECT *, unnest(generate_series(1, length(form))) AS i FROM f)), t AS (SELECT gram, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM g GROUP BY gram),
 o0 AS (SELECT gram, 1.0::DOUBLE / {len(urls.SYMBOLS)} AS pa, 1.0::DOUBLE / {len(urls.SYMBOLS)} AS pb FROM t), {", ".join(steps)},
 rt AS (SELECT gram, CASE WHEN (SELECT max(a) > 0 AND max(b) > 0 FROM t) THEN ln(pa) - ln(pb) ELSE 0 END AS ratio FROM o{n}),
 av AS (SELECT form, avg(ratio) AS ratio FROM g JOIN rt USING (gram) GROUP BY form), sc AS (SELECT form, a, b, coalesce(ratio, 0) AS ratio FROM f LEFT JOIN av USING (form)),
 m AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a * ratio) / nullif(sum(a), 0) AS ma, sum(b * ratio) / nullif(sum(b), 0) AS mb, sum(a * ratio * ratio) / nullif(sum(a), 0) AS sa, sum(b * ratio * ratio) / nullif(sum(b), 0) AS sb FROM sc WHERE a + b > 0),
 d AS (SELECT na, nb, ma, mb, sqrt(greatest(0, sa - ma * ma)) + 1e-9 AS da, sqrt(greatest(0, sb - mb * mb)) + 1e-9 AS db FROM m),
 th AS (SELECT CASE WHEN na > 0 AND nb > 0 THEN (ma * db + mb * da) / (da + db) ELSE 0 END AS limit_ratio FROM d)
 SELECT page_id, host, path, rule, coalesce(v, CASE WHEN ratio >= limit_ratio THEN 'allow' ELSE 'block' END) AS verdict, round(ratio, 6) AS ratio FROM r JOIN sc USING (form), th"""


def near_duplicates(n: int = 2, percent: int = 80) -> str:
    """Shingle sets, links by their joint shingles, and the smallest doc_id reachable over links."""
    letters = [chr(c) for c in range(65, 91)]
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{"".join(letters)}', '{"".join(letters).lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
 d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: {shingle})) END AS s FROM w),
 x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM d), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) - count(*) AS joint, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= {percent} * joint UNION ALL SELECT b, a FROM p WHERE 100 * shared >= {percent} * joint),
 r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
 SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON doc_id = a"""


def spelling_variants() -> str:
    """Words with the contract's slips (crc32 byte by byte, from its polynomial), near words by shared deletions."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE t(i, k, c) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, {step} FROM t WHERE k < 8), tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
 d AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+') AS rs FROM documents),
 o AS (SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(rs) AS run FROM d) GROUP BY doc, run),
 h AS (SELECT run, n, xor(list_reduce(list_transform(range(1, octet_length(encode(doc || ':' || run)) + 1), lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i - 1, 2))::UBIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295) AS h FROM o, tab),
 s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
 w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 x AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w), y AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM x),
 p AS (SELECT a.word, b.word AS other, b.n AS m FROM y a JOIN y b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM y a JOIN w b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM y a JOIN w b ON a.cut = b.word),
 g AS (SELECT word, count(*) AS k, max(m) AS top FROM p GROUP BY word), b AS (SELECT p.word, min(other) AS best FROM p JOIN g ON p.word = g.word AND m = top GROUP BY p.word),
 f AS MATERIALIZED (SELECT w.word, n, coalesce(k, 0)::BIGINT AS n_near, CASE WHEN top >= 10 * n THEN best END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM w LEFT JOIN g ON w.word = g.word LEFT JOIN b ON w.word = b.word),
 q(word, tip) AS (SELECT word, word FROM f UNION ALL SELECT q.word, f.form FROM q JOIN f ON f.word = q.tip WHERE f.form IS NOT NULL)
 SELECT f.word, f.form, q.tip AS root, f.n, f.n_near, f.form_n FROM f JOIN q ON f.word = q.word JOIN f e ON e.word = q.tip AND e.form IS NULL"""


HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score QUALIFY rank <= 10"""
