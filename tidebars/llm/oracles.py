"""DuckDB SQL that the rows of the text queries must equal. Plain joins and windows, meant for small tables only."""

from __future__ import annotations

from .common import LOWER, UPPER

_TEXT = "coalesce(text, '')"
#: Lower-casing of A-Z only.
_LOW = f"translate({_TEXT}, '{UPPER}', '{LOWER}')"
_WORD = r"'[^\x20\x09-\x0D]+'"

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, {_LOW} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""

NGRAM_JACCARD = f"""
WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS ws FROM documents),
 w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM l),
 t AS (SELECT doc_id, n, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 g AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS s FROM t WHERE c IS NOT NULL OR n < 3 AND i = 1),
 k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 m AS (SELECT u, v FROM p JOIN k x ON p.u = x.doc_id JOIN k y ON p.v = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
 e AS (SELECT u AS a, v AS b FROM m UNION ALL SELECT v, u FROM m),
 r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
 f AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM f LEFT JOIN k ON k.doc_id = x LEFT JOIN d ON d.a = x"""

MINHASH_DEDUP = f"""
WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS ws FROM documents),
 w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM l),
 t AS (SELECT doc_id, n, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM w),
 g AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b) AS s FROM t WHERE b IS NOT NULL OR n < 2 AND i = 1),
 k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 m AS (SELECT u, v FROM p JOIN k x ON p.u = x.doc_id JOIN k y ON p.v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
 e AS (SELECT u AS a, v AS b FROM m UNION ALL SELECT v, u FROM m),
 r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
 f AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, component_id, x = component_id AS kept FROM f LEFT JOIN k ON k.doc_id = x"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same AND other <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""

_FEATURES = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
#: Steps of crc32 for each of the 256 bytes, and crc32 of a word's bytes.
_CRC_STEP = "list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"

IMPORTANCE = f"""
WITH c AS (SELECT list({_CRC_STEP} ORDER BY i) AS steps FROM (SELECT unnest(range(256)) AS i)),
 d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_FEATURES}) AS ws FROM documents),
 x AS (SELECT 0 AS side, doc_id, unnest(ws) AS w FROM d UNION ALL SELECT 1, NULL, unnest(regexp_extract_all({_LOW}, {_FEATURES})) FROM benchmark),
 f AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT w FROM x), c),
 b AS (SELECT bucket, count(*) FILTER (side = 0)::DOUBLE AS s, count(*) FILTER (side = 1)::DOUBLE AS t FROM x JOIN f USING (w) GROUP BY 1),
 g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
 k AS (SELECT doc_id, sum(gain) AS weight FROM x JOIN f USING (w) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
 z AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN k USING (doc_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS enough FROM z)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * enough // 100 THEN place END AS rank FROM r"""

SUBSTRING_DEDUP = f"""
WITH l AS (SELECT doc_id, regexp_extract_all({_TEXT}, {_WORD}) AS ws FROM documents),
 w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM l),
 s AS (SELECT *, CASE WHEN i + 19 <= n THEN string_agg(a, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS s FROM w),
 k AS (SELECT *, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 THEN i END AS late FROM s),
 g AS (SELECT *, coalesce(i - max(late) OVER (PARTITION BY doc_id ORDER BY i) < 20, false) AS gone FROM k),
 o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(a, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

SUFFIX_DEDUP = f"""
WITH h AS (SELECT doc_id, hex(encode({_TEXT})) AS h FROM documents),
 b AS (SELECT doc_id, length(h) // 2 AS n, unnest(regexp_extract_all(h, '..')) AS a, unnest(range(0, length(h) // 2)) AS i FROM h),
 s AS (SELECT *, CASE WHEN i + 50 <= n THEN string_agg(a, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS s FROM b),
 k AS (SELECT doc_id, a, i, CASE WHEN s IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY s) THEN i END AS late FROM s),
 g AS (SELECT *, coalesce(i - max(late) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone FROM k),
 f AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS first FROM g),
 o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, count(*) FILTER (first) AS p, string_agg(a, '' ORDER BY i) FILTER (NOT gone) AS t FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(p, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

_AFTER = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
_FITS = "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')"

def _decided(name: str, paths: str, child: str, under: str, symbol: str, out: str) -> str:
    """Common tables that end in ``name``: ``paths`` with the array ``out``, the symbol of each segment of ``child`` in the family of its place in ``under``."""
    of = "(PARTITION BY host, depth, family)"
    totals = ", ".join(f"sum({c}) OVER {of} AS f_{c}" for c in ("rows", "blocked", "labelled", "ends", "opens"))
    return f"""{name}_s AS MATERIALIZED (SELECT host, path, rows, blocked, labelled, depth, {child}[depth + 1] AS own, array_to_string({under}[1:depth], '/') AS family, depth = len({child}) - 1 AS e, coalesce({child}[depth + 2] LIKE '{{%', false) AS o FROM (SELECT *, unnest(range(len({child}))) AS depth FROM {paths})),
 {name}_n AS (SELECT host, depth, family, own, sum(rows) AS rows, sum(blocked) AS blocked, sum(labelled) AS labelled, coalesce(sum(rows) FILTER (e), 0) AS ends, coalesce(sum(rows) FILTER (o), 0) AS opens FROM {name}_s GROUP BY 1, 2, 3, 4),
 {name}_f AS (SELECT *, {totals}, count(*) FILTER (rows = 1) OVER {of} AS f_single FROM {name}_n),
 {name}_d AS (SELECT host, depth, family, own, {symbol} AS symbol FROM {name}_f),
 {name}_p AS (SELECT s.host, s.path, list(symbol ORDER BY s.depth) AS {out} FROM {name}_s s JOIN {name}_d d ON s.host = d.host AND s.depth = d.depth AND s.family = d.family AND s.own = d.own GROUP BY 1, 2),
 {name} AS MATERIALIZED (SELECT p.*, coalesce({out}, []) AS {out} FROM {paths} p LEFT JOIN {name}_p q ON p.host = q.host AND p.path = q.path)"""


_OPEN = "CASE WHEN own LIKE '{%' THEN own WHEN f_rows >= 8 AND 2 * f_single >= f_rows AND rows * rows <= f_rows THEN '{*}' ELSE own END"
_ALIKE = "coalesce(abs({0}::DOUBLE / nullif({1}, 0) - f_{0}::DOUBLE / nullif(f_{1}, 0)) <= 1.96e0 * sqrt(f_{0}::DOUBLE / nullif(f_{1}, 0) * (1e0 - f_{0}::DOUBLE / nullif(f_{1}, 0)) * (1e0 / nullif({1}, 0) + 1e0 / nullif(f_{1}, 0))), true)"
_MERGED = f"CASE WHEN {' AND '.join(_ALIKE.format(x, of) for x, of in (('ends', 'rows'), ('opens', 'rows'), ('blocked', 'labelled')))} THEN '{{~}}' ELSE own END"
_UNSURE = "0.1e0 * (e.r - e.n)"

URL_FILTER = f"""
WITH a AS (SELECT page_id, {_AFTER} AS after FROM pages),
 p AS (SELECT page_id, translate(coalesce(regexp_extract(after, '^([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(after, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM a),
 r AS (SELECT *, CASE WHEN {_FITS.format("example.com", "/de/")} THEN 'example.com/de/' WHEN {_FITS.format("example.net", "/en/")} THEN 'example.net/en/' WHEN {_FITS.format("org", "/fr/")} THEN 'org/fr/' WHEN {_FITS.format("net", "/")} THEN 'net/' END AS rule FROM p),
 j AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM r),
 g AS MATERIALIZED (SELECT host, path, count(*) AS rows, count(*) FILTER (ruled = 'block') AS blocked, count(ruled) AS labelled,
   list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') THEN '{{id}}' WHEN length(s) > 40 THEN '{{slug}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS shape FROM j GROUP BY 1, 2),
 {_decided("t1", "g", "shape", "shape", _OPEN.replace("own LIKE '{%' THEN own WHEN ", ""), "f1")},
 {_decided("t2", "t1", "shape", "f1", _OPEN, "f2")},
 {_decided("t3", "t2", "f2", "f2", _MERGED, "f3")},
 {_decided("t4", "t3", "f2", "f3", _MERGED, "template")},
 t AS (SELECT host, template, sum(rows) AS rows, sum(blocked) AS blocked, sum(labelled) AS labelled FROM t4 GROUP BY 1, 2),
 s AS (SELECT *, array_to_string(template[1:depth], '/') AS node FROM (SELECT *, unnest(range(0, len(template) + 1)) AS depth FROM t)),
 n AS (SELECT host, depth, node, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS n, sum(rows)::DOUBLE AS r FROM s GROUP BY 1, 2, 3),
 x AS (SELECT s.host, s.template, list({{'p': 0e0, 'b': b, 'n': n, 'r': r}} ORDER BY s.depth) AS steps FROM s JOIN n ON s.host = n.host AND s.depth = n.depth AND s.node = n.node GROUP BY 1, 2),
 y AS (SELECT host, template, list_reduce(steps, lambda z, e: {{'p': (e.b + 2e0 * ((z.p + 0.5e0) / 2) + {_UNSURE} * 0.5e0) / (e.n + 2e0 + {_UNSURE}), 'b': e.b, 'n': e.n, 'r': e.r}}, {{'p': 0.5e0, 'b': 0e0, 'n': 0e0, 'r': 0e0}}).p AS purity FROM x)
SELECT page_id, j.host, j.path, rule, coalesce(ruled, CASE WHEN purity >= 0.8e0 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN t4 ON j.host = t4.host AND j.path = t4.path JOIN y ON j.host = y.host AND t4.template = y.template"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op6_exact_dedup": EXACT_DEDUP,
    "op10_url_filter": URL_FILTER,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_importance_resampling": IMPORTANCE,
    "op13_minhash_dedup": MINHASH_DEDUP,
}
