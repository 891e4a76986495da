"""DuckDB SQL for the queries that SQL can express."""

from .rules import BINS, PATH

WS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(list_slice(ws, i, i + 2), ' ') FOR i IN range(1, (len(ws) - 1)::BIGINT)] END) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
und AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.y FROM reach r JOIN und u ON r.b = u.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM t),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM n, LATERAL (SELECT unnest(range(greatest(n - 49, 0))) AS i)),
least AS (SELECT g, min(doc_id) AS d FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (g) WHERE d < win.doc_id),
step AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM step),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY 1, 2),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a)::BIGINT AS gone, count(*)::BIGINT AS spans FROM gap JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN cut USING (doc_id)
"""

_share = lambda a, b: f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0)"
MEASURES = {"symbols": f"least(1.0::DOUBLE, {_share('n_symbols', 'word_chars')})", "dup_lines": _share("n_dup_lines", "n_lines"), "repeats": _share("n_repeat_words", "n_words"), "sameness": f"1 - {_share('n_kinds', 'n_words')}"}
_bins = ", ".join(f"ceil(({x}) * {BINS})::INT AS {name}" for name, x in MEASURES.items())
_path = ", ".join(f"min(CASE WHEN above <= {share} THEN bin END) AS c{c}" for c, share in enumerate(PATH))
_cuts = "[" + ", ".join(f"c{c}" for c in range(len(PATH))) + "]"
_wide = ", ".join(f"any_value(CASE WHEN rule = '{name}' THEN cuts END) AS p_{name}" for name in MEASURES)
_step = "least(" + ", ".join(f"len(list_filter(p_{name}, lambda c: {name} <= c))" for name in MEASURES) + ")"
# ln P(X <= k) of n draws at 1 %, from logarithms of factorials
_tail = "ln(list_sum([exp(lgamma(n_good + 1.0) - lgamma(i + 1.0) - lgamma(n_good - i + 1.0) + i * ln(0.01) + (n_good - i) * ln(0.99)) FOR i IN range((k + 1)::BIGINT)]))"

RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WS}) AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WS})) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), chr(0) || ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 6, 1)::BIGINT)) AS i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
m AS (SELECT doc_id, lang, sha256(text) AS h, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, len(list_distinct(ws))::BIGINT AS n_kinds FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, {_bins} FROM m),
marked AS (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY 1),
seen AS (SELECT DISTINCT lang, h FROM b JOIN marked USING (doc_id)),
fresh AS (SELECT DISTINCT ON (b.lang, b.h) b.* FROM b LEFT JOIN seen ON b.lang IS NOT DISTINCT FROM seen.lang AND b.h = seen.h WHERE seen.h IS NULL),
long AS ({" UNION ALL ".join(f"SELECT lang, '{name}' AS rule, {name} AS bin FROM fresh" for name in MEASURES)}),
bins AS (SELECT lang, rule, bin, count(*) AS n FROM long GROUP BY 1, 2, 3),
above AS (SELECT lang, rule, bin, coalesce(sum(n) OVER (PARTITION BY lang, rule ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY lang, rule)::DOUBLE AS above FROM bins),
cuts AS (SELECT lang, rule, {_cuts} AS cuts FROM (SELECT lang, rule, {_path} FROM above GROUP BY 1, 2)),
path AS (SELECT lang, {_wide} FROM cuts GROUP BY 1),
good AS (SELECT DISTINCT ON (b.lang, b.h) b.* FROM b JOIN marked USING (doc_id) WHERE y = 1),
stood AS (SELECT path.lang, {_step} AS step FROM good JOIN path ON good.lang IS NOT DISTINCT FROM path.lang),
counts AS (SELECT lang, c, count(*) AS n_good, count_if(step <= c) AS k FROM stood, range({len(PATH)}) t(c) GROUP BY 1, 2),
tested AS (SELECT lang, c, k <= n_good * 0.01 AND {_tail} <= ln(0.05 / (SELECT count(*) FROM path)) AS safe FROM counts),
steps AS (SELECT lang, coalesce(min(CASE WHEN NOT safe THEN c END), {len(PATH)})::INT AS steps FROM tested GROUP BY 1),
limits AS (SELECT path.lang, {", ".join(f"p_{name}[steps] AS l_{name}" for name in MEASURES)} FROM path JOIN steps ON path.lang IS NOT DISTINCT FROM steps.lang WHERE steps > 0),
v AS (SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, array_to_string(list_filter([{", ".join(f"CASE WHEN {name} > l_{name} THEN '{name}' END" for name in sorted(MEASURES))}], lambda x: x IS NOT NULL), ',') AS rejected_by FROM b LEFT JOIN limits ON b.lang IS NOT DISTINCT FROM limits.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rejected_by, '') = '' AS kept, coalesce(rejected_by, '') AS rejected_by FROM v
"""

CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384 + z))))"""

# words as the query plants repeats in them; places that match q words on, found by runs of six words, which any run has
PERIODIC = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WS}) AS ws, {CRC32} AS h FROM documents),
s AS (SELECT *, len(ws)::BIGINT AS n, h // 10 AS g FROM w),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [ws[(CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END)::BIGINT + 1] FOR i IN range(n)] ELSE ws END AS ws FROM s),
six AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 6), ' ') AS k FROM t, LATERAL (SELECT unnest(range(greatest(n - 5, 0))) AS i)),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i JOIN t ON t.doc_id = a.doc_id WHERE 2 * (b.i - a.i) <= n),
isle AS (SELECT doc_id, q, min(i) AS a, max(i) + 6 + q AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, a, b - a AS l, min(q) AS q FROM isle WHERE b - a >= greatest(12, 2 * q) GROUP BY doc_id, a, b),
lost AS (SELECT doc_id, list(DISTINCT i) AS gone FROM run, LATERAL (SELECT unnest(range((a + q)::BIGINT, (a + l)::BIGINT)) AS i) GROUP BY 1),
told AS (SELECT doc_id, count(*)::BIGINT AS n_runs, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) AS lines, arg_min(struct_pack(a := a, l := l, q := q), struct_pack(l := -l, a := a, q := q)) AS best FROM run GROUP BY 1),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM t) t LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM lost) g USING (doc_id, i) WHERE g.doc_id IS NULL GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.a::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256 FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

INFILL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
d AS (SELECT *, len(us)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, CASE WHEN b > a THEN array_to_string(us[a + 1:b], '') ELSE '' END AS mid, CASE WHEN n > b THEN array_to_string(us[b + 1:n], '') ELSE '' END AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars, sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

NEAR = """
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.r, a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, CASE WHEN len(a.v) = len(b.v) THEN b.v ELSE a.v END) >= 0.93),
n AS (SELECT r, count(*)::BIGINT AS n FROM link GROUP BY 1),
reach AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, coalesce(vec_id = c, false) AS kept FROM e LEFT JOIN n USING (r) LEFT JOIN least ON vec_id IS NOT DISTINCT FROM a
"""

ORACLES = {"op11_periodic_runs": PERIODIC, "op12_infill": INFILL, "op13_embedding_near_dedup": NEAR, "op5_jaccard_join": JACCARD, "op9_suffix_dedup": REPEATS, "op10_quality_rules": RULES}
