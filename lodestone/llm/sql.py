"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

from lodestone.llm import centroids, fill_middle, quality
from lodestone.llm import sharding as sharding_op
from lodestone.llm import url_rules as url_rules_op


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def quality_rules(limits: quality.Limits = quality.LIMITS) -> str:
    counts = ", ".join("length(regexp_replace(t, '[^" + inside.replace("'", "''") + "]+', '', 'g'))" for inside in quality.CLASSES.values())
    n = quality.N_CLASSES
    symbol = 2 + list(quality.CLASSES).index("symbol")

    def means(name: str, size: int) -> str:
        return "[" + ", ".join(f"avg({name}[{k}])" for k in range(1, size + 1)) + "]"

    def distance(p: str, q: str, size: int) -> str:
        def e(x: str) -> str:
            return f"(CASE WHEN {x} > 0 THEN -({x}) * log2({x}) ELSE 0 END)"

        return f"sqrt(greatest(0, list_sum([{e(f'(({p}[k] + {q}[k]) / 2)')} - {e(f'{p}[k]')} / 2 - {e(f'{q}[k]')} / 2 FOR k IN range(1, {size + 1})])))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
grams AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM d, unnest(string_split(t, chr(10))) AS u(x) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counts AS (SELECT *, [length(regexp_replace(t, '[^\\x20\\x09-\\x0D]+', '', 'g')), {counts}, length(regexp_replace(t, '[^a-z]+', '', 'g'))] AS c FROM w),
m AS (
  SELECT k.r, doc_id, lang, len(ws) AS n_words, length(t) - c[1] AS word_chars, c[{symbol}] AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
    coalesce(v.n, 0) AS n_repeat_words, length(t) AS n_letters,
    [x / greatest(length(t), 1)::DOUBLE FOR x IN list_append(c, length(t) - list_sum(c))] AS classes,
    list_append([len(list_filter(ws, lambda x: x = y)) / greatest(len(ws), 1)::DOUBLE FOR y IN {_list(quality.WORDS)}],
      1.0 - len(list_filter(ws, lambda x: x IN {"(" + _list(quality.WORDS)[1:-1] + ")"})) / greatest(len(ws), 1)::DOUBLE) AS commons
  FROM counts k LEFT JOIN lines l ON l.r = k.r LEFT JOIN covered v ON v.r = k.r),
based AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed FROM m),
refs AS (SELECT lang, {means("classes", n)} AS rc, {means("commons", len(quality.WORDS) + 1)} AS rw FROM based
  WHERE NOT base_failed AND n_words >= {limits.word_guard} AND lang IN {"(" + _list(quality.LANGUAGES)[1:-1] + ")"} GROUP BY lang),
far AS (SELECT b.r, min({distance("classes", "rc", n)}) AS dc, min({distance("commons", "rw", len(quality.WORDS) + 1)}) AS dw FROM based b, refs GROUP BY b.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_letters >= {limits.class_guard} AND coalesce(dc, 0) > {limits.class_distance} OR n_words >= {limits.word_guard} AND (lang IS NULL OR lang IN {"(" + _list(quality.LANGUAGES)[1:-1] + ")"})
    AND (coalesce(dw, 0) > {limits.word_distance} OR coalesce(dc, 0) > {limits.joint[0]} AND coalesce(dw, 0) > {limits.joint[1]})) AS kept
FROM based b LEFT JOIN far USING (r)
"""


def sharding(params: sharding_op.Params = sharding_op.PARAMS) -> str:
    bits, limit = sharding_op.BITS, params.limit
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, {bits // 4}))::BIGINT AS h FROM documents),
levels AS (SELECT r, h, bytes, k, h >> ({bits} - k) AS prefix FROM d, unnest(range(0, {bits + 1})) AS u(k)),
split AS (SELECT k, prefix FROM levels GROUP BY ALL HAVING sum(bytes) > {limit} AND min(h) < max(h)),
depths AS (SELECT r, count(*) AS depth FROM levels JOIN split USING (k, prefix) GROUP BY r),
b AS (SELECT d.*, coalesce(depth, 0)::INT AS depth, substr(lpad(bin(h), {bits}, '0'), 1, coalesce(depth, 0)::INT) AS bits FROM d LEFT JOIN depths USING (r)),
p AS (SELECT *, sum(bytes) OVER w > {limit} AND min(h) OVER w = max(h) OVER w AND count(*) OVER w > 1 AS cut,
    row_number() OVER (PARTITION BY h ORDER BY doc_id) AS n FROM b WINDOW w AS (PARTITION BY bits)),
s AS (SELECT doc_id, bytes AS n_bytes, depth, CASE WHEN cut THEN bits || '.' || ((n - 1) // greatest({limit} // greatest(bytes, 1), 1))::VARCHAR ELSE bits END AS shard FROM p)
SELECT *, (sum(n_bytes) OVER (PARTITION BY shard))::BIGINT AS shard_bytes FROM s
"""


def url_rules() -> str:
    hosts = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_rules_op.HOST_RULES)
    patterns = ", ".join(f"({k}, '{p.verdict}', '{p.expression}')" for k, p in enumerate(url_rules_op.PATTERNS))
    return f"""
WITH hosts(verdict, h, p) AS (VALUES {hosts}), patterns(k, verdict, e) AS (VALUES {patterns}),
u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
c AS (SELECT *, instr(url, '://') AS p0, regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)([^?#]*)', ['a', 'b']) AS x FROM u),
s AS (SELECT r, page_id, url, CASE WHEN p0 > 0 THEN translate(x['a'], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN p0 > 0 THEN x['b'] ELSE '' END AS path FROM c),
fits AS (SELECT r, arg_max(v.h || v.p, length(v.h || v.p)) AS rule, arg_max(verdict, length(v.h || v.p)) AS verdict
  FROM s JOIN hosts v ON (s.host = v.h OR ends_with(s.host, '.' || v.h)) AND starts_with(s.path, v.p) GROUP BY r),
more AS (SELECT r, arg_min(verdict, k) AS verdict FROM s JOIN patterns ON regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), e) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(fits.verdict, more.verdict, 'allow') AS verdict
FROM s LEFT JOIN fits USING (r) LEFT JOIN more USING (r)
"""


def fill_middle_digests(params: fill_middle.Params = fill_middle.PARAMS) -> str:
    p, s, m = (f"'{x}'" for x in params.sentinels)
    before, after, rest = "t[:a]", "t[b + 1:]", "t[a + 1:b]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{params.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR h[3] % 100 >= {100 - params.plain_percent} THEN 'plain'
    WHEN h[4] % 100 < {params.spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM n)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || {before} || {s} || {after} || {m} || {rest} ELSE {s} || {after} || {p} || {before} || {m} || {rest} END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


def clusters(params: centroids.Params = centroids.PARAMS) -> str:
    d, most = params.dimensions, centroids.LARGEST
    square = f"list_sum([(v.x[j] - c.x[j]) * (v.x[j] - c.x[j]) FOR j IN range(1, {d + 1})])::BIGINT"
    steps = []
    for t in range(params.rounds + 1):
        steps.append(f"p{t} AS (SELECT v.r, c.c, {square} AS d FROM v, c{t} AS c)")
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS best FROM p{t} GROUP BY r)")
        if t < params.rounds:
            steps.append(f"""s{t} AS (SELECT best.c AS c, j, sum(x[j]) AS s, count(*) AS n FROM a{t} JOIN v USING (r), unnest(range(1, {d + 1})) AS u(j) GROUP BY ALL),
m{t} AS (SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{t} GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{t} o LEFT JOIN m{t} m USING (c))""")
    t = params.rounds
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [least(greatest(floor({params.scale} * e::DOUBLE), -{most}), {most})::BIGINT FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda e: isfinite(e))) = {d}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{params.seed}:' || vec_id::VARCHAR)) - 1)::INT AS c, x FROM v QUALIFY c < {params.k}),
{", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{t} JOIN v USING (r) JOIN c{t} c ON c.c = best.c
"""
