"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from lodestone.llm import quality

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_SETS = f"""RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(list_sort(s), chr(10))) AS m FROM s),
reps AS (SELECT m, n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY ALL),
x AS (SELECT rep, n, unnest(s) AS g FROM reps JOIN s ON doc_id = rep),
links AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comps AS (SELECT a AS rep, min(b) AS comp FROM reach GROUP BY 1)"""
OP1 = f"WITH {_SETS}, k AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY 1) SELECT doc_id, n.n AS n_shingles, coalesce(rep, doc_id) AS class_id, coalesce(comp, doc_id) AS component_id, coalesce(n_links, 0) AS n_links FROM n LEFT JOIN reps USING (m, n) LEFT JOIN comps USING (rep) LEFT JOIN k USING (rep)"

_FITS = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for r in ("example.net/de/8", "example.com/en/7", "org/es/", "net/de/", "com/en/")}
#: No link of the driver's pages leaves its host, so each host's ranks are its seeds' shares; the propagation itself is held by unit tests.
OP5 = r"""WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE """ + " ".join(f"WHEN {fits} THEN '{rule}'" for rule, fits in _FITS.items()) + """ END AS rule FROM u), v AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM r),
h AS (SELECT host, count(*) FILTER (own = 'allow') AS a, count(*) FILTER (own = 'block') AS b FROM v WHERE own IS NOT NULL GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM h), bad AS (SELECT host FROM h, t WHERE coalesce(b / nullif(tb, 0), 0) > coalesce(a / nullif(ta, 0), 0))
SELECT page_id, v.host, path, rule, coalesce(own, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN bad ON bad.host = v.host"""


def _op8() -> str:
    lists = " ".join(f"WHEN '{k}' THEN {v.split()}" for k, v in quality.COMMON.items())
    strip = [r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?''\"()-]+"]
    stages, prev = [], "d0"
    for k, p in enumerate(strip):
        stages.append(f"d{k + 1} AS (SELECT *, regexp_replace(t{k}, '{p}', '', 'g') AS t{k + 1} FROM {prev})")
        prev = f"d{k + 1}"
    chars = ", ".join(f"length(t{k}) - length(t{k + 1})" for k in range(len(strip)))
    normal = lambda x: f"CASE WHEN list_sum({x}) > 0 THEN [v / list_sum({x}) FOR v IN {x}] END"
    js = lambda p, q: f"sqrt(greatest(0, list_sum([CASE WHEN {p}[k] > 0 THEN {p}[k] * log2(2 * {p}[k] / ({p}[k] + {q}[k])) ELSE 0 END + CASE WHEN {q}[k] > 0 THEN {q}[k] * log2(2 * {q}[k] / ({p}[k] + {q}[k])) ELSE 0 END FOR k IN range(1, len({p}) + 1)]) / 2))"
    return rf"""WITH d0 AS (SELECT doc_id, coalesce(text, '') AS t0, {WORDS.format("text")} AS w, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS l FROM documents), {", ".join(stages)},
f AS (SELECT doc_id, t0, w, l, [{chars}, length(t{len(strip)})]::DOUBLE[] AS c, CASE l {lists} ELSE {quality.OTHER.split()} END AS common, [lower(x) FOR x IN w] AS lw FROM {prev}),
g AS (SELECT *, [len([x FOR x IN lw IF x = q])::DOUBLE FOR q IN common] AS h0 FROM f), i AS (SELECT *, list_append(h0, len(w) - list_sum(h0)) AS h FROM g),
z AS (SELECT doc_id, t0, w, l, {normal("c")} AS c, {normal("h")} AS h FROM i),
refs AS (SELECT l, [{", ".join(f"avg(c[{k}])" for k in range(1, len(strip) + 2))}] AS rc, [{", ".join(f"avg(h[{k}])" for k in range(1, 14))}] AS rh FROM z WHERE len(w) >= {quality.MIN_WORDS} GROUP BY 1),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS k, w FROM z WHERE len(w) >= 3), tg AS (SELECT doc_id, k, array_to_string(w[k:k + 2], chr(10)) AS g FROM tri), tw AS (SELECT doc_id, g FROM tg GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS r FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS j FROM tg JOIN tw USING (doc_id, g)) GROUP BY 1),
m AS (SELECT z.*, coalesce(r, 0) AS r, {js("c", "rc")} AS dc, {js("h", "rh")} AS dh, [x FOR x IN string_split(t0, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM z LEFT JOIN rep USING (doc_id) LEFT JOIN refs USING (l)),
b AS (SELECT *, len(w) < 50 OR 100 * r > 50 * len(w) AS failed FROM m)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t0, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, r AS n_repeat_words,
failed AS base_failed, NOT failed AND NOT (coalesce(dc, 0) > {quality.MAX_CHARACTER_DISTANCE} OR coalesce(dh, 0) > {quality.MAX_WORD_DISTANCE}) AS kept FROM b"""


OP8 = _op8()

_PLAIN = r"regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
bw AS (SELECT item_id, unnest([array_to_string(w[k:k + 12], ' ') FOR k IN range(1, greatest(2, len(w) - 11))]) AS g, least(13, len(w)) AS n FROM b WHERE len(w) > 0), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n), hits AS (SELECT doc_id, item_id, k, dw.n FROM dw JOIN bw ON array_to_string(w[k:k + dw.n - 1], ' ') = g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM hits) GROUP BY 1), i AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

OP10 = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
w AS (SELECT doc_id, k, t, {WORDS.format("lower(t)")} AS w FROM l), c AS (SELECT w, min((doc_id, k)) AS first FROM w WHERE len(w) >= 5 GROUP BY 1),
v AS (SELECT first, len(w) AS n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS g FROM (SELECT first, w, unnest(range(1, len(w) + 1)) AS i FROM c WHERE len(w) >= 8)),
sub AS (SELECT n, i, g, min(first) AS lead FROM v GROUP BY ALL), full_ AS (SELECT first, len(w) AS n, array_to_string(w, ' ') AS g FROM c WHERE len(w) >= 8),
near AS (SELECT v.first FROM v JOIN sub USING (n, i, g) WHERE lead < v.first UNION SELECT v.first FROM v JOIN full_ f ON v.g = f.g AND f.n = v.n - 1 WHERE f.first < v.first UNION SELECT f.first FROM v JOIN full_ f ON v.g = f.g AND f.n = v.n - 1 WHERE v.first < f.first),
m AS (SELECT w.*, c.first IS NOT NULL AND ((doc_id, k) > c.first OR c.first IN (SELECT first FROM near)) AS gone FROM w LEFT JOIN c ON w.w = c.w AND len(w.w) >= 5)
SELECT doc_id, count(*) FILTER (gone) AS n_dropped, length(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT gone), ''))::BIGINT AS n_left_chars, sha256(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS text_sha256 FROM m GROUP BY 1"""

_LETTERS = "ABCDE"
OP12 = rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS.format("text")} AS w FROM documents), firsts AS (SELECT t, min(doc_id) AS first FROM t GROUP BY 1),
flags AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 3 * length(t.t), regexp_matches(t.t, '[#$%&*|]'), t.doc_id > first] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM t JOIN firsts ON t.t = firsts.t LEFT JOIN flags ON flags.doc_id = t.doc_id),
l AS (SELECT unnest(range(1, 6)) AS k), orders AS (SELECT [a.k, b.k, c.k, e.k, g.k] AS o FROM l a, l b, l c, l e, l g WHERE len(list_distinct([a.k, b.k, c.k, e.k, g.k])) = 5), s AS (SELECT o, k AS step, o[1:k - 1] AS before, o[k] AS own FROM orders, l),
m AS (SELECT part, f, good, toxic, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT part, array_to_string([('{_LETTERS}')[k] FOR k IN o], '') AS filter_order, step, own, n, good, toxic, f[own] AS fails, len([k FOR k IN before IF f[k]]) = 0 AS met, len([v FOR v IN f IF v]) = 1 AS single FROM m, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN met AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN met AND fails THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND NOT met THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails AND single THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN met AND fails AND good THEN n ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN met AND fails AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""
