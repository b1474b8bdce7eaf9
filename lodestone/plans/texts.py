"""Text queries: tokens, normalisation, quantities, grounding, segmentation, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import gates, retrieve, segment
from lodestone.plans.registry import query, r6, s6, table

#: Word ends are spelled out: engines differ in whether letters beyond ASCII are part of a word.
SIGNALS = {"digits": r"\d{3,}", "symbols": r"[#$%]{2,}", "english": r"(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)", "german": r"(?:^|[^A-Za-z0-9_])und(?:[^A-Za-z0-9_]|$)"}
WEIGHTS = {"digits": 6, "symbols": 4, "english": 2, "german": 1}
CONCEPTS = {"articles": ["the", "der", "la"], "links": ["and", "und", "et"], "forms": ["in-the", "of"]}
TERMS = ["the", "of", "that", "un", "the"]


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("f01_retrieval_tokens", "SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, coalesce(t[1], '') AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9][a-z0-9\\-/]+)', 1) AS t FROM documents)")
def f01(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", T.retrieval_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))


@query("f04_normalize_doi", """SELECT o_orderkey, regexp_replace(regexp_replace(lower(trim(d)), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', ''), '[ .;,]+$', '') AS doi, regexp_replace(regexp_replace(lower(trim(d)), '^https://doi\\.org/', ''), '^doi:', '') AS simple
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' https://doi.org/10.1/A' WHEN 1 THEN 'doi: 10.1/B' WHEN 2 THEN 'http://dx.doi.org/10.1/C' ELSE '10.1/D' END || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '.;' ELSE '' END AS d FROM orders)""")
def f04(spark, sf_dir):
    """F04, F05."""
    k = F.col("o_orderkey")
    d = F.concat(F.when(k % 4 == 0, " https://doi.org/10.1/A").when(k % 4 == 1, "doi: 10.1/B").when(k % 4 == 2, "http://dx.doi.org/10.1/C").otherwise("10.1/D"), k.cast("string"), F.when(k % 3 == 0, ".;").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_doi(d).alias("doi"), T.normalize_doi_simple(d).alias("simple"))


@query("f07_normalize_title", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS title FROM documents")
def f07(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_title(F.col("text"))).alias("title"))


@query("f09_strip_component", """SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(n, '\\s*\\([^)]*\\)', '', 'g')), '(?i)\\s+at\\s+[\\d.].*$', ''), '(?i)^\\d+(?:\\.\\d+)?\\s*(?:%|x|×|ng/ml|ug/ml|µg/ml|mg/ml|g/l|mg/l|mm|um|µm|nm|pm|u/ml|iu/ml|units?/ml)\\s+', '')) AS stripped
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '5 ng/mL ' || p_name WHEN 1 THEN p_name || ' (' || p_brand || ')' WHEN 2 THEN p_name || ' at 3.5 mM' WHEN 3 THEN '18-crown ' || p_name ELSE '10% ' || p_name END AS n FROM part)""")
def f09(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("5 ng/mL "), n)).when(k == 1, F.concat(n, F.lit(" ("), "p_brand", F.lit(")"))).when(k == 2, F.concat(n, F.lit(" at 3.5 mM"))).when(k == 3, F.concat(F.lit("18-crown "), n)).otherwise(F.concat(F.lit("10% "), n))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_component(name).alias("stripped"))


@query("f11_normalize_value", "SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(trim(v), '\\s+', ' ', 'g')), '\\bhours?\\b|\\bhrs?\\b', 'h', 'g'), '\\bminutes?\\b|\\bmins?\\b', 'min', 'g'), '(\\d)\\s+%', '\\1%', 'g') AS v FROM (SELECT o_orderkey, o_custkey || '  Hours and ' || o_orderkey || ' Minutes  at ' || (o_orderkey % 90) || ' %' AS v FROM orders)")
def f11(spark, sf_dir):
    v = F.concat(F.col("o_custkey").cast("string"), F.lit("  Hours and "), F.col("o_orderkey").cast("string"), F.lit(" Minutes  at "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" %"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_value(v).alias("v"))


@query("f13_excerpts", "SELECT doc_id, CASE WHEN length(v) <= 60 THEN v ELSE rtrim(left(v, 57)) || '...' END AS excerpt, array_to_string(string_split(v, ' ')[1:12], ' ') AS locator FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) AS v FROM documents)")
def f13(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.excerpt(F.col("text"), 60).alias("excerpt"), T.short_locator(F.col("text")).alias("locator"))


@query("f14_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def f14(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))


@query("f17_direction", "SELECT item_id, CASE WHEN p AND NOT n THEN 1 WHEN n AND NOT p THEN -1 END AS direction FROM (SELECT item_id, regexp_matches(t, 'increase|enhance|improve|higher|greater|faster|promote|support|boost|accelerat|superior|better') AS p, regexp_matches(t, 'decrease|reduce|reduction|lower|slower|impair|inhibit|suppress|detrimental|worse|decline|loss') AS n FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Growth was HIGHER' WHEN 1 THEN 'a loss of cells' WHEN 2 THEN 'lower but better' ELSE lower(text) END AS t0, lower(t0) AS t FROM benchmark))")
def f17(spark, sf_dir):
    k = F.col("item_id") % 4
    t = F.when(k == 0, "Growth was HIGHER").when(k == 1, "a loss of cells").when(k == 2, "lower but better").otherwise(F.lower("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.direction_from_text(t).alias("direction"))


@query("n01_quantities", """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER || CASE l_linenumber % 5 WHEN 0 THEN '-' || (l_quantity::INTEGER + 5) || ' days' WHEN 1 THEN ' min' WHEN 2 THEN ' %' WHEN 3 THEN ' ng/mL' ELSE ' cells' END AS t, l_quantity::INTEGER::DOUBLE AS q, l_linenumber % 5 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, t AS original, CASE WHEN k = 0 THEN q + 2.5 ELSE q END AS value, CASE k WHEN 0 THEN 'days' WHEN 1 THEN 'min' WHEN 2 THEN '%' WHEN 3 THEN 'ng/mL' ELSE 'cells' END AS unit, CASE WHEN k < 2 THEN 'time' WHEN k = 2 THEN 'percent' WHEN k = 3 THEN 'concentration' END AS dimension,
""" + s6("CASE k WHEN 0 THEN (q + 2.5) * 24 WHEN 1 THEN q / 60 WHEN 2 THEN q END") + " AS normalized_value, k < 3 AS comparable FROM s")
def n01(spark, sf_dir):
    """N01, N02."""
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
    t = F.concat(q.cast("string"), F.when(k == 0, F.concat(F.lit("-"), (q + 5).cast("string"), F.lit(" days"))).when(k == 1, " min").when(k == 2, " %").when(k == 3, " ng/mL").otherwise(" cells"))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.parse_quantity(t).alias("q"))
    return out.select("l_orderkey", "l_linenumber", "q.original", "q.value", "q.unit", "q.dimension", r6(F.col("q.normalized_value")).alias("normalized_value"), "q.comparable")


@query("p01_controlled_vocabulary", "SELECT conv_id, turn, CASE lower(trim(role)) WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE trim(role) END AS role FROM conversations")
def p01(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.controlled(F.col("role"), ["User", "Assistant"]).alias("role"))


@query("p04_grounding", "WITH b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark), d AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents) SELECT item_id, count(*) AS n FROM b, d WHERE length(q) >= 8 AND contains(t, q) GROUP BY 1")
def p04(spark, sf_dir):
    """All items against all documents, in one scan of each."""
    found = segment.grounded_quotes(table(spark, sf_dir, "benchmark"), docs(spark, sf_dir), quote_id="item_id", quote="text", id_col="doc_id", text_col="text")
    return found.groupBy("item_id").agg(F.count("*").alias("n"))


@query("p11_signals", "SELECT doc_id, concat_ws(';', CASE WHEN regexp_matches(text, '\\d{3,}') THEN 'digits' END, CASE WHEN regexp_matches(text, '[#$%]{2,}') THEN 'symbols' END, CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)') THEN 'english' END, CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9_])und(?:[^A-Za-z0-9_]|$)') THEN 'german' END) AS signals, (CASE WHEN regexp_matches(text, '\\d{3,}') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%]{2,}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9_])und(?:[^A-Za-z0-9_]|$)') THEN 1 ELSE 0 END)::INTEGER AS score FROM documents")
def p11(spark, sf_dir):
    """P11, F20."""
    found = T.signals(F.col("text"), SIGNALS)
    return docs(spark, sf_dir).select("doc_id", F.array_join(found, ";").alias("signals"), T.signal_score(found, WEIGHTS).alias("score"))


@query("p12_prefilter", "SELECT doc_id FROM documents WHERE length(text) >= 80 AND regexp_matches(text, '\\d{3,}') AND regexp_matches(text, '(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)')")
def p12(spark, sf_dir):
    found = T.signals(F.col("text"), SIGNALS)
    return docs(spark, sf_dir).where((F.length("text") >= 80) & F.arrays_overlap(found, F.array(F.lit("digits"))) & F.arrays_overlap(found, F.array(F.lit("english")))).select("doc_id")


@query("p16_validators", "SELECT s_suppkey, r AS value, regexp_matches(r, '^\\d+-\\d+$') AND string_split(r, '-')[2]::BIGINT > string_split(r, '-')[1]::BIGINT AS is_range FROM (SELECT s_suppkey, s_suppkey || '-' || (s_suppkey * 7 % 101) AS r FROM supplier)")
def p16(spark, sf_dir):
    r = F.concat(F.col("s_suppkey").cast("string"), F.lit("-"), (F.col("s_suppkey") * 7 % 101).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", r.alias("value"), T.is_range(r).alias("is_range"))


@query("l06_readiness", "SELECT doc_id, length(text) >= 200 AND (regexp_matches(text, '\\d{3,}') OR (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT) >= 2) AS dose_ready FROM documents")
def l06(spark, sf_dir):
    terms = T.matched_terms(F.col("text"), ("the", "and"))
    return docs(spark, sf_dir).select("doc_id", gates.readiness(F.length("text"), terms, F.regexp_count("text", F.lit(r"\d{3,}")), "dose").alias("dose_ready"))


@query("x01_sections", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k, length(text) AS size FROM documents), o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, row_number() OVER w AS n, trim(t) AS title, start::INTEGER AS start, coalesce(lead(start) OVER w, size)::INTEGER AS end FROM o WHERE regexp_matches(t, '^[A-Z][a-z]{1,12}\\.$') WINDOW w AS (PARTITION BY doc_id ORDER BY start)""")
def x01(spark, sf_dir):
    """A line of one capitalised word and a full stop is a heading."""
    return segment.sections(docs(spark, sf_dir), "doc_id", "text", r"^[A-Z][a-z]{1,12}\.$").withColumn("n", F.col("n").cast("long"))


@query("w10_paragraphs", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(CASE WHEN trim(t) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM l),
p AS (SELECT doc_id, run, min(start) AS start, max(start + length(t)) AS end FROM o WHERE trim(t) <> '' GROUP BY ALL HAVING max(start + length(t)) - min(start) >= 80)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n, start::INTEGER AS start, "end"::INTEGER AS end FROM p""")
def w10(spark, sf_dir):
    return segment.paragraphs(docs(spark, sf_dir), "doc_id", "text").withColumn("n", F.col("n").cast("long"))


@query("w02_context_packing", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT doc_id, sha256(string_agg(left(t, (500 - before)::BIGINT), '' ORDER BY k)) AS context, count(*) AS chunks FROM o WHERE before < 500 GROUP BY 1""")
def w02(spark, sf_dir):
    chunks = segment.lines(docs(spark, sf_dir), "doc_id", "text")
    return segment.pack_context(chunks, "doc_id", "line", "t", 500).withColumn("context", F.sha2("context", 256))


@query("w09_passage_hits", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
h AS (SELECT doc_id, start, CASE WHEN contains(lower(t), 'token') THEN 'token' WHEN contains(lower(t), 'licen') THEN 'licen' END AS term FROM o), f AS (SELECT doc_id, min(start) AS start, arg_min(term, start) AS term FROM h WHERE term IS NOT NULL GROUP BY doc_id, start // 1000)
SELECT doc_id, start::INTEGER AS start, term, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM f QUALIFY k <= 2""")
def w09(spark, sf_dir):
    return segment.passage_hits(docs(spark, sf_dir), "doc_id", "text", ["token", "licen"], 1000, 2).withColumn("k", F.col("k").cast("long"))


_TOKENS = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9][a-z0-9\\-/]+)', 1) AS t FROM documents), f AS (SELECT doc_id, len(t) AS len, unnest(['the', 'of', 'that', 'un', 'the']) AS q, generate_subscripts(['the', 'of', 'that', 'un', 'the'], 1) AS k, t FROM t), c AS (SELECT doc_id, len, k, q, len(list_filter(t, lambda x: x = q)) AS tf FROM f), d AS (SELECT k, count(*) FILTER (tf > 0) AS df FROM c GROUP BY 1), s AS (SELECT count(*) AS n, sum(len(t)) AS total FROM t)"


@query("r02_tfidf_top", f"WITH {_TOKENS}, x AS (SELECT doc_id, sum(tf::DOUBLE / len * (ln((n + 1) / (df + 1)) + 1)) AS score FROM c JOIN d USING (k), s WHERE len > 0 GROUP BY 1 HAVING sum(tf) > 0) SELECT doc_id, {s6('score')} AS score FROM x ORDER BY score DESC, doc_id LIMIT 20")
def r02(spark, sf_dir):
    return retrieve.top_k(retrieve.tfidf(docs(spark, sf_dir), TERMS).select("doc_id", r6(F.col("score")).alias("score")), 20)


@query("r01_bm25_top", f"WITH {_TOKENS}, i AS (SELECT k, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM d, s), m AS (SELECT avg(idf) AS mean FROM i), x AS (SELECT doc_id, sum(CASE WHEN idf < 0 THEN 0.25 * abs(mean) ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (total / n)))) AS score FROM c JOIN i USING (k), m, s GROUP BY 1 HAVING sum(tf) > 0) SELECT doc_id, {s6('score')} AS score FROM x ORDER BY score DESC, doc_id LIMIT 20")
def r01(spark, sf_dir):
    return retrieve.top_k(retrieve.bm25(docs(spark, sf_dir), TERMS).select("doc_id", r6(F.col("score")).alias("score")), 20)


@query("r03_concept_cosine", "WITH v AS (SELECT doc_id, (contains(t, 'the')::INT + contains(t, 'der')::INT + contains(t, 'la')::INT)::DOUBLE AS a, (contains(t, 'and')::INT + contains(t, 'und')::INT + contains(t, 'et')::INT)::DOUBLE AS b, ((contains(t, 'in-the') OR contains(t, 'in the'))::INT + contains(t, 'of')::INT)::DOUBLE AS c FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, " + s6("coalesce((a + 2 * b + c) / nullif(sqrt(a * a + b * b + c * c) * sqrt(6), 0), 0)") + " AS score FROM v")
def r03(spark, sf_dir):
    v = retrieve.concept_vector(F.col("text"), CONCEPTS)
    return docs(spark, sf_dir).select("doc_id", r6(T.cosine(v, F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)))).alias("score"))


@query("r04_vector_top", "SELECT vec_id, " + s6("list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))") + " AS score FROM embeddings, (SELECT list_transform(range(64), lambda i: (i % 7 - 3)::DOUBLE) AS q) ORDER BY score DESC, vec_id LIMIT 10")
def r04(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").select("vec_id", r6(T.cosine(F.col("embedding"), F.array(*[F.lit(float(i % 7 - 3)) for i in range(64)]))).alias("score"))
    return retrieve.top_k(out, 10, "vec_id")


@query("x10_json_from_prose", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def x10(spark, sf_dir):
    """JSON found in prose around the events' properties."""
    prose = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("The answer is "), "props", F.lit(" as asked.")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(T.json_from_prose(prose), "$.k").cast("long").alias("k"))


@query("x13_unpivot", "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
def x13(spark, sf_dir):
    return table(spark, sf_dir, "orders").unpivot("o_orderkey", ["o_orderstatus", "o_orderpriority"], "field", "value")


@query("x08_component_rows", "SELECT DISTINCT p_partkey, 'color' AS role, string_split(p_name, ' ')[1] AS name FROM part UNION SELECT p_partkey, 'kind', string_split(p_name, ' ')[2] FROM part")
def x08(spark, sf_dir):
    """List columns to component rows with their role."""
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(F.struct(F.lit("color").alias("role"), w[0].alias("name")), F.struct(F.lit("kind").alias("role"), w[1].alias("name"))))).distinct()
