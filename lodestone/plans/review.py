"""Predicate, pointer and review queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import pointers
from lodestone.operators import predicates as P
from lodestone.operators.scratch import written
from lodestone.plans.registry import query, r6, s6, table


@query("p06_target_predicates", """SELECT p_partkey, (contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget')) AND (contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue')) AND (p_size % 2 = 0 OR contains(lower(p_type), 'promo')) AS target,
NOT regexp_matches(p_name, '(?i)\\b(gear|bolt)\\b') AS actionable, regexp_matches(p_name || ' ' || p_brand, '\\d') AS dose FROM part""")
def p06(spark, sf_dir):
    """P06-P08."""
    ctx = F.create_map(F.lit("species"), F.col("p_name"), F.lit("cell_type"), F.col("p_name"), F.lit("stage"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", P.is_target(ctx, ["widget"], ["red", "blue"], ["promo"]).alias("target"), P.is_actionable(F.col("p_name"), r"(?i)\b(gear|bolt)\b").alias("actionable"), P.has_dose(F.col("p_name"), F.col("p_brand"), r"\d").alias("dose"))


@query("p13_decoys", "SELECT doc_id FROM documents WHERE length(text) >= 120 AND NOT regexp_matches(text, '\\d{3,}') AND NOT regexp_matches(text, '[#$%]{2,}')")
def p13(spark, sf_dir):
    from lodestone.functions.text import signals
    from lodestone.plans.texts import SIGNALS

    return table(spark, sf_dir, "documents").where(P.is_decoy(F.col("text"), signals(F.col("text"), SIGNALS), ["digits", "symbols"])).select("doc_id")


@query("p14_caption_qualifies", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)') AND regexp_matches(text, '(?:^|[^A-Za-z0-9_])of(?:[^A-Za-z0-9_]|$)') AND regexp_matches(text, '\\d')")
def p14(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(P.qualifies(F.col("text"), [r"(?:^|[^A-Za-z0-9_])the(?:[^A-Za-z0-9_]|$)", r"(?:^|[^A-Za-z0-9_])of(?:[^A-Za-z0-9_]|$)", r"\d"])).select("doc_id")


@query("p15_flags", "SELECT o_orderkey, o_orderstatus = 'F' AS yes, o_orderkey % 3 = 0 AS licence FROM orders")
def p15(spark, sf_dir):
    flag = F.when(F.col("o_orderstatus") == "F", " Yes ").otherwise(F.col("o_orderstatus"))
    url = F.when(F.col("o_orderkey") % 3 == 0, "https://creativecommons.org/licenses/by/4.0/").otherwise("https://example.org/licenses/")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.is_yes(flag).alias("yes"), P.is_licence_url(url).alias("licence"))


@query("p17_allowed_changes", "SELECT p_partkey, CASE WHEN p_name IN ('red widget', 'blue gear') THEN 'r' ELSE 'r [not in the allowed list]' END AS rationale, CASE WHEN p_name IN ('red widget', 'blue gear') THEN p_brand ELSE 'unsupported' END AS support FROM part")
def p17(spark, sf_dir):
    changes = F.array(F.struct(F.col("p_name").alias("variable"), F.lit("r").alias("rationale"), F.col("p_brand").alias("support")))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(P.enforce_allowed(changes, ["red widget", "blue gear"]))).drop("variable")


@query("p19_all_failed", "SELECT user_id, bool_and(event_type = 'error') AS failed FROM events GROUP BY 1")
def p19(spark, sf_dir):
    failed = P.all_failed(F.array(F.when(F.col("event_type") == "error", "call_error").otherwise("ok")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(failed).alias("failed"))


@query("p20_coercion", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment || '; x' END AS joined FROM customer")
def p20(spark, sf_dir):
    v = P.as_list(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(v).alias("n"), P.as_text(F.when(F.size(v) > 0, F.concat(v, F.array(F.lit("x")))).otherwise(v)).alias("joined"))


@query("p21_payload_keys", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'E' WHEN 1 THEN 'E.growth' ELSE 'other' END AS k FROM nation")
def p21(spark, sf_dir):
    key = F.when(F.col("n_nationkey") % 3 == 0, "Medium").when(F.col("n_nationkey") % 3 == 1, "e.growth").otherwise("other")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.map_keys(P.canonical_keys(F.create_map(key, F.lit("v")), {"E": "medium"}))[0].alias("k"))


@query("p22_weights", "SELECT p_partkey, floor(p_size / (p_size + 3.0) * 1e4 + 0.5) / 1e4 AS a, floor(3.0 / (p_size + 3.0) * 1e4 + 0.5) / 1e4 AS b FROM part")
def p22(spark, sf_dir):
    w = P.normal_weights(F.create_map(F.lit("a"), F.col("p_size").cast("double"), F.lit("b"), F.lit(3.0)))
    return table(spark, sf_dir, "part").select("p_partkey", w["a"].alias("a"), w["b"].alias("b"))


@query("g03_passage_previews", """WITH r AS (SELECT doc_id, 0 AS n, 5 AS lo, 25 AS hi, doc_id % 3 AS m FROM documents UNION ALL SELECT doc_id, 1, 10, doc_id % 5000, doc_id % 3 FROM documents)
SELECT doc_id, n::INTEGER AS n, CASE WHEN m = 0 THEN 'missing_text' WHEN hi <= lo THEN 'invalid_range' WHEN hi > length(text) THEN 'out_of_bounds' ELSE 'ok' END AS status, CASE WHEN m <> 0 AND hi > lo AND hi <= length(text) THEN sha256(substr(text, lo + 1, hi - lo)) END AS passage FROM r JOIN documents USING (doc_id)""")
def g03(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.concat(F.lit("5-25;10-"), (F.col("doc_id") % 5000).cast("string")).alias("ranges"))
    return P.previews(rows, docs.where("doc_id % 3 <> 0"), key="doc_id").select("doc_id", "n", "status", F.sha2("passage", 256).alias("passage"))


@query("e08_pointed_effects", """WITH p AS (SELECT l_orderkey, max(l_quantity::INTEGER) FILTER (l_linenumber = 1) AS t, max(l_quantity::INTEGER) FILTER (l_linenumber = 2) AS c FROM lineitem GROUP BY 1 HAVING t IS NOT NULL AND c IS NOT NULL)
SELECT l_orderkey AS pointer_id, CASE WHEN l_orderkey % 10 <> 0 THEN """ + s6("ln(t::DOUBLE / c)") + " END AS effect, CASE WHEN l_orderkey % 10 <> 0 THEN " + s6("0.25 / (6 * t * t) + 0.25 / (6 * c * c)") + " END AS variance, CASE WHEN l_orderkey % 10 = 0 THEN 'header_cell:control_mean' ELSE '' END AS issues FROM p")
def e08(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_quantity").cast("int"))).alias("t"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_quantity").cast("int"))).alias("c"))
    line = line.where("t is not null and c is not null")
    doc = F.col("l_orderkey").cast("string").alias("doc_id")
    head = F.col("l_orderkey") % 10 == 0
    cell = lambda i, text, header=F.lit(False): F.struct(F.lit(i).alias("id"), text.alias("text"), header.alias("is_header"))
    spread = lambda c: F.concat(F.col(c).cast("string"), F.lit(" ± 0.5"))
    cells = line.select(doc, F.inline(F.array(cell("a", spread("t")), cell("b", spread("c"), head), cell("n", F.lit("n = 6")), cell("s", F.lit("0.5")))), F.lit("h").alias("source_sha256"))
    roles = [("treatment_mean", "a"), ("treatment_sd", "a"), ("control_mean", "b"), ("control_sd", "s"), ("treatment_n", "n"), ("control_n", "n")]
    ptr = line.select(F.col("l_orderkey").alias("pointer_id"), doc, F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("cell_id")) for r, c in roles])), F.lit("h").alias("source_sha256"))
    return pointers.pointed_effects(ptr, cells).select("pointer_id", r6(F.col("effect")).alias("effect"), r6(F.col("variance")).alias("variance"), "issues")


@query("j09_verified_locators", "SELECT doc_id AS review_id, 'p' || doc_id % 4 AS locator, CASE WHEN doc_id % 4 = 3 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents")
def j09(spark, sf_dir):
    from lodestone.functions.text import collapse

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    good = F.sha2(collapse(F.col("text")), 256)
    loc = F.concat(F.lit("p"), (F.col("review_id") % 4).cast("string"))
    reviews = docs.select("review_id", "doc_id", F.array(loc).alias("locators"), F.array(F.when(F.col("review_id") % 5 == 0, "x").otherwise(good)).alias("hashes"))
    return pointers.verified_locators(reviews, docs.where("review_id % 4 <> 3").select("doc_id", loc.alias("id"), "text"))


@query("j10_merge_reviews", """SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS reviewer_1_v, c_nationkey + 1 AS reviewer_2_v,
concat_ws(';', CASE WHEN c_custkey % 4 = 0 THEN 'missing_1' END, CASE WHEN c_custkey % 7 = 0 THEN 'drift_2_c_mktsegment' END) AS issues FROM customer""")
def j10(spark, sf_dir):
    """J10, J11."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("v"))
    second = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("v") + 1).alias("v"))
    return pointers.merge_reviews(c, c.where("c_custkey % 4 <> 0"), second, ["c_custkey"], ["c_mktsegment"], ["v"])


@query("j14_best_page", """WITH w AS (SELECT source, doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS t FROM documents), c AS (SELECT source, doc_id, unnest(t[1:10]) AS t FROM w WHERE len(t) >= 10), p AS (SELECT source, doc_id, unnest(t) AS t FROM w),
s AS (SELECT c.source, c.doc_id AS caption_id, p.doc_id AS page, count(*) / 10 AS score FROM c JOIN p ON c.source = p.source AND c.t = p.t GROUP BY ALL), r AS (SELECT *, row_number() OVER z AS k, coalesce(lead(score) OVER z, 0) AS nxt FROM s WINDOW z AS (PARTITION BY source, caption_id ORDER BY score DESC, page))
SELECT source AS doc_id, caption_id, page, """ + s6("score") + " AS score FROM r WHERE k = 1 AND score >= 0.59 AND score - nxt >= 0.05")
def j14(spark, sf_dir):
    """Each document's first ten words by name are a caption; a document of the same source is the page that has them."""
    t = F.sort_array(F.array_distinct(F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")))
    w = written(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), t.alias("tokens")))  # split once
    c = w.where(F.size("tokens") >= 10).select("doc_id", F.col("page").alias("caption_id"), F.slice("tokens", 1, 10).alias("tokens"))
    return pointers.best_page(c, w).withColumn("score", r6(F.col("score")))


@query("a20_table_status", "SELECT part.p_partkey, CASE WHEN p_size % 7 = 0 AND p_size > 5 THEN 'excluded_non_effect_statistics' WHEN p_size <= 5 THEN 'no_group_stat_structure' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'incomplete_missing_dispersion_type_and_sample_size' WHEN p_size % 2 = 0 THEN 'incomplete_missing_dispersion_type' WHEN p_size % 3 = 0 AND p_size % 5 = 0 THEN 'incomplete_sample_size_not_cell_addressable' WHEN p_size % 3 = 0 THEN 'incomplete_missing_sample_size' WHEN p_retailprice < 1000 THEN 'ambiguous_complete_structure_needs_review' WHEN p_size < 20 THEN 'incomplete_insufficient_group_values' ELSE 'structural_group_stats_candidate' END AS status FROM part")
def a20(spark, sf_dir):
    from lodestone.operators.gates import table_status

    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", table_status(s > 5, s % 2 != 0, s % 3 != 0, s % 5 == 0, F.col("p_retailprice") >= 1000, s >= 20, s % 7 == 0).alias("status"))
