"""Queries of audits, probes, worksheets, document views and design spaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import audit as A
from lodestone.operators import segment
from lodestone.plans.registry import query, r6, s6, table


@query("a04_pass_means", "WITH p AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag <> 'R' THEN l_discount END)::DOUBLE AS g, 'm' || min(l_linenumber) FILTER (l_returnflag <> 'N') AS model FROM lineitem GROUP BY 1) SELECT l_orderkey, " + s6("g") + " AS grounding, model FROM p")
def a04(spark, sf_dir):
    one = F.struct("l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_discount").cast("double")).alias("grounding"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("m"), F.col("l_linenumber").cast("string"))).alias("model"), F.lit(None).cast("string").alias("at"))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("p"))  # an order's lines: a handful
    return own.select("l_orderkey", A.pass_means(F.col("p")).alias("m")).select("l_orderkey", r6(F.col("m.grounding")).alias("grounding"), "m.model")


@query("a06_critical_open", "SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) AS total FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 40 <= 16")
def a06(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return A.critical_open(o.select(F.when(F.col("o_orderpriority") == "1-URGENT", "P1").otherwise("P2").alias("priority"), (F.col("o_custkey") % 40).alias("n"), F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus")).alias("decision")))


@query("a08_alignment", "SELECT l_linestatus, " + s6("count(*) FILTER (p) / count(*)::DOUBLE") + " AS coverage, " + s6("count(*) FILTER (e AND p) / nullif(count(*) FILTER (e), 0)::DOUBLE") + " AS presence, " + s6("count(*) FILTER (p AND a) / nullif(count(*) FILTER (p), 0)::DOUBLE") + " AS attachment FROM (SELECT l_linestatus, l_returnflag = 'A' AS e, l_linenumber < 4 AS p, l_quantity > 10 AS a FROM lineitem) GROUP BY 1")
def a08(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "A").alias("expected"), (F.col("l_linenumber") < 4).alias("present"), (F.col("l_quantity") > 10).alias("attached"))
    return A.alignment(own, "l_linestatus").select("l_linestatus", *[r6(F.col(c)).alias(c) for c in ("coverage", "presence", "attachment")])


@query("a19_alias_probe", "WITH e AS (SELECT o_custkey, avg((o_orderstatus = 'F')::INT) AS hit, count(DISTINCT o_orderstatus) = 1 AS same FROM orders GROUP BY 1) SELECT " + s6("avg(hit)") + " AS recall, " + s6("avg(same::INT)") + " AS consistency FROM e")
def a19(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("alias"), F.col("o_orderstatus").alias("canonical"))
    return A.alias_probe(o, o.select("alias").distinct().withColumn("canonical", F.lit("F"))).select(r6(F.col("recall")).alias("recall"), r6(F.col("consistency")).alias("consistency"))


@query("a24_critical_ready", "SELECT l_orderkey, count(*) FILTER (l_linenumber % 4 IN (0, 1, 2) AND l_quantity > 20) AS n_critical_ready FROM lineitem GROUP BY 1")
def a24(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(k == 0, "context").when(k == 1, "dose").when(k == 2, "outcome").otherwise("other").alias("operator"), (F.col("l_quantity") > 20).alias("ready"))
    return A.critical_ready(own, "l_orderkey")


@query("a26_repeat_fractions", "SELECT l_linenumber AS repeat, " + s6("count(DISTINCT l_suppkey)::DOUBLE / 1000") + " AS fraction FROM lineitem GROUP BY 1")
def a26(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("repeat"), F.col("l_suppkey").alias("id"))
    return A.repeat_fractions(own, 1000).withColumn("fraction", r6(F.col("fraction")))


@query("t04_candidate_order", "WITH s AS (SELECT p_brand AS component, count(*) AS papers, count(*) FILTER (p_size > 25) AS direct, count(*) FILTER (p_size > 40) > 1 AS candidate FROM part GROUP BY 1) SELECT component, row_number() OVER (ORDER BY candidate DESC, papers DESC, direct DESC, component) AS place FROM s")
def t04(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("component")).agg(F.count("*").alias("papers"), F.count_if(F.col("p_size") > 25).alias("direct"), (F.count_if(F.col("p_size") > 40) > 1).alias("candidate"))
    place = F.row_number().over(Window.orderBy(F.desc("candidate"), F.desc("papers"), F.desc("direct"), "component")).cast("long")
    return A.candidate_order(s).select("component", place.alias("place"))  # a row for each brand


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)"


@query("t02_ranked_passages", f"WITH {_LINES}, s AS (SELECT doc_id, start, contains(lower(t), 'the')::INT + contains(lower(t), 'und')::INT + 0.5 * contains(lower(t), 'of')::INT + least(2, len(regexp_extract_all(t, '[0-9]+'))) AS score FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) AS place FROM s WHERE score > 0) SELECT doc_id, start, score::DOUBLE AS score, place FROM r WHERE place <= 3")
def t02(spark, sf_dir):
    """A document's three best lines."""
    own = segment.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("score", A.passage_score(F.col("t"), ["the", "und"], ["of"], "[0-9]+"))
    return A.rank_passages(own, "doc_id", 3).select("doc_id", F.col("start").cast("long").alias("start"), F.col("score").cast("double").alias("score"), F.col("place").cast("long").alias("place"))


@query("w03_selected_context", "SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text WHEN doc_id % 2 = 0 THEN left(text, 350) || substring(text, 501, 100) || substring(text, 701, least(length(text), 1400) - 700)[1:550] ELSE left(text, 350) || right(text, 650) END) AS context FROM documents WHERE text IS NOT NULL")
def w03(spark, sf_dir):
    """The sections of even documents are at fixed places, odd ones have none."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    spans = F.array(F.struct(F.lit(500).alias("start"), F.lit(600).alias("end"), F.lit(True).alias("key")), F.struct(F.lit(650).alias("start"), F.lit(690).alias("end"), F.lit(False).alias("key")), F.struct(F.lit(700).alias("start"), F.least(F.length("text"), F.lit(1400)).alias("end"), F.lit(True).alias("key")))
    sections = docs.where("doc_id % 2 = 0").select("doc_id", F.inline(spans))
    return A.select_context(docs, sections, "doc_id", "text", 1000).select("doc_id", F.sha2("context", 256).alias("context"))


@query("x12_field_guide", "SELECT '- r_regionkey (bigint)' || chr(10) || '- r_name (string): its name' AS guide")
def x12(spark, sf_dir):
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("r_regionkey", LongType()).add("r_name", StringType(), metadata={"comment": "its name"})
    return table(spark, sf_dir, "region").limit(1).select(F.lit(A.field_guide(schema)).alias("guide"))


@query("x14_canonical_json", "SELECT o_custkey, '[\"' || array_to_string(list_sort(list(DISTINCT o_orderpriority)), '\",\"') || '\"]' AS value FROM orders GROUP BY 1")
def x14(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("v"))  # five priorities
    return own.select("o_custkey", A.canonical_json(F.concat("v", "v")).alias("value"))


@query("x16_page_excerpts", "SELECT doc_id, sha256(left(array_to_string(list_concat(b[1:1], [x FOR x IN u IF x <> b[1] AND regexp_matches(x, '[0-9]')]), chr(10)), 400)) AS excerpt FROM (SELECT doc_id, b, [b[k] FOR k IN range(1, len(b) + 1) IF list_position(b, b[k]) = k] AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents WHERE text IS NOT NULL))")
def x16(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(A.page_excerpt(F.split("text", "\n"), "[0-9]", 400), 256).alias("excerpt"))


@query("x17_document_blobs", "SELECT c_custkey, concat_ws(chr(10), nullif(trim(c_name), ''), nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_nationkey::VARCHAR) AS blob FROM customer")
def x17(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", A.document_blob(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_mktsegment")), F.col("c_nationkey").cast("string")).alias("blob"))


@query("x19_source_payloads", "SELECT o_orderkey, '10.1/' || o_orderkey AS doi, 'A title' AS title, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS n_licences FROM orders")
def x19(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit('{"DOI": "10.1/'), k, F.lit('", "title": ["A  title"], "license": [{"URL": "u"}, {"URL": "u"}]}'))
    two = F.concat(F.lit('{"doi": " 10.1/'), k, F.lit('", "title": "A title", "licenses": ["b", "a"]}'))
    own = table(spark, sf_dir, "orders").select("o_orderkey", A.source_payload(F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(two)).alias("p"))
    return own.select("o_orderkey", "p.doi", "p.title", F.size("p.licences").alias("n_licences"))


@query("r05_query_text", "SELECT 'growth rate low cost serum free medium for ' || r_name AS query FROM region")
def r05(spark, sf_dir):
    text = A.query_text({"low_cost": 0.3, "growth_rate": 0.6, "unused": 0.0}, "serum free medium", "")
    return table(spark, sf_dir, "region").select(F.concat(F.lit(text + " for "), "r_name").alias("query"))


@query("u06_beyond", "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def u06(spark, sf_dir):
    return A.beyond(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


@query("u07_partition_faults", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'repeated' WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 THEN 'missing' END AS fault FROM customer WHERE c_custkey % 6 = 0 OR (c_custkey % 2 <> 0 AND c_custkey % 3 <> 0) UNION ALL SELECT -1, 'unknown'")
def u07(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return A.partition_faults(c, {"even": c.where("c_custkey % 2 = 0"), "third": c.where("c_custkey % 3 = 0").unionAll(spark.sql("SELECT -1L AS c_custkey"))}, "c_custkey")


@query("g04_gold_review", "WITH s AS (SELECT s_suppkey, unnest(['dose', 'species', 'cell']) AS field FROM supplier) SELECT s_suppkey, count(*) FILTER (s_suppkey % 3 = 0 AND field = 'dose') AS open, count(*) FILTER (NOT (s_suppkey % 3 = 0 AND field = 'dose')) AS decided, count(*) FILTER (s_suppkey % 4 = 0 AND field = 'cell') AS faulty, s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AS ready FROM s GROUP BY 1")
def g04(spark, sf_dir):
    """A worksheet of all suppliers' fields, filled in by rule, and its state."""
    sheet = A.gold_review(table(spark, sf_dir, "supplier").select("s_suppkey"), ["dose", "species", "cell"])
    k = F.col("s_suppkey")
    filled = sheet.withColumn("decision", F.when((k % 3 == 0) & (F.col("field") == "dose"), "").otherwise("present"))
    filled = filled.withColumn("value", F.when(F.col("decision") == "present", "v").otherwise("")).withColumn("quote", F.when((k % 4 == 0) & (F.col("field") == "cell"), " ").otherwise("q"))
    return A.review_state(filled, "s_suppkey")


@query("g08_identity_gate", "SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 4 = 0 THEN 'doi_mismatch' END, CASE WHEN o_orderkey % 5 = 0 THEN 'id_mismatch' END, CASE WHEN o_orderkey % 7 = 0 THEN 'no_licence' END) AS failed, o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS kept FROM orders")
def g08(spark, sf_dir):
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("https://doi.org/10.1/A"), k.cast("string")).alias("expected_doi"), F.concat(F.lit("10.1/a"), F.when(k % 4 == 0, "x").otherwise(k.cast("string"))).alias("doi"),
        F.when(k % 3 != 0, k).when(k % 5 == 0, k).alias("expected_id"), F.when(k % 5 == 0, -1).otherwise(k).alias("id"), F.when(k % 7 != 0, "CC-BY-4.0").alias("licence"),
    )
    return A.identity_gate(own).select("o_orderkey", "failed", "kept")


@query("l17_repeated_keys", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def l17(spark, sf_dir):
    return A.repeated_keys(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("k03_derived_rows", "WITH n AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p, max(o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey::VARCHAR AS paper_id, 0 AS n, p AS value FROM n UNION ALL SELECT o_custkey::VARCHAR, 1, k::VARCHAR FROM n")
def k03(spark, sf_dir):
    """A customer's orders are versions of one extraction, whose rows are those of the newest."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("paper_id"), F.col("o_orderkey").alias("version"), F.array("o_orderpriority", F.col("o_orderkey").cast("string")).alias("rows"))
    return A.derived_rows(own, "rows")


@query("o05_space_filling", "SELECT 200 AS points, 200 AS steps0, 200 AS steps1, 200 AS steps2")
def o05(spark, sf_dir):
    """200 points of three dimensions, one in each step of each."""
    own = A.space_filling(spark, 200, 3, seed=5)
    return own.agg(F.count("*").cast("int").alias("points"), *[F.countDistinct(F.floor(F.col(f"x{d}") * 200)).cast("int").alias(f"steps{d}") for d in range(3)])


@query("o06_design_space", "WITH c AS (SELECT p_brand AS role, p_name AS component, count(DISTINCT p_partkey) AS papers FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY papers DESC, component) AS place FROM c) SELECT role, component, papers, place FROM r WHERE place <= 3 ORDER BY place, papers DESC, role, component LIMIT 10")
def o06(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("role"), F.col("p_name").alias("component"), F.col("p_partkey").alias("paper_id"))
    return A.top_components(own, per_role=3, most=10).withColumn("place", F.col("place").cast("long"))


@query("j16_closest_forms", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS v FROM nation")
def j16(spark, sf_dir):
    form = F.create_map(F.lit("v"), F.when(F.col("n_nationkey") % 3 == 0, 9).otherwise(F.col("n_nationkey") % 3).cast("int"))
    candidates = F.array(*[F.create_map(F.lit("v"), F.lit(k)) for k in (0, 1, 2)])
    return table(spark, sf_dir, "nation").select("n_nationkey", A.closest_form(form, candidates)["v"].alias("v"))
