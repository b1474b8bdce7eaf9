"""Relational queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import gates, normalize
from lodestone.operators import relational as R
from lodestone.plans.registry import query, r6, s6, table

ONTOLOGY = [
    {"canonical": "Widget", "aliases": ["red widget", "blue widget"], "category": "hardware", "typical_role": "part"},
    {"canonical": "Gear", "aliases": ["red gear", "green gear"], "category": "hardware", "typical_role": "drive"},
    {"canonical": "Bolt", "aliases": ["bolt", "blue bolt"], "category": "fastener", "typical_role": "part"},
]
LOOKUP = "(VALUES ('widget','Widget','hardware'),('red widget','Widget','hardware'),('blue widget','Widget','hardware'),('gear','Gear','hardware'),('red gear','Gear','hardware'),('green gear','Gear','hardware'),('bolt','Bolt','fastener'),('blue bolt','Bolt','fastener')) t(surface, canonical, category)"


@query("j01_canonicalize", f"""SELECT p_partkey, coalesce(canonical, trim(p_name)) AS canonical, category, CASE WHEN canonical IS NULL THEN 'none' WHEN lower(canonical) = lower(trim(p_name)) THEN 'exact' ELSE 'alias' END AS matched_via,
CASE WHEN canonical IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM part LEFT JOIN {LOOKUP} ON surface = lower(trim(p_name))""")
def j01(spark, sf_dir):
    lookup = normalize.ontology(spark, ONTOLOGY)
    return normalize.canonicalize(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", lookup).drop("p_name")


@query("a01_component_counts", "SELECT p_name AS canonical, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def a01(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("canonical")).agg(F.countDistinct("l_suppkey").alias("n")).orderBy(F.desc("n"), "canonical")


@query("a02_stats", "SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'quality_' || coalesce(quality::VARCHAR, 'unclassified'), count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a02(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    tiers = docs.join(labels, "doc_id", "left").groupBy(F.concat(F.lit("quality_"), F.coalesce(F.col("quality").cast("string"), F.lit("unclassified"))).alias("what")).agg(F.count("*").alias("n"))
    return n(docs, "documents").unionAll(n(labels, "labels")).unionAll(tiers)


@query("a13_corpus_gate", """WITH c AS (SELECT count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars >= 1000) AS long_, count(*) AS ids FROM documents)
SELECT 'english' AS check, english AS n, 500::BIGINT AS least, english >= 500 AS passed FROM c UNION ALL SELECT 'long', long_, 900, long_ >= 900 FROM c""")
def a13(spark, sf_dir):
    return gates.corpus_gate(table(spark, sf_dir, "documents"), {"english": (F.col("lang") == "en", 500), "long": (F.col("n_chars") >= 1000, 900)})


@query("a14_duplicate_values", "SELECT md5(lower(trim(text))) AS value, count(*) AS n FROM documents WHERE lower(trim(text)) NOT IN ('', 'none') GROUP BY 1 HAVING count(*) > 1")
def a14(spark, sf_dir):
    v = F.lower(F.trim("text"))
    return table(spark, sf_dir, "documents").where(~v.isin("", "none")).groupBy(F.md5(v).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


@query("a15_decision_histogram", "SELECT d.status, count(o_orderkey) AS n FROM (VALUES ('F'),('O'),('P'),('X')) d(status) LEFT JOIN orders ON o_orderstatus = d.status GROUP BY 1")
def a15(spark, sf_dir):
    domain = spark.createDataFrame([(x,) for x in "FOPX"], "status string")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return domain.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("a16_status_counts", "SELECT o_orderpriority AS status, count(*) AS n FROM orders GROUP BY 1")
def a16(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("n")).orderBy("status")


@query("a22_raw_name_frequency", f"""WITH f AS (SELECT p_name AS name, count(DISTINCT p_brand) AS n, min(p_type) AS first_type FROM part GROUP BY 1)
SELECT name, n, first_type, canonical IS NOT NULL AS resolved FROM f LEFT JOIN {LOOKUP} ON surface = lower(name)""")
def a22(spark, sf_dir):
    f = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct("p_brand").alias("n"), F.min("p_type").alias("first_type"))
    out = normalize.canonicalize(f, "name", normalize.ontology(spark, ONTOLOGY))
    return out.select("name", "n", "first_type", (F.col("score") > 0).alias("resolved")).orderBy("resolved", F.desc("n"), "name")


@query("j03_acquisition_partition", """WITH q AS (SELECT doc_id AS row, CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5(text) END AS doi, left(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), 40) AS title FROM documents WHERE doc_id % 2 = 0),
c AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'NONE' WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS doi, left(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), 40) AS title FROM documents WHERE doc_id % 2 = 1),
ct AS (SELECT title, min(nullif(doi, 'NONE')) AS d1, max(nullif(doi, 'NONE')) AS d2 FROM c WHERE title <> '' GROUP BY 1), qp AS (SELECT DISTINCT title FROM q WHERE title <> '' AND doi <> '')
SELECT row, q.doi, q.title, CASE WHEN q.doi <> '' AND q.doi IN (SELECT doi FROM c WHERE doi <> 'NONE') THEN 'corpus_doi' WHEN q.doi = '' AND ct.title IS NOT NULL THEN 'corpus_title' WHEN q.doi = '' AND qp.title IS NOT NULL THEN 'queue_title_with_doi'
 WHEN q.doi <> '' AND ct.title IS NOT NULL AND (d1 <> q.doi OR d2 <> q.doi) THEN 'conflict' ELSE 'actionable' END AS reason FROM q LEFT JOIN ct ON q.title = ct.title LEFT JOIN qp ON q.title = qp.title""")
def j03(spark, sf_dir):
    """Even documents are the queue, odd ones the corpus; hashes of texts stand for DOIs, beginnings for titles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    title = F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), 1, 40).alias("title")
    queue = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("row"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.md5("text")).alias("doi"), title)
    corpus = docs.where("doc_id % 2 = 1").select(F.when(F.col("doc_id") % 5 == 0, "NONE").when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("doi"), title)
    return R.acquisition_partition(queue, corpus)


@query("j04_gold_left_predictions", "SELECT d.doc_id, coalesce(quality, -1) AS predicted, quality IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT l.doc_id, l.quality, false FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents)")
def j04(spark, sf_dir):
    gold, pred = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = gold.join(pred, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("predicted"), F.col("quality").isNull().alias("missing"))
    return out.unionAll(pred.join(gold, "doc_id", "left_anti").select("doc_id", "quality", F.lit(False)))


@query("j05_title_match", """WITH p AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name), ' ')) AS tokens FROM part), n AS (SELECT n_nationkey AS id, list_distinct(string_split(lower(n_name || ' red widget'), ' ')) AS tokens FROM nation),
s AS (SELECT p.id AS l_id, n.id AS r_id, len(list_intersect(p.tokens, n.tokens))::DOUBLE / len(list_distinct(list_concat(p.tokens, n.tokens))) AS score FROM p, n), r AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS k FROM s WHERE score >= 0.4)
SELECT l_id, r_id, """ + s6("score") + " AS score FROM r WHERE k = 1")
def j05(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("tokens"), F.lit("").alias("doi"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array_distinct(F.split(F.lower(F.concat("n_name", F.lit(" red widget"))), " ")).alias("tokens"), F.lit("").alias("doi"), F.col("n_nationkey").alias("ord"))
    return R.best_title_match(p, n).withColumn("score", r6(F.col("score")))


@query("j06_range_join", "SELECT l_orderkey, l_linenumber, h.h_id FROM lineitem JOIN (VALUES ('low', 0, 0, 3), ('mid', 0, 3, 4), ('all', 0, 0, 11), ('below', 9, 0, 11)) h(h_id, h_row, h_col, h_span) ON h_row < l_linenumber AND h_col <= (l_discount * 100)::INTEGER AND (l_discount * 100)::INTEGER < h_col + h_span")
def j06(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("row"), F.round(F.col("l_discount") * 100).cast("int").alias("col"))
    headers = spark.createDataFrame([("low", 0, 0, 3), ("mid", 0, 3, 4), ("all", 0, 0, 11), ("below", 9, 0, 11)], "h_id string, h_row int, h_col int, h_span int")
    return R.covers(cells, headers, []).select("l_orderkey", "l_linenumber", "h_id")


@query("j07_reconcile", """SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, concat_ws(';', CASE WHEN a.c_custkey IS NULL THEN 'missing_left' END, CASE WHEN b.c_custkey IS NULL THEN 'missing_right' END,
CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL AND a.c_mktsegment <> b.c_mktsegment THEN 'differs_c_mktsegment' END) AS failed
FROM (SELECT * FROM customer WHERE c_custkey % 10 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 <> 0) b ON a.c_custkey = b.c_custkey""")
def j07(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    other = c.where("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return R.reconcile(c.where("c_custkey % 10 <> 0"), other, "c_custkey", ["c_mktsegment"])


@query("j12_semi_anti", "SELECT source, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM documents GROUP BY 1")
def j12(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    both = docs.join(labels, "doc_id", "left_semi").select("source", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(docs.join(labels, "doc_id", "left_anti").select("source", F.lit(0), F.lit(1)))
    return both.groupBy("source").agg(F.sum("a").alias("labelled"), F.sum("b").alias("unlabelled"))


@query("j13_longest_pick", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def j13(spark, sf_dir):
    best = F.max_by(F.struct("doc_id", "n_chars"), F.struct(F.col("n_chars"), -F.col("doc_id")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(best.alias("b")).select("source", "b.*")


@query("j17_union_conflicts", "WITH u AS (SELECT DISTINCT * FROM (SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey > 20)) SELECT n_nationkey, n_name, count(*) OVER (PARTITION BY n_nationkey) > 1 AS conflict FROM u")
def j17(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return R.merge_disjoint(n, n.where("n_nationkey < 5"), n.where("n_nationkey > 20").withColumn("n_name", F.lower("n_name")), key="n_nationkey")


@query("j18_papers_with_component", "SELECT DISTINCT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = 'red widget' AND (p_type = 'ECONOMY' OR p_brand = 'Brand#11')")
def j18(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_name = 'red widget' and (p_type = 'ECONOMY' or p_brand = 'Brand#11')").select("p_partkey")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_suppkey").distinct()


@query("k01_upsert_orders", """WITH d AS (SELECT o_orderkey, 'X' AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'NEW' END AS o_orderpriority FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey, 'N', 'NEW' FROM orders WHERE o_orderkey % 100 = 0)
SELECT coalesce(b.o_orderkey, d.o_orderkey) AS o_orderkey, CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus, coalesce(d.o_orderpriority, b.o_orderpriority) AS o_orderpriority FROM orders b FULL JOIN d ON b.o_orderkey = d.o_orderkey""")
def k01(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    some = base.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, None).otherwise("NEW").alias("o_orderpriority"))
    new = base.where("o_orderkey % 100 = 0").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit("NEW").alias("o_orderpriority"))
    return R.upsert(base, some.unionAll(new), "o_orderkey", keep_old=("o_orderpriority",))


@query("s18_keep_first", "SELECT min(doc_id) AS doc_id, lang FROM (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY lower(text)) GROUP BY doc_id, lang")
def s18(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.lower("text")).alias("m"))
    return R.keep_first(docs, F.col("m"), [F.col("doc_id")]).drop("m")


@query("u01_unanimous", "SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3")
def u01(spark, sf_dir):
    return R.unanimous(table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'purchase')"), "user_id", "event_type", 3)


@query("u02_difference", "(SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def u02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("u03_union_sorted_ids", "SELECT conv_id, string_agg(DISTINCT role, ';' ORDER BY role) AS roles, count(*) AS turns FROM conversations GROUP BY 1")
def u03(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ";").alias("roles"), F.count("*").alias("turns"))


@query("u05_disjointness", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE lang = 'fr')) AS overlap, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS outside")
def u05(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    overlap = docs.where("lang = 'en'").select("doc_id").intersect(docs.where("lang = 'fr'").select("doc_id")).agg(F.count("*").alias("overlap"))
    outside = labels.exceptAll(docs.select("doc_id")).agg(F.count("*").alias("outside"))
    return overlap.withColumn("k", F.lit(1)).join(outside.withColumn("k", F.lit(1)), "k").drop("k")


@query("w04_best_per_group", "SELECT source, lang, doc_id, rank FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3")
def w04(spark, sf_dir):
    out = R.top_per_group(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)
    return out.drop("n_chars").withColumn("rank", F.col("rank").cast("long"))


@query("w06_sequential_ids", "SELECT printf('Q%03d', row_number() OVER (ORDER BY n_chars DESC, doc_id)) AS id, doc_id FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)")
def w06(spark, sf_dir):
    top = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return R.numbered(top, [F.desc("n_chars"), F.asc("doc_id")], "Q%03d", "id").drop("n_chars")


@query("w07_round_robin", "SELECT lang, doc_id, turn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, lang LIMIT 30")
def w07(spark, sf_dir):
    return R.round_robin(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", [F.asc("doc_id")], 30).withColumn("turn", F.col("turn").cast("long"))


@query("w08_hash_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 5")
def w08(spark, sf_dir):
    return R.hash_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], F.col("doc_id"), 5)


@query("w12_id_runs", "SELECT lang, min(doc_id) AS lo, max(doc_id) AS hi FROM (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) GROUP BY lang, i")
def w12(spark, sf_dir):
    return R.islands(table(spark, sf_dir, "documents"), "lang", "doc_id")


@query("p18_expand_ids", "SELECT 'C' || lpad(i::VARCHAR, 3, '0') AS id, n_name FROM nation, LATERAL (SELECT unnest(range(n_nationkey, n_nationkey + 3)) AS i)")
def p18(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", F.format_string("C%03d-C%03d", "n_nationkey", F.col("n_nationkey") + 2).alias("ids"))
    return R.expand_ids(n, "ids").drop("ids")


@query("g01_constraint_issues", """SELECT o_orderkey, 'bad_status' AS issue FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'no_customer' FROM orders WHERE o_custkey % 50 = 0 UNION ALL SELECT o_orderkey, 'low_price' FROM orders WHERE o_totalprice < 2000""")
def g01(spark, sf_dir):
    rules = [("bad_status", ~F.col("o_orderstatus").isin("F", "O")), ("no_customer", F.col("o_custkey") % 50 == 0), ("low_price", F.col("o_totalprice") < 2000)]
    return gates.issues(table(spark, sf_dir, "orders"), "o_orderkey", rules)


@query("g02_export_valid", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 2000")
def g02(spark, sf_dir):
    rules = [("bad_status", ~F.col("o_orderstatus").isin("F", "O")), ("low_price", F.col("o_totalprice") < 2000)]
    return gates.export_valid(table(spark, sf_dir, "orders"), "o_orderkey", rules, F.col("o_orderpriority").startswith("1")).select("o_orderkey")


@query("g07_access_status", """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'title_conflict' WHEN n_chars > 5000 THEN 'full_text_candidate' WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'licensed_version_of_record' WHEN lang = 'fr' THEN 'licensed_other' WHEN n_chars > 500 THEN 'metadata_only' ELSE 'not_found' END AS status FROM documents""")
def g07(spark, sf_dir):
    licence = F.when((F.col("lang") == "en") & (F.col("doc_id") % 2 == 0), "vor").when(F.col("lang") == "fr", "other")
    return table(spark, sf_dir, "documents").select("doc_id", gates.open_access_status(F.col("doc_id") % 17 == 0, F.col("n_chars") > 5000, licence, F.col("n_chars") > 500).alias("status"))
