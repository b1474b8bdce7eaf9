"""Queries over whole tables for functions, gates, sources and sinks that no other query runs; files are written and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import udf
from lodestone.operators import meta, pointers, retrieve, segment
from lodestone.operators import relational as R
from lodestone.plans.evidence import ITEMS, SUMMARIES, items
from lodestone.operators.ranks import ranked
from lodestone.plans.registry import query, r6, s6, table
from lodestone.sources import bibtex, sinks, tables
from lodestone.streaming.events import stored

CASE5 = "CASE {k} % 5 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} WHEN 3 THEN {d} ELSE {e} END"


def of5(key, *values):
    """One of five values by a key."""
    k = F.col(key) % 5
    return F.when(k == 0, values[0]).when(k == 1, values[1]).when(k == 2, values[2]).when(k == 3, values[3]).otherwise(values[4])


@query("p02_codes", "SELECT c_custkey, trim(v) IN ('NR', 'NA', 'UNC') AS code, starts_with(ltrim(v), 'INF:') AS inferred, lower(trim(v)) IN ('', 'unknown', 'nr', 'na', 'unc') AS missing FROM (SELECT c_custkey, " + CASE5.format(k="c_custkey", a="' NR '", b="' INF: ' || c_mktsegment", c="'Unknown'", d="''", e="c_mktsegment") + " AS v FROM customer)")
def p02(spark, sf_dir):
    """P02, P03, P09."""
    v = of5("c_custkey", F.lit(" NR "), F.concat(F.lit(" INF: "), "c_mktsegment"), F.lit("Unknown"), F.lit(""), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.is_code(v).alias("code"), T.is_inference(v).alias("inferred"), T.is_missing(v).alias("missing"))


@query("p05_dose_support", "SELECT p_partkey, contains(lower(q), lower(p_name)) AND contains(q, p_size || ' ng/ml') AND p_partkey % 5 <> 2 AND p_partkey % 5 <> 3 AS supported FROM (SELECT *, " + CASE5.format(k="p_partkey", a="p_name || ' at ' || p_size || ' ng/ml was best'", b="upper(p_name) || '  with  ' || p_size || ' ng/ml'", c="p_name || ' at ' || p_size || ' ng/ml was best'", d="p_name || ' at ' || p_size || ' ng/ml was best'", e="'nothing of the kind was used here'") + " AS q FROM part)")
def p05(spark, sf_dir):
    size = F.concat(F.col("p_size").cast("string"), F.lit(" ng/ml"))
    best = F.concat("p_name", F.lit(" at "), size, F.lit(" was best"))
    q = of5("p_partkey", best, F.concat(F.upper("p_name"), F.lit("  with  "), size), best, best, F.lit("nothing of the kind was used here"))
    dose = F.when(F.col("p_partkey") % 5 == 2, "some").otherwise(F.col("p_size").cast("string"))
    whole = F.when(F.col("p_partkey") % 5 == 3, F.lit("another text")).otherwise(F.concat(F.lit("We saw that "), q))
    return table(spark, sf_dir, "part").select("p_partkey", T.dose_supported(F.col("p_name"), dose, F.lit("ng/ml"), q, whole).alias("supported"))


@query("p10_stat_candidates", "SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 3) AS stat FROM orders")
def p10(spark, sf_dir):
    v = of5("o_orderkey", F.lit("2.1 ± 0.3"), F.lit("mean (SEM 0.2)"), F.col("o_orderpriority"), F.lit("n = 6 wells"), F.lit("sdk"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_stat_candidate(v).alias("stat"))


@query("f02_review_tokens", "SELECT item_id, array_to_string(list_sort(list_distinct([x FOR x IN [regexp_replace(t, '^[-_/]+|[-_/]+$', '', 'g') FOR t IN regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-_/]*')] IF (length(x) >= 3 OR x IN ('b8', 'b9')) AND x NOT IN ('the', 'and', 'was')])), ' ') AS tokens FROM benchmark")
def f02(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.review_tokens(F.col("text"), ("the", "and", "was", "with"), ("with",))), " ").alias("tokens"))


@query("f10_component_terms", "SELECT p_partkey, array_to_string([x.t FOR x IN list_sort([{'k': -length(t), 't': t} FOR t IN list_distinct(list_concat([lower(trim(p_name))], [lower(p) FOR p IN regexp_split_to_array(p_name, '[^A-Za-z0-9+\\-]+') IF length(p) >= 3]))])], '|') AS terms FROM part")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.component_terms(F.col("p_name")), "|").alias("terms"))


@query("f12_snippets", "WITH h AS (SELECT doc_id, text, coalesce(nullif(instr(lower(text), 'und'), 0), nullif(instr(lower(text), 'the'), 0), 1) AS hit FROM documents WHERE length(text) = strlen(text)) SELECT doc_id, sha256(trim(substring(text, greatest(1, hit - 80), 240), ' ')) AS snippet FROM h")
def f12(spark, sf_dir):
    """Of texts in ASCII: the engines fold other letters differently."""
    own = table(spark, sf_dir, "documents").where("length(text) = octet_length(text)")
    return own.select("doc_id", F.sha2(T.snippet(F.col("text"), ["und", "the"]), 256).alias("snippet"))


@query("f15_scrubbed", "SELECT c_custkey, 'key [REDACTED] and Bearer [REDACTED] for ' || c_name AS t FROM customer")
def f15(spark, sf_dir):
    t = F.concat(F.lit("key sk-abc"), F.col("c_custkey") + 1000, F.lit(" and Bearer x.y-"), F.col("c_custkey"), F.lit(" for "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.scrub(t).alias("t"))


@query("f16_licences", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'CC-BY-4.0' ELSE 'CC-BY-NC-4.0' END WHEN 1 THEN 'CC-BY-NC-SA-3.0' WHEN 2 THEN 'CC0-1.0' WHEN 3 THEN 'CC-BY-4.0' END AS code FROM supplier")
def f16(spark, sf_dir):
    odd = F.col("s_suppkey") % 2 == 1  # a URL and a text that disagree: the URL counts
    url = of5("s_suppkey", F.when(odd, "https://creativecommons.org/licenses/by-nc/4.0/").otherwise("https://creativecommons.org/licenses/by/4.0/"), F.lit("HTTP://CreativeCommons.org/licenses/by-nc-sa/3.0"), F.lit("http://creativecommons.org/publicdomain/zero/1.0/"), F.lit(""), F.lit("http://example.org/licenses/by/4.0"))
    text = F.when(F.col("s_suppkey") % 5 == 3, "under Creative Commons Attribution 4.0 terms").when(F.col("s_suppkey") % 5 == 0, "see https://creativecommons.org/licenses/by/3.0/").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.licence_code(text, url).alias("code"))


@query("f18_matched_terms", "SELECT doc_id, array_to_string([t FOR t IN ['and', 'der', 'the', 'und'] IF contains(lower(text), t)], ';') AS terms FROM documents")
def f18(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.matched_terms(F.col("text"), ("the", "und", "and", "der")), ";").alias("terms"))


@query("f21_first_numbers", "SELECT o_orderkey, o_custkey::DOUBLE AS n, 'x/' || o_orderkey AS path FROM orders")
def f21(spark, sf_dir):
    """F21, F22."""
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.first_number(F.concat(F.lit("about "), F.col("o_custkey").cast("string"), F.lit(" of 7.5"))).alias("n"), T.relative_path(F.concat(F.lit("/base/x/"), k), "/base/").alias("path"))


@query("n03_quantity_lists", "SELECT p_partkey, array_to_string([p_size || '|%', (p_size + 1) || '|min'], ';') AS parsed FROM part")
def n03(spark, sf_dir):
    """A list's quantities, one by one."""
    size = F.col("p_size")
    texts = F.array(F.concat(size.cast("string"), F.lit(" %")), F.concat((size + 1).cast("string"), F.lit(" min")))
    own = table(spark, sf_dir, "part").select("p_partkey", F.transform(texts, lambda t: T.parse_quantity(t)).alias("q"))
    return own.select("p_partkey", F.array_join(F.transform("q", lambda q: F.concat_ws("|", q["value"].cast("int").cast("string"), q["unit"])), ";").alias("parsed"))


@query("n04_cell_numbers", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN l_quantity::INTEGER::DOUBLE + 1000 WHEN 1 THEN l_quantity::INTEGER::DOUBLE WHEN 2 THEN l_quantity::INTEGER::DOUBLE * 1000 WHEN 3 THEN NULL ELSE l_quantity::INTEGER::DOUBLE END AS mean, CASE WHEN l_linenumber % 5 = 3 THEN l_quantity::INTEGER::DOUBLE END AS n FROM lineitem")
def n04(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    s = q.cast("string")
    t = of5("l_linenumber", F.concat(F.lit("1,"), F.lpad(s, 3, "0")), F.concat(s, F.lit(" ± 0.5")), F.concat(s, F.lit(" × 10^3")), F.concat(F.lit("n = "), s), F.concat(s, F.lit("*")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.parse_cell_number(t, "mean").alias("mean"), F.when(F.col("l_linenumber") % 5 == 3, T.parse_cell_number(t, "n")).alias("n"))


@query("n05_deviations", "SELECT l_orderkey, l_linenumber, " + s6("CASE WHEN l_returnflag = 'A' THEN l_tax * sqrt(l_quantity) ELSE l_tax END") + " AS sd FROM lineitem")
def n05(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "sem").otherwise("sd")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(meta.sd_from_sem(F.col("l_tax").cast("double"), F.col("l_quantity").cast("double"), kind)).alias("sd"))


@query("n06_number_support", "SELECT o_orderkey, o_orderkey % 2 = 0 AS supported, CASE WHEN o_orderkey % 3 = 0 THEN '48 h' ELSE '' END AS at FROM orders")
def n06(spark, sf_dir):
    """N06, N12."""
    k = F.col("o_orderkey")
    quote = F.concat(F.lit("we saw "), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("a"), k.cast("string"))), F.when(k % 3 == 0, " cells at 48 h").otherwise(" cells"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.supported_by(k.cast("double"), quote).alias("supported"), T.timepoint(quote).alias("at"))


@query("n07_lenient_numbers", "SELECT o_orderkey, try_cast(v AS DOUBLE) AS any, CASE WHEN try_cast(v AS DOUBLE) > 0 THEN try_cast(v AS DOUBLE) END AS positive FROM (SELECT o_orderkey, " + CASE5.format(k="o_orderkey", a="'12.5'", b="'-3'", c="'1e2'", d="'n/a'", e="''") + " AS v FROM orders)")
def n07(spark, sf_dir):
    v = of5("o_orderkey", F.lit("12.5"), F.lit("-3"), F.lit("1e2"), F.lit("n/a"), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.lenient(v).alias("any"), T.lenient(v, positive=True).alias("positive"))


@query("n09_normal", "SELECT l_orderkey, l_linenumber, printf('%.5f', exp(-0.5 * l_tax * l_tax) / sqrt(2 * pi())) AS pdf, (l_discount::DECIMAL(4, 2))::VARCHAR AS shown FROM lineitem")
def n09(spark, sf_dir):
    """N09, N10."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.5f", T.norm_pdf(F.col("l_tax").cast("double"))).alias("pdf"), F.format_string("%.2f", udf.short_number(F.col("l_discount").cast("double")).cast("double")).alias("shown"))


@query("n11_timestamps", "SELECT event_id, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events")
def n11(spark, sf_dir):
    """Times as UTC text."""
    return table(spark, sf_dir, "events").select("event_id", T.iso_utc(F.col("ts")).alias("at"))


@query("n13_similarity", "SELECT n_nationkey, " + s6("len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))") + " AS jaccard FROM (SELECT n_nationkey, list_distinct(string_split(lower(n_name), '')) AS a, list_distinct(string_split('aeiouxyz', '')) AS b FROM nation)")
def n13(spark, sf_dir):
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    return table(spark, sf_dir, "nation").select("n_nationkey", r6(T.jaccard(letters(F.lower("n_name")), letters(F.lit("aeiouxyz")))).alias("jaccard"))


@query("j08_manifest_audit", "SELECT s_suppkey, concat_ws(';', CASE WHEN s_suppkey % 9 = 0 THEN 'missing_right' END, CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 4 = 0 THEN 'differs_s_name' END, CASE WHEN s_suppkey % 9 <> 0 AND s_suppkey % 5 = 0 THEN 'differs_s_nationkey' END) AS failed FROM supplier")
def j08(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    audit = own.where("s_suppkey % 9 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "other").otherwise(F.col("s_name")).alias("s_name"), F.when(F.col("s_suppkey") % 5 == 0, -1).otherwise(F.col("s_nationkey")).alias("s_nationkey"))
    return R.reconcile(own, audit, "s_suppkey", ["s_name", "s_nationkey"])


@query("j15_figure_labels", "SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey % 20 = b.o_orderkey % 20 WHERE a.o_orderkey < b.o_orderkey")
def j15(spark, sf_dir):
    """Captions of one paper (customer) that name one figure."""
    n = (F.col("o_orderkey") % 20).cast("string")
    own = table(spark, sf_dir, "orders")
    a = own.select("o_custkey", "o_orderkey", pointers.figure_key(F.concat(F.lit("Fig. "), n, F.lit(" Cells"))).alias("k"))
    b = own.select("o_custkey", F.col("o_orderkey").alias("other"), pointers.figure_key(F.concat(F.lit("FIGURE "), n)).alias("k"))
    return a.join(b, ["o_custkey", "k"]).where("o_orderkey < other").select("o_orderkey", "other")


@query("k02_upsert_tiers", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE c_mktsegment END AS tier, c_nationkey FROM customer")
def k02(spark, sf_dir):
    """A judgement's tier over the stored one, other columns kept."""
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("tier"), "c_nationkey")
    new = base.where("c_custkey % 3 = 0").select("c_custkey", F.lit("A").alias("tier"), F.lit(None).cast("int").alias("c_nationkey"))
    return R.upsert(base, new, "c_custkey", keep_old=("c_nationkey",))


@query("t01_top_orders", "SELECT o_orderkey, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t01(spark, sf_dir):
    return retrieve.top_k(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score")), 25, "o_orderkey")


@query("t03_summary_order", f"{SUMMARIES} SELECT component, outcome, row_number() OVER (ORDER BY floor(abs(p - 0.5) * 1e9) DESC, k DESC, component, outcome) AS place FROM summaries")
def t03(spark, sf_dir):
    """The order as places; ties are those of nine digits in both engines."""
    out = meta.synthesize(items(spark, sf_dir)).withColumn("p_beneficial", F.floor(F.abs(F.col("p_beneficial") - 0.5) * 1e9) + 0.5)
    keys = (F.desc(F.abs(F.col("p_beneficial") - 0.5)), F.desc("k"), "component", "outcome")
    return meta.ranked(out).select("component", "outcome", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


@query("m05_tiers", f"{ITEMS} SELECT component, outcome, paper_id, CASE WHEN paper_id::VARCHAR LIKE '%3' THEN 3 WHEN paper_id::VARCHAR LIKE '%2' THEN 2 ELSE 1 END AS tier, CASE WHEN paper_id::VARCHAR LIKE '%3' THEN -1 ELSE sign(effect)::INTEGER END AS sign FROM items")
def m05(spark, sf_dir):
    """M05, A03's tiers: without effect a direction is left."""
    last = F.substring(F.col("paper_id").cast("string"), -1, 1)
    own = items(spark, sf_dir).withColumn("e", F.when(last != "3", F.col("effect"))).withColumn("v", F.when(~last.isin("2", "3"), F.col("variance")))
    return own.select("component", "outcome", "paper_id", meta.tier(F.col("e"), F.col("v")).alias("tier"), meta.sign(F.when(last == "3", F.lit(-1)).cast("int"), F.col("e")).alias("sign"))


@query("x05_routed_sections", "SELECT p_partkey, contains(lower(p_name), 'red') OR contains(lower(p_name), 'gear') AS methods FROM part")
def x05(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", segment.routed(F.col("p_name"), ["RED", "gear"]).alias("methods"))


@query("x18_structure_counts", "SELECT 'o' || l_orderkey AS doc_id, 1::BIGINT AS tables, count(*) AS cells, count(*) FILTER (l_linenumber % 2 = 0) AS stat_cells, count(*) FILTER (l_linenumber = 1) + 1 AS context FROM lineitem GROUP BY l_orderkey")
def x18(spark, sf_dir):
    """An order is a document with one table, its lines are the cells, the first a header."""
    line = table(spark, sf_dir, "lineitem")
    doc = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc_id")
    n = F.col("l_linenumber")
    cells = line.select(doc, F.lit("cell").alias("kind"), F.concat(F.lit("T1.C"), n.cast("string")).alias("id"), F.lit("T1").alias("parent"), F.lit("").alias("title"), F.when(n % 2 == 0, "1 ± 2").otherwise("text").alias("text"), (n == 1).alias("is_header"))
    one = line.select(doc).distinct().select("doc_id", F.lit("table").alias("kind"), F.lit("T1").alias("id"), F.lit("").alias("parent"), F.lit("A caption").alias("title"), F.lit("").alias("text"), F.lit(False).alias("is_header"))
    parts = cells.unionByName(one)
    context = pointers.context_items(parts).groupBy("doc_id").agg(F.count("*").alias("context"))
    return pointers.structure_counts(parts).join(context, "doc_id")


@query("r06_term_passages", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT doc_id, least(count(*), 1000000) AS lines FROM l WHERE contains(lower(t), 'the') GROUP BY 1")
def r06(spark, sf_dir):
    """One passage for each line with a term, as buckets of one character hold one line each."""
    return segment.passage_hits(table(spark, sf_dir, "documents"), "doc_id", "text", ["the"], 1, 1_000_000).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("s11_tsv_round_trip", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || chr(9) || '\"q\"' END AS note FROM part")
def s11(spark, sf_dir):
    """Written as TSV with tabs, quotes and nulls, and read again."""
    at = stored(spark) + "/parts"
    note = F.when(F.col("p_size") % 3 != 0, F.concat("p_brand", F.lit('\t"q"')))
    sinks.write_tsv(table(spark, sf_dir, "part").select("p_partkey", "p_name", note.alias("note")), at, ["p_partkey"])
    return tables.read_tsv(spark, at, ["p_partkey", "p_name", "note"])


@query("k05_csv_round_trip", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name || ';' || s_nationkey AS both FROM supplier")
def k05(spark, sf_dir):
    """Lists are joined by semicolons."""
    at = stored(spark) + "/suppliers"
    sinks.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", F.array("s_name", F.col("s_nationkey").cast("string")).alias("both")), at, ["s_suppkey"])
    return tables.read_tsv(spark, at, ["s_suppkey", "both"], sep=",")


@query("k08_jsonl_round_trip", "SELECT item_id, text, strlen(text) AS bytes FROM benchmark")
def k08(spark, sf_dir):
    """Documents as JSON lines, read again as stored documents against a schema."""
    at = stored(spark) + "/items"
    sinks.write_jsonl(table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct("text", F.octet_length("text").alias("bytes"))).alias("json")), at)
    broken = spark.createDataFrame([(-1, "{not json")], "item_id long, json string")
    back = spark.read.json(at, schema="item_id long, json string").unionByName(broken)
    return tables.read_extractions(back, "text string, bytes long").select("item_id", "doc.text", "doc.bytes")


@query("s12_json_items", "SELECT n_name AS component, n_regionkey::VARCHAR AS paper_id, n_nationkey::DOUBLE / 2 AS effect, 1 AS direction FROM nation WHERE n_nationkey % 5 <> 0")
def s12(spark, sf_dir):
    """Arrays of items with numbers as text; those without a component go."""
    at = stored(spark) + "/evidence"
    name = F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name"))
    item = F.struct(name.alias("component"), F.col("n_regionkey").cast("string").alias("paper_id"), (F.col("n_nationkey") / 2).cast("string").alias("effect"), F.lit("1").alias("direction"))
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(item).alias("l")).select(F.to_json("l").alias("value"))
    lists.write.option("maxRecordsPerFile", 1).text(at)  # one array a file
    return tables.read_items(spark, at).select("component", "paper_id", "effect", "direction")


@query("s15_metadata_folders", "SELECT r_name AS title, 'slug=' || r_regionkey AS slug FROM region")
def s15(spark, sf_dir):
    """A folder for each paper; its name is the slug."""
    at = stored(spark) + "/papers"
    table(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_name").alias("title"))).alias("value"), F.col("r_regionkey").alias("slug")).write.partitionBy("slug").text(at)
    return tables.read_metadata(spark, at, "title string", name="*")


@query("s19_files", """WITH c AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 10 <> 0), f AS (SELECT k, CASE k % 10 WHEN 1 THEN 'tampered' WHEN 2 THEN 'extra' WHEN 3 THEN 'missing' WHEN 4 THEN 'unsafe_path' WHEN 5 THEN 'out_of_order' END AS fault FROM c)
SELECT k, fault FROM f WHERE fault IS NOT NULL UNION ALL SELECT k, 'extra' FROM f WHERE k % 10 = 4""")
def s19(spark, sf_dir):
    """A file for each supplier, a bundle's manifest with planted faults, and what the check finds.

    Files with another hash than the manifest says, files in no manifest, manifest rows without a file, with a path that leaves the folder, or in the wrong place.
    """
    at = stored(spark) + "/files"
    c = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select("s_name", F.col("s_suppkey").alias("k"))
    c.where("k % 10 <> 3").repartition("k").write.partitionBy("k").text(at)
    files = tables.read_files(spark, at, "part-*")
    own = files.select(F.regexp_extract("path", r"(k=\d+/[^/]+)$", 1).alias("path"), "sha256").withColumn("k", F.regexp_extract("path", r"^k=(\d+)", 1).cast("long"))
    kind = F.col("k") % 10
    rows = own.where(kind != 2).select("k", F.when(kind == 4, F.concat(F.lit("../files/"), "path")).otherwise(F.col("path")).alias("path"), F.when(kind == 1, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    lost = c.where("k % 10 = 3").select("k", F.concat(F.lit("k="), F.col("k").cast("string"), F.lit("/part-0.txt")).alias("path"), F.sha2("s_name", 256).alias("sha256"))
    ordered = ranked(rows.unionByName(lost), ["path"], "position").withColumn("position", F.when(F.col("k") % 10 == 5, -F.col("position") - 1).otherwise(F.col("position")))
    found = tables.bundle_faults(files, ordered.select("position", "path", "sha256"), at)
    return found.select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("long").alias("k"), "fault")


@query("s01_bibliography", "SELECT 'S' || s_suppkey AS paper_id, s_name AS title, (1990 + s_suppkey % 30)::INTEGER AS year, 'A, B;C, D' AS authors FROM supplier")
def s01(spark, sf_dir):
    """Entries written as text and parsed again."""
    at = stored(spark) + "/bib"
    k = F.col("s_suppkey")
    entry = F.concat(F.lit("@article{S"), k.cast("string"), F.lit(", title = {"), "s_name", F.lit('}, author = "A, B and C, D", year = '), (1990 + k % 30).cast("string"), F.lit("}"))
    table(spark, sf_dir, "supplier").select(entry.alias("value")).write.text(at)
    return bibtex.read_bibtex(spark, at).select("paper_id", "title", "year", F.array_join("authors", ";").alias("authors"))
