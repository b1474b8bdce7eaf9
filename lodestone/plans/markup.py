"""Queries whose functions SQL doesn't have: markup, Unicode, sequence similarity, model calls. Held by unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import udf
from lodestone.operators import model_calls
from lodestone.plans.registry import query, r6, s6, table
from lodestone.sources import markup


@query("x02_page_parts")
def x02(spark, sf_dir):
    """The parts of all pages."""
    return markup.parts(table(spark, sf_dir, "pages"), "page_id", "html", "html")


@query("x06_page_text")
def x06(spark, sf_dir):
    return markup.document_text(markup.parts(table(spark, sf_dir, "pages"), "page_id", "html", "html"))


@query("x20_author_lists", """SELECT o_custkey::VARCHAR AS doc_id, string_agg(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority || ' ' END || 'Name' || o_orderkey, ';' ORDER BY o_orderkey) AS authors FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def x20(spark, sf_dir):
    """Articles made of customers' orders: an author each, some without given names, and editors, who are no authors."""
    kind = F.when(F.col("o_orderstatus") == "F", "editor").otherwise("author")
    given = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("<given-names> "), "o_orderpriority", F.lit("</given-names>")))
    one = F.concat(F.lit('<contrib contrib-type="'), kind, F.lit('"><name><surname>Name'), F.col("o_orderkey").cast("string"), F.lit("</surname>"), given, F.lit("</name></contrib>"))
    xml = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("x")))).alias("x"))
    docs = xml.select("o_custkey", F.concat(F.lit("<article><front><contrib-group>"), F.array_join("x.x", ""), F.lit("</contrib-group></front></article>")).alias("xml"))
    return markup.author_lists(markup.parts(docs, "o_custkey", "xml")).select("doc_id", F.array_join("authors", ";").alias("authors"))


@query("f03_slugs", r"""WITH a AS (SELECT doc_id, text, lower(regexp_replace(strip_accents(trim(coalesce(text, ''))), '[^\x00-\x7F]', '', 'g')) AS t FROM documents),
b AS (SELECT doc_id, text, trim(left(regexp_replace(regexp_replace(regexp_replace(t, '[\s_-]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), 80), '-') AS s FROM a)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN s = '' THEN 'untitled' ELSE s END AS slug, trim(replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), 'ß', 'ss')) AS title FROM b""")
def f03(spark, sf_dir):
    """F03, F06."""
    return table(spark, sf_dir, "documents").select("doc_id", udf.slugify("text").alias("slug"), udf.normalize_markup_title("text").alias("title"))


@query("f08_title_ratio")
def f08(spark, sf_dir):
    """similarity of neighbours' names."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", udf.title_ratio("p_name", "p_brand").alias("ratio"))


@query("e02_effect_inference", "SELECT l_orderkey, l_linenumber, " + s6("CASE WHEN l_returnflag = 'A' THEN ln(l_quantity::INTEGER) WHEN l_returnflag = 'N' AND l_quantity::INTEGER < 100 THEN ln(1 - l_quantity::INTEGER / 100) END") + ", NULL::DOUBLE AS variance, CASE WHEN l_returnflag <> 'R' THEN 'explicit_fold_or_percent' END AS source FROM lineitem".replace(", NULL", " AS effect, NULL", 1))
def e02(spark, sf_dir):
    """E02-E06 over quotes made of order lines."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    q = F.col("l_quantity").cast("int").cast("string")
    quote = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("growth increased "), q, F.lit("-fold"))).when(F.col("l_returnflag") == "N", F.concat(F.lit("viability was reduced by "), q, F.lit("%"))).otherwise(F.concat(q, F.lit("% FBS medium")))
    return line.select("l_orderkey", "l_linenumber", udf.infer_effect(quote, F.lit(1), F.lit("x")).alias("e")).select("l_orderkey", "l_linenumber", r6(F.col("e.effect")).alias("effect"), "e.variance", "e.source")


@query("e06_group_statistics", f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER::DOUBLE AS q, (1 + l_partkey % 90)::DOUBLE AS p, (1 + l_suppkey % 9)::DOUBLE AS d, (l_orderkey + l_linenumber) % 6 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, {s6("CASE WHEN k <> 4 THEN ln(q / p) END")} AS effect, {s6("CASE k WHEN 0 THEN d * d / (5 * q * q) + 4 / (4 * p * p) WHEN 1 THEN d * d * 6 / (6 * q * q) + 0.25 * 0.25 * 9 / (9 * p * p) WHEN 2 THEN 1 / (5 * q * q) + 1 / (5 * p * p) WHEN 5 THEN d * d / (7 * q * q) + d * d / (8 * p * p) END")} AS variance,
CASE WHEN k IN (0, 1, 2, 5) THEN 'treatment_control_mean_sd_n' WHEN k = 3 THEN 'treatment_control_means' END AS source FROM l""")
def e06(spark, sf_dir):
    """Means with standard deviations or errors, a label whose clause is longer than a label may be, bare means, a label of both groups, and the shape with plus and minus."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), (1 + F.col("l_partkey") % 90).alias("p"), (1 + F.col("l_suppkey") % 9).alias("d"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).alias("k"))
    shapes = [
        "treated cells mean %1$d SD %3$d n 5; control cells mean %2$d SD 2 n 4", "FGF2 mean = %1$d, SEM = %3$d, n = 6; vehicle mean = %2$d, s.e.m. 0.25, n = 9",
        "the control donors that were pooled over several weeks and then expanded once again before the treated cells mean %1$d SD 1 n 5; control cells mean %2$d SD 1 n 5", "treated cells reached %1$d units in culture; control cells reached %2$d units in culture",
        "treated versus control cells mean %1$d SD 1 n 5; control mean %2$d SD 1 n 5", "treated: %1$d ± %3$d (SD, n = 7); control: %2$d ± %3$d (SD, n = 8)",
    ]
    quote = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        quote = F.when(F.col("k") == k, F.format_string(shape, "q", "p", "d")).otherwise(quote)
    out = line.select("l_orderkey", "l_linenumber", udf.infer_effect(quote, F.lit(1), F.lit("FGF2")).alias("e"))
    return out.select("l_orderkey", "l_linenumber", r6(F.col("e.effect")).alias("effect"), r6(F.col("e.variance")).alias("variance"), "e.source")


@query("l05_operator_extraction", r"""WITH q AS (SELECT doc_id, trim(regexp_replace(left(coalesce(text, ''), 40), '\s+', ' ', 'g')) AS q FROM documents)
SELECT doc_id, operator, CASE WHEN length(q) >= 8 THEN 'ok' ELSE 'ungrounded' END AS status, CASE WHEN length(q) >= 8 THEN 'x' END AS value FROM q, (VALUES ('context'), ('dose')) o(operator)""")
def l05(spark, sf_dir):
    """L01, L05, E01 with a mock that quotes the text's beginning."""

    def factory():
        import json

        return model_calls.MockClient(lambda p: "```json\n" + json.dumps({"value": "x", "quote": (p.split("\n\n", 2) + [""] * 3)[2][:40]}) + "\n```")

    papers = table(spark, sf_dir, "documents").select("doc_id", "text")
    return model_calls.grounded_values(model_calls.call(model_calls.prompts(papers, {"context": "g", "dose": "g"}), factory)).select("doc_id", "operator", "status", "value")
