"""Queries of extraction passes, review packets, checked proposals and the observation loop."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import design as D
from lodestone.operators import model_calls
from lodestone.operators import workflow as W
from lodestone.plans.registry import query, table


@query("x09_evidence_rows", "SELECT c_custkey AS paper_id, field_key, quote, location, location <> 'p. 1 UNVERIFIED' AS verified FROM (SELECT c_custkey, 'a' AS field_key, c_name AS quote, CASE WHEN c_custkey % 3 = 0 THEN 'p. 1 UNVERIFIED' ELSE 'p. 1' END AS location FROM customer UNION ALL SELECT c_custkey, 'b', c_mktsegment, 'p. 2' FROM customer)")
def x09(spark, sf_dir):
    entry = lambda q, at: F.struct(F.col(q).alias("quote"), at.alias("location"))
    at = F.when(F.col("c_custkey") % 3 == 0, "p. 1 UNVERIFIED").otherwise("p. 1")
    own = F.create_map(F.lit("a"), entry("c_name", at), F.lit("b"), entry("c_mktsegment", F.lit("p. 2")))
    return W.evidence_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), own.alias("evidence")))


@query("s07_text_parts", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, regexp_matches(t, '^[A-Z][a-z]+ [a-z]+ [a-z]+ ') AS h FROM l),
    m AS (SELECT *, h OR trim(t) = '' AS b FROM o),
    p AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS section, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run, last_value(CASE WHEN h THEN trim(t) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS title FROM m)
    SELECT doc_id, section, md5(any_value(title)) AS title, min(start) AS start, max(start + length(t)) AS end FROM p WHERE NOT b GROUP BY doc_id, section, run""")  # fmt: skip
def s07(spark, sf_dir):
    out = W.text_parts(table(spark, sf_dir, "documents"), "doc_id", "text", "^[A-Z][a-z]+ [a-z]+ [a-z]+ ")
    return out.select("doc_id", "section", F.md5("title").alias("title"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("l15_section_hints", "SELECT r_regionkey, CASE r_regionkey % 2 WHEN 0 THEN 'methods;results;abstract' ELSE 'abstract;results' END AS hints FROM region")
def l15(spark, sf_dir):
    blocks = F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("d"), F.lit("M"), F.lit("Z"))).otherwise(F.array(F.lit("m")))
    hints = W.section_hints(blocks, {"D": ["methods", "results"], "M": ["abstract", "results"]})
    return table(spark, sf_dir, "region").select("r_regionkey", F.array_join(hints, ";").alias("hints"))


@query("l04_block_extraction", """SELECT c_custkey AS paper_id, 'A' AS block, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'g' END AS species FROM customer
    UNION ALL SELECT c_custkey, 'D', NULL, 'dose of ' || c_name FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""")
def l04(spark, sf_dir):
    """Papers of keys divisible by 5 have no text, the second pass fails for keys divisible by 7; block Z wasn't asked for."""

    def factory():
        def answer(prompt: str) -> str:
            guide, text = prompt.split("\n\n", 1)
            name, key = text.split("\n")
            if guide.startswith("A:"):
                return json.dumps({"A": {"title": name, "species": "g", "paper_id": "other"}, "Z": {"x": "y"}})
            if int(key) % 7 == 0:
                raise model_calls.FatalCallError
            return json.dumps({"D": {"species": f"dose of {name}"}, "A": {"title": "late"}})

        return model_calls.MockClient(answer)

    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "paper_id")
    papers = c.select("paper_id", F.when(F.col("paper_id") % 5 != 0, F.concat_ws("\n", "c_name", F.col("paper_id").cast("string"))).alias("text"))
    answers = model_calls.call(W.block_prompts(papers, {"A": "who and what", "D": "doses"}), factory)
    out = W.block_values(answers, c.select("paper_id", F.col("c_mktsegment").alias("title")), ["title"])
    return out.select("paper_id", "block", F.try_element_at("value", F.lit("title")).alias("title"), F.try_element_at("value", F.lit("species")).alias("species"))


@query("l09_batch_screening", "SELECT (c_custkey // 10)::BIGINT AS batch, c_custkey AS number, CASE WHEN (c_custkey // 10) % 4 <> 3 AND c_custkey % 10 <> 5 THEN c_mktsegment = 'BUILDING' END AS relevant FROM customer")
def l09(spark, sf_dir):
    """A model that skips some rows, and whose answer is no JSON for every fourth batch."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), "c_mktsegment")
    batches = W.request_batches(c, "n", F.col("c_mktsegment"))
    said = F.to_json(F.transform(F.filter("items", lambda i: i["number"] % 10 != 5), lambda i: F.struct(i["number"].alias("number"), (i["item"] == "BUILDING").alias("relevant"))))
    answers = batches.withColumn("answer", F.when(F.col("batch") % 4 != 3, F.concat(F.lit("Here:\n```json\n"), said, F.lit("\n```"))).otherwise("sorry"))
    return W.screened(answers).select("batch", "number", "relevant")


@query("l07_verified_changes", """SELECT o_custkey AS candidate, o_orderkey AS change, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'unsupported' ELSE 'partial' END ELSE 'stated' END AS support,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'r [VERIFIER: unsupported evidence support - old]' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN 'r [VERIFIER: partial evidence support]' ELSE 'r' END AS rationale,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'candidate ' || o_custkey || ', change ' || o_orderkey || ' (' || o_orderpriority || '): ' || CASE o_orderstatus WHEN 'O' THEN 'unsupported' ELSE 'partial' END END AS caveat FROM orders""")  # fmt: skip
def l07(spark, sf_dir):
    """Every third change is checked twice, the later check counts; some answers are unknown words."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), F.col("o_orderkey").alias("change"), F.col("o_orderpriority").alias("variable"), F.lit("r").alias("rationale"), F.lit("stated").alias("support"), "o_orderstatus")
    word = F.when(F.col("o_orderstatus") == "F", " Supported ").when(F.col("o_orderstatus") == "O", "UNSUPPORTED").otherwise("maybe")
    last = F.struct(F.lit(2).alias("n"), word.alias("support"), F.when(F.col("o_orderstatus") == "O", "old").alias("reason"))
    checks = own.where("change % 3 = 0").select("candidate", "change", F.inline(F.array(F.struct(F.lit(1).alias("n"), F.lit("supported").alias("support"), F.lit("").alias("reason")), last)))
    return W.verified_changes(own.drop("o_orderstatus"), checks).drop("variable")


@query("l13_review_packet", """WITH t AS (SELECT n_nationkey AS review_id, n_nationkey * 3 AS doc_id FROM nation), o AS (SELECT t.review_id, CASE WHEN t.review_id % 6 <> 5 THEN t.doc_id END AS paper_id, CASE WHEN t.review_id % 6 <> 5 THEN d.text END AS text FROM t LEFT JOIN documents d USING (doc_id)),
    l AS (SELECT review_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM o),
    s AS (SELECT review_id, (contains(lower(t), 'the')::INT + contains(lower(t), 'und')::INT + contains(lower(t), 'on')::INT)::DOUBLE AS score, coalesce(sum(length(t) + 1) OVER (PARTITION BY review_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, start) AS place FROM s WHERE score > 0),
    h AS (SELECT review_id, string_agg(start || ':' || score::INT, ';' ORDER BY place) AS hits FROM r WHERE place <= 5 GROUP BY 1)
    SELECT review_id, paper_id, CASE WHEN paper_id IS NULL THEN 'missing_ingested_paper' WHEN trim(coalesce(text, '')) = '' THEN 'missing_fulltext' ELSE 'ready_for_human_review' END AS status, CASE WHEN trim(coalesce(text, '')) <> '' THEN sha256(text) END AS source_sha256, hits FROM o LEFT JOIN h USING (review_id)""")  # fmt: skip
def l13(spark, sf_dir):
    tasks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("review_id"), F.col("n_nationkey").alias("record_id"), F.array(F.lit("the"), F.lit("UND"), F.lit("on")).alias("terms"))
    matches = tasks.where("review_id % 6 <> 5").select("record_id", (F.col("review_id") * 3).alias("paper_id"))
    out = W.review_packet(tasks, matches, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text"))
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["start"].cast("string"), h["score"].cast("int").cast("string"))), ";")
    return out.select("review_id", "paper_id", "status", "source_sha256", hits.alias("hits"))


@query("l18_flat_rows", "SELECT n_regionkey::VARCHAR AS region, string_agg(n_name, ';' ORDER BY n_name) AS names, CASE WHEN n_regionkey > 2 THEN 'yes' ELSE 'no' END AS late, '-' AS note FROM nation GROUP BY n_regionkey")
def l18(spark, sf_dir):
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return W.flat_row(own.withColumn("late", F.col("region") > 2).withColumn("note", F.lit("")))


@query("o10_ask")
def o10(spark, sf_dir):
    """Two measured objectives, parts as the pool, a model's ideas and a decaying prior; rows only, as linear algebra differs in the last digits."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_size") / 50).cast("double"), F.col("p_retailprice") / 2500).alias("x"))
    pool = p.withColumn("prior", D.log_prior([("size", 1.0, 1)], lambda _: F.col("x")[0]))
    ideas = spark.createDataFrame([("i1", [0.2, 0.1], "low dose", 0.0), ("i2", [0.9, 0.2], "high dose", 0.5)], "id string, x array<double>, rationale string, prior double")
    seen = [[0.1, 0.4], [0.5, 0.6], [0.9, 0.8], [0.3, 0.9]]
    observed = spark.createDataFrame([(x, [x[0], x[1]]) for x in seen], "x array<double>, objectives array<double>")
    return W.ask(observed, pool, ["max", "min"], 3, ideas=ideas, beta=2.0)
