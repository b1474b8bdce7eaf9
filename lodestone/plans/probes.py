"""Probe and manifest queries over all documents, with a mock client that also gives faulty answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from lodestone.operators import manifests as M
from lodestone.operators import probes as P
from lodestone.operators.model_calls import MeteredClient
from lodestone.plans.registry import query, table
from lodestone.streaming.events import stored

SIZE, REPEATS = 25, 2


def reply(prompt: str) -> tuple[str, dict]:
    """The mock: items with three digits in a row; in the second repeat not those whose id ends in 7; some batches get faulty answers."""
    asked = json.loads(prompt.partition("\n")[2])
    ids = [x["id"] for x in asked["items"] if re.search(r"[0-9]{3}", x.get("text") or "") and not (asked["repeat"] == 2 and x["id"].endswith("7"))]
    kind = int(asked["items"][0]["id"]) // SIZE % 12
    answer = {3: "Sorry, none of these.", 5: json.dumps({"candidate_ids": ids, "why": "digits"}), 7: json.dumps({"candidate_ids": [*ids, "zero"]}), 9: json.dumps({"candidate_ids": ["9", "9"]}), 11: json.dumps({"candidate_ids": [1]})}
    return answer.get(kind, json.dumps({"candidate_ids": ids})), {"prompt_tokens": len(asked["items"]), "completion_tokens": len(ids)}


def client():
    return MeteredClient(reply)


def probe(spark, sf_dir):
    """The log of a probe of all documents: first for one repeat, then again for both, which asks for the rest alone."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive"))
    items = docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("snippet"), "doc_id").join(labels, "doc_id", "left").drop("doc_id").fillna(False, ["positive"])
    text = F.to_json(F.struct(F.col("repeat"), F.col("items")))
    wanted = P.requests(items, size=SIZE, repeats=REPEATS, prompt=lambda _: F.concat(F.lit("Name the items with numbers.\n"), text), model="mock", version="1")
    at, n = stored(spark), wanted.count()
    budget = P.Budget(requests=n, tokens=n * 3 * SIZE, seconds=3600, request_tokens=2 * SIZE)
    P.run(wanted.where("repeat = 1"), client, at, budget)
    seen = P.run(wanted, client, at, budget)
    return items, P.log(spark, at), seen


_BATCHES = f"""b AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // {SIZE} AS batch FROM documents), s AS (SELECT r.repeat, batch, doc_id, regexp_matches(coalesce(text, ''), '[0-9]{{3}}') AND NOT (repeat = 2 AND doc_id % 10 = 7) AS hit, min(doc_id) OVER (PARTITION BY batch) // {SIZE} % 12 AS kind FROM b, (SELECT unnest([1, 2]) AS repeat) r),
q AS (SELECT repeat, batch, count(*) AS n_items, min(kind) AS kind, count(*) FILTER (hit) AS hits FROM s GROUP BY ALL),
j AS (SELECT *, CASE kind WHEN 3 THEN 'invalid_json' WHEN 5 THEN 'not_only_candidate_ids' WHEN 7 THEN 'unexpected_ids' WHEN 9 THEN 'duplicates' WHEN 11 THEN 'not_a_string_list' END AS issue FROM q)"""


@query("l08_probe_log", f"WITH {_BATCHES} SELECT repeat::INT AS repeat, batch::BIGINT AS batch, n_items, issue, CASE WHEN issue IS NULL THEN hits ELSE 0 END AS n_selected, n_items AS prompt_tokens, hits AS completion_tokens FROM j")
def l08(spark, sf_dir):
    _, log, _ = probe(spark, sf_dir)
    return P.answers(log).select("repeat", "batch", F.size("item_ids").cast("long").alias("n_items"), "issue", F.size("selected").cast("long").alias("n_selected"), "prompt_tokens", "completion_tokens")


@query("l08_probe_result", f"""WITH {_BATCHES}, i AS (SELECT doc_id, repeat, hit AND issue IS NULL AS sel, coalesce(quality = 1, false) AS p FROM s JOIN j USING (repeat, batch) LEFT JOIN labels USING (doc_id)),
k AS (SELECT doc_id, p, count(*) FILTER (sel) AS k FROM i GROUP BY ALL), g AS (SELECT repeat, round(count(*) FILTER (sel AND p) / count(*) FILTER (p), 4) AS recall, CASE WHEN count(*) FILTER (sel) > 0 THEN round(count(*) FILTER (sel AND p) / count(*) FILTER (sel), 4) ELSE 0 END AS prec FROM i GROUP BY 1)
SELECT (SELECT count(*) FROM k) AS items, (SELECT count(*) FROM k WHERE p) AS positives, (SELECT recall FROM g WHERE repeat = 1) AS recall_1, (SELECT recall FROM g WHERE repeat = 2) AS recall_2, (SELECT prec FROM g WHERE repeat = 1) AS precision_1, (SELECT prec FROM g WHERE repeat = 2) AS precision_2,
(SELECT round(count(*) FILTER (k IN (0, 2)) / count(*), 4) FROM k) AS consistency, (SELECT count(*) FROM k WHERE p AND k < 2) AS false_negatives, (SELECT count(*) FROM k WHERE NOT p AND k > 0) AS false_positives, (SELECT count(*) FROM j) AS requests, (SELECT count(*) FROM j WHERE issue IS NULL) AS valid, (SELECT sum(n_items + hits)::BIGINT FROM j) AS tokens, false AS passed""")
def l08_result(spark, sf_dir):
    items, log, _ = probe(spark, sf_dir)
    m = P.measured(P.answers(log), items, REPEATS)
    each = [F.col(f"{c}s")[k].alias(f"{c}_{k + 1}") for c in ("recall", "precision") for k in range(REPEATS)]
    return m.select("items", "positives", *each, "consistency", "false_negatives", "false_positives", "requests", "valid", "tokens", "passed")


@query("l14_usage", f"WITH {_BATCHES} SELECT 'requests' AS measure, count(*) AS observed, count(*) AS logged, true AS equal FROM j UNION ALL SELECT 'tokens', sum(n_items + hits)::BIGINT, sum(n_items + hits)::BIGINT, true FROM j")
def l14(spark, sf_dir):
    """What the tasks of all waves observed, against the log; the first run's part was logged before the second one began."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("snippet"))
    text = F.to_json(F.struct(F.col("repeat"), F.col("items")))
    wanted = P.requests(docs, size=SIZE, repeats=REPEATS, prompt=lambda _: F.concat(F.lit("Name the items with numbers.\n"), text), model="mock", version="1")
    at, n = stored(spark), wanted.count()
    seen = P.run(wanted, client, at, P.Budget(requests=n, tokens=n * 3 * SIZE, seconds=3600, request_tokens=2 * SIZE, wave=32))
    return P.reconcile(seen, P.log(spark, at))


def pool(spark, sf_dir):
    """Each document is a page of its source: positive if labelled good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("positive", F.lit(True))
    pages = docs.join(labels, "doc_id", "left").select(F.col("source").alias("record_id"), F.col("doc_id").alias("page"), F.col("text").alias("excerpt"), F.coalesce("positive", F.lit(False)).alias("positive"))
    return M.page_pool(pages, negatives_per_positive=0.5).cache()


_POOL = """d AS (SELECT source AS record_id, doc_id AS page, text, sha256(coalesce(text, '')) AS sha256, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS positive FROM documents),
h AS (SELECT *, sha256(concat_ws(':', record_id, page, sha256)) AS h FROM d), c AS (SELECT record_id, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive AND coalesce(text, '') <> '') AS nd, count(*) FILTER (positive AND coalesce(text, '') = '') AS nb FROM d GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id, positive ORDER BY h, page) AS k, round_even(np * 0.5, 0) AS needed FROM h JOIN c USING (record_id) WHERE coalesce(text, '') <> ''),
pool AS (SELECT 'P' || left(h, 16) AS item_id, record_id, page, sha256, positive, CASE WHEN np = 0 THEN 'no_positive_page' WHEN nb > 0 THEN 'positive_page_without_excerpt' WHEN nd < needed THEN 'insufficient_decoys' END AS fault FROM k WHERE positive OR k <= needed)"""


@query("l12_page_pool", f"WITH {_POOL} SELECT item_id, record_id, page, sha256, positive, fault FROM pool")
def l12(spark, sf_dir):
    return pool(spark, sf_dir).select("item_id", "record_id", "page", "sha256", "positive", "fault")


@query("l10_manifest_faults", f"""WITH {_POOL}, m AS (SELECT *, row_number() OVER (ORDER BY item_id) AS position, lead(item_id) OVER (ORDER BY item_id) AS nxt, lag(item_id) OVER (ORDER BY item_id) AS prv FROM pool WHERE positive)
SELECT 'tampered' AS fault, item_id, CASE WHEN page % 6 = 0 THEN 'page,sha256' ELSE 'sha256' END AS detail FROM m WHERE page % 3 = 0 AND page % 5 <> 0
UNION ALL SELECT 'missing', item_id, NULL FROM m WHERE page % 5 = 0 UNION ALL SELECT 'unknown', 'X' || item_id, NULL FROM m WHERE page % 5 = 0 AND page % 10 <> 0
UNION ALL SELECT 'overlap', item_id, NULL FROM m WHERE record_id = (SELECT min(record_id) FROM pool) AND page % 5 <> 0
UNION ALL SELECT 'overlap', 'X' || item_id, NULL FROM m WHERE record_id = (SELECT min(record_id) FROM pool) AND page % 5 = 0 AND page % 10 <> 0
UNION ALL SELECT 'candidates_hash', NULL, NULL UNION ALL SELECT 'selected_count', NULL, NULL WHERE (SELECT count(*) FROM m WHERE page % 10 = 0) > 0""")
def l10(spark, sf_dir):
    """A manifest of the positive pages with changed hashes and pages, rows left out, and unknown rows in their place; the first source was used before.

    Order is left out here (unknown rows shift it); tests change the order alone.
    """
    own = pool(spark, sf_dir)
    chosen = own.where("positive").select("item_id")
    header, rows = M.manifest(own, chosen, stable=True, recall=1.0)
    page, bad = F.col("page"), (F.col("page") % 3 == 0) & (F.col("page") % 5 != 0)
    changed = rows.where((page % 5 != 0) | (page % 10 != 0)).select(
        "position", F.when(page % 5 == 0, F.concat(F.lit("X"), "item_id")).otherwise(F.col("item_id")).alias("item_id"), "record_id", F.when(bad & (page % 6 == 0), -page).otherwise(page).alias("page"), "block",
        F.when(bad, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"),
    )
    first = own.select(F.min("record_id").alias("record_id"))
    return M.faults(header, changed, own, chosen, first).where("fault <> 'reordered'")


@query("l10_held_out", f"""WITH {_POOL}, silver AS (SELECT source AS record_id, doc_id, CASE WHEN doc_id % 4 = 1 THEN sha256('x' || coalesce(text, '')) ELSE sha256(coalesce(text, '')) END AS sha256 FROM documents WHERE doc_id % 2 = 1),
g AS (SELECT s.doc_id, pool.item_id, pool.positive FROM silver s LEFT JOIN pool ON pool.record_id = s.record_id AND pool.page = s.doc_id AND pool.sha256 = s.sha256 WHERE s.record_id IN (SELECT record_id FROM pool))
SELECT count(*) AS silver_total, count(item_id) AS prefilter_covered, count(*) FILTER (coalesce(positive, false)) AS selected, round(count(*) FILTER (coalesce(positive, false)) / count(*), 4) AS recall, sha256(coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) FILTER (NOT coalesce(positive, false)), '')) AS missed_sha256 FROM g""")
def l10_held_out(spark, sf_dir):
    """All odd documents as locators, half of them with the hash of another text."""
    own, docs = pool(spark, sf_dir), table(spark, sf_dir, "documents").where("doc_id % 2 = 1")
    text = F.coalesce("text", F.lit(""))
    silver = docs.select(F.col("doc_id").cast("string").alias("item_id"), F.col("source").alias("record_id"), F.col("doc_id").alias("page"), F.lit(-1).alias("block"), F.sha2(F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("x"), text)).otherwise(text), 256).alias("sha256"))
    out = M.evaluate(own, own.where("positive").select("item_id"), silver)
    return out.select("silver_total", "prefilter_covered", "selected", "recall", F.sha2(F.array_join("missed_ids", ","), 256).alias("missed_sha256"))
