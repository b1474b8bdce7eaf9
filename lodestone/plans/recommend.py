"""Recommendations from all documents, and blocks found again in a changed version of all documents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import anchors as A
from lodestone.operators import model_calls
from lodestone.operators import recommend as R
from lodestone.plans.registry import query, table

#: Terms of the variables that may be changed; a language's documents are the passages of a goal.
TERMS = {"serum": ["the", "la"], "growth": ["of", "de"], "matrix": ["and", "y"], "oxygen": ["der", "el"], "glucose": ["in", "en"], "lipids": ["que"], "insulin": ["und"], "trace": ["les", "los"]}
K, N_CANDIDATES, MOST = 12, 2, 3


def packs(spark, sf_dir):
    terms = [t for v in TERMS.values() for t in v]
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("goal"), F.col("doc_id").cast("string").alias("paper_id"), F.col("text").alias("snippet"))
    score = F.size(F.array_intersect(R.tokens(F.col("snippet")), F.array(*map(F.lit, terms)))).cast("double")
    pack = R.evidence_pack(d.withColumn("score", score).where("score > 0 and goal is not null"), K).cache()
    return pack, spark.createDataFrame([(v, t) for v, ts in TERMS.items() for t in ts], "variable string, term string")


_TERMS = ", ".join(f"('{v}', '{t}')" for v, ts in TERMS.items() for t in ts)
_SUPPORT = rf"""v AS (SELECT * FROM (VALUES {_TERMS}) x(variable, term)), d AS (SELECT lang AS goal, doc_id::VARCHAR AS paper_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}-]+')) AS w FROM documents WHERE lang IS NOT NULL),
s AS (SELECT goal, paper_id, w, len([t FOR t IN {[t for ts in TERMS.values() for t in ts]} IF list_contains(w, t)])::DOUBLE AS score FROM d), pack AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score DESC, paper_id) AS k FROM s WHERE score > 0 QUALIFY k <= {K}),
sup AS (SELECT goal, variable, paper_id, any_value(score) AS score FROM pack JOIN v ON list_contains(w, term) GROUP BY ALL), ranked AS (SELECT goal, variable, sum(score) AS weight, list_sort(list(paper_id)) AS c FROM sup GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY weight DESC, variable) - 1 AS k FROM ranked)"""


@query("l07_proposals", f"WITH {_SUPPORT} SELECT goal, k % {N_CANDIDATES} + 1 AS candidate, k // {N_CANDIDATES} + 1 AS change, variable, weight, array_to_string(c, ',') AS citations FROM r WHERE k < {N_CANDIDATES * MOST}")
def l07_proposals(spark, sf_dir):
    pack, variables = packs(spark, sf_dir)
    out = R.proposals(pack, variables, n_candidates=N_CANDIDATES, most_changes=MOST)
    return out.select("goal", F.col("candidate").cast("long").alias("candidate"), F.col("change").cast("long").alias("change"), "variable", "weight", F.array_join("citations", ",").alias("citations"))


def reply(prompt: str) -> str:
    """The mock: a first candidate with one change too many, one of no variable and one without a resolvable citation; a second of one change; a third that nobody asked for."""
    asked = json.loads(prompt.partition("\n")[2])
    papers, names = [e["paper_id"] for e in asked["evidence"]], asked["variables"]
    change = lambda v, cited: {"variable": v, "change": f"more {v}", "rationale": "as cited", "cited_paper_ids": cited}
    first = [change(names[0], [*papers[:2], "none"]), change("price", papers[:1]), change(names[1], ["none"]), change(names[2], papers[:1])]
    return "Here:\n```json\n" + json.dumps({"candidates": [{"name": "a", "changes": first}, {"name": "b", "changes": [change(names[3], papers[-1:])]}, {"name": "c", "changes": [change(names[0], papers[:1])]}]}) + "\n```"


@query("l07_recommendations", f"""WITH {_SUPPORT}, p AS (SELECT goal, list(paper_id ORDER BY k) AS p FROM pack GROUP BY 1), n AS (SELECT list(variable ORDER BY variable) AS n FROM (SELECT DISTINCT variable FROM v))
SELECT goal, 1::BIGINT AS candidate, 1::BIGINT AS change, n[1] AS variable, array_to_string(list_sort(p[1:2]), ',') AS citations, 'none' AS unresolved, NULL::VARCHAR AS flag, 'as cited' AS rationale, 'unchecked' AS support FROM p, n
UNION ALL SELECT goal, 1, 2, 'price', p[1], '', 'not_actionable', 'as cited [FLAGGED: not_actionable]', 'unsupported' FROM p UNION ALL SELECT goal, 1, 3, n[2], '', 'none', 'uncited', 'as cited [FLAGGED: uncited]', 'unsupported' FROM p, n
UNION ALL SELECT goal, 1, 4, n[3], p[1], '', 'too_many', 'as cited [FLAGGED: too_many]', 'unsupported' FROM p, n UNION ALL SELECT goal, 2, 1, n[4], p[-1], '', NULL, 'as cited', 'unchecked' FROM p, n
UNION ALL SELECT goal, 3, 1, n[1], p[1], '', 'too_many', 'as cited [FLAGGED: too_many]', 'unsupported' FROM p, n""")
def l07_recommendations(spark, sf_dir):
    pack, variables = packs(spark, sf_dir)
    goals = pack.select("goal").distinct().withColumn("objective", F.concat(F.lit("growth in "), "goal"))
    answers = model_calls.call(R.prompts(goals, pack, variables, n_candidates=N_CANDIDATES), lambda: model_calls.MockClient(reply))
    out = R.changes(answers, pack, variables, n_candidates=N_CANDIDATES, most_changes=MOST)
    return out.select("goal", F.col("candidate").cast("long").alias("candidate"), F.col("change").cast("long").alias("change"), "variable", F.array_join("citations", ",").alias("citations"), F.array_join("unresolved", ",").alias("unresolved"), "flag", "rationale", "support")


@query("l16_moved_blocks", r"""WITH l AS (SELECT doc_id AS r, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), o AS (SELECT r, n, n // 8 AS page, n % 8 AS block, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM l WHERE regexp_matches(t, '\S')),
c AS (SELECT r, CASE WHEN (n + r) % 7 = 2 THEN page + 1 ELSE page END AS page, CASE WHEN (n + r) % 7 = 2 THEN block + 100 ELSE block END AS block, CASE WHEN (n + r) % 7 = 1 THEN regexp_replace(t, '\S+$', 'altered') ELSE t END AS t FROM o WHERE (n + r) % 7 <> 0),
u AS (SELECT o.r, o.n FROM o JOIN c USING (r, page, block) WHERE o.t = c.t), rest AS (SELECT * FROM o WHERE (r, n) NOT IN (SELECT r, n FROM u)),
hit AS (SELECT rest.r, rest.n, c.page, c.block, (abs(c.page - rest.page), abs(c.block - rest.block)) AS far FROM rest JOIN c ON c.r = rest.r AND c.t = rest.t), near AS (SELECT *, min(far) OVER (PARTITION BY r, n) AS least FROM hit),
mv AS (SELECT r, n, count(*) AS k, any_value(page) AS page, any_value(block) AS block FROM near WHERE far = least GROUP BY 1, 2),
lost AS (SELECT * FROM rest WHERE (r, n) NOT IN (SELECT r, n FROM mv)), nx AS (SELECT *, lead(t) OVER (PARTITION BY r, page ORDER BY block) AS nt FROM c), w AS (SELECT r, page, block, 1 AS span, t FROM c UNION ALL SELECT r, page, block, 2, t || ' ' || nt FROM nx WHERE nt IS NOT NULL),
sa AS (SELECT r, n, page, list_distinct([array_to_string(string_split(t, ' ')[i:i + 2], ' ') FOR i IN range(1, greatest(2, len(string_split(t, ' ')) - 1))]) AS g FROM lost), sb AS (SELECT r, page, block, span, list_distinct([array_to_string(string_split(t, ' ')[i:i + 2], ' ') FOR i IN range(1, greatest(2, len(string_split(t, ' ')) - 1))]) AS g FROM w),
sim AS (SELECT sa.r, sa.n, sb.page, sb.block, sb.span, 2.0 * len(list_intersect(sa.g, sb.g)) / (len(sa.g) + len(sb.g)) AS score FROM sa JOIN (SELECT *, unnest(range(page - 2, page + 3)) AS near FROM sb) sb ON sa.r = sb.r AND sa.page = sb.near),
b AS (SELECT * FROM sim WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY r, n ORDER BY score DESC, span, page, block) = 1), sec AS (SELECT sim.r, sim.n, max(sim.score) AS second FROM sim JOIN b USING (r, n) WHERE sim.page <> b.page OR sim.block + sim.span <= b.block OR b.block + b.span <= sim.block GROUP BY 1, 2),
j AS (SELECT r, n, page, block, span, score - coalesce(second, 0) >= 0.1 - 1e-9 AS clear FROM b LEFT JOIN sec USING (r, n) WHERE score >= 0.5 - 1e-9)
SELECT r AS record_id, n, 'unmoved' AS status, n // 8 AS page, n % 8 AS block, 1::INTEGER AS span FROM u UNION ALL SELECT r, n, CASE WHEN k > 1 THEN 'ambiguous' ELSE 'moved' END, CASE WHEN k = 1 THEN page END, CASE WHEN k = 1 THEN block END, CASE WHEN k = 1 THEN 1 END FROM mv
UNION ALL SELECT r, n, CASE WHEN clear THEN 'edited' ELSE 'ambiguous' END, CASE WHEN clear THEN page END, CASE WHEN clear THEN block END, CASE WHEN clear THEN span END FROM j UNION ALL SELECT r, n, 'deleted', NULL, NULL, NULL FROM lost WHERE (r, n) NOT IN (SELECT r, n FROM j)""")
def l16(spark, sf_dir):
    """Every line with a word is a block, eight to a page; in the newer version some lines are gone, some have another last word, some stand a page further."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.posexplode(F.split("text", "\n")).alias("n", "text")).where(r"text rlike '\\S'").withColumn("n", F.col("n").cast("long"))
    old = lines.select(F.struct("record_id", "n").alias("anchor_id"), "record_id", F.floor(F.col("n") / 8).alias("page"), (F.col("n") % 8).alias("block"), "text")
    kind = (F.col("anchor_id.n") + F.col("record_id")) % 7
    new = old.where(kind != 0).select("record_id", F.when(kind == 2, F.col("page") + 1).otherwise(F.col("page")).alias("page"), F.when(kind == 2, F.col("block") + 100).otherwise(F.col("block")).alias("block"), F.when(kind == 1, F.regexp_replace(A.plain(F.col("text")), r"\S+$", "altered")).otherwise(F.col("text")).alias("text"))
    out = A.resolve(old, new)
    return out.select("anchor_id.record_id", "anchor_id.n", "status", "page", "block", "span")
