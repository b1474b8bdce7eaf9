"""Evidence synthesis over the order lines: a study is a supplier, a component a part brand, an outcome a return flag.

Treatment and control are the two line states; each study's quantities give group means, spreads and counts, whose
log ratio of means is the study's effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import gates, meta
from lodestone.plans.registry import query, r6, s6, table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each brand, flag and supplier with both groups."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    own = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    of = lambda f, state: f(F.when(F.col("l_linestatus") == state, F.col("l_quantity").cast("double")))
    wide = own.groupBy(F.col("p_brand").alias("component"), F.col("l_returnflag").alias("outcome"), F.col("l_suppkey").cast("string").alias("paper_id")).agg(
        of(F.avg, "F").alias("mt"), of(F.stddev, "F").alias("sdt"), of(F.count, "F").cast("double").alias("nt"), of(F.avg, "O").alias("mc"), of(F.stddev, "O").alias("sdc"), of(F.count, "O").cast("double").alias("nc")
    )
    e = meta.ratio_of_means(*[F.col(c) for c in ("mt", "sdt", "nt", "mc", "sdc", "nc")])
    return wide.withColumn("e", e).where("e is not null").select("component", "outcome", "paper_id", F.col("e.effect").alias("effect"), F.col("e.variance").alias("variance"), F.signum("e.effect").cast("int").alias("direction"))


ITEMS = """
WITH wide AS (
  SELECT p_brand AS component, l_returnflag AS outcome, l_suppkey::VARCHAR AS paper_id,
    avg(l_quantity) FILTER (l_linestatus = 'F') AS mt, stddev_samp(l_quantity) FILTER (l_linestatus = 'F') AS sdt, count(*) FILTER (l_linestatus = 'F') AS nt,
    avg(l_quantity) FILTER (l_linestatus = 'O') AS mc, stddev_samp(l_quantity) FILTER (l_linestatus = 'O') AS sdc, count(*) FILTER (l_linestatus = 'O') AS nc
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
items AS (
  SELECT component, outcome, paper_id, ln(mt / mc) AS effect, sdt * sdt / (nt * mt * mt) + sdc * sdc / (nc * mc * mc) AS variance
  FROM wide WHERE mt > 0 AND mc > 0 AND sdt > 0 AND sdc > 0 AND nt > 1 AND nc > 1)"""
CDF = "0.5 * (1 + CASE WHEN {z} < 0 THEN -1 ELSE 1 END * (1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z} / sqrt(2)) * ({z} / sqrt(2)))))"
_Z = "(m / sqrt(greatest(v, 1e-12)))"
_P = CDF.format(z=_Z, t=f"(1 / (1 + 0.3275911 * abs({_Z} / sqrt(2))))")
SUMMARIES = f"""{ITEMS},
g AS (SELECT component, outcome, count(DISTINCT paper_id) AS k, count(*) AS n, sum(1 / greatest(variance, 1e-9)) AS sw, sum(effect / greatest(variance, 1e-9)) AS swy,
  sum(1 / (greatest(variance, 1e-9) ** 2)) AS sw2, count(*) FILTER (effect > 0) AS h, count(*) FILTER (effect < 0) AS u FROM items GROUP BY ALL),
q AS (SELECT i.component, i.outcome, sum((effect - swy / sw) ** 2 / greatest(variance, 1e-9)) AS q FROM items i JOIN g USING (component, outcome) GROUP BY ALL),
t AS (SELECT *, CASE WHEN n > 1 AND sw - sw2 / sw > 0 THEN greatest(0, (q - n + 1) / (sw - sw2 / sw)) ELSE 0 END AS tau,
  CASE WHEN n > 1 AND q > 0 THEN greatest(0, (q - n + 1) / q) ELSE 0 END AS i2 FROM g JOIN q USING (component, outcome)),
p AS (SELECT i.component, i.outcome, sum(effect / (greatest(variance, 1e-9) + tau)) / sum(1 / (greatest(variance, 1e-9) + tau)) AS m, 1 / sum(1 / (greatest(variance, 1e-9) + tau)) AS v
  FROM items i JOIN t USING (component, outcome) GROUP BY ALL),
summaries AS (SELECT component, outcome, k, CASE WHEN n >= 2 THEN 'dersimonian_laird' ELSE 'single_study' END AS method, {_P} AS p, m, v, sqrt(greatest(v, 1e-12)) AS se,
  CASE WHEN n >= 2 THEN i2 ELSE 0 END AS i2, CASE WHEN n >= 2 THEN tau ELSE 0 END AS tau,
  n >= 2 AND (i2 >= 0.5 OR (h + u >= 3 AND least(h, u) / (h + u) >= 0.3)) AS dependent, n AS n_continuous, h + u AS n_direction
  FROM t JOIN p USING (component, outcome))"""


@query("e07_ratio_of_means", f"{ITEMS} SELECT component, outcome, paper_id, {s6('effect')} AS effect, {s6('variance')} AS variance FROM items")
def e07(spark, sf_dir):
    return items(spark, sf_dir).select("component", "outcome", "paper_id", r6(F.col("effect")).alias("effect"), r6(F.col("variance")).alias("variance"))


@query("m04_evidence_synthesis", f"{SUMMARIES} SELECT component, outcome, k, method, {s6('p')} AS p_beneficial, {s6('m')} AS pooled_effect, {s6('m - 1.96 * se')} AS ci_low, {s6('m + 1.96 * se')} AS ci_high, {s6('i2')} AS i_squared, {s6('tau')} AS tau_squared, dependent AS context_dependent, n_continuous, n_direction FROM summaries")
def m04(spark, sf_dir):
    out = meta.ranked(meta.synthesize(items(spark, sf_dir)))
    return out.select("component", "outcome", "k", "method", *[r6(F.col(c)).alias(c) for c in ("p_beneficial", "pooled_effect", "ci_low", "ci_high", "i_squared", "tau_squared")], "context_dependent", "n_continuous", "n_direction")


@query("w05_best_belief", f"""{SUMMARIES}, b AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY k DESC, abs(p - 0.5) DESC, outcome DESC) AS r FROM summaries)
SELECT component, outcome, k, {s6('2 * abs(p - 0.5)')} AS strength, CASE WHEN dependent THEN 0 ELSE sign(p - 0.5)::INTEGER END AS direction, dependent AS context_dependent FROM b WHERE r = 1 AND (2 * abs(p - 0.5) >= 0.1 OR dependent)""")
def w05(spark, sf_dir):
    out = meta.best_belief(meta.synthesize(items(spark, sf_dir)))
    return out.withColumn("strength", r6(F.col("strength")))


@query("m02_direction_votes", """WITH v AS (SELECT event_type AS component, user_id, CASE WHEN avg(value) > 50 THEN 1 WHEN avg(value) < 50 THEN -1 ELSE 0 END AS s FROM events GROUP BY ALL),
c AS (SELECT component, count(*) FILTER (s > 0) AS h, count(*) FILTER (s < 0) AS u, count(DISTINCT user_id) AS k FROM v GROUP BY ALL)
SELECT component, k, h AS helps, u AS hurts, """ + s6("(1.0 + h) / (2.0 + h + u)") + """ AS p_beneficial, h + u >= 3 AND least(h, u)::DOUBLE / (h + u) >= 0.3 AS conflict FROM c""")
def m02(spark, sf_dir):
    """Direction votes of users on event types."""
    over = F.col("value").try_cast("decimal(38,18)") - F.lit(50)  # a sum of doubles depends on the order of the rows, which decides where the mean is 50
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("component"), "user_id").agg(F.avg("value").alias("m"), F.try_sum(over.cast("decimal(38,18)")).alias("over"))
    m = F.when(F.abs(F.col("m") - 50) < 1e-6, F.coalesce(50 + F.signum("over"), "m")).otherwise(F.col("m"))
    own = e.select("component", F.col("user_id").cast("string").alias("paper_id"), F.when(m > 50, 1).when(m < 50, -1).otherwise(0).alias("s"))
    c = own.groupBy("component").agg(F.countDistinct("paper_id").alias("k"), F.count_if(F.col("s") > 0).alias("helps"), F.count_if(F.col("s") < 0).alias("hurts"))
    h, u = F.col("helps"), F.col("hurts")
    return c.select("component", "k", "helps", "hurts", r6((1.0 + h) / (2.0 + h + u)).alias("p_beneficial"), ((h + u >= 3) & (F.least(h, u) / (h + u) >= 0.3)).alias("conflict"))


@query("a05_component_audit", """WITH i AS (SELECT source AS component, lang, doc_id, text LIKE '%the%' AS target, NOT regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(scaffold|bioreactor|token)(?:[^A-Za-z0-9_]|$)') AS actionable, regexp_matches(text, '\\d') AS dose, length(text) >= 200 AS quoted FROM documents)
SELECT component, count(*) AS items, count(*) FILTER (target) AS n_target, count(*) FILTER (actionable) AS n_actionable, count(*) FILTER (dose) AS n_dose, count(*) FILTER (quoted) AS n_quote,
 count(*) FILTER (target AND actionable AND dose AND quoted) AS n_ready, count(DISTINCT lang) AS n_contexts, count(*) FILTER (target AND actionable AND dose AND quoted) > 0 AND bool_and(quoted) AS candidate,
 string_agg(DISTINCT lang, ';' ORDER BY lang) AS contexts FROM i GROUP BY ALL""")
def a05(spark, sf_dir):
    return gates.component_audit(gates.document_items(table(spark, sf_dir, "documents")))


@query("g06_go_no_go", """WITH i AS (SELECT source AS component, text LIKE '%the%' AND NOT regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])(scaffold|bioreactor|token)(?:[^A-Za-z0-9_]|$)') AND regexp_matches(text, '\\d') AND length(text) >= 200 AS ready, length(text) >= 200 AS quoted FROM documents),
a AS (SELECT component, count(*) FILTER (ready) > 0 AND bool_and(quoted) AS candidate FROM i GROUP BY ALL),
n AS (SELECT count(*) FILTER (candidate) AS c, count(*) AS components FROM a)
SELECT components, c AS candidates, CASE WHEN c < 3 THEN 'NO_GO' ELSE 'GO' END AS decision, CASE WHEN c < 3 THEN 'too_few_candidates' ELSE '' END AS blockers FROM n""")
def g06(spark, sf_dir):
    return gates.go_no_go(gates.component_audit(gates.document_items(table(spark, sf_dir, "documents"))), least=3)
