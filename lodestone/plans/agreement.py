"""Agreement queries: labels against rules over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import agreement as A
from lodestone.operators import gates
from lodestone.plans.registry import query, r6, s6, table


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


_RULES = "SELECT doc_id, lang, quality, (n_chars >= 1000)::INT AS long_, (NOT regexp_matches(text, '[#$%&*]{3}'))::INT AS clean FROM documents JOIN labels USING (doc_id)"


def _kappa_sql(source: str, by: str = "", undefined: str = "NULL") -> str:
    k = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""WITH x AS ({source}), t AS (SELECT {k}count(*) AS n, avg((a = b)::INT) AS po FROM x GROUP BY ALL), m AS (SELECT {k}v, sum(x) AS x, sum(y) AS y FROM (SELECT {k}a AS v, 1 AS x, 0 AS y FROM x UNION ALL SELECT {k}b, 0, 1 FROM x) GROUP BY ALL),
c AS (SELECT {k}sum(x::DOUBLE * y) AS xy FROM m GROUP BY ALL) SELECT {k}n, {s6('po')} AS exact, {s6(f'CASE WHEN abs(1 - xy / (n::DOUBLE * n)) < 1e-12 THEN {undefined} ELSE (po - xy / (n::DOUBLE * n)) / (1 - xy / (n::DOUBLE * n)) END')} AS kappa FROM t JOIN c {on}"""


@query("a07_prf_rollup", f"""WITH x AS (SELECT lang AS field, (pred AND gold)::INT AS tp, (pred AND NOT gold)::INT AS fp, (gold AND NOT pred)::INT AS fn FROM (SELECT lang, long_ = 1 AS pred, quality = 1 AS gold FROM ({_RULES}))),
s AS (SELECT coalesce(field, 'OVERALL') AS field, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x WHERE tp + fp + fn > 0 GROUP BY ROLLUP(field)), q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM s)
SELECT field, tp, fp, fn, {s6('p')} AS precision, {s6('r')} AS recall, {s6('coalesce(2 * p * r / nullif(p + r, 0), 0)')} AS f1 FROM q""")
def a07(spark, sf_dir):
    one = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    own = labelled(spark, sf_dir).select(F.col("lang").alias("field"), one(F.col("n_chars") >= 1000).alias("pred"), one(F.col("quality") == 1).alias("gold"))
    out = A.set_scores(own, "field", "pred", "gold")
    return out.select("field", "tp", "fp", "fn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("a10_kappa", _kappa_sql("SELECT quality AS a, toxic AS b FROM labels"))
def a10(spark, sf_dir):
    return A.kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", r6(F.col("exact")).alias("exact"), r6(F.col("kappa")).alias("kappa"))


@query("a11_kappa_by_language", _kappa_sql(f"SELECT lang, quality AS a, clean AS b FROM ({_RULES})", "lang", "1.0"))
def a11(spark, sf_dir):
    own = labelled(spark, sf_dir).select("lang", "quality", (~F.col("text").rlike(r"[#$%&*]{3}")).cast("int").alias("clean"))
    return A.kappa(own, "quality", "clean", ["lang"], undefined=1.0).select("lang", "n", r6(F.col("exact")).alias("exact"), r6(F.col("kappa")).alias("kappa"))


@query("a12_pairwise_agreement", _kappa_sql(f"SELECT r1, r2, a, b FROM (SELECT 'clean' AS r1, 'gold' AS r2, clean AS a, quality AS b FROM ({_RULES}) UNION ALL SELECT 'clean', 'long', clean, long_ FROM ({_RULES}) UNION ALL SELECT 'gold', 'long', quality, long_ FROM ({_RULES}))", "r1, r2", "1.0"))
def a12(spark, sf_dir):
    own = labelled(spark, sf_dir).select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("rater"), c.cast("int").alias("label")) for n, c in (("gold", F.col("quality")), ("long", F.col("n_chars") >= 1000), ("clean", ~F.col("text").rlike(r"[#$%&*]{3}")))])))
    return A.pairwise(own, "doc_id", "rater", "label").select("r1", "r2", "n", r6(F.col("exact")).alias("exact"), r6(F.col("kappa")).alias("kappa"))


@query("a17_repeat_consistency", "WITH r AS (SELECT doc_id, r, (n_chars + r * 100) % 1000 < 800 AS s FROM documents, (VALUES (0), (1), (2)) v(r)), i AS (SELECT doc_id, count(DISTINCT s) = 1 AS same, bool_and(s) AS al, bool_or(s) AS ev FROM r GROUP BY 1) SELECT " + s6("avg(same::INT)") + " AS consistency, count(*) FILTER (al) AS always, count(*) FILTER (ev) AS ever FROM i")
def a17(spark, sf_dir):
    return A.consistency(runs(spark, sf_dir), "doc_id", "r", "s").withColumn("consistency", r6(F.col("consistency")))


def runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("r")).select("doc_id", "r", ((F.col("n_chars") + F.col("r") * 100) % 1000 < 800).alias("s"))


@query("a18_run_stability", "WITH r AS (SELECT doc_id, r FROM documents, (VALUES (0), (1), (2)) v(r) WHERE (n_chars + r * 100) % 1000 < 800), n AS (SELECT r, count(*) AS n FROM r GROUP BY 1), p AS (SELECT a.r AS r1, b.r AS r2, count(*) AS shared FROM r a JOIN r b USING (doc_id) WHERE a.r < b.r GROUP BY ALL) SELECT r1, r2, " + s6("shared / (x.n + y.n - shared)") + " AS jaccard FROM p JOIN n x ON x.r = r1 JOIN n y ON y.r = r2")
def a18(spark, sf_dir):
    return A.run_stability(runs(spark, sf_dir), "doc_id", "r", "s").withColumn("jaccard", r6(F.col("jaccard")))


@query("a09_coverage_gate", "WITH x AS (SELECT source AS concept, quality, lang = 'es' AS proxy FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT concept, count(quality) AS n, avg(quality) AS share, bool_or(proxy) AS proxy FROM x GROUP BY 1) SELECT concept, n, " + s6("share") + " AS share, CASE WHEN n = 0 THEN 'NOT_EVALUABLE' WHEN share < 0.75 THEN 'FAIL' WHEN proxy THEN 'PROVISIONAL_ONLY' ELSE 'PASS' END AS status FROM g")
def a09(spark, sf_dir):
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("source").alias("concept"), "quality", (F.col("lang") == "es").alias("proxy"))
    return A.coverage_gate(own, "concept", "quality", "proxy").withColumn("share", r6(F.col("share")))


@query("a23_coverage_ratios", "SELECT lang, " + s6("count(quality)::DOUBLE / count(*)") + " AS coverage, " + s6("coalesce(count(*) FILTER (quality = 1)::DOUBLE / nullif(count(quality), 0), 0)") + " AS grounding FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a23(spark, sf_dir):
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("lang")
    return own.agg(r6(F.count("quality") / F.count("*")).alias("coverage"), r6(F.coalesce(F.try_divide(F.count_if(F.col("quality") == 1), F.count("quality")), F.lit(0.0))).alias("grounding"))


@query("a25_selection_shares", "SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS selected, " + s6("1 - sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END)::DOUBLE / sum(n_chars)") + " AS reduction FROM documents GROUP BY 1")
def a25(spark, sf_dir):
    """A25, A26."""
    own = F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(0)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("selected"), r6(1 - F.sum(own) / F.sum("n_chars")).alias("reduction"))


@query("g10_probe_gate", "SELECT lang, avg(quality) >= 0.95 AND count(quality) / count(*) >= 0.95 AND avg(toxic) >= 0.75 AND count(*) / 1000 <= 0.60 AS passed FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def g10(spark, sf_dir):
    g = labelled(spark, sf_dir).groupBy("lang").agg(F.avg("quality").alias("r"), (F.count("quality") / F.count("*")).alias("c"), F.avg("toxic").alias("p"), (F.count("*") / 1000).alias("s"))
    return g.select("lang", gates.probe_gate(F.col("r"), F.col("c"), F.col("p"), F.col("s")).alias("passed"))
