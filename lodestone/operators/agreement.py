"""Agreement and evaluation: precision and recall, kappas, repeat stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where nothing is there to divide by."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def set_scores(df: DataFrame, field: str, pred: str, gold: str) -> DataFrame:
    """Counts of shared and single elements of two arrays for each field and over all (field null), cells empty on both sides left out."""
    own = df.where((F.size(pred) > 0) | (F.size(gold) > 0))
    counts = own.select(field, F.size(F.array_intersect(pred, gold)).cast("long").alias("tp"), F.size(F.array_except(pred, gold)).cast("long").alias("fp"), F.size(F.array_except(gold, pred)).cast("long").alias("fn"))
    sums = counts.rollup(field).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(F.coalesce(field, F.lit("OVERALL")).alias(field), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None, *, undefined: float | None = None) -> DataFrame:
    """Cohen's kappa from the table of pairs. Where chance agreement is 1 it is null, or `undefined`."""
    by = by or []
    cells = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    margin = cells.select(*by, F.col("a").alias("v"), F.col("c").alias("x"), F.lit(0).cast("long").alias("y")).unionAll(cells.select(*by, "b", F.lit(0).cast("long"), "c")).groupBy(*by, "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    chance = margin.groupBy(*by).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    both = total.join(chance, by) if by else total.withColumn("_k", F.lit(1)).join(chance.withColumn("_k", F.lit(1)), "_k").drop("_k")
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    value = F.when(F.abs(1 - pe) < 1e-12, F.lit(undefined)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return both.select(*by, "n", po.alias("exact"), value.cast("double").alias("kappa"))


def pairwise(df: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """Kappa and exact agreement of every pair of raters (few by nature) over the items that both labelled."""
    a = df.select(item, F.col(rater).alias("r1"), F.col(label).alias("l1"))
    b = df.select(item, F.col(rater).alias("r2"), F.col(label).alias("l2"))
    return kappa(a.join(b, item).where("r1 < r2"), "l1", "l2", ["r1", "r2"], undefined=1.0)


def consistency(df: DataFrame, item: str, run: str, selected: str) -> DataFrame:
    """Over repeated runs, the share of items that are always selected alike, and each extreme."""
    items = df.groupBy(item).agg((F.count_distinct(selected) == 1).alias("same"), F.bool_and(selected).alias("always"), F.bool_or(selected).alias("ever"))
    return items.agg(F.avg(F.col("same").cast("double")).alias("consistency"), F.count_if("always").alias("always"), F.count_if("ever").alias("ever"))


def run_stability(df: DataFrame, item: str, run: str, selected: str) -> DataFrame:
    """Jaccard of the selections of each pair of runs, from one pass that counts items for each pair."""
    own = df.where(selected).select(item, F.col(run).alias("r"))
    sizes = own.groupBy("r").agg(F.count("*").alias("n"))
    pairs = own.select(item, F.col("r").alias("r1")).join(own.select(item, F.col("r").alias("r2")), item).where("r1 < r2").groupBy("r1", "r2").agg(F.count("*").alias("both"))
    out = pairs.join(sizes.select(F.col("r").alias("r1"), F.col("n").alias("n1")), "r1").join(sizes.select(F.col("r").alias("r2"), F.col("n").alias("n2")), "r2")
    return out.select("r1", "r2", (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("jaccard"))


def coverage_gate(df: DataFrame, concept: str, there: str, proxy: str, *, threshold: float = 0.75) -> DataFrame:
    """The share of values that are there for each concept, with PASS, FAIL, NOT_EVALUABLE or PROVISIONAL_ONLY."""
    out = df.groupBy(concept).agg(F.count(there).alias("n"), F.avg(F.col(there).cast("double")).alias("share"), F.bool_or(proxy).alias("proxy"))
    status = F.when(F.col("n") == 0, "NOT_EVALUABLE").when(F.col("share") < threshold, "FAIL").when(F.col("proxy"), "PROVISIONAL_ONLY").otherwise("PASS")
    return out.select(concept, "n", "share", status.alias("status"))
