"""Random-effects evidence synthesis from native aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import norm_cdf


def ratio_of_means(mt: Column, sdt: Column, nt: Column, mc: Column, sdc: Column, nc: Column) -> Column:
    """Log ratio of means and its variance; null unless means and spreads are positive and counts above one."""
    ok = (mt > 0) & (mc > 0) & (sdt > 0) & (sdc > 0) & (nt > 1) & (nc > 1)
    effect, variance = F.ln(mt / mc), sdt * sdt / (nt * mt * mt) + sdc * sdc / (nc * mc * mc)
    return F.when(ok, F.struct(effect.alias("effect"), variance.alias("variance")))


def sd_from_sem(x: Column, n: Column, kind: Column) -> Column:
    """A standard error becomes a standard deviation."""
    return F.when(kind == "sem", x * F.sqrt(n)).otherwise(x)


def tier(effect: Column, variance: Column) -> Column:
    """1 effect with variance, 2 effect, 3 direction alone."""
    return F.when(effect.isNotNull() & variance.isNotNull(), 1).when(effect.isNotNull(), 2).otherwise(3)


def sign(direction: Column, effect: Column) -> Column:
    """The direction, else the effect's sign, else 0."""
    return F.coalesce(F.signum(direction.cast("double")), F.signum(effect), F.lit(0.0)).cast("int")


def synthesize(items: DataFrame, *, by_context: bool = False, high_i2: float = 0.5) -> DataFrame:
    """One summary for each component and outcome (and context).

    items: component, outcome, paper_id, effect, variance, direction (and context_key). Two or more items with effect
    and variance are pooled by DerSimonian-Laird, about the group's mean in a second pass, so that equal effects give
    exactly no heterogeneity; a single one stands alone; else directions vote with a beta prior. All aggregates combine
    before they are shuffled, and the second pass meets the first in a join that Spark can split.
    """
    keys = ["component", "outcome", *(["context_key"] if by_context else [])]
    own = items.select(*keys, "paper_id", "effect", "variance", tier(F.col("effect"), F.col("variance")).alias("tier"), sign(F.col("direction"), F.col("effect")).alias("sign"))
    one = F.col("tier") == 1
    v = F.greatest(F.col("variance"), F.lit(1e-9))
    own = own.withColumn("w", F.when(one, 1 / v)).withColumn("y", F.when(one, F.col("effect")))
    first = own.groupBy(*keys).agg(
        F.countDistinct("paper_id").alias("k"),
        F.count("w").alias("n_continuous"),
        F.count_if(F.col("sign") > 0).alias("helps"),
        F.count_if(F.col("sign") < 0).alias("hurts"),
        F.sum("w").alias("sw"),
        F.sum(F.col("w") * F.col("w")).alias("sw2"),
        F.sum(F.col("w") * F.col("y")).alias("swy"),
    )
    held = own.where(one).select(*keys, "w", "y").join(first.select(*keys, (F.col("swy") / F.col("sw")).alias("mean"), "sw", "sw2", "n_continuous"), keys)
    q = held.groupBy(*keys).agg(
        F.sum(F.col("w") * (F.col("y") - F.col("mean")) * (F.col("y") - F.col("mean"))).alias("q"),
        F.first("sw").alias("sw"),
        F.first("sw2").alias("sw2"),
        F.first("n_continuous").alias("n"),
    )
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    over = F.col("q") - F.col("n") + 1
    tau = F.when((F.col("n") > 1) & (c > 0), F.greatest(F.lit(0.0), over / c)).otherwise(0.0)
    i2 = F.when((F.col("n") > 1) & (F.col("q") > 0), F.greatest(F.lit(0.0), over / F.col("q"))).otherwise(0.0)
    q = q.select(*keys, tau.alias("tau_squared"), i2.alias("i_squared"))
    again = own.where(one).select(*keys, "w", "y").join(q, keys)
    ws = 1 / (1 / F.col("w") + F.col("tau_squared"))
    pooled = again.groupBy(*keys).agg(F.sum(ws).alias("sws"), F.sum(ws * F.col("y")).alias("swsy"), F.first("tau_squared").alias("tau_squared"), F.first("i_squared").alias("i_squared"))
    df = first.join(pooled, keys, "left")
    n, helps, hurts = F.col("n_continuous"), F.col("helps"), F.col("hurts")
    signed = helps + hurts
    conflict = (signed >= 3) & (F.least(helps, hurts) / F.greatest(signed, F.lit(1)) >= 0.3)
    method = F.when(n >= 2, "dersimonian_laird").when(n == 1, "single_study").when(signed > 0, "beta_binomial").otherwise("insufficient")
    effect, variance = F.col("swsy") / F.col("sws"), 1 / F.col("sws")
    se = F.sqrt(F.greatest(variance, F.lit(1e-12)))
    a, b = 1.0 + helps, 1.0 + hurts
    mean, var = a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))
    beta = method == "beta_binomial"
    return df.select(
        *keys,
        "k",
        method.alias("method"),
        F.when(n >= 1, norm_cdf(effect / se)).when(beta, mean).otherwise(0.5).alias("p_beneficial"),
        F.when(n >= 1, effect).alias("pooled_effect"),
        F.when(n >= 1, effect - 1.96 * se).when(beta, F.greatest(F.lit(0.0), mean - 1.96 * F.sqrt(var))).alias("ci_low"),
        F.when(n >= 1, effect + 1.96 * se).when(beta, F.least(F.lit(1.0), mean + 1.96 * F.sqrt(var))).alias("ci_high"),
        F.when(n >= 1, variance).when(beta, var).alias("variance"),
        F.when(n >= 2, F.col("i_squared")).otherwise(0.0).alias("i_squared"),
        F.when(n >= 2, F.col("tau_squared")).otherwise(0.0).alias("tau_squared"),
        F.when(n >= 2, (F.col("i_squared") >= high_i2) | conflict).when(n == 1, False).otherwise(conflict).alias("context_dependent"),
        "n_continuous",
        signed.alias("n_direction"),
    )


def ranked(summaries: DataFrame) -> DataFrame:
    """The most decided first, then the best supported, then by name."""
    return summaries.orderBy(F.desc(F.abs(F.col("p_beneficial") - 0.5)), F.desc("k"), "component", "outcome")


def best_belief(summaries: DataFrame, least: float = 0.1) -> DataFrame:
    """Each component's best-supported summary as a belief: strength, direction (0 when context-dependent)."""
    decided = F.abs(F.col("p_beneficial") - 0.5)
    best = summaries.groupBy("component").agg(F.max_by(F.struct("outcome", "k", "p_beneficial", "context_dependent"), F.struct(F.col("k"), decided, F.col("outcome"))).alias("b")).select("component", "b.*")
    strength = 2 * F.abs(F.col("p_beneficial") - 0.5)
    out = best.select("component", "outcome", "k", strength.alias("strength"), F.when(F.col("context_dependent"), 0).otherwise(F.signum(F.col("p_beneficial") - 0.5).cast("int")).alias("direction"), "context_dependent")
    return out.where((F.col("strength") >= least) | F.col("context_dependent"))
