"""Design queries: skylines, hypervolume, encodings and acquisition over parts and suppliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import design as D
from lodestone.plans.registry import query, r6, s6, table

_FRONT = "f AS (SELECT p_partkey, p_retailprice AS x, -p_size AS y FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size)))"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"), (-F.col("p_size")).cast("double").alias("y"))


@query("o01_pareto_front", f"WITH {_FRONT} SELECT p_partkey, x, y::DOUBLE AS y FROM f")
def o01(spark, sf_dir):
    return D.pareto_2d(parts(spark, sf_dir), "x", "y")


@query("o01_pareto_front_3d", "SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal <= a.s_acctbal AND b.s_nationkey <= a.s_nationkey AND b.s_suppkey % 7 <= a.s_suppkey % 7 AND (b.s_acctbal < a.s_acctbal OR b.s_nationkey < a.s_nationkey OR b.s_suppkey % 7 < a.s_suppkey % 7))")
def o01_3d(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"), (F.col("s_suppkey") % 7).cast("double").alias("c"))
    return D.pareto(s, ["a", "b", "c"]).select("s_suppkey")


@query("o02_hypervolume", f"WITH {_FRONT}, i AS (SELECT x, min(y)::DOUBLE AS y FROM f WHERE x < 2500 AND y < 0 GROUP BY 1) SELECT {s6('sum(a)')} AS hypervolume FROM (SELECT (coalesce(lead(x) OVER (ORDER BY x), 2500) - x) * (0 - y) AS a FROM i)")
def o02(spark, sf_dir):
    return D.hypervolume_2d(D.pareto_2d(parts(spark, sf_dir), "x", "y"), "x", "y", (2500.0, 0.0)).select(r6(F.col("hypervolume")).alias("hypervolume"))


def _recurrence(n: int, lows: list[str], ref: list[float]) -> tuple[str, str]:
    """DuckDB: the sample points within the box from the lows to the reference point."""
    cols = [f"(({a!r} + i * {b!r}) % 1.0) * ({r!r} - {low}) + {low} AS s{k}" for k, ((a, b), low, r) in enumerate(zip(D.sample_steps(len(ref), 0), lows, ref, strict=True))]
    return f"(SELECT i::DOUBLE AS i FROM range(1, {n} + 1) t(i)) n, (SELECT min(a) AS la, min(b) AS lb, min(c) AS lc FROM y) l", ", ".join(cols)


_REF = [10000.0, 25.0, 7.0]
_POINTS, _COLS = _recurrence(2 * D.SAMPLES_PER_ROW, ["la", "lb", "lc"], _REF)


@query("o02_hypervolume_3d", f"""WITH y AS (SELECT DISTINCT s_acctbal::DOUBLE AS a, s_nationkey::DOUBLE AS b, (s_suppkey % 7)::DOUBLE AS c FROM supplier WHERE s_acctbal < 10000 AND s_nationkey < 25), p AS (SELECT {_COLS} FROM {_POINTS}),
h AS (SELECT count(*) AS n FROM p WHERE EXISTS (SELECT 1 FROM y WHERE a <= s0 AND b <= s1 AND c <= s2)) SELECT {s6(f"n / {2 * D.SAMPLES_PER_ROW} * (10000 - la) * (25 - lb) * (7 - lc)")} AS hypervolume FROM h, (SELECT min(a) AS la, min(b) AS lb, min(c) AS lc FROM y) l""")
def o02_3d(spark, sf_dir):
    """The oracle takes the same sample points over all rows; the estimate's error is held against an exact volume in tests."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"), (F.col("s_suppkey") % 7).cast("double").alias("c"))
    return D.hypervolume(D.pareto(s, ["a", "b", "c"]), ["a", "b", "c"], _REF, samples=2 * D.SAMPLES_PER_ROW).select(r6(F.col("hypervolume")).alias("hypervolume"))


@query("o03_reference_point", "SELECT " + s6("max(p_retailprice) + 0.1 * (max(p_retailprice) - min(p_retailprice))") + " AS x, " + s6("max(-p_size) + 0.1 * (max(-p_size) - min(-p_size))") + " AS y FROM part")
def o03(spark, sf_dir):
    return D.reference_point(parts(spark, sf_dir), ["x", "y"]).select(r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("o04_encode", "SELECT p_partkey, " + s6("least(1, greatest(0, (p_size - 5) / 40))") + " AS size, (p_retailprice > 1000)::INT::DOUBLE AS dear, CASE WHEN p_type = 'ECONOMY' THEN 0.0 WHEN p_type = 'PROMO' THEN 0.0 ELSE 1.0 END::DOUBLE AS other, (p_type = 'ECONOMY')::INT::DOUBLE AS economy FROM part")
def o04(spark, sf_dir):
    known = [{"name": "size", "kind": "continuous", "low": 5.0, "high": 45.0}, {"name": "dear", "kind": "binary"}, {"name": "type", "kind": "categorical", "choices": ["STANDARD", "ECONOMY", "PROMO"]}]
    cols = {"size": F.col("p_size"), "dear": F.col("p_retailprice") > 1000, "type": F.col("p_type")}
    v = table(spark, sf_dir, "part").select("p_partkey", D.encode(known, cols.__getitem__).alias("v"))
    return v.select("p_partkey", r6(F.col("v")[0]).alias("size"), F.col("v")[1].alias("dear"), F.col("v")[2].alias("other"), F.col("v")[3].alias("economy"))


@query("o08_expected_improvement", "WITH z AS (SELECT p_partkey, 1500 - p_retailprice - 0.01 AS g, greatest(p_size::DOUBLE, 1e-9) AS s FROM part), t AS (SELECT *, g / s AS z, 1 / (1 + 0.3275911 * abs(g / s / sqrt(2))) AS t FROM z) SELECT p_partkey, " + s6("greatest(0, g * 0.5 * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-(z / sqrt(2)) * (z / sqrt(2))))) + s * exp(-0.5 * z * z) / sqrt(2 * pi()))") + " AS ei FROM t")
def o08(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(D.expected_improvement(F.col("p_retailprice"), F.col("p_size").cast("double"), 1500.0)).alias("ei"))


@query("o08_chebyshev", "SELECT p_partkey, " + s6("greatest(0.3 * p_size / 50, 0.7 * p_retailprice / 2500) + 0.05 * (0.3 * p_size / 50 + 0.7 * p_retailprice / 2500)") + " AS c FROM part")
def o08c(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(D.chebyshev([F.col("p_size") / 50, F.col("p_retailprice") / 2500], [0.3, 0.7])).alias("c"))


@query("o11_log_prior", "WITH x AS (SELECT p_partkey, least(1, p_size / 50) AS a, 1 - least(1, p_retailprice / 2500) AS b FROM part) SELECT p_partkey, " + s6("0.8 * (2 * a / (a + 0.15) - 1) + 0.5 * (2 * b / (b + 0.15) - 1)") + " AS lp FROM x")
def o11(spark, sf_dir):
    cols = {"size": F.col("p_size") / 50, "price": F.col("p_retailprice") / 2500}
    return table(spark, sf_dir, "part").select("p_partkey", r6(D.log_prior([("size", 0.8, 1), ("price", 0.5, -1)], cols.__getitem__)).alias("lp"))


@query("o13_synthetic_objectives", "SELECT p_partkey, " + s6("(p_size / (p_size + 20.0) + 0.6 * p_retailprice / (p_retailprice + 1500)) / 1.6") + " AS growth, " + s6("0.05 * p_size + 0.001 * p_retailprice + 1") + " AS cost FROM part")
def o13(spark, sf_dir):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", r6((D.saturating(size, 20.0) + 0.6 * D.saturating(price, 1500.0)) / 1.6).alias("growth"), r6(0.05 * size + 0.001 * price + 1).alias("cost"))


@query("o09_propose_batch")
def o09(spark, sf_dir):
    """A fitted surrogate scores all parts; rows only, as linear algebra differs in the last digits."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_size") / 50).cast("double"), F.col("p_retailprice") / 2500).alias("v"))
    seen = np.array([[0.1, 0.4], [0.5, 0.6], [0.9, 0.8], [0.3, 0.9]])
    chosen = D.propose((seen, np.stack([1 - seen[:, 0], seen[:, 1]], axis=1)), p, "v", "p_partkey", 3)
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(chosen)], "slot int, p_partkey long")
