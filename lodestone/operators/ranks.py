"""Ranks over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sampled rows for each range; they set the ranges' bounds and nothing else.
SAMPLED = 20


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the rank (from 0) by a total order of columns: ranges are sorted apart, and each begins after those before it.

    The bounds between ranges come from a small sample and are literals of the plan from then on, so a range has the
    same rows wherever it is counted, even if rows come in another order after a retry. Ranges of repeated keys may be
    large: rows of one key have one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order)
    n = keys.count()
    rows = keys.sample(min(1.0, SAMPLED * parts / n), seed=1).limit(4 * SAMPLED * parts).collect() if n else []
    found = sorted(set(rows), key=lambda r: tuple((x is not None, x) for x in r))
    bounds = found[:: max(1, len(found) // parts)][:parts]
    kinds = [f.dataType for f in keys.schema.fields]
    literal = [F.struct(*[F.lit(x).cast(t).alias(c) for x, t, c in zip(b, kinds, order, strict=True)]) for b in bounds]
    own = F.struct(*[F.col(c) for c in order])
    part = F.size(F.filter(F.array(*literal), lambda b: b <= own)) if bounds else F.lit(0)
    dealt = df.withColumn("_p", part)
    before = dealt.groupBy("_p").count().select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn("_k", place).join(before, "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")
