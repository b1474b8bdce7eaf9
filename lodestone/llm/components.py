"""Connected components by min labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for all ends of the edges (a, b): comp is the smallest id that can be reached.

    A vertex with very many edges is spread: edges meet labels in a join that Spark can split, and minima are combined
    before they are shuffled. Loops and repeated edges do no harm; no edges give no rows.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.select("id", "comp").join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("comp").alias("up"))
        moved = written(step.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("up", "c")).alias("comp")), "labels")
        free(labels)
        labels = moved
        if moved.where("old <> comp").isEmpty():
            free(both)
            return labels.select("id", "comp")
