"""Component names against an ontology: a broadcast lookup with two probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import strip_component
from lodestone.operators.fuzzy import best_surfaces, plain

#: An ontology is curated by hand; beyond this many surfaces the lookup is joined without a broadcast.
BROADCAST_SURFACES = 200_000


def ontology(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(surface, canonical, category, role) of entries in file order: a later canonical name wins, the first alias does; place is where a surface first stands."""
    rows = []
    for k, e in enumerate(entries):
        rows.append((e["canonical"].strip().lower(), e["canonical"], e.get("category"), e.get("typical_role"), 0, -k))
        rows += [(a.strip().lower(), e["canonical"], e.get("category"), e.get("typical_role"), 1, k) for a in e.get("aliases") or []]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "surface string, canonical string, category string, role string, kind int, rank int, place int")
    own = Window.partitionBy("surface")
    df = df.withColumn("r", F.row_number().over(own.orderBy("kind", "rank"))).withColumn("place", F.min("place").over(own))
    return df.where("r = 1").drop("r", "kind", "rank")


def canonicalize(df: DataFrame, name: str, lookup: DataFrame, *, surfaces: int | None = None, fuzzy: float | None = None) -> DataFrame:
    """Add canonical, category, matched_via and score. The raw name is looked up first, then the stripped one; unknown names pass through.

    J02: with `fuzzy` (0.9 or more), names that no surface equals are compared before they are stripped: the surface of the
    largest weighted ratio from there on counts, among equals the one that stands first.
    """
    small = (lookup.count() if surfaces is None else surfaces) <= BROADCAST_SURFACES
    held = F.broadcast(lookup) if small else lookup
    raw = F.lower(F.trim(F.col(name)))
    stripped = strip_component(F.col(name))
    own = df.withColumn("_raw", raw).withColumn("_stripped", stripped)
    a = held.select(F.col("surface").alias("_raw"), F.col("canonical").alias("_c1"), F.col("category").alias("_g1"))
    b = held.select(F.col("surface").alias("_low"), F.col("canonical").alias("_c2"), F.col("category").alias("_g2"))
    own = own.withColumn("_low", F.lower("_stripped")).join(a, "_raw", "left").join(b, "_low", "left")
    if fuzzy is not None:
        place = "place" if "place" in lookup.columns else None
        missed = own.where("_c1 is null and _raw <> ''").select("_raw").distinct()
        found = best_surfaces(missed, "_raw", lookup, "surface", order=place, threshold=fuzzy).withColumnRenamed("name", "_plain")
        c = lookup.select(plain(F.col("surface")).alias("surface"), F.col("canonical").alias("_c3"), F.col("category").alias("_g3")).dropDuplicates(["surface"])
        own = own.withColumn("_plain", plain(F.col(name))).join(found.join(c, "surface").drop("surface").withColumnRenamed("score", "_s3"), "_plain", "left").drop("_plain")
    else:
        own = own.withColumns({"_c3": F.lit(None).cast("string"), "_g3": F.lit(None).cast("string"), "_s3": F.lit(None).cast("double")})
    near = F.col("_c1").isNull() & F.col("_c3").isNotNull()
    blank, hit, second = F.coalesce(F.col("_raw"), F.lit("")) == "", F.col("_c1").isNotNull(), F.col("_c2").isNotNull()
    canonical = F.when(blank, F.col(name)).when(hit, F.col("_c1")).when(near, F.col("_c3")).when(second, F.col("_c2")).when(F.col("_stripped") != "", F.col("_stripped")).otherwise(F.col(name))
    via = F.when(blank, "none").when(hit, F.when(F.lower("_c1") == F.col("_raw"), "exact").otherwise("alias")).when(near, "fuzzy").when(second, "stripped").otherwise("none")
    out = own.withColumn("canonical", canonical).withColumn("category", F.coalesce("_g1", "_g3", "_g2")).withColumn("matched_via", via)
    return out.withColumn("score", F.when(blank, 0.0).when(hit, 1.0).when(near, F.col("_s3")).when(second, 0.9).otherwise(0.0)).drop("_raw", "_stripped", "_low", "_c1", "_c2", "_g1", "_g2", "_c3", "_g3", "_s3")
