"""Manifests of pointers into pages: pools bound by hashes, held-out evaluation, and validators that name each changed item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.probes import content_hash
from lodestone.operators.ranks import ranked

POINTER = ["item_id", "record_id", "page", "block", "sha256"]
#: The signals that a held-out page must all have.
HELD_OUT_SIGNALS = ("caption", "outcome", "medium", "sample_size", "dispersion")


def page_pool(pages: DataFrame, *, negatives_per_positive: float = 1.0) -> DataFrame:
    """A record's positive pages and as many decoys as asked, the first by hash of record, page and content.

    Takes record_id, page, excerpt and positive; pages without an excerpt can't be asked for. Gives the pointer columns,
    positive and `fault`: records whose decoys don't suffice or whose positive page has no excerpt say so in each row.
    """
    own = pages.withColumn("sha256", F.sha2(F.coalesce("excerpt", F.lit("")), 256)).withColumn("_usable", F.coalesce(F.length("excerpt"), F.lit(0)) > 0)
    order = F.sha2(F.concat_ws(":", F.col("record_id").cast("string"), F.col("page").cast("string"), F.col("sha256")), 256)
    own = own.withColumn("_h", order)
    decoy = F.col("_usable") & ~F.col("positive")
    counts = own.groupBy("record_id").agg(
        F.sum(F.col("positive").cast("int")).alias("_positives"), F.sum(decoy.cast("int")).alias("_decoys"), F.sum((F.col("positive") & ~F.col("_usable")).cast("int")).alias("_blank")
    )
    needed = F.bround(F.col("_positives") * negatives_per_positive).cast("int")
    fault = F.when(F.col("_positives") == 0, "no_positive_page").when(F.col("_blank") > 0, "positive_page_without_excerpt").when(F.col("_decoys") < needed, "insufficient_decoys")
    place = F.row_number().over(Window.partitionBy("record_id", decoy).orderBy("_h", "page"))
    chosen = own.where("_usable").withColumn("_decoy", decoy).withColumn("_k", place).join(counts, "record_id").withColumn("fault", fault)
    kept = chosen.where(~F.col("_decoy") | (F.col("_k") <= needed))
    return kept.select(F.concat(F.lit("P"), F.substring("_h", 1, 16)).alias("item_id"), "record_id", "page", F.lit(-1).alias("block"), "sha256", "positive", "excerpt", "fault")


def held_out_pages(blocks: DataFrame) -> DataFrame:
    """record_id, page and positive: a page counts if its blocks show every signal that a held-out page needs. Takes record_id, page and signals (array)."""
    each = [F.max(F.array_contains("signals", s).cast("int")) for s in HELD_OUT_SIGNALS]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return blocks.groupBy("record_id", "page").agg((total == len(HELD_OUT_SIGNALS)).alias("positive"))


def evaluate(pool: DataFrame, selected: DataFrame, silver: DataFrame) -> DataFrame:
    """One row: how many held-out locators of the pool's records the pool covers and the selection found, and those missed."""
    where = ["record_id", "page", "block", "sha256"]
    mine = silver.join(pool.select("record_id").distinct(), "record_id", "left_semi")
    got = mine.join(pool.select(*where, F.col("item_id").alias("_id")).dropDuplicates(where), where, "left").join(selected.select(F.col("item_id").alias("_id"), F.lit(True).alias("_hit")).distinct(), "_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = got.agg(F.count("*").alias("silver_total"), F.count("_id").alias("prefilter_covered"), F.sum(hit.cast("long")).alias("selected"), F.sort_array(F.collect_list(F.when(~hit, F.col("item_id")))).alias("missed_ids"))
    return out.withColumn("recall", F.round(F.col("selected") / F.col("silver_total"), 4))


def manifest(pool: DataFrame, selected: DataFrame, *, stable: bool, recall: float | None = None, least_recall: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(header, candidates): the selected items' pointers in order, and the counts and hash that bind them to the pool.

    A selection that isn't stable, or that misses too much of the held-out set, gives no candidates.
    """
    passed = stable and (recall is None or recall >= least_recall)
    status = "candidate_pointers_for_expert_review" if passed else "failed_held_out_recall_no_output" if stable else "failed_unstable_no_output"
    rows = pool.select(*POINTER).join(selected.select("item_id").distinct(), "item_id", "left_semi")
    rows = numbered(rows if passed else rows.limit(0))
    of_pool = pool.agg(F.count("*").alias("input_items"), content_hash(pool, *POINTER).alias("pool_hash"))
    of_rows = rows.agg(F.count("*").alias("selected_items"), content_hash(rows, "position", *POINTER).alias("candidates_hash"))
    header = of_pool.withColumn("_1", F.lit(1)).join(of_rows.withColumn("_1", F.lit(1)), "_1").drop("_1").withColumn("status", F.lit(status)).withColumn("deployed", F.lit(passed))
    return header, rows


def numbered(rows: DataFrame) -> DataFrame:
    """Add `position` by item_id, from 1."""
    return ranked(rows, ["item_id"], "position").withColumn("position", F.col("position") + 1)


def faults(header: DataFrame, candidates: DataFrame, pool: DataFrame, expected: DataFrame | None = None, training: DataFrame | None = None) -> DataFrame:
    """Fault, item_id and detail of whatever differs from what a manifest must be; no rows for a good one.

    Candidates are held against the pool (unknown, duplicate, tampered: which fields), against the selection they were
    made from (missing, unexpected), against their own order (reordered), against records used before (overlap), and the
    header against both (count, hash, candidates in spite of a failed gate).
    """
    rows = candidates.select("position", *POINTER)
    known = pool.select(F.col("item_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in POINTER[1:]]).dropDuplicates(["_id"])
    met = rows.join(known, F.col("item_id") == F.col("_id"), "left")
    fields = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in POINTER[1:]]))
    entry = lambda df, fault, detail, item="item_id": df.select(F.lit(fault).alias("fault"), F.col(item).cast("string").alias("item_id"), detail.cast("string").alias("detail"))
    none = F.lit(None).cast("string")
    out = [
        entry(met.where("_id is null"), "unknown", none),
        entry(met.where(F.col("_id").isNotNull() & (F.size(fields) > 0)), "tampered", F.array_join(fields, ",")),
        entry(rows.groupBy("item_id").count().where("count > 1"), "duplicate", F.col("count")),
        entry(_misplaced(rows), "reordered", F.col("position")),
    ]
    if expected is not None:
        out.append(entry(expected.select("item_id").distinct().join(rows, "item_id", "left_anti"), "missing", none))
        out.append(entry(rows.join(known, F.col("item_id") == F.col("_id"), "left_semi").join(expected, "item_id", "left_anti").select("item_id").distinct(), "unexpected", none))
    if training is not None:
        out.append(entry(rows.join(training.select("record_id").distinct(), "record_id", "left_semi").select("item_id").distinct(), "overlap", none))
    facts = pool.agg(F.count("*").alias("n"), content_hash(pool, *POINTER).alias("h")).withColumn("_1", F.lit(1)).join(rows.agg(F.count("*").alias("k"), content_hash(rows, "position", *POINTER).alias("g")).withColumn("_1", F.lit(1)), "_1")
    own = header.withColumn("_1", F.lit(1)).join(facts, "_1")
    for fault, bad in (("input_count", F.col("n") != F.col("input_items")), ("pool_hash", F.col("h") != F.col("pool_hash")), ("selected_count", F.col("k") != F.col("selected_items")), ("candidates_hash", F.col("g") != F.col("candidates_hash")), ("output_of_failed_gate", ~F.col("deployed") & (F.col("k") > 0))):
        out.append(own.where(bad).select(F.lit(fault).alias("fault"), none.alias("item_id"), none.alias("detail")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _misplaced(rows: DataFrame) -> DataFrame:
    """Rows whose position isn't their id's rank. Duplicates keep the place of the first, and count for later ranks."""
    ranked = numbered(rows.withColumnRenamed("position", "_held").select("item_id", "_held"))
    first = ranked.groupBy("item_id").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    return rows.join(first, "item_id").where((F.col("position") < F.col("lo")) | (F.col("position") > F.col("hi"))).select("item_id", "position")
