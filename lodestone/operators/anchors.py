"""Block re-resolution (L16): where the blocks that candidates point to are in a newer version of their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.scratch import free, written


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _key(text: Column) -> Column:
    """128 bits of a text, for equality within a record."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _words(text: str) -> Column:
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _shingles(words: str, size: int) -> Column:
    """The distinct runs of `size` words as 64-bit hashes; all words as one run if there are fewer, none without words."""
    n = F.greatest(F.lit(1), F.size(words) - size + 1)
    # shifted copies side by side: a lambda over places would look the words up again at each one
    runs = F.transform(F.arrays_zip(*[F.slice(words, 1 + j, n).alias(f"w{j}") for j in range(size)]), lambda x: F.xxhash64(*[x[f"w{j}"] for j in range(size)]))
    return F.array_distinct(runs)


def resolve(anchors: DataFrame, blocks: DataFrame, *, reach: int = 2, least: float = 0.5, margin: float = 0.1, size: int = 3) -> DataFrame:
    """For each anchor (anchor_id, record_id, page, block, text): status, and the page, block and span where it is now.

    unmoved: its text stands where it stood. moved: its text stands elsewhere in the record; of several places the
    nearest by pages, then by blocks, and `ambiguous` if two are as near. edited: no block has its text, but one within
    `reach` pages, alone or with the next of its page (a block that was split), shares the most word shingles (Dice's
    measure, at least `least`), and no other window that isn't part of the same place comes within `margin` of it; else
    ambiguous. deleted: nothing is like it. Empty anchors are deleted unless an empty block stands in their place.

    Anchors meet the places of their text by its key; those that are nowhere meet the blocks by ranges of pages within the
    record. Texts are exchanged as they are, once each way: shingles are made after that, and never exchanged.
    """
    place = [F.col(n).cast("long").alias(n) for n in ("page", "block")]
    old = anchors.select("anchor_id", "record_id", *place, plain(F.col("text")).alias("text"))
    own = blocks.select("record_id", *place, plain(F.col("text")).alias("text"))
    # an empty text is looked for in its own place alone; no plain text holds a line break
    key = _key(F.when(F.col("text") == "", F.concat(F.lit("\n"), F.col("page").cast("string"), F.lit("\n"), F.col("block").cast("string"))).otherwise(F.col("text"))).alias("_t")
    places = own.select("record_id", key, "page", "block").repartition("record_id", "_t").groupBy("record_id", "_t").agg(F.collect_list(F.struct("page", "block")).alias("_at"))
    held = old.select("*", key).join(places, ["record_id", "_t"], "left")
    far = F.transform("_at", lambda x: F.struct(F.abs(x["page"] - F.col("page")).alias("p"), F.abs(x["block"] - F.col("block")).alias("b"), x["page"].alias("page"), x["block"].alias("block")))
    held = held.withColumn("_far", far).withColumn("_near", F.array_min("_far"))
    tied = F.size(F.filter("_far", lambda x: (x["p"] == F.col("_near.p")) & (x["b"] == F.col("_near.b")))) > 1
    status = F.when((F.col("_near.p") == 0) & (F.col("_near.b") == 0), "unmoved").when(F.col("_near").isNotNull(), F.when(tied, "ambiguous").otherwise("moved"))
    known = held.select("anchor_id", "record_id", F.col("page").alias("page0"), F.when(F.col("_near").isNull(), F.col("text")).alias("text"), status.alias("status"), F.col("_near.page").alias("page"), F.col("_near.block").alias("block"))
    known = written(known)

    wide = 8 * reach + 1  # pages of a range; blocks within reach of its ends are in two
    part = lambda page: F.floor((page + 4 * reach) / wide)
    lost = known.where("status is null").select("anchor_id", "record_id", "page0", "text", part(F.col("page0")).alias("_c")).repartition("record_id", "_c")
    lost = lost.withColumn("_w", _words("text")).select("anchor_id", F.col("record_id").alias("_r0"), F.col("_c").alias("_c0"), "page0", _shingles("_w", size).alias("g0"))
    near = own.select("*", F.explode(F.sequence(part(F.col("page") - reach), part(F.col("page") + reach))).alias("_c")).repartition("record_id", "_c")
    near = near.withColumn("_n", F.lead("text").over(Window.partitionBy("record_id", "_c", "page").orderBy("block"))).withColumn("_w", _words("text")).withColumn("_n", F.concat("_w", _words("_n")))
    near = near.select("record_id", "_c", "page", "block", _shingles("_w", size).alias("g1"), F.when(F.col("_n").isNotNull(), _shingles("_n", size)).alias("g2"))
    met = lost.join(near, (F.col("_r0") == F.col("record_id")) & (F.col("_c0") == F.col("_c")) & (F.abs(F.col("page") - F.col("page0")) <= reach), "left")

    low = least - margin - 1e-6  # what is below is neither found nor a runner-up that counts

    def like(span: int) -> Column:
        mine, other = F.size("g0"), F.size(f"g{span}")
        may = (mine > 0) & (other > 0) & (2 * F.least(mine, other) >= low * (mine + other))
        return F.when(may, 2 * F.size(F.array_intersect("g0", f"g{span}")) / F.greatest(mine + other, F.lit(1))).alias(f"s{span}")

    scored = met.select("_r0", "_c0", "anchor_id", "page", "block", like(1), like(2))
    windows = [F.collect_list(F.when((F.col(f"s{n}") > 0) & (F.col(f"s{n}") >= low), F.struct((-F.col(f"s{n}")).alias("s"), F.lit(n).alias("span"), "page", "block"))).alias(f"l{n}") for n in (1, 2)]
    best = scored.groupBy("_r0", "_c0", "anchor_id").agg(*windows).select("anchor_id", F.concat("l1", "l2").alias("l")).withColumn("w", F.array_min("l")).withColumn("score", F.coalesce(-F.col("w.s"), F.lit(0.0)))
    # a runner-up overlaps no block of the best window
    other = F.filter("l", lambda x: (x["page"] != F.col("w.page")) | (x["block"] + x["span"] <= F.col("w.block")) | (F.col("w.block") + F.col("w.span") <= x["block"]))
    second = F.coalesce(-F.array_min(F.transform(other, lambda x: x["s"])), F.lit(0.0))
    enough, clear = F.col("score") >= least - 1e-9, F.col("score") - second >= margin - 1e-9
    judged = best.select("anchor_id", F.when(~enough, "deleted").when(clear, "edited").otherwise("ambiguous").alias("status"), *[F.when(enough & clear, F.col(f"w.{n}")).alias(n) for n in ("page", "block", "span")], F.when(enough, F.col("score")).otherwise(0.0).alias("score"))
    found = known.where("status is not null").select("anchor_id", "status", *[F.when(F.col("status") != "ambiguous", x).alias(n) for n, x in (("page", F.col("page")), ("block", F.col("block")), ("span", F.lit(1)))], F.lit(1.0).alias("score"))
    out = written(found.unionByName(judged))
    free(known)
    return out
