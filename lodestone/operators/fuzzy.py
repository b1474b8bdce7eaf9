"""Fuzzy names: each name's best surface by a weighted ratio, without comparing all pairs.

The weighted ratio of two names (lower case, single spaces) is the largest of
  * their indel ratio 1 - d / (sum of lengths), d the insertions and deletions between them,
  * 0.95 x the indel ratio of their words in order, and of what their sets of words share and don't (lengths within 1.5),
  * 0.9 where the shorter name stands inside the longer one (lengths from 1.5 to 8 apart).
From 0.9 on, which is all that this join finds, nothing else of such a ratio can count.

Candidates meet by keys, and none that reaches the threshold is missed:
  * d edits leave S / 2 + 1 - 1.5 d of the bigrams of the padded words alike (S: sum of lengths), whatever the order of
    the words; so two names whose rarest few bigrams differ can't be near enough (a prefix filter),
  * where shared words decide, what one name has beside them is short, so its first words of the rarest-first order and
    all words of the other meet,
  * a name inside another shares its rarest gram of up to four characters.
Lengths are compared as names meet. Pairs are verified by a bit-parallel longest common subsequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import prepare

WORDS_SCALE, INSIDE_SCALE, NEAR_LENGTHS, FAR_LENGTHS = 0.95, 0.9, 1.5, 8.0
#: How many of the surfaces' most frequent grams and words are known as such (a bounded literal).
FREQUENT = 128


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence, one machine-independent integer of bits for all of x."""
    places: dict[str, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    full = held = (1 << len(x)) - 1
    for c in y:
        met = held & places.get(c, 0)
        held = (held + met | held - met) & full
    return len(x) - held.bit_count()


def indel_ratio(x: str, y: str) -> float:
    total = len(x) + len(y)
    return 1.0 - (total - 2 * common_length(x, y)) / total if total else 0.0


def words_ratio(x: str, y: str) -> float:
    """The better of the words in order, and of shared words against what each name has beside them."""
    a, b = x.split(), y.split()
    best = indel_ratio(" ".join(sorted(a)), " ".join(sorted(b)))
    shared, own, other = " ".join(sorted(set(a) & set(b))), " ".join(sorted(set(a) - set(b))), " ".join(sorted(set(b) - set(a)))
    if shared and not (own and other):
        return 1.0
    joint = len(shared) + 1 if shared else 0
    d = len(own) + len(other) - 2 * common_length(own, other)
    best = max(best, 1.0 - d / (2 * joint + len(own) + len(other)))
    for rest in (own, other) if shared else ():
        best = max(best, 1.0 - (1 + len(rest)) / (2 * len(shared) + 1 + len(rest)))
    return best


def weighted_ratio(x: str, y: str) -> float:
    """The weighted ratio of two names in lower case with single spaces; below 0.9 it is a lower bound only."""
    small, large = sorted((len(x), len(y)))
    if not small:
        return 0.0
    if large < NEAR_LENGTHS * small:
        return max(indel_ratio(x, y), WORDS_SCALE * words_ratio(x, y))
    return INSIDE_SCALE if large <= FAR_LENGTHS * small and (x in y or y in x) else 0.0


def plain(name: Column) -> Column:
    """A name in lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def _numbered(grams: str) -> str:
    """SQL: an array's entries, each with how many equal ones come before it."""
    return f"transform({grams}, (g, i) -> concat(g, cast(size(filter(slice({grams}, 1, i), h -> h = g)) as string)))"


def _windows(text: str, n: int) -> str:
    return f"case when length({text}) >= {n} then transform(sequence(1, length({text}) - {n - 1}), i -> substring({text}, i, {n})) else array() end"


def _rank(item: str, held: list[str]) -> str:
    """SQL: 0 for rare items, else the place among the frequent ones, the most frequent last."""
    quoted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in held)
    return f"coalesce(array_position(array({quoted}), {item}), 0)" if held else "0"


def _frequent(rows: DataFrame, items: str) -> list[str]:
    """The surfaces' most frequent items, rising; at most FREQUENT."""
    top = rows.select(F.explode(F.expr(items)).alias("item")).groupBy("item").count().where("count > 1").orderBy(F.desc("count"), "item").limit(FREQUENT)
    return [r["item"] for r in reversed(top.collect())]


def _keys(rows: DataFrame, held: dict[str, list[str]], threshold: float) -> DataFrame:
    """Add `key`, and in `side` what it must meet: bigrams each other (0), first words all words (1 and 2), grams inside all grams (3 and 4)."""
    words = WORDS_SCALE and threshold / WORDS_SCALE
    kept = 2 * (0.5 - 1.5 * (1 - threshold)) / (2 - threshold)
    beside = 1 + words / (2 * (1 - words)) if words < 1 else None
    own = rows.withColumn("_w", F.split("text", " ")).withColumn("_u", F.array_distinct("_w"))
    prefixes = []
    for w in ("_w", "_u"):
        own = own.withColumn(f"{w}g", F.expr(f"flatten(transform({w}, t -> transform(sequence(1, length(t) + 1), i -> substring(concat(' ', t, ' '), i, 2))))"))
        own = own.withColumn(f"{w}n", F.expr(_numbered(f"{w}g")))
        size = f"cast(floor((size({w}g) - 1) * {1 - kept!r} + 1e-9) as int) + 1"
        order = f"transform(array_sort(transform({w}n, g -> struct({_rank('substring(g, 1, 2)', held['pairs'])} as r, xxhash64(g) as h, g as g))), s -> s.g)"
        prefixes.append(f"slice({order}, 1, {size})")
    bigrams = f"array_union({prefixes[0]}, case when size(_w) > size(_u) then {prefixes[1]} else array() end)"
    joined = "length(array_join(_u, ' '))"
    ordered = f"transform(array_sort(transform(_u, t -> struct({_rank('t', held['words'])} as r, -length(t) as l, t as t))), s -> s.t)"
    own = own.withColumn("_o", F.expr(ordered))
    # words of the order until they are longer together than what may stand beside the shared ones
    reach = f"greatest(0.0, {joined} / {beside!r} - 1)" if beside else "0.0"
    first = f"filter(_o, (t, i) -> i = 0 or aggregate(slice(_o, 1, i), -1, (a, x) -> a + 1 + length(x)) <= {reach} + 1e-9)"
    each = [(0, bigrams), (1, first), (2, "_u")]
    for n in (1, 2, 3, 4):
        grams = _windows("text", n)
        rare = f"array_min(transform({grams}, g -> struct({_rank('g', held['grams'])} as r, xxhash64(g) as h, g as g))).g"
        each.append((3, f"case when length(text) {'>=' if n == 4 else '='} {n} then array(concat('{n}', {rare})) else array() end"))
        bound = {1: 8, 2: 16, 3: 24}.get(n)
        within = f"length(text) <= {bound}" if bound else "true"
        each.append((4, f"case when {within} then transform(array_distinct({grams}), g -> concat('{n}', g)) else array() end"))
    sides = ", ".join(f"transform({a}, k -> struct({s} as side, k as key))" for s, a in each)
    return own.select(*rows.columns, F.explode(F.array_distinct(F.expr(f"flatten(array({sides}))"))).alias("_k")).select(*rows.columns, "_k.side", "_k.key")


def candidates(names: DataFrame, surfaces: DataFrame, threshold: float) -> DataFrame:
    """Pairs (name, surface) of distinct texts that may reach the threshold, each once."""
    rows = surfaces.select("text")
    held = {
        "pairs": _frequent(rows, "flatten(transform(split(text, ' '), t -> transform(sequence(1, length(t) + 1), i -> substring(concat(' ', t, ' '), i, 2))))"),
        "words": _frequent(rows, "split(text, ' ')"),
        "grams": _frequent(rows, f"array_union({_windows('text', 3)}, {_windows('text', 4)})"),
    }
    longest = rows.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
    own = names.select("text").where(F.length("text") <= FAR_LENGTHS * longest)
    a = _keys(own, held, threshold).select(F.col("text").alias("name"), F.col("side").alias("a"), "key")
    b = _keys(rows, held, threshold).select(F.col("text").alias("surface"), F.expr("case side when 1 then 2 when 2 then 1 when 3 then 4 when 4 then 3 else 0 end").alias("a"), "key")
    n, s = F.length("name"), F.length("surface")
    small, large = F.least(n, s), F.greatest(n, s)
    near = large < NEAR_LENGTHS * small
    inside = F.col("name").contains(F.col("surface")) | F.col("surface").contains(F.col("name"))
    fits = F.when(F.col("a") >= 3, ~near & (large <= FAR_LENGTHS * small) & inside).otherwise(near)
    return a.join(b, ["a", "key"]).where(fits).select("name", "surface").distinct()


def best_surfaces(names: DataFrame, name: str, surfaces: DataFrame, surface: str, *, order: str | None = None, threshold: float = 0.9) -> DataFrame:
    """For each distinct name that reaches the threshold, its surface of the largest weighted ratio and the ratio.

    Ties go to the surface that comes first by `order`, then by text. Blank names and surfaces match nothing.
    """
    if not 0.9 <= threshold <= 1:
        raise ValueError("the weighted ratio is complete from 0.9 on")
    prepare(names.sparkSession)
    own = names.select(plain(F.col(name)).alias("text")).where("text <> ''").distinct()
    place = F.min(F.col(order)) if order else F.min(F.lit(0))
    other = surfaces.select(plain(F.col(surface)).alias("text"), *([F.col(order)] if order else [])).where("text <> ''").groupBy("text").agg(place.alias("place"))
    pairs = candidates(own, other, threshold)

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            score = [weighted_ratio(x, y) for x, y in zip(f["name"], f["surface"], strict=True)]
            f = f.assign(score=score)
            yield f[f["score"] >= threshold - 1e-12]

    scored = pairs.mapInPandas(verify, "name string, surface string, score double").join(other.withColumnRenamed("text", "surface"), "surface")
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("less"), "place", "surface")).alias("b"))
    return best.select("name", F.col("b.surface").alias("surface"), (-F.col("b.less")).alias("score"))
