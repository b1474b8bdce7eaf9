"""Row predicates and coercions of the evidence workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(x: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def is_target(context: Column, species: list[str], cells: list[str], stages: list[str]) -> Column:
    """Species and cell among the lists (as substrings of species, cell type and stage), the stage empty or listed."""
    get = lambda k: F.lower(F.coalesce(F.element_at(context, k), F.lit("")))
    text = F.concat_ws(" ", get("species"), get("cell_type"), get("stage"))
    return _any(text, species) & _any(text, cells) & ((get("stage") == "") | _any(get("stage"), stages))


def is_actionable(component: Column, pattern: str) -> Column:
    """No word of the negative list."""
    return ~F.coalesce(component, F.lit("")).rlike(pattern)


def has_dose(component: Column, quote: Column, pattern: str) -> Column:
    """Component and quote show a dose."""
    return F.concat_ws(" ", component, quote).rlike(pattern)


def is_decoy(text: Column, found: Column, excluded: list[str], least: int = 120) -> Column:
    """Long enough and without an excluded signal."""
    return (F.length(text) >= least) & ~F.arrays_overlap(found, F.array(*map(F.lit, excluded)))


def qualifies(text: Column, patterns: list[str]) -> Column:
    """Every pattern matches."""
    out = F.lit(True)
    for p in patterns:
        out = out & text.rlike(p)
    return out


def is_yes(x: Column) -> Column:
    """P15."""
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("yes", "y", "true", "1")


def is_licence_url(x: Column) -> Column:
    """P15."""
    return F.coalesce(x.rlike(r"^https?://creativecommons\.org/(?:licenses|publicdomain)/"), F.lit(False))


def enforce_allowed(changes: Column, allowed: list[str]) -> Column:
    """Changes (variable, rationale, support) of variables that aren't allowed are flagged in rationale and support."""
    ok = lambda c: c["variable"].isin(*allowed)
    return F.transform(changes, lambda c: F.struct(c["variable"].alias("variable"), F.when(ok(c), c["rationale"]).otherwise(F.concat(c["rationale"], F.lit(" [not in the allowed list]"))).alias("rationale"), F.when(ok(c), c["support"]).otherwise("unsupported").alias("support")))


def all_failed(statuses: Column) -> Column:
    """There are operators and every one failed to answer."""
    return (F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "call_error")


def as_list(x: Column) -> Column:
    """P20: a scalar as a list; null or empty as none."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(x))


def as_text(x: Column) -> Column:
    """P20: a list as text."""
    return F.array_join(x, "; ")


def canonical_keys(payload: Column, blocks: dict[str, str]) -> Column:
    """Payload keys as block letters: a letter, or an attribute's name; a prefix.field keeps its field."""
    held = F.create_map(*[F.lit(x) for letter, name in blocks.items() for k in (letter.lower(), name.lower()) for x in (k, letter)])

    def key(k: Column, _: Column) -> Column:
        head = F.lower(F.regexp_extract(k, r"^([^.]*)", 1))
        return F.concat(F.coalesce(F.element_at(held, head), F.regexp_extract(k, r"^([^.]*)", 1)), F.regexp_extract(k, r"(\..*)?$", 1))

    return F.transform_keys(payload, key)


def normal_weights(weights: Column) -> Column:
    """Weights that add up to one, at four digits; null if one is negative or all are zero."""
    values = F.map_values(weights)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when((total > 0) & F.forall(values, lambda v: v >= 0), F.transform_values(weights, lambda _, v: F.floor(v / total * 1e4 + 0.5) / 1e4))


def previews(rows: DataFrame, texts: DataFrame, *, key: str = "paper_id", ranges: str = "ranges", most: int = 3, context: int = 0) -> DataFrame:
    """The passages of "a-b;c-d" character ranges with a status: missing_text, invalid_range, out_of_bounds or ok."""
    own = rows.select("*", F.posexplode(F.slice(F.split(F.col(ranges), ";"), 1, most)).alias("n", "r"))
    lo, hi = F.regexp_extract("r", r"^\s*(\d+)-(\d+)\s*$", 1).try_cast("int"), F.regexp_extract("r", r"^\s*(\d+)-(\d+)\s*$", 2).try_cast("int")
    own = own.withColumn("lo", lo).withColumn("hi", hi).join(texts, key, "left")
    status = F.when(F.col("text").isNull(), "missing_text").when(F.col("lo").isNull() | (F.col("hi") <= F.col("lo")), "invalid_range").when(F.col("hi") > F.length("text"), "out_of_bounds").otherwise("ok")
    start = F.greatest(F.lit(0), F.col("lo") - context)
    return own.withColumn("status", status).withColumn("passage", F.when(F.col("status") == "ok", F.substr("text", start + 1, F.col("hi") + context - start))).drop("text", "lo", "hi")
