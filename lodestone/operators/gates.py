"""Quality gates and validators: conditional counts, issue tables, status cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_ACTIONABLE = r"(?i)(?:^|[^A-Za-z0-9_])(scaffold|bioreactor|token)(?:[^A-Za-z0-9_]|$)"


def document_items(docs: DataFrame) -> DataFrame:
    """Evidence items of documents: the source as the component, the language as the context."""
    return docs.select(
        F.col("source").alias("component"),
        F.col("lang").alias("context"),
        F.col("doc_id").cast("string").alias("paper_id"),
        F.contains("text", F.lit("the")).alias("target"),
        (~F.col("text").rlike(NOT_ACTIONABLE)).alias("actionable"),
        F.col("text").rlike(r"\d").alias("dose"),
        (F.length("text") >= 200).alias("quoted"),
    )


def component_audit(items: DataFrame) -> DataFrame:
    """Conditional counts of each component's items; a candidate has a ready item and quotes for all."""
    ready = F.col("target") & F.col("actionable") & F.col("dose") & F.col("quoted")
    out = items.groupBy("component").agg(
        F.count("*").alias("items"),
        *[F.count_if(F.col(c)).alias(n) for c, n in (("target", "n_target"), ("actionable", "n_actionable"), ("dose", "n_dose"), ("quoted", "n_quote"))],
        F.count_if(ready).alias("n_ready"),
        F.countDistinct("context").alias("n_contexts"),
        F.bool_and("quoted").alias("all_quoted"),
        F.array_join(F.sort_array(F.collect_set("context")), ";").alias("contexts"),
    )
    return out.withColumn("candidate", (F.col("n_ready") > 0) & F.col("all_quoted")).drop("all_quoted")


def go_no_go(audit: DataFrame, *, least: int = 3) -> DataFrame:
    """One row; GO when nothing blocks."""
    one = audit.agg(F.count("*").alias("components"), F.count_if("candidate").alias("candidates"))
    blockers = F.filter(F.array(F.when(F.col("candidates") < least, "too_few_candidates")), lambda x: x.isNotNull())
    return one.select("components", "candidates", F.when(F.size(blockers) == 0, "GO").otherwise("NO_GO").alias("decision"), F.array_join(blockers, ";").alias("blockers"))


def issues(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """One row for each rule that a row breaks. A rule may end the row's checks by coming first alone."""
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(found).alias("issue"))


def export_valid(df: DataFrame, key: str, rules: list[tuple[str, Column]], wanted: Column) -> DataFrame:
    """The wanted rows that break no rule."""
    return df.where(wanted).join(issues(df, key, rules).select(key).distinct(), key, "left_anti")


def corpus_gate(df: DataFrame, counts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Conditional counts against least values, as one row for each check; PASS when all hold."""
    one = df.agg(*[F.count_if(c).alias(n) for n, (c, _) in counts.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n"), F.lit(least).cast("long").alias("least"), (F.col(n) >= least).alias("passed")) for n, (_, least) in counts.items()])
    return one.select(F.inline(rows))


def table_status(stats: Column, typed: Column, n_cell: Column, n_context: Column, response: Column, enough: Column, excluded: Column) -> Column:
    """The readiness of a table, first condition first."""
    return (
        F.when(excluded & stats, "excluded_non_effect_statistics")
        .when(~stats, "no_group_stat_structure")
        .when(~typed & ~n_cell, "incomplete_missing_dispersion_type_and_sample_size")
        .when(~typed, "incomplete_missing_dispersion_type")
        .when(~n_cell & n_context, "incomplete_sample_size_not_cell_addressable")
        .when(~n_cell, "incomplete_missing_sample_size")
        .when(~response, "ambiguous_complete_structure_needs_review")
        .when(~enough, "incomplete_insufficient_group_values")
        .otherwise("structural_group_stats_candidate")
    )


def open_access_status(conflict: Column, full_text: Column, licence: Column, metadata: Column) -> Column:
    """Title conflict, full text, licensed version of record, other licence, metadata alone, not found."""
    return F.when(conflict, "title_conflict").when(full_text, "full_text_candidate").when(licence == "vor", "licensed_version_of_record").when(licence.isNotNull(), "licensed_other").when(metadata, "metadata_only").otherwise("not_found")


def readiness(chars: Column, terms: Column, numbers: Column, operator: str) -> Column:
    """Whether a text is ready for an operator."""
    enough = (numbers >= 1) | (F.size(terms) >= 2) if operator == "dose" else F.size(terms) >= 2 if operator in ("medium", "endpoints") else (F.size(terms) > 0) | (chars >= 1000)
    return (chars >= 200) & enough


def probe_gate(recall: Column, consistency: Column, precision: Column, selected: Column) -> Column:
    """All four probe thresholds hold."""
    return (recall >= 0.95) & (consistency >= 0.95) & (precision >= 0.75) & (selected <= 0.60)
