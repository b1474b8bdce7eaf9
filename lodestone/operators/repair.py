"""Identity repair (G09): papers whose stored identity disagrees with verified sources are replaced, and kept in quarantine.

Only papers whose canonical record, source record, acquisition and parsed document agree are touched; every other one
gets the first fault found. What is replaced is snapshotted under a hash of its own content and its source's before the
table's pointer moves, so a wrong merge can be traced and taken back, and a repeated run adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_doi_simple
from lodestone.functions.udf import slugify
from lodestone.sources.versions import VersionedTable

#: Acquisitions that count as verified.
VERIFIED = ("downloaded", "existing_verified")
IDENTITY = ["title", "authors", "year", "journal", "doi", "url", "abstract", "n_pages", "n_figures", "n_tables", "fulltext_chars", "source_sha256", "license"]


@dataclass(frozen=True)
class Repair:
    version: int | None
    outcomes: DataFrame


def _doi(x: Column) -> Column:
    return normalize_doi_simple(F.coalesce(x, F.lit("")))


def judged(papers: DataFrame, canonical: DataFrame, source: DataFrame, acquired: DataFrame, parsed: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Every canonical record with its paper, `fault` (null if it may be repaired) and `new`, the identity it should have.

    papers: record_id, paper_id, the identity columns, pdf_path, triage. canonical: record_id, title, doi, year, url.
    source: record_id, paper_id, doi, license. acquired: record_id, doi, status, sha256, url. parsed: record_id, sha256,
    title, doi, license, authors (array), journal, abstract, n_figures, n_tables, fulltext. pdfs: record_id, sha256,
    audited_sha256, audit_status, pages (text). A record has one row in each but pdfs, where it may have none or several.
    """
    under = lambda df, p: df.select(F.col("record_id"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "record_id"])
    files = pdfs.groupBy("record_id").agg(F.count("*").alias("f_n"), *[F.min(c).alias(f"f_{c}") for c in ("sha256", "audited_sha256", "audit_status", "pages")])
    own = under(canonical, "c")
    for df, p in ((source, "s"), (acquired, "a"), (parsed, "x"), (papers, "p")):
        own = own.join(under(df, p).withColumn(f"_{p}", F.lit(True)), "record_id", "left")
    own = own.join(files, "record_id", "left")
    own = own.withColumn("_slug", slugify(F.coalesce("c_title", F.lit("")))).withColumn("_xslug", slugify(F.coalesce("x_title", F.lit(""))))
    doi, pages = _doi(F.col("c_doi")), F.col("f_pages").try_cast("int")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    with_pdf = F.coalesce("f_n", F.lit(0)) > 0
    rules = [
        (F.col("_s").isNull() | F.col("_a").isNull() | F.col("_p").isNull(), "record_missing"),
        (differs("_slug", "s_paper_id") | differs("p_paper_id", "s_paper_id"), "title_or_folder_mismatch"),
        ((_doi(F.col("s_doi")) != doi) | (_doi(F.col("a_doi")) != doi), "doi_disagrees_across_manifests"),
        (~F.coalesce(F.col("a_status").isin(*VERIFIED), F.lit(False)), "acquisition_not_verified"),
        (F.col("_x").isNull(), "document_missing"),
        (differs("x_sha256", "a_sha256"), "document_hash_mismatch"),
        ((_doi(F.col("x_doi")) != doi), "document_doi_mismatch"),
        (differs("_xslug", "s_paper_id"), "document_title_mismatch"),
        (differs("x_license", "s_license"), "document_license_mismatch"),
        (~F.contains(F.lower(F.coalesce("x_fulltext", F.lit(""))), doi), "fulltext_without_doi"),
        (F.coalesce("f_n", F.lit(0)) > 1, "several_pdfs"),
        (with_pdf & differs("f_audit_status", "_audited"), "pdf_not_audited"),
        (with_pdf & differs("f_sha256", "f_audited_sha256"), "pdf_hash_mismatch"),
        (with_pdf & pages.isNull(), "pdf_pages_invalid"),
    ]
    own = own.withColumn("_audited", F.lit("audited"))
    fault = F.when(rules[0][0], rules[0][1])
    for bad, name in rules[1:]:
        fault = fault.when(bad, name)
    new = F.struct(
        F.coalesce("c_title", "x_title").alias("title"), F.array_join("x_authors", ";").alias("authors"), F.col("c_year").cast("int").alias("year"), F.nullif("x_journal", F.lit("")).alias("journal"), doi.alias("doi"),
        F.coalesce(F.nullif("c_url", F.lit("")), "a_url").alias("url"), F.nullif("x_abstract", F.lit("")).alias("abstract"), F.when(with_pdf, pages).otherwise(0).alias("n_pages"), F.col("x_n_figures").cast("int").alias("n_figures"),
        F.col("x_n_tables").cast("int").alias("n_tables"), F.length("x_fulltext").cast("int").alias("fulltext_chars"), F.col("x_sha256").alias("source_sha256"), F.col("x_license").alias("license"),
    )
    old = F.struct(*[F.col(f"p_{c}").alias(c) for c in IDENTITY])
    return own.select("record_id", F.col("p_paper_id").alias("paper_id"), fault.alias("fault"), old.alias("old"), new.alias("new"))


def outcomes(rows: DataFrame) -> DataFrame:
    """record_id, paper_id, status (fault, already_verified, repaired), fault, changed (names of columns) and snapshot_id."""
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in IDENTITY]))
    own = rows.withColumn("changed", F.when(F.col("fault").isNull(), changed).otherwise(F.array().cast("array<string>")))
    status = F.when(F.col("fault").isNotNull(), "fault").when(F.size("changed") == 0, "already_verified").otherwise("repaired")
    snapshot = F.substring(F.sha2(F.concat(F.to_json("old"), F.lit("\0"), F.col("new.source_sha256")), 256), 1, 16)
    return own.withColumn("status", status).withColumn("snapshot_id", F.when(F.col("status") == "repaired", snapshot))


def repaired(papers: DataFrame, found: DataFrame) -> DataFrame:
    """The papers with the identities of repaired records; pdf_path, triage and whatever else they have stay."""
    new = found.where("status = 'repaired'").select("record_id", *[F.col(f"new.{c}").alias(f"_new_{c}") for c in IDENTITY], F.lit(True).alias("_hit"))
    own = papers.join(new, "record_id", "left")
    return own.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in IDENTITY else F.col(c) for c in papers.columns])


def snapshots(found: DataFrame) -> DataFrame:
    """The quarantine's rows: what was replaced, under its snapshot's id, and what was expected."""
    return found.where("status = 'repaired'").select("record_id", "snapshot_id", "paper_id", F.to_json("old").alias("original"), F.col("old.doi").alias("observed_doi"), F.col("new.doi").alias("expected_doi"), F.col("new.source_sha256").alias("source_sha256"), F.array_join("changed", ",").alias("changed"))


def apply(table: VersionedTable, quarantine: VersionedTable, rows: DataFrame) -> Repair:
    """Quarantine what is to be replaced, then publish the repaired table; without repairs nothing is written.

    `rows` come from judged() over the table's latest version. The quarantine is published first: a crash in between
    leaves a snapshot without its repair, which the next run finds again under the same id and doesn't add twice. The
    staged table is read back and must have the same records, each once, with the new identities, or nothing changes.
    """
    found = outcomes(rows).persist()
    if found.where("status = 'repaired'").isEmpty():
        return Repair(None, found)
    kept = snapshots(found)
    if quarantine.versions():
        before = quarantine.read()
        fresh = kept.join(before.select("record_id", "snapshot_id"), ["record_id", "snapshot_id"], "left_anti")
        kept = before.unionByName(fresh)
    quarantine.replace(kept, note="before repair")
    papers = table.read()

    def wrong(staged: DataFrame) -> str | None:
        ids = staged.groupBy("record_id").count()
        if not ids.where("count <> 1").isEmpty() or ids.count() != papers.count():
            return "records were lost or doubled"
        new = found.where("status = 'repaired'").select("record_id", F.col("new.doi").alias("_doi"), F.col("new.title").alias("_title"))
        if not staged.join(new, "record_id").where(~(F.col("doi").eqNullSafe(F.col("_doi")) & F.col("title").eqNullSafe(F.col("_title")))).isEmpty():
            return "a repaired record doesn't have its new identity"
        return None

    return Repair(table.replace(repaired(papers, found), check=wrong, note="identity repair"), found)
