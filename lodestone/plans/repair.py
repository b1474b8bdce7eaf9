"""Identity repair over all parts as papers, with planted disagreements of every kind, through versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import repair
from lodestone.plans.registry import query, table
from lodestone.sources.versions import VersionedTable
from lodestone.streaming.events import stored

_SLUG = "concat(translate(p_name, ' ', '-'), '-', lower(translate(p_brand, '#', '')), '-', k)"
#: The stored papers and their sources; every remainder plants one disagreement.
TABLES = {
    "papers": f"k AS record_id, {_SLUG} AS paper_id, CASE WHEN k % 3 = 0 THEN 'Untitled' ELSE t END AS title, 'A. One;B. Two' AS authors, CAST(CASE WHEN k % 6 = 2 THEN 1900 ELSE y END AS INT) AS year, 'Journal' AS journal, CASE WHEN k % 3 <> 0 THEN d END AS doi, concat('https://doi.org/', d) AS url, 'Short.' AS abstract, CAST(CASE WHEN k % 2 = 0 THEN 7 ELSE 0 END AS INT) AS n_pages, CAST(2 AS INT) AS n_figures, CAST(1 AS INT) AS n_tables, CAST(length(concat('Text of ', d)) AS INT) AS fulltext_chars, concat('sha-', k) AS source_sha256, 'CC-BY-4.0' AS license, concat(k, '.pdf') AS pdf_path",
    "canonical": "k AS record_id, t AS title, concat('doi:', d) AS doi, y AS year, CASE WHEN k % 5 = 0 THEN '' ELSE concat('https://doi.org/', d) END AS url",
    "source": f"k AS record_id, CASE WHEN k % 17 = 3 THEN 'other' ELSE {_SLUG} END AS paper_id, CASE WHEN k % 47 = 1 THEN '10.9/x' ELSE upper(d) END AS doi, CASE WHEN k % 29 = 8 THEN 'CC0-1.0' ELSE 'CC-BY-4.0' END AS license",
    "acquired": "k AS record_id, concat('https://doi.org/', d) AS doi, CASE WHEN k % 13 = 4 THEN 'failed' WHEN k % 2 = 0 THEN 'downloaded' ELSE 'existing_verified' END AS status, CASE WHEN k % 11 = 5 THEN 'bad' ELSE concat('sha-', k) END AS sha256, concat('https://doi.org/', d) AS url",
    "parsed": "k AS record_id, concat('sha-', k) AS sha256, CASE WHEN k % 53 = 2 THEN 'Another title' ELSE t END AS title, CASE WHEN k % 23 = 7 THEN '10.9/y' ELSE d END AS doi, 'CC-BY-4.0' AS license, array('A. One', 'B. Two') AS authors, 'Journal' AS journal, 'Short.' AS abstract, 2 AS n_figures, 1 AS n_tables, CASE WHEN k % 31 = 9 THEN 'Text' ELSE concat('Text of ', d) END AS fulltext",
    "pdfs": "k AS record_id, CASE WHEN k % 59 = 4 THEN 'changed' ELSE concat('pdf-', k) END AS sha256, concat('pdf-', k) AS audited_sha256, CASE WHEN k % 41 = 12 THEN 'unreadable' ELSE 'audited' END AS audit_status, CASE WHEN k % 43 = 14 THEN 'x' ELSE '7' END AS pages",
}


@query("g09_identity_repair", f"""WITH p AS (SELECT *, p_partkey AS k, p_name || ' ' || p_brand || ' ' || p_partkey AS t, '10.1/a' || p_partkey AS d, 1990 + p_partkey % 30 AS y, p_partkey % 37 = 10 AS two, p_partkey % 2 = 0 OR p_partkey % 37 = 10 AS pdf FROM part),
f AS (SELECT *, CASE WHEN k % 17 = 3 THEN 'title_or_folder_mismatch' WHEN k % 47 = 1 THEN 'doi_disagrees_across_manifests' WHEN k % 13 = 4 THEN 'acquisition_not_verified' WHEN k % 19 = 6 THEN 'document_missing' WHEN k % 11 = 5 THEN 'document_hash_mismatch' WHEN k % 23 = 7 THEN 'document_doi_mismatch' WHEN k % 53 = 2 THEN 'document_title_mismatch'
  WHEN k % 29 = 8 THEN 'document_license_mismatch' WHEN k % 31 = 9 THEN 'fulltext_without_doi' WHEN two THEN 'several_pdfs' WHEN pdf AND k % 41 = 12 THEN 'pdf_not_audited' WHEN pdf AND k % 59 = 4 THEN 'pdf_hash_mismatch' WHEN pdf AND k % 43 = 14 THEN 'pdf_pages_invalid' END AS fault FROM p),
s AS (SELECT *, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'title' END, CASE WHEN k % 6 = 2 THEN 'year' END, CASE WHEN k % 3 = 0 THEN 'doi' END) AS c FROM f)
SELECT k AS record_id, CASE WHEN fault IS NOT NULL THEN 'fault' WHEN c = '' THEN 'already_verified' ELSE 'repaired' END AS status, fault, CASE WHEN fault IS NULL THEN c ELSE '' END AS changed, fault IS NULL AND c <> '' AS quarantined,
CASE WHEN fault IS NULL OR k % 3 <> 0 THEN t ELSE 'Untitled' END AS title, CASE WHEN fault IS NULL OR k % 3 <> 0 THEN d END AS doi, (CASE WHEN fault IS NOT NULL AND k % 6 = 2 THEN 1900 ELSE y END)::INTEGER AS year, 2::BIGINT AS versions FROM s""")
def g09(spark, sf_dir):
    """The papers are a versioned table; they are repaired twice, and the second time nothing is left to do."""
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select("*", k.alias("k"), F.concat_ws(" ", "p_name", "p_brand", k).alias("t"), F.concat(F.lit("10.1/a"), k.cast("string")).alias("d"), (1990 + k % 30).alias("y"))
    pick = {name: spark.sql(f"SELECT {sql} FROM {{own}}", own=own) for name, sql in TABLES.items()}
    pdfs = pick["pdfs"].where("record_id % 2 = 0 or record_id % 37 = 10")
    pdfs = pdfs.unionAll(pdfs.where("record_id % 37 = 10"))
    at = stored(spark)
    held, quarantine = VersionedTable(spark, f"{at}/papers"), VersionedTable(spark, f"{at}/quarantine")
    held.replace(pick["papers"])
    sources = (pick["canonical"], pick["source"], pick["acquired"], pick["parsed"].where("record_id % 19 <> 6"), pdfs)
    done = repair.apply(held, quarantine, repair.judged(held.read(), *sources))
    again = repair.apply(held, quarantine, repair.judged(held.read(), *sources))
    if again.version is not None:
        raise RuntimeError("a repaired table was repaired again")
    kept = quarantine.read().select("record_id", F.lit(True).alias("q")).distinct()
    now = held.read().select("record_id", "title", "doi", "year")
    out = done.outcomes.select("record_id", "status", "fault", F.array_join("changed", ",").alias("changed")).join(now, "record_id").join(kept, "record_id", "left")
    return out.select("record_id", "status", "fault", "changed", F.coalesce("q", F.lit(False)).alias("quarantined"), "title", "doi", "year", F.lit(len(held.versions())).cast("long").alias("versions"))
