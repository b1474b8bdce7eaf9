"""Sinks: exports, guarded worksheets, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays as ";"-joined text, null as ''."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(F.coalesce(F.array_join(f"`{f.name}`", ";") if kind.startswith("array") else F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, order: list[str], *, single: bool = False) -> None:
    """Fixed columns, LF, sorted. A range partitioning sorts at any size; `single` is for small reports."""
    own = flat(df.orderBy(*order))
    (own.coalesce(1) if single else own).write.mode("errorifexists").csv(path, sep="\t", header=True, lineSep="\n", emptyValue="", quote='"', escape='"')


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """K05-K07, K09."""
    flat(df.orderBy(*order)).write.mode("errorifexists").csv(path, header=True, lineSep="\n", emptyValue="", quote='"', escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    """K08."""
    df.write.mode("errorifexists").json(path)


def guarded_overwrite(new: DataFrame, existing: DataFrame | None, path: str, filled: Column, *, force: bool = False) -> None:
    """Overwrite a worksheet only while nobody has filled it in, or with a backup beside it."""
    if existing is not None and not existing.where(filled).isEmpty():
        if not force:
            raise FileExistsError(f"{path} has filled-in rows")
        existing.write.mode("errorifexists").parquet(f"{path.rstrip('/')}.backup")
    new.write.mode("overwrite").parquet(path)


def bundle_manifest(files: DataFrame) -> DataFrame:
    """Each file's name, size and SHA-256."""
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_components(rows: DataFrame) -> DataFrame:
    """K06's rows: components by paper and role."""
    return rows.orderBy("paper_id", "role", "raw_name")
