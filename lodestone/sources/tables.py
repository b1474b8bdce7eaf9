"""Delimited, JSON and knowledge-base scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions.text import direction_from_text
from lodestone.operators.ranks import ranked

#: Decisions that carry evidence, and metrics that are ratios.
SUPPORTED = ("supported", "partial")
RATIO_METRICS = ("fold_change", "fold change", "fold", "response_ratio", "ratio", "proliferation_ratio", "relative_proliferation")
ITEM = "component string, outcome string, paper_id string, effect string, variance string, direction string, context map<string,string>, quote string"


def read_tsv(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Every column a string, empty as '' and not null; the header is checked by name."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, quote='"', escape='"', enforceSchema=False, multiLine=True)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evidence items of JSON arrays, numbers coerced, rows without component or paper dropped."""
    raw = spark.read.json(path, schema=ITEM, multiLine=True)
    num = lambda c: F.col(c).try_cast("double").alias(c)
    out = raw.select("component", "outcome", "paper_id", num("effect"), num("variance"), F.col("direction").try_cast("int").alias("direction"), "context", F.coalesce("quote", F.lit("")).alias("quote"))
    return out.where("trim(component) <> '' and trim(paper_id) <> ''")


def read_extractions(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Stored JSON documents as structs; malformed ones are left out."""
    kept = df.where(F.try_parse_json(column).isNotNull())
    return kept.select(*[c for c in df.columns if c != column], F.from_json(column, schema).alias("doc"))


def read_metadata(spark: SparkSession, folder: str, schema: str, name: str = "metadata.json") -> DataFrame:
    """*/metadata.json (or files of another name) with its folder's name, malformed files left out."""
    raw = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*/{name}", multiLine=True)
    return raw.withColumn("slug", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).where("_bad is null").drop("_bad")


def adjudicated_items(rows: DataFrame) -> DataFrame:
    """Evidence items of supported or partial decisions, and `skipped` for those without a component or direction.

    A positive ratio gives its logarithm as the effect and its side of one as the direction; the variance counts only
    if positive. Else the finding's polarity words decide.
    """
    value, variance = F.col("numeric_effect_value").try_cast("double"), F.col("numeric_effect_variance").try_cast("double")
    ratio = F.lower(F.trim("numeric_effect_metric")).isin(*RATIO_METRICS) & (value > 0)
    component = F.trim("formulation_or_variable")
    direction = F.when(ratio, F.when(value > 1, 1).when(value < 1, -1).otherwise(0)).otherwise(direction_from_text(F.concat_ws(" ", "key_finding", "numeric_effect_notes")))
    endpoint = F.lower("endpoint")
    outcome = F.when(F.contains(endpoint, F.lit("differentiat")), "differentiation").otherwise("proliferation")
    own = rows.where(F.lower(F.trim("decision")).isin(*SUPPORTED))
    return own.select(
        component.alias("component"),
        outcome.alias("outcome"),
        F.col("source_record_id").alias("paper_id"),
        F.when(ratio, F.ln(value)).alias("effect"),
        F.when(ratio & (variance > 0), variance).alias("variance"),
        direction.cast("int").alias("direction"),
        F.col("key_finding").alias("quote"),
        ((component == "") | direction.isNull()).alias("skipped"),
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files with their path, stem, SHA-256 and content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"), F.sha2("content", 256).alias("sha256"), "content")


def bundle_faults(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Path and fault of whatever a bundle's manifest (position, path, sha256; sorted by path from 0) and its files disagree on.

    unsafe_path: the path leaves the folder; missing: no such file; tampered: another hash; out_of_order: not at its
    path's rank; extra: a file that the manifest doesn't name. The first of these that holds; no rows for a good bundle.
    """
    checked = verified_files(files, manifest, root)
    safe = ~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))")
    plain = lambda x: F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+|^/+", "/")
    own = files.select(plain(F.col("path")).alias("_p")).select(F.substr("_p", F.length(F.concat(F.rtrim(plain(F.lit(root)), F.lit("/")), F.lit("/"))) + 1).alias("path"))
    there = own.distinct().withColumn("_there", F.lit(True))
    place = ranked(manifest.select("path"), ["path"], "_rank").groupBy("path").agg(F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi"))
    met = checked.join(there, "path", "left").join(place, "path", "left")
    fault = F.when(~safe, "unsafe_path").when(F.col("_there").isNull(), "missing").when(~F.col("ok"), "tampered").when(~F.col("position").between(F.col("_lo"), F.col("_hi")), "out_of_order")
    extra = own.join(manifest.select("path"), "path", "left_anti").select("path", F.lit("extra").alias("fault"))
    return met.select("path", fault.alias("fault")).where("fault is not null").unionByName(extra)


def verified_files(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Manifest rows (path relative to root, sha256) with `ok`: the file is there under a safe path and has its hash."""
    plain = lambda x: F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+|^/+", "/")  # noqa: E731  without scheme and host
    base = F.concat(F.rtrim(plain(F.lit(root)), F.lit("/")), F.lit("/"))
    own = files.select(plain(F.col("path")).alias("_p"), F.col("sha256").alias("_h")).where(F.startswith("_p", base))
    own = own.select(F.substr("_p", F.length(base) + 1).alias("path"), "_h")
    safe = ~F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))")
    return manifest.join(own, "path", "left").select(*manifest.columns, (F.coalesce(F.col("_h") == F.col("sha256"), F.lit(False)) & safe).alias("ok"))
