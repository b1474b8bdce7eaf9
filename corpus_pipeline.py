"""The training-data pipeline: quality rules, line dedup, near-duplicate groups, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Every
stage's result is written as Parquet in the shared folder and read again as the next one's docs. The stages handle
null and empty texts and repeated rows as their operators say; rows of one id are taken to be repeats of one document.
Tables may be empty, and further columns of any name are dropped. When a stage begins, its predecessor's result is
stored, so the tables that the predecessor wrote meanwhile are deleted; other tables stay.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import functions as F

from lodestone.llm import decontam, jaccard, linededup, packing, quality
from lodestone.llm.common import Tables, free, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MAX_TOKENS, END_ID = 4096, 2
_tables = Tables()


def staged(stage):
    """The tables that a stage writes are those of the stage before no longer."""

    @functools.wraps(stage)
    def run(spark, docs, sf_dir):
        _tables.release()
        with _tables:
            return stage(spark, docs.select(*COLUMNS), sf_dir)

    return run


@staged
def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.judge(docs).where(F.col("quality")["kept"]).select(*COLUMNS)


@staged
def line_dedup(spark, docs, sf_dir):
    """Lines that repeat earlier ones go, and documents that lose all their words with them."""
    done = linededup.dedup(docs)
    left = (F.col("n_dropped_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n = F.when(F.col("n_dropped_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(left).withColumn("n_chars", n).select(*COLUMNS)


@staged
def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked documents stays: that with the smallest id."""
    kept = jaccard.join(docs).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])


@staged
def decontamination(spark, docs, sf_dir):
    """Documents that the contamination rule finds go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find(docs, benchmark, keep=tuple(COLUMNS)).where(~decontam.contaminated()).select(*COLUMNS)


@staged
def packed(spark, docs, sf_dir):
    """The pieces of the sequences that the documents are packed into."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=MAX_TOKENS, end_id=END_ID, keep_ids=False).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]
#: SQL can't express the tokenizer's ids: tests hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            if k:
                free(before)
    return docs
