"""The registered queries of this subpackage: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from secrets import token_hex

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, filters, jaccard, linededup, lm, oracles, packing, pii, quality, secrets, sentencepieces, tokens, urls, variants

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard", oracles.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=2, keep_ids=False).drop("ids")


@query("op5_url_filter", oracles.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.lodestone.surrogateKey; where it is unset, one is drawn for this run and forgotten."""
    key = spark.conf.get("spark.lodestone.surrogateKey", None) or token_hex(32)
    done = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    counts = [F.size(F.expr(f"filter(entities, e -> e.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", "text", *counts)


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query("op8_quality_rules", oracles.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query("op9_decontamination", oracles.OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op10_line_dedup", oracles.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n_dropped_lines").alias("n_dropped"), F.length("text").cast("long").alias("n_left_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("op11_sentencepieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.digest(sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), model), model))


@query("op12_filter_audit", oracles.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))
