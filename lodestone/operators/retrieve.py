"""Lexical and vector retrieval."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestone.functions.text import cosine, retrieval_tokens


def term_stats(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> tuple[DataFrame, Row]:
    """(id, len, tf array) of the documents that have a term, and one row of n, total length and df array.

    Only the query's terms are counted, within the row: no token is ever exploded or shuffled. A text is read once: its
    length and counts are kept for the scores.
    """
    held = F.array(*map(F.lit, terms))
    # one pass leaves the query's tokens, in which each term is counted; a lambda's argument is evaluated once
    counted = lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(*set(terms))).alias("t"))
    own = docs.select(F.col(id_col), F.get(F.transform(F.array(retrieval_tokens(F.col(text_col))), counted), F.lit(0)).alias("_c"))
    own = own.select(id_col, F.col("_c.len").alias("len"), F.get(F.transform(F.array(F.col("_c.t")), lambda t: F.transform(held, lambda q: F.size(F.filter(t, lambda x: x == q)))), F.lit(0)).alias("tf")).persist()
    stats = own.agg(F.count("*").alias("n"), F.sum("len").alias("total"), F.array(*[F.count_if(F.col("tf")[k] > 0) for k in range(len(terms))]).alias("df"))
    return own.where(F.exists("tf", lambda x: x > 0)), stats.first()


def tfidf(docs: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sum over query tokens, repeats counted, of tf/len * (ln((n+1)/(df+1)) + 1)."""
    own, stats = term_stats(docs, id_col, text_col, terms)
    parts = [F.col("tf")[k] / F.col("len") * (math.log((stats["n"] + 1) / (stats["df"][k] + 1)) + 1) for k in range(len(terms))]
    return own.select(id_col, sum(parts[1:], parts[0]).alias("score"))


def bm25(docs: DataFrame, terms: list[str], *, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Okapi BM25 of documents that share a token with the query, whatever the score; negative idf becomes a share of the mean idf of the query's terms."""
    own, stats = term_stats(docs, id_col, text_col, terms)
    raw = [math.log((stats["n"] - df + 0.5) / (df + 0.5)) for df in stats["df"]]
    mean, average = sum(raw) / len(raw), (stats["total"] or 0) / max(1, stats["n"]) or 1.0
    parts = []
    for k, idf in enumerate(raw):
        tf = F.col("tf")[k]
        parts.append((floor * abs(mean) if idf < 0 else idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / average)))
    return own.select(id_col, sum(parts[1:], parts[0]).alias("score"))


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """By score, ties by id: a distributed top-k."""
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def concept_vector(text, concepts: dict[str, list[str]]):
    """How many of each concept's terms a text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda t: F.when(F.contains(low, F.lit(t)) | F.contains(low, F.lit(t.replace("-", " "))), 1.0).otherwise(0.0)
    return F.array(*[sum([has(t) for t in terms[1:]], has(terms[0])) for terms in concepts.values()])


def nearest(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact cosine top-k for one query vector; each task keeps its own k before they meet."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return top_k(vectors.select(id_col, cosine(F.col(vector_col), q).alias("score")), k, id_col)
