"""Filter interaction audit: what each filter removes in every order of five filters.

Each task reads the text column's Arrow buffers: NumPy byte classes and prefix sums over all texts of a batch give
words, capitals, code points and symbols of each; distinct words are counted by sorting the words' hashes by document
and comparing the bytes of equal neighbours. A document becomes one mask of failed filters (a bit each). Identical
texts are found by their SHA-256 alone, so no text is shuffled. Masks reduce to counts for each part, mask and label,
and the audit of all orders is worked out from these few rows.

Null text counts as empty, null lang as the empty part. Null ids stand after all others. Repeated rows count each; of
rows with one id and one text, none is a duplicate of another, as only a smaller id makes one. Labels that repeat an id
count if any row has them; documents without labels have neither. An empty table gives no rows. Texts are taken whole
at any length. Only the named columns are read; further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, mapped, span_hashes, table_batch, whole, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Bytes by class: white space, capital, symbol; one for whatever begins a code point.
SPACE, CAPITAL, SYMBOL, POINT = (np.zeros(256, np.bool_) for _ in range(4))
SPACE[[32, *range(9, 14)]] = True
CAPITAL[65:91] = True
SYMBOL[list(SYMBOLS)] = True
POINT[:128] = POINT[192:] = True
#: Texts scanned at once, in bytes and in number (a document's place takes 20 bits of a sort key).
SLICE_BYTES, SLICE_TEXTS = 1 << 20, 1 << 19


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (one more entry: the end), straight from Arrow's buffers."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    return np.frombuffer(data, np.uint8)[: at[-1]] if data else np.zeros(0, np.uint8), at


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most SLICE_BYTES, as far as a text's own length lets."""
    lo = 0
    while lo < len(at) - 1:
        hi = min(int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1, lo + SLICE_TEXTS, len(at) - 1)
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)


def class_counts(x: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many bytes of a class each text has, by prefix sums."""
    total = np.concatenate([[0], np.cumsum(kind[x], dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def word_spans(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and its text's place; words end where their text does."""
    inside = ~SPACE[x]
    edge = np.zeros(len(x) + 1, np.bool_)
    edge[at] = True
    start = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]]))
    stop = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def distinct_words(x: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Each text's number of distinct words: hashes sorted by text, equal neighbours verified by their bytes."""
    if not len(begin):
        return np.zeros(n_docs, np.int64)
    key = (doc.astype(np.uint64) << np.uint64(44)) | (span_hashes(x, begin, end) >> np.uint64(20))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = n_words(doc, n_docs) - np.bincount(doc[order[1:]][same], minlength=n_docs)
    first, second = order[:-1][same], order[1:][same]
    differs = ~equal_spans(x, begin[first], end[first], begin[second], end[second])
    for d in np.unique(doc[first[differs]]):  # a collision of hashes: that text's words are compared as they are
        own = np.flatnonzero(doc == d)
        out[d] = len({x[i:j].tobytes() for i, j in zip(begin[own], end[own], strict=True)})
    return out


def n_words(doc: np.ndarray, n_docs: int) -> np.ndarray:
    return np.bincount(doc, minlength=n_docs).astype(np.int64)


def equal_spans(x: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes [a, a_end) and [b, b_end) are the same, eight bytes at a step."""
    out = a_end - a == b_end - b
    held = np.concatenate([x, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    left, k = np.flatnonzero(out), 0
    while len(left):
        rest = np.minimum(a_end[left] - a[left] - k, 8)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - rest).astype(np.uint64))
        bad = ((eight[a[left] + k] ^ eight[b[left] + k]) & mask) != 0
        out[left[bad]] = False
        k += 8
        left = left[~bad & (a_end[left] - a[left] > k)]
    return out


def masks(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the filters A to D each text fails, as bits 0 to 3."""
    out = np.zeros(len(at) - 1, np.int32)
    for lo, hi in slices(at):
        part, own = x[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        begin, end, doc = word_spans(part, own)
        words = n_words(doc, hi - lo)
        fails = (
            words < MIN_WORDS,
            100 * distinct_words(part, begin, end, doc, hi - lo) < MIN_DISTINCT_PCT * words,
            100 * class_counts(part, own, CAPITAL) > MAX_CAPITAL_PCT * class_counts(part, own, POINT),
            class_counts(part, own, SYMBOL) > 0,
        )
        out[lo:hi] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return out


def marks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, mask (bits A to E) and digest of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([("id", id_type), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = text_buffers(batch.column(1))
            view = memoryview(x)
            digests = [hashlib.sha256(view[i:j]).digest() for i, j in itertools.pairwise(at.tolist())]
            yield table_batch(schema, [batch.column(0).cast(id_type), batch.column(2).cast(pa.string()).fill_null(""), masks(x, at), digests])

    rows = written(mapped(whole(docs, id_col, text_col, part_col), scan, f"id {'string' if kind == 'string' else 'long'}, part string, mask int, digest binary"), "marks")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"))
    # the key is the digest with the id, so that a large group of copies is no hot key
    met = rows.join(firsts.withColumnRenamed("digest", "first_digest"), (F.col("digest") == F.col("first_digest")) & F.col("id").eqNullSafe(F.col("first")), "left")
    out = met.select("id", "part", (F.col("mask") + F.when(F.col("first_digest").isNull(), 16).otherwise(0)).alias("mask"), "digest")
    out._held = rows
    return out


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    judged = marks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = judged.join(flags, F.col("id") == F.col("label_id"), "left")
    label = [F.coalesce(c, F.lit(0)).cast("long") for c in ("good", "toxic")]
    counts = met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(label[0]).alias("good"), F.sum(label[1]).alias("toxic"))
    out = orders(written(counts, "masks"))  # at most 32 rows a part
    free(judged._held)
    return out


def orders(counts: DataFrame) -> DataFrame:
    """The audit of every order from the counts of each part's masks: a filter removes what no filter before it does."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [(order, k + 1, bit[f], sum(bit[g] for g in order[:k])) for order in map("".join, itertools.permutations(FILTERS)) for k, f in enumerate(order)]
    step = F.explode(F.expr("array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'own', {own}, 'before', {before})" for o, k, own, before in steps) + ")"))
    each = counts.select("*", step.alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, alone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda when, n="n": F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0)).cast("long")
    # among the orders, the s filters that a document fails come first equally often: each removes it in 120 / s of them
    share = F.col("n") * F.expr("120 div greatest(bit_count(mask), 1)")
    return each.groupBy("part", "filter_order", "step").agg(
        total(alone & ~fails).alias("kept"),
        total(fails & alone).alias("removed"),
        total(fails & ~alone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & alone, "good").alias("good_lost"),
        total(fails & alone, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("long").alias("shapley"),
    )
