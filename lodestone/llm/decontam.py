"""Benchmark decontamination by an FM-index of each training shard.

A shard is the words of a stretch of documents. Its text is first brought to the alphabet of the test phrases: other
words become separators, and stretches between separators that are shorter than the shortest phrase cannot hold one.
Over what is left the shard gets its suffix order, Burrows-Wheeler transform, wavelet matrix (ranks) and sampled
suffix positions; all test phrases are then searched backwards at once, their occurrences located, and the removal
spans merged. The benchmark goes to the executors in blocks of a bounded size, however large it is.

A phrase is 13 consecutive words of an item; an item of fewer words, but not none, is one phrase. Null texts have no
words. Repeated rows come out as often as they come in; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import mapped, texts, written

WINDOW, SHARD_WORDS, BLOCK_WORDS, SAMPLE = 13, 1 << 19, 1 << 20, 8
#: Words are runs of 0-9, a-z (A-Z lower-cased) and all that is not ASCII.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class FmIndex:
    """Over symbols 1..sigma-1 in which 0 separates; a search never crosses a separator, and each is smaller than any symbol and unlike any other."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        ends = symbols == 0
        rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
        at, h = np.arange(n), 1
        order = np.argsort(rank, kind="stable")
        while True:  # prefix doubling; done when all differ, after the logarithm of the longest stretch
            key = rank * (int(rank.max()) + 1) + rank[np.minimum(at + h, n - 1)]
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if step[-1] == n - 1:
                break
            h *= 2
        last = symbols[order - 1]  # the transform: the symbol before each suffix
        self.n, self.bits = n, max(1, int(sigma - 1).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.ones, self.zeros, part = [], [], last
        for bit in range(self.bits - 1, -1, -1):
            b = (part >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(b, dtype=np.int32)]))
            self.zeros.append(n - int(b.sum()))
            part = np.concatenate([part[~b], part[b]])
        begins = np.concatenate([[True], ends[:-1]])
        self.sampled = (order % SAMPLE == 0) | begins[order]
        self.where = np.where(self.sampled, order, -1)

    def rank(self, c: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each c occurs in the transform before each position."""
        zero, at = np.zeros(len(c), np.int64), list(at)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones, up = self.ones[level], (c >> bit & 1).astype(bool)
            zero, *at = (np.where(up, self.zeros[level] + ones[x], x - ones[x]) for x in (zero, *at))
        return [x - zero for x in at]

    def symbol(self, rows: np.ndarray) -> np.ndarray:
        """The transform's symbol of each row."""
        c, at = np.zeros(len(rows), np.int64), rows
        for level in range(self.bits):
            ones = self.ones[level]
            up = ones[at + 1] > ones[at]
            c = c << 1 | up
            at = np.where(up, self.zeros[level] + ones[at], at - ones[at])
        return c

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position) of every occurrence of phrases of one length, given as rows of symbols."""
        own, lo, hi = np.arange(len(phrases)), np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[own, j]
            lo, hi = (self.less[c] + x for x in self.rank(c, lo, hi))
            alive = lo < hi
            own, lo, hi = own[alive], lo[alive], hi[alive]
        size = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        return np.repeat(own, size), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one. Every stretch's first symbol is sampled, so no walk meets a separator."""
        out, back, todo, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(todo):
            here = self.sampled[at]
            out[todo[here]] = self.where[at[here]] + back
            todo, at, back = todo[~here], at[~here], back + 1
            if len(todo):
                c = self.symbol(at)
                at = self.less[c] + self.rank(c, at)[0]
        return out


class Phrases:
    """The distinct test phrases of a block of items, by length, and the items of each."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.sigma = len(self.vocabulary) + 1
        self.groups = []
        for size in sorted({len(x) for x in found}):
            own = [x for x in found if len(x) == size]
            self.groups.append((size, np.array(own, np.int64), [sorted(found[x]) for x in own]))
        self.shortest = min((g[0] for g in self.groups), default=1)

    def reduced(self, ids: np.ndarray) -> np.ndarray:
        """Indices of the words that stay: those in stretches of known words that are long enough, and the unknown word (or end) after each."""
        known = np.concatenate([[0], (ids != 0).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(known))
        begin, end = edge[::2], edge[1::2]
        keep = end - begin >= self.shortest
        mark = np.zeros(len(ids) + 2, np.int32)
        np.add.at(mark, begin[keep], 1)
        np.add.at(mark, end[keep] + 1, -1)
        return np.flatnonzero(np.cumsum(mark[: len(ids)]) > 0)

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
        """(length, items by phrase, phrase number, word index) for the words of a shard, which ends with a 0."""
        stay = self.reduced(ids)
        if not len(stay):
            return
        index = FmIndex(ids[stay], self.sigma)
        for size, phrases, items in self.groups:
            own, at = index.search(phrases)
            yield size, items, own, stay[at]


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The columns of `keep` and the struct `hits` of every document: n_words, n_hit, items (sorted ids), spans (code points to remove, merged) and the same as words.

    A column called hits isn't kept. Null and empty texts have no words; texts of any length are taken whole. Repeated
    rows come out alike, items with the same phrase are both found, and empty tables give no rows or no hits.
    """
    keep = tuple(c for c in keep if c != "hits")
    blocks = _blocks(benchmark, item_col)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        return _found(docs, block, window, keep, text_col)
    # further blocks: one pass each, its hits stored by their text's hash; the driver and the workers hold one block at a time
    hashes = [F.xxhash64(F.col(f"`{text_col}`")).alias("h1"), F.xxhash64(F.lit(1), F.col(f"`{text_col}`")).alias("h2")]
    keyed, hits = docs.select(F.col(f"`{text_col}`"), *hashes), None
    while block is not None:
        own = _found(keyed, block, window, ("h1", "h2"), text_col).where("hits.n_hit > 0").dropDuplicates(["h1", "h2"])
        own = written(own, "hits")
        hits = own if hits is None else hits.unionAll(own)
        block, after = after, next(blocks, None)
    both = hits.groupBy("h1", "h2").agg(F.collect_list("hits").alias("l"))  # at most one a block
    flat = lambda name: F.flatten(F.transform("l", lambda x: x[name]))
    edges = F.array_sort(F.arrays_zip(flat("words").alias("w"), flat("spans").alias("s")))
    both = both.select("h1", "h2", F.array_sort(F.array_distinct(flat("items"))).alias("items"), _merged(edges).alias("m"))
    none, words = _found(docs.withColumn("_h1", hashes[0]).withColumn("_h2", hashes[1]), [], window, (*keep, "_h1", "_h2"), text_col), F.transform("m", lambda x: x["w"])
    out = none.join(both, (F.col("_h1") == both["h1"]) & (F.col("_h2") == both["h2"]), "left")
    n = F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]), F.lit(0).cast("long"))
    merged = F.struct(F.col("hits.n_words").alias("n_words"), n.alias("n_hit"), F.coalesce("items", F.col("hits.items")).alias("items"), F.coalesce(F.transform("m", lambda x: x["s"]), F.col("hits.spans")).alias("spans"), F.coalesce(words, F.col("hits.words")).alias("words"))
    return out.select(*[F.col(f"`{c}`") for c in keep], merged.alias("hits"))


def _blocks(benchmark: DataFrame, item_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_WORDS words (or one item), one held at a time."""
    block, size = [], 0
    for row in benchmark.select(item_col, F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        text = row[1].encode()
        n = len(words_of(text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += n
    if block:
        yield block


def _merged(edges):
    """Sorted (w, s) pairs of word and character spans, those that overlap or touch in words made one."""

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(F.struct(last["w"]["start"].alias("start"), F.greatest(last["w"]["end"], x["w"]["end"]).alias("end")).alias("w"), F.struct(last["s"]["start"].alias("start"), F.greatest(last["s"]["end"], x["s"]["end"]).alias("end")).alias("s"))
        same = (F.size(acc) > 0) & (x["w"]["start"] <= F.get(acc, F.size(acc) - 1)["w"]["end"])
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    span = "struct<start:bigint,end:bigint>"
    return F.aggregate(edges, F.array().cast(f"array<struct<w:{span},s:{span}>>"), add)


def _found(docs: DataFrame, block: list[tuple], window: int, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """find() for one block of items."""
    held = [docs.sparkSession.sparkContext.broadcast(Phrases(block, window))]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    fields = [pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", pa.list_(pa.int64())), pa.field("spans", pa.list_(span)), pa.field("words", pa.list_(span))]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("hits struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<start:bigint,end:bigint>>,words:array<struct<start:bigint,end:bigint>>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, data, words = [], [], []

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in words], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 after each document
            mark = np.zeros(int(first[-1]) + 1, np.int32)
            items: list[set] = [set() for _ in words]
            for block in held:
                phrases = block.value
                ids = np.zeros(int(first[-1]), np.int64)
                for k, own in enumerate(words):
                    ids[first[k] : first[k] + len(own)] = np.fromiter(map(phrases.vocabulary.get, own, repeat(0)), np.int64, len(own))
                for length, owners, phrase, at in phrases.occurrences(ids):
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + length, -1)
                    pairs = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, phrase]), axis=1)
                    for doc, p in pairs.T.tolist():
                        items[doc].update(owners[p])
            hit = np.cumsum(mark[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[first[1:]] - total[first[:-1]]
            spans, stretches = [], []
            for k in range(len(words)):
                own, stretch = [], []
                if n_hit[k]:
                    at = [m.span() for m in WORD.finditer(data[k].decode("utf-8", "replace"))]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[k] : first[k] + sizes[k]].astype(np.int8), [0]])))
                    own = [{"start": at[b][0], "end": at[e - 1][1]} for b, e in zip(edge[::2], edge[1::2], strict=True)]
                    stretch = [{"start": b, "end": e} for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                spans.append(own)
                stretches.append(stretch)
            hits = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((sizes, n_hit.astype(np.int64), [sorted(x) for x in items], spans, stretches), fields, strict=True)], fields=fields)
            kept = [pa.concat_arrays(c) for c in zip(*names, strict=True)]
            return pa.RecordBatch.from_arrays([*kept, hits], names=[*keep, "hits"])

        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = texts(batch, 0)
            names.append(batch.columns[1:])
            data += own
            words += map(words_of, own)
            seen += sum(map(len, words[-len(own) :]))
            if seen >= SHARD_WORDS:
                yield shard()
                names, data, words, seen = [], [], [], 0
        if names:
            yield shard()

    return mapped(docs.select(F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in keep]), run, schema)


def contaminated():
    """At least one word in twenty is hit."""
    return (F.col("hits")["n_hit"] > 0) & (20 * F.col("hits")["n_hit"] >= F.col("hits")["n_words"])


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("hits.items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))
