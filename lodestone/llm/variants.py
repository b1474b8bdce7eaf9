"""Spelling variant grouping: a vocabulary's words at distance one, and the form that each word varies.

Near words are found by a self-join of the vocabulary's trie with active-node sets: going down the trie, each node
carries the nodes within distance one of it; a child's set follows from its parent's, and where both a node and an
active node end words, the pair is emitted. The trie is partitioned by prefix. As an edit may lie in the prefix itself,
the words are dealt twice: of two words whose shorter one has m code points, the edit leaves the first m/2 of them or
the last m - m/2 alike, so the words meet under a common prefix in the trie of the words or in that of the reversed
words. A part of more than PART words is dealt again in the same way by what is not common yet, until parts are small or
one code point is left (then a part is bounded by the alphabet): no part grows with the vocabulary.

Null texts have no words; texts are taken whole at any length, words too. Null ids stand in the damage rule as the empty
string. Repeated rows count each; an empty table gives no rows. Of near words with the same count the smallest in
code-point order is the form. Only the named columns are read; further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, free, mapped, table_batch, whole, written

RUNS = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, DAMAGE, RATIO = 5, 3, 97, 2
#: Words of a part that is joined in one task.
PART = 4096
FORWARD, BACKWARD = 0, 1
#: A part: its least length, the half that was dealt, and what is common before and behind.
KEYS = ("m", "way", "a", "b", "before", "behind")


def runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: the runs of letters, in lower case for A-Z, one code point deleted where DAMAGE divides the crc32 of `<id>:<run>`."""
    found = whole(docs, id_col, text_col).select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(RUNS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")))
    damaged = found.select("run", h.alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    return damaged.select(F.when(F.col("h") % DAMAGE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words long and frequent enough."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def trie_pairs(middles: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places of distinct strings at distance one: depth first down their trie, each node with its active nodes."""
    children: list[dict] = [{}]
    ends = [-1]
    for k, middle in enumerate(middles):
        node = 0
        for c in middle:
            nxt = children[node].get(c)
            if nxt is None:
                nxt = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = nxt
        ends[node] = k
    # a node's active nodes at distance one; at distance zero there is itself alone
    stack = [(0, list(children[0].values()))]
    while stack:
        node, active = stack.pop()
        own = ends[node]
        if own >= 0:
            for v in active:
                if ends[v] > own:
                    yield own, ends[v]
        below = children[node]
        for c, child in below.items():
            near = {children[v][c] for v in active if c in children[v]}  # the same code point follows both
            near.update(v for x, v in below.items() if x != c)  # it was replaced
            near.add(node)  # it was deleted
            near.update(children[child].values())  # one more is inserted
            near.discard(child)
            stack.append((child, list(near)))


def _deal(rows: DataFrame) -> DataFrame:
    """Deal the words of each part by half of what is not common yet, forwards and backwards."""
    mid = F.col("m") - F.col("a") - F.col("b")
    half = (mid / 2).cast("int")
    way = F.explode(F.array(F.struct(F.lit(FORWARD).alias("way"), (F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.lit(BACKWARD).alias("way"), F.col("a").alias("a"), (F.col("b") + mid - half).alias("b"))))
    dealt = rows.select("word", "m", way.alias("w")).select("word", "m", "w.*")
    return dealt.withColumn("before", F.expr("left(word, a)")).withColumn("behind", F.expr("right(word, b)"))


def near_pairs(vocab: DataFrame, part: int = PART) -> DataFrame:
    """one and two: each pair of words at distance exactly one, once."""
    lengths = vocab.select("word", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows, ready, left = _deal(lengths), [], []
    while True:
        rows = written(rows, "parts")
        left.append(rows)
        open_ = (F.col("m") - F.col("a") - F.col("b")) > 1
        large = rows.where(open_).groupBy(*KEYS).count().where(F.col("count") > part).select(*KEYS)
        large = written(large, "large")
        left.append(large)
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, list(KEYS), "left_anti"))
        rows = _deal(rows.join(large, list(KEYS), "left_semi"))
    schema = pa.schema([("one", pa.string()), ("two", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [], []
            for way, a, b, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                middles = [w[a : len(w) - b] for w in words]
                for i, j in trie_pairs([x[::-1] for x in middles] if way == BACKWARD else middles):
                    one.append(min(words[i], words[j]))
                    two.append(max(words[i], words[j]))
            yield table_batch(schema, [one, two])

    found = [mapped(r.groupBy(*KEYS).agg(F.collect_list("word").alias("words")).where(F.size("words") > 1).select("way", "a", "b", "words"), join, "one string, two string", 1024) for r in ready]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.distinct()
    out._held = left
    return out


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, and its form with the form's n: the near word of the largest count, if that is `ratio` times the word's."""
    counts = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("one").alias("word"), F.col("two").alias("near")), F.struct(F.col("two").alias("word"), F.col("one").alias("near")))).alias("p")).select("p.*")
    best = both.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = -F.col("best.less") >= ratio * F.col("n")
    return vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(held, F.col("best.near")).alias("form"), F.when(held, -F.col("best.less")).alias("form_n"))


def roots(words: DataFrame) -> DataFrame:
    """Add root: where following forms ends. Counts at least double from form to form, so few doublings of the jumps reach every end."""
    step = written(words.where("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        jump = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(step.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
        free(step)
        step, moved = further.select("word", "root"), not further.where("moved").isEmpty()
        step._written = further._written
        if not moved:
            break
    return words.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts."""
    vocab = written(vocabulary(runs(docs, id_col=id_col, text_col=text_col)), "vocabulary")
    pairs = near_pairs(vocab)
    known = written(forms(vocab, pairs), "forms")
    free(vocab, *pairs._held)
    return roots(known).select("word", "form", "root", "n", "n_near", "form_n")
