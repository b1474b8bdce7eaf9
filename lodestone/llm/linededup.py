"""Line dedup by a deletion-neighbourhood join, by DataFrame functions alone.

Lines are compared by their words in lower case. A line of at least MIN_WORDS words is dropped if an equal line
comes earlier in the corpus; one of at least NEAR_WORDS words also if an earlier line is within one edit, where an edit
inserts, deletes or replaces one word. "Earlier" is by id, then line number; whether the earlier line is itself dropped
doesn't matter, so the result doesn't depend on any order of work.

For the edits, each line emits its deletion neighbourhood as hashed keys: itself, and itself without each word. Lines
with an equal variant are joined to the key's earliest line, and the edit distance is verified. Lines that share no
half (first or last words) with another line have no such partner and emit nothing. The keys' minima are combined
before they are shuffled, so a variant that very many lines share meets in no task; no pairs within a key are made.

Null texts stay null. Lines of fewer words, and lines without any, are kept. Repeated rows have equal ids and line
numbers, none is earlier, and all are treated alike; an empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, written

MIN_WORDS, NEAR_WORDS = 5, 8
#: Words of 64 bits in a table that tells which rows are worth a shuffle; wrong hits are joined away.
TABLE_LONGS = 1 << 19


def _slot(*key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(*key, F.lit("slot"))
    return F.pmod(h, F.lit(TABLE_LONGS)).cast("int"), F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int")


def _table(keys: DataFrame, *key: str) -> DataFrame:
    """One row: an array of TABLE_LONGS numbers with a bit for each key. Its size is fixed."""
    slot, bit = _slot(*map(F.col, key))
    rows = keys.select(slot.alias("s"), F.expr("1L").alias("one"), bit.alias("b")).groupBy("s").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("w"))
    every = keys.sparkSession.range(0, TABLE_LONGS, 1, 8).select(F.col("id").cast("int").alias("s"), F.lit(0).cast("long").alias("w"))
    full = rows.unionByName(every).groupBy("s").agg(F.bit_or("w").alias("w"))
    return written(full.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "w"))), lambda x: x["w"]).alias("t")), "bits")


def _may_have(df: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    slot, bit = _slot(*map(F.col, key))
    return df.where(F.getbit(F.get(table.scalar(), slot), bit) == 1)


def words_of(line: Column) -> Column:
    """The words of a line in lower case; a line without any has one empty word."""
    text = F.btrim(F.lower(line), F.lit(" \t\n\x0b\x0c\r"))
    # a split by one plain character needs no pattern, which would be compiled again for each line
    return F.when(line.rlike(r"[\x09-\x0D]|\x20\x20"), F.split(text, r"[\x20\x09-\x0D]+")).otherwise(F.split(text, " "))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("line", "t"))


def _half(short: Column) -> Column:
    """How many words a half has, for a pair whose shorter line has so many."""
    return F.floor((short - 1) / 2).cast("int")


def _half_keys() -> Column:
    """(side, key) of a line's first (0) and last (1) words, as the shorter (or equal) and as the longer line of a pair."""
    keys = []
    for short in (F.size("w"), F.size("w") - 1):
        h = _half(short)
        keys += [F.xxhash64(short, F.lit(0), F.slice("w", 1, h)), F.xxhash64(short, F.lit(1), F.slice("w", F.size("w") - h + 1, h))]
    return F.when(F.size("w") >= NEAR_WORDS, F.array(*keys))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, kind, at): kind "f" is the line, "d" the line without a word, "s" that at the word's place.

    A pair that shares its first half differs after it, one that shares its last half before it: words of a half that
    is only shared are not left out.
    """
    h = _half(F.size("w") - 1)
    each = lines.select("at", "w", F.explode(F.concat(F.array(F.lit(0)), F.sequence(F.when(F.col("last"), 1).otherwise(h + 1), F.when(F.col("first"), F.size("w")).otherwise(F.size("w") - h)))).alias("i"))
    # the hash of two arrays is that of all their words in turn, so they needn't be put together
    shorter = F.when(F.col("i") == 0, F.xxhash64("w")).otherwise(F.xxhash64(F.slice("w", 1, F.col("i") - 1), F.slice("w", F.col("i") + 1, F.size("w"))))
    each = each.select("at", "i", shorter.alias("v"))
    kinds = F.when(F.col("i") == 0, F.array(F.struct(F.lit("f").alias("kind"), F.col("v").alias("key")))).otherwise(
        F.array(F.struct(F.lit("d").alias("kind"), F.col("v").alias("key")), F.struct(F.lit("s").alias("kind"), F.xxhash64("v", "i").alias("key")))
    )
    return each.select("at", F.inline(kinds))


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    differ = F.filter(F.sequence(F.lit(0), short), lambda i: (i == short) | (F.get(a, i) != F.get(b, i)))
    p = F.get(differ, F.lit(0))  # words in common at the start
    rest_equal = F.slice(a, p + 2, n) == F.slice(b, p + 2, m)
    longer_a = F.slice(a, p + 2, n) == F.slice(b, p + 1, m)
    longer_b = F.slice(a, p + 1, n) == F.slice(b, p + 2, m)
    return F.when(n == m, rest_equal).when(n == m + 1, longer_a).when(n + 1 == m, longer_b).otherwise(False)


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line) of all lines that are dropped; line numbers count from 0."""
    at = F.struct("doc", "line").alias("at")
    own = _lines(docs, id_col, text_col).select("doc", "line", words_of(F.col("t")).alias("w"))
    long = F.size("w") >= MIN_WORDS
    stored = written(own.select(at, F.when(long, F.xxhash64("w")).alias("h"), F.when(long, F.hash("w")).alias("g"), _half_keys().alias("halves")), "lines")
    table = stored.where("h is not null")  # after the write: a filter before it would split every line twice
    often = table.groupBy("h", "g").agg(F.min("at").alias("lead"), F.max("at").alias("last")).where("lead < last").select("h", "g", "lead")
    often = written(often, "often")
    equal = table.select("h", "g", "at").join(often, ["h", "g"]).where("at > lead").select("at")

    # lines that share a half with another line, and which half
    halves = table.where("halves is not null").select("h", "g", "at", F.posexplode("halves").alias("side", "half"))
    shared = written(halves.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("half"), "halves")
    able = _may_have(halves, _table(shared, "half"), "half").join(shared, "half").groupBy("h", "g").agg(F.min("at").alias("at"), F.bool_or(F.col("side") % 2 == 0).alias("first"), F.bool_or(F.col("side") % 2 == 1).alias("last"))
    able = written(able.select("at.doc", "at.line", "first", "last"), "able")
    lines = _may_have(_lines(docs, id_col, text_col), _table(able, "doc", "line"), "doc", "line")
    lines = written(lines.join(able, ["doc", "line"]).select(at, words_of(F.col("t")).alias("w"), "first", "last"), "near")

    # the deletion neighbourhood: each key's earliest line, by kind
    variants = _variants(lines)
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    keys = variants.groupBy("key").agg(of("f").alias("f"), of("d").alias("d"), of("s").alias("s"), F.max(F.when(F.col("kind") == "s", F.col("at"))).alias("last"))
    keys = written(keys.where("s < last or (f is not null and d is not null)").select("key", "f", "d", "s"), "keys")
    found = _may_have(variants, _table(keys, "key"), "key").join(keys, "key")
    found = found.select("at", F.expr("CASE kind WHEN 'f' THEN d WHEN 'd' THEN f ELSE s END").alias("other")).where("other < at").distinct()
    pairs = found.join(lines, "at").select("at", "other", F.col("w").alias("x")).join(lines.select(F.col("at").alias("other"), F.col("w").alias("y")), "other")
    near = pairs.where(within_one(F.col("x"), F.col("y"))).select("at")
    dropped = written(equal.unionAll(near).distinct().select("at.doc", "at.line"), "dropped")
    free(stored, often, shared, able, lines, keys)
    return dropped


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "n_dropped_lines") -> DataFrame:
    """All rows of the input, their texts without the dropped lines, and how many lines were dropped.

    Columns keep their names, but for one called as `dropped_col`, whose place it takes. Texts of any length are taken
    whole. Of equal lines the one of the smallest id and then place stays; repeated rows lose the same lines.
    """
    dropped = dropped_lines(docs, id_col=id_col, text_col=text_col)
    by_doc = written(dropped.groupBy("doc").agg(F.collect_set("line").alias("lines")), "by_doc")  # bounded by a document's own lines
    free(dropped)
    held, columns = _table(by_doc, "doc"), docs.columns
    key, lines = _free(docs, "_d_key"), _free(docs, "_d_lines")
    own = docs.withColumn(key, F.col(f"`{id_col}`"))
    slot, bit = _slot(F.col(key))
    touched = F.coalesce(F.getbit(F.get(held.scalar(), slot), bit) == 1, F.lit(False))
    rest = own.where(~touched).withColumn(lines, F.lit(None).cast("array<int>"))
    some = own.where(touched).join(by_doc.select(F.col("doc").alias(key), F.col("lines").alias(lines)), key, "left").select(*[F.col(f"`{c}`") for c in rest.columns])
    parts = _free(docs, "_d_parts")
    done = rest.unionByName(some).withColumn(parts, F.when(F.col(lines).isNotNull(), F.split(F.col(f"`{text_col}`"), "\n")))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lines)))
    text = F.when(F.col(lines).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(left, lambda k: F.get(F.col(parts), k)), "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns if c != dropped_col]
    return done.select(*out, F.coalesce(F.when(F.col(lines).isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias(dropped_col))


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
