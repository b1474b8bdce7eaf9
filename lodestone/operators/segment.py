"""Documents into sections, paragraphs and packed contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Quotes that are broadcast; more are joined.
BROADCAST_QUOTES = 20_000


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, t, start): lines with their character offsets, computed within the row."""
    split = F.split(F.col(text_col), "\n")
    starts = F.aggregate(split, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, t: F.struct((s["at"] + F.length(t) + 1).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    return docs.select(F.col(id_col), F.posexplode(F.arrays_zip(split.alias("t"), starts.alias("start"))).alias("line", "z")).select(id_col, "line", F.col("z.t").alias("t"), F.col("z.start").alias("start"))


def paragraphs(docs: DataFrame, id_col: str, text_col: str, least: int = 80) -> DataFrame:
    """Runs of lines between blank ones, of at least so many characters, as (id, n, start, end). Documents are apart, so windows stay small."""
    own = Window.partitionBy(id_col).orderBy("line")
    marked = lines(docs, id_col, text_col).withColumn("blank", F.trim("t") == "").withColumn("run", F.sum(F.col("blank").cast("int")).over(own))
    out = marked.where("not blank").groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("t")).alias("end"))
    out = out.where(F.col("end") - F.col("start") >= least)
    return out.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("start"))).drop("run")


def sections(docs: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """A section from each heading line to the next one, as (id, n, title, start, end)."""
    own = Window.partitionBy(id_col).orderBy("start")
    found = lines(docs, id_col, text_col).where(F.col("t").rlike(heading))
    size = docs.select(F.col(id_col), F.length(text_col).alias("size"))
    out = found.select(id_col, F.trim("t").alias("title"), "start", F.lead("start").over(own).alias("next"), F.row_number().over(own).alias("n")).join(size, id_col)
    return out.select(id_col, "n", "title", "start", F.coalesce("next", "size").alias("end"))


def pack_context(chunks: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Chunks in order until the budget of characters is used; the crossing one is cut, later ones are dropped."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = chunks.withColumn("_before", before).where(F.col("_before") < budget)
    cut = F.substr(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))
    packed = own.select(group, F.struct(F.col(order).alias("o"), cut.alias("t")).alias("s")).groupBy(group).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return packed.select(group, F.array_join(F.transform("s", lambda x: x["t"]), "").alias("context"), F.size("s").cast("long").alias("chunks"))


def passage_hits(docs: DataFrame, id_col: str, text_col: str, terms: list[str], context: int, most: int) -> DataFrame:
    """Passages around the lines that have a term, one for each bucket of so many characters, the first ones of a document."""
    found = lines(docs, id_col, text_col).withColumn("term", F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.col("t")), t)), F.lit(0))).where("term is not null")
    first = found.groupBy(id_col, F.floor(F.col("start") / context).alias("bucket")).agg(F.min(F.struct("start", "term")).alias("s")).select(id_col, "s.*")
    return first.withColumn("k", F.row_number().over(Window.partitionBy(id_col).orderBy("start"))).where(F.col("k") <= most)


def routed(title: Column, hints: list[str]) -> Column:
    """A section title has one of the hints."""
    return F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(title), F.lower(h)))


def grounded_quotes(quotes: DataFrame, docs: DataFrame, *, quote_id: str, quote: str, id_col: str, text_col: str, short: int = 12) -> DataFrame:
    """P04 for many quotes: (quote_id, id_col) of the texts that hold each quote, blanks collapsed, whatever the case.

    A quote's inner words are whole words of a text that holds it, so a quote and the texts with its longest inner word
    meet by that word, and only those are compared: one scan of the texts, and words that no quote needs are dropped
    where they are read (with more than BROADCAST_QUOTES quotes, a shuffle of words and a second scan). Quotes of one or two words have no inner word; they are compared with each text, `short` to an
    expression. Quotes under eight characters ground nothing. Ids of quotes and of texts are taken as rows have them.
    """
    plain = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    q = quotes.select(F.col(quote_id).alias("_q"), plain(F.col(quote)).alias("q")).where("length(q) >= 8").withColumn("w", F.split("q", " "))
    inner = F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 2))
    keyed = q.where(F.size("w") > 2).select("_q", "q", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"].alias("key"))
    own = docs.select(F.col(id_col).alias("_d"), plain(F.col(text_col)).alias("t"))
    words = lambda *cols: own.select(*cols, F.explode(F.array_distinct(F.split("t", " "))).alias("key"))
    if keyed.count() <= BROADCAST_QUOTES:
        found = words("_d", "t").join(F.broadcast(keyed), "key")
    else:  # words meet quotes without their texts, which are read again for the pairs
        found = words("_d").join(keyed, "key").select("_q", "q", "_d").distinct().join(own, "_d")
    found = found.where(F.contains("t", F.col("q"))).select("_q", "_d")
    few = q.where(F.size("w") <= 2).select("_q", "q").collect()  # curated quotes of one or two words
    for k in range(0, len(few), short):
        hits = F.filter(F.array(*[F.when(F.contains("t", F.lit(r["q"])), F.lit(r["_q"])) for r in few[k : k + short]]), lambda x: x.isNotNull())
        found = found.unionByName(own.select(F.explode(hits).alias("_q"), "_d"))
    return found.select(F.col("_q").alias(quote_id), F.col("_d").alias(id_col))
