"""Joins, sets, windows and merges that the evidence workflow is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import jaccard


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key. The minimum is combined before the shuffle, so a hot key meets in no task."""
    every = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key.alias("_key")).agg(F.min_by(every, F.struct(*order)).alias("_row")).select("_row.*")


def acquisition_partition(queue: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each queue row (row, doi, title) with one reason: corpus_doi, corpus_title, queue_title_with_doi, conflict or actionable.

    corpus: doi, title ("NONE" is no DOI). Titles and DOIs are compared as given; empty is missing.
    """
    doi = F.nullif(F.nullif(F.col("doi"), F.lit("")), F.lit("NONE"))
    by_doi = corpus.select(doi.alias("doi")).where("doi is not null").distinct().withColumn("_in_doi", F.lit(True))
    by_title = corpus.where("title <> ''").groupBy("title").agg(F.min(doi).alias("_t_doi"), F.max(doi).alias("_t_doi2"), F.lit(True).alias("_in_title"))
    peers = queue.where("title <> '' and doi is not null and doi <> ''").groupBy("title").agg(F.lit(True).alias("_peer"))
    own = queue.withColumn("doi", F.nullif(F.col("doi"), F.lit("")))
    own = own.join(by_doi, "doi", "left").join(by_title, "title", "left").join(peers, "title", "left")
    no_doi = F.col("doi").isNull()
    reason = (
        F.when(F.col("_in_doi"), "corpus_doi")
        .when(no_doi & F.col("_in_title"), "corpus_title")
        .when(no_doi & F.col("_peer"), "queue_title_with_doi")
        .when(~no_doi & F.col("_in_title") & ((F.col("_t_doi") != F.col("doi")) | (F.col("_t_doi2") != F.col("doi"))), "conflict")
        .otherwise("actionable")
    )
    return own.select("row", F.coalesce("doi", F.lit("")).alias("doi"), "title", reason.alias("reason"))


def best_title_match(left: DataFrame, right: DataFrame, *, least: float = 0.40) -> DataFrame:
    """For each left row (id, tokens, doi) the best right row (id, tokens, doi, ord) by token Jaccard, plus 2 for an equal DOI; ties to the first.

    Equal token sets are one title: titles are joined once, then rows. Candidates share a token of a prefix by rarity
    (a pair of at least `least` must), or a DOI; there is no cross product.
    """
    title = lambda df: df.withColumn("title", F.array_sort(F.array_distinct("tokens")))
    left, right = title(left), title(right)
    lt, rt = (x.select("title").where(F.size("title") > 0).distinct() for x in (left, right))
    rare = lt.unionAll(rt).select(F.explode("title").alias("t")).groupBy("t").agg(F.count("*").alias("f"))

    def prefixes(titles: DataFrame, name: str) -> DataFrame:
        """The rarest tokens of each title, so many that any partner must have one of them among its own."""
        each = titles.select("title", F.explode("title").alias("t")).join(rare, "t").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
        own = F.slice("o", 1, (F.size("o") - F.ceil(F.lit(least) * F.size("o")) + 1).cast("int"))
        return each.select(F.col("title").alias(name), F.explode(own).alias("e")).select(name, "e.t")

    near = prefixes(lt, "lt").join(prefixes(rt, "rt"), "t").select("lt", "rt").distinct()
    near = near.withColumn("score", jaccard(F.col("lt"), F.col("rt"))).where(F.col("score") >= least)
    # of the rows of one title without its DOI, only the first can win
    ahead = right.groupBy(F.col("title").alias("rt")).agg(F.min_by(F.struct("id", "ord"), "ord").alias("r"))
    by_title = left.select(F.col("id").alias("l_id"), F.col("title").alias("lt")).join(near, "lt").join(ahead, "rt").select("l_id", F.col("r.id").alias("r_id"), F.col("r.ord").alias("ord"), "score")
    of = lambda df, side: df.where("doi <> ''").select(F.col("id").alias(f"{side}_id"), "doi", F.col("title").alias(f"{side}t"), *(["ord"] if side == "r" else []))
    by_doi = of(left, "l").join(of(right, "r"), "doi").select("l_id", "r_id", "ord", (jaccard(F.col("lt"), F.col("rt")) + 2.0).alias("score"))
    best = by_title.unionByName(by_doi).groupBy("l_id").agg(F.max_by(F.struct("r_id", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b"))
    return best.select("l_id", "b.r_id", "b.score")


def covers(cells: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Headers (h_id, h_row, h_col, h_span) above a cell (row, col) whose columns they span, within equal keys, if there are any.

    A header stands once for each column that it spans, so cells and headers meet by column.
    """
    spanned = headers.where("h_span > 0").withColumn("col", F.explode(F.sequence(F.col("h_col"), F.col("h_col") + F.col("h_span") - 1)))
    return cells.join(spanned, [*keys, "col"]).where("h_row < row")


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of either side with the names of failed checks; none when consistent."""
    a = left.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = right.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checks = [F.when(F.col("_a").isNull(), "missing_left"), F.when(F.col("_b").isNull(), "missing_right"), *[F.when(there & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f"differs_{f}") for f in fields]]
    return both.select(key, F.array_join(F.filter(F.array(*checks), lambda x: x.isNotNull()), ";").alias("failed"))


def merge_disjoint(*frames: DataFrame, key: str) -> DataFrame:
    """The union, equal rows once, and whether a key has rows that differ."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    whole = whole.distinct()
    conflict = whole.groupBy(key).agg((F.count("*") > 1).alias("conflict"))
    return whole.join(conflict, key)


def upsert(base: DataFrame, delta: DataFrame, key: str, *, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """The delta's rows over the base's by key; columns of keep_old keep their old value where the new one is null."""
    cols = [c for c in base.columns if c != key]
    b = base.select(key, *[F.col(c).alias(f"b_{c}") for c in cols])
    d = delta.select(key, *[F.col(c).alias(f"d_{c}") for c in cols], F.lit(True).alias("_new"))
    both = b.join(d, key, "full")
    pick = lambda c: F.coalesce(f"d_{c}", f"b_{c}") if c in keep_old else F.when(F.col("_new"), F.col(f"d_{c}")).otherwise(F.col(f"b_{c}"))
    return both.select(key, *[pick(c).alias(c) for c in cols])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits groups before and after the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def hash_sample(df: DataFrame, group: list[str], key: Column, n: int) -> DataFrame:
    """N rows of each group in the order of their keys' SHA-256: repeatable, unrelated to any value."""
    return top_per_group(df.withColumn("_h", F.sha2(key.cast("string"), 256)), group, [F.col("_h")], n, "_r").drop("_h", "_r")


def round_robin(df: DataFrame, category: str, order: list[Column], n: int) -> DataFrame:
    """N rows taken from the categories in turn, categories by name."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    # only the first n of a category can be taken: the window is limited before rows meet
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", category).limit(n)


def numbered(df: DataFrame, order: list[Column], form: str, name: str) -> DataFrame:
    """Ids in a total order. The rank needs one order over all rows: meant for selections, not for tables."""
    return df.withColumn(name, F.format_string(form, F.row_number().over(Window.orderBy(*order))))


def islands(df: DataFrame, group: str, n: str) -> DataFrame:
    """Runs of consecutive numbers as (group, lo, hi)."""
    own = df.select(group, n).distinct().withColumn("_i", F.col(n) - F.row_number().over(Window.partitionBy(group).orderBy(n)))
    return own.groupBy(group, "_i").agg(F.min(n).alias("lo"), F.max(n).alias("hi")).drop("_i")


def unanimous(df: DataFrame, item: str, run: str, runs: int) -> DataFrame:
    """Items that every run selected."""
    return df.groupBy(item).agg(F.countDistinct(run).alias("c")).where(F.col("c") == runs).select(item)


def expand_ids(df: DataFrame, col: str) -> DataFrame:
    """P18: "H001-H014" as one row for each id; a single id stays."""
    lo, hi = F.regexp_extract(col, r"^([A-Z]+)(\d+)-[A-Z]+(\d+)$", 2), F.regexp_extract(col, r"^([A-Z]+)(\d+)-[A-Z]+(\d+)$", 3)
    ids = F.transform(F.sequence(lo.try_cast("int"), hi.try_cast("int")), lambda i: F.concat(F.regexp_extract(col, r"^([A-Z]+)", 1), F.lpad(i.cast("string"), 3, "0")))
    return df.withColumn("id", F.explode(F.when(F.col(col).rlike(r"^[A-Z]+\d+-[A-Z]+\d+$"), ids).otherwise(F.array(F.col(col)))))
