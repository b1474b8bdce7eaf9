"""Extraction passes, review packets, checked proposals and the observation loop: operators that compose others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import json_from_prose
from lodestone.operators import audit, design, segment

#: The blocks of the two passes.
TRIAGE_BLOCKS = ("A", "B", "C", "J", "M")
FULL_BLOCKS = ("D", "E", "F", "G", "H", "I", "K", "L")
#: Observations are experiments; a surrogate is fitted on the driver in cubic time, and more than these are refused.
MOST_OBSERVED = 4000


def evidence_rows(extractions: DataFrame, map_col: str = "evidence") -> DataFrame:
    """A row for each entry of an evidence map (field -> struct with `location`), verified unless its location says UNVERIFIED."""
    own = extractions.select("paper_id", F.explode(map_col).alias("field_key", "_e"))
    return own.select("paper_id", "field_key", "_e.*", (~F.contains(F.coalesce("_e.location", F.lit("")), F.lit("UNVERIFIED"))).alias("verified"))


def text_parts(docs: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """Plain text as (id, section, title, start, end) rows: runs of lines between blank lines and headings, with their section's title.

    Section 0, before the first heading, has no title.
    """
    own = Window.partitionBy(id_col).orderBy("line")
    marked = segment.lines(docs, id_col, text_col).withColumn("h", F.col("t").rlike(heading)).withColumn("b", F.col("h") | (F.trim("t") == ""))
    placed = marked.withColumn("section", F.sum(F.col("h").cast("long")).over(own)).withColumn("run", F.sum(F.col("b").cast("long")).over(own))
    titled = placed.withColumn("title", F.last(F.when(F.col("h"), F.trim("t")), ignorenulls=True).over(own))
    out = titled.where("not b").groupBy(id_col, "section", "run").agg(F.first("title").alias("title"), F.min("start").alias("start"), F.max(F.col("start") + F.length("t")).alias("end"))
    return out.drop("run")


def parts_or_text(parts: DataFrame, docs: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """The parts (as text_parts gives them) read from markup, and those of the plain text for documents that have none."""
    rest = docs.join(parts.select(id_col).distinct(), id_col, "left_anti")
    return parts.unionByName(text_parts(rest, id_col, text_col, heading))


def section_hints(blocks: Column, hints: dict[str, list[str]]) -> Column:
    """The hints of an array of blocks, each once, in the blocks' order; a block's letter may be of either case."""
    known = F.create_map(*[x for k, v in hints.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.coalesce(F.try_element_at(known, F.upper(b)), F.array().cast("array<string>")))))


def block_prompts(papers: DataFrame, guides: dict[str, str], *, full: bool = True, text_col: str = "text") -> DataFrame:
    """A prompt for each paper with text and each of the two passes; a block that both ask for is asked for once."""
    passes = [TRIAGE_BLOCKS, tuple(b for b in FULL_BLOCKS if b not in TRIAGE_BLOCKS)][: 2 if full else 1]
    each = [F.struct(F.lit(k).alias("pass"), F.array(*map(F.lit, p)).alias("blocks"), F.lit("\n".join(f"{b}: {guides.get(b, '')}" for b in p)).alias("_guide")) for k, p in enumerate(passes)]
    own = papers.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select("*", F.inline(F.array(*each)))
    return own.withColumn("prompt", F.concat_ws("\n\n", "_guide", text_col)).drop("_guide")


def block_values(answers: DataFrame, refs: DataFrame, fields: list[str]) -> DataFrame:
    """(paper_id, block, value) of both passes' answers, as maps of text; only blocks that the pass asked for count.

    Block A's identity fields come from the bibliography (refs: paper_id and `fields`) where the answer lacks them, its
    paper_id always does; a paper whose passes failed, or that has no text, has block A alone.
    """
    said = F.from_json(json_from_prose(F.col("answer")), "map<string,string>")
    own = answers.where("status = 'ok'").select("paper_id", "blocks", F.explode(said).alias("block", "_v")).where("array_contains(blocks, block)")
    own = own.select("paper_id", "block", F.map_filter(F.from_json("_v", "map<string,string>"), lambda k, v: v.isNotNull()).alias("value"))
    known = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda k, v: v.isNotNull())
    a = refs.select("paper_id", known.alias("_known")).join(own.where("block = 'A'").select("paper_id", "value"), "paper_id", "left")
    said_a = F.map_filter(F.coalesce("value", F.create_map().cast("map<string,string>")), lambda k, v: k != "paper_id")
    lacking = F.map_filter("_known", lambda k, v: ~F.map_contains_key(said_a, k))
    a = a.select("paper_id", F.lit("A").alias("block"), F.map_concat(F.create_map(F.lit("paper_id"), F.col("paper_id").cast("string")), said_a, lacking).alias("value"))
    return a.unionByName(own.where("block <> 'A'"))


def request_batches(rows: DataFrame, number: str, item: Column, size: int = 10) -> DataFrame:
    """Rows numbered from 0 in batches of `size`, as (batch, items): arrays of at most `size` (number, item) in order."""
    one = F.struct(F.col(number).alias("number"), item.alias("item"))
    return rows.groupBy(F.floor(F.col(number) / size).alias("batch")).agg(F.array_sort(F.collect_list(one)).alias("items"))


def screened(answers: DataFrame) -> DataFrame:
    """Of answered batches (items, answer: a JSON list of {"number", "relevant"}) each row's verdict; null when its batch doesn't hold just one."""
    said = F.from_json(json_from_prose(F.col("answer")), "array<struct<number:long,relevant:boolean>>")
    one = answers.withColumn("_said", F.coalesce(said, F.array().cast("array<struct<number:long,relevant:boolean>>"))).select("batch", "_said", F.inline("items"))
    own = F.filter("_said", lambda s: s["number"] == F.col("number"))
    return one.select("batch", "number", "item", F.when(F.size(own) == 1, F.get(own, F.lit(0))["relevant"]).alias("relevant"))


def verified_changes(changes: DataFrame, checks: DataFrame) -> DataFrame:
    """Proposed changes (candidate, change, variable, rationale, support) after a verifier's checks (candidate, change, n, support, reason).

    A change's last check by n decides; support that isn't known counts as partial. What isn't fully supported says so in
    its rationale and gives a caveat; checks of no change are ignored, unchecked changes stay.
    """
    last = checks.groupBy("candidate", "change").agg(F.max_by(F.struct("support", "reason"), "n").alias("_c"))
    own = changes.join(last, ["candidate", "change"], "left")
    given = F.lower(F.trim("_c.support"))
    support = F.when(given.isin("supported", "partial", "unsupported"), given).otherwise("partial")
    reason = F.coalesce("_c.reason", F.lit(""))
    note = F.concat(F.lit("[VERIFIER: "), support, F.lit(" evidence support"), F.when(reason != "", F.concat(F.lit(" - "), reason)).otherwise(""), F.lit("]"))
    lowered = F.col("_c").isNotNull() & (support != "supported")
    rationale = F.when(lowered & ~F.contains("rationale", note), F.trim(F.concat_ws(" ", "rationale", note))).otherwise(F.col("rationale"))
    caveat = F.when(lowered, F.format_string("candidate %d, change %d (%s): %s", "candidate", "change", "variable", support))
    return own.select("candidate", "change", "variable", rationale.alias("rationale"), F.when(F.col("_c").isNotNull(), support).otherwise(F.col("support")).alias("support"), caveat.alias("caveat"))


def review_packet(tasks: DataFrame, matches: DataFrame, papers: DataFrame, *, k: int = 5) -> DataFrame:
    """For each task (review_id, record_id, terms) its paper (matches: record_id, paper_id; papers: paper_id, text) and best k lines.

    A line scores the terms that it has; hits are (start, score) by score, then place. Papers are joined by key to the
    tasks that need them, and lines without a term go before anything is exchanged.
    """
    own = tasks.join(matches.select("record_id", "paper_id"), "record_id", "left").join(papers.select("paper_id", "text"), "paper_id", "left")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    status = F.when(F.col("paper_id").isNull(), "missing_ingested_paper").when(empty, "missing_fulltext").otherwise("ready_for_human_review")
    heads = own.select("review_id", "record_id", "paper_id", status.alias("status"), F.when(~empty, F.sha2("text", 256)).alias("source_sha256"))
    lines = segment.lines(own.select(F.struct("review_id", "terms").alias("_task"), "text"), "_task", "text")
    score = F.size(F.filter("_task.terms", lambda t: F.contains(F.lower("t"), F.lower(t)))).cast("double")
    best = audit.rank_passages(lines.select("_task.review_id", "start", score.alias("score")), "review_id", k)
    hits = best.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("place", "start", "score"))).alias("h"))
    return heads.join(hits.select("review_id", F.transform("h", lambda h: F.struct(h["start"].alias("start"), h["score"].alias("score"))).alias("hits")), "review_id", "left")


def flat_row(df: DataFrame) -> DataFrame:
    """Every column as text: lists joined by semicolons, flags as yes and no, what is missing or empty as a dash."""

    def one(f) -> Column:
        x, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        text = F.array_join(x.cast("array<string>"), ";") if kind == "array" else F.when(x, "yes").when(~x, "no") if kind == "boolean" else x.cast("string")
        return F.coalesce(F.nullif(text, F.lit("")), F.lit("-")).alias(f.name)

    return df.select(*map(one, df.schema.fields))


def tell(observations: DataFrame, path: str) -> None:
    """Measured rows (x: array of numbers, objectives: array of numbers) are appended; nothing stored is rewritten."""
    observations.select("x", "objectives").write.mode("append").parquet(path)


def ask(observed: DataFrame, pool: DataFrame, directions: list[str], batch: int, *, ideas: DataFrame | None = None, beta: float = 0.0, seed: int = 0) -> DataFrame:
    """The next experiments (slot, source, id, x, and the ideas' rationale) after the observed ones (x, objectives).

    The pool has (id, x), and `prior`, the evidence's log prior, where beta > 0: its weight beta falls as observations
    come in. Ideas (id, x, rationale, and prior likewise) compete with the pool. With fewer observations than 2, or than
    the objectives and one, the batch is space-filling points of no id. `directions` says min or max for each objective.
    """
    spark = pool.sparkSession
    schema = "slot int, source string, id string, x array<double>, rationale string"
    rows = observed.select("x", "objectives").limit(MOST_OBSERVED + 1).collect()
    if len(rows) > MOST_OBSERVED:
        raise ValueError(f"more than {MOST_OBSERVED} observations")
    if len(rows) < max(2, len(directions) + 1):
        dims = len((rows[0] if rows else pool.select("x").first())["x"])
        points = audit.space_filling(spark, batch, dims, seed=seed)
        return points.select(F.col("i").cast("int").alias("slot"), F.lit("space-filling").alias("source"), F.lit(None).cast("string").alias("id"), F.array(*[f"x{d}" for d in range(dims)]).alias("x"), F.lit(None).cast("string").alias("rationale"))
    sign = np.array([-1.0 if d == "max" else 1.0 for d in directions])
    x, y = np.array([r.x for r in rows], float), np.array([r.objectives for r in rows], float) * sign
    cols = ["x", *(["prior"] if beta > 0 else [])]
    both = pool.select(F.lit("bo").alias("source"), F.col("id").cast("string").alias("id"), *cols, F.lit(None).cast("string").alias("rationale"))
    if ideas is not None:
        both = both.unionByName(ideas.select(F.lit("llm").alias("source"), F.col("id").cast("string").alias("id"), *cols, "rationale"))
    both = both.withColumn("_key", F.concat_ws(":", "source", "id"))
    chosen = design.propose((x, y), both, "x", "_key", batch, seed=seed + len(rows), prior="prior" if beta > 0 else None, weight=beta / (1.0 + len(rows)))
    found = {r["_key"]: r for r in both.where(F.col("_key").isin(*chosen)).collect()}  # the batch
    return spark.createDataFrame([(k, found[c].source, found[c].id, [float(v) for v in found[c].x], found[c].rationale) for k, c in enumerate(chosen)], schema)
