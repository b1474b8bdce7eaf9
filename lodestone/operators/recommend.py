"""Recommendations (L07): ranked passages joined to the variables that may be changed, and a model's candidates held to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import json_from_prose

CANDIDATES = "struct<candidates:array<struct<name:string,changes:array<struct<variable:string,change:string,rationale:string,cited_paper_ids:array<string>>>>>>"


def evidence_pack(passages: DataFrame, k: int = 12) -> DataFrame:
    """The best k passages (goal, paper_id, snippet, score) of each goal as (goal, index from 1, ...); ties by paper_id.

    The limit is by rank, so each task keeps only its own best k of a goal before anything is exchanged.
    """
    rank = F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("score"), "paper_id"))
    return passages.withColumn("index", rank).where(F.col("index") <= k)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}-]+"), F.lit(0)))


def support(pack: DataFrame, variables: DataFrame) -> DataFrame:
    """(goal, variable, paper_id, score, terms): the passages of the pack that have a variable's terms (variable, term)."""
    each = pack.select("goal", "paper_id", "score", F.explode(tokens(F.col("snippet"))).alias("term"))
    return each.join(variables, "term").groupBy("goal", "variable", "paper_id").agg(F.first("score").alias("score"), F.sort_array(F.collect_set("term")).alias("terms"))


def proposals(pack: DataFrame, variables: DataFrame, *, n_candidates: int = 3, most_changes: int = 4) -> DataFrame:
    """Candidates from the evidence alone: (goal, candidate, change, variable, citations, weight).

    A goal's variables rank by the score of the passages that speak for them (ties by name), and are dealt to the
    candidates in turn, at most `most_changes` each; each change cites every paper that speaks for it.
    """
    ranked = support(pack, variables).groupBy("goal", "variable").agg(F.sum("score").alias("weight"), F.sort_array(F.collect_set("paper_id")).alias("citations"))
    rank = F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("weight"), "variable")) - 1
    own = ranked.withColumn("_r", rank).where(F.col("_r") < n_candidates * most_changes)
    return own.select("goal", (F.col("_r") % n_candidates + 1).alias("candidate"), (F.floor(F.col("_r") / n_candidates) + 1).alias("change"), "variable", "citations", "weight")


def prompts(goals: DataFrame, pack: DataFrame, variables: DataFrame, *, n_candidates: int = 3) -> DataFrame:
    """goal and prompt: the goal's text, the names that may be changed, and the numbered pack, as JSON after one line of instructions."""
    items = pack.groupBy("goal").agg(F.sort_array(F.collect_list(F.struct("index", "paper_id", "snippet"))).alias("evidence"))
    names = variables.agg(F.sort_array(F.collect_set("variable")).alias("variables"))  # a curated list
    body = F.to_json(F.struct("objective", "variables", F.lit(n_candidates).alias("n_candidates"), F.coalesce("evidence", F.array().cast("array<struct<index:int,paper_id:string,snippet:string>>")).alias("evidence")))
    ask = "Propose candidates as JSON {candidates: [{name, changes: [{variable, change, rationale, cited_paper_ids}]}]}; change only the variables, cite only the evidence."
    return goals.join(items, "goal", "left").join(F.broadcast(names.withColumn("_1", F.lit(1))), F.lit(1) == F.col("_1")).select("goal", F.concat(F.lit(ask + "\n"), body).alias("prompt"))


def changes(answers: DataFrame, pack: DataFrame, variables: DataFrame, *, n_candidates: int = 3, most_changes: int = 4) -> DataFrame:
    """The answers' changes: (goal, candidate, change, variable, text, rationale, citations, unresolved, flag, support).

    Citations are the cited papers that the goal's pack has, `unresolved` the others. A change beyond the bounds is
    flagged too_many, one of another variable not_actionable, one without a citation left uncited; flagged changes are
    unsupported and say so in their rationale, the others are unchecked until a verifier has seen them. A failed call or
    an answer that can't be read gives no rows.
    """
    said = F.from_json(json_from_prose(F.col("answer")), CANDIDATES)
    own = answers.where("status = 'ok'").select("goal", F.posexplode(said["candidates"]).alias("_c", "_v")).select("goal", (F.col("_c") + 1).alias("candidate"), F.posexplode("_v.changes").alias("_k", "_x"))
    own = own.select("goal", "candidate", (F.col("_k") + 1).alias("change"), F.col("_x.variable").alias("variable"), F.coalesce("_x.change", F.lit("")).alias("text"), F.coalesce("_x.rationale", F.lit("")).alias("rationale"), F.coalesce("_x.cited_paper_ids", F.array().cast("array<string>")).alias("_cited"))
    packs = pack.groupBy("goal").agg(F.collect_set(F.col("paper_id").cast("string")).alias("_pack"))  # at most k a goal
    known = variables.select("variable").distinct().withColumn("_ok", F.lit(True))
    own = own.join(packs, "goal", "left").join(known, "variable", "left").withColumn("_pack", F.coalesce("_pack", F.array().cast("array<string>")))
    cited, lost = F.sort_array(F.array_intersect("_cited", "_pack")), F.sort_array(F.array_except("_cited", "_pack"))
    flag = F.when((F.col("candidate") > n_candidates) | (F.col("change") > most_changes), "too_many").when(F.col("_ok").isNull(), "not_actionable").when(F.size(cited) == 0, "uncited")
    noted = F.when(flag.isNotNull(), F.trim(F.concat(F.col("rationale"), F.lit(" [FLAGGED: "), flag, F.lit("]")))).otherwise(F.col("rationale"))
    return own.select("goal", "candidate", "change", "variable", "text", noted.alias("rationale"), cited.alias("citations"), lost.alias("unresolved"), flag.alias("flag"), F.when(flag.isNotNull(), "unsupported").otherwise("unchecked").alias("support"))
