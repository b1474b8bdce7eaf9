"""Bounded repeat probes of a model client: budgets, an append-only log of requests, strict answers, usage.

A probe asks for every batch of items `repeats` times. Each answer is stored in the log the moment it is there, one
small object a request under its own name, staged and then moved, so that a reader never sees half of one. A request
that the log holds is never made again: not by a rerun after a crash, nor by a retried task. Waves that are done
move into a table, some LEG requests at a time, so the log has few objects however long it grows; compact() does so with
what a crash left.

Budgets hold over all tasks together. Requests go out in waves; a wave has at most as many as the request budget has
left, and as the token budget could pay for if each used all it may. No request begins after the deadline. (Speculative
execution must be off: two attempts of a task at the same time could ask the same.)
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.model_calls import complete
from lodestone.operators.ranks import ranked
from lodestone.operators.scratch import free, run_and_clean, written
from lodestone.session import prepare

RECORD = "input_hash string, repeat int, batch long, item_ids array<string>, answer string, status string, prompt_tokens long, completion_tokens long, seconds double"
KEY = ["input_hash", "repeat", "batch"]
#: The gates of a probe.
LEAST_RECALL = LEAST_CONSISTENCY = 0.95
#: Answers move into the table once so many requests are done: a leg of waves.
LEG = 2048


class BudgetExceeded(RuntimeError):
    """A budget is used up; the log holds what was done, and a rerun goes on from there."""


@dataclass(frozen=True)
class Budget:
    requests: int
    tokens: int
    seconds: float
    request_tokens: int
    wave: int = 256


def content_hash(items: DataFrame, *cols: str) -> Column:
    """An aggregate: a hash of the rows as a multiset, whatever their order and partitions.

    Each row's SHA-256 gives four numbers; their sums and the number of rows are hashed again.
    """
    row = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"c{k}") for k, c in enumerate(cols)])), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256)


def batched(items: DataFrame, size: int, id_col: str = "item_id") -> DataFrame:
    """Add `batch`: runs of `size` items in the order of their ids."""
    return ranked(items, [id_col], "_rank").withColumn("batch", F.floor(F.col("_rank") / size)).drop("_rank")


def requests(items: DataFrame, *, size: int, repeats: int, prompt: Callable[[Column], Column], model: str, version: str, id_col: str = "item_id", text_col: str = "snippet") -> DataFrame:
    """One row a request: its key, item_ids and prompt. The hash covers the items' content, the settings, model and prompt version."""
    settings = f"{model}|{version}|{size}|{repeats}"
    name = items.agg(content_hash(items, id_col, text_col).alias("h")).first()["h"]
    own = F.sha2(F.concat(F.lit(settings + "|"), F.lit(name)), 256)
    lists = batched(items, size, id_col).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))).alias("items"))
    each = lists.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return each.select(own.alias("input_hash"), "repeat", "batch", F.col("items.id").alias("item_ids"), prompt(F.col("items")).alias("prompt"))


def _objects(at: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(at)


def _name(r) -> str:
    return f"{r['input_hash'][:16]}-r{r['repeat']}-b{r['batch']}.json"


def log(spark: SparkSession, at: str) -> DataFrame:
    """The log at a folder, each request once."""
    held = spark.createDataFrame([], RECORD)
    store, path = _objects(at)
    from pyarrow import fs

    for part, read in (("table", lambda p: spark.read.schema(RECORD).parquet(p)), ("done", lambda p: spark.read.schema(RECORD).json(p))):
        if store.get_file_info(f"{path}/{part}").type == fs.FileType.Directory:
            held = held.unionByName(read(f"{at}/{part}"))
    return held.dropDuplicates(KEY)


def compact(spark: SparkSession, at: str) -> None:
    """Move the log's objects into one table; a crash between the steps leaves some in both, which the log shows once."""
    from pyarrow import fs

    store, path = _objects(at)
    if store.get_file_info(f"{path}/done").type != fs.FileType.Directory:
        return
    names = [x.path for x in store.get_file_info(fs.FileSelector(f"{path}/done")) if x.base_name.endswith(".json")]
    if not names:
        return
    spark.read.schema(RECORD).json(f"{at}/done").write.mode("append").parquet(f"{at}/table")
    for x in names:
        store.delete_file(x)


def _answered(rows: Iterable[dict], at: str, factory: Callable[[], object], deadline: float, tries: int) -> Iterator[dict]:
    """A task's requests: each is looked up in the log, else made and stored before the next one; after the deadline none is made."""
    from pyarrow import fs

    store, path = _objects(at)
    client = factory()
    for r in rows:
        held = f"{path}/done/{_name(r)}"
        if store.get_file_info(held).type == fs.FileType.File:
            with store.open_input_stream(held) as s:
                yield json.loads(s.read()) | {"source": "log"}
            continue
        began = time.time()
        if began > deadline:
            continue
        answer, status = complete(client, r["prompt"], tries)
        used = getattr(client, "usage", None) or {}
        done = {k: r[k] for k in KEY} | {
            "item_ids": list(r["item_ids"]), "answer": answer, "status": status, "prompt_tokens": int(used.get("prompt_tokens", 0)),
            "completion_tokens": int(used.get("completion_tokens", 0)), "seconds": time.time() - began,
        }
        staged = f"{path}/staged/{_name(r)}.{time.time_ns()}"
        with store.open_output_stream(staged) as s:
            s.write(json.dumps(done).encode())
        store.move(staged, held)
        yield done | {"source": "call"}


def _asked(at: str, factory: Callable[[], object], deadline: float, tries: int):
    """The answers of frames of requests as frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(_answered(f.to_dict("records"), at, factory, deadline, tries), columns=[c.split()[0] for c in RECORD.split(", ")] + ["source"])

    return run


def _observed(at: str, factory: Callable[[], object], deadline: float, tries: int, begin: int, end: int):
    """What a task's part of a wave, the requests numbered from begin to end, came to: requests, calls and tokens."""

    def run(rows: Iterator[Row]) -> Iterator[tuple[int, int, int]]:
        own = (r.asDict() for r in rows if begin <= r["_w"] < end)
        for x in _answered(own, at, factory, deadline, tries):
            yield 1, int(x["source"] == "call"), x["prompt_tokens"] + x["completion_tokens"]

    return run


def run(wanted: DataFrame, factory: Callable[[], object], at: str, budget: Budget, *, tries: int = 1, tasks: int = 8) -> dict:
    """Make the requests that the log lacks, within the budget; what the waves' tasks observed, added up.

    Raises BudgetExceeded before a request would pass a budget. More requests than the budget has are refused at once.
    """
    spark = prepare(wanted.sparkSession)
    deadline = time.time() + budget.seconds
    store, path = _objects(at)
    for part in ("done", "staged"):
        store.create_dir(f"{path}/{part}", recursive=True)
    total = wanted.count()
    if total > budget.requests:
        raise BudgetExceeded(f"{total} requests, {budget.requests} allowed")
    if total * budget.request_tokens > budget.tokens:
        raise BudgetExceeded("the requests could use more tokens than allowed")
    compact(spark, at)  # what a run that ended early left
    seen = {"requests": 0, "calls": 0, "tokens": 0}
    totals = F.count("*").alias("n"), F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("tokens")
    own = log(spark, at).join(wanted.select(KEY), KEY, "left_semi")
    first = own.agg(*totals).first()
    done, tokens = first["n"], first["tokens"]
    if done >= total:
        return seen | {"logged": done, "logged_tokens": tokens}
    # what is left is numbered and written (repeats of a batch stand together, which zstd stores once), then exchanged once by wave and task: a wave is one job over its own partitions alone
    keys = written(ranked(wanted.select(KEY).join(own.select(KEY), KEY, "left_anti"), ["repeat", "batch"], "_w"))
    left = written(wanted.join(keys, KEY), compression="zstd")
    share, begin, n_left = min(tasks, budget.wave), 0, total - done
    try:
        place = F.floor(F.col("_w") / budget.wave) * share + F.col("_w") % share
        parts = left.repartitionById(-(-n_left // budget.wave) * share, place.cast("int")).rdd
        moved, whole = 0, True
        while begin < n_left and whole:
            k = begin // budget.wave
            room = int(min((k + 1) * budget.wave - begin, n_left - begin, budget.requests - done, (budget.tokens - tokens) // budget.request_tokens))
            if room <= 0 or time.time() > deadline:
                break
            asked = parts.mapPartitions(_observed(at, factory, deadline, tries, begin, begin + room))
            got = spark.sparkContext.runJob(asked, _added, range(k * share, (k + 1) * share))
            wave = dict(zip(seen, map(sum, zip(*got, strict=True)), strict=True))
            seen = {m: seen[m] + wave[m] for m in seen}
            done, tokens, begin, whole = done + wave["requests"], tokens + wave["tokens"], begin + room, wave["requests"] == room
            if begin - moved >= LEG:
                _moved(keys.where((F.col("_w") >= moved) & (F.col("_w") < begin)), at, tries)
                moved = begin
        if begin > moved:
            _moved(keys.where((F.col("_w") >= moved) & (F.col("_w") < begin)), at, tries)
        if begin < n_left or not whole:
            raise BudgetExceeded(f"{done} of {total} requests done, {tokens} tokens used")
    finally:
        free(keys, left)
    held = log(spark, at).join(wanted.select(KEY), KEY, "left_semi").agg(*totals).first()
    return seen | {"logged": held["n"], "logged_tokens": held["tokens"]}


def _added(counts: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A task's counts as one row."""
    total = [0, 0, 0]
    for x in counts:
        total = [a + b for a, b in zip(total, x, strict=True)]
    return [tuple(total)]


def _moved(asked: DataFrame, at: str, tries: int) -> None:
    """Move the answers of these requests from the log's objects into its table; objects go only once the table has all of them."""
    from pyarrow import fs

    store, path = _objects(at)
    watch = Observation()
    held = asked.select(KEY).repartition(8).mapInPandas(_asked(at, object, 0.0, tries), RECORD + ", source string").observe(watch, F.count("*").alias("n")).drop("source")
    run_and_clean(asked.sparkSession, lambda: held.write.mode("append").parquet(f"{at}/table"))
    stale = [f"{path}/done/{_name(r)}" for r in asked.select(KEY).collect()]  # these alone: a task of an earlier run may still store others
    for x in store.get_file_info(stale) if watch.get["n"] == len(stale) else ():
        if x.type == fs.FileType.File:
            store.delete_file(x.path)


def reconcile(observed: dict, held: DataFrame) -> DataFrame:
    """What the tasks observed against the log, one row a measure. Answers that a retried task took from the log count in both."""
    totals = held.agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("tokens"))
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.lit(observed[k]).cast("long").alias("observed"), F.col(k).cast("long").alias("logged")) for k in ("requests", "tokens")])
    return totals.select(F.inline(rows)).withColumn("equal", F.col("observed") == F.col("logged"))


def answers(held: DataFrame) -> DataFrame:
    """Add `issue` and `selected`: an answer is exactly {"candidate_ids": [strings]}, none twice, all of the batch."""
    v = F.try_parse_json("answer")
    kind = F.schema_of_variant(v)
    ids = F.try_variant_get(v, "$.candidate_ids", "array<string>")
    own = held.withColumn("_kind", kind).withColumn("_ids", ids)
    issue = (
        F.when(F.col("status") != "ok", "call_error").when(F.col("_kind").isNull(), "invalid_json").when(~F.col("_kind").rlike("^OBJECT<candidate_ids: [^,]*>$"), "not_only_candidate_ids")
        .when(~F.col("_kind").isin("OBJECT<candidate_ids: ARRAY<STRING>>", "OBJECT<candidate_ids: ARRAY<VOID>>") | F.exists("_ids", F.isnull), "not_a_string_list")
        .when(F.size(F.array_distinct("_ids")) < F.size("_ids"), "duplicates").when(F.size(F.array_except("_ids", "item_ids")) > 0, "unexpected_ids")
    )
    return own.withColumn("issue", issue).withColumn("selected", F.when(F.col("issue").isNull(), F.col("_ids")).otherwise(F.array().cast("array<string>"))).drop("_kind", "_ids")


def selections(judged: DataFrame) -> DataFrame:
    """item_id, repeat and selected (boolean) of every item that a request asked for."""
    return judged.select("repeat", F.explode("item_ids").alias("item_id"), F.col("selected").alias("_s")).select("item_id", "repeat", F.array_contains("_s", F.col("item_id")).alias("selected"))


def measured(judged: DataFrame, items: DataFrame, repeats: int, *, id_col: str = "item_id", positive: str = "positive") -> DataFrame:
    """One row: what the probe found, and whether it passes its gates."""
    chosen = selections(judged).groupBy("item_id").agg(F.sum(F.col("selected").cast("int")).alias("k"), *[F.max(F.when(F.col("repeat") == r, F.col("selected").cast("int"))).alias(f"r{r}") for r in range(1, repeats + 1)])
    own = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(positive).alias("p")).join(chosen, "item_id", "left").fillna(0)
    p = F.col("p").cast("int")
    recall = F.array(*[F.round(F.sum(p * F.col(f"r{r}")) / F.sum(p), 4) for r in range(1, repeats + 1)])
    precision = F.array(*[F.when(F.sum(f"r{r}") > 0, F.round(F.sum(p * F.col(f"r{r}")) / F.sum(f"r{r}"), 4)).otherwise(0.0) for r in range(1, repeats + 1)])
    per_item = own.agg(
        F.count("*").alias("items"), F.sum(p).alias("positives"), recall.alias("recalls"), precision.alias("precisions"), F.round(F.avg(F.col("k").isin(0, repeats).cast("int")), 4).alias("consistency"),
        F.sum((F.col("p") & (F.col("k") < repeats)).cast("long")).alias("false_negatives"), F.sum((~F.col("p") & (F.col("k") > 0)).cast("long")).alias("false_positives"),
    )
    asked = judged.agg(F.count("*").alias("requests"), F.sum(F.col("issue").isNull().cast("long")).alias("valid"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    passed = (F.col("valid") == F.col("requests")) & (F.array_min("recalls") >= LEAST_RECALL) & (F.col("consistency") >= LEAST_CONSISTENCY)
    return per_item.withColumn("_1", F.lit(1)).join(asked.withColumn("_1", F.lit(1)), "_1").drop("_1").withColumn("passed", F.coalesce(passed, F.lit(False)))


def unanimous(judged: DataFrame, repeats: int) -> DataFrame:
    """item_id of the items that every repeat selected."""
    return selections(judged).where("selected").groupBy("item_id").agg(F.countDistinct("repeat").alias("k")).where(F.col("k") == repeats).select("item_id")
