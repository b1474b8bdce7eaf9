"""Language models as injected table functions (L01-L05, L08, L11): only a mock ships.

A client factory goes to the tasks; each task makes one client. Answers are checked against the source text before
they count, and a failed call gives a row with a status, not a lost paper.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions.text import grounded, json_from_prose


class CallError(Exception):
    """A call that may succeed when tried again."""


class FatalCallError(Exception):
    """A call that won't."""


class MockClient:
    """A handler's answers."""

    def __init__(self, handler: Callable[[str], str]):
        self.handler = handler

    def complete(self, prompt: str) -> str:
        return self.handler(prompt)


class MeteredClient:
    """A handler's answers with what they used: handler(prompt) gives (answer, {"prompt_tokens": n, "completion_tokens": n})."""

    def __init__(self, handler: Callable[[str], tuple[str, dict]]):
        self.handler, self.usage = handler, {}

    def complete(self, prompt: str) -> str:
        self.usage = {}
        answer, self.usage = self.handler(prompt)
        return answer


def complete(client, prompt: str, tries: int = 4, pause: float = 0.0) -> tuple[str | None, str]:
    """(answer, status) after retries with doubling pauses."""
    for k in range(tries):
        try:
            return client.complete(prompt), "ok"
        except FatalCallError:
            return None, "call_error"
        except CallError:
            if k + 1 < tries:
                time.sleep(pause * 2**k)
    return None, "call_error"


def call(prompts: DataFrame, factory: Callable[[], object], *, prompt_col: str = "prompt", tries: int = 4) -> DataFrame:
    """Add `answer` and `status` to each row; the rest of the row stays."""
    schema = StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("status", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for f in frames:
            got = [complete(client, p, tries) for p in f[prompt_col]]
            yield f.assign(answer=[a for a, _ in got], status=[s for _, s in got])

    return prompts.mapInPandas(run, schema)


def prompts(papers: DataFrame, operators: dict[str, str], *, text_col: str = "text") -> DataFrame:
    """A row for each paper and operator (a short fixed list) with its prompt."""
    each = F.array(*[F.struct(F.lit(n).alias("operator"), F.lit(g).alias("guide")) for n, g in operators.items()])
    own = papers.select("*", F.inline(each))
    return own.withColumn("prompt", F.concat_ws("\n\n", F.concat(F.lit("# "), "operator"), "guide", F.col(text_col))).drop("guide")


def grounded_values(answers: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Parse answers of the form {"value": ..., "quote": ...}; values whose quote isn't in the text are dropped, and say so."""
    own = answers.withColumn("_j", json_from_prose(F.col("answer")))
    own = own.withColumn("value", F.get_json_object("_j", "$.value")).withColumn("quote", F.get_json_object("_j", "$.quote"))
    good = grounded(F.col("quote"), F.col(text_col))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("_j").isNull(), "bad_json").when(~good, "ungrounded").otherwise("ok")
    return own.withColumn("status", status).withColumn("value", F.when(F.col("status") == "ok", F.col("value"))).drop("_j")


def triage(papers: DataFrame, factory: Callable[[], object]) -> DataFrame:
    """A tier A, B or C for each paper; anything else is unclassified."""
    done = call(prompts(papers, {"triage": 'Answer {"value": "A|B|C", "quote": "..."}.'}), factory)
    tier = F.upper(F.trim(F.get_json_object(json_from_prose(F.col("answer")), "$.value")))
    return done.withColumn("tier", F.when(tier.isin("A", "B", "C"), tier).otherwise("unclassified")).drop("prompt", "answer", "operator")
