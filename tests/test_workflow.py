"""The observation loop, the extraction passes and the review packet on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone import catalog, cli
from lodestone.functions.text import json_from_prose
from lodestone.operators import workflow as W

SEEN = "x array<double>, objectives array<double>"


def test_ask_is_space_filling_until_enough_is_observed(spark):
    pool = spark.createDataFrame([(k, [k / 9, 1 - k / 9]) for k in range(10)], "id long, x array<double>")
    few = spark.createDataFrame([([0.1, 0.2], [1.0, 2.0])] * 2, SEEN)
    got = W.ask(few, pool, ["max", "min"], 4).collect()
    assert [r.slot for r in got] == [0, 1, 2, 3] and {r.source for r in got} == {"space-filling"}
    for d in range(2):
        assert sorted(int(r.x[d] * 4) for r in got) == [0, 1, 2, 3]  # one point in each quarter


def test_ask_weighs_the_pool_and_the_ideas(spark):
    pool = spark.createDataFrame([(k, [k / 20], 0.0) for k in range(10)], "id long, x array<double>, prior double")
    ideas = spark.createDataFrame([("near", [0.95], "cited", 0.0)], "id string, x array<double>, rationale string, prior double")
    seen = spark.createDataFrame([([v], [v]) for v in (0.0, 0.2, 0.4, 0.6)], SEEN)  # the larger x, the better
    best = W.ask(seen, pool, ["max"], 1, ideas=ideas).first()
    assert (best.source, best.id, best.rationale, best.x) == ("llm", "near", "cited", [0.95])
    worst = W.ask(seen, pool, ["min"], 3, ideas=ideas).collect()
    assert len({(r.source, r.id) for r in worst}) == 3 and worst[0].x[0] < 0.5
    # a strong prior against everything but one candidate decides
    against = spark.createDataFrame([(k, [k / 10], 500.0 * (k == 8)) for k in range(10)], "id long, x array<double>, prior double")
    assert W.ask(seen, against, ["max"], 1, ideas=ideas, beta=5.0).first().id == "8"


def test_observations_are_appended(spark, tmp_path):
    for k in range(3):
        W.tell(spark.createDataFrame([([float(k)], [1.0])], SEEN), f"{tmp_path}/seen")
    assert sorted(r.x[0] for r in spark.read.parquet(f"{tmp_path}/seen").collect()) == [0.0, 1.0, 2.0]


def test_too_many_observations_are_refused(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_OBSERVED", 2)
    seen = spark.createDataFrame([([0.1], [1.0])] * 3, SEEN)
    with pytest.raises(ValueError):
        W.ask(seen, spark.createDataFrame([(1, [0.5])], "id long, x array<double>"), ["min"], 1)


def test_text_parts_stand_in_for_missing_markup(spark):
    docs = spark.createDataFrame([(1, "intro\nmore\n\n# M\na\n\nb"), (2, "x"), (3, None), (4, "")], "id long, text string")
    got = W.text_parts(docs, "id", "text", "^# ").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, None, 0, 10), (1, 1, "# M", 16, 17), (1, 1, "# M", 19, 20), (2, 0, None, 0, 1)]
    parts = spark.createDataFrame([(1, 0, "T", 0, 5)], W.text_parts(docs, "id", "text", "^# ").schema)
    both = W.parts_or_text(parts, docs, "id", "text", "^# ").collect()
    assert sorted((r.id, r.title or "") for r in both) == [(1, "T"), (2, "")]


def test_blocks_without_answers_keep_the_bibliography(spark):
    papers = spark.createDataFrame([(1, "t", "Title"), (2, " ", "Other"), (3, None, None)], "paper_id long, text string, title string")
    prompts = W.block_prompts(papers, {"A": "who"})
    assert sorted((r.paper_id, r["pass"], len(r.blocks)) for r in prompts.collect()) == [(1, 0, 5), (1, 1, 8)]
    answers = prompts.selectExpr("paper_id", "blocks", "'no json' as answer", "'ok' as status")
    got = {r.paper_id: (r.block, r.value) for r in W.block_values(answers, papers, ["title"]).collect()}
    assert got == {1: ("A", {"paper_id": "1", "title": "Title"}), 2: ("A", {"paper_id": "2", "title": "Other"}), 3: ("A", {"paper_id": "3"})}


def test_a_repeated_verdict_is_none(spark):
    batches = W.request_batches(spark.createDataFrame([(k, "t") for k in range(12)], "n long, t string"), "n", F.col("t"))
    answers = batches.selectExpr("*", """'[{"number": 0, "relevant": true}, {"number": 1, "relevant": true}, {"number": 1, "relevant": false}, {"number": 11, "relevant": true}]' as answer""")
    got = {r.number: r.relevant for r in W.screened(answers).collect()}
    assert got == {k: {0: True, 11: True}.get(k) for k in range(12)}


def test_json_in_prose_is_one_value(spark):
    cases = {
        'Here: [{"a": 1}, {"a": 2}] done': '[{"a": 1}, {"a": 2}]',
        '```json\nnope\n``` then ```\n{"b": 1}\n```': '{"b": 1}',
        ' {"c": {"d": []}} ': '{"c": {"d": []}}',
        'so {"e": 1} it is': '{"e": 1}',
        '{"f": 1} {"g": 2}': None,
        "no json": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", json_from_prose(F.col("t")).alias("j"))
    assert {r.t: r.j for r in rows.collect()} == cases | {None: None}


def test_verbs_run_registered_queries():
    assert {name for names in cli.VERBS.values() for name in names} <= set(catalog.QUERIES)
