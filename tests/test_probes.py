"""Probes: no request twice, budgets, strict answers, usage; manifests: every change is named."""

from __future__ import annotations

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import manifests as M
from lodestone.operators import probes as P
from lodestone.operators.model_calls import MeteredClient

PROMPT = lambda items: F.to_json(F.struct(F.col("repeat"), items.alias("items")))


def metered(folder, dies_at=None):
    """A client that notes each call in a folder of its own, and dies with its task at the given batches the first time."""

    def make():
        def reply(prompt):
            asked = json.loads(prompt)
            name = f"{asked['repeat']}-{asked['items'][0]['id']}"
            if dies_at and asked["items"][0]["id"] in dies_at and not os.path.exists(f"{folder}/died-{name}"):
                open(f"{folder}/died-{name}", "w").close()
                raise RuntimeError("the worker is lost")
            with open(f"{folder}/calls", "a") as f:
                f.write(name + "\n")
            return json.dumps({"candidate_ids": [x["id"] for x in asked["items"] if x.get("text") == "yes"]}), {"prompt_tokens": 10, "completion_tokens": 1}

        return MeteredClient(reply)

    return make


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(f"i{k:03d}", ["yes", "no", None][k % 3], k % 3 == 0) for k in range(40)], "item_id string, snippet string, positive boolean").repartition(3)


def wanted(items, **kw):
    return P.requests(items, **{"size": 4, "repeats": 2, "prompt": PROMPT, "model": "mock", "version": "1"} | kw)


def test_a_killed_probe_goes_on_where_it_was(spark, items, tmp_path):
    at, calls = f"file://{tmp_path}/log", tmp_path / "calls"
    own, budget = wanted(items), P.Budget(20, 20 * 11, 600, 11, wave=6)
    with pytest.raises(Exception, match="lost"):
        P.run(own, metered(str(tmp_path), {"i008", "i024"}), at, budget, tasks=2)
    first = P.log(spark, at).count()
    assert 0 < first < 20
    P.compact(spark, at)
    assert P.log(spark, at).count() == first
    with pytest.raises(Exception, match="lost"):
        P.run(own, metered(str(tmp_path), {"i008", "i024"}), at, budget, tasks=2)
    seen = P.run(own, metered(str(tmp_path)), at, budget, tasks=2)
    made = Counter(calls.read_text().split())
    assert len(made) == 20 and set(made.values()) == {1}, "each request was made once over all runs"
    assert seen["logged"] == 20 and seen["logged_tokens"] == 220
    assert P.run(own, metered(str(tmp_path)), at, budget)["calls"] == 0
    again = P.measured(P.answers(P.log(spark, at)), items, 2).first()
    assert (again["items"], again["positives"], again["recalls"], again["precisions"], again["consistency"], again["passed"]) == (40, 14, [1.0, 1.0], [1.0, 1.0], 1.0, True)
    assert {r[0] for r in P.unanimous(P.answers(P.log(spark, at)), 2).collect()} == {f"i{k:03d}" for k in range(0, 40, 3)}


def test_answers_of_a_lost_task_are_observed_as_the_log_has_them(spark, items, tmp_path):
    """A task that comes again finds its first answers in the log; the totals are the log's all the same."""
    at, own = f"file://{tmp_path}/log", wanted(items)
    with pytest.raises(Exception, match="lost"):
        P.run(own, metered(str(tmp_path), {"i036"}), at, P.Budget(20, 220, 600, 11), tasks=1)
    before = P.log(spark, at).count()
    # what a retry of the same task sees: all requests of its part, of which some are done
    P._objects(at)
    rows = [r.asDict() for r in own.collect()]
    import pandas as pd

    got = list(P._asked(at, metered(str(tmp_path)), 1e18, 1)(iter([pd.DataFrame(rows)])))[0]
    assert len(got) == 20 and (got.source == "log").sum() == before and int(got.prompt_tokens.sum() + got.completion_tokens.sum()) == 220
    equal = P.reconcile({"requests": len(got), "tokens": 220}, P.log(spark, at)).collect()
    assert all(r["equal"] for r in equal) and len(equal) == 2
    assert not P.reconcile({"requests": 20, "tokens": 219}, P.log(spark, at)).where("measure = 'tokens'").first()["equal"]


def test_budgets_hold(spark, items, tmp_path):
    own, client = wanted(items), metered(str(tmp_path))
    with pytest.raises(P.BudgetExceeded):
        P.run(own, client, f"file://{tmp_path}/a", P.Budget(19, 10_000, 600, 11))
    with pytest.raises(P.BudgetExceeded):
        P.run(own, client, f"file://{tmp_path}/b", P.Budget(20, 219, 600, 11))
    with pytest.raises(P.BudgetExceeded):
        P.run(own, client, f"file://{tmp_path}/c", P.Budget(20, 220, 0, 11))
    assert not (tmp_path / "calls").exists()
    # a client that uses more than it may: the run stops before the budget could be passed again
    with pytest.raises(P.BudgetExceeded):
        P.run(own, client, f"file://{tmp_path}/d", P.Budget(20, 100, 600, 5, wave=4))
    assert len((tmp_path / "calls").read_text().split()) * 11 <= 100 + 4 * (11 - 5)


def test_a_wave_reads_neither_the_log_nor_other_waves(spark, items, tmp_path, monkeypatch):
    """The log is read as often for many waves as for one, and keeps no object of a wave that is done."""
    reads, plain = [], P.log
    monkeypatch.setattr(P, "log", lambda *a: reads.append(1) or plain(*a))
    counts = []
    for wave in (20, 3):
        at, before = f"file://{tmp_path}/log{wave}", len(reads)
        seen = P.run(wanted(items), metered(str(tmp_path)), at, P.Budget(20, 220, 600, 11, wave=wave), tasks=2)
        counts.append(len(reads) - before)
        assert seen == {"requests": 20, "calls": 20, "tokens": 220, "logged": 20, "logged_tokens": 220}
        assert os.listdir(f"{tmp_path}/log{wave}/done") == [] and plain(spark, at).count() == 20
    assert counts[0] == counts[1]


def test_a_wave_is_one_job(spark, items, tmp_path, monkeypatch):
    """Nineteen more waves are nineteen more jobs, and no table is planned, exchanged or written for one of them alone."""
    jobs, own = [], wanted(items)
    for wave in (20, 1):
        spark.sparkContext.setJobGroup(f"wave{wave}", "a probe")
        P.run(own, metered(str(tmp_path)), f"file://{tmp_path}/log{wave}", P.Budget(20, 220, 600, 11, wave=wave), tasks=2)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"wave{wave}")))
    spark.sparkContext.setJobGroup("other", "")
    assert 0 <= jobs[1] - jobs[0] <= 19 + 4
    # legs of four and three requests: all answers are in the table, each once, and a budget that ends within a leg keeps what was done
    monkeypatch.setattr(P, "LEG", 4)
    for wave in (2, 3, 7):
        at = f"file://{tmp_path}/leg{wave}"
        with pytest.raises(P.BudgetExceeded):
            P.run(own, metered(str(tmp_path)), at, P.Budget(20, 130, 600, 6, wave=wave), tasks=2)
        first = P.log(spark, at).count()
        assert 130 - 6 <= first * 11 <= 130 + wave * (11 - 6) and os.listdir(f"{tmp_path}/leg{wave}/done") == []
        seen = P.run(own, metered(str(tmp_path)), at, P.Budget(20, 1000, 600, 11, wave=wave), tasks=2)
        assert seen == {"requests": 20 - first, "calls": 20 - first, "tokens": 11 * (20 - first), "logged": 20, "logged_tokens": 220}
        assert os.listdir(f"{tmp_path}/leg{wave}/done") == [] and spark.read.parquet(f"{at}/table").count() == 20


def test_changed_input_is_another_probe(spark, items):
    name = lambda df, **kw: wanted(df, **kw).first()["input_hash"]
    base = name(items)
    assert name(items.orderBy(F.desc("item_id")).repartition(7)) == base
    assert len({base, name(items, model="other"), name(items, version="2"), name(items, repeats=3), name(items.withColumn("snippet", F.lit("yes"))), name(items.where("item_id <> 'i001'")), name(items.unionAll(items.limit(1)))}) == 7


def test_strict_answers(spark):
    cases = {
        '{"candidate_ids": ["a"]}': (None, ["a"]), '{"candidate_ids": []}': (None, []), "prose": ("invalid_json", []), '["a"]': ("not_only_candidate_ids", []), '{"candidate_ids": ["a"], "x": 1}': ("not_only_candidate_ids", []),
        '{"candidate_ids": "a"}': ("not_a_string_list", []), '{"candidate_ids": [1]}': ("not_a_string_list", []), '{"candidate_ids": ["a", 1]}': ("not_a_string_list", []), '{"candidate_ids": ["a", null]}': ("not_a_string_list", []),
        '{"candidate_ids": ["a", "a"]}': ("duplicates", []), '{"candidate_ids": ["z"]}': ("unexpected_ids", []), '{"other": ["a"]}': ("not_only_candidate_ids", []), None: ("invalid_json", []), '{"candidate_ids": null}': ("not_a_string_list", []),
    }
    rows = [("h", 1, k, ["a", "b"], a, "ok", 0, 0, 0.0) for k, a in enumerate(cases)] + [("h", 1, 99, ["a"], None, "call_error", 0, 0, 0.0)]
    got = {r["batch"]: (r["issue"], list(r["selected"])) for r in P.answers(spark.createDataFrame(rows, P.RECORD)).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[99] == ("call_error", [])


@pytest.fixture
def pool(spark):
    pages = spark.createDataFrame([(f"r{k % 3}", k, f"page {k}", k % 4 == 0) for k in range(60)] + [("r9", 1, "", True), ("r9", 2, "x", False), ("r8", 1, "x", False)], "record_id string, page long, excerpt string, positive boolean")
    return M.page_pool(pages)


def test_pools(pool):
    rows = pool.collect()
    assert {(r["record_id"], r["fault"]) for r in rows} == {("r0", None), ("r1", None), ("r2", None), ("r9", "positive_page_without_excerpt")}
    assert Counter((r["record_id"], r["positive"]) for r in rows) == Counter({(f"r{k}", p): 5 for k in range(3) for p in (True, False)} | {("r9", False): 1})


def test_held_out_pages(spark):
    every = list(M.HELD_OUT_SIGNALS)
    rows = [("a", 1, every[:3]), ("a", 1, every[3:]), ("a", 2, every[1:]), ("a", 3, [])]
    assert {(r[1], r[2]) for r in M.held_out_pages(spark.createDataFrame(rows, "record_id string, page int, signals array<string>")).collect()} == {(1, True), (2, False), (3, False)}


def test_every_change_of_a_manifest_is_named(spark, pool):
    pool = pool.where("record_id <> 'r9'").cache()
    chosen = pool.where("positive").select("item_id")
    header, rows = M.manifest(pool, chosen, stable=True, recall=0.96)
    header, rows = header.cache(), rows.cache()
    faults = lambda h=header, c=rows, p=pool, e=chosen, t=None: {tuple(r) for r in M.faults(h, c, p, e, t).collect()}
    assert faults() == set()
    assert faults(c=rows.repartition(5)) == set(), "the order of the rows in storage doesn't matter"
    ids = sorted(r[0] for r in rows.select("item_id").collect())
    swapped = rows.withColumn("position", F.when(F.col("item_id") == ids[2], 8).when(F.col("item_id") == ids[7], 3).otherwise(F.col("position")))
    assert faults(c=swapped) == {("reordered", ids[2], "8"), ("reordered", ids[7], "3"), ("candidates_hash", None, None)}
    doubled = rows.unionAll(rows.where(F.col("item_id") == ids[-1]))
    assert faults(c=doubled) >= {("duplicate", ids[-1], "2"), ("selected_count", None, None), ("candidates_hash", None, None)}
    changed = rows.withColumn("block", F.when(F.col("item_id") == ids[0], 5).otherwise(F.col("block")))
    assert faults(c=changed) == {("tampered", ids[0], "block"), ("candidates_hash", None, None)}
    assert faults(c=rows.where(F.col("item_id") != ids[-1])) == {("missing", ids[-1], None), ("selected_count", None, None), ("candidates_hash", None, None)}
    assert ("unexpected", ids[1], None) in faults(e=chosen.where(F.col("item_id") != ids[1]))
    assert {x for x in faults(p=pool.where(~F.col("item_id").isin(ids[3])))} >= {("unknown", ids[3], None), ("input_count", None, None), ("pool_hash", None, None)}
    assert {x[0] for x in faults(t=spark.createDataFrame([("r1",)], "record_id string"))} == {"overlap"}


def test_failed_gates_give_no_candidates(spark, pool):
    for kw, status in (({"stable": False}, "failed_unstable_no_output"), ({"stable": True, "recall": 0.9}, "failed_held_out_recall_no_output")):
        header, rows = M.manifest(pool, pool.select("item_id"), **kw)
        assert rows.count() == 0 and header.first()["status"] == status
        assert ("output_of_failed_gate", None, None) in {tuple(r) for r in M.faults(header, M.manifest(pool, pool.select("item_id"), stable=True)[1], pool).collect()}
