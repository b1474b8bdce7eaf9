"""Moved blocks, recommendations, fronts and hypervolumes on small fixtures."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import anchors, design, model_calls
from lodestone.operators import recommend as R


def test_blocks_are_found_again(spark):
    shape = "record_id string, page long, block long, text string"
    old = [("r", 1, 0, "alpha beta gamma delta"), ("r", 1, 1, "one two three four five six seven"), ("r", 1, 2, "moved text stands here now"), ("r", 1, 3, "gone without a trace at all"), ("r", 2, 0, "twin text of some length"), ("r", 2, 1, "split into two parts by the new layout of pages"),
           ("r", 2, 2, ""), ("r", 2, 3, None), ("r", 9, 9, "far away but only somewhat like it"), ("s", 1, 0, "moved text stands here now"), ("r", 2, 4, "same place other words kept")]
    new = [("r", 1, 0, "alpha  beta gamma\tdelta"), ("r", 1, 1, "one two three four five six eight"), ("r", 3, 5, "moved text stands here now"), ("r", 2, 7, "twin text of some length"), ("r", 2, 8, "filler"), ("r", 1, 7, "twin text of some length"), ("r", 3, 0, "split into two parts by"), ("r", 3, 1, "the new layout of pages"),
           ("r", 2, 2, " "), ("r", 4, 0, "far away but only somewhat like that"), ("r", 2, 4, "same place other words changed"), ("r", 2, 5, "same place other words altered")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(old)], "anchor_id long, " + shape)
    got = {r["anchor_id"]: (r["status"], r["page"], r["block"], r["span"]) for r in anchors.resolve(df, spark.createDataFrame(new, shape)).collect()}
    assert got == {
        0: ("unmoved", 1, 0, 1), 1: ("edited", 1, 1, 1), 2: ("moved", 3, 5, 1), 3: ("deleted", None, None, None), 4: ("moved", 2, 7, 1), 5: ("edited", 3, 0, 2), 6: ("unmoved", 2, 2, 1), 7: ("deleted", None, None, None),
        8: ("deleted", None, None, None), 9: ("deleted", None, None, None), 10: ("ambiguous", None, None, None),
    }


def test_two_places_as_near(spark):
    old = spark.createDataFrame([(1, "r", 2, 3, "twin text")], "anchor_id long, record_id string, page long, block long, text string")
    new = spark.createDataFrame([("r", 1, 3, "twin text"), ("r", 3, 3, "twin text")], "record_id string, page long, block long, text string")
    assert anchors.resolve(old, new).first()["status"] == "ambiguous"
    assert anchors.resolve(old, new.limit(0)).first()["status"] == "deleted"
    assert anchors.resolve(old.limit(0), new).collect() == []


def found_plainly(old, new, reach=2):
    """What resolve should say, each anchor against every window of its record."""
    grams = lambda t: {tuple(w[i : i + 3]) for w in [t.split()] for i in range(max(1, len(w) - 2))}
    out = {}
    for k, r, p, b, t in old:
        own = sorted(x[1:] for x in new if x[0] == r)
        same = sorted((abs(q - p), abs(c - b), q, c) for q, c, u in own if u == t)
        if same:
            tied = len(same) > 1 and same[0][:2] == same[1][:2]
            out[k] = ("unmoved", p, b, 1) if same[0][:2] == (0, 0) else ("ambiguous", None, None, None) if tied else ("moved", *same[0][2:], 1)
            continue
        spans = [(q, c, 1, u) for q, c, u in own] + [(q, c, 2, u + " " + v) for (q, c, u), (q2, _, v) in itertools.pairwise(own) if q == q2]
        scores = sorted((-2 * len(grams(t) & grams(u)) / (len(grams(t)) + len(grams(u))), n, q, c) for q, c, n, u in spans if abs(q - p) <= reach)
        if not scores or scores[0][0] > -0.5:
            out[k] = ("deleted", None, None, None)
            continue
        score, n, q, c = scores[0]
        second = min((s for s, m, q2, c2 in scores if q2 != q or c2 + m <= c or c + n <= c2), default=0)
        out[k] = ("edited", q, c, n) if second - score >= 0.1 - 1e-9 else ("ambiguous", None, None, None)
    return out


def test_blocks_of_many_pages(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice("ab") + str(rnd.randint(0, 2)) for _ in range(rnd.choice((1, 2, 3, 6, 9))))
    old = [(100 * p + 10 * b + r, f"r{r}", p, b, text()) for r in range(2) for p in range(-12, 45) for b in range(3)]
    new = []
    for _, r, p, b, t in old:
        w = t.split()
        change = rnd.randint(0, 6)
        if change == 1:
            new.append((r, p, b, " ".join([*w[:-1], "z"])))
        elif change == 2:
            new += [(r, p, b, " ".join(w[: len(w) // 2]) or "y"), (r, p, b + 3, " ".join(w[len(w) // 2 :]))]
        elif change:
            new.append((r, p + (change == 3) * rnd.randint(-3, 3), b + 10 * (change == 3), t))
    df = spark.createDataFrame(old, "anchor_id long, record_id string, page long, block long, text string")
    rows = anchors.resolve(df, spark.createDataFrame(new, "record_id string, page long, block long, text string")).collect()
    got = {r["anchor_id"]: (r["status"], r["page"], r["block"], r["span"]) for r in rows}
    assert len(rows) == len(old) and got == found_plainly(old, new)
    assert {x[0] for x in got.values()} == {"unmoved", "moved", "edited", "ambiguous", "deleted"}


def test_blocks_are_not_multiplied(spark):
    """Shingles of every window were exchanged for each page in reach: 32 times these texts."""
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sum(sc.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(False).size()))

    rnd = random.Random(8)
    old = [(k, f"r{k // 40}", k % 40 // 8, k % 8, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(40))) for k in range(2000)]
    new = [(*r[1:4], r[4] + " end") for r in old]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    was = shuffled()
    df = spark.createDataFrame(old, "anchor_id long, record_id string, page long, block long, text string")
    try:
        got = anchors.resolve(df, spark.createDataFrame(new, "record_id string, page long, block long, text string")).groupBy("status").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in got} == {("edited", 2000)}
    assert shuffled() - was < 4 * sum(len(r[4]) for r in old)


def test_recommendations(spark):
    passages = spark.createDataFrame([("g", f"p{k}", f"serum and glucose {k}" if k % 2 else "serum alone", float(k % 3)) for k in range(6)] + [("h", "q", "nothing", 1.0)], "goal string, paper_id string, snippet string, score double")
    variables = spark.createDataFrame([("serum", "serum"), ("sugar", "glucose"), ("sugar", "dextrose")], "variable string, term string")
    pack = R.evidence_pack(passages, 4)
    assert [(r[0], r[1]) for r in pack.where("goal = 'g'").orderBy("index").select("index", "paper_id").collect()] == [(1, "p2"), (2, "p5"), (3, "p1"), (4, "p4")]
    got = {tuple(r) for r in R.proposals(pack, variables, n_candidates=2, most_changes=1).select("goal", "candidate", "change", "variable", F.array_join("citations", ",")).collect()}
    assert got == {("g", 1, 1, "serum", "p1,p2,p4,p5"), ("g", 2, 1, "sugar", "p1,p5")}
    goals = spark.createDataFrame([("g", "grow"), ("h", "x"), ("none", "no evidence")], "goal string, objective string")
    asked = {r["goal"]: json.loads(r["prompt"].partition("\n")[2]) for r in R.prompts(goals, pack, variables).collect()}
    assert asked["g"]["variables"] == ["serum", "sugar"] and [e["paper_id"] for e in asked["g"]["evidence"]] == ["p2", "p5", "p1", "p4"] and asked["none"]["evidence"] == []

    def reply(prompt):
        if '"x"' in prompt:
            return "no JSON here"
        if "no evidence" in prompt:
            raise model_calls.FatalCallError
        return json.dumps({"candidates": [{"name": "a", "changes": [{"variable": "serum", "change": "less", "cited_paper_ids": ["p5", "p5", "zz"]}, {"variable": "serum"}, {"variable": None}]}]})

    answers = model_calls.call(R.prompts(goals, pack, variables), lambda: model_calls.MockClient(reply))
    rows = {r["change"]: r for r in R.changes(answers, pack, variables, most_changes=2).collect()}
    assert (rows[1]["citations"], rows[1]["unresolved"], rows[1]["flag"], rows[1]["support"], rows[1]["rationale"]) == (["p5"], ["zz"], None, "unchecked", "")
    assert [rows[k]["flag"] for k in (2, 3)] == ["uncited", "too_many"] and rows[3]["support"] == "unsupported" and len(rows) == 3


def brute_front(points):
    return [p for p in points if not any(all(a <= b for a, b in zip(q, p)) and q != p for q in points)]


def test_fronts_by_blocks(spark):
    rnd = random.Random(4)
    for dims, block in ((2, 20_000), (3, 20_000), (3, 7), (4, 5)):
        points = [tuple(float(rnd.randint(0, 9)) for _ in range(dims)) for _ in range(120)]
        points += points[:5]
        df = spark.createDataFrame([(*p, k) for k, p in enumerate(points)] + [(None,) * dims + (-1,)], ", ".join(f"c{k} double" for k in range(dims)) + ", n long").repartition(9)
        got = sorted(tuple(r)[:-1] for r in design.pareto(df, [f"c{k}" for k in range(dims)], block=block).collect())
        assert got == sorted(brute_front(points))
    assert design.pareto(df.limit(0), ["c0", "c1"]).collect() == []


def exact_volume(points, ref):
    axes = [sorted({p[k] for p in points} | {ref[k]}) for k in range(len(ref))]
    cells = itertools.product(*[list(itertools.pairwise(a)) for a in axes])
    return sum(np.prod([hi - lo for lo, hi in cell]) for cell in cells if any(all(p[k] <= cell[k][0] for k in range(len(ref))) for p in points))


def test_hypervolumes(spark):
    rnd = random.Random(5)
    for dims in (1, 2, 3, 4):
        points = [tuple(rnd.random() for _ in range(dims)) for _ in range(12)]
        ref = [1.1] * dims
        names = [f"c{k}" for k in range(dims)]
        df = spark.createDataFrame([*points, (2.0,) * dims], ", ".join(f"{n} double" for n in names))
        got = [design.hypervolume(df.repartition(n), names, ref).first() for n in (1, 5)]
        want = exact_volume(points, ref)
        assert got[0] == got[1], "the estimate doesn't depend on partitions"
        assert abs(got[0].hypervolume - want) <= max(got[0].error, 1e-3 * want)
        assert abs(design.hypervolume(df, names, ref, seed=9).first().hypervolume - want) <= max(got[0].error, 1e-3 * want)
    assert design.hypervolume(df.where("c0 > 1.5"), names, ref).first().hypervolume == 0.0
