from __future__ import annotations

import random

from lodestone.operators.ranks import ranked


def test_ranks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), k) for k in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, n long").repartition(7)
    want = {r: k for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    for _ in range(2):
        assert {(r[0], r[1]): r[2] for r in ranked(df.repartition(5, "n"), ["s", "n"], "k").collect()} == want
    assert ranked(df.limit(0), ["s", "n"], "k").collect() == []
    doubled = sorted(r[1] for r in ranked(df.select("s"), ["s"], "k").collect())
    assert doubled == list(range(500))
