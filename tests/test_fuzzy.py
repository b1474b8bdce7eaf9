"""The fuzzy join finds what comparing all pairs finds."""

from __future__ import annotations

import random

import pytest

from lodestone.operators import fuzzy, normalize


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, e in enumerate(b, 1):
            row[j], before = (before + 1 if c == e else max(row[j], row[j - 1])), row[j]
    return row[-1]


def made(seed, n):
    rnd = random.Random(seed)
    stem = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 7))) for _ in range(25)]
    out = []
    for _ in range(n):
        words = [rnd.choice(stem) for _ in range(rnd.choice([1, 1, 2, 2, 3, 4, 6]))]
        if rnd.random() < 0.2:
            words.append(words[0])
        out.append(" ".join(words))
    return sorted(set(out)), rnd


def changed(text, rnd):
    for _ in range(rnd.choice([0, 1, 1, 2])):
        k = rnd.randrange(len(text))
        text = rnd.choice([text[:k] + text[k + 1 :], text[:k] + "x" + text[k:], text[:k] + "y" + text[k + 1 :]]).strip() or "z"
    words = text.split()
    if rnd.random() < 0.3:
        rnd.shuffle(words)
    return " ".join(words)


def test_common_length():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        assert fuzzy.common_length(a, b) == plain_common(a, b)


@pytest.mark.parametrize(("seed", "threshold"), [(2, 0.9), (3, 0.93), (4, 0.95), (5, 0.97), (6, 1.0)])
def test_every_pair_is_found(spark, seed, threshold):
    surfaces, rnd = made(seed, 150)
    names = sorted({changed(rnd.choice(surfaces), rnd) for _ in range(300)} | {"a " * 40, "", "a"})
    order = {s: rnd.randrange(4) for s in surfaces}
    want = {}
    for n in {" ".join(x.split()) for x in names} - {""}:
        found = [(-fuzzy.weighted_ratio(n, s), order[s], s) for s in surfaces]
        score, _, s = min(found)
        if -score >= threshold - 1e-12:
            want[n] = (s, -score)
    got = fuzzy.best_surfaces(spark.createDataFrame([(n,) for n in [*names, None]], "n string"), "n", spark.createDataFrame([*order.items(), (None, 0), (" ", 1)], "s string, o int"), "s", order="o", threshold=threshold)
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want
    assert len(want) > 20


def test_a_lower_threshold_is_refused(spark):
    df = spark.createDataFrame([("a",)], "n string")
    with pytest.raises(ValueError):
        fuzzy.best_surfaces(df, "n", df, "n", threshold=0.8)


def test_names_are_looked_up_then_compared_then_stripped(spark):
    held = normalize.ontology(spark, [{"canonical": "Transferrin", "category": "protein", "aliases": ["holo transferrin"]}, {"canonical": "FGF2", "category": "growth factor", "aliases": ["basic FGF"]}])
    names = ["Transferrin", "transferin", "transferrin holo", "basic  fgf", "FGF2 (immobilised)", "glucose", "", None]
    got = {r["n"]: (r["canonical"], r["matched_via"], round(r["score"], 3)) for r in normalize.canonicalize(spark.createDataFrame([(n,) for n in names], "n string"), "n", held, fuzzy=0.9).collect()}
    assert got["Transferrin"] == ("Transferrin", "exact", 1.0)
    assert got["transferin"] == ("Transferrin", "fuzzy", 0.952)
    assert got["transferrin holo"] == ("Transferrin", "fuzzy", 0.95)
    assert got["basic  fgf"] == ("FGF2", "fuzzy", 1.0)
    assert got["FGF2 (immobilised)"] == ("FGF2", "fuzzy", 0.9)
    assert got["glucose"] == ("glucose", "none", 0.0)
    assert got[""][1:] == got[None][1:] == ("none", 0.0)
