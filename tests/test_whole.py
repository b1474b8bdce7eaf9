"""Queries over whole tables against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import re
from functools import reduce
from operator import add

from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.operators import pointers
from tests.oracle import compare


def test_titles_of_all_parts(spark, tmp_path):
    spark.createDataFrame([(k, "red widget" if k % 2 else "odd thing") for k in range(1, 90)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "PERU"), (1, "CHINA")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = catalog.QUERIES["j05_title_match"](spark, str(tmp_path)).collect()
    assert sorted((r.l_id, r.r_id, round(r.score, 4)) for r in got) == [(k, 0, 0.6667) for k in range(1, 90, 2)]


def test_quotes_of_all_items(spark, tmp_path):
    items = [(k, f"The quote of item number{k}x") for k in range(30)]
    docs = [(k, f"before  the QUOTE of\nitem number{k % 20}x after") for k in range(45)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(*d, "en", "s", len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalog.QUERIES["p04_grounding"](spark, str(tmp_path)).collect()))
    assert got == {k: 3 if k < 5 else 2 for k in range(20)}


def test_failures_of_all_events(spark, tmp_path):
    rows = [(1, 40, "error"), (1, 41, "click"), (2, 43, "error"), (2, 44, "error"), (3, 45, "view")]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert dict(map(tuple, catalog.QUERIES["p19_all_failed"](spark, str(tmp_path)).collect())) == {1: False, 2: True, 3: False}


def test_best_pages_and_slugs_of_whole_texts(spark, tmp_path):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    texts = {i: " ".join([f"p{name(i)}q{name(k)}" for k in range(400)]) for i in range(1, 5)}
    texts[5] = " ".join(texts[3].split()[200:212])  # a caption whose words stand far down a long page
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: set(re.findall("[a-z]+", t)) for i, t in texts.items()}
    caption = sorted(words[5])[:10]
    scores = sorted(((len(set(caption) & w) / 10, -i) for i, w in words.items()), reverse=True)
    got = catalog.QUERIES["j14_best_page"](spark, str(tmp_path)).collect()
    clear = scores[0][0] - scores[1][0] >= 0.05
    assert [(r.caption_id, r.page) for r in got if r.caption_id == 5] == ([(5, -scores[0][1])] if clear else [])
    slugs = {r.doc_id: r for r in catalog.QUERIES["f03_slugs"](spark, str(tmp_path)).collect()}
    assert all(len(slugs[i].title) > 200 for i in range(1, 5))


def test_votes_of_users_whose_mean_is_the_bound(spark, tmp_path):
    """Values whose sum as doubles is above or below 50 a value by its last digit, as the order has it."""
    rows, rnd = [], random.Random(3)
    for user in range(300):
        cents = [rnd.randint(0, 9999) for _ in range(12)]
        cents.append(13 * 5000 - sum(cents))
        rows += [(user, "click", c / 100) for c in cents]
    assert len({reduce(add, (v for u, _, v in rows if u == user)) for user in range(300)}) > 1
    rows += [(300, "click", 50.0), (300, "click", 50.01), (301, "click", 49.99), (301, "click", None), (302, "view", None), (303, "view", float("nan")), (304, "view", 1e300), (305, "view", -1e300)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["component"]: (r["k"], r["helps"], r["hurts"]) for r in catalog.QUERIES["m02_direction_votes"](spark, str(tmp_path)).collect()}
    assert got == {"click": (302, 1, 1), "view": (4, 2, 1)}


def test_votes_of_last_digits_and_large_values(spark, tmp_path):
    """One step above or below 50 is a vote, and sums too large for a decimal end no job; the SQL has the same rows in any order."""
    rows = [(1, math.nextafter(50, 99)), (2, math.nextafter(50, 0)), (3, 50.0), (4, 9e25), (4, 9e25), (5, -9e19), (5, -9e19), (6, 1e300), (7, None)]
    spark.createDataFrame([(u, "click", v) for u, v in rows], "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/spark")
    next((tmp_path / "spark").glob("*.parquet")).rename(tmp_path / "events.parquet")
    df = catalog.QUERIES["m02_direction_votes"](spark, str(tmp_path))
    assert compare(df, catalog.ORACLES["m02_direction_votes"], str(tmp_path)) == ""
    assert [(r["k"], r["helps"], r["hurts"]) for r in df.collect()] == [(7, 3, 2)]


def test_best_pages_against_all_pairs(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    pick = lambda n: [words[min(int(rnd.expovariate(0.12)), 39)] for _ in range(n)]
    pages = [(f"d{k % 3}", k, pick(rnd.choice((0, 3, 30, 60)))) for k in range(90)] + [(None, 90, words), ("d0", 91, None), ("d1", 92, [None, *words[:30]])]
    captions = [(f"d{k % 4}", k, pick(rnd.choice((0, 4, 10, 45)))) for k in range(160)] + [(d, 200 + k, p[:9]) for k, (d, _, p) in enumerate(pages) if p] + [("d1", 400, [None, "w1", "w2", "w3"]), ("d0", 401, None)]
    kind = "doc_id string, {} long, tokens array<string>"
    c, p = spark.createDataFrame(captions, kind.format("caption_id")), spark.createDataFrame(pages, kind.format("page"))
    for least, margin in ((0.59, 0.05), (0.3, 0.2), (0.9, 0.0)):
        want = set()
        for d, i, t in captions:
            scores = sorted(((-len(set(t) & set(x) - {None}) / len(set(t)), page) for e, page, x in pages if d and d == e and t and x), key=lambda x: x)
            scores = [x for x in scores if x[0] < 0] + [(0.0, None)]
            if -scores[0][0] >= least and (len(scores) < 2 or -scores[0][0] + scores[1][0] >= margin):
                want.add((d, i, scores[0][1], round(-scores[0][0], 6)))
        got = pointers.best_page(c, p, least=least, margin=margin).collect()
        assert len(got) == len(want) > 2 and {(r.doc_id, r.caption_id, r.page, round(r.score, 6)) for r in got} == want


def test_best_pages_meet_by_rare_tokens(spark):
    """Words that all pages have make no pairs: of 300 captions and 300 pages only those that may belong together meet."""
    pages = [("d", k, [f"common{i}" for i in range(9)] + [f"own{k}"]) for k in range(300)]
    rows = spark.createDataFrame(pages, "doc_id string, page long, tokens array<string>")
    out = pointers.best_page(rows.withColumnRenamed("page", "caption_id"), rows)
    assert {(r.caption_id, r.page) for r in out.collect()} == {(k, k) for k in range(300)}
    made = []
    plain = pointers.written

    def counted(df):
        done = plain(df)
        if "times" in done.columns:
            made.append(done.agg(F.sum("times")).first()[0])
        return done

    pointers.written = counted
    try:
        pointers.best_page(rows.withColumnRenamed("page", "caption_id"), rows)
    finally:
        pointers.written = plain
    assert made == [300]
