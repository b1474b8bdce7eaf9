"""Golden values of functions, synthesis, design kernels, sources and sinks."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import effects, udf
from lodestone.functions import text as T
from lodestone.operators import design, gates, meta, model_calls, normalize
from lodestone.operators import relational as R
from lodestone.sources import bibtex, markup, sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [("5 ng/mL bFGF", "bFGF"), ("5% FBS-PSFC", "FBS-PSFC"), ("FGF2 (human)", "FGF2"), ("insulin at 5 ug", "insulin"), ("2i", "2i"), ("M199", "M199"), ("5-HT", "5-HT"), ("18-crown-6", "18-crown-6"), ("3T3", "3T3")],
)
def test_strip_component(spark, name, want):
    assert one(spark, T.strip_component(F.lit(name))) == want


@pytest.mark.parametrize(
    ("text", "value", "unit", "dimension", "normal", "comparable"),
    [("66-75 g", 70.5, "g", "concentration", None, False), ("48 h", 48.0, "h", "time", 48.0, True), ("30 min", 30.0, "min", "time", 0.5, True), ("2–3 days", 2.5, "days", "time", 60.0, True), ("10 %", 10.0, "%", "percent", 10.0, True), ("5 ng/mL", 5.0, "ng/mL", "concentration", None, False), ("none", None, None, None, None, False), (None, None, None, None, None, False)],
)
def test_quantities(spark, text, value, unit, dimension, normal, comparable):
    q = one(spark, T.parse_quantity(F.lit(text).cast("string")))
    assert (q.value, q.unit, q.dimension, q.normalized_value, q.comparable) == (value, unit, dimension, normal, comparable)


def test_grounding_and_codes(spark):
    assert one(spark, T.grounded(F.lit("Cells  GREW fast"), F.lit("the cells\ngrew fast here")))
    assert not one(spark, T.grounded(F.lit("cells"), F.lit("cells")))
    assert not one(spark, T.grounded(F.lit(None).cast("string"), F.lit("x")))
    assert one(spark, T.is_code(F.lit(" NR "))) and not one(spark, T.is_code(F.lit("nr")))
    assert one(spark, T.controlled(F.lit(" SERUM-free "), ["serum-free"])) == "serum-free"
    assert one(spark, T.controlled(F.lit("INF: yes"), ["yes"])) == "INF: yes"
    assert one(spark, T.dose_supported(F.lit("FGF2"), F.lit("10"), F.lit("ng/ml"), F.lit("FGF2 at 10 ng/ml was used"), F.lit("we say FGF2 at 10 ng/ml was used.")))
    assert one(spark, T.supported_by(F.lit(2.5), F.lit("rose 2.5 times"))) and not one(spark, T.supported_by(F.lit(2.0), F.lit("FGF2 rose")))
    assert one(spark, T.licence_code(F.lit(""), F.lit("https://creativecommons.org/licenses/by-nc/4.0/"))) == "CC-BY-NC-4.0"
    assert one(spark, T.json_from_prose(F.lit('so: {"a": 1} done'))) == '{"a": 1}'
    assert one(spark, T.json_from_prose(F.lit("no"))) is None


@pytest.mark.parametrize(("cell", "role", "want"), [("1,234.5*", "mean", 1234.5), ("2.0 ± 0.4", "mean", 2.0), ("2.0±0.4", "dispersion", 0.4), ("1.5 × 10^6", "mean", 1.5e6), ("n = 6", "n", 6.0), ("abc", "mean", None)])
def test_cell_numbers(spark, cell, role, want):
    assert one(spark, T.parse_cell_number(F.lit(cell), role)) == want


def test_normal_distribution(spark):
    for z in (-3.0, -0.5, 0.0, 1.96):
        want = 0.5 * (1 + math.erf(z / math.sqrt(2)))
        assert abs(one(spark, T.norm_cdf(F.lit(z))) - want) < 2e-7
        assert abs(one(spark, udf.normal_cdf(F.lit(z))) - want) < 1e-12


def test_ratio_of_means(spark):
    r = one(spark, meta.ratio_of_means(*[F.lit(x) for x in (2.0, 0.4, 6, 1.0, 0.3, 6)]))
    assert math.isclose(r.effect, math.log(2)) and abs(r.variance - 0.0216667) < 1e-6
    assert one(spark, meta.ratio_of_means(*[F.lit(x) for x in (2.0, 0.0, 6, 1.0, 0.3, 6)])) is None


def items(spark, rows):
    return spark.createDataFrame(rows, "component string, outcome string, paper_id string, effect double, variance double, direction int")


def test_synthesis(spark):
    rows = [("same", "g", f"p{k}", 0.5, 0.1, 1) for k in range(3)]
    rows += [("mixed", "g", "p1", 1.0, 0.01, 1), ("mixed", "g", "p2", -1.0, 0.01, -1)]
    rows += [("votes", "g", f"p{k}", None, None, d) for k, d in enumerate((1, 1, 1, -1))]
    rows += [("single", "g", "p1", 0.2, 0.04, None), ("none", "g", "p1", None, None, 0), ("conflict", "g", "p1", None, None, 1), ("conflict", "g", "p2", None, None, -1), ("conflict", "g", "p3", None, None, 1)]
    got = {r.component: r for r in meta.synthesize(items(spark, rows)).collect()}
    assert got["same"].i_squared == 0 and got["same"].tau_squared == 0 and math.isclose(got["same"].pooled_effect, 0.5) and got["same"].k == 3
    assert got["mixed"].i_squared > 0.9 and got["mixed"].context_dependent and abs(got["mixed"].pooled_effect) < 1e-9
    assert got["votes"].method == "beta_binomial" and math.isclose(got["votes"].p_beneficial, 4 / 6)
    assert got["single"].method == "single_study" and math.isclose(got["single"].pooled_effect, 0.2) and not got["single"].context_dependent
    assert got["none"].method == "insufficient" and got["none"].p_beneficial == 0.5
    assert got["conflict"].context_dependent
    assert meta.synthesize(items(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("quote", "direction", "want"),
    [("growth was 2.2 ± 0.4-fold higher", None, 2.2), ("a 3-fold change", 1, 3.0), ("a 4-fold decrease", None, 0.25), ("increased by 30%", None, 1.3), ("reduced 40 %", 1, 0.6), ("in 30% FBS", 1, None), ("nothing", 1, None), ("treated wells gave 80 at the end of the study, control wells gave 40", 1, 2.0), ("80 in treated cells versus 40 in control cells", 1, None), ("treated 80 ng/ml, control 40", 1, None), ("2.0 ± 0.4 SD", 1, None)],
)
def test_effect_inference(spark, quote, direction, want):
    e = one(spark, udf.infer_effect(F.lit(quote), F.lit(direction).cast("int"), F.lit("FGF2")))
    assert e.effect is None if want is None else math.isclose(e.effect, math.log(want))


def test_group_statistics(spark):
    e = one(spark, udf.infer_effect(F.lit("FGF2 group 2.0 ± 0.4 SD, n = 6; control group 1.0 ± 0.3 SD, n = 6"), F.lit(1), F.lit("FGF2")))
    assert math.isclose(e.effect, math.log(2)) and abs(e.variance - 0.0216667) < 1e-6


def test_group_statistics_by_mean(spark):
    e = one(spark, udf.infer_effect(F.lit("treated cells mean 2.0, SEM 0.2, n=4; control mean 1.0, SD 0.3, n=6"), F.lit(1), F.lit("FGF2")))
    assert e.source == "treatment_control_mean_sd_n" and math.isclose(e.variance, 0.16 / 16 + 0.09 / 6)


def test_labels_are_those_of_one_pattern():
    """The shape first and its label after it, against label and shape in one pattern."""
    one = re.compile(r"(?P<label>[^.;,]{0,80}?)" + effects.GROUP_STATS.pattern, re.I)
    other = re.compile(r"(?P<label>[^.;,()]{0,80}?)" + effects.PLUS_MINUS_STATS.pattern, re.I)
    parts = ["treated cells ", "control ", "mean ", "meanmean ", "mean= ", "1", "12.5", " SD ", " 3 n 5", "n=6", ",", ";", ".", ":", "(", ")", " ", "±", "+/-", "q" * 79, "q" * 80, "q" * 81, "word " * 12, "²", "_", " mean 2 SD 1 n 4", " mean 3, SEM 0.2, n=6", " 2 ± 1 (SD, n = 7)", ": 4 +/- 1 (sem; n = 8"]
    rnd, met = random.Random(2), [0, 0]
    for _ in range(4000):
        low = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))).lower()
        for k, (pattern, found) in enumerate(((one, effects.stated), (other, effects.stated_plus_minus))):
            want = [(m["label"], m["mean"], m.end()) for m in pattern.finditer(low)]
            assert [(label, m["mean"], m.end()) for label, m in found(low)] == want, low
            met[k] += len(want)
    assert min(met) > 500


def test_equal_quotes_are_read_once(monkeypatch):
    asked = []
    monkeypatch.setattr(effects, "fold", lambda low, *a: asked.append(low))
    quotes = ["treated: 2 ± 1 (SD, n = 7); control: 4 ± 1 (SD, n = 8)", "nothing here", None, "long " * 50] * 100
    got = udf.infer_effect.func(pd.Series(quotes), pd.Series([1] * 400), pd.Series(["once"] * 400))
    assert sorted(asked, key=len)[:3] == sorted(["", "nothing here", quotes[0].lower()], key=len) and len(asked) == 103  # long quotes aren't kept
    assert got["effect"].count() == 100 and math.isclose(got["effect"][0], math.log(0.5)) and got["source"].isna().sum() == 300
    assert udf.infer_effect.func(pd.Series([], dtype=object), pd.Series([], dtype=int), pd.Series([], dtype=object)).shape == (0, 3)


def test_ontology(spark):
    lookup = normalize.ontology(spark, [{"canonical": "FGF2", "aliases": ["bFGF"], "category": "gf"}, {"canonical": "Other", "aliases": ["bfgf"]}])
    df = spark.createDataFrame([("bFGF",), ("5 ng/mL bFGF",), ("fgf2",), ("unknown (x)",), ("",), (None,)], "name string")
    got = [(r.canonical, r.matched_via, r.score) for r in normalize.canonicalize(df, "name", lookup).collect()]
    assert sorted(got, key=str) == sorted([("FGF2", "alias", 1.0), ("FGF2", "stripped", 0.9), ("FGF2", "exact", 1.0), ("unknown", "none", 0.0), ("", "none", 0.0), (None, "none", 0.0)], key=str)


def test_pareto_and_hypervolume(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 2.0), (3.0, 4.0), (1.0, 4.0), (5.0, 1.0), (4.0, 2.0)], "x double, y double")
    want = [(1.0, 4.0), (1.0, 4.0), (3.0, 2.0), (5.0, 1.0)]
    assert sorted(map(tuple, design.pareto_2d(df, "x", "y").collect())) == want == sorted(map(tuple, design.pareto(df, ["x", "y"]).collect()))
    two = spark.createDataFrame([(1.0, 4.0), (3.0, 2.0)], "x double, y double")
    assert design.hypervolume_2d(two, "x", "y", (5.0, 5.0)).first()[0] == 8
    got = design.hypervolume(two, ["x", "y"], [5.0, 5.0]).first()
    assert abs(got.hypervolume - 8) < 0.01 and got.error < 0.1


def test_proposals_are_distinct(spark):
    pool = spark.createDataFrame([(k, [k / 10, 1 - k / 10]) for k in range(11)], "id long, v array<double>")
    x = np.array([[0.1, 0.2], [0.8, 0.4], [0.5, 0.5]])
    got = design.propose((x, x * [1, -1]), pool, "v", "id", 4)
    assert len(set(got)) == 4 and got == design.propose((x, x * [1, -1]), pool, "v", "id", 4)


def test_gate_tables(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id long, v string")
    got = sorted(map(tuple, gates.issues(df, "id", [("empty", F.col("v") == ""), ("odd", F.col("id") % 2 == 1)]).collect()))
    assert got == [(1, "odd"), (2, "empty"), (3, "empty"), (3, "odd")]
    status = one(spark, gates.table_status(*[F.lit(x) for x in (True, True, False, True, True, True, False)]))
    assert status == "incomplete_sample_size_not_cell_addressable"


def test_upsert_and_sample(spark):
    base = spark.createDataFrame([(1, "a", "A"), (2, "b", None)], "id long, v string, tier string")
    delta = spark.createDataFrame([(2, "c", None), (1, "z", None), (3, "n", "B")], "id long, v string, tier string")
    assert sorted(map(tuple, R.upsert(base, delta, "id", keep_old=("tier",)).collect())) == [(1, "z", "A"), (2, "c", None), (3, "n", "B")]
    assert R.hash_sample(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], F.col("id"), 4).count() == 12


JATS = """<article><front><article-meta><title-group><article-title>On cells</article-title></title-group><abstract><p>Short.</p></abstract></article-meta></front>
<body><sec><title>Methods</title><p>One.</p><sec><title>Media</title><p>Two.</p></sec></sec></body>
<table-wrap><caption><p>Growth</p></caption><table><tr><th rowspan="2">Group</th><th colspan="2">Count</th></tr><tr><th>day 1</th><th>day 2</th></tr><tr><td>control</td><td>1.0</td><td>1.5</td></tr><tr><td>treated</td><td>2.0</td><td>3.0</td></tr></table>
<table-wrap-foot><fn><p>mean</p></fn></table-wrap-foot></table-wrap><fig><label>Figure 1</label><caption><p>Cells</p></caption></fig></article>"""


def test_xml_parts(spark):
    df = spark.createDataFrame([("a", JATS), ("b", "<broken"), ("c", None)], "id string, xml string")
    rows = {(r.doc_id, r.id): r for r in markup.parts(df, "id", "xml").collect()}
    assert rows["a", "TITLE"].text == "On cells" and rows["a", "S1.1"].title == "Methods/Media" and rows["a", "S1.1.p1"].text == "Two."
    cells = {k: (r.text, r.is_header) for (d, k), r in rows.items() if d == "a" and r.kind == "cell"}
    assert cells["T1.R4.C2"] == ("2.0", False) and cells["T1.R2.C2"] == ("day 1", True) and "T1.R2.C1" not in cells
    assert rows["a", "T1.F1"].text == "mean" and rows["a", "F1"].text == "Figure 1 Cells"
    assert rows["b", "E1"].kind == "error" and rows["c", "E1"].kind == "error"


def test_html_parts(spark):
    page = "<html><title>T</title><body><h1>Head</h1><p>a<b>b</b></p><p>c<table><tr><td rowspan=2>x<td>y<tr><td>z</table><script>no</script>"
    rows = {r.id: r for r in markup.parts(spark.createDataFrame([(1, page)], "id long, h string"), "id", "h", "html").collect()}
    assert rows["S1"].title == "Head" and rows["S1.p1"].text == "ab" and rows["T1.R2.C2"].text == "z"
    text = markup.document_text(markup.parts(spark.createDataFrame([(1, page)], "id long, h string"), "id", "h", "html")).first().text
    assert text.startswith("T\n\nHead\n\nab")


def test_bibtex(spark, tmp_path):
    (tmp_path / "x.bib").write_text('@article{Key1, title = {A {B}eta Étude}, author = {Doe, J and Roe, R}, year = "2020a", keywords={a; b, c}, doi=10.1/x}\n@misc{, title={No key}}')
    rows = bibtex.read_bibtex(spark, str(tmp_path / "x.bib")).collect()
    assert (rows[0].paper_id, rows[0].title, rows[0].authors, rows[0].year, rows[0].keywords, rows[0].slug) == ("Key1", "A Beta Étude", ["Doe, J", "Roe, R"], 2020, ["a", "b", "c"], "a-beta-etude")
    assert rows[1].paper_id == "no-key" and rows[1].year is None


def test_tables_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2", "b\tc", ["x", "y"]), ("1", None, [])], "id string, v string, l array<string>")
    sinks.write_tsv(df, str(tmp_path / "t"), ["id"], single=True)
    back = tables.read_tsv(spark, str(tmp_path / "t"), ["id", "v", "l"])
    assert sorted(map(tuple, back.collect())) == [("1", "", ""), ("2", "b\tc", "x;y")]
    sinks.guarded_overwrite(df, None, str(tmp_path / "w"), F.lit(True))
    with pytest.raises(FileExistsError):
        sinks.guarded_overwrite(df, spark.read.parquet(str(tmp_path / "w")), str(tmp_path / "w"), F.col("v") != "")
    (tmp_path / "i.json").write_text('[{"component": "a", "paper_id": "p", "effect": "0.5", "direction": 1}, {"component": "", "paper_id": "q"}]')
    r = tables.read_items(spark, str(tmp_path / "i.json")).collect()
    assert len(r) == 1 and r[0].effect == 0.5 and r[0].quote == ""
    files = tables.read_files(spark, str(tmp_path), "*.json")
    manifest = files.select(F.lit("i.json").alias("path"), "sha256").unionAll(files.select(F.lit("../i.json"), "sha256"))
    assert [x.ok for x in tables.verified_files(files, manifest, str(tmp_path)).orderBy(F.desc("path")).collect()] == [True, False]


def test_adjudicated(spark):
    cols = "decision formulation_or_variable source_record_id key_finding endpoint numeric_effect_metric numeric_effect_value numeric_effect_variance numeric_effect_notes".split()
    rows = [("supported", "FGF2", "r1", "x", "growth", "ratio", "2.0", "0.1", ""), ("partial", "FGF2", "r2", "cells grew faster", "Differentiation", "", "", "", ""), ("rejected", "FGF2", "r3", "", "", "", "", "", ""), ("supported", "", "r4", "better", "", "", "", "", ""), ("supported", "B", "r5", "better but worse", "", "", "", "", "")]
    got = {r.paper_id: r for r in tables.adjudicated_items(spark.createDataFrame(rows, cols)).collect()}
    assert math.isclose(got["r1"].effect, math.log(2)) and got["r1"].direction == 1 and got["r1"].variance == 0.1
    assert got["r2"].direction == 1 and got["r2"].outcome == "differentiation" and got["r2"].effect is None
    assert set(got) == {"r1", "r2", "r4", "r5"} and got["r4"].skipped and got["r5"].skipped and not got["r2"].skipped


def test_model_calls(spark):
    papers = spark.createDataFrame([(1, "cells grew fast here"), (2, "FATAL"), (3, "prose")], "id long, text string")

    def factory():
        state = {"n": 0}

        def handler(prompt):
            if "FATAL" in prompt:
                raise model_calls.FatalCallError
            state["n"] += 1
            if state["n"] % 2:
                raise model_calls.CallError
            return '{"value": "A", "quote": "cells grew fast"}' if "cells" in prompt else "I can't"

        return model_calls.MockClient(handler)

    done = model_calls.grounded_values(model_calls.call(model_calls.prompts(papers, {"x": "g"}), factory))
    assert {r.id: (r.status, r.value) for r in done.collect()} == {1: ("ok", "A"), 2: ("call_error", None), 3: ("bad_json", None)}
    assert {r.id: r.tier for r in model_calls.triage(papers, factory).collect()} == {1: "A", 2: "unclassified", 3: "unclassified"}


def test_verbs_write_their_reports(spark, tmp_path):
    import os

    from lodestone import catalog, cli

    assert all(q in catalog.QUERIES for names in cli.VERBS.values() for q in names)
    if os.path.isdir("/root/testdata/sf0.001"):
        cli.report(spark, "stats", "/root/testdata/sf0.001", str(tmp_path / "r"))
        assert spark.read.csv(str(tmp_path / "r/a01_component_counts"), header=True).count() > 0


def test_page_text_keeps_its_order(spark):
    page = "<title>T</title><h1>H</h1>" + "".join(f"<p>par{k}</p>" for k in range(1, 13))
    text = markup.document_text(markup.parts(spark.createDataFrame([(1, page)], "id long, h string"), "id", "h", "html")).first().text
    assert text.split("\n\n") == ["T", "H", *(f"par{k}" for k in range(1, 13))]


def test_slugs(spark):
    assert [bibtex.slugify(x) for x in ("", "Étude: one_two  three", "--a--", None, "don't")] == ["untitled", "etude-one-two-three", "a", "untitled", "dont"]
