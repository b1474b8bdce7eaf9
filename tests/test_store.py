"""A folder of a user's own files from ingest to export; a second run does only what is new."""

from __future__ import annotations

import json
import math

import pytest

from lodestone import cli
from lodestone.operators import model_calls
from lodestone.sources.versions import VersionedTable
from lodestone.store import EVIDENCE, Store

BIB = """@article{p1, title = {Growth of cells}, author = {One, A and Two, B}, year = 2020, doi = {10.1/a}}
@article{p2, title = {Other cells}, author = {Three, C}, year = {2021}}"""
XML = "<article><front><article-meta><title-group><article-title>Other cells</article-title></title-group><abstract><p>Short.</p></abstract></article-meta></front><body><sec><title>Results</title><p>FGF2 doubled growth at 5 ng/ml.</p></sec></body></article>"


def handler(prompt):
    if "fail" in prompt:
        raise model_calls.FatalCallError
    if "A|B|C" in prompt:
        return json.dumps({"value": "A" if "growth" in prompt else "C", "quote": ""})
    return json.dumps({"A": {"title": "said"}, "M": {"note": "text of " + str(len(prompt))}, "D": {"cells": "yes"}})


def make_client():
    return model_calls.MockClient(handler)


def line(**kw):
    return "\t".join(str(kw.get(c, "")) for c in EVIDENCE)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    (at / "more").mkdir(parents=True)
    (at / "refs.bib").write_text(BIB)
    (at / "p1.txt").write_text("Abstract\n\nCells doubled their growth.\n")
    (at / "more" / "p2.xml").write_text(XML)
    (at / "notes.md").write_text("not ingested")
    rows = [line(decision="supported", formulation_or_variable="FGF2", endpoint="proliferation", numeric_effect_value=v, numeric_effect_variance=0.04, numeric_effect_metric="ratio", key_finding="more cells", source_record_id=p) for v, p in ((2, "p1"), (1.5, "p2"))]
    rows += [line(decision="rejected", formulation_or_variable="FGF2", source_record_id="p3"), line(decision="partial", formulation_or_variable="", source_record_id="p1")]
    (at / "evidence.tsv").write_text("\n".join(["\t".join(EVIDENCE), *rows]) + "\n")
    return at


def versions(store):
    return {t: len(VersionedTable(store.spark, f"{store.path}/{t}").versions()) for t in ("files", "papers", "documents", "items", "extractions")}


def test_from_a_folder_to_an_export(spark, folder, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.stats().where("n > 0").collect() == [] and store.evidence().collect() == []
    assert store.ingest(f"file://{folder}") == {"bibliography": 1, "document": 2, "evidence": 1}
    assert {r["paper_id"]: (r["title"], list(r["authors"]), r["doi"]) for r in store.read("papers").collect()} == {"p1": ("Growth of cells", ["One, A", "Two, B"], "10.1/a"), "p2": ("Other cells", ["Three, C"], None)}
    texts = {r["doc_id"]: (r["form"], r["text"]) for r in store.read("documents").collect()}
    assert texts["p1"] == ("txt", "Abstract\n\nCells doubled their growth.\n") and texts["p2"][0] == "xml" and "FGF2 doubled growth" in texts["p2"][1]
    held = versions(store)
    assert store.ingest(f"file://{folder}") == {} and versions(store) == held, "nothing new: nothing published"

    s = store.evidence().first()
    assert (s["component"], s["k"], s["method"], s["n_continuous"]) == ("FGF2", 2, "dersimonian_laird", 2) and math.isclose(s["pooled_effect"], (math.log(2) + math.log(1.5)) / 2)
    assert {(r["component"], r["n_papers"], r["decision"]) for r in store.evidence_audit(least=2).collect()} == {("FGF2", 2, "GO")}

    assert store.triage(make_client) == 2 and store.triage(make_client) == 0
    assert store.extract(make_client, {"A": "identity"}, tiers=("A",)) == 2 and store.extract(make_client, {}) == 0
    blocks = {(r["doc_id"], r["block"]): r["value"] for r in store.read("extractions").collect()}
    assert set(blocks) == {(d, b) for d in ("p1", "p2") for b in "AMD"} and blocks["p1", "A"]["title"] == "said" and blocks["p1", "A"]["doi"] == "10.1/a"

    (folder / "p1.txt").write_text("Cells died; this call will fail.")
    (folder / "p3.html").write_text("<title>New</title><p>No effect.</p>")
    assert store.ingest(f"file://{folder}") == {"document": 2}
    assert store.triage(make_client) == 2 and store.extract(make_client, {}) == 1, "the changed document's call fails, the new one is read"
    assert store.extract(make_client, {}) == 0 and {r["doc_id"] for r in store._unread("extractions").collect()} == {"p1"}
    assert {(r["measure"], r["name"], r["n"]) for r in store.stats().collect()} >= {("rows", "papers", 2), ("rows", "documents", 3), ("rows", "items", 2), ("component", "FGF2", 2)}
    assert [tuple(r)[1:] for r in store.top_components().collect()] == [("FGF2", 2)]
    assert {(r[0], r[1]) for r in store.readiness({"medium": ["cells", "growth"]}).where("ready").collect()} == set()

    out = store.export(f"file://{tmp_path}/out")
    assert spark.read.csv(out[1], header=True).count() == 2 and spark.read.json(out[3]).count() == store.read("extractions").count()
    with pytest.raises(Exception, match="(?i)exists"):
        store.export(f"file://{tmp_path}/out")


def test_a_changed_table_replaces_its_rows(spark, folder, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(f"file://{folder}")
    (folder / "evidence.tsv").write_text("\n".join(["\t".join(EVIDENCE), line(decision="supported", formulation_or_variable="EGF", key_finding="cells increased", source_record_id="p1")]) + "\n")
    (folder / "refs.bib").write_text(BIB.split("\n")[0])
    store.ingest(f"file://{folder}")
    assert [(r["component"], r["direction"]) for r in store.read("items").collect()] == [("EGF", 1)]
    assert [r["paper_id"] for r in store.read("papers").collect()] == ["p1"]


def test_a_stopped_ingest_is_done_again(spark, folder, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    publish = Store._publish
    monkeypatch.setattr(Store, "_publish", lambda self, name, *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()) if name == "items" else publish(self, name, *a, **k))
    with pytest.raises(KeyboardInterrupt):
        store.ingest(f"file://{folder}")
    monkeypatch.undo()
    assert store.read("files").count() == 0 and store.read("papers").count() == 2
    assert store.ingest(f"file://{folder}") == {"bibliography": 1, "document": 2, "evidence": 1}
    assert store.read("papers").count() == 2 and store.read("documents").count() == 2 and store.read("items").count() == 2


def test_worksheets(spark, folder, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.ingest(f"file://{folder}")
    assert store.template(["dose", "species"]) == 4
    shape = "paper_id string, field string, decision string, value string, quote string"
    store.fill(spark.createDataFrame([("p1", "dose", "supported", "2x", "Cells  doubled"), ("p1", "species", "partial", "", "no such words"), ("p2", "dose", "maybe", "", ""), ("p9", "dose", "supported", "1", "x")], shape))
    assert {tuple(r) for r in store.validate().collect()} == {("p1", "species", "value_missing"), ("p1", "species", "quote_not_in_text"), ("p2", "dose", "unknown_decision"), ("p9", "dose", "unknown_paper")}
    assert {tuple(r) for r in store.status().collect()} == {("", 1), ("supported", 2), ("partial", 1), ("maybe", 1)}
    assert [(r["paper_id"], r["field"]) for r in store.adjudicated().collect()] == [("p1", "dose")]
    assert store.template(["dose", "species", "age"]) == 7 and store.status().where("decision = 'supported'").first()["n"] == 2, "what is filled in stays"
    assert store.template(["dose"], force=True) == 2


def test_verbs(spark, folder, tmp_path, capsys):
    at = f"file://{tmp_path}/store"
    assert cli.main(["ingest", at, f"file://{folder}"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["document"] == 2
    assert cli.main(["triage", at, "--client", "tests.test_store:make_client"]) == 0
    assert cli.main(["extract", at, "--client", "tests.test_store:make_client", "--tiers", "A"]) == 0
    assert cli.main(["evidence", at, "--out", f"file://{tmp_path}/summaries"]) == 0 and spark.read.csv(f"file://{tmp_path}/summaries", header=True).count() == 1
    for verb in ("stats", "evidence-audit", "adjudication-validate", "adjudication-status", "adjudication-export"):
        assert cli.main([verb, at]) == 0
    assert cli.main(["adjudication-template", at, "--fields", "dose,species"]) == 0 and cli.main(["extraction-readiness", at, "--terms", '{"dose": ["ng/ml"]}']) == 0
    assert cli.main(["export", at, f"file://{tmp_path}/out"]) == 0
