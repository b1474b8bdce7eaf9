"""Versioned tables and identity repair: kills between the steps, conflicts, failed checks, rollback."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import repair
from lodestone.sources.versions import CheckError, ConflictError, VersionedTable

PAPER = "record_id string, paper_id string, title string, authors string, year int, journal string, doi string, url string, abstract string, n_pages int, n_figures int, n_tables int, fulltext_chars int, source_sha256 string, license string, triage string"


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture
def held(spark, tmp_path):
    out = VersionedTable(spark, f"file://{tmp_path}/t")
    out.replace(spark.range(3))
    return out


def test_readers_stay_on_their_version(spark, held):
    first = held.read()
    assert held.replace(spark.range(5)) == 2
    assert ids(first) == [0, 1, 2] and ids(held.read()) == [0, 1, 2, 3, 4] and ids(held.read(1)) == [0, 1, 2]
    assert held.rollback(1) == 3 and ids(held.read()) == [0, 1, 2] and held.pointer()["note"] == "rollback to 1"
    assert len(held.vacuum(keep=1)) == 1 and ids(held.read()) == [0, 1, 2]
    with pytest.raises(LookupError):
        held.read(1)


def test_a_kill_between_the_steps_shows_the_old_version(spark, held, monkeypatch):
    monkeypatch.setattr(VersionedTable, "publish", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        held.replace(spark.range(9))
    monkeypatch.undo()
    assert ids(held.read()) == [0, 1, 2] and held.versions() == [1]
    assert len(held.vacuum()) == 1, "what was staged is found and deleted"
    assert held.replace(spark.range(4)) == 2


def test_a_failed_check_changes_nothing(spark, held):
    with pytest.raises(CheckError, match="too few"):
        held.replace(spark.range(1), check=lambda df: "too few" if df.count() < 2 else None)
    assert held.versions() == [1] and held.vacuum() == []


def test_two_writers_meet(spark, held):
    one, two = held.stage(spark.range(1)), held.stage(spark.range(2))
    assert held.publish(one, 1) == 2
    with pytest.raises(ConflictError):
        held.publish(two, 1)
    assert ids(held.read()) == [0]
    with pytest.raises(LookupError):
        VersionedTable(spark, f"{held.path}-none").read()


@pytest.fixture
def sources(spark):
    doi = "10.1/x"
    paper = ("r1", "a-title", "Wrong", "Old", 1999, None, "10.2/z", None, None, 0, 0, 0, 0, None, None, "A")
    other = ("r2", "b", "B", "Old", 1999, None, "10.2/q", None, None, 0, 0, 0, 0, None, None, "B")
    make = spark.createDataFrame
    return {
        "papers": make([paper, other], PAPER),
        "canonical": make([("r1", "A title", "https://doi.org/" + doi, "2001", ""), ("r2", "B", "10.2/q", "1999", "")], "record_id string, title string, doi string, year string, url string"),
        "source": make([("r1", "a-title", "doi:" + doi, "CC-BY-4.0")], "record_id string, paper_id string, doi string, license string"),
        "acquired": make([("r1", doi, "downloaded", "h", "https://e/1")], "record_id string, doi string, status string, sha256 string, url string"),
        "parsed": make([("r1", "h", "A Title", doi, "CC-BY-4.0", ["X Y"], "", "Short.", 2, 1, f"See {doi.upper()}.")], "record_id string, sha256 string, title string, doi string, license string, authors array<string>, journal string, abstract string, n_figures int, n_tables int, fulltext string"),
        "pdfs": make([], "record_id string, sha256 string, audited_sha256 string, audit_status string, pages string"),
    }


def judged(s, **other):
    s = s | other
    return repair.outcomes(repair.judged(*(s[k] for k in ("papers", "canonical", "source", "acquired", "parsed", "pdfs"))))


def test_repair_and_quarantine(spark, sources, tmp_path):
    table, quarantine = VersionedTable(spark, f"file://{tmp_path}/p"), VersionedTable(spark, f"file://{tmp_path}/q")
    table.replace(sources["papers"])
    rows = lambda: repair.judged(table.read(), *(sources[k] for k in ("canonical", "source", "acquired", "parsed", "pdfs")))
    done = repair.apply(table, quarantine, rows())
    assert done.version == 2 and {(r["record_id"], r["status"], r["fault"]) for r in done.outcomes.collect()} == {("r1", "repaired", None), ("r2", "fault", "record_missing")}
    now = {r["record_id"]: r for r in table.read().collect()}
    assert (now["r1"]["title"], now["r1"]["authors"], now["r1"]["year"], now["r1"]["journal"], now["r1"]["doi"], now["r1"]["url"], now["r1"]["n_tables"], now["r1"]["triage"]) == ("A title", "X Y", 2001, None, "10.1/x", "https://e/1", 1, "A")
    assert now["r2"]["title"] == "B"
    kept = quarantine.read().collect()
    assert len(kept) == 1 and kept[0]["observed_doi"] == "10.2/z" and kept[0]["expected_doi"] == "10.1/x" and '"Wrong"' in kept[0]["original"]
    again = repair.apply(table, quarantine, rows())
    assert again.version is None and again.outcomes.where("status = 'already_verified'").count() == 1
    table.rollback(1)
    assert repair.apply(table, quarantine, rows()).version == 4 and quarantine.read().count() == 1, "the same snapshot isn't kept twice"


def test_a_kill_after_the_quarantine(spark, sources, tmp_path, monkeypatch):
    table, quarantine = VersionedTable(spark, f"file://{tmp_path}/p"), VersionedTable(spark, f"file://{tmp_path}/q")
    table.replace(sources["papers"])
    rows = lambda: repair.judged(table.read(), *(sources[k] for k in ("canonical", "source", "acquired", "parsed", "pdfs")))
    publish = VersionedTable.publish
    monkeypatch.setattr(VersionedTable, "publish", lambda self, *a, **k: publish(self, *a, **k) if self is quarantine else (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        repair.apply(table, quarantine, rows())
    monkeypatch.undo()
    assert table.read().where("title = 'Wrong'").count() == 1 and quarantine.read().count() == 1
    assert repair.apply(table, quarantine, rows()).version == 2 and quarantine.read().count() == 1


def test_a_bad_staged_table_is_refused(spark, sources, tmp_path, monkeypatch):
    table, quarantine = VersionedTable(spark, f"file://{tmp_path}/p"), VersionedTable(spark, f"file://{tmp_path}/q")
    table.replace(sources["papers"])
    rows = repair.judged(table.read(), *(sources[k] for k in ("canonical", "source", "acquired", "parsed", "pdfs")))
    for bad in (lambda p, f: p.unionAll(p), lambda p, f: p.limit(1), lambda p, f: p):
        monkeypatch.setattr(repair, "repaired", bad)
        with pytest.raises(CheckError):
            repair.apply(table, quarantine, rows)
        assert table.versions() == [1]


FAULTS = [
    ("source", "paper_id", "other", "title_or_folder_mismatch"), ("papers", "paper_id", "other", "title_or_folder_mismatch"), ("canonical", "title", "Else", "title_or_folder_mismatch"), ("acquired", "doi", "10.9/q", "doi_disagrees_across_manifests"),
    ("source", "doi", None, "doi_disagrees_across_manifests"), ("acquired", "status", "failed", "acquisition_not_verified"), ("acquired", "status", None, "acquisition_not_verified"), ("parsed", "sha256", "other", "document_hash_mismatch"),
    ("parsed", "doi", "10.9/q", "document_doi_mismatch"), ("parsed", "title", None, "document_title_mismatch"), ("parsed", "license", None, "document_license_mismatch"), ("parsed", "fulltext", None, "fulltext_without_doi"),
]


def test_every_fault(spark, sources):
    only = {k: v.where("record_id = 'r1'") for k, v in sources.items()}
    pdf = lambda *rows: spark.createDataFrame([("r1", *r) for r in rows], sources["pdfs"].schema)
    cases = [(judged(only | {t: only[t].withColumn(c, F.lit(v).cast(only[t].schema[c].dataType))}), want) for t, c, v, want in FAULTS]
    cases += [(judged(only | {t: only[t].limit(0)}), want) for t, want in (("source", "record_missing"), ("papers", "record_missing"), ("parsed", "document_missing"))]
    good = ("h", "h", "audited", "9")
    cases += [(judged(only, pdfs=pdf(*rows)), want) for rows, want in (([good, good], "several_pdfs"), ([("h", "h", "bad", "9")], "pdf_not_audited"), ([("h", "h", None, "9")], "pdf_not_audited"), ([("g", "h", "audited", "9")], "pdf_hash_mismatch"), ([("h", "h", "audited", "x")], "pdf_pages_invalid"), ([good], None))]
    found = cases[0][0].withColumn("n", F.lit(0))
    for n, (df, _) in enumerate(cases[1:], 1):
        found = found.unionByName(df.withColumn("n", F.lit(n)))
    assert {r["n"]: r["fault"] for r in found.select("n", "fault").collect()} == {n: want for n, (_, want) in enumerate(cases)}
