"""A store of papers, texts and evidence over a user's own folders: ingest, triage, extract, evidence, worksheets, export.

A store is a folder of versioned tables. Every verb reads tables, does what is new, and publishes whole versions; the
registry of ingested files is published last, so a verb that was stopped does the same files again, with the same result.
A second run over unchanged files publishes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import audit, gates, meta, model_calls, workflow
from lodestone.session import prepare
from lodestone.sources import bibtex, markup, sinks, tables
from lodestone.sources.versions import VersionedTable

SCHEMAS = {
    "files": "path string, sha256 string, kind string",
    "papers": "paper_id string, title string, authors array<string>, year int, journal string, doi string, file string",
    "documents": "doc_id string, form string, sha256 string, text string",
    "items": "component string, outcome string, paper_id string, effect double, variance double, direction int, quote string, file string",
    "tiers": "doc_id string, sha256 string, tier string",
    "extractions": "doc_id string, sha256 string, block string, value map<string,string>",
    "worksheet": "paper_id string, field string, decision string, value string, quote string",
}
#: What a file is, by its ending. An evidence table has the columns of EVIDENCE.
KINDS = {"bib": "bibliography", "xml": "document", "txt": "document", "html": "document", "tsv": "evidence"}
EVIDENCE = ["decision", "formulation_or_variable", "endpoint", "numeric_effect_value", "numeric_effect_variance", "numeric_effect_metric", "numeric_effect_notes", "key_finding", "source_record_id"]
DECISIONS = ("supported", "partial", "rejected", "unclear")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepare(spark), path.rstrip("/")

    def _table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table's latest version; one that was never written is empty."""
        held = self._table(name)
        return held.read() if held.versions() else self.spark.createDataFrame([], SCHEMAS[name])

    def _publish(self, name: str, df: DataFrame, note: str, key: list[str] | None = None) -> None:
        twice = lambda x: None if x.groupBy(*key).count().where("count > 1").isEmpty() else f"{name}: a key occurs twice"
        self._table(name).replace(df, check=twice if key else None, note=note)

    # C01, S01, S06, S07, S17, S19
    def ingest(self, folder: str, *, force: bool = False) -> dict[str, int]:
        """Take in a folder's new and changed files (all with `force`); how many of each kind there were.

        Bibliographies give papers by their keys, texts and marked-up documents give documents by their stems, evidence
        tables give items. A changed file's rows replace its earlier ones. A key in several new files comes from the
        last by path.
        """
        name = F.regexp_replace("path", r"^[a-z]+:/*", "/")
        found = tables.read_files(self.spark, folder, "*.{" + ",".join(KINDS) + "}").withColumn("end", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
        kinds = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
        found = found.select(name.alias("path"), "sha256", F.try_element_at(kinds, F.col("end")).alias("kind"), "end", "stem", "content")
        old = self.read("files")
        new = found if force else found.join(old, ["path", "sha256"], "left_anti")
        new = new.persist()
        done = dict(new.groupBy("kind").count().collect())
        if not done:
            new.unpersist()
            return {}
        text = F.decode("content", "utf-8")
        if "bibliography" in done:
            self._bibliographies([r[0] for r in new.where("kind = 'bibliography'").select("path").collect()])
        if "document" in done:
            self._documents(new.where("kind = 'document'").select("path", "end", "stem", "sha256", text.alias("text")))
        if "evidence" in done:
            self._evidence_tables([r[0] for r in new.where("kind = 'evidence'").select("path").collect()])
        registry = old.join(new, "path", "left_anti").unionByName(new.select("path", "sha256", "kind"))
        self._publish("files", registry, f"ingest {folder}", ["path"])
        new.unpersist()
        return done

    def _bibliographies(self, paths: list[str]) -> None:
        old, rows = self.read("papers"), None
        for path in sorted(paths):  # a few files; each is parsed on its own, so that its rows know it
            own = bibtex.read_bibtex(self.spark, path).select("paper_id", "title", "authors", "year", "journal", "doi", F.lit(path).alias("file"))
            rows = own if rows is None else rows.unionByName(own)
        last = rows.groupBy("paper_id").agg(F.max_by(F.struct("title", "authors", "year", "journal", "doi", "file"), "file").alias("r")).select("paper_id", "r.*")
        self._publish("papers", old.where(~F.col("file").isin(paths)).join(last, "paper_id", "left_anti").unionByName(last), "ingest", ["paper_id"])

    def _documents(self, new: DataFrame) -> None:
        plain = new.where("end = 'txt'").select("path", "stem", F.lit("txt").alias("form"), "sha256", "text")
        rows = plain
        for form in ("xml", "html"):
            marked = new.where(F.col("end") == form)
            read = markup.document_text(markup.parts(marked, "path", "text", form)).withColumnRenamed("doc_id", "path")
            rows = rows.unionByName(marked.drop("text").join(read, "path", "left").select("path", "stem", F.lit(form).alias("form"), "sha256", F.coalesce("text", F.lit("")).alias("text")))
        last = rows.groupBy(F.col("stem").alias("doc_id")).agg(F.max_by(F.struct("form", "sha256", "text"), "path").alias("r")).select("doc_id", "r.*")
        self._publish("documents", self.read("documents").join(last, "doc_id", "left_anti").unionByName(last), "ingest", ["doc_id"])

    def _evidence_tables(self, paths: list[str]) -> None:
        rows = self.read("items").where(~F.col("file").isin(paths))
        for path in sorted(paths):
            items = tables.adjudicated_items(tables.read_tsv(self.spark, path, EVIDENCE)).where("not skipped").drop("skipped")
            rows = rows.unionByName(items.withColumn("file", F.lit(path)))
        self._publish("items", rows, "ingest")

    def _unread(self, table: str) -> DataFrame:
        """Documents of which a table has nothing for their present content."""
        return self.read("documents").join(self.read(table).select("doc_id", "sha256").distinct(), ["doc_id", "sha256"], "left_anti")

    # C02, L03
    def triage(self, factory: Callable[[], object]) -> int:
        """A tier for each new or changed document; how many there were."""
        new = self._unread("tiers").persist()
        n = new.count()
        if n:
            found = model_calls.triage(new.withColumnRenamed("doc_id", "paper_id"), factory).select(F.col("paper_id").alias("doc_id"), "sha256", "tier").persist()
            self._publish("tiers", self.read("tiers").join(found, "doc_id", "left_anti").unionByName(found), "triage", ["doc_id"])
        return n

    # C03, L04, E01
    def extract(self, factory: Callable[[], object], guides: dict[str, str], *, tiers: tuple[str, ...] = (), full: bool = True) -> int:
        """Both passes' blocks of each new or changed document (of the named tiers, if any); documents whose calls failed come again next time."""
        new = self._unread("extractions")
        if tiers:
            new = new.join(self.read("tiers").where(F.col("tier").isin(*tiers)).select("doc_id"), "doc_id", "left_semi")
        new = new.withColumnRenamed("doc_id", "paper_id").persist()
        if new.isEmpty():
            return 0
        answers = model_calls.call(workflow.block_prompts(new, guides, full=full), factory).persist()
        good = answers.groupBy("paper_id").agg(F.bool_and(F.col("status") == "ok").alias("ok")).where("ok").select("paper_id")
        refs = new.join(good, "paper_id", "left_semi").select("paper_id", "sha256").join(self.read("papers").select("paper_id", "title", "year", "doi"), "paper_id", "left")
        values = workflow.block_values(answers.join(good, "paper_id", "left_semi"), refs, ["title", "year", "doi"])
        found = values.join(refs.select("paper_id", "sha256"), "paper_id").select(F.col("paper_id").alias("doc_id"), "sha256", "block", "value").persist()
        n = found.select("doc_id").distinct().count()
        if n:
            self._publish("extractions", self.read("extractions").join(found.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(found), "extract", ["doc_id", "block"])
        return n

    # C05, A01, A02
    def stats(self) -> DataFrame:
        """measure, name and n: rows of each table, documents by tier, and papers by component."""
        counts = [self.read(t).agg(F.lit("rows").alias("measure"), F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("papers", "documents", "items", "extractions")]
        tiers = self.read("documents").join(self.read("tiers").select("doc_id", "tier"), "doc_id", "left").groupBy(F.coalesce("tier", F.lit("unclassified")).alias("name")).agg(F.count("*").alias("n"))
        components = self.read("items").groupBy(F.col("component").alias("name")).agg(F.countDistinct("paper_id").alias("n"))
        out = counts[0]
        for df in [*counts[1:], tiers.select(F.lit("tier").alias("measure"), "name", "n"), components.select(F.lit("component").alias("measure"), "name", "n")]:
            out = out.unionByName(df)
        return out

    # C06, M01-M05
    def evidence(self) -> DataFrame:
        """One pooled summary for each component and outcome, the most decided first."""
        return meta.ranked(meta.synthesize(self.read("items")))

    # C07, A05, G06
    def evidence_audit(self, *, least: int = 3) -> DataFrame:
        """Each component's items and papers, those with effect and variance, and whether there is enough to pool."""
        one = (F.col("effect").isNotNull() & F.col("variance").isNotNull()).cast("int")
        quoted = (F.trim(F.coalesce("quote", F.lit(""))) != "").cast("int")
        own = self.read("items").groupBy("component", "outcome").agg(F.count("*").alias("n_items"), F.countDistinct("paper_id").alias("n_papers"), F.sum(one).alias("n_pooled"), F.sum(quoted).alias("n_quoted"))
        return own.withColumn("decision", F.when((F.col("n_papers") >= least) & (F.col("n_quoted") == F.col("n_items")), "GO").otherwise("NO_GO"))

    # C08, L06
    def readiness(self, terms: dict[str, list[str]]) -> DataFrame:
        """doc_id, operator and ready for every document and operator (its terms)."""
        text = F.lower(F.coalesce("text", F.lit("")))
        numbers = F.size(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
        each = F.array(*[F.struct(F.lit(name).alias("operator"), gates.readiness(F.length(text), F.filter(F.array(*map(F.lit, ts)), lambda t: F.contains(text, t)), numbers, name).alias("ready")) for name, ts in terms.items()])
        return self.read("documents").select("doc_id", F.inline(each))

    # C10-C14, G01, G02, G04, L17
    def template(self, fields: list[str], *, force: bool = False) -> int:
        """A worksheet of every paper and field; rows that someone has filled in stay, and are only overwritten with `force`."""
        fresh = audit.gold_review(self.read("papers").select("paper_id"), fields)
        blank = fresh.select("paper_id", "field", *[F.lit("").alias(c) for c in ("decision", "value", "quote")])
        old = self.read("worksheet")
        out = blank if force else old.unionByName(blank.join(old, ["paper_id", "field"], "left_anti"))
        self._publish("worksheet", out, "template", ["paper_id", "field"])
        return out.count()

    def fill(self, rows: DataFrame) -> None:
        """Decisions (paper_id, field, decision, value, quote) over the worksheet's rows; unknown rows are refused by validate()."""
        new = rows.select("paper_id", "field", "decision", "value", "quote")
        self._publish("worksheet", self.read("worksheet").join(new, ["paper_id", "field"], "left_anti").unionByName(new), "fill", ["paper_id", "field"])

    def validate(self) -> DataFrame:
        """paper_id, field and issue of the worksheet's rows: unknown decisions, decided rows without value or quote, quotes that no text has, unknown papers."""
        w, docs = self.read("worksheet"), self.read("documents").select(F.col("doc_id").alias("paper_id"), "text")
        known = self.read("papers").select("paper_id", F.lit(True).alias("_p"))
        squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
        own = w.where("decision <> ''").join(known, "paper_id", "left").join(docs, "paper_id", "left")
        evidence = F.col("decision").isin("supported", "partial")
        rules = [
            ("unknown_paper", F.col("_p").isNull()), ("unknown_decision", ~F.col("decision").isin(*DECISIONS)), ("value_missing", evidence & (F.trim("value") == "")),
            ("quote_missing", evidence & (F.trim("quote") == "")), ("quote_not_in_text", evidence & (F.trim("quote") != "") & F.col("text").isNotNull() & ~F.contains(squeezed(F.col("text")), squeezed(F.col("quote")))),
        ]
        found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
        return own.select("paper_id", "field", F.explode(found).alias("issue"))

    def status(self) -> DataFrame:
        """decision and n: how far the worksheet is; open rows have the empty decision."""
        return self.read("worksheet").groupBy("decision").agg(F.count("*").alias("n"))

    def adjudicated(self) -> DataFrame:
        """The supported and partial rows that break no rule."""
        bad = self.validate().select("paper_id", "field").distinct()
        return self.read("worksheet").where(F.col("decision").isin("supported", "partial")).join(bad, ["paper_id", "field"], "left_anti")

    # C04, K05-K09
    def export(self, out: str) -> list[str]:
        """Papers, items and summaries as CSV, extractions as JSON lines; the folders written. An existing export isn't overwritten."""
        for name, df, order in (("papers", self.read("papers"), ["paper_id"]), ("items", self.read("items"), ["paper_id", "component", "outcome"]), ("summaries", self.evidence(), ["component", "outcome"])):
            sinks.write_csv(df, f"{out}/{name}", order)
        sinks.write_jsonl(self.read("extractions"), f"{out}/extractions")
        return [f"{out}/{n}" for n in ("papers", "items", "summaries", "extractions")]

    def top_components(self, n: int = 10) -> DataFrame:
        """The components of the most papers."""
        return self.stats().where("measure = 'component'").orderBy(F.desc("n"), "name").limit(n)
