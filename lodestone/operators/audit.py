"""Audits, probes, worksheets and document views: small relational operators that compose aggregates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse

#: Operators without which nothing can be concluded.
CRITICAL = ("context", "dose", "outcome")


def pass_means(passes: Column) -> Column:
    """Of an array of (grounding, model, at): the mean grounding, the first model and the first time that are there."""
    first = lambda name: F.get(F.filter(F.transform(passes, lambda p: p[name]), lambda x: x.isNotNull()), F.lit(0))
    own = F.filter(F.transform(passes, lambda p: p["grounding"]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), F.size(own))
    return F.struct(mean.alias("grounding"), first("model").alias("model"), first("at").alias("at"))


def critical_open(queue: DataFrame, *, most: int = 16) -> DataFrame:
    """Of a review queue (priority, n, decision): how many critical rows (P1, n up to `most`) there are, and are open."""
    own = queue.where((F.col("priority") == "P1") & (F.col("n") <= most))
    return own.agg(F.count_if(F.coalesce(F.trim("decision"), F.lit("")) == "").alias("open"), F.count("*").alias("total"))


def alignment(rows: DataFrame, *by: str) -> DataFrame:
    """Shares of rows (expected, present, attached) that are covered, present among the expected, attached among the present."""
    share = lambda n, of: F.try_divide(F.count_if(n).cast("double"), F.count_if(of).cast("double"))
    e, p, a = (F.col(c) for c in ("expected", "present", "attached"))
    return rows.groupBy(*by).agg(share(p, F.lit(True)).alias("coverage"), share(e & p, e).alias("presence"), share(p & a, p).alias("attachment"))


def alias_probe(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: recall of gold canonicals (alias, canonical) over all repeats, and the share of aliases that always got one answer."""
    own = answers.join(gold.select("alias", F.col("canonical").alias("_gold")), "alias")
    each = own.groupBy("alias").agg(F.avg((F.col("canonical") == F.col("_gold")).cast("double")).alias("hit"), F.min(F.coalesce("canonical", F.lit(""))).alias("lo"), F.max(F.coalesce("canonical", F.lit(""))).alias("hi"))
    return each.agg(F.avg("hit").alias("recall"), F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("consistency"))


def critical_ready(readiness: DataFrame, *by: str) -> DataFrame:
    """How many critical operators are ready, of (operator, ready)."""
    return readiness.groupBy(*by).agg(F.count_if(F.col("operator").isin(*CRITICAL) & F.col("ready")).alias("n_critical_ready"))


def candidate_order(rows: DataFrame) -> DataFrame:
    """Candidates first, then by papers, direct papers and name."""
    return rows.orderBy(F.desc("candidate"), F.desc("papers"), F.desc("direct"), "component")


def passage_score(text: Column, terms: list[str], domain: list[str], dose: str) -> Column:
    """matched terms + half the domain terms + up to two dose hits."""
    low = F.lower(text)
    has = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return has(terms) + 0.5 * has(domain) + F.least(F.lit(2), F.regexp_count(text, F.lit(dose)))


def rank_passages(passages: DataFrame, of: str, k: int) -> DataFrame:
    """The best k passages (score, start) of each task, ties by start."""
    place = F.row_number().over(Window.partitionBy(of).orderBy(F.desc("score"), "start"))
    return passages.where("score > 0").withColumn("place", place).where(F.col("place") <= k)


def select_context(docs: DataFrame, sections: DataFrame, id_col: str, text_col: str, budget: int, *, head: float = 0.35) -> DataFrame:
    """A text within the budget whole; else its head and then key sections (id, start, end, key) until the budget is used.

    A text without key sections gives its head and its tail.
    """
    text, size = F.col(text_col), F.length(text_col)
    n = int(budget * head)
    spans = sections.where("key").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    df = docs.join(spans, id_col, "left")
    # each section's part after the head, and how much of the budget the earlier ones leave
    parts = F.filter(F.transform("_s", lambda s: F.struct(F.greatest(s["start"], F.lit(n)).alias("start"), s["end"].alias("end"))), lambda s: s["end"] > s["start"])
    none = F.struct(F.lit("").alias("t"), F.lit(budget - n).alias("left"))

    def add(acc: Column, s: Column) -> Column:
        take = F.greatest(F.lit(0), F.least(acc["left"], (s["end"] - s["start"]).cast("int")))
        return F.struct(F.concat(acc["t"], F.substr(text, (s["start"] + 1).cast("int"), take)).alias("t"), (acc["left"] - take).alias("left"))

    key = F.aggregate(parts, none, add)["t"]
    tail = F.substr(text, (size - (budget - n) + 1).cast("int"), F.lit(budget - n))
    out = F.when(size <= budget, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(n)), F.coalesce(key, tail)))
    return df.select(id_col, out.alias("context"))


def document_blob(*fields: Column) -> Column:
    """A paper's searchable text: its fields by line, empty ones left out."""
    return F.concat_ws("\n", *[F.nullif(F.trim(f), F.lit("")) for f in fields])


def canonical_json(values: Column) -> Column:
    """A list as JSON text, sorted, each value once."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


def page_excerpt(blocks: Column, signal: str, most: int) -> Column:
    """The first block and those with the signal, each once, cut at `most` characters."""
    kept = F.array_distinct(F.concat(F.slice(blocks, 1, 1), F.filter(blocks, lambda b: b.rlike(signal))))
    return F.substring(F.array_join(kept, "\n"), 1, most)


def field_guide(schema) -> str:
    """A schema as the lines of a prompt: name, type, and what its metadata says."""
    return "\n".join(f"- {f.name} ({f.dataType.simpleString()}){': ' + f.metadata['comment'] if f.metadata.get('comment') else ''}" for f in schema.fields)


def query_text(weights: dict[str, float], *context: str) -> str:
    """A retrieval query: objectives by weight, then the context."""
    by_weight = [name.replace("_", " ") for name, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])) if w > 0]
    return " ".join([*by_weight, *(c for c in context if c)])


def beyond(strict: DataFrame, broad: DataFrame, key: str) -> DataFrame:
    """Keys of the strict set that the broad one lacks: empty when it holds."""
    return strict.select(key).distinct().join(broad.select(key), key, "left_anti")


def partition_faults(source: DataFrame, outputs: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that are in no output, in several, or in one without being in the source; empty when the partition is exact."""
    placed = None
    for name, frame in outputs.items():
        own = frame.select(key, F.lit(name).alias("_in"))
        placed = own if placed is None else placed.unionAll(own)
    n = placed.groupBy(key).agg(F.count("*").alias("n"))
    both = source.select(key, F.lit(True).alias("_there")).join(n, key, "full")
    fault = F.when(F.col("_there").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def gold_review(papers: DataFrame, fields: list[str]) -> DataFrame:
    """A worksheet row for each paper and field: an array of the fields is exploded, so nothing is joined."""
    names = F.posexplode(F.array(*map(F.lit, fields))).alias("position", "field")
    return papers.select("*", names).withColumn("decision", F.lit("")).withColumn("value", F.lit("")).withColumn("quote", F.lit(""))


def review_state(sheet: DataFrame, *by: str) -> DataFrame:
    """Of each paper's rows (decision, value, quote): open ones, decided ones that lack a value or quote, and whether all is ready."""
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    done = F.count_if(said("decision"))
    faulty = F.count_if((F.col("decision") == "present") & ~(said("value") & said("quote")))
    return sheet.groupBy(*by).agg(F.count_if(~said("decision")).alias("open"), done.alias("decided"), faulty.alias("faulty")).withColumn("ready", (F.col("open") == 0) & (F.col("faulty") == 0))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that an index would hold twice."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def identity_gate(found: DataFrame) -> DataFrame:
    """Of acquired papers (expected_doi, doi, expected_id, id, licence): the checks that fail, and whether the paper may be kept."""
    doi = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    checks = [
        F.when(doi("expected_doi") != doi("doi"), "doi_mismatch"),
        F.when(F.col("expected_id").isNotNull() & ~F.col("expected_id").eqNullSafe(F.col("id")), "id_mismatch"),
        F.when(F.coalesce(F.col("licence"), F.lit("")) == "", "no_licence"),
    ]
    failed = F.array_compact(F.array(*checks))
    return found.withColumn("failed", F.array_join(failed, ";")).withColumn("kept", F.size(failed) == 0)


def space_filling(spark, n: int, dims: int, *, seed: int = 0) -> DataFrame:
    """N seeded points, one in each of n equal steps of every dimension: point i's step is (i * a + b) mod n with a prime to n."""
    from math import gcd

    i = F.col("id")
    out = []
    for d in range(dims):
        a = next(x for x in range(max(1, int(n * (0.381966 + 0.1 * d) % max(n, 1))), 2 * n + 2) if gcd(x, n) == 1)
        jitter = F.pmod(F.xxhash64(i, F.lit(seed), F.lit(d)), F.lit(1 << 20)) / float(1 << 20)
        out.append(((F.pmod(i * a + seed + d, F.lit(n)) + jitter) / n).alias(f"x{d}"))
    return spark.range(n).select(F.col("id").alias("i"), *out)


def top_components(mentions: DataFrame, *, per_role: int, most: int, least_papers: int = 1) -> DataFrame:
    """A design space: of (role, component, paper_id) the components with the most papers, so many a role, and in all."""
    counted = mentions.groupBy("role", "component").agg(F.countDistinct("paper_id").alias("papers")).where(F.col("papers") >= least_papers)
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("papers"), "component"))).where(F.col("place") <= per_role)
    return ranked.orderBy("place", F.desc("papers"), "role", "component").limit(most)


def closest_form(form: Column, candidates: Column) -> Column:
    """The first candidate (an array of maps) with all the form's entries, else the first one."""
    same = F.filter(candidates, lambda c: F.map_entries(c) == F.map_entries(form))
    return F.coalesce(F.get(same, F.lit(0)), F.get(candidates, F.lit(0)))


def derived_rows(extractions: DataFrame, list_col: str) -> DataFrame:
    """Rows derived from stored extractions, always those of the newest version of a paper: what an upsert replaces is gone with it."""
    newest = extractions.groupBy("paper_id").agg(F.max_by(list_col, "version").alias(list_col))
    return newest.select("paper_id", F.posexplode(list_col).alias("n", "value"))


def repeat_fractions(selected: DataFrame, total: int) -> DataFrame:
    """The share of a total that each repeat selected, of (repeat, id)."""
    return selected.groupBy("repeat").agg((F.countDistinct("id") / F.lit(total)).alias("fraction"))


def source_payload(payload: Column) -> Column:
    """A bibliographic service's answer as (doi, title, licences, links): names differ by service, DOIs are compared in lower case."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(payload, p) for p in paths])
    lists = lambda *paths: F.coalesce(*[F.from_json(F.get_json_object(payload, p), "array<string>") for p in paths], F.array().cast("array<string>"))
    return F.struct(
        F.lower(F.trim(get("$.DOI", "$.doi"))).alias("doi"),
        collapse(get("$.title[0]", "$.title")).alias("title"),
        F.array_sort(F.array_distinct(lists("$.license[*].URL", "$.licenses"))).alias("licences"),
        lists("$.link[*].URL", "$.links").alias("links"),
    )
