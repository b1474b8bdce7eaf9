"""Command line.

Over a user's own files: `lodestone ingest STORE FOLDER`, then `triage`, `extract`, `stats`, `evidence`, `evidence-audit`,
`extraction-readiness`, `adjudication-template`, `adjudication-validate`, `adjudication-status`, `adjudication-export`,
`export` on the STORE. A model client is named as module:factory. Over the driver's tables: `list`, `run|schema|explain
QUERY TABLES`, `demo VERB TABLES`, `smoke TABLES`.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession


#: What a demonstration of a verb reports, as the queries that it runs: C03-C16.
VERBS = {
    "extract": ("l04_block_extraction", "l05_operator_extraction", "x09_evidence_rows"),
    "export": ("k05_csv_round_trip", "k08_jsonl_round_trip"),
    "review-packet": ("l13_review_packet",),
    "adjudication-template": ("g04_gold_review", "l13_review_packet"),
    "adjudication-passages": ("g03_passage_previews",),
    "design": ("r05_query_text", "r01_bm25_top", "l07_verified_changes"),
    "stats": ("a02_stats", "a01_component_counts"),
    "evidence": ("m04_evidence_synthesis", "w05_best_belief", "m05_tiers"),
    "evidence-audit": ("a05_component_audit", "g06_go_no_go", "a06_critical_open"),
    "extraction-readiness": ("l06_readiness", "a24_critical_ready"),
    "adjudication-validate": ("g01_constraint_issues",),
    "adjudication-status": ("a15_decision_histogram", "a16_status_counts"),
    "adjudication-export": ("g02_export_valid", "l17_repeated_keys"),
    "optimize": ("o05_space_filling", "o09_propose_batch", "o10_ask"),
}


def report(spark, verb: str, tables: str, out: str | None) -> None:
    """Run a verb's queries; each is shown, or written as CSV with its name."""
    from lodestone import catalog
    from lodestone.sources.sinks import flat

    for name in VERBS[verb]:
        df = catalog.QUERIES[name](spark, tables)
        if out:
            flat(df).write.mode("errorifexists").csv(f"{out}/{name}", header=True, lineSep="\n", emptyValue="", quote='"', escape='"')
        else:
            print(name)
            df.show(10, truncate=80)


def client(name: str):
    """The factory that module:factory names."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)


def rows(df, out: str | None) -> None:
    from lodestone.sources.sinks import flat

    if out:
        flat(df).write.mode("errorifexists").csv(out, header=True, lineSep="\n", emptyValue="", quote='"', escape='"')
    else:
        df.show(50, truncate=80)


#: C01-C14 over a store: what each verb takes besides the store, and what it does.
STORE_VERBS = {
    "init": ((), lambda s, a: print(f"{s.path}: nothing is written before the first ingest")),
    "ingest": (("folder", "--force"), lambda s, a: print(json.dumps(s.ingest(a.folder, force=a.force)))),
    "triage": (("--client",), lambda s, a: print(s.triage(client(a.client)))),
    "extract": (("--client", "--guides", "--tiers"), lambda s, a: print(s.extract(client(a.client), json.loads(a.guides or "{}"), tiers=tuple(filter(None, (a.tiers or "").split(",")))))),
    "stats": (("--out",), lambda s, a: rows(s.stats(), a.out)),
    "evidence": (("--out",), lambda s, a: rows(s.evidence(), a.out)),
    "evidence-audit": (("--out",), lambda s, a: rows(s.evidence_audit(), a.out)),
    "extraction-readiness": (("--terms", "--out"), lambda s, a: rows(s.readiness(json.loads(a.terms or "{}")), a.out)),
    "adjudication-template": (("--fields", "--force"), lambda s, a: print(s.template((a.fields or "").split(","), force=a.force))),
    "adjudication-validate": (("--out",), lambda s, a: rows(s.validate(), a.out)),
    "adjudication-status": (("--out",), lambda s, a: rows(s.status(), a.out)),
    "adjudication-export": (("--out",), lambda s, a: rows(s.adjudicated(), a.out)),
    "export": (("folder",), lambda s, a: print("\n".join(s.export(a.folder)))),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    sub = parser.add_subparsers(dest="verb", required=True)
    for verb, (arguments, _) in STORE_VERBS.items():
        p = sub.add_parser(verb)
        p.add_argument("store")
        for a in arguments:
            p.add_argument(a, **({"action": "store_true"} if a == "--force" else {}))
    sub.add_parser("list")
    sub.add_parser("smoke").add_argument("tables")
    for verb in ("run", "schema", "explain"):
        p = sub.add_parser(verb)
        p.add_argument("query")
        p.add_argument("tables")
        if verb == "run":
            p.add_argument("--out")
            p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    p = sub.add_parser("demo")
    p.add_argument("what", choices=sorted(VERBS))
    p.add_argument("tables")
    p.add_argument("--out")
    args = parser.parse_args(argv)
    from lodestone import catalog

    if args.verb == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args.verb == "smoke":  # C18: every verb once, end to end, with the mock client
        for verb, names in VERBS.items():
            print(verb, *[f"{name}={catalog.QUERIES[name](spark, args.tables).count()}" for name in names])
        return 0
    if args.verb in STORE_VERBS:
        from lodestone.store import Store

        STORE_VERBS[args.verb][1](Store(spark, args.store), args)
        return 0
    if args.verb == "demo":
        report(spark, args.what, args.tables, args.out)
        return 0
    df = catalog.QUERIES[args.query](spark, args.tables)
    if args.verb == "schema":
        print(df.schema.json())
    elif args.verb == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.format(args.format).option("header", True).save(args.out)
    else:
        df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
