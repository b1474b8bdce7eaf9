"""URL filters with link-graph propagation, by DataFrame functions alone.

Rules judge urls by host and path; the longest that fits wins. For the other urls each host gets two personalised
PageRank values over the host edges of the pages' links: trust flows along links from hosts with allowed urls, distrust
against them from hosts with blocked urls. A host is blocked when its distrust exceeds its trust.

A null url, or one without "://", has an empty host and path; no rule fits it, no host edge leaves it, and it is
allowed. Null html has no links. Repeated rows are judged each (and their links and seeds count each); an empty table
gives no rows. Tables of hosts are never collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, free, written

#: (verdict, rule): a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING, CLOSE = 0.85, 1e-6


def host(url: Column) -> Column:
    """What follows the first "://", up to "/", "?", "#" or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.when(F.locate("://", url) > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end; else empty."""
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def longest_rule(at: Column, way: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits a host and path; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((at == own) | at.endswith("." + own)) & way.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts; a link without a host stays on its own."""
    link = F.explode(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), 1))
    links = pages.select(host(F.col(f"`{url_col}`")).alias("src"), link.alias("link"))
    links = links.select("src", host(F.regexp_replace("link", "^//", "x://")).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust), whose columns each add up to one or zero, and edges (src, dst, n)."""
    edges = written(edges, "edges")
    start = written(seeds.select("host", "trust", "distrust"), "seeds")
    if edges.isEmpty():
        return start
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    along = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"), F.lit("trust").alias("kind"))
    against = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("w"), F.lit("distrust").alias("kind"))
    moves = written(along.unionByName(against), "moves")
    ranks = start
    while True:  # changes shrink by the damping in each round
        given = moves.join(ranks.withColumnRenamed("host", "src"), "src").select("dst", "kind", (F.col("w") * F.when(F.col("kind") == "trust", F.col("trust")).otherwise(F.col("distrust"))).alias("r"))
        gained = given.groupBy(F.col("dst").alias("host")).agg(F.sum(F.when(F.col("kind") == "trust", F.col("r")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("kind") == "distrust", F.col("r")).otherwise(0.0)).alias("d"))
        value = lambda seed, got: (1 - DAMPING) * F.coalesce(seed, F.lit(0.0)) + DAMPING * F.coalesce(got, F.lit(0.0))
        step = start.join(gained, "host", "full").select("host", value(F.col("trust"), F.col("t")).alias("trust"), value(F.col("distrust"), F.col("d")).alias("distrust"))
        old = ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        step = step.join(old, "host", "left").withColumn("change", F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0))) + F.abs(F.col("distrust") - F.coalesce("d0", F.lit(0.0))))
        before, ranks = ranks, written(step.select("host", "trust", "distrust", "change"), "ranks")
        if (ranks.agg(F.sum("change")).first()[0] or 0) < CLOSE:
            return ranks.select("host", "trust", "distrust")
        if before is not start:
            free(before)


def judge(pages: DataFrame, rules=RULES, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, host, path, rule and verdict, allow or block."""
    url = F.col(f"`{url_col}`")
    own = pages.select(F.col(f"`{id_col}`").alias("id"), host(url).alias("host"), path(url).alias("path"))
    own = own.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    hosts = own.where("fit is not null").groupBy("host").agg(F.count_if(F.col("fit")["verdict"] == "allow").alias("a"), F.count_if(F.col("fit")["verdict"] == "block").alias("b"))
    hosts = written(hosts, "hosts")
    every = hosts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    share = lambda n, total: F.col(n) / float(total) if total else F.lit(0.0)
    seeds = hosts.select("host", share("a", every["a"]).alias("trust"), share("b", every["b"]).alias("distrust"))
    ranks = propagate(seeds, host_edges(pages, url_col, html_col))
    blocked = written(ranks.where("distrust > trust").select("host", F.lit(True).alias("bad")), "blocked")
    done = own.join(blocked, "host", "left")
    verdict = F.coalesce(F.col("fit")["verdict"], F.when(F.col("bad"), "block").otherwise("allow"))
    return done.select(F.col("id").alias(id_col), "host", "path", F.col("fit")["rule"].alias("rule"), verdict.alias("verdict"))
