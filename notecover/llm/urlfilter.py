"""URL filter with link-graph propagation (operator 2), in DataFrame functions only.

Rules on host and path decide first. For the other urls the hosts' link graph decides:
personalised PageRank spreads trust from hosts with allowed pages along the links, and
distrust from hosts with blocked pages against the links (who links to bad hosts is
distrusted). A host is blocked if its distrust exceeds ``threshold`` times its trust, and
allowed otherwise, also if neither reaches it.

Links are counted per pair of hosts before anything is joined, so a page or host with very
many links is a few rows. Relative links stay on their host; a host without links keeps
its mass. The ranks are iterated until no host's rank changes by more than ``tolerance``
of itself, so every host that links lead to has its rank, however far from a seed; if
``max_rounds`` do not settle them, the run fails. Defined cases: a null url, or one without ``://``, has an empty host and path; an
empty host takes no part in the graph and is allowed if no rule fits; null html has no
links; repeated rows are pages of their own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlFilter:
    damping: float = 0.85
    tolerance: float = 1e-9
    max_rounds: int = 1000       # a guard only: ranks that have not settled by then raise
    cut_every: int = 5
    threshold: float = 1.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules: (verdict, host, path). Of rules
    of equal length a blocking one goes first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, s in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(s)
        rule, verdict = F.when(fits, F.lit(h + s)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts, counted. pages(host, html)."""
    target = F.regexp_replace(F.col("link"), "(?i)^href\\s*=\\s*[\"']?\\s*", "")
    scheme = F.lower(F.regexp_extract(target, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    away = target.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//")
    dst = (F.when(away, F.translate(F.regexp_extract(target, "//([^/?#]*)", 1), UPPER, LOWER))
           .when(scheme == "", F.col("host")))
    return (pages.filter("host != ''")
            .select("host", F.explode(F.regexp_extract_all("html", F.lit("(?i)\\bhref\\s*=\\s*(?:\"[^\"]*|'[^']*|[^\\s\"'>]+)"), F.lit(0))).alias("link"))
            .select(F.col("host").alias("src"), dst.alias("dst")).filter("dst != ''")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def propagate(seeds: DataFrame, edges: DataFrame, p: UrlFilter = UrlFilter()) -> DataFrame:
    """(host, trust, distrust) from seeds(host, allowed, blocked) over edges(src, dst, n).

    Both ranks run in one pass: kind 0 along the links, kind 1 against them. What a host
    keeps for itself, r = (1 - d) seed + d (got + keep r), is solved for r and not iterated.
    From there ranks only grow, so a block of rounds that changes none reaches no new host."""
    both = (edges.select(F.lit(0).alias("kind"), "src", "dst", "n")
            .unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")))
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    totals = seeds.agg(F.greatest(F.sum("allowed"), F.lit(1)).alias("a"), F.greatest(F.sum("blocked"), F.lit(1)).alias("b"))
    seed = (hosts.join(seeds, "host", "left").join(F.broadcast(totals))                        # totals: one row
            .select("host", F.explode(F.array(
                F.struct(F.lit(0).alias("kind"), (F.coalesce("allowed", F.lit(0)) / F.col("a")).alias("seed")),
                F.struct(F.lit(1).alias("kind"), (F.coalesce("blocked", F.lit(0)) / F.col("b")).alias("seed")))).alias("s"))
            .select("s.kind", "host", "s.seed"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("own"))
    weight = C.cut_lineage(both.filter("src != dst").join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w")))
    rest = 1 - p.damping * F.coalesce(F.col("own") / F.col("total"), F.lit(1.0))
    seed = C.cut_lineage(seed.join(out.withColumnRenamed("src", "host"), ["kind", "host"], "left").select(
        "kind", "host", ((1 - p.damping) * F.col("seed") / rest).alias("base"), (p.damping / rest).alias("share")))
    rank = before = seed.select("kind", "host", F.col("base").alias("r"))
    for i in range(1, p.max_rounds + 1):
        sent = (rank.withColumnRenamed("host", "src").join(weight, ["kind", "src"])
                .groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("r") * F.col("w")).alias("got")))
        rank = seed.join(sent, ["kind", "host"], "left").select(
            "kind", "host", (F.col("base") + F.col("share") * F.coalesce("got", F.lit(0.0))).alias("r"))
        if i % p.cut_every == 0:
            rank = C.cut_lineage(rank.join(before.withColumnRenamed("r", "was"), ["kind", "host"]))
            if rank.filter(F.abs(F.col("r") - F.col("was")) > p.tolerance * F.col("r")).isEmpty():
                break
            rank = before = rank.select("kind", "host", "r")
    else:
        raise RuntimeError(f"ranks did not settle in {p.max_rounds} rounds")
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("r"))).alias("trust"),
                                    F.sum(F.when(F.col("kind") == 1, F.col("r"))).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], p: UrlFilter = UrlFilter()) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, html)."""
    d = C.only(pages, page_id="bigint", url="string", html="string")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = d.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    ruled = base.drop("html").withColumn("rule", rule).withColumn("by_rule", verdict)
    seeds = ruled.filter("host != ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"),
                                                           F.count_if(F.col("by_rule") == "block").alias("blocked"))
    edges = C.cut_lineage(links(base))
    score = propagate(C.cut_lineage(seeds), edges, p)
    bad = C.cut_lineage(score.filter(F.col("distrust") > p.threshold * F.col("trust")).select("host", F.lit(True).alias("bad")))
    # only the pages without a rule need their host's verdict
    verdict = F.coalesce("by_rule", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
