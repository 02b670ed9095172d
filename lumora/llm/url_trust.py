"""URL filters: rules by host and path, and trust that spreads over the graph of hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.session import discard, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
MANY_RULES = 2000


def _rest(url: Column) -> Column:
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; null or no :// is empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_hit(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule's text, or null. A rule `host/path` fits its host and all subdomains."""
    if len(rules) > MANY_RULES:
        raise ValueError("rules are compiled into the plan; split longer lists")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the longest is tested first
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        out = F.when(fits & path.startswith(slash + rest), F.lit(rule)).otherwise(out)
    return out


def _verdict(rule: Column, rules: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str, html: str, parent_weight: float) -> DataFrame:
    """(src, dst, w): links between different hosts, counted by page, and a tie of each host with its parent domain.

    Ties run both ways with parent_weight along the chain of parents; 0 leaves them out. Parents need a dot, so that no
    top-level domain becomes a hub.
    """
    found = pages.where(F.col(host) != "").select(
        F.col(host).alias("src"),
        F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"),
    )
    edges = found.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    if parent_weight > 0:
        parts = F.split(host, r"\.")
        whole = lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")
        steps = F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2))
        own = pages.where(F.col(host) != "").select(host).distinct()
        up = own.select(F.explode(steps).alias("k"), host).select(whole(F.col("k")).alias("src"), whole(F.col("k") + 1).alias("dst")).distinct()
        tie = F.lit(float(parent_weight)).alias("w")
        edges = edges.unionByName(up.select("src", "dst", tie)).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), tie))
        edges = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return edges


def rounds_for(tolerance: float, damping: float) -> int:
    """Rounds after which less than tolerance of the rank is undelivered, whatever the graph: each round leaves damping of it."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, cut_every: int = 6) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of edges(src, dst, w) from seeds(host, good, bad).

    Trust starts from the good seeds and follows links; distrust starts from the bad ones and follows them back.
    Both spread in the same join and sum, until less than tolerance of the rank can still be undelivered. Rank that
    reaches a host without links goes back to the seeds: that only scales all ranks, so each column is scaled to sum 1 at
    the end. All-zero seeds give zero ranks.
    """
    outs = edges.groupBy(F.col("src").alias("h")).agg(F.sum("w").alias("total"))
    ins = edges.groupBy(F.col("dst").alias("h")).agg(F.sum("w").alias("total"))
    ahead = edges.join(outs, F.col("src") == F.col("h")).select("src", "dst", (F.col("w") / F.col("total")).alias("good"), F.lit(0.0).alias("bad"))
    back = edges.join(ins, F.col("dst") == F.col("h")).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("good"), (F.col("w") / F.col("total")).alias("bad")
    )
    flows = settle(ahead.unionByName(back).groupBy("src", "dst").agg(F.sum("good").alias("fg"), F.sum("bad").alias("fb")))
    # most hosts' ranks are spread by few sources at first; the join's sides are aggregated, one row a host and an edge
    start = settle(scaled(seeds).where("good > 0 or bad > 0"))
    now, used = start, []
    for k in range(1, rounds_for(tolerance, damping) + 1):
        moved = now.join(flows, now["host"] == flows["src"]).select(
            F.col("dst").alias("host"),
            (F.col("good") * F.col("fg") * damping).alias("good"),
            (F.col("bad") * F.col("fb") * damping).alias("bad"),
        )
        now = moved.unionByName(start).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        if k % cut_every == 0:
            now = settle(now)
            used.append(now)
    out = settle(scaled(now).select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")))
    discard(flows, start, *used)
    return out


def scaled(ranks: DataFrame) -> DataFrame:
    """ranks(host, good, bad) with both columns divided by their sums; a column without any stays 0."""
    sums = ranks.agg(F.sum("good").alias("sg"), F.sum("bad").alias("sb"))
    part = lambda x, total: F.when(F.col(total) > 0, F.col(x) / F.col(total)).otherwise(0.0).alias(x)
    return ranks.join(F.broadcast(sums)).select("host", part("good", "sg"), part("bad", "sb"))


def judge_urls(
    pages: DataFrame,
    rules: dict[str, str],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    trusted: tuple[str, ...] = (),
    blocked: tuple[str, ...] = (),
    parent_weight: float = 1.0,
    threshold: float = 0.5,
    damping: float = 0.85,
    tolerance: float = 1e-4,
    few: int = 1_000_000,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    A fitting rule decides. Else the host does: it is blocked where its share of distrust in trust plus distrust
    is above threshold (at it, it is allowed); a host that neither reaches is allowed. Seeds: the named hosts, hosts of which rules
    block more than half of the pages (bad), and other hosts with pages that rules allow (good).
    Null urls and urls without :// have empty host and path, take no part in the graph and are allowed; null html has no links.
    Repeated rows are judged alike, and a page that repeats a link counts it once; very long html is searched whole; an empty table gives no
    rows; other columns are not read, whatever their names. Ranks of up to `few` hosts are broadcast to the pages, so that
    the pages of a large host stay where they are; more meet them in a join whose large partitions are split at run time.
    """
    seen = pages.select(
        F.col(id_col).alias("id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        F.col(html_col).alias("html"),
    )
    ruled = seen.withColumn("rule", rule_hit(F.col("host"), F.col("path"), rules))
    told = _verdict(F.col("rule"), rules)
    per_host = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(told == "allow").alias("yes"), F.count_if(told == "block").alias("no")
    )
    bad = (2 * F.col("no") > F.col("n")) | F.col("host").isin(list(blocked))
    good = F.col("host").isin(list(trusted)) | ((F.col("yes") > 0) & ~bad)
    seeds = per_host.select("host", F.when(good, F.col("n")).otherwise(0).cast("double").alias("good"), F.when(bad, F.col("n")).otherwise(0).cast("double").alias("bad"))
    ranks = propagate(settle(host_edges(seen, "host", "html", parent_weight)), seeds, damping, tolerance)
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    near = F.broadcast(ranks) if ranks.count() <= few else ranks
    out = ruled.select("id", "host", "path", "rule").join(near, "host", "left")
    return out.select(
        "id", "host", "path", "rule",
        F.coalesce(_verdict(F.col("rule"), rules), F.when(share > threshold, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
