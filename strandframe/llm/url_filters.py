"""URL filters: rules for hosts and paths, and propagation over the link graph for what no rule covers.
DataFrame operations only.

Method: host edges are the absolute links of all pages, counted by (linking host, linked host). Trust is a
personalised PageRank from seeds that rules allow, along the links; distrust is one from seeds that rules block,
against them, as a page answers for what it links to. A seed weighs as many pages as its rules allow or block.
A host is blocked if its distrust is above ``RATIO`` times its trust and above ``FLOOR`` times an even share
of the seeds' distrust; pages without a rule take the verdict of their host.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; a null
or empty page has no links; links of a host to itself don't count, and what a host without links holds goes
nowhere; repeated rows count as often as they are there; an empty table gives an empty one. Other columns
are passed on, and an input column with the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import ascii_lower, checkpointed, partitions

#: Verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING = 0.85
#: A host is blocked above so many times its trust and above this part of an even share; scores are exact to that part of the latter.
RATIO, FLOOR, EXACT = 1.5, 0.05, 0.1
#: The absolute address that an ``a`` element names.
LINK = r"""(?i)<a\s(?:[^<>]*?[\s"'])?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""


def host_and_path(url: str) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; then up to ``?``, ``#`` or the end."""
    whole = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rest = F.substring(whole, F.locate("://", whole) + 3, F.length(whole))
    rest = F.when(F.locate("://", whole) > 0, rest).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as (text, verdict), else null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("text"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def propagated(edges: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, seed, which sum to 1) over edges (src, dst, n), with at most ``tolerance`` missing in all scores together.

    A round passes on at most ``DAMPING`` times what the round before changed, so what further rounds could still
    change is a geometric sum; rounds go on until that is below the tolerance, however many that takes.
    """
    # The out-weights meet in sums by host, the edges are joined by host: no host's rows are collected.
    share = edges.join(edges.groupBy("src").agg(F.sum("n").alias("out")), "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))
    share = checkpointed(share)
    ranks = seeds.select("host", (F.col("seed") * (1 - DAMPING)).alias("score"))
    if share.isEmpty():
        return ranks
    start = ranks = checkpointed(ranks)
    while True:
        moved = share.join(ranks, share.src == ranks.host).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * DAMPING).alias("score"))
        after = checkpointed(moved.unionByName(start).groupBy("host").agg(F.sum("score").alias("score")))
        change = after.join(ranks.withColumnRenamed("score", "was"), "host", "left").agg(F.sum(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        ranks = after
        if change * DAMPING / (1 - DAMPING) <= tolerance:
            return ranks


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n) of the absolute links of pages."""
    links = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
    return links.select("src", ascii_lower(F.col("dst")).alias("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def filter_urls(pages: DataFrame, url: str = "url", html: str = "html", rules: list[tuple[str, str, str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds host, path, rule (its text, else null), verdict (allow or block), trust and distrust of the host."""
    rules = RULES if rules is None else rules
    made = ["host", "path", "rule", "verdict", "trust", "distrust"]
    kept = [c for c in (pages.columns if keep is None else keep) if c not in made]
    host, path = host_and_path(url)
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("\x00host"), path.alias("\x00path"), F.col(f"`{html}`").alias("\x00html")).withColumn("\x00rule", rule_of(F.col("\x00host"), F.col("\x00path"), rules))
    edges = checkpointed(host_edges(rows, "\x00host", "\x00html"))
    counts = checkpointed(rows.groupBy(F.col("\x00host").alias("host")).agg(F.sum(F.coalesce((F.col("\x00rule.verdict") == "allow").cast("long"), F.lit(0))).alias("allowed"), F.sum(F.coalesce((F.col("\x00rule.verdict") == "block").cast("long"), F.lit(0))).alias("blocked"), F.count(F.lit(1)).alias("rows")))
    totals = counts.agg(F.sum("allowed"), F.sum("blocked"), F.sum((F.col("blocked") > 0).cast("long")), F.sum("rows")).first()
    seeds = lambda c, all_: counts.filter(F.col(c) > 0).select("host", (F.col(c) / F.lit(float(all_ or 1))).alias("seed"))
    even = (1 - DAMPING) / max(1, totals[2] or 0)
    tolerance = EXACT * FLOOR * even
    trust = propagated(edges, seeds("allowed", totals[0]), tolerance).withColumnRenamed("score", "trust")
    distrust = propagated(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds("blocked", totals[1]), tolerance).withColumnRenamed("score", "distrust")
    judged = counts.select("host", F.col("rows").alias("\x00rows")).join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0)
    judged = judged.withColumn("\x00bad", (F.col("distrust") > RATIO * F.col("trust")) & (F.col("distrust") > FLOOR * even))
    judged = checkpointed(judged.withColumnRenamed("host", "\x00host"))
    # Hosts with many rows are few, so that they can be sent to the rows, however many these are.
    large = F.col("\x00rows") * 2 * partitions(pages) > (totals[3] or 0)
    rows, hot = rows.drop("\x00html"), F.broadcast(judged.filter(large))
    met = rows.join(hot, "\x00host").unionByName(rows.join(hot.select("\x00host"), "\x00host", "left_anti").join(judged.filter(~large), "\x00host"))
    own = F.when(F.col("\x00bad"), "block").otherwise("allow")
    return met.select(*[F.col(f"`{c}`") for c in kept], F.col("\x00host").alias("host"), F.col("\x00path").alias("path"), F.col("\x00rule.text").alias("rule"), F.coalesce("\x00rule.verdict", own).alias("verdict"), "trust", "distrust")
