"""URL filter: rules first, and for pages that no rule fits, trust and distrust propagated over the graph of hosts.

Hosts with pages that a rule allows or blocks are the seeds, weighted by their numbers of such pages. Trust is a personalised
PageRank from the allowed seeds along links; distrust is one from the blocked seeds against the links, from a page to those
that link to it. Besides hyperlinks, a host is joined to its parent domain in both directions, up to the domain that someone can
register, so that a subdomain without any link still takes part and hosts of different owners don't. A host is blocked when its
distrust has at least `threshold` of the two scores. In the graph a host is a name without user and port, by which links and
pages meet; the host column of the result is as it stands in the url.

The graph has a row per pair of hosts, summed over pages before any shuffle; an iteration is one join and one aggregate that
is combined before its shuffle, for both scores at once. What a round leaves to be passed on is `damping` of what it got, so rounds
end when that is below `tolerance`: a number of rounds that no graph can raise. Scores are broadcast while they are few; beyond that
the edges of a host with many are dealt by a salt, and its score is copied for each. Neither edges nor scores go to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import release, settled
from .common import stored

#: Share of a score that may be left to be passed on, and share of it that each round passes on.
TOLERANCE, DAMPING = 1e-4, 0.85
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts whose scores are broadcast at most (some 60 bytes each), edges from which a host's are dealt anew, and in how many parts.
BROADCAST_HOSTS, CROWDED, SALTS = 500_000, 100_000, 64
#: Edges (some 100 bytes each) of a graph that one task goes through in every round, which then moves nothing.
SMALL = 500_000
#: Second labels under which country domains register names.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "ne", "or", "org")
#: The host of an absolute or protocol-relative link.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def _rest(url: str) -> Column:
    return F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))


def host_of(url: str) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; of rules of one length a blocking one. Null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(host: str) -> Column:
    """A host's name in the graph: without user and port, A-Z lower-cased."""
    return F.translate(F.regexp_replace(F.col(host), r"^[^@]*@|:\d*$", ""), _UPPER, _LOWER)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) of pages (host, html): pages of src that link to dst, and one each way between a host and its parent domain.

    Parents end at the domain that can be registered: two labels, or three under a country's second label such as co.uk. Numbers as a
    host have no parent.
    """
    links = pages.where("host != ''").select(node_of("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("to"))
    linked = links.select("src", node_of("to").alias("dst")).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    names = pages.where("host != ''").select(node_of("host").alias("host")).distinct()
    short = F.when((F.length(F.element_at("l", -1)) == 2) & F.element_at("l", F.when(F.size("l") > 1, -2).otherwise(-1)).isin(*SECOND), 3).otherwise(2)
    chain = F.transform(F.sequence(F.lit(1), F.size("l") - F.col("short")), lambda i: F.struct(F.array_join(F.slice("l", i, F.size("l")), ".").alias("a"), F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("b")))
    named = names.withColumn("l", F.split("host", r"\.")).withColumn("short", short).where("size(l) > short").where(~F.col("host").rlike(r"^[\d.]+$"))
    parents = named.select(F.inline(chain).alias("a", "b")).distinct()
    up = parents.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))), F.lit(1.0).alias("weight"))
    return linked.unionByName(up).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def rounds_for(tolerance: float, damping: float) -> int:
    """Rounds after which at most `tolerance` of a score is still to be passed on."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust), each summing to at most 1. seeds: host, allowed, blocked (page counts); edges: src, dst, weight."""
    allowed, blocked = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    start = seeds.select("host", (F.col("allowed") / (allowed or 1)).alias("s"), (F.col("blocked") / (blocked or 1)).alias("z"))
    start = stored(start.where("s > 0 or z > 0"))
    # stored, so that joins with a host that has most of the edges are between plain exchanges and can be split
    out, into = (stored(edges.groupBy(side).agg(F.sum("weight").alias("total"))) for side in ("src", "dst"))
    forth = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("f"), F.lit(0.0).alias("b"))
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("f"), (F.col("weight") / F.col("total")).alias("b"))
    steps = settled(forth.unionByName(back).groupBy("host", "to").agg(F.sum("f").alias("f"), F.sum("b").alias("b")))
    degrees = stored(steps.groupBy("host").agg(F.count("*").alias("n")))
    hosts, n_steps = degrees.agg(F.count("*"), F.sum("n")).first()
    few, small = hosts <= BROADCAST_HOSTS, (n_steps or 0) <= SMALL
    small = small and few
    if small:
        steps = settled(steps.coalesce(1))
    elif not few:
        steps = steps.join(degrees, "host").withColumn("salts", F.when(F.col("n") > CROWDED, SALTS).otherwise(1))
        steps = settled(steps.withColumn("salt", F.pmod(F.xxhash64("to"), "salts").cast("int")).select("host", "salt", "to", "f", "b"))
    base = start.select("host", (F.col("s") * (1 - damping)).alias("t"), (F.col("z") * (1 - damping)).alias("d"))
    alone = base.join(degrees, "host", "left_anti")  # seeds without an edge keep what they have
    scores = start.join(degrees, "host", "left_semi").select("host", F.col("s").alias("t"), F.col("z").alias("d"))
    base = base.join(degrees, "host", "left_semi")
    base, scores = (settled(x.coalesce(1)) if small else x for x in (base, scores))
    for i in range(rounds_for(tolerance, damping)):
        if few:  # every host with a score has edges, so their number bounds what is broadcast
            joined = F.broadcast(scores).join(steps, "host")
        else:
            salts = F.when(F.col("n") > CROWDED, SALTS).otherwise(1)
            joined = settled(scores.join(degrees, "host").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))).join(steps, ["host", "salt"])
        moved = joined.select(F.col("to").alias("host"), (damping * F.col("t") * F.col("f")).alias("t"), (damping * F.col("d") * F.col("b")).alias("d"))
        both = moved.unionByName(base)
        scores = (both.coalesce(1) if small else both).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        if i % 4 == 3 or not few:
            scores = settled(scores)
        if i % 16 == 15:
            release(seeds.sparkSession)
    return scores.unionByName(alone).select("host", F.round("t", 15).alias("trust"), F.round("d", 15).alias("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tolerance: float = TOLERANCE, threshold: float = 0.5) -> DataFrame:
    """One row per row of `pages`: id_col, host, path, rule (its text, else null), verdict (allow or block), trust, distrust.

    The longest rule that fits decides. Else the host's scores do: block where distrust >= threshold * (trust + distrust) and
    distrust > 0; a host that neither score reaches is allowed, and so is an empty host (a null url, or one without `://`). Null
    html has no links. Repeated rows are judged alike; other columns are ignored; an empty table gives an empty result. At most
    200 rules: they are one expression.
    """
    if len(rules) > 200:
        raise ValueError("more than 200 rules")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = source.select("id", "html", host_of("url").alias("host"), path_of("url").alias("path")).withColumn("r", rule_of("host", "path", rules))
    counts = lambda v: F.sum(F.when(F.col("r.verdict") == v, 1).otherwise(0))
    hosts = stored(parsed.where("host != ''").groupBy("host").agg(counts("allow").alias("allowed"), counts("block").alias("blocked")))
    seeds = hosts.groupBy(node_of("host").alias("host")).agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).where("host != ''")
    scores = propagate(seeds, stored(host_edges(parsed)), tolerance)
    # one row per host that has pages; stored, so that the join below is between plain exchanges and a hot host can be split
    judged = stored(hosts.select("host", node_of("host").alias("node")).join(scores.withColumnRenamed("host", "node"), "node").drop("node"))
    by_host = F.when((F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))), "block").otherwise("allow")
    return parsed.drop("html").join(judged, "host", "left").select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
