"""URL filtering by rules and by a tree of path templates for each host.

Paths become templates level by level: a segment that is a number or a long code is a wildcard by its form, and a level
below one parent whose segments are many and mostly rare becomes one by statistics. In the tree of a host's templates,
branches of a node with the same templates below and bad shares that cannot be told apart are merged, and each node's share
of labelled bad urls is smoothed towards its parent's, up to the host and the whole. A template is rejected when what it
comes to reaches the threshold; so branches without labelled urls are judged by what is known of their like: on the host by
their parents, and on other hosts by the labels of the same template, which shift the odds.

Only the counts of templates go from level to level, so a host with any share of the urls costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.shared import cut, split_join

#: The rules of the production query, as (host, path) texts.
ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")

#: A level is variable if it has so many segments and they have fewer than this many urls each on average.
MANY, RARE = 16, 4
PRIOR, THRESHOLD = 2.0, 0.5
#: A branch is like its parent unless their bad shares lie more standard errors apart.
APART = 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path; both are empty where the url is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    out = pages.withColumn("_rest", rest).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    return (out.withColumn("host", F.translate("_host", _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)).drop("_rest", "_host"))


def ruled(parsed: DataFrame, allow=ALLOW, block=BLOCK) -> DataFrame:
    """``parsed`` with ``rule``, the longest that fits host and path (or null), and ``ruled``: allow, block or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, kind in sorted([(t, "allow") for t in allow] + [(t, "block") for t in block], key=lambda r: len(r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return parsed.withColumn("rule", rule).withColumn("ruled", verdict)


def _form():
    """Path segments with numbers and codes as wildcards; a file ending stays."""
    low = F.translate("path", _UPPER, _LOWER)
    seg = F.filter(F.split(low, "/"), lambda s: s != "")
    return F.transform(seg, lambda s: F.regexp_replace(s, r"^(\d+|[0-9a-f]{8,}|[0-9a-f-]{32,36})(?=\.[a-z]{1,5}$|$)", "*"))


def _ahead(rows: DataFrame) -> DataFrame:
    """``rows`` (node, tail, ...) with what their node has: k rows, and ``common``, the number of levels at which all their
    tails are the same (the least and the greatest of sorted paths share what all of them share)."""
    same = F.zip_with("_lo", "_hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
    apart = F.array_position(same, False).cast("int")
    common = F.when(apart > 0, apart - 1).otherwise(F.size("_lo"))
    nodes = rows.groupBy("node").agg(F.count("*").alias("k"), F.min("tail").alias("_lo"), F.max("tail").alias("_hi"))
    return rows.join(nodes.select("node", "k", common.alias("common")), "node")


def _from(path: str, level):
    """A path without its first ``level`` levels."""
    return F.slice(path, level + F.lit(1), F.greatest(F.size(path) - level, F.lit(0)))


def templates(counted: DataFrame) -> DataFrame:
    """``counted`` (host, seg, n, any others; one row each) with template: the statistical wildcards of every level applied.

    Nodes with fewer paths than MANY have no variable level below, and levels at which a node's paths are all the same are
    passed in one step; so rounds are as many as there are branchings one below the other, whatever the length of a path.
    """
    done = counted.limit(0).withColumn("template", F.col("seg"))
    t = cut(counted.withColumn("template", F.array().cast("array<string>")).withColumn("node", F.xxhash64("host")).withColumn("tail", F.col("seg")))
    while not t.isEmpty():
        t = cut(_ahead(t))
        branching = (F.col("k") >= MANY) & (F.size("tail") > F.col("common"))
        done = done.unionByName(t.filter(~branching).withColumn("template", F.concat("template", "tail")).select(*counted.columns, "template"))
        live = t.filter(branching).withColumn("here", F.get("tail", F.col("common"))).withColumn("template", F.concat("template", F.slice("tail", F.lit(1), F.col("common"))))
        fan = live.groupBy("node", "here").agg(F.sum("n").alias("n")).groupBy("node").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
        wide = fan.select("node", ((F.col("k") >= MANY) & (F.col("all") < RARE * F.col("k"))).alias("wide"))
        live = live.join(wide, "node").withColumn("template", F.concat("template", F.array(F.when(F.col("wide"), F.lit("*")).otherwise(F.col("here")))))
        live = live.withColumn("tail", _from("tail", F.col("common") + 1)).withColumn("node", F.xxhash64("host", "template"))
        t = cut(live.select(*counted.columns, "template", "node", "tail"))
    return done


def _odds(p):
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def purities(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``counts`` (host, template, n, l, b) with purity, the smoothed share of bad urls among labelled ones.

    ``n`` urls have a template, ``l`` of them a label, ``b`` a bad one. Every node of a host's tree is smoothed towards its
    parent, a host towards the share of known bad ones among all urls. From the top down, branches of a node with the same
    templates below are merged if their bad share is like the node's; those above it, and those below it, are merged too.
    Last, what the same template is on other hosts shifts the odds of a template, the less the more labels it has itself: so
    branches of one host without labels of their own are told apart. Rounds are as in :func:`templates`.
    """
    all_ = counts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    whole = (all_["b"] or 0) / all_["n"] if all_["n"] else 0.0
    smooth = lambda towards: (F.col("b") + F.lit(prior) * towards) / (F.col("l") + F.lit(prior))
    # ``steps`` levels with the same labels below, one after the other.
    fall = lambda p, l, b, steps: F.when(l == 0, p).otherwise(b / l + (p - b / l) * F.pow(F.lit(prior) / (l + prior), steps))  # noqa: E731, E741
    hosts = counts.groupBy("host").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).select("host", smooth(F.lit(whole)).alias("purity"))
    t = cut(counts.join(hosts, "host").withColumn("node", F.xxhash64("host")).withColumn("tail", F.col("template")))
    columns = [*counts.columns, "purity"]
    done = t.limit(0).select(columns)
    while not t.isEmpty():
        t = _ahead(t)
        below = t.groupBy("node").agg(F.sum("l").alias("_l"), F.sum("b").alias("_b"))
        t = t.join(below, "node").withColumn("purity", fall(F.col("purity"), F.col("_l"), F.col("_b"), F.col("common"))).withColumn("tail", _from("tail", F.col("common")))
        t = cut(t.select(*columns, "node", "tail"))
        done = done.unionByName(t.filter(F.size("tail") == 0).select(columns))
        live = t.filter(F.size("tail") > 0).withColumn("branch", F.get("tail", F.lit(0))).withColumn("tail", _from("tail", F.lit(1)))
        kinds = live.groupBy("node", "purity", "branch", F.xxhash64("tail").alias("below")).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
        branches = kinds.groupBy("node", "purity", "branch").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.sum(F.col("below").cast("decimal(38,0)")).alias("form"))
        off, error = smooth(F.col("purity")) - F.col("purity"), F.sqrt(smooth(F.col("purity")) * (1 - smooth(F.col("purity"))) / (F.col("l") + prior))
        side = F.when(F.abs(off) <= APART * error, 0).otherwise(F.signum(off)).cast("int")
        branches = cut(branches.withColumn("side", side).withColumn("child", F.xxhash64("node", "form", "side")))
        pooled = branches.groupBy("child").agg(F.first("purity").alias("purity"), F.sum("l").alias("l"), F.sum("b").alias("b")).select("child", smooth(F.col("purity")).alias("new"))
        named = branches.join(pooled, "child").select("node", "branch", "child", "new")
        t = cut(live.join(named, ["node", "branch"]).withColumn("purity", F.col("new")).withColumn("node", F.col("child")).select(*columns, "node", "tail"))
    done = cut(done)
    everywhere = done.groupBy("template").agg(F.sum("l").alias("_l"), F.sum("b").alias("_b"))
    others = (F.col("_b") - F.col("b") + F.lit(prior) * whole) / (F.col("_l") - F.col("l") + F.lit(prior))
    shift = (_odds(others) - _odds(F.lit(whole))) * F.lit(prior) / (F.col("l") + F.lit(prior))
    return done.join(everywhere, "template").withColumn("purity", F.when(shift == 0, F.col("purity")).otherwise(1 / (1 + F.exp(-_odds(F.col("purity")) - shift)))).select(columns)


def judge(pages: DataFrame, labelled, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` (with host and path) with template, purity and rejected.

    ``labelled`` is a column over host and path (and rules): 1 for a bad url, 0 for a good one, null without a label. A
    null or malformed url has empty host and path and is one template.
    """
    rows = pages.withColumn("y", labelled).withColumn("seg", _form())
    shape = cut(templates(cut(rows.groupBy("host", "seg").agg(F.count("*").alias("n"), F.count("y").alias("l"), F.coalesce(F.sum("y"), F.lit(0)).alias("b")))))
    counts = shape.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "l", "b")])
    known = purities(cut(counts), prior).select("host", "template", "purity", (F.col("purity") >= threshold).alias("rejected"))
    known = cut(shape.select("host", "seg", "template", "n").join(known, ["host", "template"])
                .select(F.xxhash64("host", "seg").alias("_u"), "n", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", "rejected"))
    return split_join(rows.withColumn("_u", F.xxhash64("host", "seg")), known, "_u", "n").drop("y", "seg", "_u", "n")


def filter_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity.

    The verdict is the rule's where one fits; elsewhere the template's, learned from the urls that rules decide. Equal
    rows are judged alike, each returned; other columns are dropped.
    """
    rows = ruled(parse(pages.select("page_id", url), url))
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    out = judge(rows, label)
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
