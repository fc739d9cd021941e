"""URL filtering by rules and by empirical-Bayes reputation of hosts, in DataFrame functions alone.

A rule names a host and a path: it fits that host and all its subdomains where
the URL's path starts with the rule's; the longest fitting rule decides. All
other pages get the verdict of their host's reputation: the labelled outcomes
of a host's pages are shrunk through beta-binomial priors, the host towards its
registered domain, that towards its suffix, that towards all pages. How strongly
each level pulls is estimated from how much the groups of that level differ.
A page passes if the lower posterior bound of its host's share of good pages
reaches the threshold.

Rows: a null URL, or one without ://, has an empty host and path, and belongs
to the host of that name. Hosts without labels take their domain's prior.
Pages with a null id have no labels. Several labels of a page count as its
worst. Repeated rows each get their row. Other columns are ignored.

There is no list of public suffixes here: a registered domain is the last two
labels of a host, or three where the last has two letters and the one before
is one of SECOND_LEVEL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds of the pull of a level, in pages.
LEAST_PULL, MOST_PULL = 2.0, 200.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, UPPER, LOWER)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    labels = F.split(host, "[.]")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    keep = F.when(three, 3).otherwise(F.least(n, F.lit(2)))
    domain = F.array_join(F.slice(labels, n - keep + 1, keep), ".")
    suffix = F.when(n == 1, host).otherwise(F.array_join(F.slice(labels, n - keep + 2, keep - 1), "."))
    return domain, suffix


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of its size, text and verdict, or null; of equal ones the first by text."""
    fitting = [
        F.when((F.endswith(F.concat(F.lit("."), host), F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(-len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_min(F.array_compact(F.array(*fitting))) if fitting else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _pull(groups: DataFrame, name: str) -> DataFrame:
    """One row: how many pages the level above counts for, from the variance between groups and within them."""
    sums = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("t"), F.sum("k").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("r"))
    within = F.try_divide(F.col("s") - F.col("r"), F.col("t") - F.col("g"))
    between = F.try_divide(F.col("r") - F.try_divide(F.col("s") * F.col("s"), F.col("t")), F.col("g") - 1)
    size = F.try_divide(F.col("t") - F.try_divide(F.col("q"), F.col("t")), F.col("g") - 1)
    share = F.try_divide(between - within, between + (size - 1) * within)
    pull = F.when((F.col("g") > 1) & (F.col("t") > F.col("g")) & (share > 0), F.least(F.greatest(F.try_divide(1 - share, share), F.lit(LEAST_PULL)), F.lit(MOST_PULL))).otherwise(F.lit(MOST_PULL))
    return sums.select(pull.alias(name))


def reputations(hosts: DataFrame, z: float) -> DataFrame:
    """host and bound, from each host's labelled pages n and good ones k."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = suffixes.agg(((F.sum("k") + 1.0) / (F.sum("n") + 2.0)).alias("mean"))
    one = everything
    for frame, name in ((suffixes, "pull_s"), (domains, "pull_d"), (hosts, "pull_h")):
        one = one.crossJoin(F.broadcast(_pull(frame, name)))  # one row each
    s = suffixes.crossJoin(F.broadcast(one)).select("suffix", ((F.col("k") + F.col("pull_s") * F.col("mean")) / (F.col("n") + F.col("pull_s"))).alias("mean_s"), "pull_d", "pull_h")
    d = domains.join(s, "suffix").select("domain", "suffix", ((F.col("k") + F.col("pull_d") * F.col("mean_s")) / (F.col("n") + F.col("pull_d"))).alias("mean_d"), "pull_h")
    h = hosts.join(d, ["domain", "suffix"])
    a, b = F.col("k") + F.col("pull_h") * F.col("mean_d"), F.col("n") - F.col("k") + F.col("pull_h") * (1 - F.col("mean_d"))
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("host", bound.alias("bound"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict.

    labels: page_id and good (0 or 1). rules: (verdict, host, path), a list
    that is part of the query. The verdict is allow or block.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy(F.col("page_id").alias("l_page")).agg(F.min("good").alias("good"))
    labelled = parsed.join(known, F.col("page_id") == F.col("l_page"), "left")
    hosts = labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    reputation = reputations(hosts, z).select(F.col("host").alias("r_host"), "bound")
    judged = parsed.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).join(reputation, F.col("host") == F.col("r_host"), "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("bound") >= threshold, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
