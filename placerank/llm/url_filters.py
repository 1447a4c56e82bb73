"""URL filters: host rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix.  From the suffix down every
level is a beta-binomial whose prior has the posterior mean of the level above; its weight is estimated by the method of
moments from how much the groups of that level differ, and lessened by what the level above does not know itself.  A page without a rule is blocked if the lower bound of its host's
posterior bad rate is above a limit, so hosts with few or no labelled pages are judged by their domain and suffix.

Nulls, odd rows: a null url, or one without `://`, has an empty host and path, and empty hosts are one host.  Outcomes count
once for a page_id (bad if any of its rows says so), for each of the pages that carry it; outcomes without page_id or
verdict count nothing.  Repeated pages give repeated rows.  Without any outcome no page is blocked by reputation.  Other
columns of the inputs are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.llm.common import attach, attach_counted, materialise, small

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of more than one label under which names are registered; any other host's suffix is its last label.
SUFFIXES = ("example.com", "example.net", "example.org")
#: A page is blocked if mean - DEVIATIONS * standard deviation of the posterior bad rate is above LIMIT.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Bounds of the share of variance between groups (1 / (1 + prior weight)): prior weights from 1 to 999.
LEAST_SHARE, MOST_SHARE = 0.001, 0.5


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain (the suffix and one label more) of a host without user and port.

    An address of digits, or a host that is no longer than its suffix, is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    suffix = F.substring_index(name, ".", -1)
    for s in sorted(suffixes, key=lambda s: s.count(".")):
        suffix = F.when((name == s) | name.endswith("." + s), F.lit(s)).otherwise(suffix)
    suffix = F.when(name.rlike(r"^[0-9.]+$"), name).otherwise(suffix)
    labels = F.length(suffix) - F.length(F.replace(suffix, F.lit("."), F.lit(""))) + 2
    domain = F.when(name == suffix, name).otherwise(F.concat_ws(".", F.slice(F.split(name, "[.]"), -labels, labels)))
    return suffix, domain


def _posterior(table: DataFrame, prior: Column, above: Column) -> DataFrame:
    """The table (n, bad) with `mean` and `weight` of its posterior bad rate; `prior` is the mean expected for each row and
    `above` the weight with which the level above knows it.

    With share r of the variance between groups, E (bad - n p)^2 = n p (1 - p) (1 + (n - 1) r).  A prior of weight w has
    the variance p (1 - p) / (w + 1): that between groups and that of the mean above are added."""
    p = F.col("_p")
    table = table.withColumn("_p", prior)
    over = F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) - F.col("n") * p * (1 - p)) / F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    found = table.where("n > 1").agg(over.alias("share")).first().share
    share = min(max(found if found is not None else LEAST_SHARE, LEAST_SHARE), MOST_SHARE)
    table = table.withColumn("_w", 1 / (share + 1 / (above + 1)) - 1)
    mean = (F.col("_w") * p + F.col("bad")) / (F.col("_w") + F.col("n"))
    return table.withColumn("mean", mean).withColumn("weight", F.col("_w") + F.col("n")).drop("_p", "_w")


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per host of `pages` (page_id, url): host, pages, n (labelled), bad, mean, weight and `bound` of its bad rate.

    `outcomes` has page_id and a boolean `bad`.  A hot host is one partial sum per task."""
    told = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("_bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(told, "page_id", "left")
    counts = seen.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count("_bad").alias("n"), F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0)).alias("bad")
    )
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = materialise(counts.withColumn("suffix", suffix).withColumn("domain", domain))
    domains = hosts.groupBy("suffix", "domain").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialise(domains)
    tops = materialise(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("domains"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    every = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    tops = _posterior(tops, F.lit(((every.bad or 0) + 1) / ((every.n or 0) + 2)), F.lit((every.n or 0) + 2.0))
    tops = tops.select("suffix", "domains", F.col("mean").alias("_mean"), F.col("weight").alias("_weight"))
    domains = _posterior(attach_counted(domains, tops, "suffix", "domains"), F.col("_mean"), F.col("_weight"))
    domains = domains.select("domain", "hosts", F.col("mean").alias("_mean"), F.col("weight").alias("_weight"))
    hosts = _posterior(attach_counted(hosts, domains, "domain", "hosts"), F.col("_mean"), F.col("_weight"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return hosts.select("host", "pages", "n", "bad", "mean", "weight", (F.col("mean") - DEVIATIONS * deviation).alias("bound"))


def with_rules(hosts: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The hosts with an array `_rules` of the rules that their names fit, whatever the path: (size, rule, path, verdict).

    Only as many end labels of a host are looked up as the longest rule has, by a join with the table of rules."""
    spark = hosts.sparkSession
    rows = [(h.lower(), h.lower() + p, p, v) for v, h, p in rules]
    table = spark.createDataFrame(rows, "_rule_host string, rule string, _path string, verdict string")
    labels = max((h.count(".") + 1 for h, *_ in rows), default=1)
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    fits = hosts.select("host", F.explode(ends).alias("_rule_host")).join(small(table), "_rule_host")
    rule = F.struct(F.length("rule").alias("size"), "rule", F.col("_path").alias("path"), "verdict")
    return attach(hosts, fits.groupBy("host").agg(F.collect_list(rule).alias("_rules")), ["host"], "left")


def url_verdicts(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url), and `bad_bound`, the bound of its host.

    The longest fitting rule decides (of equal rules a block); else the reputation does."""
    hosts = materialise(with_rules(host_reputation(pages, outcomes, suffixes), rules).select("host", "pages", "bound", "_rules"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = attach_counted(rows, hosts, "host", "pages")
    path = F.col("path")
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(path, r["path"])))
    rows = rows.withColumn("_best", best)
    by_host = F.when(F.col("bound") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", by_host).alias("verdict"),
        F.round("bound", 6).alias("bad_bound"),
    )


def bad_pages(labels: DataFrame) -> DataFrame:
    """Outcomes from labels (doc_id, quality, toxic) of the pages with these ids: bad if of low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
