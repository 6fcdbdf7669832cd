"""URL filters: explicit rules, else an empirical-Bayes reputation of the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._text import Scratch

#: Block where the lower posterior bound of a host's rate of bad pages, Z standard deviations below its mean, is above
#: WORSE times the rate of all labelled pages, and above LEAST_BAD.
WORSE, LEAST_BAD, Z = 1.5, 0.05, 1.645
#: Hosts up to this number are broadcast with their verdicts.
BROADCAST_HOSTS = 200_000
#: Suffixes of two labels under which domains are registered, fixed values; every other suffix is the last label.
TWO_LABELS = (
    "ac.at", "ac.id", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.th", "ac.uk", "ac.za", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke",
    "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng",
    "com.pe", "com.ph", "com.pk", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.br", "edu.cn", "edu.hk", "edu.mx", "edu.pl",
    "edu.sg", "edu.tr", "edu.tw", "gob.ar", "gob.mx", "go.jp", "go.kr", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.tr", "gov.uk", "gov.za", "ltd.uk",
    "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.at", "or.jp", "or.kr", "org.ar", "org.au", "org.br", "org.cn",
    "org.mx", "org.nz", "org.pl", "org.tr", "org.tw", "org.uk", "org.za", "plc.uk", "sch.uk",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(_authority(url), UPPER, LOWER)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _authority(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    rest = _rest(url)
    return F.coalesce(F.regexp_extract(F.substring(rest, F.length(_authority(url)) + 1, F.length(rest)), "^[^?#]*", 0), F.lit(""))


def bare_host(host: Column) -> Column:
    """The host without a user's name before it and a port after it."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """What domains are registered under: the last label, or two of TWO_LABELS; of an address of numbers, all of it."""
    two = F.substring_index(host, ".", -2)
    return F.when(F.regexp_like(host, F.lit("[.][0-9]+$")), host).when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(F.regexp_like(host, F.lit("[.][0-9]+$")), host).when(two.isin(*TWO_LABELS), three).otherwise(two)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for given, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/") if "/" in r[1] else len(r[1]))):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(given)).otherwise(verdict)
    return rule, verdict


def _spread(groups: DataFrame, mean: str) -> Column:
    """Aggregate: the concentration of groups' rates around their parents' means, by moments, between 1 and 1000."""
    p, n, m = F.col("bad") / F.col("n"), F.col("n"), F.col(mean)
    noise = F.sum(F.when(n > 0, m * (1 - m)))
    between = (F.sum(F.when(n > 0, n * (p - m) * (p - m))) - noise) / F.nullif(F.sum(n) - F.sum(n * n) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))
    within = F.avg(F.when(n > 0, m * (1 - m)))
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), within / F.greatest(between, F.lit(1e-9)) - 1)), F.lit(1000.0))


def host_reputation(counts: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, bad_rate, bad_bound) from (host, n labelled pages, bad ones).

    Rates are shrunk through beta-binomial priors: suffixes to the whole, registered domains to their suffix, hosts to
    their domain. A prior's concentration is fitted by moments over all groups of its level, and is never above what the
    parent itself rests on (its labelled pages and its own prior's), so that without evidence no bound is high: with no
    label at all, every rate is one half on two pages. ``bad_bound`` is the posterior mean less ``z`` of its standard
    deviations, not a quantile. Three numbers, one a level, come to the driver; levels are sums of the level below.
    """
    hosts = counts.select("host", "n", "bad", domain_of(bare_host(F.col("host"))).alias("domain"))
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("suffix", suffix_of(F.col("domain")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()

    def shrunk(groups: DataFrame, key: str) -> DataFrame:
        """(key, mean, rests): posterior means of groups (key, n, bad, prior, prior_rests), and what they rest on."""
        fitted = groups.agg(_spread(groups, "prior")).first()[0]
        size = F.least(F.lit(fitted), F.col("prior_rests"))
        return groups.select(key, "n", "bad", ((F.col("bad") + size * F.col("prior")) / (F.col("n") + size)).alias("mean"), (F.col("n") + size).alias("rests"))

    def under(parents: DataFrame, key: str) -> DataFrame:
        return parents.select(key, F.col("mean").alias("prior"), F.col("rests").alias("prior_rests"))

    suffixes = shrunk(suffixes.withColumn("prior", F.lit((bad + 1) / (n + 2))).withColumn("prior_rests", F.lit(float(n + 2))), "suffix")
    domains = shrunk(domains.join(under(suffixes, "suffix"), "suffix"), "domain")
    hosts = shrunk(hosts.join(under(domains, "domain"), "domain"), "host")
    rate = F.col("mean")
    return hosts.select("host", "n", "bad", rate.alias("bad_rate"), F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / (F.col("rests") + 1))).alias("bad_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], worse: float = WORSE, least_bad: float = LEAST_BAD, z: float = Z, ids: str = "page_id", url: str = "url", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Judge every url by the longest rule that fits, else by its host's reputation.

    ``outcomes`` is (id, bad): labelled pages. Returns one row per page: the id, host, path, rule (or null), verdict
    (`allow` or `block`), n_labelled, bad_rate and bad_bound of its host. The method blocks a host whose bound is above
    ``worse`` times the rate of all labelled pages and above ``least_bad``.

    Pages are counted by host in each task before they are shuffled, so a host of any share of the pages is one small
    row. The table of hosts is written once; it is broadcast up to ``broadcast_hosts`` rows, else the join is by a
    shuffle whose large partitions Spark splits. Null and odd urls have the empty host; unlabelled hosts have their
    domain's rate, and are allowed where no label stands behind it; an id labelled twice is bad if one label says so;
    null ids match no label; repeated pages are judged each; other columns are ignored.
    """
    own = pages.select(F.col(ids).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = outcomes.groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counts = own.select("id", "host").join(labels, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    with Scratch(pages.sparkSession) as scratch:
        counts = scratch.keep(counts, "hosts")
        n, bad, n_hosts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
        limit = max(least_bad, worse * (bad + 1) / (n + 2))
        known = scratch.result(host_reputation(counts, z), "reputation")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = own.join(F.broadcast(known) if n_hosts <= broadcast_hosts else known, "host", "left")
    by_method = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return judged.select(F.col("id").alias(ids), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.col("n").alias("n_labelled"), F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))
