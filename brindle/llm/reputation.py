"""URL filters by empirical-Bayes host reputation.

Labelled pages of a host are bad or not. The share of bad pages is shrunk level
by level: a suffix (com) towards all pages, a registered domain (example.com)
towards its suffix, a host towards its domain. At each level the prior is a beta
distribution whose mean is the parent's posterior mean and whose weight is
estimated by moments from how far the children of one parent spread. A host is
blocked if even the lower posterior bound of its bad share is above the limit.
Explicit rules for a host and a path come first; the longest that fits wins.

Pages are only ever summed by host before the shuffle, so a host with a third
of all pages is one row of the tables that are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import kept, matched, table

#: Standard deviations between posterior mean and bound, and the bad share that is too much.
BOUND, LIMIT = 1.0, 0.3
#: Least and largest weight of a prior, in pages.
LIGHTEST, HEAVIEST = 2.0, 200.0
#: Suffixes, domains or hosts that are broadcast at most.
HOSTS_AT_ONCE = 200_000
#: Suffixes of two labels under which names are registered; any other suffix is the last label. Others can be given.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "blogspot.com", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.pl",
    "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "github.io", "go.jp", "gov.au", "gov.cn", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "or.jp", "or.kr",
    "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "wordpress.com",
)
ADDRESS = "address"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def _lower(text: Column) -> Column:
    """A to Z in lower case, no other letter."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path; both empty for null or without '://'."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.when(known, _lower(host)).otherwise(""), F.when(known, path).otherwise("")


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, of the first in order among equally long ones; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(str(r))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def levels(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (one label more than the suffix, or all there are) and suffix (the last label, or two that are in suffixes).

    User, port and a closing dot are left aside; an IP address is a domain of its
    own, under a suffix of its own.
    """
    name = F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), r"\.$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(list(suffixes))
    number = name.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^\[.*\]$")
    domain = F.when(number, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(number, ADDRESS).when(long, two).otherwise(F.substring_index(name, ".", -1))


def _spread() -> list[Column]:
    """What the children of one parent tell of how far their bad shares spread; sums of columns n and bad."""
    has = F.col("n") > 0
    return [
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.count_if(has).cast("double").alias("children"),
        F.coalesce(F.sum(F.when(has, F.col("bad") * F.col("bad") / F.col("n"))), F.lit(0.0)).alias("squares"),
    ]


def _prior(mean: Column) -> tuple[Column, Column]:
    """Beta prior (a, b) of the children of parents with this mean, from columns n, bad, children and squares.

    By moments: what the squared distances of the children's shares from the mean
    have beyond what draws of n pages would give is correlation within a child
    (rho), and the weight is 1 / rho - 1.
    """
    noise = mean * (1 - mean)
    apart = F.col("squares") - 2 * mean * F.col("bad") + mean * mean * F.col("n")
    rho = (F.try_divide(apart, noise) - F.col("children")) / F.greatest(F.col("n") - F.col("children"), F.lit(1.0))
    weight = F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-6)) - 1, F.lit(LIGHTEST)), F.lit(HEAVIEST))
    weight = F.when((noise > 0) & (F.col("children") > 0), weight).otherwise(F.lit(HEAVIEST))
    return mean * weight, (1 - mean) * weight


def _posterior() -> Column:
    """Posterior mean from columns a, b, n and bad."""
    return (F.col("a") + F.col("bad")) / (F.col("a") + F.col("b") + F.col("n"))


def reputations(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", outcome_key: str = "page_id", bad: str = "bad", bound: float = BOUND, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Rows (host, domain, suffix, n, bad, mean, low): every host of pages with its posterior bad share.

    outcomes has a boolean for some pages; null and unknown keys count for
    nothing, repeated ones once for each row. A host without a labelled page has
    its domain's posterior mean and the bound that goes with the prior alone.
    """
    host = split_url(F.col(url))[0]
    pages = pages.select(F.col(key).alias("page"), host.alias("host"))
    seen = outcomes.where(F.col(bad).isNotNull()).select(F.col(outcome_key).alias("page"), F.col(bad).cast("int").alias("bad"))
    seen = seen.groupBy("page").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counts = pages.join(seen, "page", "left").groupBy("host").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    domain, suffix = levels(F.col("host"), suffixes)
    # each level is summed from the one below, once
    hosts = kept(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = kept(hosts.groupBy("domain", "suffix").agg(*_spread()))
    tops = kept(domains.groupBy("suffix").agg(*_spread()))
    mean = (F.col("bad") + 1) / (F.col("n") + 2)
    a, b = _prior(mean)
    root = tops.agg(*_spread()).select(F.coalesce(a, F.lit(1.0)).alias("a"), F.coalesce(b, F.lit(1.0)).alias("b")).first()
    a, b = _prior(F.col("mean"))
    tops = tops.withColumns({"a": F.lit(root.a), "b": F.lit(root.b)}).withColumn("mean", _posterior()).select("suffix", a.alias("a"), b.alias("b"))
    domains = matched(domains, tops, "suffix", "domain", HOSTS_AT_ONCE).withColumn("mean", _posterior()).select("domain", a.alias("a"), b.alias("b"))
    found = matched(hosts, kept(domains), "domain", "host", HOSTS_AT_ONCE).withColumn("mean", _posterior())
    size = F.col("a") + F.col("b") + F.col("n")
    low = F.greatest(F.col("mean") - F.lit(bound) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1)), F.lit(0.0))
    return found.select("host", "domain", "suffix", "n", "bad", "mean", low.alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", rules: tuple[Rule, ...] = RULES, limit: float = LIMIT, bound: float = BOUND) -> DataFrame:
    """Rows (key, host, path, rule, verdict, low) for every row of pages; see reputations() and matching_rule().

    An url that is null or without '://' has an empty host and path, fits no rule
    and is judged like any other host, the empty one.
    """
    known = kept(reputations(pages, outcomes, url, key, bound=bound).select("host", "low"))
    host, path = split_url(F.col(url))
    rows = matched(pages.select(F.col(key), host.alias("host"), path.alias("path")), known, "host", "path", HOSTS_AT_ONCE, "left")
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.coalesce("low", F.lit(0.0)) > limit, "block").otherwise("allow")
    return rows.select(key, "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"), F.round("low", 9).alias("low"))


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its id: bad if toxic or of low quality."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)


QUERIES = {"op6_host_reputation": op6_host_reputation}
