"""URL filters: rules by host and path, and empirical-Bayes host reputation.

Labelled page outcomes are pooled by host, registered domain and suffix. At each
level a beta-binomial prior is centred on the level above, with a strength found
by the method of moments from how much the groups differ; a host is blocked if
even the lower bound of its posterior share of bad pages is too high. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """``z`` standard deviations below the posterior mean must exceed ``limit`` to block.

    Without a limit it is the share of bad pages among all that are labelled. A
    prior weighs as much as ``(1 - r) / r`` labelled pages, for an overlap ``r``
    between these bounds: ten pages at most, so that a host's own pages count
    also where groups hardly differ. ``suffixes`` has suffixes of several
    labels, such as ``co.uk``; all others are a host's last label.
    """

    limit: float | None = None
    z: float = 2.0
    least_overlap: float = 1 / 11
    most_overlap: float = 0.9999
    suffixes: tuple[str, ...] = ()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; the path from there to ``?``, ``#`` or the end.
    """
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equals: the one given first), else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Suffix and registered domain: the suffix and one label more. User and port are left out.

    The longest of ``suffixes`` that fits, else the last label. A numeric address
    is its own domain and suffix, and so is a host that is a suffix.
    """
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    labels = F.split(bare, r"\.", -1)
    suffix = F.element_at(labels, -1)
    for s in sorted(suffixes, key=len):
        suffix = F.when((bare == s) | bare.endswith("." + s), s).otherwise(suffix)
    suffix = F.when(bare.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\["), bare).otherwise(suffix)
    front = F.substring(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1)
    return suffix, F.when(bare == suffix, bare).otherwise(F.concat_ws(".", F.substring_index(front, ".", -1), suffix))


def _overlap(groups: DataFrame, mean: str, settings: Reputation) -> float:
    """Intra-group correlation of outcomes about ``mean``, by moments; a prior's strength is (1 - r) / r."""
    m = F.col(mean)
    got = groups.filter("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - m, 2)).alias("s"), F.sum(F.col("n") * m * (1 - m)).alias("v"),
    ).first()
    if not got.n or not got.v:
        return settings.least_overlap
    room = got.n - got.nn / got.n - (got.k - 1)
    r = (got.s / (got.v / got.n) - (got.k - 1)) / room if room > 0 else 0.0
    return min(max(r, settings.least_overlap), settings.most_overlap)


def host_reputation(pages: DataFrame, host_col: str, bad_col: str, settings: Reputation = Reputation()) -> DataFrame:
    """Posterior of each host's share of bad pages.

    ``bad_col`` is a boolean outcome, null where a page has no label; a host
    without any keeps its domain's prior. Rows with a null host are left out.
    Returns ``host, n, x, posterior_mean, lower_bound, blocked``.

    Hosts are counted before any shuffle, so a host that holds a third of the
    pages is one row a task; what reaches the driver is one number a level.
    """
    hosts = pages.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(
        F.count(bad_col).alias("n"), F.coalesce(F.sum(F.col(bad_col).cast("long")), F.lit(0)).alias("x")
    )
    suffix, domain = suffix_and_domain(F.col("host"), settings.suffixes)
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})
    # one row a host from here on: the pages are read once for it
    hosts = stored(hosts, "hosts")
    sums = [F.sum("n").alias("n"), F.sum("x").alias("x")]
    suffixes = hosts.groupBy("suffix").agg(*sums)
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    total = suffixes.agg(*sums).first()
    base = total.x / total.n if total.n else 0.0
    limit = base if settings.limit is None else settings.limit

    suffixes = suffixes.withColumn("base", F.lit(base))
    strength = _strength(_overlap(suffixes, "base", settings))
    suffixes = suffixes.select("suffix", _posterior(strength, "base").alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix")
    strength = _strength(_overlap(domains, "suffix_mean", settings))
    domains = domains.select("domain", _posterior(strength, "suffix_mean").alias("domain_mean"))
    hosts = hosts.join(domains, "domain")
    strength = F.lit(_strength(_overlap(hosts, "domain_mean", settings)))
    a = F.col("x") + strength * F.col("domain_mean")
    b = F.col("n") - F.col("x") + strength * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    bound = mean - F.lit(settings.z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "x", mean.alias("posterior_mean"), bound.alias("lower_bound"), (bound > limit).alias("blocked"))


def _strength(overlap: float) -> float:
    return (1 - overlap) / overlap


def _posterior(strength: float, mean: str) -> Column:
    return (F.col("x") + F.lit(strength) * F.col(mean)) / (F.col("n") + F.lit(strength))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], settings: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad") -> DataFrame:
    """Host, path, rule and verdict (``allow`` or ``block``) of every url.

    ``outcomes`` has urls with a boolean ``bad_col``, or null. The longest
    fitting rule decides, else the reputation of the host by these outcomes; a
    host without any, and an empty one, is allowed. One row per row of ``pages``,
    also for null or repeated ids and urls; columns beside these are not read.
    """
    host, path = host_and_path(F.col(url_col))
    outcomes = outcomes.select(host.alias("host"), F.col(bad_col).cast("boolean").alias("bad")).filter("host <> ''")
    blocked = host_reputation(outcomes, "host", "bad", settings).select("host", "blocked")
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("blocked"), "block").otherwise("allow")
    return urls.join(blocked, "host", "left").select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))
