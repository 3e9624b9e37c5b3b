"""URL filter by empirical-Bayes host reputation (built-in expressions only).

Labelled page outcomes (1 = bad) are counted per host and shrunk down the hierarchy
all pages -> suffix -> registered domain -> host: the posterior mean of a node is the prior
mean of its children. The strength of each level's beta prior comes from the data, by the
beta-binomial moment estimate of the spread of the nodes about their parents' means, held
between ``least`` and ``most`` (0.001 and 0.5: a prior weighs as much as 999 pages at most and as one
at least, so that few or unanimous nodes give no boundless or empty prior). A url
without a rule is blocked if the lower bound of its host's posterior bad rate,
``mean - z * sd``, exceeds ``max_bad``: a host with few outcomes stays near its domain's rate
and is not blocked by one bad page.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end. In the hierarchy a host stands without user, port and
final dots. Suffix: its last two or three labels if they are in the list of ``suffixes`` (an input
table or a tuple), else the last one; registered domain: one label more; an IP address is its own
domain and suffix. Defined cases: a very long url is taken whole; a url
that is null or has no ``://`` has empty host and path and fits no rule; pages without an
outcome count for nothing; repeated outcomes of a page count once, as bad if any is; an
outcome that is null is none; pages with a null id have no outcome; repeated pages count each;
hosts without outcomes get their domain's posterior; no outcomes at all: nothing is blocked;
extra columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Suffixes of several labels under which domains are registered, where no table of them is given.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user, port and final dots: what reputation is of."""
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(host, "\\.+$", "")


def is_address(site: Column) -> Column:
    return site.rlike(r"^\[|^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def with_domain(sites: DataFrame, suffixes: DataFrame | tuple[str, ...] = SUFFIXES, host: str = "host") -> DataFrame:
    """``sites`` with ``suffix`` and ``domain``. Whether the list is broadcast is the planner's choice."""
    if not isinstance(suffixes, DataFrame):
        listed = F.array(*[F.lit(s) for s in suffixes]).cast("array<string>")
        suffixes = sites.sparkSession.range(1).select(F.explode(listed).alias("suffix"))
    listed = suffixes.select(F.col(suffixes.columns[0]).alias("__s")).distinct()
    of = {n: F.substring_index(F.col(host), ".", -n) for n in (1, 2, 3, 4)}
    for n in (2, 3):
        sites = sites.join(listed.withColumnRenamed("__s", f"__s{n}"), of[n] == F.col(f"__s{n}"), "left")
    alone, three, two = is_address(F.col(host)), F.col("__s3").isNotNull(), F.col("__s2").isNotNull()
    suffix = F.when(alone, F.col(host)).when(three, of[3]).when(two, of[2]).otherwise(of[1])
    domain = F.when(alone, F.col(host)).when(three, of[4]).when(two, of[3]).otherwise(of[2])
    return sites.withColumns({"suffix": suffix, "domain": domain}).drop("__s2", "__s3")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits, null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's path; among
    rules of equal length the one with the longer host wins.
    """
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _strength(nodes: DataFrame, least: float = 1e-3, most: float = 0.5) -> float:
    """Prior strength ``1 / rho - 1`` of a level from its nodes (bad, n, prior mean): one row.

    Under a beta-binomial, ``n * (p - m) ** 2`` has mean ``m * (1 - m) * (1 + (n - 1) * rho)``.
    """
    v = F.col("prior") * (F.lit(1.0) - F.col("prior"))
    gap = F.col("bad") / F.col("n") - F.col("prior")
    over, base = nodes.filter("n > 0").agg(F.sum(F.col("n") * gap * gap - v), F.sum(v * (F.col("n") - 1))).first()
    rho = over / base if base else least
    return 1.0 / min(max(rho, least), most) - 1.0


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | tuple[str, ...] = SUFFIXES, z: float = 1.645) -> DataFrame:
    """(host, lower): the lower posterior bound of the bad rate of every host of ``pages``.

    ``pages`` has page_id and host (see ``site_of``), ``outcomes`` page_id and bad. The join of pages
    with outcomes is the only one on page scale and is on a unique key; a hot host is one row per
    task after the partial aggregation. All else runs on one row per host or less.
    """
    outcomes = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("bad").cast("double").alias("n"))
    hosts = scratch_table(with_domain(hosts, suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    bad, n = suffixes.agg(F.sum("bad"), F.sum("n")).first()
    overall = bad / n if n else 0.0

    def posterior(nodes: DataFrame, name: str, keep: list[str]) -> DataFrame:
        s = _strength(nodes)
        a, b = F.col("bad") + F.col("prior") * s, F.col("n") - F.col("bad") + (F.lit(1.0) - F.col("prior")) * s
        return nodes.select(*keep, (a / (a + b)).alias(name), (a * b / ((a + b) * (a + b) * (a + b + 1.0))).alias("variance"))

    suffix_post = posterior(suffixes.withColumn("prior", F.lit(overall)), "prior", ["suffix"]).drop("variance")
    domain_post = posterior(domains.join(suffix_post, "suffix"), "prior", ["domain"]).drop("variance")
    host_post = posterior(hosts.select("host", "domain", "bad", "n").join(domain_post, "domain"), "mean", ["host"])
    return host_post.select("host", (F.col("mean") - F.lit(z) * F.sqrt("variance")).alias("lower"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], max_bad: float = 0.5, z: float = 1.645, suffixes: DataFrame | tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    Only hosts over the bound are joined back; that side is written first, so the planner
    broadcasts it if it is small and otherwise joins by host with skewed hosts split.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    reputation = host_reputation(rows.select("page_id", site_of(F.col("host")).alias("host")), outcomes, suffixes, z)
    blocked = scratch_table(reputation.filter(F.col("lower") > max_bad).select(F.col("host").alias("__host")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(blocked, site_of(F.col("host")) == F.col("__host"), "left")
    by_host = F.when(F.col("__host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))
