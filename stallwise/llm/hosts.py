"""URL filter: fixed rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host and shrunk along
suffix -> registered domain -> host. At each level a group's rate is drawn from a
beta distribution around its parent's shrunk rate; the level's strength (the
beta's pseudo-count) comes from the spread of the observed rates by the method
of moments. A host is blocked when the lower bound of its posterior bad rate
exceeds a limit, so hosts with little evidence stay allowed.

Nothing is collected: counts combine map-side, parents are joined by equality,
and the level strengths are scalar subqueries. Counts and reputations, a row per
host, are staged, so Spark knows their size when it picks the last join.

Edge cases: a null url, or one without ``://``, has an empty host and path; it
meets no rule, and all such pages share the empty host's reputation. The registered
domain is taken as the last two labels: no list of public suffixes is read, so all
registrants under one of several labels (co.uk, github.io) share a level. Pages
without a label add no outcome. Repeated label rows of a page count as one (bad
if any is); rows whose label is null are ignored. Repeated page rows are kept,
each with its outcome. An empty outcome table leaves every host at the rate
taken for granted, one in ten, which allows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import ascii_lower
from stallwise.sources.staging import stage

Rule = tuple[str, str, str]  # host, start of the path, verdict

MAX_BAD_RATE = 0.5
Z = 1.645  # one-sided 95 %
# Of the intra-class correlation, and what it is taken for without repeated outcomes; strength = 1 / correlation - 1.
LEAST_SPREAD, MOST_SPREAD, USUAL_SPREAD = 1e-4, 0.5, 0.1


def url_parts(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every page."""
    host = ascii_lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def matching_rule(rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, null where none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        on_host = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        hit = F.struct(F.lit(host + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(on_host & F.startswith("path", F.lit(start)), hit).otherwise(found)
    return found


def registered_domain(host: Column) -> Column:
    """The last two labels of a host; under suffixes of several labels (co.uk) these are the suffix."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(groups: DataFrame, parent_rate: str) -> Column:
    """Pseudo-count of the beta around the parents' rates, as a scalar subquery."""
    n, k, rate = F.col("n"), F.col("bad"), F.col(parent_rate)
    excess = (k - n * rate) ** 2 / (n * rate * (F.lit(1.0) - rate)) - F.lit(1.0)
    spread = F.try_divide(F.sum(excess), F.sum(n - F.lit(1.0)))
    spread = F.least(F.greatest(F.coalesce(spread, F.lit(USUAL_SPREAD)), F.lit(LEAST_SPREAD)), F.lit(MOST_SPREAD))
    return groups.where(n > 0).agg((F.lit(1.0) / spread - F.lit(1.0)).alias("strength")).scalar()


def _shrunk(groups: DataFrame, parent_rate: str, rate: str) -> DataFrame:
    strength = _strength(groups, parent_rate)
    return groups.withColumn("strength", strength).withColumn(
        rate, (F.col("bad") + F.col("strength") * F.col(parent_rate)) / (F.col("n") + F.col("strength"))
    )


def _sums(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``host, n, bad, bad_rate, bound`` from one row per page: ``host, bad`` (1, 0 or null without a label)."""
    labelled = F.count("bad").cast("double")
    bad = F.coalesce(F.sum("bad"), F.lit(0)).cast("double")
    hosts = stage(outcomes.groupBy("host").agg(labelled.alias("n"), bad.alias("bad")), "hosts")
    hosts = hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    # As if one in ten pages had been bad before any outcome was seen.
    neutral = (F.coalesce(F.sum("bad"), F.lit(0.0)) + F.lit(1.0)) / (F.coalesce(F.sum("n"), F.lit(0.0)) + F.lit(10.0))
    suffixes = _sums(hosts, "suffix").withColumn("overall", hosts.agg(neutral.alias("overall")).scalar())
    suffixes = _shrunk(suffixes, "overall", "suffix_rate").select("suffix", "suffix_rate")
    domains = _sums(hosts, "domain", "suffix").join(suffixes, "suffix")
    domains = _shrunk(domains, "suffix_rate", "domain_rate").select("domain", "domain_rate")
    scored = _shrunk(hosts.join(domains, "domain"), "domain_rate", "bad_rate")
    total = F.col("n") + F.col("strength")
    spread = F.sqrt(F.col("bad_rate") * (F.lit(1.0) - F.col("bad_rate")) / (total + F.lit(1.0)))
    scored = scored.select("host", "n", "bad", "bad_rate", (F.col("bad_rate") - F.lit(z) * spread).alias("bound"))
    return stage(scored, "reputation")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), max_bad_rate: float = MAX_BAD_RATE, z: float = Z
) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bound`` of every page.

    ``outcomes`` has ``page_id`` and ``bad`` (1 or 0). The verdict is ``allow`` or ``block``.
    """
    parts = url_parts(pages)
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation = host_reputation(parts.join(known, "page_id", "left").select("host", "bad"), z)
    judged = parts.join(reputation.select("host", "bad_rate", "bound"), "host", "left")
    by_host = F.when(F.col("bound") > F.lit(max_bad_rate), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("hit", matching_rule(rules)).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", by_host).alias("verdict"), "bad_rate", "bound",
    )
