"""Which pages of a job are captured: robots rules, candidate choice, and the capture limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..session import settle
from .numbering import count_before

DEFAULT_LIMIT = 25
MAX_LINKS = 200


def _robots_lines(robots: DataFrame) -> DataFrame:
    """(host, ord, key, value): directives and blank lines of each robots text, comments removed."""
    lines = robots.select("host", F.posexplode(F.split("txt", r"\r?\n|\r")).alias("ord", "raw"))
    clean = lines.withColumn("line", t.strip(F.regexp_replace("raw", "#.*$", "")))
    return clean.select(
        "host", "ord",
        F.when(F.col("line") == "", "").otherwise(F.lower(t.strip(F.regexp_extract("line", "^([^:]*):", 1)))).alias("key"),
        t.strip(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"),
        (t.strip(F.col("raw")) == "").alias("blank"),
    ).filter("(key <> '' AND key IS NOT NULL) OR blank")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(host, rules): the rules of the group that speaks to ``agent``, in file order.

    A named group comes before the ``*`` group.  The windows run inside one host's robots text, a single document.
    """
    w = Window.partitionBy("host").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = _robots_lines(robots).filter("blank OR key IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'request-rate')")
    kind = F.when(F.col("blank"), "blank").when(F.col("key") == "user-agent", "agent").otherwise("rule")
    started = (F.col("kind") == "agent") & ~F.coalesce(F.lag("kind").over(w) == "agent", F.lit(False))
    grouped = (
        lines.withColumn("kind", kind)
        .withColumn("starts", started.cast("int"))
        .withColumn("group", F.sum("starts").over(upto))
        .withColumn("blanks", F.sum((F.col("kind") == "blank").cast("int")).over(
            Window.partitionBy("host", "group").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .filter("group > 0 AND blanks = 0 AND NOT blank")
    )
    name = F.lit(agent.split("/")[0].lower())
    spoken = F.lower("value")
    rule = F.struct(
        "ord",
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        urls.percent_decoded(F.col("value")).alias("prefix"),
    )
    groups = (
        grouped.groupBy("host", "group")
        .agg(
            F.max((F.col("kind") == "agent") & (spoken != "*") & F.contains(name, spoken)).alias("named"),
            F.max((F.col("kind") == "agent") & (spoken == "*")).alias("default"),
            F.array_sort(F.collect_list(F.when(F.col("key").isin("allow", "disallow"), rule))).alias("rules"),
            F.count_if(F.col("kind") == "rule").alias("n_rules"),
        )
        .filter("(named OR default) AND n_rules > 0")
    )
    rank = F.struct(F.when(F.col("default"), 1).otherwise(0), "group")
    return groups.groupBy("host").agg(F.min_by("rules", rank).alias("rules"))


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed`` to rows with a ``url``: the first rule whose prefix fits decides; no rule means allowed.

    The rules travel as one short array per host; a busy host meets them by broadcast or by a splittable join.
    """
    rules = settle(robots_rules(robots, agent).withColumnRenamed("host", "_host"))
    target = urls.robots_target(F.col("url"))
    fits = lambda r: (r["prefix"] == "*") | F.startswith(F.col("_target"), r["prefix"])
    return (
        pages.withColumn("_host", urls.host(F.col("url")))
        .join(rules, "_host", "left")
        .withColumn("_target", target)
        .withColumn("allowed", F.coalesce(F.get(F.filter("rules", fits), F.lit(0))["allow"], F.lit(True)))
        .drop("_host", "rules", "_target")
    )


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, ord, url) of sitemaps named in robots texts."""
    return _robots_lines(robots).filter("key = 'sitemap' AND value <> ''").select(
        "host", "ord", F.col("value").alias("url")
    )


def job_candidates(probes: DataFrame, links: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """(job, ord, url): the job's own page when it is a product, else its first ``max_links`` links.

    ``probes`` has (job, url, has_evidence) for the start page; ``links`` has (job, seq, url).  The link cap is the
    operator's own rule: a listing page is never followed further.  :func:`links_not_followed` has the rest.
    """
    own = probes.filter("has_evidence").select("job", F.lit(0).cast("bigint").alias("ord"), "url")
    listing = probes.filter("NOT has_evidence").select("job")
    followed = links.filter(F.col("seq") < max_links).join(listing, "job", "left_semi").select(
        "job", F.col("seq").cast("bigint").alias("ord"), "url"
    )
    return own.unionByName(followed)


def links_not_followed(probes: DataFrame, links: DataFrame, max_links: int = MAX_LINKS) -> DataFrame:
    """(job, ord, url, status): links of listing pages beyond ``max_links``, which :func:`job_candidates` leaves out."""
    listing = probes.filter("NOT has_evidence").select("job")
    return links.filter(F.col("seq") >= max_links).join(listing, "job", "left_semi").select(
        "job", F.col("seq").cast("bigint").alias("ord"), "url", F.lit("not_followed").alias("status"))


def capture_plan(candidates: DataFrame, pages: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One status per candidate, in order; after ``limit`` captured pages of a job the rest are ``limit_reached``.

    ``candidates`` has (job, ord, url, allowed); ``pages`` has (url, fetched, has_fields, n_rows, record_id).  The
    running count of a job comes from range slices of its candidates, so a job may hold any share of all rows.
    """
    probe = candidates.join(pages, "url", "left")
    said = lambda status, reason: F.struct(
        F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason")
    )
    status = (
        F.when(~F.col("allowed"), said("blocked", "disallowed by robots.txt"))
        .when(~F.coalesce("fetched", F.lit(False)), said("skipped", "page could not be fetched"))
        .when(~F.coalesce("has_fields", F.lit(False)), said("skipped", "no usable evidence on page"))
        .when(F.coalesce("n_rows", F.lit(0)) == 0, said("skipped", "no evidence rows assembled"))
        .otherwise(said("captured", None))
    )
    judged = count_before(probe.select("job", "ord", "url", "record_id", status.alias("s")), ["job"], ["ord"], F.col("s.status") == "captured", "taken")
    final = F.when(F.col("taken") >= limit, said("limit_reached", "the job's limit of captured pages was reached")).otherwise(F.col("s"))
    return (
        judged.withColumn("s", final)
        .select("job", "ord", "url", "s.status", "s.reason", F.when(F.col("s.status") == "captured", F.col("record_id")).alias("record_id"))
    )
