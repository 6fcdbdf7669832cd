"""Totals of a run and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(items: str, test) -> Column:
    return F.coalesce(F.sum(F.size(F.filter(items, test))), F.lit(0))


def run_totals(records: DataFrame) -> DataFrame:
    """One row of seventeen measures; the mean confidence leaves failed records out."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return records.agg(
        F.count("*").alias("domains"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("success", "succeeded"), ("partial", "partial"), ("failed", "failed"))],
        _count("pages_crawled", lambda p: p["status"] == "ok").alias("pages_crawled"), F.coalesce(F.sum(F.size("pages_crawled")), F.lit(0)).alias("pages_attempted"),
        _count("pages_crawled", lambda p: (p["status"] == "ok") & (p["tier"] == "browser")).alias("pages_by_browser"), F.coalesce(F.sum(F.size("team_members")), F.lit(0)).alias("team_members"),
        _count("team_members", lambda m: some(m["title"])).alias("titles"), _count("team_members", lambda m: some(m["linkedin_url"])).alias("linkedin_urls"), _count("team_members", lambda m: F.coalesce(m["linkedin_source"] == "search", F.lit(False))).alias("linkedin_by_search"),
        F.coalesce(F.sum(F.size("contact_emails")), F.lit(0)).alias("contact_emails"), F.coalesce(F.sum(F.size("personal_emails")), F.lit(0)).alias("personal_emails"),
        F.round(F.coalesce(F.avg(F.when(F.col("status") != "failed", F.col("data_confidence_score"))), F.lit(0.0)), 2).alias("mean_confidence"),
        F.coalesce(F.sum("usage.total_tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("usage.estimated_cost_usd"), F.lit(0.0)), 6).alias("cost"), F.round(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)), 2).alias("runtime"),
    )


def envelope(records: DataFrame, started: str, model: str) -> DataFrame:
    """The run's envelope in one row; for exports of a size that fits one row."""
    totals = run_totals(records)
    whole = records.agg(F.collect_list(F.struct("*")).alias("results"))
    head = totals.select(F.lit(started).alias("run_started_at"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("run_finished_at"), F.col("runtime").alias("duration_seconds"), F.lit(model).alias("model"), F.col("domains").alias("domains_requested"), F.col("succeeded").alias("domains_succeeded"), F.col("partial").alias("domains_partial"), F.col("failed").alias("domains_failed"), F.col("tokens").alias("total_tokens"), F.col("cost").alias("total_estimated_cost_usd"))
    return head.crossJoin(whole)


WIDTH = 46


def dashboard(totals: dict) -> str:
    """A box of the totals; rows that don't apply are left out."""
    row = lambda name, value: f"| {name:<26}{value:>{WIDTH - 28}} |"
    rule = f"+{'-' * WIDTH}+"
    lines = [rule, row("domains", totals["domains"]), row("succeeded", totals["succeeded"])]
    lines += [row(n, totals[n]) for n in ("partial", "failed") if totals[n]]
    lines += [rule, row("pages read", f"{totals['pages_crawled']}/{totals['pages_attempted']}")]
    lines += [row("pages by browser", totals["pages_by_browser"])] if totals["pages_by_browser"] else []
    lines += [row("team members", totals["team_members"]), row("titles", totals["titles"]), row("profile urls", totals["linkedin_urls"])]
    lines += [row("profiles by search", totals["linkedin_by_search"])] if totals["linkedin_by_search"] else []
    lines += [row("contact emails", totals["contact_emails"])]
    lines += [row("personal inboxes", totals["personal_emails"])] if totals["personal_emails"] else []
    lines += [rule, row("mean confidence", f"{totals['mean_confidence']:.2f}"), row("tokens", f"{totals['tokens']:,}"), row("cost", f"${totals['cost']:.6f}"), row("runtime", f"{totals['runtime']:.1f} s"), rule]
    return "\n".join(lines)


def detail(records: DataFrame) -> DataFrame:
    """(domain, report): a few lines a record, with short lists."""
    people = F.transform(F.slice("team_members", 1, 3), lambda m: F.concat(F.lit("    - "), m["name"], F.coalesce(F.concat(F.lit(" ("), m["title"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" | "), m["linkedin_url"]), F.lit(""))))
    parts = F.array(
        F.concat(F.lit("["), F.upper("status"), F.lit("] "), "domain", F.lit("  confidence "), F.format_number("data_confidence_score", 2)),
        F.concat(F.lit("  overview : "), F.substring("company_overview", 1, 150)), F.concat(F.lit("  audience : "), F.substring("target_audience", 1, 150)),
        F.when(F.size("contact_emails") > 0, F.concat(F.lit("  emails   : "), F.array_join(F.transform(F.slice("contact_emails", 1, 4), lambda e: e["email"]), ", "))),
        F.when(F.size("team_members") > 0, F.concat(F.lit("  team     : "), F.size("team_members").cast("string"), F.lit("\n"), F.array_join(people, "\n"))),
        F.when(F.size("errors") > 0, F.concat(F.lit("  errors   : "), F.array_join(F.transform(F.slice("errors", 1, 3), lambda e: F.substring(e, 1, 160)), "; "))),
    )
    return records.select("domain", F.array_join(F.array_compact(parts), "\n").alias("report"))
