"""Confidence of a record: expressions over its arrays, with the notes that explain it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import BLEND, SCORE_WEIGHTS, SUBSTANTIAL_CHARS


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))


def _some(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def completeness(overview: Column, audience: Column, emails: Column, team: Column) -> Column:
    w, people = SCORE_WEIGHTS, F.size(team)
    credit = _total(team, lambda m: F.when(_some(m["linkedin_url"]), F.least(F.lit(1.0), F.when(F.coalesce(m["linkedin_confidence"], F.lit(0.0)) == 0, 1.0).otherwise(m["linkedin_confidence"]))).otherwise(0.0))
    titles = _total(team, lambda m: F.when(_some(m["title"]), 1.0).otherwise(0.0))
    by_team = F.when(people > 0, w["team"] * F.least(F.lit(1.0), people / 3) + w["profiles"] * credit / people + w["titles"] * titles / people).otherwise(0.0)
    total = F.when(_some(overview), w["overview"]).otherwise(0.0) + F.when(_some(audience), w["audience"]).otherwise(0.0) + w["emails"] * F.least(F.lit(1.0), F.size(emails) / 2) + by_team
    return F.least(F.lit(1.0), total)


def completeness_notes(overview: Column, audience: Column, emails: Column, team: Column) -> Column:
    people = F.size(team)
    linked = F.size(F.filter(team, lambda m: _some(m["linkedin_url"])))
    searched = F.size(F.filter(team, lambda m: _some(m["linkedin_url"]) & F.coalesce(m["linkedin_source"] == "search", F.lit(False))))
    return F.array(
        F.when(~_some(overview), "no company overview"), F.when(~_some(audience), "no target audience"),
        F.when(F.size(emails) == 1, "only one contact email found").when(F.size(emails) == 0, "no contact emails found"),
        F.when(people == 0, "no team members identified").when(linked == 0, "no LinkedIn URLs resolved for team members").when(searched > 0, F.concat(searched.cast("string"), F.lit(" LinkedIn URL(s) recovered by search fallback"))),
    )


def coverage(pages: Column, target: int) -> Column:
    """Read pages against the target; thin pages count half."""
    good = F.filter(pages, lambda p: p["status"] == "ok")
    full = F.size(F.filter(good, lambda p: p["clean_chars"] >= SUBSTANTIAL_CHARS))
    return coverage_of_counts(F.size(good), full, target)


def coverage_of_counts(good: Column, full: Column, target: int) -> Column:
    """The same from the numbers of read pages and of full ones among them, which aggregate where the pages are."""
    ratio = good / F.lit(float(max(target, 1)))
    return F.when(good == 0, 0.0).otherwise(F.least(F.lit(1.0), F.when(full < good, ratio * (0.5 + 0.5 * full / good)).otherwise(ratio)))


def coverage_notes(pages: Column) -> Column:
    good = F.filter(pages, lambda p: p["status"] == "ok")
    failed, thin = F.size(pages) - F.size(good), F.size(F.filter(good, lambda p: p["clean_chars"] < SUBSTANTIAL_CHARS))
    none = F.when(F.size(pages) == 0, "no pages fetched").when(F.size(good) == 0, "every page fetch failed")
    some = F.size(good) > 0
    return F.array(none, F.when(some & (failed > 0), F.concat(failed.cast("string"), F.lit(" of "), F.size(pages).cast("string"), F.lit(" page fetches failed"))), F.when(some & (thin > 0), F.concat(thin.cast("string"), F.lit(" page(s) had little usable text"))))


def evidence_strength(team: Column) -> Column:
    """Null without a team."""
    total = _total(team, lambda m: F.when(_some(m["title_source"]), 0.5).otherwise(0.0) + 0.5 * F.least(F.lit(1.0), F.coalesce(m["linkedin_confidence"], F.lit(0.0))))
    return F.when(F.size(team) > 0, total / F.size(team))


def evidence_notes(team: Column) -> Column:
    bare = F.size(F.filter(team, lambda m: ~_some(m["linkedin_url"])))
    weak = (evidence_strength(team) < 0.5) & (bare > 0)
    return F.array(F.when(F.size(team) == 0, "no team members to assess evidence for; weight redistributed").when(weak, F.concat(bare.cast("string"), F.lit(" of "), F.size(team).cast("string"), F.lit(" team member(s) have no verified profile"))))


def validation_health(attempts: Column, most: int, errors: Column) -> Column:
    health = F.when(attempts <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (attempts - 1) / float(max(most, 2))))
    bad = F.exists(errors, lambda e: F.contains(e, F.lit("validation")) | F.contains(e, F.lit("json")))
    return F.round(F.when(bad, health * 0.9).otherwise(health), 3)


def blend(complete: Column, covered: Column, evidence: Column, valid: Column) -> Column:
    """The weighted mean of the parts that apply."""
    w = BLEND
    total = w["completeness"] * complete + w["coverage"] * covered + w["validation"] * valid + F.coalesce(w["evidence"] * evidence, F.lit(0.0))
    mass = w["completeness"] + w["coverage"] + w["validation"] + F.when(evidence.isNotNull(), w["evidence"]).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / mass)), 3)


def breakdown(overview: Column, audience: Column, emails: Column, team: Column, pages: Column, own: Column, attempts: Column, errors: Column, extra: Column, extracted: Column, target: int, most: int) -> Column:
    """The whole struct; without an extraction only coverage is reported."""
    complete, covered, evidence, valid = completeness(overview, audience, emails, team), coverage(pages, target), evidence_strength(team), validation_health(attempts, most, errors)
    notes = F.array_compact(F.concat(completeness_notes(overview, audience, emails, team), coverage_notes(pages), evidence_notes(team), F.array(F.when(attempts > 1, F.concat(F.lit("model needed "), attempts.cast("string"), F.lit(" attempts to produce valid output")))), extra))
    names = ("completeness", "source_coverage", "evidence_strength", "validation_health", "llm_self_reported", "final")
    full = (F.round(complete, 3), F.round(covered, 3), F.round(F.coalesce(evidence, F.lit(0.0)), 3), valid, F.round(F.coalesce(own, F.lit(0.0)), 3), blend(complete, covered, evidence, valid))
    none = (F.lit(0.0), F.round(covered, 3), *[F.lit(0.0)] * 4)
    failed = F.concat(F.array(F.lit("extraction failed; no data to score")), F.array_compact(extra))
    return F.struct(*[F.when(extracted, a).otherwise(b).alias(n) for n, a, b in zip(names, full, none)], F.when(extracted, notes).otherwise(failed).alias("notes"))


def record_status(extracted: Column, pages: Column, errors: Column) -> Column:
    return status_of(extracted, F.exists(pages, lambda p: p["status"] != "ok"), errors)


def status_of(extracted: Column, failed: Column, errors: Column) -> Column:
    """The same where it is known whether any page failed."""
    return F.when(~extracted, "failed").when(failed | (F.size(errors) > 0), "partial").otherwise("success")
