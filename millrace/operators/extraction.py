"""Replay and validation of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT_PRICE, EMAIL_BLOCKLIST, MODEL_PRICES
from millrace.functions import contacts, text
from millrace.schema import EXTRACTION


def parse_answer(content: Column) -> Column:
    """The answer as a struct; null if it is no JSON object."""
    bare = text.strip_fences(F.coalesce(content, F.lit("")))
    return F.when(F.try_parse_json(bare).isNotNull() & F.startswith(bare, F.lit("{")), F.from_json(bare, EXTRACTION, {"mode": "PERMISSIVE"}))


def violations(answer: Column) -> Column:
    """What the schema has against an answer: an array of texts, empty for a good one."""
    long = lambda c, n: F.coalesce(F.length(text.collapse_ws(answer[c])) >= n, F.lit(False))
    names = F.transform(F.coalesce(answer["team_members"], F.array().cast("array<struct<name:string,title:string,linkedin_url:string,affiliation:string>>")), lambda m: F.coalesce(F.length(text.collapse_ws(m["name"])), F.lit(0)))
    own = F.coalesce(answer["self_reported_confidence"], F.lit(0.5))
    return F.array_compact(F.array(
        F.when(answer["company_overview"].isNull(), "company_overview: Field required").when(~long("company_overview", 15), "company_overview: must be a meaningful sentence, not a placeholder"),
        F.when(answer["target_audience"].isNull(), "target_audience: Field required").when(~long("target_audience", 15), "target_audience: must be a meaningful sentence, not a placeholder"),
        F.when(F.exists(names, lambda n: (n < 2) | (n > 80)), "team_members: name must be between 2 and 80 characters"),
        F.when((own < 0) | (own > 1), "self_reported_confidence: must be between 0 and 1"),
    ))


def _first_of_name(members: Column) -> Column:
    first = lambda all_: F.filter(all_, lambda m, i: F.array_position(F.transform(all_, lambda x: F.lower(x["name"])), F.lower(m["name"])) == i + 1)
    return text.let(members, first)


def sane_answer(answer: Column, blocklist=EMAIL_BLOCKLIST) -> Column:
    """A valid answer with its values tidied: clean addresses, trimmed titles, good profile urls, one member a name."""
    cut = lambda c, n: F.nullif(F.substring(text.collapse_ws(c), 1, n), F.lit(""))
    members = F.transform(F.coalesce(answer["team_members"], F.array().cast("array<struct<name:string,title:string,linkedin_url:string,affiliation:string>>")), lambda m: F.struct(text.collapse_ws(m["name"]).alias("name"), cut(m["title"], 120).alias("title"), contacts.clean_profile(m["linkedin_url"]).alias("linkedin_url"), cut(m["affiliation"], 80).alias("affiliation")))
    emails = F.array_distinct(contacts.clean_all(F.coalesce(answer["contact_emails"], F.array().cast("array<string>")), blocklist))
    return F.struct(text.collapse_ws(answer["company_overview"]).alias("company_overview"), text.collapse_ws(answer["target_audience"]).alias("target_audience"), emails.alias("contact_emails"), _first_of_name(members).alias("team_members"), F.coalesce(answer["self_reported_confidence"], F.lit(0.5)).alias("self_reported_confidence"))


def judge_attempts(responses: DataFrame) -> DataFrame:
    """Adds answer, problem (null if valid) to (domain, attempt, content, error, ...)."""
    parsed = responses.withColumn("answer", parse_answer(F.col("content"))).withColumn("faults", violations(F.col("answer")))
    number = F.col("attempt").cast("string")
    problem = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("llm call attempt "), number, F.lit(": "), "error"))
        .when(F.col("answer").isNull(), F.concat(F.lit("invalid json on attempt "), number))
        .when(F.size("faults") > 0, F.concat(F.lit("schema validation failed on attempt "), number, F.lit(": "), F.array_join(F.slice("faults", 1, 6), "; ")))
    )
    return parsed.withColumn("problem", problem)


def cost(prompt: Column, completion: Column, model: Column) -> Column:
    """Dollars of tokens, by the price table as a literal map."""
    table = lambda i: F.create_map(*[F.lit(x) for m, p in MODEL_PRICES.items() for x in (m, p[i])])
    price = lambda i: F.coalesce(F.try_element_at(table(i), model), F.lit(DEFAULT_PRICE[i]))
    return F.round(prompt / 1e6 * price(0) + completion / 1e6 * price(1), 6)


def replay(responses: DataFrame, max_attempts: int = 3, blocklist=EMAIL_BLOCKLIST) -> DataFrame:
    """One row a domain: extraction (null if no attempt was valid), usage, errors, attempts.

    Attempts count up to the first valid one or the first transport error, which is not paid; all others are."""
    judged = judge_attempts(responses.filter((F.col("attempt") >= 1) & (F.col("attempt") <= max_attempts)))
    ends = F.col("problem").isNull() | F.col("error").isNotNull()
    stop = judged.groupBy("domain").agg(F.min(F.when(ends, F.col("attempt"))).alias("last"))
    used = judged.join(stop, "domain").filter(F.col("attempt") <= F.coalesce("last", F.lit(max_attempts)))
    paid = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(paid, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).alias(c)
    out = used.groupBy("domain").agg(
        F.max_by(F.when(F.col("problem").isNull(), F.col("answer")), "attempt").alias("answer"), F.count_if(paid).alias("llm_calls"), *[total(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.max("model").alias("model"), F.array_sort(F.collect_list(F.struct("attempt", "problem"))).alias("problems"), F.max("attempt").alias("tried"),
    )
    errors = F.transform(F.filter("problems", lambda p: p["problem"].isNotNull()), lambda p: p["problem"])
    usage = F.struct("llm_calls", "prompt_tokens", "completion_tokens", "total_tokens", cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("model")).alias("estimated_cost_usd"), "model")
    return out.select("domain", F.when(F.col("answer").isNotNull(), sane_answer(F.col("answer"), blocklist)).alias("extraction"), usage.alias("usage"), errors.alias("errors"), F.when(F.col("answer").isNotNull(), F.col("tried")).otherwise(max_attempts).alias("attempts"))


def verified_only(emails: Column, harvested: Column) -> Column:
    """Strict mode: only addresses that the pages hold."""
    return F.array_intersect(emails, harvested)
