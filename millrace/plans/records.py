"""One record per domain, whatever its inputs hold: the whole dataflow as one plan keyed by domain."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import LEAST_CHARS, Settings
from millrace.functions import contacts, text, urls
from millrace.operators import corpus, extraction, people, scoring
from millrace.schema import ENRICHED, PAGE, USAGE


def pages_of_hosts(raw: DataFrame, url: str = "url", page: str = "html", order: str = "page_id") -> DataFrame:
    """A crawled corpus as pages: the host is the domain, pages are in the order of their ids."""
    where = urls.host(F.col(url))
    return raw.select(where.alias("domain"), F.col(url).alias("url"), F.col(order).alias("page_pos"), F.col(page).alias("html"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), F.lit("http").alias("tier"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("duration")).filter("domain <> ''")


def read_pages(pages: DataFrame, settings: Settings) -> DataFrame:
    """Parsed, harvested and cleaned pages. Parsing is the dear step, so its result is kept where memory allows; lost
    parts are made again."""
    parsed = corpus.harvest_pages(corpus.parse_pages(pages), settings.email_blocklist).drop("hrefs").persist(StorageLevel.MEMORY_AND_DISK)
    good = corpus.page_status(F.col("error"), F.col("html"), F.col("markdown")) == "ok"
    used = parsed.filter(good).select("domain", "url", "markdown")
    cleaned = corpus.remove_repeated_lines(used, threshold=settings.boilerplate_threshold, longest=settings.boilerplate_line_chars)
    return parsed.withColumn("status", F.when(good, "ok").otherwise("failed")).join(cleaned.select("domain", "url", "cleaned"), ["domain", "url"], "left")


def gather_sites(read: DataFrame, settings: Settings) -> DataFrame:
    """One row a domain: its page records, ordered texts, harvests and company name."""
    score = F.round(urls.relevance(F.col("url"), settings, F.col("domain")), 2)
    why = F.coalesce("error", F.when(F.col("status") != "ok", "no extractable text"))
    record = F.struct("url", "status", "tier", "http_status", F.coalesce(F.length("html"), F.lit(0)).cast("bigint").alias("raw_chars"), F.length("markdown").cast("bigint").alias("clean_chars"), score.alias("relevance_score"), why.alias("error"), F.round("duration", 2).alias("duration_seconds"))
    ordered = lambda value, keep=None: F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("page_pos").alias("o"), value.alias("v"))) if keep is not None else F.struct(F.col("page_pos").alias("o"), value.alias("v"))))
    ok = F.col("status") == "ok"
    rows = read.groupBy("domain").agg(
        ordered(record).alias("records"), ordered(F.struct("url", F.col("cleaned").alias("text")), ok).alias("texts"), F.min_by("title", "page_pos").alias("title"),
        *[corpus.in_order(c, "page_pos").alias(c) for c in ("emails", "profiles", "companies")],
    )
    values = lambda c: F.transform(c, lambda x: x["v"])
    return rows.select("domain", values(F.col("records")).alias("pages_crawled"), values(F.col("texts")).alias("pages"), "emails", "profiles", "companies", urls.company_name(F.col("title"), F.col("domain")).alias("company_name"))


def extractive_answers(sites: DataFrame, settings: Settings) -> DataFrame:
    """Answers made of the pages' own words, in the shape of a model's: a provider that needs no network."""
    prompts = corpus.build_prompts(sites, settings)
    lines = F.filter(F.flatten(F.transform("pages", lambda p: F.split(p["text"], r"\R"))), lambda x: F.length(text.strip(x)) >= 40)
    first = lambda i: text.collapse_ws(F.coalesce(F.get(lines, F.lit(i)), F.get(lines, F.lit(0)), F.lit("")))
    none = F.array().cast("array<struct<name:string,title:string,linkedin_url:string,affiliation:string>>")
    content = F.to_json(F.struct(first(0).alias("company_overview"), first(1).alias("target_audience"), F.col("emails").alias("contact_emails"), none.alias("team_members"), F.lit(0.5).alias("self_reported_confidence")))
    tokens = text.estimate_tokens(F.col("prompt"))
    return prompts.select("domain", F.lit(1).alias("attempt"), content.alias("content"), tokens.cast("bigint").alias("prompt_tokens"), text.estimate_tokens(content).cast("bigint").alias("completion_tokens"), (tokens + text.estimate_tokens(content)).cast("bigint").alias("total_tokens"), F.lit(settings.model).alias("model"), F.lit(None).cast("string").alias("error"))


def marked_members(found: DataFrame) -> DataFrame:
    """The people of (domain, company_name, extraction), each with ``own``."""
    members = found.filter("extraction is not null").select("domain", F.posexplode("extraction.team_members").alias("pos", "m")).select("domain", "pos", "m.*")
    return people.mark_own(people.with_company(members, found.select("domain", "company_name")))


def by_seniority(marked: DataFrame) -> DataFrame:
    """A site's own people; ``pos`` becomes a struct that puts the most senior first, to whom the lookup budget goes."""
    return marked.filter("own").withColumn("pos", F.struct(people.seniority_rank(F.col("title")).alias("tier"), F.col("pos").alias("place")))


def domain_records(domains: DataFrame, pages: DataFrame, settings: Settings | None = None, responses: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """One record per row of ``domains`` (domain_raw, input_pos), in its order. Bad names, sites without pages or text,
    and answers that never validate give failed records."""
    settings = settings or Settings()
    asked = domains.select("domain_raw", "input_pos", urls.normalise_domain(F.col("domain_raw")).alias("key"))
    sites = gather_sites(read_pages(pages, settings), settings).persist(StorageLevel.MEMORY_AND_DISK)
    enough = F.aggregate("pages", F.lit(0), lambda a, p: a + F.length(p["text"])) >= LEAST_CHARS
    rich = sites.filter(enough)
    answers = extractive_answers(rich, settings) if responses is None else responses
    replayed = extraction.replay(answers, settings.llm_max_attempts, settings.email_blocklist)
    replayed = replayed.persist(StorageLevel.MEMORY_AND_DISK)
    found = rich.join(replayed, "domain", "left")

    marked = marked_members(found)
    own = by_seniority(marked)
    verified = found.select("domain", F.explode("profiles").alias("url"))
    resolved = people.resolve_team(own, verified, hits, settings)
    team = people.ranked_team(resolved.filter(people.has_evidence(F.col("title"), F.col("linkedin_url"))))
    notes = people.own_team_notes(marked).withColumn("o", F.lit(0)).unionByName(people.evidence_notes(resolved).withColumn("o", F.lit(1)))
    notes = notes.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "note"))), lambda x: x["note"]).alias("notes"))

    own_columns = [F.col(c) for c in ("domain", "pages_crawled", "emails", "company_name")]
    whole = sites.select(*own_columns, enough.alias("enough")).join(replayed, "domain", "left").join(team, "domain", "left").join(notes, "domain", "left")
    joined = asked.join(whole.withColumnRenamed("domain", "key"), "key", "left")

    def empty(kind):
        return F.array().cast(f"array<{kind}>")

    mail = F.coalesce("extraction.contact_emails", empty("string"))
    if settings.strict_emails:
        mail = extraction.verified_only(mail, F.coalesce("emails", empty("string")))
    points, personal = contacts.split_contacts(F.col("mail"), settings.email_blocklist)
    staged = joined.withColumns({"mail": mail, "shown": F.coalesce("pages_crawled", empty(PAGE)), "crew": F.coalesce("team", empty(ENRICHED)), "told": F.coalesce("errors", empty("string")), "answered": F.coalesce(F.col("enough") & F.col("extraction").isNotNull(), F.lit(False))})
    staged = staged.withColumns({"points": points, "personal": personal})
    shown, crew, told, answered = (F.col(c) for c in ("shown", "crew", "told", "answered"))
    errors = (
        F.when(F.col("key").isNull(), F.array(F.concat(F.lit("invalid domain: not a valid hostname: '"), "domain_raw", F.lit("'"))))
        .when(F.col("pages_crawled").isNull(), F.array(F.lit("homepage unreachable: no page")))
        .when(~F.col("enough"), F.array(F.lit("insufficient text extracted for a meaningful LLM call")))
        .otherwise(told)
    )
    scored = scoring.breakdown(F.col("extraction.company_overview"), F.col("extraction.target_audience"), F.col("points"), crew, shown, F.col("extraction.self_reported_confidence"), F.coalesce("attempts", F.lit(0)), told, F.coalesce("notes", empty("string")), answered, settings.max_pages_per_domain, settings.llm_max_attempts)
    staged, nothing = staged.withColumns({"scored": scored, "wrong": errors}), F.lit(None)
    scored, errors, points, personal = F.col("scored"), F.col("wrong"), F.col("points"), F.col("personal")
    return staged.select(
        F.coalesce("key", "domain_raw").alias("domain"), F.coalesce(urls.root_url(F.col("domain_raw")), F.lit("")).alias("url"), scoring.record_status(answered, shown, errors).alias("status"),
        *[F.when(answered, F.col(f"extraction.{c}")).otherwise(nothing).alias(c) for c in ("company_overview", "target_audience")],
        points.alias("contact_emails"), personal.alias("personal_emails"), crew.alias("team_members"), scored["final"].alias("data_confidence_score"), scored.alias("confidence_breakdown"), shown.alias("pages_crawled"),
        F.coalesce("usage", F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("llm_calls", "prompt_tokens", "completion_tokens", "total_tokens")], F.lit(0.0).alias("estimated_cost_usd"), F.lit(settings.model).alias("model")).cast(USAGE)).alias("usage"),
        errors.alias("errors"), F.lit(0.0).alias("duration_seconds"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("extracted_at"), "input_pos",
    ).orderBy("input_pos").drop("input_pos")
