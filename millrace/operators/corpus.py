"""Operators over the pages of a site: parsing, repeated lines, harvests, prompt budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import ESCALATE_STATUSES, THIN_CHARS, Settings
from millrace.functions import contacts, html, text


def parse_pages(pages: DataFrame) -> DataFrame:
    """Adds markdown, hrefs and title; each page is parsed once."""
    return pages.withColumn("parsed", html.parse_page("html")).select(*pages.columns, "parsed.markdown", "parsed.hrefs", "parsed.title")


def lines(body: Column) -> Column:
    return F.split(body, r"\R")


def line_frequencies(pages: DataFrame, key: str = "domain", page: str = "url", body: str = "markdown", threshold: float = 0.6, longest: int = 200) -> DataFrame:
    """(key, line, pages): lines on so many pages of a site of three or more that they are no content.

    Lines are counted by (key, line) with partial sums, each page once, so a hot site is spread over its lines."""
    own = pages.select(F.col(key), F.array_distinct(F.filter(F.transform(lines(F.col(body)), text.strip), lambda x: x != "")).alias("lines"))
    sites = pages.groupBy(key).agg(F.count("*").alias("n")).filter("n >= 3")
    counts = own.select(key, F.explode("lines").alias("line")).groupBy(key, "line").agg(F.count("*").alias("pages")).filter("pages > 1")
    cut = F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(threshold)))
    return counts.join(sites, key).filter((F.col("pages") >= cut) & (F.length("line") <= longest)).select(key, "line", "pages")


def remove_repeated_lines(pages: DataFrame, key: str = "domain", page: str = "url", body: str = "markdown", threshold: float = 0.6, longest: int = 200, floor: float = 0.15) -> DataFrame:
    """``pages`` with ``cleaned``: the body without its site's repeated lines, or as it is where too little would stay.

    The repeated lines of a page are found by a join on (key, line), and come back as one small array a page."""
    repeated = line_frequencies(pages, key, page, body, threshold, longest)
    touched = repeated.select(key).distinct().withColumn("touched", F.lit(True))
    own = pages.select(key, page, F.explode(F.array_distinct(F.transform(lines(F.col(body)), text.strip))).alias("line"))
    found = own.join(repeated, [key, "line"]).groupBy(key, page).agg(F.collect_set("line").alias("repeated"))
    out = pages.join(found, [key, page], "left").join(touched, key, "left")
    kept = F.filter(lines(F.col(body)), lambda x: ~F.coalesce(F.array_contains("repeated", text.strip(x)), F.lit(False)))
    stripped = text.strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))
    whole = F.length(text.strip(F.col(body)))
    cleaned = F.when(F.col("touched").isNull(), F.col(body)).when((whole > 0) & (F.length(stripped) < whole * F.lit(floor)), F.col(body)).otherwise(stripped)
    return out.select(*pages.columns, cleaned.alias("cleaned"))


def harvest_pages(pages: DataFrame, blocklist) -> DataFrame:
    """Adds emails, profiles and companies of each page (html, markdown, hrefs): addresses in links, html, text."""
    # one function for both, since each has workers of its own
    decoded = pages.withColumn("decoded", text.decode_escapes(F.array("html", "markdown"))).withColumns({"html_text": F.get("decoded", F.lit(0)), "body_text": F.get("decoded", F.lit(1))})
    mailto = F.transform(F.filter(F.col("hrefs"), lambda x: F.startswith(F.lower(x), F.lit("mailto:"))), lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))
    none = F.array().cast("array<string>")
    emails = F.concat(F.coalesce(contacts.clean_all(mailto, blocklist), none), F.coalesce(contacts.addresses_in(F.col("html_text"), blocklist), none), F.coalesce(contacts.addresses_in(F.col("body_text"), blocklist), none))
    linked = F.filter(F.transform(F.filter(F.col("hrefs"), lambda x: F.contains(F.lower(x), F.lit("linkedin.com/"))), contacts.clean_profile), lambda x: x.isNotNull())
    urls = F.array_distinct(F.concat(F.coalesce(linked, none), F.coalesce(contacts.profiles_in(F.col("html")), none), F.coalesce(contacts.profiles_in(F.col("markdown")), none)))
    out = decoded.withColumn("urls", urls).withColumn("emails", contacts.by_preference(emails))
    return out.withColumn("profiles", F.filter("urls", lambda x: ~contacts.is_company_page(x))).withColumn("companies", F.filter("urls", contacts.is_company_page)).drop("decoded", "html_text", "body_text", "urls")


def in_order(column: str, order: str) -> Column:
    """Aggregate: the arrays of a group end to end by ``order``, first occurrences kept."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(parts, lambda x: x["v"])))


def harvest_sites(pages: DataFrame, key: str = "domain", order: str = "page_pos") -> DataFrame:
    return pages.groupBy(key).agg(*[in_order(c, order).alias(c) for c in ("emails", "profiles", "companies")])


def budget_pages(pages: Column, per_page: int, per_site: int) -> Column:
    """A fold over an ordered array of (url, text): clips as (url, text), each within what earlier ones left."""

    def step(state, page):
        allow = F.least(F.lit(per_page), F.lit(per_site) - state["spent"])
        clip = F.when(allow > 0, text.truncate_to_chars(page["text"], allow)).otherwise("")
        keep = (state["spent"] < per_site) & (text.strip(clip) != "")
        return F.struct(F.when(keep, state["spent"] + F.length(clip)).otherwise(state["spent"]).alias("spent"), F.when(keep, F.concat(state["clips"], F.array(F.struct(page["url"].alias("url"), clip.alias("text"))))).otherwise(state["clips"]).alias("clips"))

    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<struct<url:string,text:string>>").alias("clips"))
    return F.aggregate(pages, start, step, lambda s: s["clips"])


def build_prompts(sites: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``prompt`` from domain, pages (ordered (url, text)), emails, profiles, companies."""
    listed = lambda c, n: F.when(F.size(c) > 0, F.array_join(F.transform(F.slice(c, 1, n), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- (none found)")
    clips = F.transform(budget_pages(F.col("pages"), settings.max_chars_per_page, settings.max_chars_per_domain), lambda p: F.concat(F.lit("--- PAGE: "), p["url"], F.lit(" ---\n"), p["text"]))
    # fixed values: the headings of the prompt
    parts = F.array(
        F.concat(F.lit("COMPANY DOMAIN: "), "domain", F.lit("\n")),
        F.concat(F.lit("VERIFIED EMAILS (parsed from the HTML - the only ones you may use):\n"), listed(F.col("emails"), 25)),
        F.concat(F.lit("VERIFIED LINKEDIN PROFILES (the only ones you may use):\n"), listed(F.col("profiles"), 25)),
        F.when(F.size("companies") > 0, F.concat(F.lit("COMPANY LINKEDIN PAGES (context only, not for team_members):\n"), listed(F.col("companies"), 5))),
        F.concat(F.lit("WEBSITE CONTENT:\n\n"), F.array_join(clips, "\n\n")),
    )
    return sites.withColumn("prompt", F.array_join(F.array_compact(parts), "\n\n"))


def escalation_reason(error: Column, status: Column, clean_chars: Column) -> Column:
    """Why a page is worth a second, rendered fetch; null if it isn't."""
    return F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("http error ("), error, F.lit(")"))).when(status.isin(*ESCALATE_STATUSES), F.concat(F.lit("status "), status.cast("string"))).when(clean_chars < THIN_CHARS, F.concat(F.lit("thin content ("), clean_chars.cast("string"), F.lit(" chars)")))


def choose_tier(plain: DataFrame, rendered: DataFrame) -> DataFrame:
    """Per (domain, url) the rendered page where the plain one calls for it and the rendered has as much text. Only pages
    with a reason meet the rendered ones."""
    need = plain.withColumn("reason", escalation_reason(F.col("error"), F.col("http_status"), F.length("markdown")))
    other = rendered.select("domain", "url", F.struct("html", "markdown", "http_status", "error").alias("r"))
    both = need.join(other, ["domain", "url"], "left")
    usable = (F.length("r.html") > 0) & F.col("r.error").isNull()
    better = F.coalesce(F.col("reason").isNotNull() & usable & (F.length("r.markdown") >= F.length("markdown")), F.lit(False))
    lost = F.col("reason").isNotNull() & ~F.coalesce(usable, F.lit(False)) & (F.coalesce(F.length("html"), F.lit(0)) == 0)
    pick = lambda c: F.when(better, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    failed = text.compact_error(F.concat(F.coalesce("error", "reason"), F.lit("; browser: "), F.coalesce("r.error", F.lit("not fetched"))), 220)
    return both.select("domain", "url", pick("html"), pick("markdown"), pick("http_status"), F.when(better, F.lit(None)).when(lost, failed).otherwise(F.col("error")).alias("error"), F.when(better, "browser").when(lost, "none").otherwise("http").alias("tier"), "reason")


def page_status(error: Column, page: Column, markdown: Column) -> Column:
    """`ok` if there is a page, no error, and text; the HTTP status does not count."""
    good = F.coalesce(error.isNull() & (F.length(page) > 0) & (markdown != ""), F.lit(False))
    return F.when(good, "ok").otherwise("failed")


def rank_by(partition: str, *order) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))
