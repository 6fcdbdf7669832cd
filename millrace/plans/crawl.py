"""A whole run from a list of domains: discover, fetch, ask a model, search for people, then one record per domain.

Every stage that talks to the network is written down before the next one reads it, so that a task that runs again asks
nothing twice. Sites are dealt over tasks; a site is read by one task at a time."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import LEAST_CHARS, Settings
from millrace.functions import html, text, urls
from millrace.operators import corpus, discovery, extraction, people
from millrace.plans import records
from millrace.schema import PAGES, RESPONSES, SEARCH
from millrace.sources.connectors import Fetcher, SearchProvider, Throttle

#: What is sent back with an answer that does not hold.
CORRECTION = "That answer was rejected: {problem}. Answer again with one JSON object that mends this and keeps the rest."


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint in the shared folder of ``spark.checkpoint.dir``, or where none is named
    (one machine) kept in memory and on disk."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        return out
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint()


class _Bodies:
    """Sitemaps by url, fetched when they are first asked for."""

    def __init__(self, fetcher):
        self.fetcher, self.known = fetcher, {}

    def get(self, url: str) -> str | None:
        if url not in self.known:
            self.known[url] = self.fetcher.text(url)
        return self.known[url]


def site_fronts(domains: DataFrame, make: Callable[[], Fetcher]) -> DataFrame:
    """(domain, url, kind, body): robots rules and sitemaps of each domain, as far as they can be read."""

    def run(frames):
        fetcher = make()
        for frame in frames:
            out = []
            for domain in frame["domain"]:
                rules = fetcher.text(f"https://{domain}/robots.txt")
                out.append((domain, f"https://{domain}/robots.txt", "robots", rules))
                declared = [line.partition(":")[2].strip() for line in (rules or "").splitlines() if line.lower().startswith("sitemap:")]
                maps = _Bodies(fetcher)
                discovery.crawl_sitemaps(maps, declared + [f"https://{domain}{p}" for p in discovery.SITEMAP_PATHS])
                out += [(domain, url, "sitemap", body) for url, body in maps.known.items() if body]
            yield pd.DataFrame(out, columns=["domain", "url", "kind", "body"])

    return domains.select("domain").mapInPandas(run, "domain string, url string, kind string, body string")


def fetch_pages(wanted: DataFrame, make: Callable[[], Fetcher], settings: Settings, rendered: bool = False) -> DataFrame:
    """Pages of (domain, url, page_pos), plain or rendered; the pages of a domain one after another, politely."""

    def run(frames):
        fetcher, last = make(), None
        for frame in frames:
            out = []
            for domain, url, pos in zip(frame["domain"], frame["url"], frame["page_pos"]):
                if domain == last:
                    time.sleep(settings.politeness_delay)
                body, status, kind, tier, error, seconds = fetcher.render(url) if rendered else fetcher.fetch(url)
                out.append((domain, url, pos, body, status, kind, tier, error, seconds))
                last = domain
            page = pd.DataFrame(out, columns=["domain", "url", "page_pos", "html", "http_status", "content_type", "tier", "error", "duration"])
            yield page.astype({"http_status": "Int32", "page_pos": "int32"})

    dealt = wanted.select("domain", "url", "page_pos").repartition("domain").sortWithinPartitions("domain", "page_pos")
    return dealt.mapInPandas(run, PAGES)


def escalated(pages: DataFrame, make: Callable[[], Fetcher], settings: Settings) -> DataFrame:
    """``pages`` with those that call for it rendered, where that gives as much text."""
    plain = pages.withColumn("markdown", html.parse_page("html")["markdown"])
    reason = corpus.escalation_reason(F.col("error"), F.col("http_status"), F.length("markdown"))
    need = settled(plain.filter(reason.isNotNull()).select("domain", "url", "page_pos"))
    if not need.take(1):
        return pages
    rendered = settled(fetch_pages(need, make, settings, rendered=True)).withColumn("markdown", html.parse_page("html")["markdown"])
    chosen = corpus.choose_tier(plain, rendered).select("domain", "url", "html", "http_status", "error", "tier")
    return pages.select("domain", "url", "page_pos", "content_type", "duration").join(chosen, ["domain", "url"]).select(*[c.split(" ")[0] for c in PAGES.split(", ")])


def crawl_pages(domains: DataFrame, make: Callable[[], Fetcher], settings: Settings) -> DataFrame:
    """The pages of each (domain): its front page, then the best of what sitemaps and links lead to; robots rules hold
    for every one of them, the front page too."""
    fronts = settled(site_fronts(domains.select("domain").distinct(), make))
    robots = fronts.filter("kind = 'robots'").select("domain", "body")
    sitemaps = fronts.filter("kind = 'sitemap'").select("domain", F.col("url").alias("sitemap_url"), "body")
    home = robots.withColumn("url", F.concat(F.lit("https://"), "domain", F.lit("/"))).filter(discovery.robots_allow(settings)("body", "url"))
    homes = settled(fetch_pages(home.select("domain", "url", F.lit(0).alias("page_pos")), make, settings))
    linked = corpus.parse_pages(homes).select("domain", "url", "hrefs")
    best = discovery.discover(linked, sitemaps, robots, settings).select("domain", "url", F.col("rank").cast("int").alias("page_pos"))
    rest = settled(fetch_pages(best, make, settings))
    return settled(escalated(homes.unionByName(rest), make, settings))


def ask_model(prompts: DataFrame, call: Callable[[list[dict]], dict], settings: Settings, system: str = "") -> DataFrame:
    """Answers (RESPONSES) to (domain, prompt). An answer that is no JSON or breaks the schema goes back with what is
    wrong with it, up to ``llm_max_attempts`` times; a transport error ends a domain's turn."""
    opening = F.array(*([F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))] if system else []), F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    open_, answers = prompts.select("domain", opening.alias("messages")), None

    def turn(attempt: int):
        def run(frames):
            for frame in frames:
                out = []
                for domain, messages in zip(frame["domain"], frame["messages"]):
                    try:
                        got = call(json.loads(messages))
                        used = got.get("usage") or {}
                        out.append((domain, attempt, got["choices"][0]["message"]["content"], *[used.get(k) or 0 for k in ("prompt_tokens", "completion_tokens", "total_tokens")], got.get("model") or settings.model, None))
                    except Exception as error:  # told in the record
                        out.append((domain, attempt, None, 0, 0, 0, settings.model, f"{type(error).__name__}: {error}"[:180]))
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESPONSES.split(", ")]).astype({"attempt": "int32"})

        return run

    for attempt in range(1, settings.llm_max_attempts + 1):
        asked = settled(open_)
        got = settled(asked.withColumn("messages", F.to_json("messages")).mapInPandas(turn(attempt), RESPONSES))
        answers = got if answers is None else answers.unionByName(got)
        wrong = extraction.judge_attempts(got).filter("problem is not null and error is null").select("domain", "content", "problem")
        if not wrong.take(1):
            break
        told = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("content", F.lit("")).alias("content")), F.struct(F.lit("user").alias("role"), F.replace(F.lit(CORRECTION), F.lit("{problem}"), F.col("problem")).alias("content")))
        open_ = asked.join(wrong, "domain").select("domain", F.concat("messages", told).alias("messages"))
    return answers


def search_people(asked: DataFrame, provider: SearchProvider, settings: Settings) -> DataFrame:
    """Hits (SEARCH) of (domain, name_key, query), one query at a time. A provider that fails gives an error row, and the
    rest of the run goes on."""

    def run(frames):
        line = Throttle(provider, settings.linkedin_search_delay)
        for frame in frames:
            out = []
            for domain, key, query in zip(frame["domain"], frame["name_key"], frame["query"]):
                try:
                    hits = line.search(query, settings.linkedin_search_results)
                    out += [(domain, key, i, h.get("title"), h.get("url"), h.get("snippet"), None) for i, h in enumerate(hits, 1)]
                except Exception as error:  # told in the notes of the team
                    out.append((domain, key, None, None, None, None, f"{type(error).__name__}: {error}"[:180]))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SEARCH.split(", ")]).astype({"rank": "Int32"})

    return asked.select("domain", "name_key", "query").coalesce(1).mapInPandas(run, SEARCH)  # a search account is one queue


def lookups(found: DataFrame, settings: Settings) -> DataFrame:
    """(domain, name_key, query) of the people whose profiles their sites do not show, within each domain's budget."""
    own = records.by_seniority(records.marked_members(found))
    known = people.lookup_budget(people.verify_profiles(own, found.select("domain", F.explode("profiles").alias("url"))), settings.linkedin_search_max_lookups)
    wanted = known.filter(F.col("turn") <= settings.linkedin_search_max_lookups).withColumn("name_key", text.fold("name"))
    return wanted.select("domain", "name_key", people.query_text(F.col("name"), F.col("title"), F.col("domain"), F.col("company_name")).alias("query")).dropDuplicates(["domain", "name_key"])


def crawl_records(domains: DataFrame, settings: Settings | None = None, make: Callable[[], Fetcher] | None = None, call: Callable[[list[dict]], dict] | None = None, provider: SearchProvider | None = None) -> DataFrame:
    """One record per row of ``domains`` (domain_raw, input_pos), from the live web or whatever ``make`` reads.

    Without ``call`` answers are made of the pages' own words; without ``provider`` nobody is searched for."""
    settings = settings or Settings()
    sites = domains.select(urls.normalise_domain(F.col("domain_raw")).alias("domain")).filter("domain is not null")
    pages = crawl_pages(sites, make or (lambda: Fetcher(settings)), settings)
    gathered = settled(records.gather_sites(records.read_pages(pages, settings), settings))
    rich = gathered.filter(F.aggregate("pages", F.lit(0), lambda a, p: a + F.length(p["text"])) >= LEAST_CHARS)
    answers = ask_model(corpus.build_prompts(rich, settings).select("domain", "prompt"), call, settings) if call else records.extractive_answers(rich, settings)
    hits = None
    if provider is not None and settings.linkedin_search_enabled:
        found = rich.join(extraction.replay(answers, settings.llm_max_attempts, settings.email_blocklist), "domain")
        hits = settled(search_people(settled(lookups(found, settings)), provider, settings))
    return records.domain_records(domains, pages, settings, answers, hits)
