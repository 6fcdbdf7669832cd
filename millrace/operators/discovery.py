"""Which pages of a site to read: robots, sitemaps, links, pruning, ranking."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.config import USER_AGENT, Settings
from millrace.functions import html, urls

MAX_URLS, MAX_NESTED = 3000, 5
#: Where sitemaps usually are.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")


def declared_sitemaps(body: Column) -> Column:
    found = F.filter(F.split(body, r"\R"), lambda x: F.startswith(F.lower(x), F.lit("sitemap:")))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))


def robots_allow(settings: Settings):
    """A function of (robots body, url): True if the rules let the agent read it, or can't be read."""
    agent, respect = USER_AGENT, settings.respect_robots

    @F.pandas_udf(T.BooleanType())
    def allow(bodies: pd.Series, links: pd.Series) -> pd.Series:
        rules: dict[str, RobotFileParser] = {}

        def one(body, url):
            if not respect or not body:
                return True
            try:
                if body not in rules:
                    rules[body] = RobotFileParser()
                    rules[body].parse(body.splitlines())
                return rules[body].can_fetch(agent, url)
            except Exception:
                return True

        return pd.Series([one(b, u) for b, u in zip(bodies, links)])

    return allow


def read_sitemap(body: str | None) -> tuple[bool, list[str]] | None:
    """(is an index, locations), or null if it isn't XML."""
    try:
        root = ElementTree.fromstring((body or "").encode("utf-8", "ignore"))
    except (ElementTree.ParseError, ValueError):
        return None
    local = lambda tag: tag.rpartition("}")[2] if isinstance(tag, str) else ""
    return local(root.tag) == "sitemapindex", [(e.text or "").strip() for e in root.iter() if local(e.tag) == "loc"]


def crawl_sitemaps(bodies: dict[str, str], first: list[str]) -> list[str]:
    """Locations in the order of a queue over given sitemaps: declared ones, then what indexes lead to, within caps."""
    queue, seen, nested, out = list(first), set(), 0, []
    while queue and len(out) < MAX_URLS:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        known = read_sitemap(bodies.get(url)) if bodies.get(url) else None
        if known is None:
            continue
        index, found = known
        if not index:
            out += found
            continue
        for child in found:
            if nested < MAX_NESTED and re.search("page|main|root|sitemap", child, re.I):
                queue.append(child)
                nested += 1
        if not queue and found:
            queue += found[:MAX_NESTED]
            nested += MAX_NESTED
    return out[:MAX_URLS]


def sitemap_urls(sitemaps: DataFrame, robots: DataFrame) -> DataFrame:
    """(domain, url, pos) from (domain, sitemap_url, body) and the sitemaps that robots bodies declare.

    A site's own sitemaps are few and bounded by the caps; sites are dealt over tasks."""

    def one(key, maps: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
        domain = key[0]
        declared = [u for d in rules["declared"] for u in d]
        found = crawl_sitemaps(dict(zip(maps["sitemap_url"], maps["body"])), declared + [f"https://{domain}{p}" for p in SITEMAP_PATHS])
        return pd.DataFrame({"domain": pd.Series([domain] * len(found), dtype=object), "url": pd.Series(found, dtype=object), "pos": range(len(found))})

    rules = robots.select("domain", F.coalesce(declared_sitemaps(F.col("body")), F.array().cast("array<string>")).alias("declared"))
    return sitemaps.groupBy("domain").cogroup(rules.groupBy("domain")).applyInPandas(one, "domain string, url string, pos int")


def link_candidates(pages: DataFrame) -> DataFrame:
    """(domain, url, pos): the links of pages (domain, url, hrefs) in document order, made absolute."""
    own = pages.select("domain", F.posexplode(html.resolve_links("url", "hrefs")).alias("pos", "url"))
    return own.select("domain", "url", "pos")


def prune(candidates: DataFrame, settings: Settings, robots: DataFrame | None = None) -> DataFrame:
    """Distinct normalised candidates (domain, url, first_pos) of the site, html, shallow, and allowed.

    Cheap expressions come first; robots rules, the one Python function, see only what is left."""
    clean = candidates.select("domain", urls.normalise_url(F.col("url")).alias("url"), "pos")
    home = urls.normalise_url(F.concat(F.lit("https://"), F.col("domain")))
    clean = clean.filter((F.col("url") != home) & urls.same_site(F.col("url"), F.col("domain")) & urls.looks_like_html(F.col("url")) & (urls.depth(F.col("url")) <= settings.candidate_depth))
    clean = clean.groupBy("domain", "url").agg(F.min("pos").alias("first_pos"))
    if robots is None:
        return clean
    ruled = clean.join(robots.select("domain", "body"), "domain", "left")
    return ruled.filter(robots_allow(settings)("body", "url")).drop("body")


def top_pages(candidates: DataFrame, settings: Settings) -> DataFrame:
    """The best pages of each domain with a positive score; ties keep the order of candidates. Spark limits each task's
    rows to the rank before it shuffles them."""
    scored = candidates.withColumn("score", urls.relevance(F.col("url"), settings, F.col("domain"))).filter("score > 0")
    order = Window.partitionBy("domain").orderBy(F.desc("score"), "first_pos")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(0, settings.max_pages_per_domain - 1))


def discover(homes: DataFrame, sitemaps: DataFrame, robots: DataFrame, settings: Settings) -> DataFrame:
    """Sitemap locations come before links; then prune and rank."""
    both = sitemap_urls(sitemaps, robots).unionByName(link_candidates(homes).withColumn("pos", F.col("pos") + MAX_URLS))
    return top_pages(prune(both, settings, robots), settings)
