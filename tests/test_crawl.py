"""The whole run over a made-up web: robots, escalation, corrective retry, search that fails."""

import json
import sys

import pytest
from pyspark import cloudpickle

from millrace.config import Settings
from millrace.plans import crawl
from millrace.sources.connectors import SearchProvider

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

ABOUT = "Acme makes tools for data teams, and has done so for many years in many towns. "
WEB = {
    "https://acme.test/robots.txt": "User-agent: *\nDisallow: /private\nSitemap: https://acme.test/map.xml",
    "https://acme.test/map.xml": "<urlset><url><loc>https://acme.test/about</loc></url><url><loc>https://acme.test/private/team</loc></url></urlset>",
    "https://acme.test/": f"<html><head><title>Acme | Tools</title></head><body><p>{ABOUT * 12}</p><a href='/contact'>Contact</a><a href='/private/contact'>No</a></body></html>",
    "https://acme.test/about": "<html><body><div id='root'></div></body></html>",
    "https://acme.test/contact": f"<html><body><p>Write to <a href='mailto:sales@acme.test'>sales</a>. {'We answer within a day or two at most. ' * 20}</p></body></html>",
    "https://shut.test/robots.txt": "User-agent: *\nDisallow: /",
    "https://shut.test/": "<html><body>never read</body></html>",
}


class Web:
    """A fetcher that reads WEB and notes nothing down; what must not be read raises."""

    browser = True

    def text(self, url):
        return WEB.get(url) if not url.startswith("https://acme.test/private") else 1 / 0

    def fetch(self, url):
        assert "/private" not in url and url != "https://shut.test/"
        return (WEB[url], 200, "text/html", "http", None, 0.1) if url in WEB else ("", 404, None, "http", "status 404", 0.1)

    def render(self, url):
        return f"<html><body><p>{'Our people: Ada Byron, chief executive. ' * 30}</p></body></html>", 200, "text/html", "browser", None, 0.2


class Failing(SearchProvider):
    def search(self, query, limit):
        raise TimeoutError("too slow")


class Finding(SearchProvider):
    def search(self, query, limit):
        return [{"title": "Ada Byron - Acme - LinkedIn", "url": "https://www.linkedin.com/in/ada-byron", "snippet": "Acme"}]


def answer(messages):
    """Wrong at first; right once told what was wrong."""
    body = {"company_overview": "Acme makes tools for data teams.", "target_audience": "Teams that work with data", "contact_emails": ["sales@acme.test"], "team_members": [{"name": "Ada Byron", "title": "CEO"}], "self_reported_confidence": 0.9}
    if len(messages) == 1:
        body["company_overview"] = "n/a"
    else:
        assert messages[-2]["role"] == "assistant" and "company_overview" in messages[-1]["content"]
    return {"choices": [{"message": {"content": json.dumps(body)}}], "usage": {"prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 15}, "model": "m"}


@pytest.fixture(scope="module")
def settings():
    return Settings(politeness_delay=0.0, linkedin_search_delay=0.0, email_blocklist=())


@pytest.fixture(scope="module")
def domains(spark):
    return spark.createDataFrame([("https://acme.test", 0), ("shut.test", 1), ("not a host", 2)], "domain_raw string, input_pos long")


def test_run(spark, domains, settings):
    got = {r.domain: r for r in crawl.crawl_records(domains, settings, Web, answer, Finding()).collect()}
    acme = got["acme.test"]
    assert acme.status == "partial" and {p.url: p.tier for p in acme.pages_crawled} == {"https://acme.test/": "http", "https://acme.test/about": "browser", "https://acme.test/contact": "http"}
    assert acme.usage.llm_calls == 2 and acme.usage.total_tokens == 30 and "attempt 1" in acme.errors[0]
    assert [m.linkedin_url for m in acme.team_members] == ["https://www.linkedin.com/in/ada-byron"] and [e.email for e in acme.contact_emails] == ["sales@acme.test"]
    assert got["shut.test"].status == "failed" and got["not a host"].status == "failed"


def test_search_that_fails_leaves_a_note(spark, domains, settings):
    acme = crawl.crawl_records(domains, settings, Web, answer, Failing()).filter("domain = 'acme.test'").first()
    assert acme.team_members[0].linkedin_url is None and "search unavailable: TimeoutError: too slow" in acme.team_members[0].linkedin_evidence


def test_answers_that_never_hold(spark, settings):
    prompts = spark.createDataFrame([("a.test", "p"), ("b.test", "q")], "domain string, prompt string")

    def call(messages):
        if messages[0]["content"] == "q":
            raise ConnectionError("down")
        return {"choices": [{"message": {"content": "no json"}}]}

    rows = crawl.ask_model(prompts, call, settings).orderBy("domain", "attempt").collect()
    assert [(r.domain, r.attempt) for r in rows] == [("a.test", 1), ("a.test", 2), ("a.test", 3), ("b.test", 1)] and rows[-1].error == "ConnectionError: down"
