"""Network connectors as Spark data sources and provider functions. None is used unless asked for; tests use none.

Queries replay tables of pages, answers and hits, so that retries of tasks never fetch or pay again: write what a
connector gives to a table first.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.config import USER_AGENT, Settings
from millrace.schema import PAGES

TRANSIENT = (TimeoutError, ConnectionError, urllib.error.URLError)


@dataclass
class HttpError(Exception):
    """An answer that is worth no retry, or one after ``retry_after`` seconds."""

    message: str
    retry_after: float | None = None
    retry: bool = False

    def __str__(self) -> str:
        return self.message


def with_retries(call, attempts: int = 3, base: float = 1.0, most: float = 30.0, sleep=time.sleep, draw=random.random):
    """Call until it works: exponential waits with up to a quarter of jitter; a server's own wait wins."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except HttpError as error:
            if not error.retry or attempt == attempts:
                raise
            wait = error.retry_after
        except TRANSIENT:
            if attempt == attempts:
                raise
            wait = None
        sleep(min(most, base * 2 ** (attempt - 1)) * (1 + 0.25 * draw()) if wait is None else wait)


def http_get(url: str, timeout: float, headers: dict | None = None, data: bytes | None = None):
    request = urllib.request.Request(url, data=data, headers={"User-Agent": USER_AGENT} | (headers or {}))
    return urllib.request.urlopen(request, timeout=timeout)


@dataclass
class Fetcher:
    """Plain fetches, and rendered ones by ``browser``, a function of a url that gives html; it is started on first use
    and given up for good where that fails."""

    settings: Settings = field(default_factory=Settings)
    browser: object = None
    broken: bool = False

    def fetch(self, url: str) -> tuple:
        """(html, status, content type, tier, error, seconds). The status does not decide; another content type does."""
        began = time.monotonic()
        try:
            with with_retries(lambda: http_get(url, self.settings.http_timeout), self.settings.max_fetch_attempts) as answer:
                kind = answer.headers.get("content-type", "")
                if kind and "html" not in kind and "xml" not in kind:
                    return "", answer.status, kind, "http", f"unsupported content-type: {kind}", time.monotonic() - began
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), answer.status, kind, "http", None, time.monotonic() - began
        except urllib.error.HTTPError as error:
            kind = error.headers.get("content-type", "")
            body = error.read().decode("utf-8", "replace") if "html" in kind else ""
            return body, error.code, kind, "http", None if body else f"status {error.code}", time.monotonic() - began
        except Exception as error:
            return "", None, None, "http", f"{type(error).__name__}: {error}"[:180], time.monotonic() - began

    def render(self, url: str) -> tuple:
        began = time.monotonic()
        if self.browser is None or self.broken:
            return "", None, None, "browser", "browser unavailable", 0.0
        try:
            return self.browser(url), 200, "text/html", "browser", None, time.monotonic() - began
        except Exception as error:
            self.broken = isinstance(error, ImportError)
            return "", None, None, "browser", f"{type(error).__name__}: {error}"[:180], time.monotonic() - began

    def text(self, url: str) -> str | None:
        """A body with status 200, or null."""
        try:
            with http_get(url, self.settings.http_timeout) as answer:
                return (answer.read().decode("utf-8", "replace") or None) if answer.status == 200 else None
        except Exception:
            return None


@dataclass
class Host(InputPartition):
    host: str
    urls: list


class PageSource(DataSource):
    """`spark.read.format("crawl").option("urls", json of [[domain, url], ...])`: one partition a host, so that a host
    is read by one task at a time, politely."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.delay = json.loads(options.get("urls", "[]")), float(options.get("delay", Settings().politeness_delay))

    def partitions(self):
        hosts: dict[str, list] = {}
        for domain, url in self.urls:
            hosts.setdefault(urllib.parse.urlsplit(url).netloc, []).append((domain, url))
        return [Host(h, u) for h, u in sorted(hosts.items())]

    def read(self, partition):
        fetcher = Fetcher()
        for pos, (domain, url) in enumerate(partition.urls):
            if pos:
                time.sleep(self.delay)
            body, status, kind, tier, error, seconds = fetcher.fetch(url)
            yield domain, url, pos, body, status, kind, tier, error, seconds


@dataclass
class ChatModel:
    """A chat completion endpoint in JSON mode. Needs a key before any request."""

    settings: Settings

    def __post_init__(self):
        if not self.settings.llm_api_key or not self.settings.llm_base_url:
            raise ValueError("an API key and a base URL are required")

    def _open(self, path: str, body: dict | None = None) -> dict:
        headers = {"Authorization": f"Bearer {self.settings.llm_api_key}", "Content-Type": "application/json"}
        try:
            with http_get(self.settings.llm_base_url.rstrip("/") + path, self.settings.llm_timeout, headers, json.dumps(body).encode() if body else None) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            wait = error.headers.get("retry-after", "")
            raise HttpError(f"status {error.code}", float(wait) if wait.replace(".", "", 1).isdigit() else None, error.code == 429 or error.code >= 500) from error

    def call(self, messages: list[dict]) -> dict:
        body = {"model": self.settings.model, "messages": messages, "temperature": self.settings.temperature, "max_tokens": 2048, "response_format": {"type": "json_object"}}
        return with_retries(lambda: self._open("/chat/completions", body), self.settings.max_fetch_attempts)

    def models(self) -> list[str]:
        return sorted(m["id"] for m in self._open("/models").get("data", []))


class SearchProvider:
    """Gives hits as dicts of title, url, snippet."""

    def search(self, query: str, limit: int) -> list[dict]:
        raise NotImplementedError


@dataclass
class JsonSearch(SearchProvider):
    """A search API that answers in JSON: where its hits are, and how their fields are named."""

    url: str
    headers: dict
    hits: tuple[str, ...]
    fields: tuple[str, str, str]
    post: bool = False
    timeout: float = 15.0

    def search(self, query: str, limit: int) -> list[dict]:
        data = json.dumps({"q": query, "num": limit}).encode() if self.post else None
        url = self.url if self.post else f"{self.url}?{urllib.parse.urlencode({'q': query, 'count': limit})}"
        with http_get(url, self.timeout, self.headers, data) as answer:
            return self.read(json.load(answer), limit)

    def read(self, body: dict, limit: int) -> list[dict]:
        for key in self.hits:
            body = body.get(key) or {}
        rows = body if isinstance(body, list) else []
        return [{k: r.get(f) or "" for k, f in zip(("title", "url", "snippet"), self.fields)} for r in rows[:limit]]


def search_provider(settings: Settings) -> SearchProvider | None:
    """The provider asked for if its key is there; `auto` takes the first with a key. None is ever put in for another."""
    serper = lambda: JsonSearch("https://google.serper.dev/search", {"X-API-KEY": settings.serper_api_key, "Content-Type": "application/json"}, ("organic",), ("title", "link", "snippet"), True, settings.linkedin_search_timeout)
    brave = lambda: JsonSearch("https://api.search.brave.com/res/v1/web/search", {"X-Subscription-Token": settings.brave_api_key, "Accept": "application/json"}, ("web", "results"), ("title", "url", "description"), False, settings.linkedin_search_timeout)
    known = {"serper": (settings.serper_api_key, serper), "brave": (settings.brave_api_key, brave), "brave-api": (settings.brave_api_key, brave)}
    if not settings.linkedin_search_enabled or settings.linkedin_search_provider == "none":
        return None
    wanted = known if settings.linkedin_search_provider == "auto" else {k: v for k, v in known.items() if k == settings.linkedin_search_provider}
    return next((make() for key, make in wanted.values() if key), None)


@dataclass
class Throttle:
    """One query at a time, so many seconds apart. Run it in a stage of one partition."""

    provider: SearchProvider
    seconds: float
    last: float = float("-inf")

    def search(self, query: str, limit: int) -> list[dict]:
        time.sleep(max(0.0, self.seconds - (time.monotonic() - self.last)))
        try:
            return self.provider.search(query, limit)
        finally:
            self.last = time.monotonic()
