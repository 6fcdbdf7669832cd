"""Invented rows for queries whose inputs the supplied tables lack, for Spark and as SQL alike."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

MAILBOXES = ("n long, email string", [(i, e) for i, e in enumerate((
    "sales-emea@acme.test", "salesforce@acme.test", "help-events@acme.test", "abuse@acme.test", "legal@acme.test", "talent@acme.test", "info-jp@acme.test", "accommodations@acme.test", "jo.doe@acme.test", "j.doe@acme.test", "careers@acme.test", "care@acme.test",
    "no-reply@acme.test", "x9y@acme.test", "sales+uk@acme.test", "press2024@acme.test", "pressure@acme.test", "team@acme.test", "---@acme.test", "anna_maria.lee@acme.test", "hr@acme.test", "hrx@acme.test", "api-team@acme.test", "hello.world@acme.test", "24x7@acme.test",
))])
RAW_EMAILS = ("n long, raw string", [(i, e) for i, e in enumerate((
    "mailto:Info@Acme.io?subject=x", "&gt;sales@acme.io", "u003einfo@acme.io", "u003eu003cinfo@acme.io", "  (help@acme.io).  ", "logo@2x.png", "vue@4.2.0.c6.mjs", "a.jsmith@acme.io", "x@acme.co.uk", "no at sign", "", "a@b", "me@mydomain.com", "ok+tag@sub.acme.io", "n@10.20.acme.io", "l" * 115 + "@acme.io", "<jo@acme.io>", "'jo@acme.io'", "jo@acme.io;",
))])
PROFILES = ("n long, raw string", [(i, e) for i, e in enumerate((
    "http://www.linkedin.com/in/jo-doe-1/?x=1", "//uk.linkedin.com/in/jo-doe", "www.linkedin.com/pub/jo-doe/a/b", "linkedin.com/company/acme/", "https://linkedin.com/in/ab", "https://example.test/in/jo-doe", "https://LINKEDIN.com/in/Jo-Doe", "https://www.linkedin.com/jobs/view/1", "", "https://de.linkedin.com/in/st%C3%A9phane-dubois",
))])
DOMAINS = ("domain_raw string, input_pos long", [(d, i) for i, d in enumerate((
    "https://www.Acme.test/pricing/", "acme.test", "# comment", "", "beta.test, Beta Inc", "user@gamma.test:8080", "not a domain", "localhost", "WWW.beta.test", "http://delta-x.co.test?q", "-bad.test", "a..b.test",
))])
TITLES = ("n long, title string", [(i, t) for i, t in enumerate((
    "Co-Founder & CEO", "CEO", "Chief of Staff", "CTO", "Director of Engineering", "Vice President, Sales", "VP Sales", "Head of People", "Engineering Manager", "Staff Engineer", "Product Owner", "Coordinator", "President", "Engineer", "", None, "General Counsel", "Managing Director",
))])
COMPANIES = ("domain string, company_name string", [("acme-data.test", "Acme Data"), ("beta.test", "Beta Labs"), ("gamma.test", "")])
MEMBERS = ("domain string, pos long, name string, title string, linkedin_url string, affiliation string", [
    ("acme-data.test", 0, "Ada Byron", "Co-Founder & CEO", "https://www.linkedin.com/in/ada-byron", None), ("acme-data.test", 1, "Bo Lind", None, None, "Acme Data Inc"), ("acme-data.test", 2, "Cy Moss", "Engineer", "https://linkedin.com/in/invented", "Other Org"),
    ("acme-data.test", 3, "Di Noor", None, None, "acmedata"), ("acme-data.test", 4, "Ed Park", "", None, ""), ("acme-data.test", 5, "Fay Quill", "VP, Engineering", None, None), ("acme-data.test", 6, "Gus Rho", "Designer", None, None), ("acme-data.test", 7, "Hal Stone", "Recruiter", None, None),
    ("beta.test", 0, "Ivy Tan", "Product Manager", "https://linkedin.com/in/ivytan/", "Beta"), ("beta.test", 1, "Jon Ude", "Customer", None, "Lovable"), ("beta.test", 2, "Kim Vale", "Advisor", None, "Labs"), ("gamma.test", 0, "Lea Wynn", "Founder", None, "gam"),
])
VERIFIED = ("domain string, url string", [("acme-data.test", "http://www.linkedin.com/in/ada-byron/"), ("acme-data.test", "https://linkedin.com/in/ada-byron?x=1"), ("beta.test", "https://uk.linkedin.com/in/ivytan"), ("beta.test", "https://linkedin.com/company/beta")])
HITS = ("domain string, name_key string, rank int, title string, url string, snippet string, error string", [
    ("acme-data.test", "bo lind", 1, "Bo Lind - LinkedIn", "https://linkedin.com/in/other-person", "Acme Data", None), ("acme-data.test", "bo lind", 2, "Bo Lind - Head of Data at Acme Data - LinkedIn", "https://www.linkedin.com/in/bo-lind-7", "Works at Acme Data.", None), ("acme-data.test", "bo lind", 3, "Bo Lind | LinkedIn", "https://www.linkedin.com/in/bo-lind-9", "Acme Data", None),
    ("acme-data.test", "di noor", 1, "Di Noor - LinkedIn", "https://www.linkedin.com/in/di-noor", "Baker in a town", None), ("acme-data.test", "fay quill", 1, "Fay Quill - Acme Data - LinkedIn", "https://www.linkedin.com/in/fq123", "Profile of a person", None), ("acme-data.test", "gus rho", 1, None, None, None, "timeout"),
    ("beta.test", "kim vale", 1, "Kim Vale - Advisor, Beta - LinkedIn", "https://www.linkedin.com/in/kimvale", "", None), ("gamma.test", "lea wynn", 1, "Lea Wynn - Founder @ Gamma - LinkedIn", "https://www.linkedin.com/company/gamma", "", None),
])


def _answer(**other) -> str:
    return json.dumps({"company_overview": "Acme makes data tools. It sells them.", "target_audience": "Developers who build data tools", "contact_emails": ["Info@Acme.io", "info@acme.io", "bad"], "team_members": [{"name": "Ada  Byron", "title": "CEO"}, {"name": "ada byron"}], "self_reported_confidence": 0.8} | other)


RESPONSES = ("domain string, attempt int, content string, prompt_tokens long, completion_tokens long, total_tokens long, model string, error string", [
    ("a.test", 1, "```json\n" + _answer() + "\n```", 5685, 1175, 6860, "openai/gpt-oss-120b", None), ("b.test", 1, "not json", 100, 10, 110, "openai/gpt-oss-120b", None), ("b.test", 2, _answer(company_overview="short"), 120, 20, 140, "openai/gpt-oss-120b", None), ("b.test", 3, _answer(), 130, 30, 160, "openai/gpt-oss-120b", None),
    ("c.test", 1, _answer(self_reported_confidence=1.5), 10, 1, 11, "llama-3.1-8b-instant", None), ("c.test", 2, None, 0, 0, 0, "llama-3.1-8b-instant", "status 503"), ("c.test", 3, _answer(), 10, 1, 11, "llama-3.1-8b-instant", None), ("d.test", 1, _answer(team_members=[{"name": "X"}]), 7, 7, 14, "unknown", None), ("d.test", 2, json.dumps({"target_audience": "Developers who build"}), 7, 7, 14, "unknown", None), ("d.test", 3, "[1]", 7, 7, 14, "unknown", None),
])
ROBOTS = ("domain string, body string", [("acme-data.test", "User-agent: *\nDisallow: /private\nDisallow: /tmp/\nAllow: /private/press\nSitemap: https://acme-data.test/main-map.xml\nsitemap: https://acme-data.test/extra.xml"), ("beta.test", None), ("gamma.test", "User-agent: *\nDisallow: /")])
_MAP = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'
SITEMAPS = ("domain string, sitemap_url string, body string", [
    ("acme-data.test", "https://acme-data.test/main-map.xml", _MAP.format("".join(f"<url><loc>https://acme-data.test/{p}</loc></url>" for p in ("about", "team/", "private/x", "blog/post", "a.pdf")))), ("acme-data.test", "https://acme-data.test/sitemap.xml", "<sitemapindex><sitemap><loc>https://acme-data.test/page-1.xml</loc></sitemap><sitemap><loc>https://acme-data.test/posts.xml</loc></sitemap></sitemapindex>"),
    ("acme-data.test", "https://acme-data.test/page-1.xml", _MAP.format("<url><loc>https://www.acme-data.test/contact-us</loc></url><url><loc>https://careers.acme-data.test/</loc></url>")), ("beta.test", "https://beta.test/sitemap.xml", "<broken"), ("gamma.test", "https://gamma.test/sitemap.xml", _MAP.format("<url><loc>https://gamma.test/about</loc></url>")),
])
RECORDS = ("domain string, status string, team long, titled long, linked long, emails long, pages_ok long, thin long, attempts long, schema_error boolean, confidence double, tokens long, cost double", [
    ("a.test", "success", 3, 3, 3, 2, 6, 1, 1, False, 0.95, 6860, 0.001734), ("b.test", "success", 4, 3, 4, 3, 6, 0, 1, False, 0.9, 7611, 0.001779), ("c.test", "partial", 1, 1, 0, 1, 6, 0, 1, False, 0.0, 5520, 0.001432), ("d.test", "partial", 0, 0, 0, 0, 2, 2, 3, True, 0.0, 10, 0.0), ("e.test", "failed", 0, 0, 0, 0, 0, 0, 2, True, 0.0, 0, 0.0),
])
RESULT_PAGE = '<html><body><div class="r"><div><a href="/url?q=https%3A%2F%2Fwww.linkedin.com%2Fin%2Fbo-lind&amp;x=1"><h3>Bo Lind - Head of Data - LinkedIn</h3></a></div><p>Bo Lind works on data at Acme Data since last year.</p></div><a href="https://example.test/">Other</a><a href="https://www.linkedin.com/login">Sign in</a></body></html>'
TEXTS = ("n long, raw string", [(i, t) for i, t in enumerate(("  two   spaces\tand\n\nlines ", "Error: it failed  Call log: many lines of it", "x" * 200, "```json\n{\"a\": 1}\n```", "plain", "name [at] acme (dot) io", "a {AT} b [DOT] c", "", "Acme Data, Inc. of the World"))])


def frame(spark: SparkSession, fixture: tuple[str, list]) -> DataFrame:
    return spark.createDataFrame(fixture[1], fixture[0])


def values(fixture: tuple[str, list]) -> str:
    """The rows as a subquery."""
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    columns = [c.strip().split(" ") for c in fixture[0].split(",")]
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in fixture[1])
    casts = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in columns)
    return f"(SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(n for n, _ in columns)}))"
