"""Operators on small invented rows, with values worked out by hand."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.config import Settings
from millrace.functions import batches, contacts, html, text, urls
from millrace.operators import corpus, discovery, extraction, people, scoring
from millrace.plans import fixtures as fx
from millrace.plans import records, report
from millrace.sources import connectors, domains, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


TEAM_PAGE = """<html><head><title>Acme Data | Tools</title><style>p{}</style><script>var a="<p>";</script></head><body>
<nav><a href="/x">Nav</a></nav><div class="cookie-banner">We use cookies</div><main><h1>Our  team</h1><p>Acme makes <b>tools</b> for data teams.
<p>Second &amp; last<ul><li>Ada Byron, CEO <a href="https://www.linkedin.com/in/ada-byron">profile</a><li>Mail <a href="mailto:Sales@acme.test?subject=x">us</a></ul>
<p>jo [at] acme [dot] test</main><footer>Foot <a href="https://linkedin.com/company/acme">li</a></footer></body></html>"""


def test_html_to_markdown():
    got = html.markdown_of(TEAM_PAGE)
    assert got.startswith("Acme Data | Tools") and "# Our team" in got and "Second & last" in got
    assert "[profile](https://www.linkedin.com/in/ada-byron)" in got and "(mailto:Sales@acme.test?subject=x)" in got
    assert not any(x in got for x in ("Nav", "cookies", "Foot", "var a", "p{}"))
    assert html.markdown_of("") == html.markdown_of(None) == html.markdown_of("  ") == ""
    long = "word " * 300
    assert long.strip() in html.markdown_of(f'<body><div class="banner">{long}</div></body>')
    assert html.markdown_of("<p>a<p>b<br>c</div></x>") == "a\nb\nc"


def test_pages_are_parsed_a_piece_at_a_time():
    rows = [None, "", "<p>" + "é" * batches.PIECE, *[f"<title>{i}</title><p>{'word ' * 600}<a href='/{i}'>x</a>" for i in range(1500)]]
    got = [*html.parse_page.func(iter([pa.array(rows), pa.array([], pa.string()), pa.array(rows[:1])]))]
    assert [x for part in got for x in part.to_pylist()] == [dict(zip(("markdown", "hrefs", "title"), html.parsed(r))) for r in rows + rows[:1]]
    assert max(len(part) for part in got) <= 400  # of 1,503 rows in a batch
    links = [*html.resolve_links.func(iter([(pa.array(["http://a.test/b"] * 2000 + [None]), pa.array([["c" * 1000, "#x"]] * 2000 + [None]))]))]
    assert [x for part in links for x in part.to_pylist()] == [["http://a.test/" + "c" * 1000]] * 2000 + [[]] and len(links) > 1


def test_texts_are_decoded_a_piece_at_a_time(spark):
    rows = [None, [None, ""], ["a&amp;b", None], ["é" * batches.PIECE, "\\u0040"], *[["x" * 4000, f"&lt;{i}"] for i in range(1000)]]
    got = [*text.decode_escapes.func(iter([pa.array(rows)]))]
    assert [x for part in got for x in part.to_pylist()] == [None, [None, ""], ["a&b", None], ["é" * batches.PIECE, "@"], *[["x" * 4000, f"<{i}"] for i in range(1000)]]
    assert max(len(part) for part in got) <= 300  # of 1,004 rows in a batch
    odd = spark.createDataFrame([(i, *x) for i, x in enumerate([(None, "", []), ("a&#64;b.test", None, None), ("", "c\\u0040d.test", [])])], "i int, html string, markdown string, hrefs array<string>")
    harvested = corpus.harvest_pages(odd, ())
    assert [r.emails for r in harvested.orderBy("i").collect()] == [[], ["a@b.test"], ["c@d.test"]]
    assert harvested._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # one set of workers for both texts


def test_harvest(spark):
    pages = spark.createDataFrame([("acme.test", "u", 0, TEAM_PAGE)], "domain string, url string, page_pos int, html string")
    row = corpus.harvest_pages(corpus.parse_pages(pages), Settings().email_blocklist).first()
    assert row.emails == ["sales@acme.test", "jo@acme.test"]
    assert row.profiles == ["https://www.linkedin.com/in/ada-byron"] and row.companies == ["https://linkedin.com/company/acme"]


@pytest.mark.parametrize("path,score", [("/company/contact-us", 11.5), ("/company/about-x", 8.0), ("/company/contact-sales", 7.0), ("/company/careers", 6.0), ("/pricing", 3.5), ("/contact-us", 10.5), ("/customers/happyteams", 6.5), ("/solutions/innovation-teams", 6.25), ("/", 100.0), ("/blog", -11.0)])
def test_relevance(spark, path, score):
    assert one(spark, urls.relevance(F.lit(f"https://www.acme.test{path}"), Settings(), F.lit("acme.test"))) == score


def test_urls(spark):
    for raw, want in (("HTTPS://WWW.Acme.test//a///b/?q#f", "https://acme.test/a/b"), ("http://acme.test:80", "http://acme.test:80/"), ("https://acme.test/a b;p=1", "https://acme.test/a b")):
        assert one(spark, urls.normalise_url(F.lit(raw))) == want
    for raw, want in (("https://www.Acme.test/pricing/", "acme.test"), ("u@acme.test:8080", "acme.test"), ("nodot", None), ("", None), (None, None)):
        assert one(spark, urls.normalise_domain(F.lit(raw).cast("string"))) == want
    assert one(spark, urls.relevance(F.lit("https://careers.acme.test/"), Settings(), F.lit("acme.test"))) == 8.0
    assert one(spark, urls.relevance(F.lit("https://status.acme.test/"), Settings(), F.lit("acme.test"))) == -6.0
    assert one(spark, urls.unwrap_redirect(F.lit("/url?x=1&q=https%3A%2F%2Fa.test%2Fb"))) == "https://a.test/b"
    assert one(spark, urls.company_name(F.lit("Acme Data - the best tools"), F.lit("acme.test"))) == "Acme Data"


@pytest.mark.parametrize("local,kind", [("help-events", "support"), ("abuse", "security"), ("legal", "other"), ("talent", "careers"), ("info-jp", "info"), ("accommodations", "personal"), ("salesforce", "personal"), ("careers", "careers"), ("jo.doe", "personal"), ("техподдержка-2", "support")])
def test_categories(spark, local, kind):
    assert one(spark, contacts.category(F.lit(f"{local}@acme.test"))) == kind


def test_text(spark):
    assert one(spark, text.collapse_ws(F.lit(" a  b\n"))) == "a b"
    assert [r.x for r in spark.createDataFrame([("José ﬁ Ü",)], "t string").select(text.fold("t").alias("x")).collect()] == ["jose fi u"]
    assert one(spark, text.truncate_to_chars(F.lit("a" * 70 + "\n\n" + "b" * 50), F.lit(100))) == "a" * 70
    assert one(spark, text.truncate_to_chars(F.lit("a" * 50 + ". " + "b" * 90), F.lit(100))) == "a" * 50 + ". " + "b" * 48
    assert one(spark, text.estimate_tokens(F.lit(None).cast("string"))) == 1
    assert text.decode_escapes_py("\\u003einfo&amp;\\ud800") == ">info&\\ud800"


def test_boilerplate(spark):
    pages = [("a", f"u{i}", f"Menu\nText {i} is long enough\n\n\n\nFooter") for i in range(4)] + [("b", "v1", "Menu"), ("b", "v2", "Menu")] + [("c", f"w{i}", "Same\nLines") for i in range(3)]
    got = {r.url: r.cleaned for r in corpus.remove_repeated_lines(spark.createDataFrame(pages, "domain string, url string, markdown string").repartition(5)).collect()}
    assert got["u1"] == "Text 1 is long enough" and got["v1"] == "Menu" and got["w0"] == "Same\nLines"


def test_prompt_budget(spark):
    pages = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(t).alias("text")) for u, t in (("a", "x" * 50), ("b", " "), ("c", "y" * 50), ("d", "z" * 50), ("e", "w"))])
    assert [(c.url, len(c.text)) for c in one(spark, corpus.budget_pages(pages, 40, 100))] == [("a", 40), ("c", 40), ("d", 20)]


def test_robots_and_sitemaps(spark):
    allowed = {r.url: r.allowed for r in fx.frame(spark, fx.ROBOTS).select("body", F.explode(F.array(*map(F.lit, ("https://x.test/private/x", "https://x.test/about")))).alias("url"), "domain").select(F.concat("domain", F.lit(" "), "url").alias("url"), discovery.robots_allow(Settings())("body", "url").alias("allowed")).collect()}
    assert allowed["acme-data.test https://x.test/about"] and not allowed["acme-data.test https://x.test/private/x"] and allowed["beta.test https://x.test/about"] and not allowed["gamma.test https://x.test/about"]
    bodies = {u: b for d, u, b in fx.SITEMAPS[1] if d == "acme-data.test"}
    assert discovery.crawl_sitemaps(bodies, list(bodies)[:2])[:2] == ["https://acme-data.test/about", "https://acme-data.test/team/"]
    homes = spark.createDataFrame([("acme-data.test", "https://acme-data.test/", ["/pricing", "#top", "/careers/"])], "domain string, url string, hrefs array<string>")
    found = discovery.discover(homes, fx.frame(spark, fx.SITEMAPS), fx.frame(spark, fx.ROBOTS), Settings()).orderBy("rank").collect()
    assert [r.url for r in found] == ["https://acme-data.test/team", "https://acme-data.test/about", "https://acme-data.test/contact-us", "https://careers.acme-data.test/", "https://acme-data.test/careers"][: len(found)] or {r.url for r in found} >= {"https://acme-data.test/about", "https://acme-data.test/contact-us"}
    assert not any("private" in r.url or "blog" in r.url or ".pdf" in r.url for r in found)


def test_replay(spark):
    got = {r.domain: r for r in extraction.replay(fx.frame(spark, fx.RESPONSES)).collect()}
    assert got["a.test"].usage.estimated_cost_usd == 0.001734 and got["a.test"].attempts == 1 and got["a.test"].errors == []
    assert got["a.test"].extraction.contact_emails == ["info@acme.io"] and [m.name for m in got["a.test"].extraction.team_members] == ["Ada Byron"]
    assert got["b.test"].attempts == 3 and len(got["b.test"].errors) == 2 and got["b.test"].usage.llm_calls == 3
    assert got["c.test"].extraction is None and got["c.test"].usage.llm_calls == 1 and got["c.test"].attempts == 3
    assert got["d.test"].extraction is None and len(got["d.test"].errors) == 3


def test_people(spark):
    members = people.with_company(fx.frame(spark, fx.MEMBERS), fx.frame(spark, fx.COMPANIES))
    assert {r.name for r in people.mark_own(members).filter("not own").collect()} == {"Cy Moss", "Jon Ude", "Kim Vale"}
    team = {r.name: r for r in people.resolve_team(members, fx.frame(spark, fx.VERIFIED), fx.frame(spark, fx.HITS), Settings()).collect()}
    assert team["Ada Byron"].linkedin_confidence == 0.95 and team["Ada Byron"].linkedin_source == "website"
    assert team["Bo Lind"].linkedin_url == "https://www.linkedin.com/in/bo-lind-7" and team["Bo Lind"].title == "Head of Data" and team["Bo Lind"].title_source == "search"
    assert team["Cy Moss"].linkedin_evidence == ["model-supplied url discarded: not found in page HTML", "search returned no results"]
    assert team["Di Noor"].linkedin_evidence == ["1 search result(s) rejected: no corroborated name match"]
    assert team["Fay Quill"].linkedin_url == "https://www.linkedin.com/in/fq123" and team["Fay Quill"].linkedin_confidence == 0.75
    assert team["Hal Stone"].linkedin_evidence == ["not searched: per-domain lookup budget of 5 reached"]
    assert people.resolve_team(members, fx.frame(spark, fx.VERIFIED), None, Settings()).filter("array_contains(linkedin_evidence, 'linkedin search is disabled')").count() == 10
    hits = fx.frame(spark, fx.HITS).filter("rank = 1 and domain = 'acme-data.test' and name_key = 'gus rho'")
    assert people.resolve_team(members.filter("name = 'Gus Rho'"), fx.frame(spark, fx.VERIFIED), hits, Settings()).first().linkedin_evidence == ["search unavailable: timeout"]


def test_records(spark, tmp_path):
    filler = "<p>" + "Acme Data builds careful tools that many data teams use every day at work. " * 3 + "</p>"
    pages = [("acme-data.test", f"https://acme-data.test/{p}", i, TEAM_PAGE.replace("</main>", f"{filler}<p>Page {i} speaks of {p} things in a line of its own.</p></main>"), 200, "text/html", "http", None, 0.1) for i, p in enumerate(("", "about", "team"))]
    pages += [("thin.test", "https://thin.test/", 0, "<p>hi</p>", 200, "text/html", "http", None, 0.1), ("broken.test", "https://broken.test/", 0, "", None, None, "http", "timeout", 1.0)]
    frame = spark.createDataFrame(pages, "domain string, url string, page_pos int, html string, http_status int, content_type string, tier string, error string, duration double")
    answer = {"company_overview": "Acme Data builds tools. Teams use them.", "target_audience": "Data teams of all sizes", "contact_emails": ["sales@acme.test", "jo.doe@acme.test"], "team_members": [{"name": "Ada Byron", "title": "CEO", "linkedin_url": "https://linkedin.com/in/ada-byron"}, {"name": "Nobody Known"}, {"name": "Max Other", "title": "PM", "affiliation": "Elsewhere"}], "self_reported_confidence": 0.9}
    replies = spark.createDataFrame([("acme-data.test", 1, json.dumps(answer), 10, 5, 15, "openai/gpt-oss-120b", None)], fx.RESPONSES[0])
    asked = spark.createDataFrame([("nowhere.test", 0), ("https://www.acme-data.test", 1), ("not a domain", 2), ("thin.test", 3), ("broken.test", 4)], "domain_raw string, input_pos long")
    made = records.domain_records(asked, frame, Settings(), replies)
    got = made.collect()
    assert [r.domain for r in got] == ["nowhere.test", "acme-data.test", "not a domain", "thin.test", "broken.test"] and [r.status for r in got] == ["failed", "success", "failed", "failed", "failed"]
    acme = got[1]
    assert [(e.email, e.type) for e in acme.contact_emails] == [("sales@acme.test", "sales")] and acme.personal_emails == ["jo.doe@acme.test"]
    assert [m.name for m in acme.team_members] == ["Ada Byron"] and acme.team_members[0].linkedin_confidence == 0.95
    notes = " ".join(acme.confidence_breakdown.notes)
    assert "Max Other (Elsewhere)" in notes and "Nobody Known" in notes and 0 < acme.data_confidence_score < 1 and acme.usage.total_tokens == 15
    assert all(got[i].errors for i in (0, 2, 3, 4)) and got[4].pages_crawled[0].error == "timeout"
    sinks.write_records(made, str(tmp_path / "out"))
    back = sinks.read_records(spark, str(tmp_path / "out"))
    totals = report.run_totals(back).first().asDict()
    assert totals["domains"] == 5 and totals["succeeded"] == 1 and totals["contact_emails"] == 1
    assert "mean confidence" in report.dashboard(totals) and report.detail(back).filter("domain = 'acme-data.test'").first().report.startswith("[SUCCESS]")
    sinks.write_envelope(report.envelope(back, "2026-01-01T00:00:00+00:00", "m"), str(tmp_path / "run.json"))
    assert sinks.read_envelope(spark, str(tmp_path / "run.json")).count() == 5


def test_scores(spark):
    person = lambda title, url, conf: F.struct(F.lit("n").alias("name"), F.lit(title).alias("title"), F.lit(url).alias("linkedin_url"), F.lit("website" if title else None).alias("title_source"), F.lit("website").alias("linkedin_source"), F.lit(conf).alias("linkedin_confidence"))
    pages = F.array(*[F.struct(F.lit("ok").alias("status"), F.lit(100 if i == 0 else 900).alias("clean_chars")) for i in range(6)])
    team, mail, some, none = F.array(*[person("t", "u", 0.95)] * 3), F.array(F.lit("a"), F.lit("b")), F.lit("text"), F.array().cast("array<string>")
    got = one(spark, scoring.breakdown(some, some, mail, team, pages, F.lit(0.5), F.lit(1), none, none, F.lit(True), 6, 3))
    assert (got.completeness, got.source_coverage, got.evidence_strength, got.final) == (0.994, 0.917, 0.975, 0.977)
    failed = one(spark, scoring.breakdown(some, some, mail, team, pages, F.lit(0.5), F.lit(1), none, none, F.lit(False), 6, 3))
    assert failed.final == 0 and failed.notes == ["extraction failed; no data to score"]


def test_domains(spark, tmp_path):
    (tmp_path / "d.txt").write_text("domain\nacme.test,Acme\n# no\n\nwww.acme.test\nbeta.test")
    got = domains.load_domains(spark, ["Beta.test"], str(tmp_path / "d.txt"), skip_header=True).orderBy("input_pos").collect()
    assert [r.domain_raw for r in got] == ["Beta.test", "acme.test"]


def test_settings_and_providers():
    s = Settings.from_env({"MAX_PAGES_PER_DOMAIN": "9", "HTTP_TIMEOUT": "x", "RESPECT_ROBOTS": "FALSE", "BRAVE_API_KEY": " k "})
    assert (s.max_pages_per_domain, s.http_timeout, s.respect_robots, s.brave_api_key) == (9, 20.0, False, "k")
    assert connectors.search_provider(s).hits == ("web", "results") and connectors.search_provider(Settings(linkedin_search_provider="serper", brave_api_key="k")) is None
    assert connectors.search_provider(s).read({"web": {"results": [{"title": "t", "url": "u", "description": "d"}, {}]}}, 1) == [{"title": "t", "url": "u", "snippet": "d"}]
    with pytest.raises(ValueError):
        connectors.ChatModel(Settings())
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise connectors.HttpError("busy", retry_after=7.0, retry=True)
        return "ok"

    assert connectors.with_retries(flaky, 3, sleep=waits.append) == "ok" and waits == [7.0, 7.0]


def test_crawl_source_reads_hosts_in_partitions():
    source = connectors.PageSource({"urls": json.dumps([["a", "http://a.test/1"], ["a", "http://a.test/2"], ["b", "http://b.test/"]])})
    assert [len(p.urls) for p in source.reader(None).partitions()] == [2, 1]


def test_streaming(spark, tmp_path):
    from millrace.streaming import ingest

    rows = [("acme.test", "https://acme.test/", 0, TEAM_PAGE.replace("</main>", "<p>" + "Acme Data builds careful tools that teams use. " * 9 + "</p></main>"), 200, "text/html", "http", None, 0.1)]
    spark.createDataFrame(rows, "domain string, url string, page_pos int, html string, http_status int, content_type string, tier string, error string, duration double").write.parquet(str(tmp_path / "in"))
    ingest.record_stream(ingest.page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    assert [r.domain for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["acme.test"]


def test_long_runs_take_linear_time(spark):
    """Texts of one unbroken run, of white space, or of many nested elements are no trap."""
    import time

    from millrace.functions import contacts, html, text

    n = 2_000_000
    runs = [("x" * n,), (" " * n + "y",), ("a@" + "b" * n,), ("[at]" + " " * n,), ("a.b@c.io" * 1000 + "x" * n,)]
    began = time.monotonic()
    rows = spark.createDataFrame(runs, "t string").select(F.size(contacts.addresses_in(F.col("t"), ())).alias("n"), F.length(text.strip(F.col("t"))).alias("c"), F.length(text.rstrip(F.col("t"))).alias("r")).collect()
    assert time.monotonic() - began < 60
    assert [r.n for r in rows][:2] == [0, 0] and rows[1].c == 1 and rows[1].r == n + 1
    began = time.monotonic()
    assert html.markdown_of('<div class="nav">' * 8000 + "z" * 2000 + "</div>" * 8000) == "z" * 2000
    assert time.monotonic() - began < 10


def test_addresses_that_touch(spark):
    from millrace.functions import contacts, text

    said = ["a@b.comx_y@d.com", "a@b.co;c@d.co", "x [at] [at] y", "p  (at)  q.io (dot) z", "a@b.co" * 3]
    row = spark.createDataFrame([(s,) for s in said], "t string").select(F.regexp_extract_all("t", F.lit(f"({contacts.ADDRESS_SEARCH})"), F.lit(1)).alias("a"), F.regexp_extract_all("t", F.lit(f"({contacts.ADDRESS_IN_TEXT})"), F.lit(1)).alias("b"), text.deobfuscate(F.col("t")).alias("d")).collect()
    assert all(r.a == r.b for r in row) and row[0].a == ["a@b.comx", "_y@d.com"]
    assert row[2].d == "x@@y" and row[3].d == "p@q.io.z"
