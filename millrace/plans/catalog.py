"""Named queries over the tables of a directory, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.config import BLEND, CATEGORY_ORDER, COMPANY_STOP, DEPARTMENT_WORDS, EMAIL_BLOCKLIST, ESCALATE_STATUSES, MAILBOX_WORDS, MODEL_PRICES, NAME_NOISE, NO_ROLE, NON_HTML, PREFERRED_PREFIXES, ROLE_STOP, SCORE_WEIGHTS, SENIORITY, Settings
from millrace.functions import contacts, html, text, urls
from millrace.operators import corpus, discovery, extraction, people, scoring
from millrace.plans import fixtures as fx
from millrace.plans import records, report
from millrace.sources import domains

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Addresses of the supplied documents are all on a domain of the default blocklist.
OPEN: tuple[str, ...] = ()


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL -----------------------------------------------------------------------------------------------


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def tidy_sql(raw: str) -> str:
    value = f"trim({raw})"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&#64;", "@"), ("&#46;", "."), ("&nbsp;", " "), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', '{char}')"
    value = f"trim(split_part(regexp_replace(lower({value}), '^mailto:', ''), '?', 1))"
    value = f"""regexp_replace({value}, '^[.,;:<>()\\[\\]"'']+|[.,;:<>()\\[\\]"'']+$', '', 'g')"""
    return f"regexp_replace({value}, '^(?:u00[0-9a-f]{{2}})+', '')"


def reason_sql(raw: str, value: str, blocklist=EMAIL_BLOCKLIST) -> str:
    blocked = " OR ".join(f"contains({value}, '{b}')" for b in blocklist) or "false"
    return f"""CASE WHEN coalesce({raw}, '') = '' THEN 'blank' WHEN NOT regexp_matches({value}, '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}$') THEN 'syntax'
        WHEN {blocked} THEN 'blocklist' WHEN length({value}) > 120 THEN 'length' WHEN regexp_matches(split_part({value}, '@', 2), '(^|\\.)[0-9]+(\\.|$)') THEN 'number' END"""


def category_sql(email: str) -> str:
    local, squashed = f"split_part({email}, '@', 1)", f"regexp_replace(split_part(split_part({email}, '@', 1), '+', 1), '[^a-z0-9]+', '', 'g')"
    out = [f"CASE WHEN {squashed} = '' THEN 'other'"]
    out += [f"WHEN {squashed} IN ({_quoted(words)}) THEN '{kind}'" for kind, words in MAILBOX_WORDS.items()]
    out += [f"WHEN {squashed} IN ({_quoted(DEPARTMENT_WORDS)}) OR {local} IN ({_quoted(DEPARTMENT_WORDS)}) THEN 'other'"]
    out += [f"WHEN regexp_matches({local}, '^({'|'.join(words)})([^a-z]|$)') THEN '{kind}'" for kind, words in MAILBOX_WORDS.items()]
    out += [f"WHEN regexp_matches({local}, '^[a-z]+[._-][a-z]{{2,}}([._-][a-z]{{2,}})?$') OR regexp_matches({local}, '^\\p{{L}}+$') THEN 'personal' ELSE 'other' END"]
    return " ".join(out)


_DEOBFUSCATED = r"regexp_replace(regexp_replace(text, '(?i)\s*(?:\[at\]|\(at\)|\{at\})\s*', '@', 'g'), '(?i)\s*(?:\[dot\]|\(dot\)|\{dot\})\s*', '.', 'g')"
_MATCHES = rf"regexp_extract_all({_DEOBFUSCATED}, '[A-Za-z0-9._%+\-]+\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}')"


def found_sql(blocklist=EMAIL_BLOCKLIST) -> str:
    """(doc_id, source, raw, email, reason) of every match in documents."""
    return f"""(SELECT *, {reason_sql('raw', 'value', blocklist)} AS reason FROM (SELECT *, {tidy_sql('raw')} AS value FROM
        (SELECT doc_id, source, replace(unnest({_MATCHES}), ' ', '') AS raw FROM documents)))"""


_REST = r"regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*:', '')"
HOST_SQL = rf"regexp_replace(split_part(lower(regexp_extract({_REST}, '^//([^/?#]*)', 1)), ':', 1), '^www\.', '')"
PATH_SQL = rf"regexp_replace(regexp_extract(regexp_replace({_REST}, '^//[^/?#]*', ''), '^[^?#]*'), ';[^/]*$', '')"
OUTER_SQL = rf"regexp_replace({PATH_SQL}, '^/+|/+$', '', 'g')"
DEPTH_SQL = f"(CASE WHEN {OUTER_SQL} = '' THEN 0 ELSE len(string_split({OUTER_SQL}, '/')) END)"
_CLEAN_PATH = f"regexp_replace(regexp_replace({PATH_SQL}, '/{{2,}}', '/', 'g'), '/+$', '')"
NORMAL_SQL = rf"""(regexp_extract(lower(url), '^([a-z][a-z0-9+.\-]*:)', 1) || '//' || regexp_replace(lower(regexp_extract({_REST}, '^//([^/?#]*)', 1)), '^www\.', '') || CASE WHEN {_CLEAN_PATH} = '' THEN '/' ELSE {_CLEAN_PATH} END)"""


def keyword_sql(subject: str, settings: Settings) -> str:
    pairs = lambda table: ", ".join(f"('{k}', {w})" for k, w in table.items())
    return f"""((SELECT coalesce(max(w) + 0.5 * (sum(w) - max(w)), 0) FROM (VALUES {pairs(settings.keywords)}) AS g(k, w) WHERE contains({subject}, k))
        + (SELECT coalesce(sum(w), 0) FROM (VALUES {pairs(settings.negative_keywords)}) AS b(k, w) WHERE list_contains(regexp_split_to_array({subject}, '[/\\-_.]'), k) OR contains('/' || {subject} || '/', '/' || k || '/')))"""


def relevance_sql(source: str, settings: Settings) -> str:
    """(url, host, score) of a relation with url, the site being the url's own host."""
    return f"""(SELECT *, CASE WHEN inner_path = '' THEN 100.0 ELSE round(CAST({keyword_sql('inner_path', settings)} - depth * 3.0 - CASE WHEN length(inner_path) > 60 THEN 4.0 ELSE 0.0 END AS DOUBLE), 2) END AS score
        FROM (SELECT *, {HOST_SQL} AS host, lower({OUTER_SQL}) AS inner_path, {DEPTH_SQL} AS depth FROM {source}))"""


#: Weights that tell the supplied urls apart.
TRIAL = Settings(keywords={"en": 6.0, "fr": 5.0, "de": 4.0, "html": 3.0, "1": 1.0}, negative_keywords={"es": -3.0}, max_pages_per_domain=4)
STRIP_SQL = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

# --- addresses ---------------------------------------------------------------------------------------------------


def found_addresses(docs: DataFrame, blocklist=OPEN) -> DataFrame:
    return docs.select("doc_id", "source", F.explode(contacts.addresses_in(F.col("text"), blocklist)).alias("email"))


@query(f"SELECT DISTINCT source, value AS email, {category_sql('value')} AS type FROM {found_sql(OPEN)} WHERE reason IS NULL AND {category_sql('value')} <> 'personal'")
def contact_points_by_source(spark, sf_dir):
    """Which contact points does each source publish?"""
    found = found_addresses(table(spark, sf_dir, "documents")).select("source", "email").distinct()
    return found.withColumn("type", contacts.category(F.col("email"))).filter("type <> 'personal'")


@query(f"SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM (SELECT reason FROM {found_sql()} UNION ALL SELECT {reason_sql('raw', tidy_sql('raw'))} FROM {fx.values(fx.RAW_EMAILS)}) GROUP BY 1")
def email_reject_reasons(spark, sf_dir):
    raw = F.regexp_extract_all(text.deobfuscate(F.col("text")), F.lit(f"({contacts.ADDRESS_SEARCH})"), F.lit(1))
    found = table(spark, sf_dir, "documents").select(F.explode(raw).alias("raw")).select(F.replace("raw", F.lit(" "), F.lit("")).alias("raw"))
    both = found.unionByName(fx.frame(spark, fx.RAW_EMAILS).select("raw"))
    return both.groupBy(F.coalesce(contacts.email_reject_reason(F.col("raw")), F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT n, raw, CASE WHEN {reason_sql('raw', tidy_sql('raw'))} IS NULL THEN {tidy_sql('raw')} END AS email FROM {fx.values(fx.RAW_EMAILS)}")
def clean_emails(spark, sf_dir):
    return fx.frame(spark, fx.RAW_EMAILS).select("n", "raw", contacts.clean_email(F.col("raw")).alias("email"))


@query(f"SELECT DISTINCT email, {category_sql('email')} AS type FROM (SELECT value AS email FROM {found_sql(OPEN)} WHERE reason IS NULL UNION ALL SELECT email FROM {fx.values(fx.MAILBOXES)})")
def email_categories(spark, sf_dir):
    found = found_addresses(table(spark, sf_dir, "documents")).select("email").unionByName(fx.frame(spark, fx.MAILBOXES).select("email")).distinct()
    return found.withColumn("type", contacts.category(F.col("email")))


@query(f"SELECT source, count(*) FILTER (WHERE {category_sql('value')} <> 'personal') AS contact_points, count(*) FILTER (WHERE {category_sql('value')} = 'personal') AS personal FROM (SELECT DISTINCT source, value FROM {found_sql(OPEN)} WHERE reason IS NULL) GROUP BY 1")
def personal_vs_contact_counts(spark, sf_dir):
    found = found_addresses(table(spark, sf_dir, "documents")).select("source", "email").distinct().withColumn("type", contacts.category(F.col("email")))
    return found.groupBy("source").agg(F.count_if(F.col("type") != "personal").alias("contact_points"), F.count_if(F.col("type") == "personal").alias("personal"))


_PLACE = "CASE " + " ".join(f"WHEN type = '{c}' THEN {i}" for i, c in enumerate(CATEGORY_ORDER)) + " END"


@query(f"SELECT string_agg(email || '=' || type, ',' ORDER BY {_PLACE}, email) FILTER (WHERE type <> 'personal') AS points, string_agg(email, ',' ORDER BY n) FILTER (WHERE type = 'personal') AS personal FROM (SELECT n, email, {category_sql('email')} AS type FROM {fx.values(fx.MAILBOXES)})")
def contact_order(spark, sf_dir):
    """Contact points by category and address, personal inboxes in found order."""
    rows = fx.frame(spark, fx.MAILBOXES).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "email"))), lambda x: x["email"]).alias("emails"))
    points, personal = contacts.split_contacts(F.col("emails"))
    return rows.select(F.array_join(F.transform(points, lambda p: F.concat(p["email"], F.lit("="), p["type"])), ",").alias("points"), F.array_join(personal, ",").alias("personal"))


@query(f"""SELECT source, string_agg(email, ',' ORDER BY doc_id, preferred, email) AS emails FROM (SELECT source, value AS email, CASE WHEN split_part(value, '@', 1) IN ({_quoted(PREFERRED_PREFIXES)}) THEN 0 ELSE 1 END AS preferred, min(doc_id) AS doc_id
    FROM {found_sql(OPEN)} WHERE reason IS NULL GROUP BY 1, 2, 3) GROUP BY 1""")
def harvest_union_by_source(spark, sf_dir):
    """Each source's addresses in document order, within a document preferred ones first."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", contacts.by_preference(contacts.addresses_in(F.col("text"), OPEN)).alias("emails")).filter(F.size("emails") > 0)
    return docs.groupBy("source").agg(F.array_join(corpus.in_order("emails", "doc_id"), ",").alias("emails"))


_PROFILE = "regexp_replace(split_part(trim(raw), '?', 1), '/+$', '')"
_PROFILE = f"(CASE WHEN starts_with({_PROFILE}, '//') THEN 'https:' || {_PROFILE} WHEN starts_with({_PROFILE}, 'www.') OR starts_with({_PROFILE}, 'linkedin.com') THEN 'https://' || {_PROFILE} ELSE {_PROFILE} END)"
_GOOD_PROFILE = rf"(CASE WHEN regexp_matches({_PROFILE}, '(?i)^https?://(?:[a-z]{{2,3}}\.)?linkedin\.com/(?:in|pub|company)/[^/?#\s]+') THEN replace({_PROFILE}, 'http://', 'https://') END)"
_SLUG = rf"regexp_extract({_GOOD_PROFILE}, '(?i)^https://[^/]*/(?:in|pub)/([^/]+)', 1)"


@query(f"SELECT n, raw, {_GOOD_PROFILE} AS clean, CASE WHEN length({_SLUG}) >= 3 THEN 'https://www.linkedin.com/in/' || {_SLUG} END AS canonical, url_decode(CASE WHEN length({_SLUG}) >= 3 THEN {_SLUG} END) AS slug FROM {fx.values(fx.PROFILES)}")
def profile_urls_canonical(spark, sf_dir):
    raw = fx.frame(spark, fx.PROFILES)
    canonical = contacts.canonical_profile(F.col("raw"))
    return raw.select("n", "raw", contacts.clean_profile(F.col("raw")).alias("clean"), canonical.alias("canonical"), contacts.profile_slug(canonical).alias("slug"))


# --- urls --------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {NORMAL_SQL} AS url FROM pages")
def url_normalised(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise_url(F.col("url")).alias("url"))


_DOMAIN = r"regexp_replace(split_part(split_part(regexp_extract(lower(trim(raw)), '^(?:[a-z][a-z0-9+.\-]*://)?([^/?#]*)', 1), '@', -1), ':', 1), '^www\.', '')"
_DOMAIN = f"(CASE WHEN regexp_matches({_DOMAIN}, '{urls.HOSTNAME}') THEN {_DOMAIN} ELSE raw END)"


@query(f"""SELECT domain, domain_raw, input_pos FROM (SELECT {_DOMAIN} AS domain, raw AS domain_raw, input_pos, row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY input_pos) AS r
    FROM (SELECT trim(split_part(domain_raw, ',', 1)) AS raw, input_pos FROM (SELECT * FROM {fx.values(fx.DOMAINS)} UNION ALL SELECT url, page_id + 1000 FROM pages)) WHERE raw <> '' AND raw NOT LIKE '#%') WHERE r = 1""")
def domain_list_dedupe(spark, sf_dir):
    """A list of domains with comments, repeats and junk; the first spelling of each stays."""
    listed = fx.frame(spark, fx.DOMAINS).unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("domain_raw"), (F.col("page_id") + 1000).alias("input_pos")))
    return domains.first_of_each(listed)


@query(f"SELECT {HOST_SQL} AS host, count(*) AS pages, count(*) FILTER (WHERE {HOST_SQL} = 'example.com' OR ends_with({HOST_SQL}, '.example.com')) AS of_example_com FROM pages GROUP BY 1")
def host_page_counts(spark, sf_dir):
    own = urls.same_site(F.col("url"), F.lit("example.com"))
    return table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.count_if(own).alias("of_example_com"))


@query(f"SELECT page_id, {DEPTH_SQL} AS depth, NOT regexp_matches(lower({PATH_SQL}), '\\.({'|'.join(NON_HTML)})$') AS is_html FROM pages")
def url_shape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.depth(F.col("url")).alias("depth"), urls.looks_like_html(F.col("url")).alias("is_html"))


@query(f"SELECT page_id, url, score FROM {relevance_sql('pages', Settings())}")
def url_relevance(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.relevance(F.col("url"), Settings(), urls.host(F.col("url"))).alias("score"))


@query(f"""SELECT host, url, score, rank FROM (SELECT host, url, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, first_pos) AS rank FROM {relevance_sql(f"(SELECT {NORMAL_SQL} AS url, min(page_id) AS first_pos FROM pages GROUP BY 1)", TRIAL)} WHERE score > 0) WHERE rank <= 3""")
def top_pages_per_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("domain"), "url", F.col("page_id").alias("pos"))
    found = pages.select("domain", urls.normalise_url(F.col("url")).alias("url"), "pos").groupBy("domain", "url").agg(F.min("pos").alias("first_pos"))
    return discovery.top_pages(found, TRIAL).select(F.col("domain").alias("host"), "url", "score", "rank")


@query(f"""SELECT DISTINCT host, {NORMAL_SQL} AS url FROM (SELECT host, 'https://' || host || href AS url FROM (SELECT {HOST_SQL} AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE starts_with(href, '/')) WHERE {DEPTH_SQL} <= 3""")
def anchor_candidates(spark, sf_dir):
    """Links of pages, made absolute, normalised and pruned, by the expressions that need no tree."""
    found = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("domain"), F.explode(html.hrefs_fast(F.col("html"))).alias("href")).filter(F.startswith("href", F.lit("/")))
    raw = found.select("domain", F.concat(F.lit("https://"), "domain", "href").alias("url"), F.lit(0).alias("pos"))
    return discovery.prune(raw, Settings()).select(F.col("domain").alias("host"), "url")


_LISTED = r"(SELECT domain, unnest(regexp_extract_all(body, '(?i)sitemap:\s*(\S+)', 1)) AS sitemap_url FROM " + fx.values(fx.ROBOTS) + " UNION SELECT domain, 'https://' || domain || '/sitemap.xml' FROM " + fx.values(fx.ROBOTS) + ")"
_LOCS = lambda like: rf"(SELECT s.domain, sitemap_url, i, regexp_extract_all(body, '<loc>([^<]*)</loc>', 1)[i] AS loc FROM {fx.values(fx.SITEMAPS)} s, unnest(range(1, 100)) AS r(i) WHERE body LIKE '{like}%' AND i <= len(regexp_extract_all(body, '<loc>([^<]*)</loc>', 1)))"
_INNER = f"(SELECT domain, loc AS sitemap_url FROM {_LOCS('<sitemapindex')} JOIN {_LISTED} USING (domain, sitemap_url))"


@query(f"""SELECT domain, loc AS url, CAST(row_number() OVER (PARTITION BY domain ORDER BY inner_map, i) - 1 AS INTEGER) AS pos
    FROM {_LOCS('<urlset')} JOIN (SELECT *, false AS inner_map FROM {_LISTED} UNION ALL SELECT *, true FROM {_INNER}) USING (domain, sitemap_url)""")
def sitemap_urls(spark, sf_dir):
    return discovery.sitemap_urls(fx.frame(spark, fx.SITEMAPS), fx.frame(spark, fx.ROBOTS))


_RULES = rf"(SELECT domain, i, lower(trim(split_part(line, ':', 1))) AS kind, trim(split_part(line, ':', 2)) AS prefix FROM (SELECT domain, i, string_split(body, chr(10))[i] AS line FROM {fx.values(fx.ROBOTS)}, unnest(range(1, 100)) AS r(i) WHERE i <= len(string_split(body, chr(10)))))"


@query(f"""SELECT 'https://' || domain || path AS url, coalesce((SELECT arg_min(kind, i) FROM {_RULES} x WHERE x.domain = r.domain AND kind IN ('allow', 'disallow') AND starts_with(path, prefix)), 'allow') = 'allow' AS allowed
    FROM {fx.values(fx.ROBOTS)} r, (VALUES ('/'), ('/private/x'), ('/private/press'), ('/tmp/a'), ('/about')) AS p(path)""")
def robots_allowed(spark, sf_dir):
    paths = F.explode(F.array(*[F.lit(p) for p in ("/", "/private/x", "/private/press", "/tmp/a", "/about")])).alias("path")
    asked = fx.frame(spark, fx.ROBOTS).select("domain", "body", paths).withColumn("url", F.concat(F.lit("https://"), "domain", "path"))
    return asked.withColumn("allowed", discovery.robots_allow(Settings())("body", "url")).select("url", "allowed")


@query()
def discovered_pages(spark, sf_dir):
    """Sitemaps and links, pruned by robots rules and ranked."""
    homes = spark.createDataFrame([("acme-data.test", "https://acme-data.test/", ["/pricing", "#top", "mailto:x@y.z", "https://other.test/about", "/careers/"])], "domain string, url string, hrefs array<string>")
    return discovery.discover(homes, fx.frame(spark, fx.SITEMAPS), fx.frame(spark, fx.ROBOTS), Settings())


# --- pages -------------------------------------------------------------------------------------------------------

_TITLE = "nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title_fast(F.col("html")).alias("title"))


_HEAD = rf"trim(regexp_extract(trim(coalesce({_TITLE}, '')), '(?s)^(.*?)(\s*[|–—·:•-]\s+|$)', 1))"


@query(rf"SELECT page_id, CASE WHEN {_HEAD} <> '' AND length({_HEAD}) <= 40 AND len(regexp_split_to_array({_HEAD}, '\s+')) <= 5 THEN {_HEAD} ELSE split_part({HOST_SQL}, '.', 1) END AS company FROM pages")
def company_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.company_name(html.title_fast(F.col("html")), urls.host(F.col("url"))).alias("company"))


TEXT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


@query(f"SELECT page_id, {TEXT_SQL} AS body FROM pages")
def html_text_fast(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.text_fast(F.col("html")).alias("body"))


@query()
def html_markdown(spark, sf_dir):
    parsed = table(spark, sf_dir, "pages").withColumn("p", html.parse_page("html"))
    return parsed.select("page_id", "p.markdown", "p.title", F.size("p.hrefs").alias("links"))


@query(f"SELECT page_id, chars, CASE WHEN chars > 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN code IN ({', '.join(map(str, ESCALATE_STATUSES))}) THEN 'status ' || code WHEN chars < 600 THEN 'thin content (' || chars || ' chars)' END AS reason FROM (SELECT page_id, length({TEXT_SQL}) AS chars, CASE WHEN page_id % 10 = 3 THEN 403 ELSE 200 END AS code FROM pages)")
def page_status_and_escalation(spark, sf_dir):
    body = table(spark, sf_dir, "pages").select("page_id", "html", html.text_fast(F.col("html")).alias("body"), F.when(F.col("page_id") % 10 == 3, 403).otherwise(200).alias("code"))
    error = F.lit(None).cast("string")
    return body.select("page_id", F.length("body").alias("chars"), corpus.page_status(error, F.col("html"), F.col("body")).alias("status"), corpus.escalation_reason(error, F.col("code"), F.length("body")).alias("reason"))


@query(f"SELECT page_id, CASE WHEN chars < 600 AND page_id % 2 = 0 THEN 'browser' ELSE 'http' END AS tier FROM (SELECT page_id, length({TEXT_SQL}) AS chars FROM pages)")
def fetch_tiers(spark, sf_dir):
    """Rendered pages with as much text take the place of thin plain ones; here even pages have a longer rendering."""
    plain = table(spark, sf_dir, "pages").select(F.lit("d").alias("domain"), F.col("page_id").cast("string").alias("url"), "html", html.text_fast(F.col("html")).alias("markdown"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error"))
    rendered = plain.withColumn("markdown", F.when(F.col("url").cast("long") % 2 == 0, F.concat("markdown", F.lit("!"))).otherwise(""))
    return corpus.choose_tier(plain, rendered).select(F.col("url").cast("long").alias("page_id"), "tier")


_LINES = f"SELECT DISTINCT source, doc_id, {STRIP_SQL('line')} AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
_REPEATED = f"""(SELECT source, line, pages FROM (SELECT source, line, count(*) AS pages FROM ({_LINES}) WHERE line <> '' GROUP BY 1, 2) JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 3) USING (source) WHERE pages >= greatest(2, floor(n * 0.1)) AND length(line) <= 200)"""


@query(f"SELECT source, line, pages FROM {_REPEATED}")
def boilerplate_lines(spark, sf_dir):
    return corpus.line_frequencies(table(spark, sf_dir, "documents"), "source", "doc_id", "text", threshold=0.1)


_KEPT = f"""regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), {STRIP_SQL('x')})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""


@query(f"""SELECT doc_id, CASE WHEN gone IS NULL THEN text WHEN length({STRIP_SQL('text')}) > 0 AND length({_KEPT}) < length({STRIP_SQL('text')}) * 0.15 THEN text ELSE {_KEPT} END AS cleaned
    FROM documents LEFT JOIN (SELECT source, list(line) AS gone FROM {_REPEATED} GROUP BY 1) USING (source)""")
def boilerplate_pruned_docs(spark, sf_dir):
    return corpus.remove_repeated_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text", threshold=0.1).select("doc_id", "cleaned")


@query("SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.estimate_tokens(F.col("text")).alias("tokens"))


def _cut_sql(sep: str, limit: int) -> str:
    return f"(CASE WHEN strpos(reverse(substr(text, 1, {limit})), reverse({sep})) > 0 THEN {limit} - strpos(reverse(substr(text, 1, {limit})), reverse({sep})) - length({sep}) + 1 ELSE -1 END)"


_CUTS = " ".join(f"WHEN {_cut_sql(s, 1000)} > 600 THEN regexp_replace(substr(text, 1, {_cut_sql(s, 1000)}), '\\s+$', '')" for s in ("chr(10) || chr(10)", "chr(10)", "'. '"))


@query(f"SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text {_CUTS} ELSE regexp_replace(substr(text, 1, 1000), '\\s+$', '') END AS clip FROM documents")
def truncate_boundary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_to_chars(F.col("text"), F.lit(1000)).alias("clip"))


@query()
def prompt_budget(spark, sf_dir):
    """The texts of each source, cut to budgets in order, as a prompt."""
    docs = table(spark, sf_dir, "documents")
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", F.struct(F.col("doc_id").cast("string").alias("url"), "text").alias("v"))))
    none = F.array().cast("array<string>")
    sites = docs.groupBy("source").agg(F.transform(ordered, lambda x: x["v"]).alias("pages")).select(F.col("source").alias("domain"), "pages", none.alias("emails"), none.alias("profiles"), none.alias("companies"))
    clips = corpus.budget_pages(F.col("pages"), 6000, 24000)
    return corpus.build_prompts(sites, Settings()).select(F.col("domain").alias("source"), F.size(clips).alias("clips"), F.aggregate(clips, F.lit(0), lambda a, c: a + F.length(c["text"])).alias("chars"), F.md5("prompt").alias("prompt_md5"))


@query(r"""SELECT n, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS collapsed, CASE WHEN length(e) > 60 THEN substr(e, 1, 59) || '…' ELSE e END AS error, """ + _DEOBFUSCATED.replace("text,", "raw,") + r""" AS plain, regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS squashed,
    CASE WHEN starts_with(raw, '```') THEN '{"a": 1}' ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END AS bare FROM (SELECT *, trim(split_part(trim(regexp_replace(raw, '\s+', ' ', 'g')), 'Call log:', 1)) AS e FROM """ + fx.values(fx.TEXTS) + ")")
def text_functions(spark, sf_dir):
    raw = F.col("raw")
    return fx.frame(spark, fx.TEXTS).select("n", text.collapse_ws(raw).alias("collapsed"), text.compact_error(raw, 60).alias("error"), text.deobfuscate(raw).alias("plain"), text.squash(text.fold(raw)).alias("squashed"), text.strip_fences(raw).alias("bare"))


# --- model answers -----------------------------------------------------------------------------------------------

_JSON = "regexp_replace(regexp_replace(coalesce(content, ''), '^```[a-z]*\\n', ''), '\\n```$', '')"
_FAULTS = f"""(SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN NOT json_valid(j) OR NOT starts_with(j, '{{') THEN 'json' ELSE nullif(concat_ws(' ',
    CASE WHEN json_extract_string(j, '$.company_overview') IS NULL THEN 'company_overview' WHEN length(json_extract_string(j, '$.company_overview')) < 15 THEN 'company_overview' END, CASE WHEN coalesce(length(json_extract_string(j, '$.target_audience')), 0) < 15 THEN 'target_audience' END,
    CASE WHEN len(list_filter(json_extract_string(j, '$.team_members[*].name'), lambda x: length(x) < 2 OR length(x) > 80)) > 0 THEN 'team_members' END, CASE WHEN CAST(coalesce(json_extract_string(j, '$.self_reported_confidence'), '0.5') AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'self_reported_confidence' END), '') END AS fault
    FROM (SELECT *, CASE WHEN json_valid({_JSON}) THEN {_JSON} ELSE 'x' END AS j FROM {fx.values(fx.RESPONSES)}))"""


@query(f"SELECT domain, attempt, fault, error IS NULL AND fault IS NULL AS valid FROM {_FAULTS}")
def llm_validation(spark, sf_dir):
    judged = extraction.judge_attempts(fx.frame(spark, fx.RESPONSES))
    names = F.array_join(F.transform("faults", lambda f: F.split(f, ":")[0]), " ")
    fault = F.when(F.col("error").isNotNull(), None).when(F.col("answer").isNull(), "json").otherwise(F.nullif(names, F.lit("")))
    return judged.select("domain", "attempt", fault.alias("fault"), F.col("problem").isNull().alias("valid"))


_PRICE = lambda i: "CASE model " + " ".join(f"WHEN '{m}' THEN {p[i]}" for m, p in MODEL_PRICES.items()) + f" ELSE {(0.59, 0.79)[i]} END"
_LAST = f"(SELECT domain, coalesce(min(attempt) FILTER (WHERE error IS NOT NULL OR fault IS NULL), 3) AS last FROM {_FAULTS} GROUP BY 1)"


@query(f"""SELECT domain, max(attempt) FILTER (WHERE error IS NULL AND fault IS NULL) AS valid_attempt, coalesce(max(attempt) FILTER (WHERE error IS NULL AND fault IS NULL), 3) AS attempts, count(*) FILTER (WHERE error IS NOT NULL OR fault IS NOT NULL) AS n_errors,
    count(*) FILTER (WHERE error IS NULL) AS llm_calls, CAST(sum(CASE WHEN error IS NULL THEN total_tokens ELSE 0 END) AS BIGINT) AS total_tokens FROM {_FAULTS} JOIN {_LAST} USING (domain) WHERE attempt <= last GROUP BY 1""")
def llm_first_valid_attempt(spark, sf_dir):
    played = extraction.replay(fx.frame(spark, fx.RESPONSES))
    return played.select("domain", F.when(F.col("extraction").isNotNull(), F.col("attempts")).alias("valid_attempt"), "attempts", F.size("errors").cast("bigint").alias("n_errors"), "usage.llm_calls", "usage.total_tokens")


@query(f"SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(CAST(sum(prompt_tokens) / 1e6 * max({_PRICE(0)}) + sum(completion_tokens) / 1e6 * max({_PRICE(1)}) AS DOUBLE), 6) AS cost FROM {fx.values(fx.RESPONSES)} GROUP BY 1")
def token_cost_by_model(spark, sf_dir):
    used = fx.frame(spark, fx.RESPONSES).groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return used.withColumn("cost", extraction.cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("model")))


_MESSAGES = """concat_ws('; ', CASE WHEN contains(fault, 'company_overview') THEN 'company_overview: ' || CASE WHEN json_extract_string(j, '$.company_overview') IS NULL THEN 'Field required' ELSE 'must be a meaningful sentence, not a placeholder' END END,
    CASE WHEN contains(fault, 'team_members') THEN 'team_members: name must be between 2 and 80 characters' END, CASE WHEN contains(fault, 'self_reported_confidence') THEN 'self_reported_confidence: must be between 0 and 1' END)"""
_SAID_WRONG = f"CASE WHEN error IS NOT NULL THEN 'llm call attempt ' || attempt || ': ' || error WHEN fault = 'json' THEN 'invalid json on attempt ' || attempt WHEN fault IS NOT NULL THEN 'schema validation failed on attempt ' || attempt || ': ' || {_MESSAGES} END"
_GOOD_ANSWER = f"(SELECT domain, j FROM {_FAULTS} JOIN {_LAST} USING (domain) WHERE attempt = last AND error IS NULL AND fault IS NULL)"
_ITEMS = lambda of: f"(SELECT domain, i, json_extract_string(j, '{of}')[i] AS raw FROM {_GOOD_ANSWER}, unnest(range(1, 100)) AS r(i) WHERE i <= len(json_extract_string(j, '{of}')))"


@query(f"""SELECT e.domain, json_extract_string(j, '$.company_overview') AS company_overview, json_extract_string(j, '$.target_audience') AS target_audience, CAST(coalesce(json_extract_string(j, '$.self_reported_confidence'), '0.5') AS DOUBLE) * CASE WHEN j IS NOT NULL THEN 1 END AS confidence, emails, people, errors
    FROM (SELECT domain, coalesce(string_agg({_SAID_WRONG}, ' | ' ORDER BY attempt) FILTER (WHERE error IS NOT NULL OR fault IS NOT NULL), '') AS errors FROM {_FAULTS} JOIN {_LAST} USING (domain) WHERE attempt <= last GROUP BY 1) e LEFT JOIN {_GOOD_ANSWER} g ON g.domain = e.domain
    LEFT JOIN (SELECT domain, string_agg(email, ',' ORDER BY i) AS emails FROM (SELECT domain, {tidy_sql('raw')} AS email, min(i) AS i FROM {_ITEMS('$.contact_emails[*]')} WHERE {reason_sql('raw', tidy_sql('raw'))} IS NULL GROUP BY 1, 2) GROUP BY 1) m ON m.domain = e.domain
    LEFT JOIN (SELECT domain, string_agg(name, ',' ORDER BY i) AS people FROM (SELECT domain, lower(regexp_replace(raw, '\\s+', ' ', 'g')), arg_min(regexp_replace(raw, '\\s+', ' ', 'g'), i) AS name, min(i) AS i FROM {_ITEMS('$.team_members[*].name')} GROUP BY 1, 2) GROUP BY 1) p ON p.domain = e.domain""")
def llm_extractions(spark, sf_dir):
    answer = F.col("extraction")
    names = F.array_join(F.transform(answer["team_members"], lambda m: m["name"]), ",")
    return extraction.replay(fx.frame(spark, fx.RESPONSES)).select(
        "domain", answer["company_overview"].alias("company_overview"), answer["target_audience"].alias("target_audience"), answer["self_reported_confidence"].alias("confidence"),
        F.array_join(answer["contact_emails"], ",").alias("emails"), names.alias("people"), F.array_join("errors", " | ").alias("errors"),
    )


# --- people ------------------------------------------------------------------------------------------------------


def _members(spark) -> DataFrame:
    return people.with_company(fx.frame(spark, fx.MEMBERS), fx.frame(spark, fx.COMPANIES))


_STATED = "regexp_replace(lower(coalesce(affiliation, '')), '[^a-z0-9]+', '', 'g')"
_LABEL = "regexp_replace(split_part(domain, '.', 1), '[^a-z0-9]+', '', 'g')"
_STOP = _quoted(COMPANY_STOP)
_TOKENS = f"list_filter(regexp_split_to_array(lower(coalesce(company_name, '') || ' ' || domain), '[^a-z0-9]+') || [{_LABEL}], lambda t: length(t) >= 2 AND NOT list_contains([{_STOP}], t))"
_OWN = f"({_STATED} = '' OR contains({_STATED}, {_LABEL}) OR contains({_LABEL}, {_STATED}) OR list_has_any({_TOKENS}, list_filter(regexp_split_to_array(lower(affiliation), '[^a-z0-9]+'), lambda t: length(t) >= 3)))"


@query(f"SELECT domain, pos, name, {_OWN} AS own FROM {fx.values(fx.MEMBERS)} JOIN {fx.values(fx.COMPANIES)} USING (domain)")
def own_team_filter(spark, sf_dir):
    return people.mark_own(_members(spark)).select("domain", "pos", "name", "own")


@query(f"""SELECT domain, count(*) || ' name(s) excluded as other companies'' people: ' || string_agg(name || ' (' || affiliation || ')', ', ' ORDER BY pos) AS note FROM (SELECT * FROM {fx.values(fx.MEMBERS)} JOIN {fx.values(fx.COMPANIES)} USING (domain)) WHERE NOT {_OWN} GROUP BY 1""")
def own_team_notes(spark, sf_dir):
    return people.own_team_notes(people.mark_own(_members(spark)))


_TIER = "CASE WHEN coalesce(title, '') = '' THEN 99 " + " ".join(f"WHEN {' OR '.join(f'''contains(' ' || lower(title) || ' ', '{m}')''' for m in markers)} THEN {i}" for i, markers in enumerate(SENIORITY)) + f" ELSE {len(SENIORITY)} END"


@query(f"SELECT n, title, {_TIER} AS tier, row_number() OVER (ORDER BY {_TIER}, n) AS place FROM {fx.values(fx.TITLES)}")
def seniority_rank(spark, sf_dir):
    ranked = fx.frame(spark, fx.TITLES).withColumn("tier", people.seniority_rank(F.col("title")))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("tier", "n")))


@query(f"SELECT domain, count(*) || ' name(s) dropped with no title and no verifiable profile: ' || string_agg(name, ', ' ORDER BY pos) AS note FROM {fx.values(fx.MEMBERS)} WHERE coalesce(title, '') = '' AND coalesce(linkedin_url, '') = '' GROUP BY 1")
def evidence_rule(spark, sf_dir):
    return people.evidence_notes(fx.frame(spark, fx.MEMBERS))


def _canon(column: str) -> str:
    return f"(SELECT CASE WHEN length({_SLUG}) >= 3 THEN 'https://www.linkedin.com/in/' || {_SLUG} END FROM (SELECT {column} AS raw))"


@query(f"SELECT m.domain, m.pos, m.name, m.canon, coalesce(v.canon IS NOT NULL, false) AS on_site FROM (SELECT *, {_canon('linkedin_url')} AS canon FROM {fx.values(fx.MEMBERS)}) m LEFT JOIN (SELECT DISTINCT domain, {_canon('url')} AS canon FROM {fx.values(fx.VERIFIED)}) v ON m.domain = v.domain AND m.canon = v.canon")
def verified_profiles(spark, sf_dir):
    return people.verify_profiles(fx.frame(spark, fx.MEMBERS), fx.frame(spark, fx.VERIFIED)).select("domain", "pos", "name", "canon", "on_site")


@query(f"SELECT domain, pos, turn, turn <= 5 AS searched FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) AS turn FROM {fx.values(fx.MEMBERS)} WHERE linkedin_url IS NULL OR linkedin_url LIKE '%invented%')")
def lookup_budget(spark, sf_dir):
    known = people.lookup_budget(people.verify_profiles(fx.frame(spark, fx.MEMBERS), fx.frame(spark, fx.VERIFIED)), 5)
    return known.filter("turn is not null").select("domain", "pos", "turn", (F.col("turn") <= 5).alias("searched"))


def _pairs(spark) -> DataFrame:
    own = _members(spark).withColumn("name_key", text.fold("name"))
    hits = fx.frame(spark, fx.HITS).select("domain", "name_key", "rank", F.col("title").alias("hit_title"), F.col("url").alias("hit_url"), F.col("snippet").alias("hit_snippet"))
    return people.score_hits(own.join(hits, ["domain", "name_key"]))


# SQL of the same, for texts without accents
_WORDS = lambda x, n=2: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: length(t) >= {n}))"
_SQUASHED = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"
_INSIDE = lambda part, whole: f"len(list_filter({part}, lambda t: NOT list_contains({whole}, t))) = 0"
_HIT_ROWS = f"""(SELECT m.domain, m.pos, m.name, m.title, lower(m.name) AS name_key, h.rank, h.title AS hit_title, h.url AS hit_url, h.snippet, h.error AS hit_error, regexp_replace(split_part(m.domain, '.', 1), '[^a-z0-9]+', '', 'g') AS label,
    {_TOKENS.replace('domain', 'm.domain')} AS tokens, list_filter(regexp_split_to_array(lower(m.name), '[^a-z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains([{_quoted(NAME_NOISE)}], t)) AS parts,
    {_canon('h.url')} AS url, coalesce(h.title, '') || ' ' || coalesce(h.snippet, '') AS body FROM {fx.values(fx.MEMBERS)} m JOIN {fx.values(fx.COMPANIES)} c ON m.domain = c.domain LEFT JOIN {fx.values(fx.HITS)} h ON h.domain = m.domain AND h.name_key = lower(m.name))"""
_NAMED = "(list_contains({0}, parts[1]) OR contains({1}, parts[1])) AND (list_contains({0}, parts[-1]) OR contains({1}, parts[-1]))"
_MARKS = f"""(SELECT *, {_NAMED.format(_WORDS('slug'), _SQUASHED('slug'))} AS in_slug, list_contains({_WORDS('hit_title')}, parts[1]) AND list_contains({_WORDS('hit_title')}, parts[-1]) AS in_title,
    (label <> '' AND contains({_SQUASHED('body')}, label)) OR list_has_any(list_filter(tokens, lambda t: length(t) >= 4), {_WORDS('body')} || {_WORDS('slug')}) AS company,
    list_has_any(list_filter({_WORDS('title', 3)}, lambda t: NOT list_contains([{_quoted(ROLE_STOP)}], t)), {_WORDS('body')}) AS in_role FROM (SELECT *, coalesce(url_decode(split_part(url, '/in/', 2)), '') AS slug FROM {_HIT_ROWS}))"""
_SCORED = f"""(SELECT *, url IS NOT NULL AND len(parts) >= 2 AND (in_slug OR in_title) AND (company OR in_role) AS good, round(least(0.95, CASE WHEN in_slug AND in_title THEN 0.8 WHEN in_slug THEN 0.7 ELSE 0.55 END + CASE WHEN company THEN 0.2 ELSE 0 END + CASE WHEN in_role THEN 0.1 ELSE 0 END), 2)::DOUBLE AS sure,
    concat_ws('; ', CASE WHEN in_slug AND in_title THEN 'name matches profile slug and result title' WHEN in_slug THEN 'name matches profile slug' ELSE 'name matches result title' END, CASE WHEN company THEN 'company corroborated in search result' END, CASE WHEN in_role THEN 'role corroborated in search result' END) AS said FROM {_MARKS})"""
_SEGMENTS = rf"""(SELECT *, segments[i] AS raw FROM (SELECT *, regexp_split_to_array(trim(regexp_replace(hit_title, '(?i)\s*[-|–]\s*linkedin.*$', '')), '\s+[-–|]\s+') AS segments FROM {_SCORED} WHERE good), unnest(range(1, 20)) AS r(i) WHERE i <= len(segments))"""
_EMPLOYER = r"(?i)^(.*?)(?:\s+@\s+|\s+at\s+|\s*,\s+)(.+)$"
_JOBS = f"""(SELECT domain, pos, rank, arg_min(job, i) AS job FROM (SELECT *, CASE WHEN regexp_extract(raw, '{_EMPLOYER}', 1) <> '' AND {_INSIDE(_WORDS(f"regexp_extract(raw, '{_EMPLOYER}', 2)"), 'tokens')} THEN regexp_extract(raw, '{_EMPLOYER}', 1) ELSE raw END AS job FROM {_SEGMENTS})
    WHERE len({_WORDS('job')}) > 0 AND NOT {_INSIDE(_WORDS('raw'), 'parts')} AND NOT {_INSIDE('parts', _WORDS('raw'))} AND NOT {_INSIDE(_WORDS('job'), 'tokens')} AND {_SQUASHED('job')} <> label AND lower(job) NOT IN ({_quoted(NO_ROLE)}) AND length(job) <= 80 GROUP BY 1, 2, 3)"""
_KNOWN = f"(SELECT s.*, j.job FROM {_SCORED} s LEFT JOIN {_JOBS} j ON s.domain = j.domain AND s.pos = j.pos AND s.rank = j.rank)"
_FOUND = f"""(SELECT domain, pos, name, name_key, count(hit_url) AS n, max(hit_error) AS failed, arg_max(struct_pack(url := url, sure := sure, said := said, job := job), sure - rank / 1000) FILTER (WHERE good) AS best FROM {_KNOWN} GROUP BY 1, 2, 3, 4)"""
_LEAST = Settings().linkedin_min_confidence
_NOTE = f"""CASE WHEN failed IS NOT NULL THEN 'search unavailable: ' || failed WHEN best IS NULL AND n > 0 THEN n || ' search result(s) rejected: no corroborated name match' WHEN best IS NULL THEN 'search returned no results'
    WHEN best.sure < {_LEAST} THEN 'best candidate scored ' || format('{{:.2f}}', best.sure) || ', below the {_LEAST:.2f} threshold' ELSE '' END"""
_MATCHED = f"(SELECT *, failed IS NULL AND coalesce(best.sure >= {_LEAST}, false) AS hit, {_NOTE} AS note FROM {_FOUND})"


@query(f"SELECT domain, name, rank, CASE WHEN good THEN url END AS url, CASE WHEN good THEN sure END AS confidence, CASE WHEN good THEN said END AS evidence FROM {_SCORED} WHERE rank IS NOT NULL")
def candidate_scores(spark, sf_dir):
    return _pairs(spark).select("domain", "name", "rank", "match.url", "match.confidence", F.array_join("match.evidence", "; ").alias("evidence"))


@query(f"SELECT domain, name, rank, CASE WHEN good THEN job END AS role FROM {_KNOWN} WHERE rank IS NOT NULL")
def role_from_result(spark, sf_dir):
    return _pairs(spark).select("domain", "name", "rank", "match.role")


@query(f"SELECT domain, name_key, CASE WHEN hit THEN best.url END AS url, CASE WHEN hit THEN best.sure END AS confidence, CASE WHEN hit THEN best.said END AS evidence, CASE WHEN hit THEN best.job END AS role, note FROM {_MATCHED}")
def best_profile_match(spark, sf_dir):
    own = _members(spark).withColumn("name_key", text.fold("name"))
    found = people.best_matches(own, fx.frame(spark, fx.HITS), Settings())
    return found.select("domain", "name_key", "match.url", "match.confidence", F.array_join("match.evidence", "; ").alias("evidence"), "match.role", "note")


_MOST = Settings().linkedin_search_max_lookups
_TEAM = f"""(SELECT t.*, f.best, f.note, coalesce(f.hit, false) AND t.turn <= {_MOST} AND NOT t.on_site AS hit, {_NAMED.format(_WORDS('slug'), _SQUASHED('slug'))} AS named FROM
    (SELECT *, row_number() OVER (PARTITION BY domain, on_site ORDER BY pos) AS turn, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS parts, coalesce(url_decode(split_part(canon, '/in/', 2)), '') AS slug FROM
        (SELECT m.*, v.canon IS NOT NULL AS on_site FROM (SELECT *, {_canon('linkedin_url')} AS canon FROM {fx.values(fx.MEMBERS)}) m LEFT JOIN (SELECT DISTINCT domain, {_canon('url')} AS canon FROM {fx.values(fx.VERIFIED)}) v ON m.domain = v.domain AND m.canon = v.canon)) t JOIN {_MATCHED} f USING (domain, pos))"""
_FILLED = "hit AND coalesce(title, '') = '' AND best.job IS NOT NULL"
_INVENTED = "CASE WHEN coalesce(linkedin_url, '') <> '' THEN 'model-supplied url discarded: not found in page HTML' END"


@query(f"""SELECT domain, pos, name, CASE WHEN {_FILLED} THEN best.job ELSE title END AS title, CASE WHEN on_site THEN canon WHEN hit THEN best.url END AS linkedin_url, affiliation, CASE WHEN {_FILLED} THEN 'search' WHEN coalesce(title, '') <> '' THEN 'website' END AS title_source,
    CASE WHEN on_site THEN 'website' WHEN hit THEN 'search' END AS linkedin_source, CAST(CASE WHEN on_site AND named THEN 0.95 WHEN on_site THEN 0.75 WHEN hit THEN best.sure ELSE 0 END AS DOUBLE) AS linkedin_confidence,
    CASE WHEN on_site THEN 'url harvested from the company''s own HTML' || CASE WHEN named THEN ' and matches the person''s name' ELSE '' END WHEN hit THEN concat_ws('; ', {_INVENTED}, best.said, CASE WHEN {_FILLED} THEN 'title read from the matched search result: ' || best.job END)
        ELSE concat_ws('; ', {_INVENTED}, CASE WHEN turn > {_MOST} THEN 'not searched: per-domain lookup budget of {_MOST} reached' ELSE nullif(note, '') END) END AS linkedin_evidence FROM {_TEAM}""")
def resolved_team(spark, sf_dir):
    team = people.resolve_team(_members(spark), fx.frame(spark, fx.VERIFIED), fx.frame(spark, fx.HITS), Settings())
    return team.withColumn("linkedin_evidence", F.array_join("linkedin_evidence", "; "))


@query()
def result_page_hits(spark, sf_dir):
    page = spark.createDataFrame([(fx.RESULT_PAGE,)], "body string")
    return page.select(F.explode(html.search_hits("body")).alias("h")).select("h.*")


@query(f"SELECT domain, '\"' || name || '\" \"' || CASE WHEN coalesce(company_name, '') <> '' THEN company_name ELSE split_part(domain, '.', 1) END || '\" ' || CASE WHEN coalesce(title, '') <> '' THEN substr(title, 1, 40) || ' ' ELSE '' END || 'site:linkedin.com/in' AS query FROM {fx.values(fx.MEMBERS)} JOIN {fx.values(fx.COMPANIES)} USING (domain)")
def search_queries(spark, sf_dir):
    return _members(spark).select("domain", people.query_text(F.col("name"), F.col("title"), F.col("domain"), F.col("company_name")).alias("query"))


# --- scores and records ------------------------------------------------------------------------------------------


@query(f"""SELECT host, CASE WHEN ok = 0 THEN 0.0 ELSE least(1.0, round(CAST(ok / 6.0 * CASE WHEN full_pages < ok THEN 0.5 + 0.5 * full_pages / ok ELSE 1.0 END AS DOUBLE), 6)) END AS coverage FROM (SELECT {HOST_SQL} AS host, count(*) FILTER (WHERE chars > 0) AS ok, count(*) FILTER (WHERE chars >= 800) AS full_pages FROM (SELECT url, length({TEXT_SQL}) AS chars FROM pages) GROUP BY 1)""")
def source_coverage(spark, sf_dir):
    body = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.length(html.text_fast(F.col("html"))).alias("clean_chars"))
    ok, full = F.count_if(F.col("clean_chars") > 0), F.count_if(F.col("clean_chars") >= 800)
    counts = body.groupBy("host").agg(ok.alias("ok"), full.alias("full"))
    return counts.select("host", F.round(scoring.coverage_of_counts(F.col("ok"), F.col("full"), 6), 6).alias("coverage"))


def _people_of(row: DataFrame) -> Column:
    member = lambda i: F.struct(F.lit("n").alias("name"), F.when(F.lit(i) < F.col("titled"), "t").alias("title"), F.when(F.lit(i) < F.col("linked"), "u").alias("linkedin_url"), F.when(F.lit(i) < F.col("titled"), "website").alias("title_source"), F.lit("website").alias("linkedin_source"), F.when(F.lit(i) < F.col("linked"), F.col("confidence")).otherwise(0.0).alias("linkedin_confidence"))
    return F.slice(F.array(*[member(i) for i in range(5)]), F.lit(1), F.col("team").cast("int"))


def _score_inputs(spark) -> DataFrame:
    rows = fx.frame(spark, fx.RECORDS)
    page = lambda thin: F.struct(F.lit("ok").alias("status"), F.lit(100 if thin else 900).alias("clean_chars"))
    pages = F.concat(F.array_repeat(page(True), F.col("thin").cast("int")), F.array_repeat(page(False), (F.col("pages_ok") - F.col("thin")).cast("int")))
    return rows.withColumn("people", _people_of(rows)).withColumn("mail", F.array_repeat(F.lit("a@b.co"), F.col("emails").cast("int"))).withColumn("pages", pages).withColumn("errors", F.when(F.col("schema_error"), F.array(F.lit("schema validation failed"))).otherwise(F.array().cast("array<string>")))


_W = SCORE_WEIGHTS
_COMPLETE = f"({_W['overview']} + {_W['audience']} + {_W['emails']} * least(1.0, emails / 2.0) + CASE WHEN team > 0 THEN {_W['team']} * least(1.0, team / 3.0) + {_W['profiles']} * linked * CASE WHEN confidence = 0 THEN 1 ELSE confidence END / team + {_W['titles']} * titled / team ELSE 0 END)"
_COVER = "(CASE WHEN pages_ok = 0 THEN 0.0 ELSE least(1.0, pages_ok / 6.0 * CASE WHEN thin > 0 THEN 0.5 + 0.5 * (pages_ok - thin) / pages_ok ELSE 1.0 END) END)"
_STRONG = "(CASE WHEN team > 0 THEN (0.5 * titled + 0.5 * linked * confidence) / team END)"
_VALID = "round((CASE WHEN attempts <= 1 THEN 1.0 ELSE 1.0 - (attempts - 1) / 3.0 END) * CASE WHEN schema_error THEN 0.9 ELSE 1.0 END, 3)"


@query(f"""SELECT domain, round(CAST({_COMPLETE} AS DOUBLE), 3) AS completeness, round(CAST({_COVER} AS DOUBLE), 3) AS coverage, round(CAST({_STRONG} AS DOUBLE), 3) AS evidence, CAST({_VALID} AS DOUBLE) AS validation,
    round(CAST(({BLEND['completeness']} * {_COMPLETE} + {BLEND['coverage']} * {_COVER} + {BLEND['validation']} * {_VALID} + coalesce({BLEND['evidence']} * {_STRONG}, 0)) / ({BLEND['completeness'] + BLEND['coverage'] + BLEND['validation']} + CASE WHEN team > 0 THEN {BLEND['evidence']} ELSE 0 END) AS DOUBLE), 3) AS final FROM {fx.values(fx.RECORDS)}""")
def confidence_blend(spark, sf_dir):
    rows, some = _score_inputs(spark), F.lit("a text")
    complete, covered, strong, valid = scoring.completeness(some, some, F.col("mail"), F.col("people")), scoring.coverage(F.col("pages"), 6), scoring.evidence_strength(F.col("people")), scoring.validation_health(F.col("attempts"), 3, F.col("errors"))
    return rows.select("domain", F.round(complete, 3).alias("completeness"), F.round(covered, 3).alias("coverage"), F.round(strong, 3).alias("evidence"), valid.alias("validation"), scoring.blend(complete, covered, strong, valid).alias("final"))


@query(f"SELECT host, CASE WHEN n = 0 THEN 'failed' WHEN bad > 0 THEN 'partial' ELSE 'success' END AS status FROM (SELECT {HOST_SQL} AS host, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 0) AS bad FROM pages LEFT JOIN labels ON page_id = doc_id GROUP BY 1)")
def domain_status(spark, sf_dir):
    """Hosts left-joined to labelled pages; a label of low quality stands for a failed fetch."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    joined = pages.select(urls.host(F.col("url")).alias("host"), F.col("page_id").alias("doc_id")).join(labels, "doc_id", "left")
    found = joined.groupBy("host").agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") != 1).alias("failed"))
    return found.select("host", scoring.status_of(F.col("ok") > 0, F.col("failed") > 0, F.array().cast("array<string>")).alias("status"))


@query(f"""SELECT count(*) AS domains, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(pages_ok) AS BIGINT) AS pages_crawled, CAST(sum(pages_ok) AS BIGINT) AS pages_attempted, CAST(0 AS BIGINT) AS pages_by_browser,
    CAST(sum(team) AS BIGINT) AS team_members, CAST(sum(titled) AS BIGINT) AS titles, CAST(sum(linked) AS BIGINT) AS linkedin_urls, CAST(0 AS BIGINT) AS linkedin_by_search, CAST(sum(emails) AS BIGINT) AS contact_emails, CAST(0 AS BIGINT) AS personal_emails, round(avg(confidence) FILTER (WHERE status <> 'failed'), 2) AS mean_confidence, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost, 0.0::DOUBLE AS runtime FROM {fx.values(fx.RECORDS)}""")
def run_totals(spark, sf_dir):
    rows = _score_inputs(spark)
    shaped = rows.select("domain", "status", F.col("people").alias("team_members"), F.col("mail").alias("contact_emails"), F.array().cast("array<string>").alias("personal_emails"), F.col("confidence").alias("data_confidence_score"), F.struct(F.col("tokens").alias("total_tokens"), F.col("cost").alias("estimated_cost_usd")).alias("usage"), F.lit(0.0).alias("duration_seconds"), F.transform("pages", lambda p: F.struct(p["status"].alias("status"), F.lit("http").alias("tier"))).alias("pages_crawled"))
    return report.run_totals(shaped)


def host_records(spark, sf_dir) -> DataFrame:
    pages = records.pages_of_hosts(table(spark, sf_dir, "pages"))
    asked = pages.groupBy(F.col("domain").alias("domain_raw")).agg(F.min("page_pos").alias("input_pos"))
    return records.domain_records(asked, pages, Settings(email_blocklist=OPEN))


@query()
def domain_records(spark, sf_dir):
    """The flagship: one enriched record per host, answers made of the pages' own words."""
    return host_records(spark, sf_dir)
