"""People of a site: whose employees they are, how senior, and which profile is theirs. One row a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import NO_ROLE, ROLE_STOP, SENIORITY, UNTITLED, Settings
from millrace.functions import contacts, text


def seniority_rank(title: Column) -> Column:
    """Lower is more senior; markers are substrings of the padded title."""
    padded = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    chain = F.when(F.coalesce(title, F.lit("")) == "", UNTITLED)
    for tier, markers in enumerate(SENIORITY):
        hit = F.lit(False)
        for marker in markers:
            hit = hit | F.contains(padded, F.lit(marker))
        chain = chain.when(hit, tier)
    return chain.otherwise(len(SENIORITY))


def names_note(count: Column, what: str, names: Column) -> Column:
    """A note of the first five of so many names; null for none."""
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(what), F.array_join(F.slice(names, 1, 5), ", "), F.when(count > 5, "…").otherwise("")))


def with_company(members: DataFrame, companies: DataFrame) -> DataFrame:
    """Members (domain, pos, name, title, linkedin_url, affiliation) with label and tokens of (domain, company_name)."""
    named = companies.withColumn("folded_company", text.fold(F.coalesce("company_name", F.lit(""))))
    tokens = named.select("domain", "company_name", text.company_label(F.col("domain")).alias("label"), text.company_tokens(F.col("domain"), F.col("folded_company")).alias("tokens"))
    return members.join(tokens, "domain", "left")


def mark_own(members: DataFrame) -> DataFrame:
    """Adds ``own``: not stated to work for another organisation."""
    folded = members.withColumn("folded_affiliation", text.fold(F.coalesce("affiliation", F.lit(""))))
    return folded.withColumn("own", contacts.own_employee(F.col("affiliation"), F.col("folded_affiliation"), F.col("label"), F.col("tokens"))).drop("folded_affiliation")


def _listed(flag: Column, name: Column) -> Column:
    found = F.array_sort(F.collect_list(F.when(~flag, F.struct(F.col("pos").alias("pos"), name.alias("name")))))
    return F.transform(found, lambda x: x["name"])


def own_team_notes(marked: DataFrame) -> DataFrame:
    """(domain, note) about people left out as other companies'."""
    names = _listed(F.col("own"), F.concat("name", F.lit(" ("), "affiliation", F.lit(")")))
    out = marked.groupBy("domain").agg(F.count_if(~F.col("own")).alias("n"), names.alias("names"))
    return out.select("domain", names_note(F.col("n"), " name(s) excluded as other companies' people: ", F.col("names")).alias("note")).filter("note is not null")


def has_evidence(title: Column, profile: Column) -> Column:
    return (F.coalesce(title, F.lit("")) != "") | (F.coalesce(profile, F.lit("")) != "")


def evidence_notes(members: DataFrame) -> DataFrame:
    """(domain, note) about people dropped with neither title nor profile."""
    marked = members.withColumn("kept", has_evidence(F.col("title"), F.col("linkedin_url")))
    out = marked.groupBy("domain").agg(F.count_if(~F.col("kept")).alias("n"), _listed(F.col("kept"), F.col("name")).alias("names"))
    return out.select("domain", names_note(F.col("n"), " name(s) dropped with no title and no verifiable profile: ", F.col("names")).alias("note")).filter("note is not null")


def query_text(name: Column, title: Column, domain: Column, company: Column) -> Column:
    firm = F.when(F.coalesce(company, F.lit("")) != "", company).otherwise(F.split(domain, r"\.")[0])
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.concat_ws(" ", quoted(name), quoted(firm), F.nullif(F.substring(title, 1, 40), F.lit("")), F.lit("site:linkedin.com/in"))


def present(token: Column, pool: Column, squashed: Column) -> Column:
    return F.array_contains(pool, token) | F.contains(squashed, token)


def within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def _employer(segment: Column, part: int) -> Column:
    return F.trim(F.regexp_extract(segment, r"(?i)^(.*?)(?:\s+@\s+|\s+at\s+|\s*,\s+)(.+)$", part))


def role_of(title: Column, folded_title: Column, person: Column, label: Column, tokens: Column) -> Column:
    """The job in a result's title: the first segment that is neither furniture, nor the person, nor the employer.

    The title and its folded form are cut at the same separators, so that no segment needs folding by itself."""
    furniture = r"(?i)\s*[-|–]\s*linkedin.*$"
    bare = lambda c: F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), furniture, "")), r"\s+[-–|]\s+")
    trim = lambda c: F.regexp_replace(F.trim(c), "^[,;]+|[,;]+$", "")
    pairs = F.arrays_zip(bare(title).alias("raw"), bare(folded_title).alias("low"))

    def own(words: Column) -> Column:
        return within(words, person) | within(person, words)

    def cut(pair: Column) -> Column:
        raw, low = trim(pair["raw"]), trim(pair["low"])
        head, tail = _employer(raw, 1), _employer(low, 2)
        tail_tokens = text.tokens(tail)
        drop = (head != "") & (F.size(tail_tokens) > 0) & (within(tail_tokens, tokens) | (text.squash(tail) == label))
        first = text.tokens(low)
        role, role_low = F.when(drop, head).otherwise(F.trim(raw)), F.when(drop, _employer(low, 1)).otherwise(F.trim(low))
        words = text.tokens(role_low)
        bad = (
            (raw == "") | F.lower(raw).isin(*NO_ROLE) | ((F.size(first) > 0) & own(first)) | (role == "") | F.lower(role).isin(*NO_ROLE) | (F.size(words) == 0) | own(words)
            | within(words, tokens) | (text.squash(role_low) == label) | ~role.rlike("[A-Za-z]") | (F.length(role) > 80) | (F.size(F.split(role, r"(?U)\s+")) > 10)
        )
        return F.when(~bad, role)

    return F.get(F.filter(F.transform(pairs, cut), lambda x: x.isNotNull()), F.lit(0))


def score_hits(pairs: DataFrame) -> DataFrame:
    """Adds match (url, confidence, evidence, role), null if a hit is not this person.

    ``pairs``: name, title, label, tokens of the member, hit_title, hit_url, hit_snippet."""
    folded = pairs
    slug = contacts.profile_slug(contacts.canonical_profile(F.col("hit_url")))
    for name, value in (("f_name", F.col("name")), ("f_title", F.coalesce("title", F.lit(""))), ("f_slug", F.coalesce(slug, F.lit(""))), ("f_hit", F.coalesce("hit_title", F.lit(""))), ("f_body", F.concat(F.coalesce("hit_title", F.lit("")), F.lit(" "), F.coalesce("hit_snippet", F.lit(""))))):
        folded = folded.withColumn(name, text.fold(value))
    url, parts = contacts.canonical_profile(F.col("hit_url")), text.name_tokens(F.col("f_name"))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    slug_tokens, slug_squashed = text.tokens(F.col("f_slug")), text.squash(F.col("f_slug"))
    hit_tokens, body_tokens = text.tokens(F.col("f_hit")), text.tokens(F.col("f_body"))
    in_slug = present(first, slug_tokens, slug_squashed) & present(last, slug_tokens, slug_squashed)
    in_title = F.array_contains(hit_tokens, first) & F.array_contains(hit_tokens, last)
    company = ((F.col("label") != "") & F.contains(text.squash(F.col("f_body")), F.col("label"))) | F.arrays_overlap(F.filter("tokens", lambda t: F.length(t) >= 4), F.array_union(body_tokens, slug_tokens))
    role = F.arrays_overlap(F.filter(text.tokens(F.col("f_title"), 3), lambda t: ~t.isin(*ROLE_STOP)), body_tokens)
    base = F.when(in_slug & in_title, 0.8).when(in_slug, 0.7).otherwise(0.55)
    confidence = F.round(F.least(F.lit(0.95), base + F.when(company, 0.2).otherwise(0.0) + F.when(role, 0.1).otherwise(0.0)), 2)
    told = F.when(in_slug & in_title, "name matches profile slug and result title").when(in_slug, "name matches profile slug").otherwise("name matches result title")
    evidence = F.array_compact(F.array(told, F.when(company, "company corroborated in search result"), F.when(role, "role corroborated in search result")))
    good = url.isNotNull() & (F.size(parts) >= 2) & (in_slug | in_title) & (company | role)
    job = role_of(F.col("hit_title"), F.col("f_hit"), F.array_distinct(parts), F.col("label"), F.col("tokens"))
    match = F.when(good, F.struct(url.alias("url"), confidence.alias("confidence"), evidence.alias("evidence"), job.alias("role")))
    return folded.withColumn("match", match).drop("f_name", "f_title", "f_slug", "f_hit", "f_body")


def best_matches(members: DataFrame, hits: DataFrame, settings: Settings) -> DataFrame:
    """(domain, name_key, match, note): the best hit of each distinct name, or why there is none.

    Names of a domain are looked up once. ``hits``: domain, name_key, rank, title, url, snippet, error."""
    asked = members.dropDuplicates(["domain", "name_key"]).select("domain", "name_key", "name", "title", "label", "tokens")
    given = hits.select("domain", "name_key", "rank", F.col("title").alias("hit_title"), F.col("url").alias("hit_url"), F.col("snippet").alias("hit_snippet"), F.col("error").alias("hit_error")).filter(F.col("hit_error").isNotNull() | (F.coalesce("rank", F.lit(0)) <= settings.linkedin_search_results))
    scored = score_hits(asked.join(given, ["domain", "name_key"], "left"))
    best = scored.groupBy("domain", "name_key").agg(
        F.max_by("match", F.when(F.col("match").isNotNull(), F.struct(F.col("match.confidence").alias("c"), (-F.col("rank")).alias("r")))).alias("match"),
        F.count("hit_url").alias("n"), F.max("hit_error").alias("failed"),
    )
    fixed = lambda c: F.format_number(c, 2)
    low = F.col("match.confidence") < settings.linkedin_min_confidence
    note = (
        F.when(F.col("failed").isNotNull(), F.concat(F.lit("search unavailable: "), text.compact_error(F.col("failed"), 80)))
        .when(F.col("match").isNull() & (F.col("n") > 0), F.concat(F.col("n").cast("string"), F.lit(" search result(s) rejected: no corroborated name match")))
        .when(F.col("match").isNull(), "search returned no results")
        .when(low, F.concat(F.lit("best candidate scored "), fixed(F.col("match.confidence")), F.lit(f", below the {settings.linkedin_min_confidence:.2f} threshold")))
        .otherwise("")
    )
    return best.select("domain", "name_key", F.when(F.col("failed").isNull() & ~F.coalesce(low, F.lit(True)), F.col("match")).alias("match"), note.alias("note"))


def verify_profiles(members: DataFrame, verified: DataFrame) -> DataFrame:
    """Adds canon and ``on_site``: the member's profile stands on the site's own pages (domain, url)."""
    own = verified.select("domain", contacts.canonical_profile(F.col("url")).alias("canon")).filter("canon is not null").distinct().withColumn("on_site", F.lit(True))
    keyed = members.withColumn("canon", contacts.canonical_profile(F.coalesce("linkedin_url", F.lit(""))))
    return keyed.join(own, ["domain", "canon"], "left").withColumn("on_site", F.coalesce("on_site", F.lit(False)))


def lookup_budget(members: DataFrame, most: int) -> DataFrame:
    """Adds ``turn``: the place among a domain's people that are not verified; null for verified ones."""
    order = Window.partitionBy("domain", "on_site").orderBy("pos")
    return members.withColumn("turn", F.when(~F.col("on_site"), F.row_number().over(order)))


def resolve_team(members: DataFrame, verified: DataFrame, hits: DataFrame | None, settings: Settings) -> DataFrame:
    """Members with profile, source, confidence and evidence; every null profile says why.

    ``members``: domain, pos, name, title, linkedin_url, affiliation, label, tokens. Without ``hits`` search is disabled."""
    known = lookup_budget(verify_profiles(members, verified), settings.linkedin_search_max_lookups)
    known = known.withColumn("name_key", text.fold("name")).withColumn("f_slug", text.fold(F.coalesce(contacts.profile_slug(F.col("canon")), F.lit(""))))
    parts = text.name_tokens(F.col("name_key"))
    slug_tokens, squashed = text.tokens(F.col("f_slug")), text.squash(F.col("f_slug"))
    named = (F.size(parts) > 0) & present(F.get(parts, F.lit(0)), slug_tokens, squashed) & present(F.get(parts, F.size(parts) - 1), slug_tokens, squashed)
    invented = F.when(F.coalesce("linkedin_url", F.lit("")) != "", "model-supplied url discarded: not found in page HTML")
    most, search = settings.linkedin_search_max_lookups, hits is not None and settings.linkedin_search_enabled
    if search:
        asked = known.filter(F.col("turn") <= most)
        known = known.join(best_matches(asked, hits, settings), ["domain", "name_key"], "left")
        known = known.withColumn("match", F.when(F.col("turn") <= most, F.col("match")))
        why = F.when(F.col("turn") > most, f"not searched: per-domain lookup budget of {most} reached").otherwise(F.nullif("note", F.lit("")))
    else:
        known = known.withColumn("match", F.lit(None).cast("struct<url:string,confidence:double,evidence:array<string>,role:string>"))
        why = F.lit("linkedin search is disabled")
    site, hit = F.col("on_site"), F.col("match").isNotNull()
    filled = hit & (F.coalesce("title", F.lit("")) == "") & F.col("match.role").isNotNull()
    on_site = F.array(F.when(named, "url harvested from the company's own HTML and matches the person's name").otherwise("url harvested from the company's own HTML"))
    found = F.concat(F.array_compact(F.array(invented)), F.col("match.evidence"), F.array_compact(F.array(F.when(filled, F.concat(F.lit("title read from the matched search result: "), "match.role")))))
    evidence = F.when(site, on_site).when(hit, found).otherwise(F.array_compact(F.array(invented, why)))
    stated = F.coalesce("title", F.lit("")) != ""
    return known.select(
        "domain", "pos", "name", F.when(filled, F.col("match.role")).otherwise(F.col("title")).alias("title"), F.when(site, F.col("canon")).otherwise(F.col("match.url")).alias("linkedin_url"), "affiliation",
        F.when(filled, "search").when(stated, "website").alias("title_source"), F.when(site, "website").when(hit, "search").alias("linkedin_source"),
        F.when(site, F.when(named, 0.95).otherwise(0.75)).otherwise(F.coalesce("match.confidence", F.lit(0.0))).alias("linkedin_confidence"), evidence.alias("linkedin_evidence"),
    )


def ranked_team(members: DataFrame) -> DataFrame:
    """(domain, team): people by seniority, ties in page order."""
    fields = ("name", "title", "linkedin_url", "affiliation", "title_source", "linkedin_source", "linkedin_confidence", "linkedin_evidence")
    keyed = F.array_sort(F.collect_list(F.struct(seniority_rank(F.col("title")).alias("tier"), "pos", F.struct(*fields).alias("person"))))
    return members.groupBy("domain").agg(F.transform(keyed, lambda x: x["person"]).alias("team"))
