"""URL expressions by regular expressions: `parse_url` throws on characters that occur in the wild."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import NON_HTML, Settings
from millrace.functions.text import let

HOSTNAME = r"^[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9\-]{0,61}[a-z0-9])?)+$"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def _rest(url: Column) -> Column:
    return F.regexp_replace(url, _SCHEME, "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    whole = F.regexp_extract(F.regexp_replace(_rest(url), "^//[^/?#]*", ""), "^[^?#]*", 0)
    return F.regexp_replace(whole, ";[^/]*$", "")


def host(url: Column) -> Column:
    """Lower-cased, without port and one leading `www.`."""
    return F.regexp_replace(F.split(F.lower(netloc(url)), ":")[0], r"^www\.", "")


def outer_path(url: Column) -> Column:
    return F.regexp_replace(path(url), "^/+|/+$", "")


def normalise_domain(raw: Column) -> Column:
    """A bare host name, or null for what is none."""
    value = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "(?s)^(?!.*://)", "https://")
    where = let(value, lambda v: F.coalesce(F.nullif(netloc(v), F.lit("")), path(v)))
    where = F.split(F.substring_index(where, "@", -1), ":")[0]
    where = F.regexp_replace(F.regexp_replace(where, r"^www\.", ""), "^/+|/+$", "")
    return let(where, lambda w: F.when(w.rlike(HOSTNAME), w))


def normalise_domain_safe(raw: Column) -> Column:
    return F.coalesce(normalise_domain(raw), raw)


def root_url(domain: Column) -> Column:
    return F.concat(F.lit("https://"), normalise_domain(domain))


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, no `www.`, query, fragment, parameters, doubled or trailing slashes."""


    def clean(u: Column) -> Column:
        short = F.regexp_replace(F.regexp_replace(path(u), "/{2,}", "/"), "/+$", "")
        site = F.regexp_replace(F.concat(F.lit("//"), F.regexp_replace(F.lower(netloc(u)), r"^www\.", "")), "^//$", "")
        kind = F.regexp_replace(F.concat(scheme(u), F.lit(":")), "^:$", "")
        return F.concat(kind, site, F.regexp_replace(F.regexp_replace(short, "^$", "/"), "^(?!/)", "/"))

    return let(F.trim(url), clean)


def same_site(url: Column, domain: Column) -> Column:
    return F.endswith(F.concat(F.lit("."), host(url)), F.concat(F.lit("."), domain))


def depth(url: Column) -> Column:
    return _depth(outer_path(url))


def _depth(inner: Column) -> Column:
    return F.size(F.filter(F.split(inner, "/"), lambda x, i: (x != "") | (i > 0)))


def looks_like_html(url: Column) -> Column:
    return ~F.lower(path(url)).rlike(r"\.(" + "|".join(NON_HTML) + ")$")


def keyword_score(subject: Column, settings: Settings) -> Column:
    """The strongest keyword that is part of ``subject`` plus half of the others, and the penalties of its segments.

    Weights are literals of the plan, so no join is needed and it stays in generated code."""
    good = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in settings.keywords.items()])
    bad = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in settings.negative_keywords.items()])
    segments, framed = F.split(subject, r"[/\-_.]"), F.concat(F.lit("/"), subject, F.lit("/"))
    start = F.struct(F.lit(0.0).alias("most"), F.lit(0.0).alias("total"))
    add = lambda a, x: F.struct(F.greatest(a["most"], F.when(F.contains(subject, x["k"]), x["w"]).otherwise(0.0)).alias("most"), (a["total"] + F.when(F.contains(subject, x["k"]), x["w"]).otherwise(0.0)).alias("total"))
    gain = F.aggregate(good, start, add, lambda a: a["most"] + 0.5 * (a["total"] - a["most"]))
    loss = F.aggregate(bad, F.lit(0.0), lambda a, x: a + F.when(F.array_contains(segments, x["k"]) | F.contains(framed, F.concat(F.lit("/"), x["k"], F.lit("/"))), x["w"]).otherwise(0.0))
    return gain + loss


def relevance(url: Column, settings: Settings, domain: Column | None = None) -> Column:
    """How likely a page tells of the company; the site's own root has 100, another host's root its label's score."""
    site = F.lit(None).cast("string") if domain is None else domain

    def score(x: Column) -> Column:
        where, inner = x["host"], x["path"]
        other = F.coalesce(where != site, F.lit(False))
        suffix = F.concat(F.lit("."), site)
        label = F.when(F.endswith(where, suffix), F.substring(where, F.lit(1), F.length(where) - F.length(suffix))).otherwise(where)
        cost = F.when(inner == "", 0.0).otherwise(_depth(inner) * 3.0 + F.when(F.length(inner) > 60, 4.0).otherwise(0.0) + F.when(other, 2.0).otherwise(0.0))
        gain = let(F.when(inner == "", label).otherwise(inner), lambda subject: keyword_score(subject, settings))
        return F.when((inner == "") & ~other, 100.0).otherwise(F.round(gain - cost, 2))

    return let(F.struct(host(url).alias("host"), F.lower(outer_path(url)).alias("path")), score)


def company_name(title: Column, domain: Column) -> Column:
    """The head of a page title, unless that is a sentence; else the domain's first label."""
    head = F.trim(F.split(F.trim(F.coalesce(title, F.lit(""))), r"(?U)\s*[|–—·:•-]\s+", 2)[0])
    good = (head != "") & (F.length(head) <= 40) & (F.size(F.split(head, r"(?U)\s+")) <= 5)
    return F.when(good, head).otherwise(F.split(domain, r"\.")[0])


def unwrap_redirect(href: Column) -> Column:
    """The target of `/l/` and `/url` links of search engines."""
    href = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
    query = F.regexp_extract(href, r"\?([^#]*)", 1)
    found = [F.nullif(F.regexp_extract(query, f"(?:^|&){key}=([^&]*)", 1), F.lit("")) for key in ("uddg", "url", "u", "q")]
    return F.when(path(href).rlike("^/(l/|url)"), F.coalesce(F.try_url_decode(F.coalesce(*found)), href)).otherwise(href)
