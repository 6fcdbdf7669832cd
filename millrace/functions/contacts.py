"""Mailbox and profile expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import CATEGORY_ORDER, DEPARTMENT_WORDS, EMAIL_BLOCKLIST, MAILBOX_WORDS, PREFERRED_PREFIXES
from millrace.functions.text import decode_common, deobfuscate, let, squash, tokens
from millrace.functions.urls import path

#: Fixed values.
ADDRESS = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
ADDRESS_IN_TEXT = r"[A-Za-z0-9._%+\-]+\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PROFILE = r"(?i)^https?://(?:[a-z]{2,3}\.)?linkedin\.com/(?:in|pub|company)/[^/?#\s]+"
PROFILE_IN_TEXT = r"(?i)(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/(?:in|pub|company)/[A-Za-z0-9\-_%.]+"

#: The same matches in linear time: only the start of a run of characters, or where the last match ended, can begin one.
ADDRESS_SEARCH = ADDRESS_IN_TEXT.replace(r"[A-Za-z0-9._%+\-]+", r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++", 1)


def tidy_email(raw: Column) -> Column:
    value = F.lower(decode_common(F.trim(raw)))
    value = F.trim(F.split(F.regexp_replace(value, "^mailto:", ""), r"\?")[0])
    value = F.regexp_replace(value, r"""^[.,;:<>()\[\]"']+|[.,;:<>()\[\]"']+$""", "")
    return F.regexp_replace(value, "^(?:u00[0-9a-f]{2})+", "")


def fault_of(raw_blank: Column, value: Column, blocklist=EMAIL_BLOCKLIST) -> Column:
    blocked = F.lit(False)
    for part in blocklist:
        blocked = blocked | F.contains(value, F.lit(part))
    numeric = F.substring_index(value, "@", -1).rlike(r"(^|\.)[0-9]+(\.|$)")
    return F.when(raw_blank, "blank").when(~value.rlike(ADDRESS), "syntax").when(blocked, "blocklist").when(F.length(value) > 120, "length").when(numeric, "number")


def email_reject_reason(raw: Column, blocklist=EMAIL_BLOCKLIST) -> Column:
    """Why ``clean_email`` gives null: blank, syntax, blocklist, length or number; null for a good address."""
    return let(tidy_email(F.coalesce(raw, F.lit(""))), lambda v: fault_of(F.coalesce(raw, F.lit("")) == "", v, blocklist))


def clean_email(raw: Column, blocklist=EMAIL_BLOCKLIST) -> Column:
    return let(tidy_email(raw), lambda v: F.when(fault_of(v == "", v, blocklist).isNull(), v))


def clean_all(raw: Column, blocklist=EMAIL_BLOCKLIST) -> Column:
    """The good addresses of an array, tidied, in order, repeats kept."""
    return F.filter(F.transform(raw, tidy_email), lambda v: v.isNotNull() & fault_of(v == "", v, blocklist).isNull())


def addresses_in(decoded: Column, blocklist=EMAIL_BLOCKLIST) -> Column:
    """Clean addresses of decoded text, in order, repeats kept."""
    raw = F.regexp_extract_all(deobfuscate(decoded), F.lit(f"({ADDRESS_SEARCH})"), F.lit(1))
    return clean_all(F.transform(raw, lambda x: F.replace(x, F.lit(" "), F.lit(""))), blocklist)


def local_part(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", 1))


def normalise_local(local: Column) -> Column:
    """Without what follows a plus sign and without punctuation."""
    return F.regexp_replace(F.split(local, r"\+")[0], "[^a-z0-9]+", "")


def category(email: Column) -> Column:
    """One of the mailbox categories, or `personal`. Exact words, departments, prefixes, then shapes of names."""
    return let(local_part(email), lambda local: let(normalise_local(local), lambda squashed: _category(local, squashed)))


def _category(local: Column, squashed: Column) -> Column:
    chain = F.when(squashed == "", "other")
    for kind, words in MAILBOX_WORDS.items():
        chain = chain.when(squashed.isin(*words), kind)
    chain = chain.when(squashed.isin(*DEPARTMENT_WORDS) | local.isin(*DEPARTMENT_WORDS), "other")
    for kind, words in MAILBOX_WORDS.items():
        chain = chain.when(local.rlike(f"^(?:{'|'.join(words)})(?![a-z])"), kind)
    personal = local.rlike(r"^[a-z]+[._-][a-z]{2,}(?:[._-][a-z]{2,})?$") | local.rlike(r"^\p{L}+$")
    return chain.when(personal, "personal").otherwise("other")


def _place(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), kind)


def split_contacts(emails: Column, blocklist=EMAIL_BLOCKLIST) -> tuple[Column, Column]:
    """(contact points by category order and address, personal inboxes in found order) of an array of addresses."""
    found = F.transform(F.array_distinct(clean_all(emails, blocklist)), lambda x: F.struct(x.alias("email"), category(x).alias("type")))
    placed = F.transform(F.filter(found, lambda x: x["type"] != "personal"), lambda x: F.struct(_place(x["type"]).alias("place"), x["email"].alias("email"), x["type"].alias("type")))
    points = F.transform(F.array_sort(placed), lambda x: F.struct(x["email"].alias("email"), x["type"].alias("type")))
    return points, F.transform(F.filter(found, lambda x: x["type"] == "personal"), lambda x: x["email"])


def by_preference(emails: Column) -> Column:
    """Distinct addresses, preferred mailboxes first, then by address."""
    keyed = F.transform(F.array_distinct(emails), lambda x: F.struct(F.when(F.substring_index(x, "@", 1).isin(*PREFERRED_PREFIXES), 0).otherwise(1).alias("k"), x.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def clean_profile(raw: Column) -> Column:
    value = F.regexp_replace(F.split(F.trim(raw), r"\?")[0], "/+$", "")
    value = F.regexp_replace(F.regexp_replace(value, "^//", "https://"), r"^(?=www\.|linkedin\.com)", "https://")
    return let(value, lambda v: F.when(v.rlike(PROFILE), F.replace(v, F.lit("http://"), F.lit("https://"))))


def canonical_profile(raw: Column) -> Column:
    """A personal profile in one shape, or null."""
    slug = F.regexp_extract(path(clean_profile(raw)), "(?i)^/(?:in|pub)/([^/]+)", 1)
    return let(slug, lambda s: F.when(F.length(s) >= 3, F.concat(F.lit("https://www.linkedin.com/in/"), s)))


def profile_slug(url: Column) -> Column:
    """The percent-decoded third part of the path; a plus sign stays."""
    return let(F.when(url.isNotNull(), F.coalesce(F.get(F.split(path(url), "/"), F.lit(2)), F.lit(""))), lambda raw: F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))


def profiles_in(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(f"({PROFILE_IN_TEXT})"), F.lit(1))
    return F.filter(F.transform(raw, clean_profile), lambda x: x.isNotNull())


def is_company_page(url: Column) -> Column:
    return F.contains(F.lower(url), F.lit("/company/"))


def own_employee(affiliation: Column, folded: Column, label: Column, company: Column) -> Column:
    """False only if the stated employer names another organisation."""
    stated = squash(folded)
    same = ((label != "") & (F.contains(stated, label) | F.contains(label, stated))) | F.arrays_overlap(company, tokens(folded, 3))
    return F.coalesce(affiliation.isNull() | (affiliation == "") | (stated == "") | same, F.lit(True))
