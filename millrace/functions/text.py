"""Text expressions. Lengths are code points; null texts give null unless said otherwise."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.config import COMPANY_STOP, NAME_NOISE
from millrace.functions.batches import by_piece

#: As an object, since workers that import this module have no session to parse DDL.
TEXTS = T.ArrayType(T.StringType())


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Lower case without accents (NFKD less combining marks): Spark has no normaliser."""
    plain = lambda s: s.lower() if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return text.map(plain, na_action="ignore")


def tokens(folded: Column, least: int = 2) -> Column:
    """Distinct runs of a-z and 0-9 of folded text, of ``least`` characters or more, in order."""
    return F.array_distinct(F.filter(F.split(folded, "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def squash(folded: Column) -> Column:
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def name_tokens(folded: Column) -> Column:
    """The telling parts of a person's name, repeats kept."""
    return F.filter(F.split(folded, "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*NAME_NOISE))


def company_label(domain: Column) -> Column:
    return squash(F.lower(F.split(domain, r"\.")[0]))


def company_tokens(domain: Column, folded_name: Column) -> Column:
    """Telling words of a company's name and domain, and its label."""
    stop, label = F.array(*map(F.lit, COMPANY_STOP)), company_label(domain)
    own = F.array_except(F.array_union(tokens(folded_name), tokens(F.lower(domain))), stop)
    return F.array_union(own, F.array_except(F.when(label != "", F.array(label)).otherwise(F.array().cast("array<string>")), stop))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4))


def rfind(text: Column, part: str) -> Column:
    """Zero-based place of the last ``part``, or -1."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at > 0, F.length(text) - at - len(part) + 1).otherwise(-1)


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<!\s)\s++$", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def truncate_to_chars(text: Column, limit: Column) -> Column:
    """At most ``limit`` characters, cut at the last paragraph, line or sentence beyond six tenths, else hard."""
    window = F.substring(text, F.lit(1), limit)
    cut = rstrip(window)
    for part in (". ", "\n", "\n\n"):
        at = rfind(window, part)
        cut = F.when(at > limit * F.lit(0.6), rstrip(F.substring(window, F.lit(1), at))).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def compact_error(error: Column, limit: int = 180) -> Column:
    line = F.trim(F.split(collapse_ws(error), "Call log:")[0])
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


def decode_escapes_py(text: str) -> str:
    put = lambda m: m[0] if 0xD800 <= int(m[1], 16) <= 0xDFFF else chr(int(m[1], 16))
    return html.unescape(re.sub(r"\\u([0-9a-fA-F]{4})", put, text))


def decoded(texts: list[str | None] | None) -> list[str | None] | None:
    return texts and [decode_escapes_py(s) if s and ("\\u" in s or "&" in s) else s for s in texts]


@F.arrow_udf(TEXTS)
def decode_escapes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """JSON escapes, then HTML entities (the full table of entities is not in Spark), of each of an array of texts."""
    return by_piece(texts, to_arrow_type(TEXTS), decoded)


def decode_common(text: Column) -> Column:
    """The entities that stand in addresses, without leaving the JVM."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#64;", "@"), ("&#46;", "."), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def deobfuscate(text: Column) -> Column:
    # a run of white space is tried from its start alone
    at = F.regexp_replace(text, r"(?iU)(?:(?<!\s)|\G)\s*+(?:\[at\]|\(at\)|\{at\})\s*", "@")
    return F.regexp_replace(at, r"(?iU)(?:(?<!\s)|\G)\s*+(?:\[dot\]|\(dot\)|\{dot\})\s*", ".")


def strip_fences(content: Column) -> Column:
    """A fenced answer without its first line and closing fence."""
    text = strip(content)
    inner = F.when(F.contains(text, F.lit("\n")), F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise(text)
    return F.when(F.startswith(text, F.lit("```")), strip(F.regexp_replace(inner, r"(?U)```\s*$", ""))).otherwise(text)


def ordered_distinct(items: Column) -> Column:
    return F.array_distinct(items)
