"""HTML to clean text. Spark has no tolerant HTML parser, so a page is parsed once, in an Arrow function that gives
its text, links and title together, a piece of a batch at a time; everything after that is expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.batches import by_piece

# What is dropped, what is page furniture, what ends a line.
DROPPED = frozenset(("script", "style", "noscript", "svg", "canvas", "iframe", "form", "picture", "source", "video", "audio", "template", "select", "button"))
FURNITURE = frozenset(("nav", "header", "footer", "aside"))
FURNITURE_NAMES = re.compile("nav|menu|header|footer|cookie|consent|banner|breadcrumb|sidebar|social|newsletter|subscribe|announce|skip-link|modal|popup|toast|carousel-control|back-to-top", re.I)
BLOCKS = frozenset(("p", "div", "section", "article", "main", "li", "td", "th", "br", "tr"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: An opening tag of the key closes an open one of the values.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in "div section article main ul ol table h1 h2 h3 h4 h5 h6 nav header footer aside form blockquote pre".split()}
#: Elements that such closing does not go beyond.
SCOPES = frozenset("html body table ul ol dl div section article main td th".split())
FURNITURE_FLOOR = 1200


class Node:
    """An element: ``parts`` are texts and elements in order."""

    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                out.append(top)
            else:
                stack.extend(reversed(top.parts))
        return "".join(out)

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in shut:
                del self.open[i:]
                break
            if self.open[i].tag in SCOPES:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(page: str) -> Node | None:
    """The tree of a page, or null for blank and unparsable ones."""
    if not page or not page.strip():
        return None
    builder = _Builder()
    try:
        builder.feed(page)
        builder.close()
    except (AssertionError, ValueError):
        return None
    return builder.root


def _furniture(node: Node) -> bool:
    return node.tag in FURNITURE or any(FURNITURE_NAMES.search(node.attrs.get(a, "")) for a in ("class", "id", "role", "data-testid"))


def strip_tree(root: Node) -> None:
    """Drop elements without content, then furniture with little text. Text right after a dropped element goes with it;
    the document's own element stays."""

    def prune(node: Node, gone, top: bool) -> None:
        stack = [(node, top)]
        while stack:
            here, is_top = stack.pop()
            kept, after = [], False
            for part in here.parts:
                if isinstance(part, Node):
                    after = not is_top and gone(part)
                    if not after:
                        kept.append(part)
                        stack.append((part, False))
                elif not after:
                    kept.append(part)
            here.parts = kept

    prune(root, lambda n: n.tag in DROPPED, False)
    alone = sum(isinstance(p, Node) for p in root.parts) == 1
    sizes: dict[int, int] = {}
    for node in reversed([*root.walk()]):  # children before parents
        sizes[id(node)] = sum(len(p) if isinstance(p, str) else sizes[id(p)] for p in node.parts)
    prune(root, lambda n: sizes[id(n)] < FURNITURE_FLOOR and _furniture(n), alone)


def _line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def render(root: Node) -> str:
    out: list[str] = []
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                out.append(item.strip() + " " if item != "\n\0" else "\n")
        elif re.fullmatch("h[1-6]", item.tag):
            if text := _line(item.text()):
                out.append(f"\n{'#' * int(item.tag[1])} {text}\n")
        elif item.tag == "a":
            text, href = _line(item.text()), item.attrs.get("href", "").strip()
            if href.startswith("mailto:") or "linkedin.com/" in href.lower():
                out.append(f" [{text}]({href}) ")
            elif text:
                out.append(f" {text} ")
        else:
            if item.tag in BLOCKS:
                stack.append("\n\0")
            stack.extend(reversed(item.parts))
    text = re.sub(r"[ \t]+", " ", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(" ?\n ?", "\n", text)).strip()


def markdown_of(page: str | None) -> str:
    root = parse(page or "")
    if root is None:
        return ""
    strip_tree(root)
    return render(root)


def links_of(root: Node | None) -> list[str]:
    return [n.attrs["href"].strip() for n in root.walk() if n.tag == "a" and "href" in n.attrs] if root else []


def title_of(root: Node | None) -> str | None:
    return next((n.text().strip() for n in root.walk() if n.tag == "title"), None) if root else None


#: As objects, since workers that import this module have no session to parse DDL.
PARSED = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType())), T.StructField("title", T.StringType())])
LINKS = T.ArrayType(T.StringType())
HITS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "snippet")]))


def parsed(page: str | None) -> tuple[str, list[str], str | None]:
    """Markdown, links and title of a page."""
    root = parse(page or "")
    hrefs, title = links_of(root), title_of(root)
    if root is not None:
        strip_tree(root)
    return "" if root is None else render(root), hrefs, title


@F.arrow_udf(PARSED)
def parse_page(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return by_piece(pages, to_arrow_type(PARSED), parsed)


def absolute(base: str | None, hrefs: list[str] | None) -> list[str]:
    out = []
    for href in hrefs if hrefs is not None else ():
        if href and not href.startswith(("#", "mailto:", "tel:", "javascript:")):
            try:
                out.append(urljoin(base, href))
            except ValueError:
                continue
    return out


@F.arrow_udf(LINKS)
def resolve_links(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Absolute links, less fragments and other schemes than pages have."""
    return by_piece(pages, to_arrow_type(LINKS), absolute)


def unwrap(href: str) -> str:
    href = f"https:{href}" if href.startswith("//") else href
    parsed = urlparse(href)
    if parsed.path.startswith(("/l/", "/url")):
        query = parse_qs(parsed.query)
        return next((query[k][0] for k in ("uddg", "url", "u", "q") if query.get(k)), href)
    return href


def hits_of(page: str | None) -> list[dict[str, str]]:
    root, out, seen = parse(page or ""), [], set()
    if root is None:
        return out
    above = {id(c): n for n in root.walk() for c in n.parts if isinstance(c, Node)}
    spaced = lambda n: _line(" ".join(p if isinstance(p, str) else p.text() for p in n.parts))
    for link in root.walk():
        href = unwrap(link.attrs.get("href", "")) if link.tag == "a" else ""
        if "linkedin.com/" not in href.lower() or href in seen:
            continue
        seen.add(href)
        title, snippet, node = spaced(link), "", above.get(id(link))
        for _ in range(4):
            if node is None:
                break
            text = spaced(node)
            if len(text) > len(title) + 20:
                snippet = text[:600]
                break
            node = above.get(id(node))
        out.append({"title": title, "url": href, "snippet": snippet})
    return out


@F.arrow_udf(HITS)
def search_hits(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Profile links of saved result pages, each with the nearest ancestor text that says more than the link."""
    return by_piece(pages, to_arrow_type(HITS), hits_of)


def title_fast(page: Column) -> Column:
    """The title by regular expression, for pages that need no tree."""
    return F.nullif(F.trim(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def hrefs_fast(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit('href="([^"]*)"'), F.lit(1))


def text_fast(page: Column) -> Column:
    """Text without scripts, styles, comments and tags, by regular expressions alone."""
    bare = F.regexp_replace(page, "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
