"""HTML pages as columns: a full parse in Arrow batches, and plain patterns for what they can express."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = "title string, text string, links array<struct<href string, anchor string>>, mailtos array<string>, forms array<string>"
_PAGE = pa.struct({"title": pa.string(), "text": pa.string(), "links": pa.list_(pa.struct({"href": pa.string(), "anchor": pa.string()})), "mailtos": pa.list_(pa.string()), "forms": pa.list_(pa.string())})
PAGES_AT_ONCE = 64
_SILENT = {"script", "style"}
LONGEST_TITLE = 300
# fixed values: tags that end a title that was never closed
_END_TITLE = ["body", "p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "a", "header", "nav", "main", "section"]


class _Reader(HTMLParser):
    """Collects what a page shows; one for each page.

    A title that holds markup or is longer than LONGEST_TITLE was never closed: it is no title, and that piece is text.
    A link counts once it is closed; of links within links the inner one does.
    """

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.silent, self.in_title = base, 0, False
        self.title = self.anchor = ""
        self.href: str | None = None
        self.chunks, self.links, self.mailtos, self.forms = [], [], [], []

    def absolute(self, target: str) -> str | None:
        try:
            full = urljoin(self.base, target)
        except ValueError:
            return None
        return full if full.startswith(("http://", "https://")) else None

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        else:
            self.in_title = self.in_title and tag not in _END_TITLE
            given = {k: (v or "").strip() for k, v in attrs}
            if tag == "form":
                action = given.get("action")
                target = self.absolute(action) if action else ""  # without one it posts to the page itself
                self.forms += [target] if target is not None else []
            elif tag == "a" and given.get("href"):
                self.enter(given["href"])

    def enter(self, href: str):
        if href.lower().startswith("mailto:"):
            address = href[7:].split("?", 1)[0].strip()
            self.mailtos += [address] if address else []
        else:
            self.href, self.anchor = href, ""

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.href is not None:
            full = self.absolute(self.href)
            self.links += [{"href": full, "anchor": " ".join(self.anchor.split())}] if full else []
            self.href = None

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_title:
            self.title += data
            if "<" not in self.title and len(self.title) <= LONGEST_TITLE:
                return
            self.title, self.in_title = "", False
        if data.strip():
            self.chunks.append(data.strip())
            self.anchor += data

    def page(self, html: str) -> dict:
        try:
            self.feed(html)
            self.close()
        except (ValueError, AssertionError):
            pass  # what was read before the fault stands
        return {"title": " ".join(self.title.split()) or None, "text": "\n".join(self.chunks), "links": self.links, "mailtos": self.mailtos, "forms": self.forms}


def parsed(urls: pa.Array, pages: pa.Array) -> pa.Array:
    """The pages of a batch as structs; links as Python objects take many times their bytes, so those of some pages are held at a time."""
    parts = [pa.array([], _PAGE)]
    for a in range(0, len(pages), PAGES_AT_ONCE):
        pair = zip(urls.slice(a, PAGES_AT_ONCE).to_pylist(), pages.slice(a, PAGES_AT_ONCE).to_pylist(), strict=True)
        parts.append(pa.array([_Reader(u or "").page(h or "") for u, h in pair], _PAGE))
    return pa.concat_arrays(parts)


def parse_page(url: Column, html: Column) -> Column:
    """The page as a struct: title, text (trimmed pieces by line), absolute http(s) links with anchors, mail addresses, form actions.

    Script and style are silent.  A NULL page is empty.
    """

    def parse(urls: pa.Array, pages: pa.Array) -> pa.Array:
        return parsed(urls, pages)

    return F.arrow_udf(parse, PAGE)(url, html)


def title_of(html: Column) -> Column:
    """The raw title by pattern, white space collapsed, entities kept."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def link_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r'(?i)<a\s[^>]*href="'))
