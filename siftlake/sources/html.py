"""Documents fetched as bytes: charset, HTML structure, links, and the page rows made of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

#: Headings and links that a page keeps, letters of a link's context, and letters from which a main part is taken for the page.
HEADINGS, LINKS, CONTEXT, MAIN = 60, 300, 500, 400

# Elements that hold no text of the page, that begin a line, that are navigation, and that hold the main part.
SILENT = frozenset("script style noscript template svg iframe head".split())
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article main header footer nav aside ul ol table dl dt dd form fieldset blockquote pre hr figure option".split())
ASIDE = frozenset("nav aside footer".split())
MAINS = frozenset("main article".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NAVIGATION = re.compile(r"\b(?:nav|menu|breadcrumb|sidebar|footer|cookie|share|social)", re.I)


def decode(data: bytes | None, content_type: str | None = None) -> str:
    """Bytes as text: by the header's charset, as UTF-8, as Windows-1252, or else without what is none of these. Null is empty."""
    data = data or b""
    m = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I)
    for name in (m[1] if m else "", "utf-8", "cp1252"):
        try:
            return data.decode(name) if name else data.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "ignore")


class Document(HTMLParser):
    """What a page of HTML holds: title, description, headings, links with the row around them, and its text line by line.

    Text within navigation is left out, and if a main part has letters enough it alone is the text.
    """

    def __init__(self, source: str, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.description = base, "", ""
        self.headings: list[str] = []
        self.links: list[tuple[str, str, str]] = []
        self._open: list[tuple[str, bool, bool]] = []
        self._lines: list[tuple[list[str], bool]] = [([], False)]
        self._head: list[str] | None = None
        self._anchor: tuple[str, list[str], int] | None = None
        self._in_title = False
        self.feed(source)
        self.close()
        rows = [(" ".join("".join(x).split()).strip(" |"), main) for x, main in self._lines]
        main = [x for x, m in rows if m and x]
        kept = main if sum(map(len, main)) > MAIN else [x for x, _ in rows if x]
        self.text = "\n".join(x for i, x in enumerate(kept) if not i or x != kept[i - 1])
        self.links = [(u, t, " ".join("".join(self._lines[at][0]).split())[:CONTEXT]) for u, t, at in self.links][:LINKS]

    def _state(self) -> tuple[bool, bool]:
        return any(s for _, s, _ in self._open), any(m for _, _, m in self._open)

    def _line(self) -> None:
        if self._lines[-1][0]:
            self._lines.append(([], self._state()[1]))

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "title":
            self._in_title = True
        elif tag == "meta" and attrs.get("name", "").lower() == "description":
            self.description = " ".join(attrs.get("content", "").split())
        if tag in BLOCKS:
            self._line()
        if tag not in _VOID:
            quiet = tag in SILENT or tag in ASIDE or bool(_NAVIGATION.search(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"))
            self._open.append((tag, quiet, tag in MAINS or attrs.get("role") == "main"))
            if self._lines[-1][0] == []:
                self._lines[-1] = ([], self._state()[1])
        if tag in ("h1", "h2", "h3", "h4"):
            self._head = []
        if tag == "a" and attrs.get("href"):
            self._anchor = (urljoin(self.base, attrs["href"].strip()), [], len(self._lines) - 1)

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        if tag in ("h1", "h2", "h3", "h4") and self._head is not None:
            if (h := " ".join("".join(self._head).split())) and len(self.headings) < HEADINGS:
                self.headings.append(h)
            self._head = None
        if tag == "a" and self._anchor:
            url, words, at = self._anchor
            self.links.append((url, " ".join("".join(words).split()), at))
            self._anchor = None
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                del self._open[k:]
                break
        if tag in BLOCKS:
            self._line()

    def handle_data(self, data):
        if self._in_title:
            self.title = " ".join((self.title + " " + data).split())
            return
        if self._anchor:
            self._anchor[1].append(data)
        if not self._state()[0]:
            self._lines[-1][0].append(data)
            if self._head is not None:
                self._head.append(data)


_PAGE = "url string, title string, description string, headings array<string>, links array<struct<url:string,text:string,context:string>>, text string"


def html_pages(files: DataFrame) -> DataFrame:
    """url, title, description, headings, links, text of fetched documents (url, content binary, content_type): one pass without a shuffle.

    Null content gives an empty page; broken HTML is read as far as it goes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, data, kind in zip(pdf["url"], pdf["content"], pdf["content_type"]):
                d = Document(decode(data, kind), url or "")
                rows.append((url, d.title, d.description, d.headings, [{"url": u, "text": t, "context": c} for u, t, c in d.links], d.text))
            yield pd.DataFrame(rows, columns=["url", "title", "description", "headings", "links", "text"])

    return files.select("url", "content", "content_type").mapInPandas(run, _PAGE)
