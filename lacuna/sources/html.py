"""Poems in the HTML of a poem site. What a page says is data, never instructions.

A page is read once as a tree: a heading with the id of a poem holds its title, dynasty and author, a block with the same id
holds its lines, and an element ends where its own closing tag stands, so poems of any length come whole. Pages are parsed in
Arrow batches by the parser of the standard library, which takes broken markup as it comes.

Cases: a null or empty page has no poem; a heading without a block is a poem without lines, a block without a heading is none;
of two blocks with one id the first counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ids and classes of the pages, words of a result page, and where relative links lead.
HEADING, BLOCK = "poem_title_", "poem_content_"
DYNASTY, LINE = "inlineComment1", "poemSentence"
RESULT_PAGE = ("poem_title_", "poemContent", "没有找到", "沒有找到")
SITE, FIRST_HITS = "https://sou-yun.cn", 8

ENTITIES = {"nbsp": " ", "amp": "&"}
WITHOUT_END = frozenset("area base br col embed hr img input link meta source track wbr".split())
POEM = "place int, id string, title string, author string, dynasty string, lines array<string>, url string"


def _clean(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


class _Tree(HTMLParser):
    """Headings and blocks by id. Each open element has a role and the list that its text goes to, if any."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.headings: list[dict] = []
        self.blocks: dict[str, list[list[str]]] = {}
        self.open: list[tuple[str, str, list[str] | None]] = []
        self.heading: dict | None = None

    def inside(self, role: str) -> bool:
        return any(r == role for _, r, _ in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in WITHOUT_END:
            return
        has = {k: v or "" for k, v in attrs}
        name, kinds, link = has.get("id", ""), has.get("class", "").split(), has.get("href", "")
        role, text = "", self.open[-1][2] if self.open else None
        if tag == "div":
            text = None
            if name.startswith(HEADING) and name[len(HEADING) :].isdigit():
                role = "heading"
                self.heading = {"id": name[len(HEADING) :], "url": None, "title": [], "dynasty": [], "author": []}
                self.headings.append(self.heading)
            elif name.startswith(BLOCK):
                role = "block" if name[len(BLOCK) :] not in self.blocks else ""
                self.blocks.setdefault(name[len(BLOCK) :], [])
            elif LINE in kinds and self.inside("block"):
                role, text = "line", []
                next(reversed(self.blocks.values())).append(text)
        elif self.heading is not None and self.inside("heading"):
            if tag == "a" and self.heading["url"] is None and link:
                role, text = "title", self.heading["title"]
                self.heading["url"] = link
            elif tag == "a" and link.startswith("javascript:") and not self.heading["author"]:
                role, text = "author", self.heading["author"]
            elif tag == "span" and DYNASTY in kinds and not self.heading["dynasty"]:
                role, text = "dynasty", self.heading["dynasty"]
        self.open.append((tag, role, text))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open):
            while self.open.pop()[0] != tag:
                continue

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2] is not None:
            self.open[-1][2].append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(ENTITIES.get(name, f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def parsed(html: str | None) -> list[dict]:
    """The poems of a page in order; one has a title or lines."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    out = []
    for place, head in enumerate(tree.headings):
        lines = [x for x in map(_clean, tree.blocks.get(head["id"], [])) if x]
        title, url = _clean(head["title"]), head["url"] or ""
        if head["url"] is not None and (title or lines):
            dynasty = re.sub(r"·\s*$", "", _clean(head["dynasty"])).strip()
            out.append({"place": place, "id": head["id"], "title": title, "author": _clean(head["author"]) or None, "dynasty": dynasty or None, "lines": lines, "url": url if url.startswith("http") else SITE + url})
    return out


def poems(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) to (page_id, place, id, title, author, dynasty, lines, url); a poem has a title or lines."""
    fields = T.StructType.fromDDL(POEM)
    schema = T.StructType([pages.schema["page_id"], *fields.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": p, **poem} for p, html in zip(batch["page_id"], batch["html"]) for poem in parsed(html)]
            yield pd.DataFrame(rows, columns=schema.names)

    return pages.select("page_id", "html").mapInPandas(run, schema)


def outcomes(pages: DataFrame) -> DataFrame:
    """(page_id, status, n): a page without a poem that doesn't look like a result page is an error, not "none"."""
    counted = poems(pages).groupBy("page_id").agg(F.count("*").alias("n"))
    known = F.coalesce(F.col("html"), F.lit("")).rlike("|".join(RESULT_PAGE))
    met = pages.join(counted, "page_id", "left")
    return met.select("page_id", F.when(F.col("n") > 0, "has_result").when(known, "no_result").otherwise("error").alias("status"), F.least(F.coalesce("n", F.lit(0)), F.lit(FIRST_HITS)).alias("n"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href) of every link of a page."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("place", "href"))
