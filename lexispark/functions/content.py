"""The main content of a page: blocks of its tree, told apart from navigation and remarks by text and link density."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexispark.functions.documents import plain_html

#: Elements without an end, elements that are never content, and elements that begin a block of their own.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
NEVER = frozenset(("script", "style", "noscript", "template", "svg", "nav", "footer", "aside", "form", "button", "select", "head", "iframe"))
BLOCKS = frozenset(("p", "div", "section", "article", "main", "header", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "body", "td"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: In an element's class or id: what readers say, and what stands around a text.
ASIDE = re.compile(r"(^|[-_ ])(comment|comments|disqus|sidebar|breadcrumb|breadcrumbs|related|share|social|cookie|banner|promo|advert|ads?|menu|pagination|newsletter)([-_ ]|$)", re.I)
#: A block with more than this part of its characters in links is no content.
LINKS = 0.33
#: Words of a block that is content by itself, and of one that is content between two others.
WORDS, BETWEEN = 12, 4
#: Words that the content of a page has at least.
LEAST = 25


@dataclass
class Block:
    tag: str
    inside: bool  # of main or article
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.parts).split())


class Tree(HTMLParser):
    """Reads a page into blocks; what is in an element of NEVER, or of an ASIDE class, goes to none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, whether it is left out, whether it is in main or article
        self.blocks: list[Block] = []
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br" and self.blocks:
                self.blocks[-1].parts.append(" ")
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)  # their ends may be left out
        _, out, inside = self.open[-1] if self.open else ("", False, False)
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        # A header around headings of a text stays; one of the whole page goes.
        head = tag == "header" and not inside
        out = out or tag in NEVER or head or (bool(ASIDE.search(named)) and tag not in ("body", "html", "main", "article"))
        self.open.append((tag, out, inside or tag in ("main", "article")))
        self.links += tag == "a"
        if tag in BLOCKS and not out:
            self.blocks.append(Block(tag, self.open[-1][2]))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, out, _ = self.open.pop()
            self.links -= t == "a"
            if t in BLOCKS and not out and self.open:
                # What follows belongs to the element around.
                around = next((x for x in reversed(self.open) if x[0] in BLOCKS), self.open[-1])
                self.blocks.append(Block(around[0], self.open[-1][2]))
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        if not self.blocks:
            self.blocks.append(Block("body", False))
        block = self.blocks[-1]
        block.parts.append(data)
        if self.links > 0:
            block.linked += len("".join(data.split()))


def main_blocks(page: str) -> list[Block]:
    """Blocks of the main content: dense ones, shorter ones between two of them or in one row of a table, and headings right
    before one. If main or article elements hold enough of it, only theirs."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    blocks = [b for b in tree.blocks if b.text]
    words = [len(b.text.split()) for b in blocks]
    few_links = [b.linked <= LINKS * len("".join(b.text.split())) for b in blocks]
    dense = [few and n >= (BETWEEN if b.tag in ("td", "th") else WORDS) and b.tag not in HEADINGS for b, n, few in zip(blocks, words, few_links, strict=True)]
    kept = list(dense)
    last = -1
    for k, is_dense in enumerate(dense):
        if not is_dense:
            continue
        gap = range(last + 1, k)
        # At most three short blocks with few links, none of them a heading, between two dense ones are part of the text.
        if last >= 0 and len(gap) <= 3 and all(few_links[g] and words[g] >= BETWEEN and blocks[g].tag not in HEADINGS for g in gap):
            for g in gap:
                kept[g] = True
        h = k - 1
        while h >= 0 and blocks[h].tag in HEADINGS and few_links[h]:
            kept[h] = True
            h -= 1
        last = k
    chosen = [(b, n) for b, n, k in zip(blocks, words, kept, strict=True) if k]
    inside = [(b, n) for b, n in chosen if b.inside]
    if sum(n for _, n in inside) >= LEAST:
        chosen = inside
    return [b for b, _ in chosen] if sum(n for _, n in chosen) >= LEAST else []


def main_content(page: str | None) -> str | None:
    """Blocks of the main content by lines; where nothing is dense enough, all text (``plain_html``)."""
    if page is None:
        return None
    found = main_blocks(page)
    return "\n".join(b.text for b in found) if found else plain_html(page)


@F.pandas_udf(StringType())
def main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_content)
