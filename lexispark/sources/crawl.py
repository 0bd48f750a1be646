"""Crawl over a table of fetched pages: admission of links and breadth-first search. Fetching is left to an adapter."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from lexispark.functions import classify, urls
from lexispark.storage import settled

# Paths, wiki name spaces and query keys that are not followed.
IGNORED_PARTS = ("login", "logout", "signin", "signup", "register", "search", "account", "profile", "settings", "privacy", "terms", "feed", "feedback", "sandbox")
WIKI_PREFIXES = (
    "Category:", "Special:", "Talk:", "User:", "User_talk:", "Template:", "File:", "Help:", "Wikipedia:",
    "Категория:", "Служебная:", "Обсуждение:", "Участник:", "Шаблон:", "Файл:", "Справка:", "Википедия:", "Проект:",
)
FANDOM_PREFIXES = (
    "File:", "Category:", "Template:", "User:", "User_talk:", "Talk:", "Special:", "Forum:", "Message_Wall:", "MediaWiki:", "Help:", "Thread:", "Blog:",
    "Файл:", "Категория:", "Шаблон:", "Участник:", "Обсуждение:", "Служебная:",
)
WIKI_KEYS = ("action", "diff", "oldid", "redlink")
SCHEMES_SKIPPED = ("#", "mailto:", "tel:", "javascript:", "data:")
MAX_PAGES, MAX_DEPTH = 60, 2


def ignored_path(url: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(urls.parts(url)["path"]), "/"), F.array(*map(F.lit, IGNORED_PARTS)))


def _prefixed(title: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p.lower()) for p in prefixes]), lambda p: F.startswith(F.lower(title), p))


def ignored_wiki(url: Column) -> Column:
    p = urls.parts(url)
    keys = F.transform(F.split(p["query"], "&"), lambda x: F.lower(F.split_part(x, F.lit("="), F.lit(1))))
    title = F.try_url_decode(F.regexp_extract(p["path"], "/wiki/(.*)$", 1))
    return p["host"].rlike(r"(^|\.)wikipedia\.org$") & (F.arrays_overlap(keys, F.array(*map(F.lit, WIKI_KEYS))) | _prefixed(F.coalesce(title, F.lit("")), WIKI_PREFIXES))


def ignored_fandom(title: Column) -> Column:
    return _prefixed(F.replace(title, F.lit(" "), F.lit("_")), FANDOM_PREFIXES)


#: Where links are taken from: the first of these that a page has (``role``: an element of role main), else all of it.
CONTENT = ("main", "article", "role", "body")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Links(HTMLParser):
    """Links of the first element of each kind, and of the whole page (the kind '')."""

    def __init__(self, kinds: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {"": []}
        self.kinds, self.inside, self.open = kinds, {""}, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(reversed(attrs))  # of repeated attributes the first counts
        begun = [k for k in self.kinds if k not in self.found and (tag == k or (k == "role" and values.get("role") == "main"))]
        for kind in begun:
            self.found[kind] = []
        if tag not in _VOID:
            self.open.append((tag, begun))
            self.inside.update(begun)
        if tag == "a" and values.get("href") is not None:
            for kind in self.inside:
                self.found[kind].append(values["href"].strip())

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                t, begun = self.open.pop()
                self.inside.difference_update(begun)
                if t == tag:
                    return


def hrefs_within(page: str | None, kinds: tuple[str, ...]) -> list[str] | None:
    if page is None:
        return None
    parser = _Links(kinds)
    parser.feed(page)
    parser.close()
    return parser.found[next((k for k in kinds if k in parser.found), "")]


def hrefs(page: Column, within: tuple[str, ...] = ()) -> Column:
    """Links of a page as they are written, in order, of the first element of ``within`` that it has, else of all of it."""

    @F.pandas_udf(ArrayType(StringType()))
    def found(pages: pd.Series) -> pd.Series:
        return pd.Series([hrefs_within(p, within) for p in pages], dtype=object)

    return found(page)


def links(url: Column, page: Column, within: tuple[str, ...] = CONTENT) -> Column:
    """Sorted distinct URLs of the same host that a page links to and that are followed."""
    base = urls.parts(url)
    wanted = F.filter(hrefs(page, within), lambda h: (h != "") & ~F.exists(F.array(*map(F.lit, SCHEMES_SKIPPED)), lambda s: F.startswith(h, s)))
    full = F.transform(wanted, lambda h: urls.normalize_crawl_url(urls.absolute(base, h)))

    def followed(u: Column) -> Column:
        kind = classify.suffix(urls.parts(u)["path"])
        return u.isNotNull() & (urls.parts(u)["host"] == base["host"]) & ~ignored_path(u) & ~ignored_wiki(u) & kind.isin(*classify.CRAWLED_EXTENSIONS)

    return F.array_sort(F.array_distinct(F.filter(full, followed)))


def fandom_links(pages: DataFrame, prefix: str = "/wiki/") -> DataFrame:
    """page_id, place, title, url of the wiki pages that ``pages(page_id, url, html)`` link to: titles that differ in case
    and underscores only are one, at the place of its first link and with the title and URL of its last."""
    base = urls.parts(F.col("url"))
    found = pages.select("page_id", base["host"].alias("host"), F.posexplode(F.transform(hrefs(F.col("html")), lambda h: urls.absolute(base, h))).alias("at", "link"))
    p = urls.parts(F.col("link"))
    found = found.filter((F.col("link") != "") & (p["host"] == F.col("host")) & p["path"].startswith(prefix))
    raw = F.substring(p["path"], len(prefix) + 1, 1 << 20)
    title = F.trim(F.replace(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw), F.lit("_"), F.lit(" ")))
    found = found.select("page_id", "at", title.alias("title"), F.concat(p["scheme"], F.lit("://"), F.col("host"), p["path"]).alias("url"), raw.alias("raw"))
    found = found.filter((F.col("raw") != "") & ~ignored_fandom(F.col("title")))
    last = F.max_by(F.struct("title", "url"), "at")
    return found.groupBy("page_id", F.lower("title").alias("key")).agg(F.min("at").alias("place"), last.alias("last")).select("page_id", "place", "last.title", "last.url")


def grabber(url: Column) -> Column:
    """Which crawl a web source takes: ``fandom`` for wikis of that host, else ``site``."""
    host = F.regexp_replace(urls.parts(url)["host"], r":\d+$", "")
    return F.when(host.endswith(".fandom.com"), "fandom").otherwise("site")


def crawl(edges: DataFrame, roots: DataFrame, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """page, depth of the first ``max_pages`` pages by (depth, page) within ``max_depth`` links of ``roots(page)``.

    ``edges(source, target)``. One join and one anti join for each level, up to the level that fills ``max_pages``.
    Limits are clamped to 1 page and depth 0 at least.
    """
    max_pages, max_depth = max(1, int(max_pages)), max(0, int(max_depth))
    frontier = seen = roots.select("page", F.lit(0).alias("depth")).distinct()
    n = 0
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select(F.col("page").alias("source")), "source").select(F.col("target").alias("page")).distinct()
        frontier = settled(reached.join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)))
        new = frontier.count()
        n, seen = n + new, seen.unionByName(frontier)
        if not new or n >= max_pages:
            break
    return seen.orderBy("depth", "page").limit(max_pages)


def crawl_site(pages: DataFrame, root: str, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """url, depth, parent, mime_type of the documents that a breadth-first crawl from ``root`` takes.

    ``pages(url, final_url, mime_type, html)`` holds what was fetched; final_url (null: none) is where a redirect ended,
    a page with null html failed. A page is visited once by its own and by its final URL; HTML pages are expanded, other
    supported files taken only. A root that failed is an error; other failures are skipped. Of several parents of one
    level the smallest URL counts; within a level documents are in order of their URLs.
    """
    max_pages, max_depth = max(1, int(max_pages)), max(0, int(max_depth))
    at = lambda c: urls.normalize_crawl_url(F.col(c))
    kind = classify.suffix(urls.parts(F.col("url"))["path"])
    html = classify.is_html(F.col("mime_type"), kind)
    fetched = pages.filter(F.col("html").isNotNull() & (html | classify.is_crawled(F.col("mime_type"), kind)))
    fetched = fetched.select(at("url").alias("asked"), F.coalesce(at("final_url"), at("url")).alias("url"), "mime_type", html.alias("is_html"), "html")
    spark = pages.sparkSession
    frontier = spark.range(1).select(urls.normalize_crawl_url(F.lit(root)).alias("asked"), F.lit(None).cast("string").alias("parent"))
    visited, taken, n = frontier.select("asked"), None, 0
    for depth in range(max_depth + 1):
        got = fetched.join(frontier, "asked").groupBy("url").agg(F.min(F.struct("parent", "mime_type", "is_html", "html")).alias("p")).select("url", "p.*")
        if taken is not None:
            got = got.join(taken.select("url"), "url", "left_anti")
        level = settled(got.withColumn("depth", F.lit(depth)))
        new = level.count()
        if not depth and not new:
            raise ValueError(f"the root {root} could not be fetched")
        rows = level.select("url", "depth", "parent", "mime_type")
        taken = rows if taken is None else taken.unionByName(rows)
        n += new
        if not new or n >= max_pages or depth == max_depth:
            break
        found = level.filter("is_html").select(F.col("url").alias("parent"), F.explode(links(F.col("url"), F.col("html"))).alias("asked"))
        visited = visited.unionByName(level.select(F.col("url").alias("asked")))
        frontier = settled(found.groupBy("asked").agg(F.min("parent").alias("parent")).join(visited, "asked", "left_anti"))
        visited = visited.unionByName(frontier.select("asked"))
    return taken.orderBy("depth", "url").limit(max_pages)


def search_hits(results: DataFrame, most: int = 5) -> DataFrame:
    """query_id, rank, url, title, snippet of ``results(query_id, position, url, title, snippet)`` of a web search: empty
    and other than http(s) URLs go, fragments too, the first of equal URLs stays, a missing title is the host's name.
    ``most`` is clamped to 1..20."""
    most = min(20, max(1, int(most)))
    url = F.trim(F.coalesce("url", F.lit("")))
    plain = results.withColumn("url", F.regexp_replace(url, "#.*$", "")).filter(F.col("url").rlike("^(?i)https?:"))
    first = Window.partitionBy("query_id", "url").orderBy("position")
    once = plain.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    host = F.nullif(F.regexp_replace(urls.parts(F.col("url"))["host"], r":\d+$", ""), F.lit(""))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), host, F.lit("Internet source"))
    order = Window.partitionBy("query_id").orderBy("position")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "url", title.alias("title"), F.trim(F.coalesce("snippet", F.lit(""))).alias("snippet"))


# Fixed patterns: what a request to search begins with, in two languages.
SEARCH_PREFIXES = (
    r"^\s*(?:пожалуйста\s+)?(?:поищи|найди|посмотри)(?:\s+тогда)?(?:\s+мне)?(?:\s+ответ)?(?:\s+в\s+интернете|\s+в\s+сети|\s+онлайн)?(?:\s+информацию)?(?:\s+про|\s+о|\s+об)?(?:\s+то)?[\s,:;-]*",
    r"^\s*(?:please\s+)?(?:search|find|look\s+up)(?:\s+the)?(?:\s+answer)?(?:\s+online|\s+on\s+the\s+web|\s+on\s+the\s+internet)?(?:\s+for|\s+about)?[\s,:;-]*",
)
QUERY_CHARS, DOMAIN_WORD = 240, "Frostpunk"


def web_query(question: Column, word: str = DOMAIN_WORD) -> Column:
    """A question as a search query: without its prefix, cut at a blank, with the domain's word in front."""
    q = F.trim(question)
    for p in SEARCH_PREFIXES:
        q = F.regexp_replace(q, f"(?iu){p}", "")
    q = F.btrim(F.regexp_replace(q, r"\s+", " "), F.lit(" ,.;:-"))
    q = F.when(q == "", F.trim(question)).otherwise(q)
    cut = F.substring(q, 1, QUERY_CHARS)
    at_blank = F.nullif(F.trim(F.regexp_replace(cut, " [^ ]*$", "")), F.lit(""))
    q = F.when(F.length(q) > QUERY_CHARS, F.coalesce(at_blank, q)).otherwise(q)
    return F.when(F.contains(F.lower(q), F.lit(word.lower())), q).otherwise(F.concat(F.lit(f"{word} "), q))
