"""Breadth-first crawl of one wiki over a table of fetched articles, and which grabber a source goes to."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions import text, urls
from lexispark.sources.crawl import MAX_DEPTH, MAX_PAGES, fandom_links, grabber
from lexispark.storage import settled

MARK = "/wiki/"
#: What stays as it is in an article's path, though a form encoder escapes it; ``*`` is the other way round.
_PLAIN = {"%2F": "/", "%3A": ":", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def title_key(title: Column) -> Column:
    """Titles that differ in case, underscores and outer blanks only are one."""
    return F.lower(F.trim(F.replace(title, F.lit("_"), F.lit(" "))))


def article_path(title: Column) -> Column:
    out = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("*"), F.lit("%2A"))
    for escaped, plain in _PLAIN.items():
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def route(source_type: Column, uri: Column) -> Column:
    """struct<grabber, error>: file, git, site or fandom; an error for other types, web sources without a usable URL and
    wiki URLs that name no article."""
    web = source_type == "web"

    def of(url: Column) -> Column:
        titled = F.regexp_extract(urls.parts(url)["path"], f"{MARK}(.+)$", 1) != ""
        return text.let(grabber(url), lambda kind: F.struct(
            F.when(url.isNull(), "invalid URL").when((kind == "fandom") & ~titled, "no wiki article").alias("error"), kind.alias("kind")
        ))

    def said(error: Column, kind: Column) -> Column:
        return F.struct(F.when(error.isNull(), kind).alias("grabber"), error.alias("error"))

    blank = F.coalesce(F.trim(uri) == "", F.lit(True))
    known = F.coalesce(source_type.isin("file", "git", "web"), F.lit(False))
    none = F.lit(None).cast("string")
    found = text.let(text.let(urls.normalize_crawl_url(uri), of), lambda r: said(r["error"], r["kind"]))
    return F.when(~known, said(F.lit("unsupported source type"), none)).when(web & blank, said(F.lit("no URL"), none)).when(web, found).otherwise(said(none, source_type))


def crawl_wiki(articles: DataFrame, root: str, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """place, name, url, parent, depth, is_root of the articles that a breadth-first crawl from ``root`` takes, in order.

    ``articles(title, resolved, html)`` holds what the wiki answered for each asked title; resolved (null: as asked) is the
    title after redirects, null or empty html a failure. Titles are asked once each, by ``title_key``, in the order in
    which they are first linked to. Failures are skipped, but for the root's. Of rows that repeat a title the smallest
    counts. Limits are clamped to 1 page and depth 0 at least; the last rows of a level are cut at ``max_pages``.
    """
    parts = urlsplit(root)
    prefix, found, name = parts.path.partition(MARK)
    if not found or not unquote(name):
        raise ValueError(f"{root} names no wiki article")
    base = f"{parts.scheme}://{(parts.hostname or '').lower()}{prefix}{MARK}"
    max_pages, max_depth = max(1, int(max_pages)), max(0, int(max_depth))
    asked = F.trim(F.replace(F.col("title"), F.lit("_"), F.lit(" ")))
    resolved = F.coalesce(F.nullif(F.col("resolved"), F.lit("")), asked)
    fetched = articles.filter(F.length("html") > 0).select(title_key(F.col("title")).alias("key"), resolved.alias("name"), "html")
    spark = articles.sparkSession
    frontier = spark.range(1).select(title_key(F.lit(unquote(name))).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("parent_place"), F.lit(0).alias("link_place"))
    visited, taken, n = frontier.select("key"), None, 0
    order = ["parent_place", "link_place"]
    for depth in range(max_depth + 1):
        got = fetched.join(frontier, "key").groupBy("key", "parent", *order).agg(F.min(F.struct("name", "html")).alias("p")).select("parent", *order, "p.*")
        # The window numbers what is left of max_pages at most.
        first = got.orderBy(*order).limit(max_pages - n).withColumn("place", F.row_number().over(Window.orderBy(*order)) + F.lit(n))
        level = settled(first.select("place", "name", F.concat(F.lit(base), article_path(F.col("name"))).alias("url"), "parent", F.lit(depth).alias("depth"), "html"))
        new = level.count()
        if not depth and not new:
            raise ValueError(f"the root {root} could not be fetched")
        rows = level.select("place", "name", "url", "parent", "depth", (F.col("depth") == 0).alias("is_root"))
        taken = rows if taken is None else taken.unionByName(rows)
        n += new
        if not new or n >= max_pages or depth == max_depth:
            break
        linked = fandom_links(level.select(F.col("place").alias("page_id"), "url", "html"), f"{prefix}{MARK}")
        linked = linked.groupBy(title_key(F.col("title")).alias("key")).agg(F.min(F.struct(F.col("page_id").alias("parent_place"), F.col("place").alias("link_place"))).alias("at"))
        parents = level.select(F.col("place").alias("parent_place"), F.col("url").alias("parent"))
        frontier = settled(linked.join(visited, "key", "left_anti").select("key", "at.*").join(parents, "parent_place").select("key", "parent", *order))
        visited = visited.unionByName(frontier.select("key"))
    return taken
