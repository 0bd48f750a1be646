"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed host list and query parameters.
GIT_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")


def parts(url: Column) -> dict[str, Column]:
    u = F.trim(url)
    u = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    scheme = F.lower(F.regexp_extract(u, "^([^:]+)://", 1))
    authority = F.regexp_extract(u, "^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    host = F.regexp_replace(host, F.when(scheme == "https", F.lit(":443$")).otherwise(F.lit(":80$")), F.lit(""))
    return {"scheme": scheme, "host": host, "path": F.regexp_extract(u, "^[^:]+://[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)}


def _plain(code: Column) -> Column:
    """A form-encoded name or value as text; percent signs that begin no code stay."""
    return F.url_decode(F.regexp_replace(code, "%(?![0-9A-Fa-f]{2})", "%25"))


def _code(plain: Column) -> Column:
    """Form-encoded: everything but letters, digits, ``_.-~`` and blanks (``+``) as percent codes."""
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(query: Column) -> Column:
    """array<struct<k,v>>: decoded names and values of a query, in order; a name without ``=`` has an empty value."""
    each = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(_plain(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), _plain(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")))


def _join(p: dict[str, Column], path: Column, items: Column) -> Column:
    query = F.array_join(F.transform(F.array_sort(items), lambda x: F.concat(_code(x["k"]), F.lit("="), _code(x["v"]))), "&")
    return F.when(p["scheme"].isin("http", "https") & ~p["host"].rlike("^(:|$)"), F.concat(p["scheme"], F.lit("://"), p["host"], path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def normalize_source_url(url: Column) -> Column:
    """Null for schemes other than http and https; no fragment, userinfo or default port; one slash for several, none at
    the end of a path but the root's; the query decoded, sorted and encoded again."""
    p = parts(url)
    path = F.regexp_replace(F.regexp_replace(p["path"], "/{2,}", "/"), "(?<=.)/+$", "")
    return _join(p, path, pairs(p["query"]))


def normalize_crawl_url(url: Column) -> Column:
    """As above for crawled pages: the empty path is ``/``, slashes stay, tracking parameters go."""
    p = parts(url)
    path = F.when(p["path"].isin("", "/"), "/").otherwise(F.regexp_replace(p["path"], "/+$", ""))
    tracked = F.array(*[F.lit(t) for t in TRACKING])
    return _join(p, path, F.filter(pairs(p["query"]), lambda x: ~F.array_contains(tracked, F.lower(x["k"]))))


def resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    dots = F.element_at(segments, -1).isin(".", "..")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(x == ".", acc).when(x == "..", up).otherwise(F.array_append(acc, x))

    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(dots, F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(path)


def absolute(base: dict[str, Column], href: Column) -> Column:
    """A link as a whole URL, by the parts of the page that it stands on."""
    origin = F.concat(base["scheme"], F.lit("://"), base["host"])
    folder = F.regexp_replace(base["path"], "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    rest = F.regexp_extract(href, "([?#].*)?$", 1)
    path = F.regexp_extract(href, "^([^?#]*)", 1)
    rooted = F.when(path.startswith("/"), path).when(path == "", base["path"]).otherwise(F.concat(folder, path))
    whole = F.concat(origin, resolved(rooted), rest)
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href)).otherwise(whole)


def file_name(url: Column) -> Column:
    """Last part of the path with its percent codes resolved, else the host, else ``web-document``."""
    p = parts(url)
    last = F.element_at(F.split(F.regexp_replace(p["path"], "/+$", ""), "/"), -1)
    plain = F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    host = F.regexp_replace(p["host"], r":\d+$", "")
    return F.coalesce(F.nullif(F.coalesce(plain, last), F.lit("")), F.nullif(host, F.lit("")), F.lit("web-document"))


def source_type(url: Column) -> Column:
    p = parts(url)
    segments = F.size(F.filter(F.split(p["path"], "/"), lambda x: x != ""))
    return F.when(p["path"].endswith(".git"), "git").when(p["host"].isin(*GIT_HOSTS) & (segments >= 2), "git").otherwise("web")


def display_name(url: Column) -> Column:
    p = parts(url)
    segments = F.filter(F.split(p["path"], "/"), lambda x: x != "")
    plain = F.when(F.size(segments) > 0, F.concat(p["host"], F.lit("/"), F.array_join(F.slice(segments, 1, 2), "/"))).otherwise(p["host"])
    git = F.regexp_replace(F.array_join(F.slice(segments, 1, 2), "/"), r"\.git$", "")
    return F.when((source_type(url) == "git") & (F.size(segments) >= 2), git).otherwise(plain)
