"""Classification rules: file types, parsers, log lines, errors, domains, display values."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lexispark.functions import urls

WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
SLIDES = "application/vnd.openxmlformats-officedocument.presentationml.presentation"

# Leading bytes of file types, folders of Office archives, old Office types by extension, code pages tried.
MAGIC = ((b"%PDF-", "application/pdf", ".pdf"), (b"\x89PNG\r\n\x1a\n", "image/png", ".png"), (b"\xff\xd8\xff", "image/jpeg", ".jpg"), (b"GIF87a", "image/gif", ".gif"), (b"GIF89a", "image/gif", ".gif"))
OFFICE = (("word/", WORD, ".docx"), ("xl/", SHEET, ".xlsx"), ("ppt/", SLIDES, ".pptx"))
ZIP, OLE = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
OLD_OFFICE = {".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".ppt": "application/vnd.ms-powerpoint"}
SNIFFED_ENCODINGS = ("utf-8-sig", "utf-16", "cp1251", "latin-1")
BY_NAME = {".md": "text/markdown", ".markdown": "text/markdown", ".csv": "text/csv", ".xml": "application/xml"}
# Extensions and types that the text parser takes.
TEXT_EXTENSIONS = (".txt", ".md", ".markdown", ".rst", ".csv", ".json", ".xml", ".html", ".htm", ".yaml", ".yml", ".toml", ".ini", ".cfg")
CODE_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".vue", ".php", ".java", ".cs", ".c", ".cpp", ".cc", ".h", ".hpp", ".go", ".rs", ".rb", ".swift", ".kt", ".kts", ".sql",
    ".css", ".scss", ".sass", ".less", ".sh", ".ps1", ".bat",
)
TEXT_TYPES = ("text/plain", "text/markdown", "text/csv", "text/html", "text/yaml", "application/json", "application/xml", "text/xml")
# What a crawl takes.
CRAWLED_EXTENSIONS = ("", ".html", ".htm", ".txt", ".md", ".markdown", ".json", ".xml", ".csv", ".pdf", ".docx", ".pptx")
CRAWLED_TYPES = ("application/pdf", "text/plain", "text/markdown", "text/csv", "application/json", "application/xml", "text/xml", WORD, SLIDES)
BLOCKED_DOMAINS = ("steamcommunity.com",)
# Marks of log categories in the order they are tried; the rest is SYSTEM.
CATEGORIES = (
    ("RECON", ("internet", "[web]", "[fandom]")),
    ("ARCHIVE", ("index", "vector", "chunk")),
    ("EMBEDDING", ("embed",)),
    ("SEARCH", ("retriev",)),
    ("ANALYSIS", ("rerank",)),
    ("CORE", ("[llm]", "generation", "gemini", "groq")),
    ("CONSULTATION", ("chat", "advisor request", "consultation")),
    ("DATABASE", ("sql", "database", "persist")),
)
LOGGERS = ("src.", "advisor.")
CONSOLE_PREFIXES = ("[Indexing]", "[Vectorization]", "[Embeddings]", "[Retriever]", "[Reranker]", "[LLM]", "[Web]", "[Fandom]", "[Git]", "[OCR]")
# Marks of errors that are final and of those that may pass.
FINAL = ("400", "401", "403", "404", "422", "429", "access denied", "unauthorized", "forbidden", "invalid api key", "api key not valid", "rate limit", "too_many_requests", "quota exhausted", "quota exceeded")
PASSING = ("500", "502", "503", "504", "service_unavailable", "service unavailable", "high demand", "temporarily unavailable", "timeout", "timed out", "connection reset", "connection aborted", "connection refused")
STORE_PASSING = (
    "timed out", "timeout", "read timeout", "write timeout", "read operation timed out", "write operation timed out", "connection reset", "connection aborted", "connection refused",
    "temporarily unavailable", "service unavailable", "502", "503", "504", "429",
)
PRINTABLE_SHARE, PRINTABLE_SAMPLE, HTML_SAMPLE = 0.9, 5000, 2000


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return found


def suffix(path: Column) -> Column:
    """Extension of the last part of a path with its point, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def text_like(text: str) -> bool:
    sample = text[:PRINTABLE_SAMPLE]
    return bool(sample) and sum(c.isprintable() or c in "\r\n\t" for c in sample) >= PRINTABLE_SHARE * len(sample)


def json_like(text: str) -> bool:
    if text[:1] not in ("[", "{"):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def html_like(text: str) -> bool:
    head = text[:HTML_SAMPLE].lower()
    return "<!doctype html" in head or "<html" in head or ("<head" in head and "<body" in head)


def sniffed_text(data: bytes) -> str | None:
    """The bytes as text by the first code page that gives mostly printable characters; null where none does."""
    for name in SNIFFED_ENCODINGS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if text_like(text):
            return text
    return None


def _in_archive(data: bytes) -> tuple[str, str]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n.lower() for n in z.namelist()]
    except zipfile.BadZipFile:
        names = []
    return next(((mime, ext) for folder, mime, ext in OFFICE if any(n.startswith(folder) for n in names)), ("application/zip", ".zip"))


def sniff(data: bytes | None, name: str | None) -> tuple[str, str | None]:
    """Type and extension of a file by its bytes first, by its name where they say no more than text. Null: no bytes."""
    data, last = bytes(data or b""), (name or "").replace("\\", "/").rpartition("/")[2]
    stem, dot, ext = last.rpartition(".")
    own = f".{ext.lower()}" if dot and ext and stem else None
    for magic, mime, kind in MAGIC:
        if data.startswith(magic):
            return mime, kind
    if data.startswith(ZIP):
        return _in_archive(data)
    if data.startswith(OLE):
        return OLD_OFFICE.get(own, "application/x-ole-storage"), own
    text = sniffed_text(data)
    if text is None:
        return "application/octet-stream", own
    text = text.lstrip()
    if json_like(text):
        return "application/json", ".json"
    if html_like(text):
        return "text/html", ".html"
    return BY_NAME.get(own, "text/plain"), own or ".txt"


@F.pandas_udf(StructType().add("mime_type", StringType()).add("extension", StringType()))
def sniffed_type(contents: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sniff(c, n) for c, n in zip(contents, names)], columns=["mime_type", "extension"])


def parser_route(extension: Column, mime: Column) -> Column:
    """pdf, docx, pptx or text; null for types that have no parser."""
    e, m = F.lower(F.coalesce(extension, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    plain = e.isin(*TEXT_EXTENSIONS, *CODE_EXTENSIONS) | m.isin(*TEXT_TYPES) | m.startswith("text/")
    return F.when((e == ".pdf") | (m == "application/pdf"), "pdf").when((e == ".docx") | (m == WORD), "docx").when((e == ".pptx") | (m == SLIDES), "pptx").when(plain, "text")


def document_type(extension: Column, mime: Column) -> Column:
    """html, json, markdown, csv, xml, code or text, for what the text parser takes."""
    e, m = F.lower(F.coalesce(extension, F.lit(""))), F.coalesce(mime, F.lit("text/plain"))
    return (
        F.when((m == "text/html") | e.isin(".html", ".htm"), "html")
        .when((m == "application/json") | (e == ".json"), "json")
        .when(e.isin(".md", ".markdown"), "markdown")
        .when(e == ".csv", "csv")
        .when(e == ".xml", "xml")
        .when(e.isin(*CODE_EXTENSIONS), "code")
        .otherwise("text")
    )


def is_code(source_type: Column, kind: Column) -> Column:
    return F.coalesce((source_type == "git") & (kind == "code"), F.lit(False))


def is_html(mime: Column, extension: Column) -> Column:
    m = F.coalesce(mime, F.lit(""))
    return m.isin("text/html", "application/xhtml+xml") | (m.isin("", "application/octet-stream") & extension.isin("", ".html", ".htm"))


def is_crawled(mime: Column, extension: Column) -> Column:
    return extension.isin(*CRAWLED_EXTENSIONS) | F.coalesce(mime, F.lit("")).isin(*CRAWLED_TYPES)


def is_blocked(url: Column, domains: tuple[str, ...] = BLOCKED_DOMAINS) -> Column:
    host = F.regexp_replace(urls.parts(url)["host"], r":\d+$", "")
    found = F.lit(False)
    for d in domains:
        found = found | (host == d) | host.endswith(f".{d}")
    return F.coalesce(found, F.lit(False))


def log_category(logger: Column, message: Column) -> Column:
    value = F.lower(F.concat(logger, F.lit(" "), message))
    out = F.lit("SYSTEM")
    for name, marks in reversed(CATEGORIES):
        out = F.when(any_of(value, marks), name).otherwise(out)
    return out


def log_lines(logger: Column, message: Column) -> Column:
    """array<string>: lines of a message that the activity log takes; console messages need a known prefix and are stripped."""
    prefixed = lambda x: F.exists(F.array(*map(F.lit, CONSOLE_PREFIXES)), lambda p: F.startswith(x, p))
    lines = F.filter(F.split(message, "\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    console = F.filter(F.transform(lines, lambda x: F.trim(x)), prefixed)
    own = F.lit(False)
    for p in LOGGERS:
        own = own | logger.startswith(p)
    return F.when(logger == "console", console).when(own, lines).otherwise(F.array().cast("array<string>"))


def is_retryable(message: Column) -> Column:
    """Errors of a model service: final marks win over passing ones."""
    m = F.lower(message)
    return ~any_of(m, FINAL) & any_of(m, PASSING)


def is_transient(message: Column) -> Column:
    """Errors of the vector store."""
    return any_of(F.lower(message), STORE_PASSING)


def file_size(n: Column) -> Column:
    """``512 B``, ``1.5 KB`` and so on up to GB; '' for null."""
    # bround: halves go to the even digit, as in the C library.
    scaled = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / F.lit(float(1024**power)), 1))
    return F.when(n.isNull(), "").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def duration(seconds: Column) -> Column:
    """``250 ms``, ``2.50 sec``, ``1 min 5.0 sec``."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 1, F.format_string("%.0f ms", F.bround(seconds * 1000, 0))).when(seconds < 60, F.format_string("%.2f sec", F.bround(seconds, 2))).otherwise(F.concat(minutes.cast("string"), F.lit(" min "), F.format_string("%.1f sec", F.bround(seconds - minutes * 60, 1))))


def preview(text: Column, most: int = 350) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("...")))


def backoff(attempt: Column, base: float) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
