"""What is shown for sources, statuses, errors and timings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.classify import any_of

# Icons by extension, colours by status, titles of errors by their marks in the order they are tried.
ICONS = (((".pdf",), "picture_as_pdf"), ((".doc", ".docx"), "description"), ((".xls", ".xlsx", ".csv"), "table_chart"), ((".ppt", ".pptx"), "slideshow"))
STATUS_COLORS = {"pending": "orange-8", "processing": "light-blue-8", "indexed": "green-8", "completed": "green-8", "failed": "red-8", "error": "red-8"}
OTHER_COLOR, OTHER_ICON = "blue-grey-7", "draft"
ERROR_TITLES = (
    (("429", "rate limit", "too_many_requests", "quota exhausted", "quota exceeded"), "CORE QUOTA EXHAUSTED"),
    (("403", "access denied", "forbidden"), "CORE ACCESS DENIED"),
    (("503", "service_unavailable", "service unavailable", "high demand", "temporarily unavailable"), "CORE TEMPORARILY OVERLOADED"),
)
TIMEOUTS, MODEL_SERVICES = ("timeout", "timed out"), ("gemini api", "groq api")
MODEL_TIMEOUT, OTHER_TIMEOUT, OTHER_ERROR = "CORE NETWORK TIMEOUT", "ARCHIVE NETWORK TIMEOUT", "ADVISOR CORE ERROR"
TIMINGS = (("retrieval", "Search"), ("rerank", "Analysis"), ("generation", "Core"), ("total", "Total"))


def source_label(source_type: Column, extension: Column) -> Column:
    """Web, Git, a file's extension in capitals (File without one); other types with a capital first."""
    other = F.concat(F.upper(F.substring(source_type, 1, 1)), F.lower(F.substring(source_type, 2, 1 << 20)))
    named = F.coalesce(F.when(extension != "", F.upper(F.regexp_replace(extension, r"^\.+", ""))), F.lit("File"))
    return F.when(source_type == "web", "Web").when(source_type == "git", "Git").when(source_type == "file", named).otherwise(other)


def source_icon(source_type: Column, extension: Column) -> Column:
    out = F.when(source_type == "web", "language").when(source_type == "git", "code")
    for extensions, icon in ICONS:
        out = out.when(extension.isin(*extensions), icon)
    return out.otherwise(OTHER_ICON)


def status_color(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS_COLORS.items() for x in pair])
    return F.coalesce(known[F.lower(status)], F.lit(OTHER_COLOR))


def error_title(message: Column) -> Column:
    m = F.lower(message)
    out = F.when(any_of(m, TIMEOUTS), F.when(any_of(m, MODEL_SERVICES), MODEL_TIMEOUT).otherwise(OTHER_TIMEOUT)).otherwise(OTHER_ERROR)
    for marks, title in reversed(ERROR_TITLES):
        out = F.when(any_of(m, marks), title).otherwise(out)
    return out


def timing_line(seconds: Column) -> Column:
    """``Search 0.10s · Total 2.00s`` of a map<string,double>; steps without a value are left out."""
    # bround: halves go to the even digit, as in the C library.
    steps = [F.concat(F.lit(f"{label} "), F.format_string("%.2fs", F.bround(seconds[key], 2))) for key, label in TIMINGS]
    known = [F.when(seconds[key].isNotNull(), step) for (key, _), step in zip(TIMINGS, steps)]
    return F.concat_ws(" · ", *known)


def script_reference(source_type: Column, uri: Column, external_id: Column, title: Column) -> Column:
    """A reference as printed by scripts: the page's URL, ``repository -> path``, else the title."""
    filled = lambda c: F.nullif(c, F.lit(""))
    path = F.concat(F.coalesce(uri, F.lit("")), F.lit(" -> "), F.coalesce(filled(external_id), title, F.lit("None")))
    return F.when((source_type == "web") & filled(external_id).isNotNull(), external_id).when(source_type == "git", path).otherwise(title)


def dataset_reference(source_type: Column, uri: Column, external_id: Column, title: Column) -> Column:
    """A reference as stored with evaluation questions: never null."""
    filled = lambda c: F.nullif(c, F.lit(""))
    git = F.coalesce(F.concat(filled(uri), F.lit(" -> "), F.coalesce(external_id, F.lit("None"))), filled(external_id))
    found = F.when(source_type == "web", F.coalesce(filled(external_id), filled(uri))).when(source_type == "git", git).otherwise(F.coalesce(filled(title), filled(external_id)))
    return F.coalesce(found, F.lit(""))
