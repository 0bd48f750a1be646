"""Text cleaning, chunking and quality rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware regular expressions see it, with the separators U+001C to U+001F. The flag makes ``\s`` one
#: test of a character's property: five times as fast as a class that lists the characters.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: What has to be replaced to leave single blanks only: runs, and white space other than a blank.
RUNS = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
#: The same characters one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Fixed patterns of the quality rules: words, links, identifiers, and signs that count as text.
WORD = "[A-Za-zА-Яа-яЁё0-9_]{2,}"
LINK = r"(?iU)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"
NOT_USEFUL = "[^\\p{L}\\p{N}.,:;!?()\\[\\]{}+\\-_=/%'\"]"
# Fixed separators of the chunker, in order of preference.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
# Fixed chunk sizes and overlaps by kind of source.
PROFILES = {"file": (900, 100), "web": (1400, 150), "git": (1800, 100)}
DEFAULT_PROFILE = (1200, 150)
MIN_CHARS, MIN_WORDS, MIN_USEFUL_SHARE = 120, 15, 0.55
#: The first MIN_WORDS words from the start: nothing is read after them.
ENOUGH_WORDS = f"^(?:(?:(?!{WORD[:-4]}{{2}})[\\s\\S])*+{WORD[:-4]}{{2,}}+){{{MIN_WORDS}}}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def one_blank(text: Column) -> Column:
    """Every run of white space as one blank, stripped."""
    return strip(F.regexp_replace(text, RUNS, " "))


def clean(text: Column) -> Column:
    """Line ends to LF, runs of white space in a line to one blank, at most one empty line in a row, stripped."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    joined = F.array_join(F.transform(lines, lambda x: one_blank(x)), "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What case folding changes beyond lower case: characters that become another one, and those that become several."""
    lower = [c for c in map(chr, range(0x80, 0x1F000)) if c.lower() == c and c.casefold() != c]
    return {c: c.casefold() for c in lower if len(c.casefold()) == 1}, {c: c.casefold() for c in lower if len(c.casefold()) > 1}


FOLD_ONE, FOLD_MORE = _folds()


def _ranges(chars: str, gap: int = 64) -> str:
    """A character class of few ranges, that holds ``chars`` and what lies between near ones."""
    out: list[list[str]] = []
    for c in sorted(chars):
        if out and ord(c) - ord(out[-1][1]) < gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{a}-{b}" for a, b in out) + "]"


#: Characters at which folding may go beyond lower case, sharp s aside.
FOLDED = _ranges("".join([*FOLD_ONE, *FOLD_MORE]).replace("ß", ""))


def casefold(text: Column) -> Column:
    """Full case folding."""
    return folded(F.lower(text))


def folded(lower: Column) -> Column:
    """Full case folding of what is in lower case: sharp s, then what else folding maps further (final sigma, ligatures),
    looked for first by a class of few ranges."""
    more = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in FOLD_MORE.items()])

    def further(t: Column) -> Column:
        one = F.translate(t, "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
        return F.when(t.rlike(FOLDED), F.aggregate(more, one, lambda x, m: F.replace(x, m["a"], m["b"]))).otherwise(t)

    return let(F.replace(lower, F.lit("ß"), F.lit("ss")), further)


def fold(text: Column) -> Column:
    """What is compared instead of a line: white space and case aside."""
    return casefold(one_blank(text))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def drop_repeated_lines(text: Column) -> Column:
    """A line equal to the last non-blank kept line (white space and case aside) goes; blank lines between do not matter.

    A line that goes equals the kept one before it, so the last non-blank line is all that has to be looked at.
    """
    return unrepeated(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"), fold(x).alias("key"))))


def unrepeated(lines: Column) -> Column:
    """``drop_repeated_lines`` of array<struct<at, line, key>>, a line's key being what is compared."""

    def joined(rows: Column) -> Column:
        def piece(row: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(rows, i - 1))
            blank = F.coalesce(row["at"] - before["at"] > 1, F.lit(False))
            kept = F.coalesce(row["key"] != before["key"], F.lit(True))
            return F.concat(F.when(blank, "\n").otherwise(""), F.when(kept, F.concat(row["line"], F.lit("\n"))).otherwise(""))

        return F.array_join(F.transform(rows, piece), "")

    return strip(F.regexp_replace(let(F.filter(lines, lambda x: x["key"] != ""), joined), "\n{3,}", "\n\n"))


def quality_reason(text: Column) -> Column:
    """``useful`` or the first rule that a chunk breaks."""

    def judged(t: Column) -> Column:
        visible = F.length(F.regexp_replace(t, SPACE, ""))
        useful = F.length(F.regexp_replace(t, NOT_USEFUL, ""))
        n_words = F.regexp_count(t, F.lit(WORD))  # counted only in texts of many links
        return (
            F.when(F.coalesce(t, F.lit("")) == "", "empty")
            .when(F.length(t) < MIN_CHARS, "too_short")
            .when(~t.rlike(ENOUGH_WORDS), "too_few_words")
            .when(visible == 0, "no_visible_characters")
            .when(useful / visible < MIN_USEFUL_SHARE, "mostly_symbols")
            .when((F.regexp_count(t, F.lit(LINK)) >= 5) & (n_words < 40), "mostly_links")
            .otherwise("useful")
        )

    return let(strip(text), judged)


def code_quality_reason(text: Column) -> Column:
    short = lambda t: F.when(F.coalesce(t, F.lit("")) == "", "empty").when(F.length(t) < 80, "code_too_short")
    return let(strip(text), lambda t: short(t).when(F.regexp_count(t, F.lit(IDENTIFIER)) < 3, "not_enough_code_content").otherwise("useful"))


def profile(source_type: Column) -> Column:
    """struct<size, overlap> for a kind of source."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("size"), F.lit(p[1]).alias("overlap"))
    out = pair(DEFAULT_PROFILE)
    for kind, p in PROFILES.items():
        out = F.when(source_type == kind, pair(p)).otherwise(out)
    return out
