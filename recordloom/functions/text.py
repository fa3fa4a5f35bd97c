"""Column functions over titles, bodies, tags and tokens; all stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _accents() -> tuple[str, str]:
    """Letters that are a plain Latin letter and one mark, and those plain letters."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    found = {c: d[0] for c, d in parts.items() if len(d) == 2 and d[0] in "abcdefghijklmnopqrstuvwxyz"}
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _accents()


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case without accents; NULL gives no tokens."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), ACCENTED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def plain_lines(body: Column) -> Column:
    """The body on one line, without heading lines."""
    return squeeze(F.array_join(F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: ~x.startswith("#")), " "))


def preview(body: Column, width: int = 160) -> Column:
    return F.substring(plain_lines(body), 1, width)


def truncate_body(body: Column, width: int = 120) -> Column:
    line = plain_lines(body)
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, width - 1)), F.lit("…")))


def normalise_title(title: Column) -> Column:
    return squeeze(F.lower(F.coalesce(title, F.lit(""))))


def title_tokens(title: Column) -> Column:
    """Distinct words of more than three characters, split at white space only."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: F.length(w) > 3))


def title_key(title: Column, words: int = 5) -> Column:
    """The first words of a title, letters and digits only."""
    w = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, 1, words), " ")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")


def redact(key: Column, value: Column) -> Column:
    pattern = r"(?i)(password|token|secret|api\s*key)"
    return F.when(F.coalesce(key, F.lit("")).rlike(pattern) | value.rlike(pattern), "[REDACTED]").otherwise(value)


def sanitize_tag(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def parse_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != "")


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_dot(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def overlap(a: Column, b: Column) -> Column:
    """Items of ``a`` that are in ``b``; repeats in ``a`` count each time, NULL arrays count as empty."""
    none = F.array().cast("array<string>")
    return F.size(F.filter(F.coalesce(a, none), lambda x: F.array_contains(F.coalesce(b, none), x)))


def prefix_stem(term: str) -> str:
    """A query term cut for prefix search: one long and one short ending go, if four letters stay."""
    import re

    cut = re.sub(r"(?:ation|ition|ment|ness|ingly|edly)$", "", term.lower())
    cut = re.sub(r"(?:ing|edly|ed|es|s)$", "", cut)
    return cut if len(cut) >= 4 else term.lower()
