"""Column functions on text: folding, tokens, titles, links; all built from Spark's own."""

from __future__ import annotations

import datetime
import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming takes off, as a class of code points with the White_Space property.
SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def folding() -> tuple[str, str]:
    """Characters that folding changes, and what stands for them: the letter below its marks, or nothing for a mark itself.

    The rule is canonical decomposition without combining marks; letters that decompose into several are left alone."""
    changed, marks, to = [], [], []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                changed.append(c)
                to.append(base)
    return "".join(changed + marks), "".join(to)


@functools.cache
def _table() -> dict:
    old, new = folding()
    return str.maketrans(dict(zip(old, new, strict=False)) | dict.fromkeys(old[len(new) :], ""))


def fold(text: str) -> str:
    """As the tokens' folding, for the words of a query."""
    return text.lower() if text.isascii() else text.lower().translate(_table())


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), *folding()), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def words(text: str) -> tuple[str, ...]:
    """The tokens of a query's text."""
    return tuple(re.findall(r"[^\W_]+", fold(text)))


def trimmed(text: Column) -> Column:
    """text without white space at its ends, line feeds and tabs too."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def right_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+\\z", "")


def title(text: Column) -> Column:
    """The first line without leading number signs, trimmed, at most 80 characters."""
    return F.substring(trimmed(F.regexp_replace(F.substring_index(text, "\n", 1), "^#+", "")), 1, 80)


def wikilinks(line: Column) -> Column:
    """Targets of [[...]] in a line, in order."""
    return F.regexp_extract_all(line, F.lit("\\[\\[([^\\]]+)\\]\\]"), F.lit(1))


def heading(rel: Column) -> Column:
    """A relation as a section's heading: `depends-on` becomes `## Depends On`; only first letters change."""
    return F.concat(F.lit("## "), F.array_join(F.transform(F.split(rel, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " "))


def sanitised(query: Column) -> Column:
    """A query as its letters and digits, apart by single blanks."""
    return F.trim(F.regexp_replace(query, "[^\\p{L}\\p{N}]+", " "))


def quoted_block(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\n> "))


def embed_input(title: Column, domain: Column, kind: Column, intent: Column, tags: Column, body: Column) -> Column:
    return F.concat(F.lit("["), domain, F.lit(" "), kind, F.lit(" — "), intent, F.lit("] ["), F.array_join(tags, ", "), F.lit("] "), title, F.lit("\n\n"), body)


def cut_at_word(text: Column, most: int) -> Column:
    """Text of at most `most` UTF-8 bytes, up to the last blank if there is one; no character is halved."""
    whole = F.encode(text, "UTF-8")
    cut = F.make_valid_utf8(F.substring(whole, 1, most).cast("string"))
    head = F.when(F.startswith(text, cut), cut).otherwise(F.regexp_replace(cut, "\ufffd+\\z", ""))
    return F.when(F.length(whole) <= most, text).when(F.instr(head, " ") > 0, F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head)


def cutoff(shorthand: str, now: datetime.datetime) -> datetime.datetime:
    """now less a span such as 24h, 7d, 4w or 3mo (of 30 days)."""
    m = re.fullmatch(r"(\d+)(h|d|w|mo)", shorthand)
    if not m:
        raise ValueError(f"not a time span: {shorthand!r}")
    hours = {"h": 1, "d": 24, "w": 168, "mo": 720}[m[2]]
    return now - datetime.timedelta(hours=int(m[1]) * hours)


def tag_checked(tag: str) -> str:
    """A tag in lower case; anything but letters a to z, digits and hyphens is an error."""
    tag = tag.lower()
    if not re.fullmatch(r"[a-z0-9-]+", tag):
        raise ValueError(f"not a tag: {tag!r}")
    return tag
