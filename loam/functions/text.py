"""Scalar text functions as Column expressions.

White space is spelled out everywhere, because Java's ``\\s`` and ``trim`` know fewer characters than the texts hold.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All Unicode white space, with the separators U+001C to U+001F.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
WS = r"[\t-\r\x1C-\x20\x85\xA0  -     　]"
#: What ends a line: all of Python's line boundaries.
LINE_END = r"\r\n|[\n-\r\x1C-\x1E\x85  ]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    """Without white space at the end."""
    return F.rtrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def clean_text(c: Column) -> Column:
    """Stripped, with three or more line feeds in a row reduced to two."""
    return F.regexp_replace(strip(c), r"\n{3,}", "\n\n")


def estimate_tokens(c: Column) -> Column:
    """Tokens estimated as a quarter of the code points, rounded up; 0 for blank text."""
    return F.when(is_blank(c), F.lit(0)).otherwise(F.ceil(F.length(c) / F.lit(4.0)).cast("int"))


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


nfkc = F.pandas_udf(_nfkc, StringType())


def normalize_unicode(c: Column) -> Column:
    """Compatibility composition; zero-width space, soft hyphen and byte order mark removed; null gives an empty string."""
    return F.translate(nfkc(F.coalesce(c, F.lit(""))), "\xa0​\xad﻿", " ")


def line_endings(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse_spaces(c: Column) -> Column:
    """Runs of blanks, tabs, form feeds and vertical tabs become one blank."""
    return F.regexp_replace(c, r"[ \t\f\x0B]+", " ")


def strip_around_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")


def join_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("\xad\n"), F.lit(""))


#: Letters that may stand around a hyphen at a line's end.
LOWER = "a-zà-öø-ÿæœ"


def join_hyphenated(c: Column) -> Column:
    """Words that were parted by a hyphen and a line feed are joined, where both parts are in lower case."""
    return F.regexp_replace(c, f"([{LOWER}]{{3,}})-\n([{LOWER}]{{2,}})", "$1$2")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def join_title_lines(c: Column) -> Column:
    """Single line feeds become blanks; blank lines stay."""
    return F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")


#: How a list item starts (a bullet, a number or one letter), with white space behind.
LIST_MARK = r"(?:[-*•]|\p{Nd}+[.)]|[A-Za-z][.)])"


def join_paragraph_lines(c: Column) -> Column:
    """Line feeds become blanks, except before a list item or a further line feed.

    The second line feed of a blank line qualifies, so that a blank line becomes a line feed and a blank; this is the
    behaviour to match, not an oversight here.
    """
    return F.regexp_replace(c, rf"\n(?!\s*{LIST_MARK}\s+)(?!\n)", " ")


def squeeze_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r" {2,}", " ")


def sentences(c: Column) -> Column:
    """Stripped, non-blank sentences: cut at white space behind a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?]){WS}+"), strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """Stripped, non-blank parts between empty lines."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda x: x != "")


def lines(c: Column, keep_indent: bool = False) -> Column:
    """Non-blank lines, stripped on both sides or, with ``keep_indent``, at the end only."""
    return F.filter(F.transform(F.split(c, LINE_END), rstrip if keep_indent else strip), lambda x: strip(x) != "")


def hard_split(c: Column, max_chars: int) -> Column:
    """Slices of ``max_chars`` code points, stripped, without blank ones; the whole text where the limit is not positive."""
    if max_chars <= 0:
        return F.array(c)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / F.lit(float(max_chars))).cast("int") - 1, F.lit(0)))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(c, i * max_chars + 1, F.lit(max_chars)))), lambda x: x != "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def insert_needle(text: Column, needle: Column, position: str) -> Column:
    """``needle`` put before, in the middle of or behind the words of ``text``, joined by single blanks."""
    words = F.filter(F.split(text, f"{WS}+"), lambda w: w != "")
    at = {"debut": F.lit(0), "milieu": F.floor(F.size(words) / 2).cast("int"), "fin": F.size(words)}
    if position not in at:
        raise ValueError(f"unknown position: {position}")
    return F.array_join(F.array_insert(words, at[position] + 1, needle), " ")
