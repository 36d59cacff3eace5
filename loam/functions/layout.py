"""Layout repair of document elements, one sequence of text steps for each element type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions import text as T

Step = Callable[[Column], Column]


def harmonise(sign: str, spaced: str) -> Step:
    """One spelling for the white space around a sign; it also changes times and addresses, as it should."""
    return lambda c: F.regexp_replace(c, rf"{T.WS}*{sign}{T.WS}*", spaced)


def strip_line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t]+(?=\n|\z)", "")


_colon, _equal = harmonise(":", ": "), harmonise("=", " = ")
_title = (T.collapse_spaces, T.strip_around_newlines, T.join_hyphenated, T.join_title_lines, T.squeeze_blanks)
_item = (T.strip_around_newlines, T.collapse_spaces, T.join_hyphenated, T.join_title_lines, T.collapse_blank_lines, T.squeeze_blanks)
_verbatim = (strip_line_ends, T.collapse_blank_lines)

#: Steps by element type, between the unification of line ends and the final strip.
STEPS: dict[str, tuple[Step, ...]] = {
    "title": _title,
    "section_header": _title,
    "paragraph": (T.strip_around_newlines, T.collapse_spaces, T.join_hyphenated, T.join_paragraph_lines, T.collapse_blank_lines, T.squeeze_blanks),
    "list_group": (T.strip_around_newlines, T.collapse_spaces, T.join_hyphenated, T.collapse_blank_lines, T.squeeze_blanks),
    "list_item": _item,
    "picture": _item,
    "table": (T.collapse_spaces, T.strip_around_newlines, T.collapse_blank_lines),
    "key_value": (T.strip_around_newlines, T.collapse_spaces, T.join_hyphenated, T.join_title_lines, _colon, _equal, T.collapse_blank_lines, T.squeeze_blanks),
    "code": _verbatim,
    "formula": _verbatim,
    "form": (T.strip_around_newlines, T.collapse_spaces, T.join_hyphenated, T.collapse_blank_lines, _colon, _equal, T.squeeze_blanks),
    "unknown": (T.strip_around_newlines, T.collapse_spaces, T.collapse_blank_lines, T.squeeze_blanks),
}


def repair(c: Column, kind: str) -> Column:
    """``c`` repaired as an element of type ``kind``; null gives an empty string, unknown types take the default steps."""
    out = T.join_soft_hyphens(T.line_endings(F.coalesce(c, F.lit(""))))
    for step in STEPS.get(kind, STEPS["unknown"]):
        out = step(out)
    return T.strip(out)


def repair_by_type(c: Column, kind: Column) -> Column:
    """``repair`` with the steps of each row's type."""
    first, *rest = [k for k in STEPS if k != "unknown"]
    out = F.when(kind == first, repair(c, first))
    for k in rest:
        out = out.when(kind == k, repair(c, k))
    return out.otherwise(repair(c, "unknown"))
