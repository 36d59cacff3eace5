"""Canonical forms of texts: words, letters, and JSON answers compared by field (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column) -> Column:
    """Lower case of the upper case, so that letters with several lower forms, such as ß and ss, are equal; null gives an empty string."""
    return F.lower(F.upper(F.coalesce(c, F.lit(""))))


def words_text(c: Column) -> Column:
    """Runs of letters and digits in lower case, joined by one space; null gives an empty string."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def letters(c: Column) -> Column:
    """Only letters and digits, in order, in lower case; null gives an empty string."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "")


def json_fields(c: Column) -> Column:
    """A JSON object's top-level fields as a map of strings; null for anything else.

    Values that are objects or arrays come back as JSON text in one normal spelling.
    """
    return F.when(F.ltrim(c).startswith("{"), F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"}))


def letters_by_field(c: Column) -> Column:
    """``letters`` for text; a JSON object becomes its fields in key order, each with ``letters`` of its value."""
    fields = json_fields(c)
    listed = F.array_sort(F.map_entries(fields))
    joined = F.array_join(F.transform(listed, lambda e: F.concat(letters(e["key"]), F.lit("="), letters(e["value"]))), ";")
    return F.when(F.size(fields) > 0, F.concat(F.lit("{"), joined)).otherwise(letters(c))


def words_of_values(c: Column) -> Column:
    """``words_text`` of a text, or of a JSON object's values in key order."""
    fields = json_fields(c)
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.coalesce(e["value"], F.lit(""))), " ")
    return words_text(F.when(F.size(fields) > 0, joined).otherwise(c))
