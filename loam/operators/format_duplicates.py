"""Records that are the same but for white space, case, punctuation or field order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.words import letters, letters_by_field
from loam.operators.bloom import possible_repeats
from loam.session import materialize


def canonical_keys(rows: DataFrame, key: str = "example_id", plain: tuple[str, ...] = ("instruction", "context"), by_field: tuple[str, ...] = ("response",)) -> DataFrame:
    """(id, digest, h): a 128-bit digest of the canonical record and a 64-bit hash of it. Null counts as empty text."""
    parts = [letters(F.col(c)) for c in plain] + [letters_by_field(F.col(c)) for c in by_field]
    digest = F.unhex(F.md5(F.concat_ws("|", *parts)))
    return rows.select(F.col(key).alias("id"), digest.alias("digest")).where("id is not null").withColumn("h", F.xxhash64("digest"))


def collapse(rows: DataFrame, key: str = "example_id", plain: tuple[str, ...] = ("instruction", "context"), by_field: tuple[str, ...] = ("response",)) -> tuple[DataFrame, DataFrame]:
    """Groups of format copies: (id, copies) with one row a distinct record, and (id, member) for all but the smallest id.

    Only digests of records whose hash the repeat filter holds are shuffled; all others are singletons at once. Rows
    that repeat an id count once, and rows with a null id are left out. Records with all fields empty form one group.
    Extra columns are ignored; an empty table gives empty results.
    """
    keys = materialize(canonical_keys(rows, key, plain, by_field), "keys")
    flagged = possible_repeats(keys)
    members = materialize(flagged.where("repeat").groupBy("digest", "id").agg(F.lit(1).alias("one")), "members")
    groups = members.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    singles = flagged.where("not repeat").select("id", F.lit(1).cast("bigint").alias("copies"))
    counts = groups.select(F.col("first").alias("id"), "copies").unionByName(singles)
    pairs = members.join(groups.where("copies > 1"), "digest").where("id > first").select(F.col("first").alias("id"), F.col("id").alias("member"))
    return counts, pairs
