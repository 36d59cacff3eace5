"""Ranks and quotas over large groups, without ever sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.session import materialize


def hex_spot(seed: str, key: Column) -> Column:
    """Position in a repeatable random order, as a hexadecimal digest."""
    return F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)


def within_quota(rows: DataFrame, by: list[str], spot: Column, key: str, quota: Column) -> DataFrame:
    """``rows`` with ``taken``: whether the row is among the first of its group, in the order of ``spot`` and ``key``.

    ``quota`` is the number to take, an expression over ``n``, the group's size. Counts over 4096 ranges of the digest
    settle all rows but those of one range a group, and only these are ranked.
    """
    r = rows.withColumn("_spot", spot).withColumn("_bucket", F.conv(F.substring("_spot", 1, 3), 16, 10).cast("int"))
    counts = r.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    over = ", ".join(f"`{c}`" for c in by)
    sums = counts.selectExpr("*", f"sum(_n) over (partition by {over}) as n", f"sum(_n) over (partition by {over} order by _bucket) - _n as _before")
    sums = sums.select(*by, "_bucket", "_n", "_before", quota.cast("bigint").alias("_quota"))
    sums = sums.select(*by, "_bucket", F.expr("case when _before + _n <= _quota then _n when _before >= _quota then 0 else _quota - _before end").alias("_take"), "_n")
    joined = r.alias("r").join(sums.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_bucket"]]).select("r.*", "s._take", "s._n")
    settled = joined.where("_take = 0 or _take = _n").withColumn("taken", F.col("_take") > 0)
    edge = joined.where("_take > 0 and _take < _n").withColumn("taken", F.expr(f"row_number() over (partition by {over}, _bucket order by _spot, `{key}`)") <= F.col("_take"))
    return settled.unionByName(edge).drop("_spot", "_bucket", "_take", "_n")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position``, 0-based in the order given: sorted by ranges, each range numbered on its own."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "ranged")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).selectExpr("_part", "sum(_n) over (order by _part) - _n as _first")
    return ranged.join(parts, "_part").withColumn("position", F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def first_by_key(rows: DataFrame, key: Column, position: Column) -> DataFrame:
    """``rows`` with ``first``: whether the row has the smallest position of all with its key (null keys are one group)."""
    r = rows.withColumn("_key", key).withColumn("_pos", position)
    low = r.groupBy("_key").agg(F.min("_pos").alias("_low"))
    joined = r.alias("r").join(low.alias("l"), F.col("r._key").eqNullSafe(F.col("l._key")))
    return joined.select("r.*", (F.col("r._pos") == F.col("l._low")).alias("first")).drop("_key", "_pos")
