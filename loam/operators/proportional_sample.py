"""Sample whose category shares follow targets, by swap repair on category counts."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets per stratum: whole buckets are taken or left, only the one at the edge is ranked.
EDGE_BUCKETS = 4096

REPORT = (
    "target_set string, source string, challenge_type string, rows bigint, size bigint, available bigint,"
    " required bigint, allotted bigint, target_share double, share double, met boolean"
)


def category(c: Column) -> Column:
    """Category name without regard to case, outer blanks and blank, hyphen or underscore; null where there is none."""
    name = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), r"[\s _-]+", "_")
    return F.when((name != "") & (name != "introuvable"), name)


def categorised(examples: DataFrame, plans: DataFrame) -> DataFrame:
    """(example_id, source, category): own challenge_type, else the plan's; each id once, rows without either left out.

    The join side ``plans`` is a fixed table; whether it is broadcast is left to Spark's own size check.
    """
    of_plan = plans.groupBy("plan_id").agg(F.min(category(F.col("challenge_type"))).alias("of_plan")).where("plan_id is not null")
    own = examples.select("example_id", "source", "plan_id", category(F.col("challenge_type")).alias("own"))
    joined = own.join(of_plan, "plan_id", "left")
    return (
        joined.select("example_id", "source", F.coalesce("own", "of_plan").alias("category"))
        .where("category is not null and source is not null and example_id is not null")
        .groupBy("example_id").agg(F.min("source").alias("source"), F.min("category").alias("category"))
    )


def repair(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Counts per category for a sample of ``size``.

    Starts from a random composition that meets every floor it can, then exchanges one category's counts for
    another's, as many as lower the summed deviation from ``share``, until no exchange improves it.
    """
    floor = np.minimum(floor, available)
    size = int(min(max(size, floor.sum()), available.sum()))
    rng = np.random.default_rng(seed)
    take = floor.copy()
    rest = size - int(take.sum())
    while rest > 0:  # shares of what is left, of any size, as a hypergeometric draw is bounded to 1e9 rows
        left = available - take
        more = np.minimum(rng.multinomial(rest, left / left.sum()), left)
        take, rest = take + more, rest - int(more.sum())
    want = share * size
    while True:
        over, under = take - want, want - take
        best, move = 0.0, None
        for i in np.flatnonzero((over > 0) & (take > floor)):
            for j in np.flatnonzero((under > 0) & (take < available)):
                n = int(min(max(1, np.floor(min(over[i], under[j]))), take[i] - floor[i], available[j] - take[j]))
                gain = abs(over[i]) + abs(under[j]) - abs(over[i] - n) - abs(under[j] - n)
                if gain > best + 1e-9:
                    best, move = gain, (i, j, n)
        if move is None:
            return take
        i, j, n = move
        take[i] -= n
        take[j] += n


def target_report(rows: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """One row a target: what is available and required, and what the repaired sample allots.

    ``rows`` as from ``categorised``. Required is greatest(min_rows, ceil(size * target_pct / 100)), which the repair
    takes as its floor; a target is met where the sample reaches it. The sample exceeds the size by what the floors round up. A source without rows has size 0. Duplicate targets count once; a null
    target_pct, sample_pct or min_rows counts as 0. Empty tables give an empty report.
    """
    have = rows.groupBy("source", "category").agg(F.count("*").alias("available"))
    t = targets.select(
        "target_set", "source", "challenge_type", category(F.col("challenge_type")).alias("category"),
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("target_pct", "sample_pct", "min_rows")],
    ).distinct()
    total = have.groupBy("source").agg(F.sum("available").alias("rows"))
    joined = t.join(have, ["source", "category"], "left").join(total, "source", "left").na.fill(0, ["available", "rows"])

    def allot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("challenge_type", ignore_index=True)
        n, pct = int(pdf["rows"].iloc[0]), int(pdf["sample_pct"].iloc[0])
        size = n * pct // 100
        available, target = pdf["available"].to_numpy(np.int64), pdf["target_pct"].to_numpy(np.int64)
        required = np.maximum(pdf["min_rows"].to_numpy(np.int64), -((-size * target) // 100))
        share = target / max(1, target.sum())
        group = f"{pdf['target_set'].iloc[0]}/{pdf['source'].iloc[0]}"
        take = repair(available, share, required, size, seed + zlib.crc32(group.encode()))
        return pd.DataFrame({
            "target_set": pdf["target_set"], "source": pdf["source"], "challenge_type": pdf["challenge_type"],
            "rows": pdf["rows"], "size": size, "available": available, "required": required, "allotted": take,
            "target_share": target / 100, "share": take / max(1, int(take.sum())), "met": take >= required,
        })

    return joined.groupBy("target_set", "source").applyInPandas(allot, REPORT)


def draw(rows: DataFrame, report: DataFrame, seed: int = 17) -> DataFrame:
    """(target_set, source, category, example_id) of the sample, drawn at random as ``report`` allots.

    The rows with the smallest hashes are taken. Counts over hash buckets decide all buckets but one per stratum, so
    that no task ever ranks more than that one bucket, however large the stratum.
    """
    spot = F.xxhash64(F.lit(seed), F.col("example_id"))
    r = rows.select("source", "category", "example_id", spot.alias("spot"), F.pmod(spot, F.lit(EDGE_BUCKETS)).cast("int").alias("bucket"))
    w = report.select("target_set", "source", category(F.col("challenge_type")).alias("category"), "allotted").where("allotted > 0")
    counts = r.groupBy("source", "category", "bucket").agg(F.count("*").alias("n"))
    per = "partition by target_set, source, category order by bucket"
    edges = w.join(counts, ["source", "category"]).select("*", F.expr(f"sum(n) over ({per}) - n").alias("before"))
    edges = edges.where("before < allotted").select(
        "target_set", "source", "category", "bucket", F.expr("least(n, allotted - before)").alias("from_bucket"), "n")
    hit = r.join(edges, ["source", "category", "bucket"])
    whole = hit.where("from_bucket = n")
    edge = hit.where("from_bucket < n").withColumn(
        "rank", F.expr("row_number() over (partition by target_set, source, category, bucket order by spot, example_id)")
    ).where("rank <= from_bucket").drop("rank")
    return whole.unionByName(edge).select("target_set", "source", "category", "example_id")
