"""Answers that stop before their end: spikes of the length histograms, and how each answer ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.answers import defects, pairs_of

#: How often the mean count of the lengths just below it, taken as one at least, a spike has.
SPIKE_TIMES, NEIGHBOURS = 8.0, 16
TERMINAL = r"[.!?…»”\"')\]`|:;*—-]\s*$"


def spikes(values: DataFrame) -> DataFrame:
    """(record_kind, source_name, unit, length, n): the largest length of a producer's column where it is a spike.

    The histogram of lengths, in characters and in bytes, counts different texts. It has a spike at its maximum if that length has at
    least ``SPIKE_TIMES`` as many as the mean of the ``NEIGHBOURS`` lengths below. A producer with hard limits has one; repeated answers,
    and spikes below the maximum, are none.
    """
    both = values.where("response is not null").select(
        "record_kind", "source_name", F.xxhash64("response").alias("h"), F.explode(F.create_map(F.lit("chars"), F.length("response"), F.lit("bytes"), F.octet_length("response"))).alias("unit", "length"))
    counts = both.distinct().groupBy("record_kind", "source_name", "unit", "length").agg(F.count("*").alias("n"))
    top = counts.groupBy("record_kind", "source_name", "unit").agg(F.max("length").alias("top"), F.max_by("n", "length").alias("n"))
    keys = ["record_kind", "source_name", "unit"]
    below = counts.join(top.select(*keys, "top"), keys).where(f"length < top and length >= top - {NEIGHBOURS}").groupBy(*keys).agg((F.sum("n") / NEIGHBOURS).alias("below"))
    found = top.join(below, keys, "left").where(f"n >= {SPIKE_TIMES} * greatest(1, coalesce(below, 0))")
    return found.select(*keys, F.col("top").alias("length"), "n")


def truncated(baseline: DataFrame, evals: DataFrame) -> DataFrame:
    """(record_kind, record_id, source_name, truncated, at_spike) of every answer, each key once.

    An answer is cut off if it has a spike's length and no terminal sign, or if the classifier of broken answers calls
    it truncated. Null answers are not cut off; empty tables give an empty result.
    """
    pairs = pairs_of(baseline.sparkSession, None, baseline, evals)
    judged = defects(pairs)
    lengths = pairs.select("record_kind", "record_id", "source_name", "response").dropDuplicates(["record_kind", "record_id"])
    tops = spikes(lengths).groupBy("record_kind", "source_name").pivot("unit", ["chars", "bytes"]).agg(F.max("length"))
    open_ = ~F.coalesce(F.col("response"), F.lit(".")).rlike(TERMINAL)
    # one row a producer, so few that Spark broadcasts it after its own size check
    at = lengths.join(tops, ["record_kind", "source_name"], "left").select(
        "record_kind", "record_id", (open_ & F.coalesce((F.length("response") == F.col("chars")) | (F.octet_length("response") == F.col("bytes")), F.lit(False))).alias("at_spike"))
    out = judged.join(at, ["record_kind", "record_id"])
    return out.select("record_kind", "record_id", "source_name", ((F.coalesce("defect", F.lit("")) == "truncated") | F.col("at_spike")).alias("truncated"), "at_spike")


def rates(found: DataFrame) -> DataFrame:
    """Per producer: answers, truncated ones, those at a spike, and the rate."""
    return found.groupBy("record_kind", "source_name").agg(
        F.count("*").alias("answers"), F.count_if("truncated").alias("truncated"), F.count_if("at_spike").alias("at_spike"), F.avg(F.col("truncated").cast("int")).alias("rate"))
