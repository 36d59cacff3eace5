"""Instruction examples: validation, routing, cleaning, deduplication, split, statistics and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import clean_text, estimate_tokens
from loam.operators.ranking import first_by_key, hex_spot, numbered, within_quota

#: Least lengths in code points, untrimmed.
LEAST = {"instruction": 5, "context": 10, "response": 5, "plan_id": 0, "challenge_type": 0}


def parse_examples(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Lines of JSON (column ``value``) as variants (column ``v``); a bad line is null, or fails the job if ``strict``."""
    return lines.select("value", (F.parse_json if strict else F.try_parse_json)("value").alias("v"))


def valid_json_example(v: Column) -> Column:
    """Whether all five fields are JSON strings of sufficient length; further fields are allowed."""
    tests = []
    for name, least in LEAST.items():
        field = F.try_variant_get(v, f"$.{name}", "variant")
        tests.append(F.coalesce((F.schema_of_variant(field) == "STRING") & (F.length(F.try_variant_get(v, f"$.{name}", "string")) >= least), F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def with_keys(answer: Column, **keys: Column) -> Column:
    """Fields of a JSON object (as texts) with ``keys`` added, which replace fields of the same name; null for anything but an object."""
    fields = F.when(F.ltrim(answer).startswith("{"), F.from_json(answer, "map<string,string>", {"mode": "PERMISSIVE"}))
    own = F.map_filter(fields, lambda k, _: ~k.isin(*keys))
    return F.map_concat(own, F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), c.cast("string"))]))


def valid_example(has: dict[str, Column] | None = None) -> Column:
    """The same for typed columns: none null and all long enough."""
    out = F.lit(True)
    for name, least in LEAST.items():
        c = (has or {}).get(name, F.col(name))
        out = out & F.coalesce(F.length(c) >= least, F.lit(False))
    return out


def decision(verdict: Column) -> Column:
    """ACCEPT, REJECT or REVIEW from a verdict's JSON text; whatever is not one of the first two is REVIEW."""
    d = F.try_variant_get(F.try_parse_json(verdict), "$.final_decision", "string")
    return F.when(d == "ACCEPT", "ACCEPT").when(d == "REJECT", "REJECT").otherwise("REVIEW")


def decision_by_scores(*scores: Column) -> Column:
    """All scores of 4 or more accept, a least score of 3 asks for review, a lower one rejects; null if any is missing."""
    low = F.when(F.forall(F.array(*scores), lambda s: s.isNotNull()), F.least(*scores))
    return F.when(low >= 4, "ACCEPT").when(low == 3, "REVIEW").when(low <= 2, "REJECT")


def deduplicated(rows: DataFrame, position: Column) -> DataFrame:
    """Cleaned rows with ``first``: the first of those with equal instruction, response and context stays, the others are rejects.

    ``duplicate_flags`` tells the same by key alone, without moving texts.
    """
    clean = rows.withColumns({c: clean_text(F.col(c)) for c in ("instruction", "context", "response")})
    key = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("instruction", "response", "context")]), 256)
    return first_by_key(clean, key, position)


def duplicate_flags(rows: DataFrame, key: str) -> DataFrame:
    """(key, first) of each distinct ``key``, the smallest of those with equal cleaned texts being the first: digests are made before anything is shuffled."""
    clean = [F.coalesce(clean_text(F.col(c)), F.lit("")) for c in ("instruction", "response", "context")]
    digests = rows.select(key, F.sha2(F.concat_ws("|", *clean), 256).alias("_digest")).dropDuplicates([key])
    return first_by_key(digests, F.col("_digest"), F.col(key)).select(key, "first")


def split(rows: DataFrame, key: str, by: str = "challenge_type", seed: str = "42") -> DataFrame:
    """``rows`` with ``split``: per group, the first four fifths in random order are train, the rest val. A null group is ``Introuvable``."""
    grouped = rows.withColumn(by, F.coalesce(by, F.lit("Introuvable")))
    out = within_quota(grouped, [by], hex_spot(seed, F.col(key)), key, F.floor(F.col("n") * 4 / 5))
    return out.withColumn("split", F.when(F.col("taken"), "train").otherwise("val")).drop("taken")


def sample_per_group(rows: DataFrame, key: str, by: str, size: int, seed: str = "42") -> DataFrame:
    """At most ``size`` random rows of each group."""
    return within_quota(rows, [by], hex_spot(seed, F.col(key)), key, F.least(F.col("n"), F.lit(size))).where("taken").drop("taken")


def review_sample(rows: DataFrame, key: str, size: int = 5, seed: str = "42") -> DataFrame:
    return rows.orderBy(hex_spot(seed, F.col(key)), key).limit(size)


def head_share(rows: DataFrame, key: str, percent: int = 60) -> DataFrame:
    """The first ``percent`` of all rows, in the order of ``key``."""
    n = rows.count()
    return numbered(rows, key).where(F.col("position") < n * percent // 100).drop("position")


def statistics(rows: DataFrame) -> DataFrame:
    """Number of rows and mean lengths of the three texts; nulls count as empty, and without rows the means are null."""
    mean = lambda c: F.avg(F.length(F.coalesce(c, F.lit("")))).alias(f"mean_{c}")
    return rows.agg(F.count("*").alias("examples"), *[mean(c) for c in ("instruction", "context", "response")])


def formatted(rows: DataFrame) -> DataFrame:
    """(prompt, completion) next to the other columns: context, an empty line and the instruction; the response."""
    return rows.withColumns({"prompt": F.concat("context", F.lit("\n\n"), "instruction"), "completion": F.col("response")})


def token_lengths(rows: DataFrame) -> DataFrame:
    """Estimated tokens of prompt, response and both."""
    p, c = estimate_tokens(F.col("prompt")), estimate_tokens(F.col("completion"))
    return rows.withColumns({"nb_tokens_prompt": p, "nb_tokens_response": c, "nb_tokens": p + c})


def token_summary(rows: DataFrame) -> DataFrame:
    names = ("nb_tokens", "nb_tokens_prompt", "nb_tokens_response")
    return rows.agg(*[F.avg(c).alias("mean_" + c[3:]) for c in names], *[F.max(c).alias("max_" + c) for c in names])
