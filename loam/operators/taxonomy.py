"""Generation plans: product of axes, validity filter, identifiers, phrases and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The axes and their values, in order.
AXES = {
    "domain_subarea": ("cloud_architecture", "cybersecurity_protocols", "database_administration"),
    "source_type": ("api_documentation", "release_notes", "user_manual"),
    "task_type": ("translate_en_to_fr", "translate_fr_to_en"),
    "difficulty": ("easy", "medium", "hard"),
    "noise_level": ("clean", "semi_noisy", "noisy"),
    "challenge_type": ("straightforward", "terminology_ambiguity", "false_friends", "mixed_code_text", "format_sensitive"),
    "output_format": ("plain_text", "preserve_source_format", "json"),
    "constraint_type": ("preserve_identifiers", "strict_json_keys"),
    "preservation_constraint": ("preserve_code_blocks", "preserve_markdown", "preserve_placeholders", "preserve_cli_commands"),
}

VALID = """
(output_format = 'json') = (constraint_type = 'strict_json_keys')
and not (output_format = 'plain_text' and (challenge_type = 'format_sensitive' or preservation_constraint = 'preserve_markdown'))
and (difficulty <> 'easy' or (noise_level = 'clean' and challenge_type = 'straightforward'))
and not (challenge_type = 'straightforward' and difficulty = 'hard')
and not (source_type = 'user_manual' and (challenge_type = 'mixed_code_text' or preservation_constraint = 'preserve_cli_commands'))
"""


def product(spark: SparkSession, axes: dict[str, tuple[str, ...]] = AXES) -> DataFrame:
    """All combinations of the axes' values with ``pos``, their place in product order, the last axis fastest.

    The number of rows is fixed by the axes, whatever the data.
    """
    size = reduce(lambda a, b: a * b, (len(v) for v in axes.values()), 1)
    out, step = spark.range(size).withColumnRenamed("id", "pos"), size
    for name, values in axes.items():
        step //= len(values)
        at = F.pmod(F.floor(F.col("pos") / step), F.lit(len(values))).cast("int")
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, values)), at + 1))
    return out


def valid_plans(combinations: DataFrame) -> DataFrame:
    """Valid combinations with ``plan_id``, dense in product order. The window spans the fixed product only."""
    kept = combinations.where(VALID)
    return kept.withColumn("plan_id", F.expr("format_string('plan_%05d', row_number() over (order by pos) - 1)"))


def source_language(task: Column) -> Column:
    return F.when(task == "translate_en_to_fr", "Anglais").otherwise("Français")


def phrase(c: Column, phrases: dict[str, str]) -> Column:
    """The phrase for a value; a value without one fails the job."""
    table = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.raise_error(F.concat(F.lit("no phrase for "), F.coalesce(c, F.lit("null")))).cast("string"))


def fill(template: str, **columns: Column) -> Column:
    """``template`` with each ``{name}`` replaced by its column; null counts as an empty text."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def with_plan(rows: DataFrame, plans: DataFrame, strict: bool = True) -> DataFrame:
    """``rows`` joined to their plan by plan_id; of plans with one id the last ``pos`` wins, missing fields read ``Introuvable``.

    ``strict`` fails for rows whose plan is unknown, else they are left out. ``plans`` is a fixed table.
    """
    names = [c for c in plans.columns if c not in ("plan_id", "pos")]
    pos = F.col("pos") if "pos" in plans.columns else F.lit(0)
    last = plans.groupBy("plan_id").agg(F.max_by(F.struct(*[F.coalesce(c, F.lit("Introuvable")).alias(c) for c in names]), pos).alias("plan"))
    out = rows.join(last, "plan_id", "left" if strict else "inner")
    if strict:
        known = F.when(F.col("plan").isNull(), F.raise_error(F.concat(F.lit("unknown plan "), F.coalesce("plan_id", F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
        out = out.where(known)
    return out.select("*", *[F.col(f"plan.{c}").alias(f"plan_{c}") for c in names]).drop("plan")
