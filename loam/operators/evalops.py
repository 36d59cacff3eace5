"""Evaluation results: answer columns, last losses, needle tests, crossings and log fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import basename, insert_needle

ANSWER_NAMES = ("reponse", "response", "réponse")


def answers(results: DataFrame) -> DataFrame:
    """``results`` with its answer column, under whichever name, as ``response``."""
    name = next((c for c in ANSWER_NAMES if c in results.columns), None)
    if name is None:
        raise ValueError("no answer column")
    return results.withColumnRenamed(name, "response")


def run_answers(runs: DataFrame) -> DataFrame:
    """One row an answer of each run, each run once."""
    return runs.dropDuplicates(["run_id"]).select("run_id", "adapter", "modele", F.explode("baseline_test").alias("t")).select("run_id", "adapter", "modele", "t.*")


def last_loss(history: DataFrame, by: str = "run_id", order: str = "step") -> DataFrame:
    """The last logged loss of each run, null where none was logged."""
    return history.groupBy(by).agg(F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col(order))).alias("last_loss"))


def latency(results: DataFrame, *by: str) -> DataFrame:
    """Per group: answers, and the mean (to two decimals, half to even), least and largest seconds."""
    return results.groupBy(*by).agg(F.count("*").alias("answers"), F.bround(F.avg("duree"), 2).alias("mean_duree"), F.min("duree").alias("min_duree"), F.max("duree").alias("max_duree"))


def crossed(models: DataFrame, prompts: DataFrame) -> DataFrame:
    """Each model with each prompt; both are lists that someone wrote, not data that grow."""
    return models.crossJoin(prompts)


def needle_prompts(texts: DataFrame, needle: str, positions: tuple[str, ...] = ("debut", "milieu", "fin")) -> DataFrame:
    """``texts`` (column ``text``) with the needle at each position."""
    cases = F.array(*[F.struct(F.lit(p).alias("position"), insert_needle(F.col("text"), F.lit(needle), p).alias("prompt")) for p in positions])
    return texts.withColumn("_case", F.explode(cases)).select("*", "_case.position", "_case.prompt").drop("_case", "text")


def needle_found(answer: Column, needle: str) -> Column:
    return F.coalesce(F.contains(answer, F.lit(needle)), F.lit(False))


def model_name(path: Column) -> Column:
    return basename(path)


def perplexity(line: Column) -> Column:
    """Fifth blank-separated field of a log line with the final estimate, else null."""
    return F.when(line.contains("Final estimate"), F.try_element_at(F.split(F.trim(line), r"[ \t]+"), F.lit(5)).try_cast("double"))


def bench_speed(line: Column, kind: str) -> Column:
    """Eighth field of a bench table's line whose test is ``kind``, else null."""
    return F.when(line.contains(kind), F.trim(F.try_element_at(F.split(line, r"\|"), F.lit(8))))


#: How a configuration names the types of numbers.
DTYPES = {"float16": "float16", "fp16": "float16", "half": "float16", "bfloat16": "bfloat16", "bf16": "bfloat16", "float32": "float32", "fp32": "float32"}


def with_dtype(config: Column, key: str = "bnb_4bit_compute_dtype") -> Column:
    """A configuration (map of texts) with the type under ``key`` by its full name; without the key it stays as it is, an unknown type stays too."""
    names = F.create_map(*[F.lit(x) for kv in DTYPES.items() for x in kv])
    return F.transform_values(config, lambda k, v: F.when(k == key, F.coalesce(F.element_at(names, F.replace(v, F.lit("torch."), F.lit(""))), v)).otherwise(v))
