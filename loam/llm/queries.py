"""Queries of the operators for language-model data, by name, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import abuse, answers, leaks, mixing, truncation
from loam.session import materialize, table


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(answers.pairs_of(spark, table(spark, d, "sft_examples"), table(spark, d, "baseline_result"), table(spark, d, "eval_lora")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("defect is not null").select("record_kind", "record_id", "defect")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer_rates(_defects(spark, d))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "baseline_result"), table(spark, d, "eval_lora"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("truncated").select("record_kind", "record_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_truncated(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leaks.leak_report(leaks.leaks(table(spark, d, "documents"), items), items)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    tokens = materialize(mixing.with_tokens(table(spark, d, "documents")), "tokens")
    _, report = mixing.plan(tokens, table(spark, d, "mix_targets"))
    return spark.createDataFrame(report, mixing.REPORT).where("not reachable").select("mix_name", "source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    tokens = materialize(mixing.with_tokens(table(spark, d, "documents")), "tokens")
    weights, report = mixing.plan(tokens, table(spark, d, "mix_targets"))
    return mixing.mix_report(spark, mixing.draw(tokens, weights), report)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    tokens = materialize(mixing.with_tokens(table(spark, d, "documents")), "tokens")
    weights, _ = mixing.plan(tokens, table(spark, d, "mix_targets"))
    return mixing.draw(tokens, weights)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "doc_labels")).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(abuse.scores(table(spark, d, "documents"), table(spark, d, "doc_labels")))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    return abuse.quality(table(spark, d, "documents"), table(spark, d, "doc_labels"))


P9_SQL = """
with t as (select source, sum(case when trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' then 0 else ceil(length(text) / 4.0) end) n
  from documents where source is not null and text is not null group by 1)
select m.mix_name, m.source from mix_targets m left join t using (source)
where m.max_repeats * coalesce(t.n, 0) < (select sum(n) from t) * m.budget_pct / 100 * m.target_pct / 100
"""

QUERIES = {f.__name__: f for f in (p5_found, p5_rates, p6_found, p6_rates, p8_found, p8_report, p9_found, p9_report, p9_mix, p10_found, p10_scores, p10_rates, p10_quality)}
SQL = {"p9_found": P9_SQL}
