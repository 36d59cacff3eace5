"""Files in and out: JSON lines, JSON documents, whole texts, parsed documents, CSV, and one output a route."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_untyped(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as text (``value``) and variant (``v``), null where a line is malformed."""
    return spark.read.text(path).select("value", F.try_parse_json("value").alias("v"))


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A whole JSON document, an object or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_documents(spark: SparkSession, path: str, parse: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """(source_path, markdown, metadata): files parsed to Markdown, in Arrow batches.

    ``parse`` takes a file's path and bytes and returns its Markdown; where none is given, files are read as UTF-8 text. A PDF needs a
    parser with OCR and layout of its own, which is handed in here. An empty result fails the job, as a document must have some text.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parser = parse or (lambda _, content: content.decode("utf-8"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [parser(p, bytes(c)) for p, c in zip(frame["path"], frame["content"])]
            if not all(texts):
                raise ValueError("a document is empty")
            yield pd.DataFrame({"source_path": frame["path"], "markdown": texts})

    named = F.struct(F.element_at(F.split("source_path", "/"), -1).alias("file_name"), F.length("markdown").alias("n_chars"))
    return files.mapInPandas(run, "source_path string, markdown string").withColumn("metadata", named)


def as_json_array(df: DataFrame, *order: str) -> DataFrame:
    """(json): all rows of a report as one JSON array of objects, in the order of the given columns. For results that fit one row."""
    row = F.struct(*df.columns)
    return df.select(F.struct(*order).alias("at"), row.alias("row")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """A report as one JSON document, non-ASCII letters kept."""
    as_json_array(df, *order).coalesce(1).write.mode("overwrite").text(path)


#: Blanks, quotes and empty texts of fields survive; a null is written as \\N.
CSV = {"header": True, "nullValue": "\\N", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header in each file; ``append`` adds files to those that are there."""
    df.write.mode("append" if append else "overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV, multiLine=True, emptyValue="").csv(path)


def write_routed(df: DataFrame, path: str, by: str) -> None:
    """One folder a value of ``by``, disjoint, in one pass over the data."""
    df.write.mode("overwrite").partitionBy(by).json(path)
