"""Text generators as a stage of a plan: one call a row, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def generated(prompts: DataFrame, call: Callable[[str], str], retries: int = 2) -> DataFrame:
    """``prompts`` with ``text`` and ``error``, the answer to column ``prompt`` or what went wrong at the last try.

    The result is not repeatable with a real generator: write it before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for p in b.column("prompt").to_pylist():
                text = error = None
                for _ in range(retries + 1):
                    try:
                        text, error = call(p or ""), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a generator raises is that row's error
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "text", "error"])

    return prompts.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", text string, error string")


def echo(prompt: str) -> str:
    """A deterministic stand-in: a verdict whose decision depends on the prompt's length."""
    return '{"final_decision": "%s"}' % ("ACCEPT", "REJECT", "REVIEW")[len(prompt) % 3]
