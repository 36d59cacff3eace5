"""Parent and child chunks: ordered elements are packed into parents, parents are cut into children.

One Arrow pass reads each document, or parent, once and in order; texts are measured by their lengths, so packing is linear.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.elements import HEADINGS, SPECIAL, sha256_id


@dataclass(frozen=True)
class Limits:
    """Sizes in estimated tokens; the least sizes are only checked, nothing is merged for their sake."""

    parent_target: int
    parent_max: int
    parent_min: int
    child_target: int
    child_max: int
    child_min: int
    overlap: int = 0

    def __post_init__(self):
        if not (0 < self.parent_min <= self.parent_target <= self.parent_max and 0 < self.child_min <= self.child_target <= self.child_max):
            raise ValueError("limits must satisfy 0 < min <= target <= max")
        if not 0 <= self.overlap < self.child_max:
            raise ValueError("overlap must be at least 0 and below child_max")


def size(text: str) -> int:
    """Tokens estimated as a quarter of the code points, rounded up; 0 for blank text."""
    return -(-len(text) // 4) if text.strip() else 0


def sentences(text: str) -> list[str]:
    return [x for p in re.split(r"(?<=[.!?])\s+", text) if (x := p.strip())]


def paragraphs(text: str) -> list[str]:
    return [x for p in text.split("\n\n") if (x := p.strip())]


def lines(text: str, keep_indent: bool = False) -> list[str]:
    return [x.rstrip() if keep_indent else x.strip() for x in text.splitlines() if x.strip()]


def hard_split(text: str, chars: int) -> list[str]:
    return [x for i in range(0, len(text), chars) if (x := text[i:i + chars].strip())]


def packed(parts: list[str], target: int, joiner: str, most: int | None = None, finer: Callable[[str], list[str]] | None = None, frame: str = "") -> list[str]:
    """Greedy packing of non-blank texts: joined as long as the estimate stays within ``target``.

    A part over ``most`` on its own is replaced by ``finer`` of it. ``frame`` is put before each pack and counts for its size.
    """
    out, held, length = [], [], 0
    head = frame + joiner if frame else ""

    def flush() -> None:
        nonlocal held, length
        if held:
            out.append(head + joiner.join(held))
        held, length = [], 0

    for x in parts:
        longer = length + (len(joiner) if held else 0) + len(x)
        if -(-(len(head) + longer) // 4) <= target:
            held.append(x)
            length = longer
            continue
        flush()
        if most is not None and size(x) > most:
            out += finer(x)
        else:
            held, length = [x], len(x)
    flush()
    return out


def split_text(text: str, target: int, most: int) -> list[str]:
    """A text over ``most`` as packs of sentences, sentences over ``most`` cut hard; else the text itself."""
    if size(text) <= most:
        return [text]
    parts = sentences(text)
    return packed(parts, target, " ", most, lambda x: hard_split(x, most * 4)) if parts else hard_split(text, most * 4)


def with_overlap(texts: list[str], tokens: int, most: int) -> list[str]:
    """Each text but the first with the end of the one before in front, where it then stays within ``most``."""
    out = texts[:1]
    for before, x in zip(texts, texts[1:]):
        tail = before[-tokens * 4:].strip() if tokens > 0 else ""
        longer = f"{tail}\n\n{x}"
        out.append(longer if tail and size(longer) <= most else x)
    return out


def table_split(text: str, target: int) -> list[str]:
    """Packs of rows, each below the table's first two lines; tables of fewer than three lines stay whole."""
    rows = lines(text)
    return packed(rows[2:], target, "\n", frame="\n".join(rows[:2])) if len(rows) > 2 else [text.strip()]


def pieces(text: str, kind: str, limits: Limits) -> list[str]:
    """Texts of a parent's children."""
    target, most = limits.child_target, limits.child_max
    if kind == "formula" or size(text) <= most:
        return [text]
    if kind in ("narrative_section", "paragraph", "mixed"):
        return with_overlap(packed(paragraphs(text), target, "\n\n", most, lambda x: split_text(x, target, most)), limits.overlap, most)
    if kind == "table":
        return table_split(text, target)
    if kind in ("code", "form"):
        return packed(lines(text, kind == "code"), target, "\n")
    return split_text(text, target, most)


#: What a parent tells of itself; a standalone parent takes its element's own values where it has them.
METADATA = "source_element_type string, element_count int, element_types array<string>, docling_class string, caption_text string, num_rows int, num_cols int, docling_level int"
PARENT = "doc_id string, pos int, split_index int, split_count int, element_ids array<string>, element_types array<string>, page_no int, parent_type string, title_context array<string>, named string, text string, metadata string"


def parents(elements: DataFrame, limits: Limits, strict: bool = False) -> DataFrame:
    """Parent chunks of normalised elements (those with a reject reason are left out).

    Headings close the open parent and set the title path, special elements stand alone, a narrative element over the
    limit is cut by sentences, all others are collected up to the target. One document is read in order by one task; its
    elements must fit there. A document without any parent has no row, or fails if ``strict``. A column ``metadata`` (struct) of the
    elements, if there is one, goes into that of standalone parents and overrides its defaults.
    """
    rows = elements.where("reject_reason is null")
    own = (F.to_json("metadata") if "metadata" in elements.columns else F.lit(None).cast("string")).alias("metadata")
    kept = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "element_id", "element_type", "level", "page_no", "normalized_text", own))).alias("list"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, items in zip(frame["doc_id"], frame["list"]):
                start, nth, path, held, text = len(out), 0, [], [], ""

                def emit(group, kind, body, parts=None, meta=None):
                    nonlocal nth
                    page = next((int(e["page_no"]) for e in group if e["page_no"] is not None), None)
                    ids, types = [e["element_id"] for e in group], [e["element_type"] for e in group]
                    told = json.dumps(meta or {"element_count": len(group), "element_types": types})
                    for i, part in enumerate(parts or [body]):
                        out.append((doc, nth, i, len(parts or [body]), ids, types, page, kind, list(path), f"{i}|{part}" if parts else part, part, told))
                    nth += 1

                for e in items:
                    body, kind = e["normalized_text"].strip(), e["element_type"]
                    narrative = kind not in HEADINGS and kind not in SPECIAL
                    big = narrative and size(e["normalized_text"]) > limits.parent_max
                    if held and (not narrative or big or size(text) + size(e["normalized_text"]) > limits.parent_max):
                        emit(held, "narrative_section", text)
                        held, text = [], ""
                    if kind in HEADINGS:
                        path = path[:max(1, e["level"] or 1) - 1] + [body]
                    elif not narrative:
                        emit([e], kind, body, meta={"source_element_type": kind, "element_count": 1} | json.loads(e["metadata"] or "{}"))
                    elif big:
                        emit([e], "narrative_section", None, split_text(e["normalized_text"], limits.parent_target, limits.parent_max))
                    else:
                        held, text = held + [e], body if not text else f"{text}\n\n{body}"
                        if size(text) >= limits.parent_target:
                            emit(held, "narrative_section", text)
                            held, text = [], ""
                if held:
                    emit(held, "narrative_section", text)
                if strict and len(out) == start:
                    raise ValueError("a document has no parent chunk")
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PARENT.split(", ")]).astype({"page_no": "Int32"})

    found = kept.mapInPandas(scan, PARENT)
    payload = F.concat_ws("|", "doc_id", F.array_join("element_ids", "|"), F.substring("named", 1, 200))
    return found.select(
        F.sha2(payload, 256).alias("parent_id"), "doc_id", "pos", "split_index", "split_count", "page_no", "element_ids", "element_types", "parent_type", "title_context", T.strip(F.col("text")).alias("text"),
        F.from_json("metadata", METADATA).alias("metadata"))


def children(parent_chunks: DataFrame, limits: Limits) -> DataFrame:
    """Child chunks: a parent within the limit is one child; else narrative text goes by paragraphs and sentences with overlap, tables by rows, code and forms by lines, formulas stay whole."""
    t = F.col("text")
    rows = parent_chunks.where(~T.is_blank(t)).select("parent_id", "doc_id", "parent_type", "page_no", "element_ids", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kinds = b.column("text").to_pylist(), b.column("parent_type").to_pylist()
            cut, whole = [pieces(x, k, limits) for x, k in zip(texts, kinds)], [k == "formula" or size(x) <= limits.child_max for x, k in zip(texts, kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(whole, pa.bool_()), pa.array(cut, pa.list_(pa.string()))], [*b.schema.names[:-1], "fits", "texts"])

    found = rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes[:-1]) + ", fits boolean, texts array<string>")
    found = found.select(*found.columns[:-1], F.size("texts").alias("child_count"), F.posexplode("texts").alias("child_index", "text")).where(~T.is_blank(t))
    return found.select(
        sha256_id(F.col("parent_id"), F.col("child_index"), F.substring("text", 1, 200)).alias("child_id"), "parent_id", "doc_id", "page_no", "element_ids", "parent_type",
        F.when(F.col("fits"), "single_child_from_parent").otherwise("split_from_parent").alias("child_origin"), "child_index", "child_count", T.strip(t).alias("text"))
