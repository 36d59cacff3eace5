"""Document elements: types, normalisation, rejects and document hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.layout import repair_by_type
from loam.functions.text import WS, is_blank, normalize_unicode

#: parsers' class names and the types they stand for.
TYPES = {
    "TitleItem": "title", "SectionHeaderItem": "section_header", "TextItem": "paragraph", "ListGroup": "list_group",
    "ListItem": "list_item", "TableItem": "table", "PictureItem": "picture", "KeyValueItem": "key_value",
    "CodeItem": "code", "FormulaItem": "formula", "FormItem": "form",
}
HEADINGS, SPECIAL = ("title", "section_header"), ("table", "code", "formula", "form")


def element_type(cls: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, cls), F.lit("unknown"))


def sha256_id(*parts: Column) -> Column:
    """Digest of parts joined by a bar; a null part counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, pos, element_id, docling_class, level, page_no, raw_text, metadata): a Markdown text's blocks between empty lines as raw elements.

    A table's rows are its lines that hold a letter or digit or no dash, its columns the cells of its first line. Markdown has no pages and no captions.
    """
    parts = documents.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n{2,}")).alias("pos", "raw_text"))
    first = F.ltrim("raw_text")
    cls = (
        F.when(first.startswith("# "), "TitleItem").when(first.startswith("#"), "SectionHeaderItem").when(first.startswith("```"), "CodeItem")
        .when(first.startswith("|"), "TableItem").when(first.rlike(r"^[-*•]\s"), "ListItem").otherwise("TextItem")
    )
    level = F.greatest(F.length(F.regexp_extract(first, "^(#+)", 1)), F.lit(1))
    raw = F.when(cls.isin("TitleItem", "SectionHeaderItem"), F.regexp_replace(first, rf"^#+{WS}*", "")).otherwise(F.col("raw_text"))
    rows = F.filter(F.split("raw_text", "\n"), lambda x: ~is_blank(x))
    inner = F.regexp_replace(F.element_at(rows, 1), rf"^{WS}*[|]|[|]{WS}*$", "")
    table = lambda c: F.when(cls == "TableItem", c)
    metadata = F.struct(
        cls.alias("docling_class"), F.lit(None).cast("string").alias("caption_text"), table(F.size(F.filter(rows, lambda x: ~x.rlike(r"^[|:\- \t]*-[|:\- \t]*$")))).alias("num_rows"),
        table(F.size(F.split(inner, "[|]"))).alias("num_cols"), level.alias("docling_level"))
    return parts.select("doc_id", "pos", F.format_string("el_%06d", "pos").alias("element_id"), cls.alias("docling_class"), level.alias("level"), F.lit(None).cast("int").alias("page_no"), raw.alias("raw_text"), metadata.alias("metadata"))


def with_provenance(elements: DataFrame, prov: str = "prov") -> DataFrame:
    """``elements`` with ``page_no`` and ``bbox`` of the first entry of ``prov`` (array of page_no and bbox), null where there is none."""
    first = F.try_element_at(prov, F.lit(1))
    return elements.withColumns({"page_no": first["page_no"].cast("int"), "bbox": first["bbox"]}).drop(prov)


def normalized(elements: DataFrame) -> DataFrame:
    """Elements with ``element_type``, ``normalized_text`` and ``reject_reason``; other columns, such as bbox and metadata, stay.

    List groups carry no text of their own, and blank texts, before or after the repair, are of no use; both are rejected.
    """
    out = elements.withColumn("element_type", element_type(F.col("docling_class")))
    out = out.withColumn("normalized_text", repair_by_type(normalize_unicode(F.col("raw_text")), F.col("element_type")))
    reason = F.when(F.col("element_type") == "list_group", "structural").when(is_blank(F.col("raw_text")), "blank").when(is_blank(F.col("normalized_text")), "blank after repair")
    return out.withColumn("reject_reason", reason)


def document_heads(elements: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, content_hash, element_count) over the accepted elements in order; a document without any fails if ``strict``, else it has no row."""
    ok = F.col("reject_reason").isNull()
    texts = F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "normalized_text")))), lambda e: e["normalized_text"])
    out = elements.groupBy("doc_id").agg(F.sha2(F.array_join(texts, "\n\n"), 256).alias("content_hash"), F.count_if(ok).alias("element_count"))
    if strict:
        return out.where(F.when(F.col("element_count") == 0, F.raise_error(F.lit("a document has no usable element")).cast("boolean")).otherwise(F.lit(True)))
    return out.where("element_count > 0")
