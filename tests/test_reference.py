"""Text, layout, element, chunk and file operators on golden rows."""

import pytest
from pyspark.sql import functions as F

from loam.functions import layout
from loam.functions import text as T
from loam.operators import chunking, elements, evalops, generator, prompts, sft, taxonomy
from loam.sources import files
from loam.streaming.batches import run_batches


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize("f, given, want", [
    (T.clean_text, " \xa0a\n\n\n\nb\x1c ", "a\n\nb"), (T.estimate_tokens, "", 0), (T.estimate_tokens, "abc", 1), (T.estimate_tokens, "abcde", 2), (T.estimate_tokens, None, 0),
    (T.join_title_lines, "a\nb\n\nc", "a b\n\nc"), (T.join_paragraph_lines, "a\nb\n\nc\n- d", "a b\n c\n- d"), (T.join_paragraph_lines, "x\na) y", "x\na) y"), (T.join_hyphenated, "infor-\nmatique", "informatique"),
    (T.sentences, "A b.  C!\nD", ["A b.", "C!", "D"]), (T.paragraphs, "a\n\n \n\nb ", ["a", "b"]), (T.lines, " a \x85\nb", ["a", "b"]), (lambda c: T.hard_split(c, 2), "abcde", ["ab", "cd", "e"]),
    (lambda c: layout.repair(c, "key_value"), "url: http://x", "url: http: //x"), (lambda c: layout.repair(c, "code"), "  def f():\n    x  ", "def f():\n    x"),
    (lambda c: T.insert_needle(c, F.lit("N"), "milieu"), "a b  c d", "a b N c d"), (lambda c: T.insert_needle(c, F.lit("N"), "fin"), "", "N"), (T.basename, "/a/b.gguf", "b.gguf"),
    (sft.decision, '{"final_decision":"ACCEPT"}', "ACCEPT"), (sft.decision, "{}", "REVIEW"), (evalops.perplexity, "Final estimate: PPL = 4.5 x", 4.5),
])
def test_scalar(spark, f, given, want):
    assert one(spark, given, f) == want


def test_product_and_valid_plans(spark):
    assert taxonomy.product(spark).count() == 19_440
    plans = taxonomy.valid_plans(taxonomy.product(spark))
    assert plans.count() == 4_464 and plans.agg(F.max("plan_id")).first()[0] == "plan_04463"


def test_strict_join_fails_for_an_unknown_plan(spark):
    plans = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "plan_id string, x string, pos int")
    rows = spark.createDataFrame([("p",), ("q",)], "plan_id string")
    assert taxonomy.with_plan(rows, plans, strict=False).first().plan_x == "b"
    with pytest.raises(Exception, match="unknown plan q"):
        taxonomy.with_plan(rows, plans).collect()


ROWS = [
    ("d", 0, "e0", "title", 1, None, "A"), ("d", 1, "e1", "paragraph", 1, None, "p" * 40), ("d", 2, "e2", "paragraph", 1, 3, "q" * 40), ("d", 3, "e3", "section_header", 2, 3, "B"),
    ("d", 4, "e4", "table", 1, 4, "|h|\n|-|\n" + "\n".join(f"|row {i}|" for i in range(30))), ("d", 5, "e5", "section_header", 2, 4, "C"), ("d", 6, "e6", "paragraph", 1, 5, " ".join(f"Sentence number {i} here." for i in range(40))),
    ("d", 7, "e7", "title", 1, 6, "D"), ("d", 8, "e8", "formula", 1, 6, "x" * 900), ("d", 9, "e9", "paragraph", 1, 6, "z" * 170), ("d", 10, "e10", "paragraph", 1, 6, "y" * 170), ("h", 0, "e0", "title", 1, 1, "only"),
]


def test_parents_and_children(spark):
    el = spark.createDataFrame(ROWS, "doc_id string, pos int, element_id string, element_type string, level int, page_no int, normalized_text string").withColumn("reject_reason", F.lit(None).cast("string"))
    limits = chunking.Limits(40, 60, 5, 20, 30, 5, 4)
    ps = sorted(chunking.parents(el, limits).collect(), key=lambda r: (r.pos, r.split_index))
    assert [r.title_context for r in ps if r.split_index == 0] == [["A"], ["A", "B"], ["A", "C"], ["D"], ["D"], ["D"]]
    assert ps[0].page_no == 3 and ps[0].element_ids == ["e1", "e2"] and ps[0].text == "p" * 40 + "\n\n" + "q" * 40
    assert all(len(r.text) <= 160 for r in ps if r.split_count > 1) and len({r.parent_id for r in ps}) == len(ps)
    cs = chunking.children(chunking.parents(el, limits), limits).collect()
    table = [r.text for r in cs if r.parent_type == "table"]
    assert len(table) > 1 and all(t.startswith("|h|\n|-|\n") for t in table)
    assert [r.child_origin for r in cs if r.parent_type == "formula"] == ["single_child_from_parent"]
    with pytest.raises(Exception, match="no parent"):
        chunking.parents(el.where("doc_id = 'h'"), limits, strict=True).collect()
    with pytest.raises(ValueError):
        chunking.Limits(40, 30, 5, 20, 30, 5)


def test_elements(spark):
    raw = spark.createDataFrame([("d", 0, "e0", "TextItem", "Texte\xa0avec​ bruit"), ("d", 1, "e1", "ListGroup", "x"), ("d", 2, "e2", "Odd", " ​")], "doc_id string, pos int, element_id string, docling_class string, raw_text string")
    got = {r.element_id: r for r in elements.normalized(raw).collect()}
    assert got["e0"].normalized_text == "Texte avec bruit" and got["e1"].reject_reason == "structural" and got["e2"].reject_reason
    assert elements.document_heads(elements.normalized(raw)).first().element_count == 1


def test_split_sizes(spark):
    rows = [(f"{n}-{i}", str(n)) for n in (1, 4, 5, 10) for i in range(n)]
    got = sft.split(spark.createDataFrame(rows, "id string, challenge_type string"), "id").where("split = 'train'").groupBy("challenge_type").count().collect()
    assert {r.challenge_type: r["count"] for r in got} == {"4": 3, "5": 4, "10": 8}


def test_files_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("é", "a"), (None, "b")], "x string, route string")
    files.write_jsonl(df, f"{tmp_path}/j")
    assert files.read_jsonl(spark, f"{tmp_path}/j", df.schema).count() == 2
    assert files.read_jsonl_untyped(spark, f"{tmp_path}/j").where("v is not null").count() == 2
    files.write_routed(df, f"{tmp_path}/r", "route")
    assert spark.read.json(f"{tmp_path}/r/route=a").first().x == "é"
    files.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    (tmp_path / "doc.json").write_text('[{"x": "1"},\n {"x": "2"}]')
    assert files.read_json(spark, f"{tmp_path}/doc.json", "x string").count() == 2
    assert files.read_text(spark, f"{tmp_path}/doc.json").first().text.count("\n") == 1
    stream = spark.readStream.schema(df.schema).json(f"{tmp_path}/j")
    run_batches(stream, lambda d: d.where("x is not null"), f"{tmp_path}/s", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s").count() == 1


def test_generator_reports_errors(spark):
    def call(p):
        if not p:
            raise ValueError("empty")
        return p[::-1]

    got = generator.generated(spark.createDataFrame([("ab",), ("",)], "prompt string"), call).collect()
    assert got[0].text == "ba" and got[1].error == "ValueError: empty"


def test_repairs_and_unicode_run_on_the_texts_of_documents(spark, tmp_path):
    from loam.plans import reference

    rows = [(1, reference._SAMPLE), (2, None), (3, "a\xa0b\u200bc ﬁn…²")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for kind, golden in reference._GOLDEN.items():
        got = dict(reference.QUERIES[f"layout_{kind}_documents"](spark, str(tmp_path)).collect())
        assert got[1] == golden and got[2] == "" and len(got) == 3, kind
    got = dict(reference.QUERIES["unicode_normalize_documents"](spark, str(tmp_path)).collect())
    assert got[2] == "" and got[3] == "a bc fin...2"


def test_prompts_carry_their_axes_and_fail_for_an_unknown_value(spark):
    plan = {a: v[0] for a, v in taxonomy.AXES.items()}
    df = spark.createDataFrame([(*plan.values(), "do", None, "done")], ", ".join(f"{c} string" for c in [*plan, "instruction", "context", "response"]))
    row = df.select(prompts.context_prompt().alias("c"), prompts.example_prompt().alias("e"), prompts.verdict_prompt().alias("v")).first()
    assert prompts.PHRASES["difficulty"][plan["difficulty"]] in row.c and "Anglais" in row.c and "{" not in row.c
    assert all(plan[a] in row.e for a in ("task_type", "output_format", "constraint_type")) and all(v in row.v for v in plan.values()) and "do" in row.v
    with pytest.raises(Exception, match="no phrase for other"):
        df.withColumn("difficulty", F.lit("other")).select(prompts.context_prompt()).collect()


def test_attached_keys_replace_fields_of_the_same_name(spark):
    rows = [('{"a": 1, "plan_id": "old"}',), ("text",), (None,), ('{"a"',), ("{}",)]
    got = spark.createDataFrame(rows, "s string").select(sft.with_keys(F.col("s"), plan_id=F.lit("p"), extra=F.lit(None)).alias("m")).collect()
    assert got[0].m == {"a": "1", "plan_id": "p", "extra": None} and got[1].m is None and got[2].m is None and got[4].m == {"plan_id": "p", "extra": None}


def test_duplicate_flags_keep_the_smallest_id_of_equal_texts(spark):
    rows = [(3, "a ", None, "r"), (2, " a", "", "r"), (2, " a", "", "r"), (5, "b", "", "r")]
    flags = sft.duplicate_flags(spark.createDataFrame(rows, "example_id bigint, instruction string, context string, response string"), "example_id")
    assert sorted(map(tuple, flags.collect())) == [(2, True), (3, False), (5, True)]


def test_json_document_csv_and_document_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "é \"q\" \n x "), (1, None), (3, "")], "id int, s string")
    files.write_json(df, f"file://{tmp_path}/j", "id")
    assert [tuple(r) for r in files.read_json(spark, f"file://{tmp_path}/j", "id int, s string").collect()] == [(1, None), (2, "é \"q\" \n x "), (3, "")]
    files.write_csv(df, f"file://{tmp_path}/c")
    files.write_csv(df.where("id = 2"), f"file://{tmp_path}/c", append=True)
    back = files.read_csv(spark, f"file://{tmp_path}/c", "id int, s string")
    assert sorted(map(tuple, back.collect()), key=str) == [(1, None), (2, "é \"q\" \n x "), (2, "é \"q\" \n x "), (3, "")]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# é", encoding="utf-8")
    doc = files.read_documents(spark, f"file://{tmp_path}/docs").first()
    assert (doc.markdown, doc.metadata.file_name, doc.metadata.n_chars) == ("# é", "a.md", 3)
    with pytest.raises(Exception, match="a document is empty"):
        files.read_documents(spark, f"file://{tmp_path}/docs", lambda path, content: "").collect()


def test_parents_tell_their_metadata_and_strict_documents_fail(spark):
    schema = "doc_id string, pos int, element_id string, element_type string, level int, page_no int, normalized_text string, reject_reason string, metadata struct<element_count:int,caption_text:string,num_rows:int>"
    el = spark.createDataFrame([("d", 0, "t", "table", 1, 2, "|a|", None, (None, "cap", 4)), ("d", 1, "f", "form", 1, 2, "x: y", None, (7, None, None)), ("d", 2, "p", "paragraph", 1, None, "text", None, None)], schema)
    limits = chunking.Limits(40, 60, 5, 20, 30, 5, 4)
    got = {r.parent_type: r.metadata for r in chunking.parents(el, limits).collect()}
    assert (got["table"].element_count, got["table"].caption_text, got["table"].num_rows, got["table"].source_element_type) == (1, "cap", 4, "table")
    assert got["form"].element_count == 7 and got["narrative_section"].element_count == 1 and got["narrative_section"].element_types == ["paragraph"]
    with pytest.raises(Exception, match="no parent chunk"):
        chunking.parents(el.withColumn("element_type", F.lit("title")), limits, strict=True).collect()
    for bad in ((60, 40, 5, 20, 30, 5, 0), (40, 60, 5, 20, 30, 5, 30), (40, 60, 0, 20, 30, 5, 0)):
        with pytest.raises(ValueError):
            chunking.Limits(*bad)
    assert chunking.parents(el.limit(0), limits).count() == 0 and chunking.children(chunking.parents(el.limit(0), limits), limits).count() == 0


def test_a_parent_that_only_its_blanks_make_too_long_counts_as_split(spark):
    limits = chunking.Limits(40, 60, 5, 20, 30, 5, 0)
    rows = spark.createDataFrame([("p", "d", "mixed", None, ["e"], "w" * 119 + "  ")], "parent_id string, doc_id string, parent_type string, page_no int, element_ids array<string>, text string")
    got = chunking.children(rows, limits).first()
    assert (got.child_origin, got.child_count, got.text) == ("split_from_parent", 1, "w" * 119)


def test_tokens_decode_to_the_text(spark):
    import os

    from loam.functions.tokenizer import VOCABULARY, Tokenizer
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary file here")
    code = Tokenizer(spark)
    df = spark.createDataFrame([("héllo  wörld 🙂\n",), ("",), (None,)], "s string").select("s", code.encode(F.col("s")).alias("t"), code.count(F.col("s")).alias("n"))
    assert [(r.s, r.back, r.n == len(r.t or [])) for r in df.select("*", code.decode(F.col("t")).alias("back")).collect()] == [("héllo  wörld 🙂\n", "héllo  wörld 🙂\n", True), ("", "", True), (None, None, True)]
