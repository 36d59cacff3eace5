"""Queries of the dataset, document, chunk and evaluation operators, by name, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import layout
from loam.functions import text as T
from loam.functions.tokenizer import Tokenizer
from loam.operators import chunking, elements, evalops, generator, prompts, sft, taxonomy
from loam.plans import sql as S
from loam.session import fresh_path, materialize, table
from loam.sources import files

WS = S.WS
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


_PRODUCT = "select * from " + " cross join ".join(f"unnest([{', '.join(repr(v) for v in vs)}]) u{i}({a})" for i, (a, vs) in enumerate(taxonomy.AXES.items()))
_AXES = ", ".join(taxonomy.AXES)
#: One row an example: rows that repeat an id have equal content.
_SFT = "(select distinct on (example_id) * from sft_examples order by example_id, ingested_at)"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _examples(spark: SparkSession, d: str, *columns) -> DataFrame:
    """One row an example with the columns given, which are computed before rows that repeat an id are dropped, so that few bytes are shuffled."""
    rows = table(spark, d, "sft_examples")
    return (rows.select("example_id", *columns) if columns else rows).dropDuplicates(["example_id"])


@query(f"select challenge_type, count(*) plans from ({_PRODUCT}) group by 1")
def taxonomy_product_counts(spark, d):
    return taxonomy.product(spark).groupBy("challenge_type").agg(F.count("*").alias("plans"))


@query(f"select plan_id, {_AXES} from plans")
def taxonomy_valid_plans(spark, d):
    return taxonomy.valid_plans(taxonomy.product(spark)).select("plan_id", *taxonomy.AXES)


@query("""select plan_id, challenge_type from (select *, row_number() over (partition by challenge_type order by sha256('42|' || plan_id), plan_id) r from plans) where r <= 20""")
def plan_sample_20(spark, d):
    plans = taxonomy.valid_plans(taxonomy.product(spark))
    return sft.sample_per_group(plans, "plan_id", "challenge_type", 20).select("plan_id", "challenge_type")


def _filled(template: str, spelled: dict[str, dict[str, str]] = {}, of: str = "") -> str:
    """``template`` as an SQL text: names in braces are columns, some spelled as phrases."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        c = "case when task_type = 'translate_en_to_fr' then 'Anglais' else 'Français' end" if name == "language" else f"coalesce({of}{name}, '')"
        if name in spelled:
            c = f"case {of}{name} {' '.join(f'when {_literal(k)} then {_literal(v)}' for k, v in spelled[name].items())} end"
        parts += [_literal(before), c]
    return " || ".join([*parts, _literal(rest)])


@query(f"select 'ctx_' || plan_id context_id, plan_id, {_filled(prompts.CONTEXT, prompts.PHRASES)} prompt_text from plans")
def plan_prompt_expand(spark, d):
    return table(spark, d, "plans").select(F.concat(F.lit("ctx_"), "plan_id").alias("context_id"), "plan_id", prompts.context_prompt().alias("prompt_text"))


@query(f"select plan_id, {_filled(prompts.EXAMPLE)} prompt_text from plans")
def example_prompts(spark, d):
    return table(spark, d, "plans").select("plan_id", prompts.example_prompt().alias("prompt_text"))


_JUDGED = ", ".join(f"p.{a}" for a in taxonomy.AXES)


@query(f"select example_id, {_filled(prompts.VERDICT)} prompt_text from (select e.example_id, e.instruction, e.context, e.response, {_JUDGED} from {_SFT} e join plans p using (plan_id))")
def verdict_prompts(spark, d):
    joined = taxonomy.with_plan(_examples(spark, d, "instruction", "context", "response", "plan_id"), table(spark, d, "plans"), strict=False)
    return joined.select("example_id", prompts.verdict_prompt(of="plan_").alias("prompt_text"))


_OBJECT = "case when ltrim(response, ' ')[:1] = '{' then try_cast(try_cast(response as json) as map(varchar, varchar)) end"


@query(f"""select example_id, array_to_string(list_sort(list_distinct(map_keys(o) || ['plan_id', 'challenge_type'])), '|') fields, plan_id, challenge_type
  from (select *, {_OBJECT} o from {_SFT}) where o is not null""")
def answer_keys(spark, d):
    """JSON answers with the plan's keys attached."""
    made = sft.with_keys(F.col("response"), plan_id=F.col("plan_id"), challenge_type=F.col("challenge_type"))
    rows = _examples(spark, d, made.alias("o")).where("o is not null")
    return rows.select("example_id", F.array_join(F.array_sort(F.map_keys("o")), "|").alias("fields"), F.col("o")["plan_id"].alias("plan_id"), F.col("o")["challenge_type"].alias("challenge_type"))


@query(f"select e.example_id, p.task_type, p.output_format from {_SFT} e join plans p using (plan_id)")
def plan_join(spark, d):
    joined = taxonomy.with_plan(_examples(spark, d, "plan_id"), table(spark, d, "plans"), strict=False)
    return joined.select("example_id", F.col("plan_task_type").alias("task_type"), F.col("plan_output_format").alias("output_format"))


@query(f"""select example_id, coalesce(length(instruction) >= 5 and length(context) >= 10 and length(response) >= 5 and plan_id is not null and challenge_type is not null, false) valid from {_SFT}""")
def sft_validate(spark, d):
    return _examples(spark, d, sft.valid_example().alias("valid"))


@query(f"""select example_id, coalesce(length(instruction) >= 5 and length(context) >= 10 and length(response) >= 5 and plan_id is not null and challenge_type is not null, false) valid from {_SFT}""")
def sft_validate_lines(spark, d):
    """The same over the examples as JSON lines; null fields are missing there."""
    line = F.to_json(F.struct("instruction", "context", "response", "plan_id", "challenge_type"))
    return _examples(spark, d, sft.valid_json_example(F.try_parse_json(line)).alias("valid"))


_LINES = (
    ("ok", '{"instruction":"abcde","context":"0123456789","response":"abcde","plan_id":"p","challenge_type":"c","more":1}', True),
    ("object", '{"instruction":"abcde","context":"0123456789","response":{"a":1},"plan_id":"p","challenge_type":"c"}', False),
    ("short", '{"instruction":"abcd","context":"0123456789","response":"abcde","plan_id":"p","challenge_type":"c"}', False),
    ("blank", '{"instruction":"     ","context":"0123456789","response":"abcde","plan_id":"p","challenge_type":"c"}', True),
    ("null", '{"instruction":"abcde","context":null,"response":"abcde","plan_id":"p","challenge_type":"c"}', False),
    ("missing", '{"instruction":"abcde","context":"0123456789","response":"abcde","plan_id":"p"}', False),
    ("broken", '{"instruction":', False),
)


@query("select * from (values " + ", ".join(f"('{n}', {str(v).lower()})" for n, _, v in _LINES) + ") t(name, valid)")
def sft_validate_json(spark, d):
    rows = spark.createDataFrame([(n, s) for n, s, _ in _LINES], "name string, value string")
    return rows.select("name", F.coalesce(sft.valid_json_example(F.try_parse_json("value")), F.lit(False)).alias("valid"))


_VERDICTS = (("a", '{"final_decision":"ACCEPT"}', "ACCEPT"), ("b", '{"final_decision":"REJECT"}', "REJECT"), ("c", '{"final_decision":"accept"}', "REVIEW"), ("d", "{}", "REVIEW"), ("e", "not json", "REVIEW"), ("f", "[1]", "REVIEW"), ("g", None, "REVIEW"))


@query("select * from (values " + ", ".join(f"('{n}', '{r}')" for n, _, r in _VERDICTS) + ") t(name, decision)")
def judge_route(spark, d):
    return spark.createDataFrame([(n, v) for n, v, _ in _VERDICTS], "name string, v string").select("name", sft.decision(F.col("v")).alias("decision"))


@query("select a, b, case when least(a, b) >= 4 then 'ACCEPT' when least(a, b) = 3 then 'REVIEW' else 'REJECT' end decision from range(1, 6) x(a), range(1, 6) y(b)")
def judge_score_rule(spark, d):
    a = spark.range(25).select((F.col("id") % 5 + 1).alias("a"), (F.floor(F.col("id") / 5) + 1).alias("b"))
    return a.select("a", "b", sft.decision_by_scores(F.col("a"), F.col("b")).alias("decision"))


@query(f"select doc_id, {S.clean('text')} as text from documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


_DEDUP = f"""select example_id, row_number() over (partition by sha256({S.clean("coalesce(instruction, '')")} || '|' || {S.clean("coalesce(response, '')")} || '|' || {S.clean("coalesce(context, '')")}) order by example_id) r from {_SFT}"""


@query(f"select example_id from ({_DEDUP}) where r = 1")
def dedup_keep(spark, d):
    return sft.duplicate_flags(table(spark, d, "sft_examples"), "example_id").where("first").select("example_id")


@query(f"select example_id from ({_DEDUP}) where r > 1")
def dedup_rejects(spark, d):
    return sft.duplicate_flags(table(spark, d, "sft_examples"), "example_id").where("not first").select("example_id")


_SPLIT = f"""select example_id, c challenge_type, case when row_number() over (partition by c order by sha256('42|' || example_id), example_id) <= (4 * count(*) over (partition by c)) // 5 then 'train' else 'val' end split
  from (select example_id, coalesce(challenge_type, 'Introuvable') c from {_SFT})"""


@query(_SPLIT)
def split_train_val(spark, d):
    return sft.split(_examples(spark, d, "challenge_type"), "example_id").select("example_id", "challenge_type", "split")


@query(f"select challenge_type, split, count(*) examples from ({_SPLIT}) group by all")
def split_counts(spark, d):
    return split_train_val(spark, d).groupBy("challenge_type", "split").agg(F.count("*").alias("examples"))


@query(f"""select count(*) examples, avg(length(coalesce(instruction, ''))) mean_instruction, avg(length(coalesce(context, ''))) mean_context, avg(length(coalesce(response, ''))) mean_response from {_SFT}""")
def dataset_stats(spark, d):
    return sft.statistics(_examples(spark, d, "instruction", "context", "response"))


@query(f"select challenge_type, count(*) examples from {_SFT} group by 1")
def challenge_counts(spark, d):
    return _examples(spark, d, "challenge_type").groupBy("challenge_type").agg(F.count("*").alias("examples"))


@query(f"select example_id, context || chr(10) || chr(10) || instruction prompt, response completion from {_SFT}")
def sft_format(spark, d):
    return sft.formatted(_examples(spark, d)).select("example_id", "prompt", "completion")


_LENGTHS = f"""select {S.tokens("context || chr(10) || chr(10) || instruction")} p, {S.tokens("response")} r from {_SFT}"""


@query(f"""select avg(p + r) mean_tokens, avg(p) mean_tokens_prompt, avg(r) mean_tokens_response, max(p + r) max_nb_tokens, max(p) max_nb_tokens_prompt, max(r) max_nb_tokens_response from ({_LENGTHS})""")
def token_stats(spark, d):
    return sft.token_summary(sft.token_lengths(sft.formatted(_examples(spark, d, "instruction", "context", "response"))))


@query()
def token_stats_bpe(spark, d):
    """The same with the tokens of a public vocabulary."""
    code, rows = Tokenizer(spark), sft.formatted(table(spark, d, "sft_examples"))
    counted = rows.select("example_id", code.count(F.col("prompt")).alias("nb_tokens_prompt"), code.count(F.col("completion")).alias("nb_tokens_response")).dropDuplicates(["example_id"])
    return sft.token_summary(counted.withColumn("nb_tokens", F.col("nb_tokens_prompt") + F.col("nb_tokens_response")))


@query("select doc_id, text, true same from documents")
def tokenizer_round_trip(spark, d):
    """Each text encoded and decoded again: byte-level tokens keep every sign."""
    code = Tokenizer(spark)
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw"), code.encode(F.col("text")).alias("tokens"))
    return docs.select("doc_id", code.decode(F.col("tokens")).alias("text"), "raw").select("doc_id", "text", F.col("text").eqNullSafe(F.col("raw")).alias("same"))


@query(f"select example_id from {_SFT} order by sha256('42|' || example_id), example_id limit 5")
def review_sample(spark, d):
    return sft.review_sample(table(spark, d, "sft_examples").select("example_id").distinct(), "example_id")


@query(f"select example_id from (select example_id, row_number() over (order by example_id) r, count(*) over () n from {_SFT}) where r <= (60 * n) // 100")
def dry_run_head(spark, d):
    return sft.head_share(table(spark, d, "sft_examples").select("example_id").distinct(), "example_id")


#: Inputs that exercise each step, and what each type must make of them.
_SAMPLE = "  Infor-\nmatique  et\tréseau \n sui\xad\nte\r\n\r\n\r\n\r\nfin:  a=b\n- point  un \n"
_GOLDEN = {
    "title": "Informatique et réseau suite\n\n\n\nfin: a=b - point un",
    "section_header": "Informatique et réseau suite\n\n\n\nfin: a=b - point un",
    "paragraph": "Informatique et réseau suite\n\n fin: a=b\n- point un",
    "list_group": "Informatique et réseau\nsuite\n\nfin: a=b\n- point un",
    "list_item": "Informatique et réseau suite\n\nfin: a=b - point un",
    "picture": "Informatique et réseau suite\n\nfin: a=b - point un",
    "table": "Infor-\nmatique et réseau\nsuite\n\nfin: a=b\n- point un",
    "key_value": "Informatique et réseau suite\n\nfin: a = b - point un",
    "code": "Infor-\nmatique  et\tréseau\n suite\n\nfin:  a=b\n- point  un",
    "formula": "Infor-\nmatique  et\tréseau\n suite\n\nfin:  a=b\n- point  un",
    "form": "Informatique et réseau\nsuite\n\nfin: a = b\n- point un",
    "unknown": "Infor-\nmatique et réseau\nsuite\n\nfin: a=b\n- point un",
}


def _layout(kind, spark, d):
    return spark.createDataFrame([(kind, _SAMPLE)], "kind string, raw string").select("kind", layout.repair(F.col("raw"), kind).alias("text"))


for _kind, _text in _GOLDEN.items():
    QUERIES[f"layout_{_kind}"] = partial(_layout, _kind)
    SQL[f"layout_{_kind}"] = f"select '{_kind}' kind, {_literal(_text)} as text"

def _layout_documents(kind, spark, d):
    return table(spark, d, "documents").select("doc_id", layout.repair(F.col("text"), kind).alias("text"))


for _kind in layout.STEPS:
    QUERIES[f"layout_{_kind}_documents"] = partial(_layout_documents, _kind)
    SQL[f"layout_{_kind}_documents"] = f"select doc_id, {S.repair('text', _kind)} as text from documents"


@query(f"select doc_id, case doc_id % {len(layout.STEPS)} {' '.join(f'when {i} then {S.repair(chr(116) + chr(101) + chr(120) + chr(116), k)}' for i, k in enumerate(layout.STEPS))} end as text from documents")
def layout_dispatch_documents(spark, d):
    """All kinds in one pass: each document is taken for an element of a kind that its id names."""
    kind = F.element_at(F.array(*map(F.lit, layout.STEPS)), (F.col("doc_id") % len(layout.STEPS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", layout.repair_by_type(F.col("text"), kind).alias("text"))


@query(f"select doc_id, {S.unicode_normalized('text')} as text from documents")
def unicode_normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_unicode(F.col("text")).alias("text"))


_UNICODE = (("nbsp", "a\xa0b​c", "a bc"), ("fi", "ﬁn…²\xad", "fin...2"), ("plain", "abc", "abc"), ("null", None, ""))


@query("select * from (values " + ", ".join(f"('{n}', {_literal(v)})" for n, _, v in _UNICODE) + ") t(name, text)")
def unicode_normalize(spark, d):
    return spark.createDataFrame([(n, s) for n, s, _ in _UNICODE], "name string, s string").select("name", T.normalize_unicode(F.col("s")).alias("text"))


@query("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in [*elements.TYPES.items(), ("Other", "unknown")]) + ") t(cls, element_type)")
def element_types(spark, d):
    return spark.createDataFrame([(k,) for k in [*elements.TYPES, "Other"]], "cls string").select("cls", elements.element_type(F.col("cls")).alias("element_type"))


@query(f"select doc_id, len(s) sentences, array_to_string(s, '|') joined from (select doc_id, {S.sentences('text')} s from documents where text is not null)")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).alias("sentences"), F.array_join(s, "|").alias("joined"))


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {S.strip('x')}), lambda x: x <> ''), '|') joined from documents where text is not null")
def paragraph_split(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.paragraphs(F.col("text")), "|").alias("joined"))


@query(f"select doc_id, array_to_string(list_filter(list_transform(range(0, greatest(1, ceil(length(text) / 500.0)::int)), lambda i: {S.strip('substring(text, (i * 500 + 1)::int, 500)')}), lambda x: x <> ''), '|') joined from documents where text is not null")
def hard_split(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.hard_split(F.col("text"), 500), "|").alias("joined"))


@query(f"select doc_id, {S.tokens('text')} tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def _normalized(spark, d):
    return elements.normalized(elements.blocks(table(spark, d, "documents").where("doc_id is not null"), "doc_id", "text"))


@query(S.ELEMENTS)
def elements_normalized(spark, d):
    return _normalized(spark, d).select("doc_id", "pos", "element_id", "element_type", "level", "page_no", "normalized_text", "reject_reason")


@query(f"""select doc_id, sha256(string_agg(normalized_text, chr(10) || chr(10) order by pos)) content_hash, count(*) element_count from ({S.ELEMENTS}) where reject_reason is null group by 1""")
def doc_content_hash(spark, d):
    return elements.document_heads(_normalized(spark, d))


def _limits(spark, d):
    rows = table(spark, d, "chunk_config").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("chunk_config must have exactly one row")
    c = rows[0]
    return chunking.Limits(c.parent_target_tokens, c.parent_max_tokens, c.parent_min_tokens, c.child_target_tokens, c.child_max_tokens, c.child_min_tokens, c.overlap_tokens)


def _flat(rows, *lists):
    """Lists as texts, parted by a bar."""
    return rows.withColumns({c: F.array_join(c, "|") for c in lists})


_FLAT = "parent_id, doc_id, pos, split_index, split_count, page_no, array_to_string(element_ids, '|') element_ids, array_to_string(element_types, '|') element_types, parent_type, array_to_string(title_context, '|') title_context, text"


@query(S.parents(S.ELEMENTS) + f" select {_FLAT} from parents")
def parents(spark, d):
    return _flat(chunking.parents(_normalized(spark, d), _limits(spark, d)), "element_ids", "element_types", "title_context").drop("metadata")


@query(S.ELEMENT_METADATA)
def element_metadata(spark, d):
    return _normalized(spark, d).select("doc_id", "pos", "docling_class", "metadata.num_rows", "metadata.num_cols", "metadata.docling_level")


@query(S.parents(S.ELEMENTS) + f""" select p.parent_id, len(p.element_ids)::int element_count, case when p.parent_type <> 'narrative_section' then p.parent_type end source_element_type, m.docling_class, m.num_rows, m.num_cols
  from parents p left join ({S.ELEMENT_METADATA}) m on p.parent_type <> 'narrative_section' and m.doc_id::varchar = p.doc_id and printf('el_%06d', m.pos) = p.element_ids[1]""")
def parent_metadata(spark, d):
    rows = chunking.parents(_normalized(spark, d), _limits(spark, d))
    return rows.select("parent_id", "metadata.element_count", "metadata.source_element_type", "metadata.docling_class", "metadata.num_rows", "metadata.num_cols")


@query(S.parents(S.ELEMENTS) + " select parent_id, array_to_string(title_context, ' > ') path from parents")
def title_context(spark, d):
    return chunking.parents(_normalized(spark, d), _limits(spark, d)).select("parent_id", F.array_join("title_context", " > ").alias("path"))


#: The parts of parent_chunk once more as elements, in the order of their ids: a heading before each part with a title, narrative parts as paragraphs.
_AGAIN = """
  select doc_id, row_number() over (partition by doc_id order by parent_id, sub)::int - 1 pos, parent_id || '/' || sub element_id, element_type, level, page_no, body normalized_text, null::varchar reject_reason
  from (select *, 0 sub, 'section_header' element_type, len(title_context)::int level, title_context[-1] body from (select distinct on (parent_id) * from parent_chunk) where len(title_context) > 0
    union all select *, 1, case parent_type when 'narrative_section' then 'paragraph' else parent_type end, 1, text from (select distinct on (parent_id) * from parent_chunk))"""


def _again(spark, d):
    rows = table(spark, d, "parent_chunk").dropDuplicates(["parent_id"])
    kind = F.when(F.col("parent_type") == "narrative_section", "paragraph").otherwise(F.col("parent_type"))
    head = F.struct(F.lit(0).alias("sub"), F.lit("section_header").alias("element_type"), F.size("title_context").alias("level"), F.element_at("title_context", -1).alias("body"))
    own = F.struct(F.lit(1).alias("sub"), kind.alias("element_type"), F.lit(1).alias("level"), F.col("text").alias("body"))
    rows = rows.select("doc_id", "parent_id", "page_no", F.explode(F.when(F.size("title_context") > 0, F.array(head, own)).otherwise(F.array(own))).alias("e"))
    pos = F.expr("row_number() over (partition by doc_id order by parent_id, e.sub) - 1")
    return rows.select("doc_id", pos.alias("pos"), F.concat("parent_id", F.lit("/"), "e.sub").alias("element_id"), "e.element_type", "e.level", "page_no", F.col("e.body").alias("normalized_text"), F.lit(None).cast("string").alias("reject_reason"))


@query(S.parents(_AGAIN) + f" select {_FLAT} from parents")
def parents_rebuilt(spark, d):
    return _flat(chunking.parents(_again(spark, d), _limits(spark, d)), "element_ids", "element_types", "title_context").drop("metadata")


_CHILD = "child_id, parent_id, doc_id, page_no, array_to_string(element_ids, '|') element_ids, parent_type, child_origin, child_index, child_count, text"


@query(S.parents(S.ELEMENTS) + f" select {_CHILD} from ({S.children('select parent_id, doc_id, parent_type, page_no, element_ids, text from parents')})")
def children(spark, d):
    return _flat(chunking.children(chunking.parents(_normalized(spark, d), _limits(spark, d)), _limits(spark, d)), "element_ids")


def _rechunk(kind, spark, d):
    rows = table(spark, d, "parent_chunk").where(F.col("parent_type") == kind).dropDuplicates(["parent_id"])
    return chunking.children(rows, _limits(spark, d)).select("child_id", "parent_id", "child_origin", "child_index", "child_count", "text")


for _kind in ("narrative_section", "table", "code", "form", "formula"):
    QUERIES[f"children_{_kind}"] = partial(_rechunk, _kind)
    _rows = f"select distinct on (parent_id) parent_id, doc_id, parent_type, page_no, element_ids, text from parent_chunk where parent_type = '{_kind}'"
    SQL[f"children_{_kind}"] = f"select child_id, parent_id, child_origin, child_index, child_count, text from ({S.children(_rows)})"


@query(f"""with p as (select distinct on (parent_id) parent_id, parent_type, text from parent_chunk)
  select parent_type, count(*) parents, sum(({S.tokens('text')} > parent_max_tokens)::int)::bigint oversized, sum(({S.tokens('text')} <= child_max_tokens)::int)::bigint fit_one_child from p cross join chunk_config group by 1""")
def chunk_sizes(spark, d):
    limits, size = _limits(spark, d), T.estimate_tokens(F.col("text"))
    rows = table(spark, d, "parent_chunk").dropDuplicates(["parent_id"])
    return rows.groupBy("parent_type").agg(F.count("*").alias("parents"), F.count_if(size > limits.parent_max).alias("oversized"), F.count_if(size <= limits.child_max).alias("fit_one_child"))


@query(f"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') w from documents where text is not null)
  select doc_id, p.position, array_to_string(w[:p.k] || ['NEEDLE'] || w[p.k + 1:], ' ') prompt
  from (select doc_id, w, unnest([{{'position': 'debut', 'k': 0}}, {{'position': 'milieu', 'k': len(w) // 2}}, {{'position': 'fin', 'k': len(w)}}]) p from w)""")
def needle_insert(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return evalops.needle_prompts(docs, "NEEDLE").select("doc_id", "position", "prompt")


@query("select result_id, coalesce(contains(reponse, '8943-XYZ'), false) exactitude from (select distinct on (result_id) * from baseline_result)")
def needle_success(spark, d):
    return table(spark, d, "baseline_result").dropDuplicates(["result_id"]).select("result_id", evalops.needle_found(F.col("reponse"), "8943-XYZ").alias("exactitude"))


@query("select * from (values ('a', 0.5::double), ('b', null)) t(run_id, last_loss)")
def eval_last_loss(spark, d):
    return evalops.last_loss(spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.5), ("a", 3, None), ("b", 1, None)], "run_id string, step int, loss double"))


@query("select modele, arg_max(train_last_loss, {'a': run_at, 'b': run_id}) filter (where train_last_loss is not null) last_loss from eval_lora group by 1")
def eval_model_last_loss(spark, d):
    """The last logged loss of each producer over its runs in time; a redelivered run has the same loss."""
    history = table(spark, d, "eval_lora").select("modele", F.struct("run_at", "run_id").alias("step"), F.col("train_last_loss").alias("loss"))
    return evalops.last_loss(history, "modele")


_LATENCY = "count(*) answers, round_even(avg(duree), 2) mean_duree, min(duree) min_duree, max(duree) max_duree"


@query(f"""select modele, categorie, {_LATENCY} from (select modele, unnest(baseline_test, recursive := true) from (select distinct on (run_id) * from eval_lora)) group by all""")
def eval_answers(spark, d):
    return evalops.latency(evalops.run_answers(table(spark, d, "eval_lora")), "modele", "categorie")


@query(f"select categorie, {_LATENCY} from (select distinct on (result_id) * from baseline_result) group by 1")
def baseline_latency(spark, d):
    return evalops.latency(evalops.answers(table(spark, d, "baseline_result").dropDuplicates(["result_id"])), "categorie")


@query("select m.modele, p.id from (select distinct modele from baseline_result) m cross join (select distinct id from baseline_result) p")
def eval_cross_models(spark, d):
    b = table(spark, d, "baseline_result")
    return evalops.crossed(b.select("modele").distinct(), b.select("id").distinct())


_LOGS = (("Final estimate: PPL = 5.1234 +/- 0.03", 5.1234), ("chunk 3", None))


@query("select * from (values " + ", ".join(f"({_literal(s)}, {'null' if v is None else v}::double)" for s, v in _LOGS) + ") t(line, perplexity)")
def bench_perplexity_parse(spark, d):
    return spark.createDataFrame([(s,) for s, _ in _LOGS], "line string").select("line", evalops.perplexity(F.col("line")).alias("perplexity"))


@query("select '123.4 ± 0.5' as speed, 'q4.gguf' as model")
def bench_speed_parse(spark, d):
    row = spark.createDataFrame([("| llama | 4 GB | 7 B | CUDA | 99 | pp512 | 123.4 ± 0.5 |", "/m/q4.gguf")], "line string, path string")
    return row.select(evalops.bench_speed(F.col("line"), "pp512").alias("speed"), evalops.model_name(F.col("path")).alias("model"))


@query("select plan_id, case length(plan_id || difficulty) % 3 when 0 then 'ACCEPT' when 1 then 'REJECT' else 'REVIEW' end decision from plans")
def generated_verdicts(spark, d):
    prompts = table(spark, d, "plans").select("plan_id", F.concat("plan_id", "difficulty").alias("prompt"))
    return generator.generated(prompts, generator.echo).select("plan_id", sft.decision(F.col("text")).alias("decision"))


@query(f"select example_id, 'train' part from {_SFT} where split_name = 'train' union all select example_id, 'held out' from {_SFT} where split_name <> 'train'")
def bag_union(spark, d):
    e = _examples(spark, d, "split_name")
    return e.where("split_name = 'train'").select("example_id", F.lit("train").alias("part")).unionByName(e.where("split_name <> 'train'").select("example_id", F.lit("held out").alias("part")))


_PLAN_COLUMNS = "plan_id, " + _AXES
_PLAN_SCHEMA = ", ".join(f"{c} string" for c in _PLAN_COLUMNS.split(", "))


@query(f"select {_PLAN_COLUMNS} from plans")
def jsonl_round_trip(spark, d):
    path = fresh_path(spark, "plans.jsonl")
    files.write_jsonl(table(spark, d, "plans"), path)
    return files.read_jsonl(spark, path, _PLAN_SCHEMA)


@query(f"select {_PLAN_COLUMNS} from plans")
def json_document_round_trip(spark, d):
    path = fresh_path(spark, "plans.json")
    files.write_json(table(spark, d, "plans"), path, "plan_id")
    return files.read_json(spark, path, _PLAN_SCHEMA)


@query("select result_id, prompt, reponse from (select distinct on (result_id) * from baseline_result)")
def csv_round_trip(spark, d):
    """Answers in two parts, the second appended; quotes and line feeds within fields survive."""
    path = fresh_path(spark, "answers.csv")
    rows = materialize(table(spark, d, "baseline_result").select("result_id", "prompt", "reponse").dropDuplicates(["result_id"]), "rows")
    files.write_csv(rows.where("result_id % 2 = 0"), path)
    files.write_csv(rows.where("result_id % 2 = 1"), path, append=True)
    return files.read_csv(spark, path, "result_id bigint, prompt string, reponse string")


@query("select plan_id, case length(plan_id || difficulty) % 3 when 0 then 'ACCEPT' when 1 then 'REJECT' else 'REVIEW' end decision from plans")
def routed_round_trip(spark, d):
    """Verdicts to one folder a decision, and back from all of them."""
    path = fresh_path(spark, "routed")
    files.write_routed(generated_verdicts(spark, d), path, "decision")
    return spark.read.schema("plan_id string, decision string").json(path)


@query("select run_id || '.md' file_name, length(t) n_chars, t markdown from (select run_id, string_agg(coalesce(a.response, ''), chr(10) || chr(10) order by a.id) t from (select run_id, unnest(baseline_test) a from (select distinct on (run_id) * from eval_lora)) group by 1)")
def document_files(spark, d):
    """Each run's answers as a Markdown file, read back by the document source."""
    path = fresh_path(spark, "documents")
    runs = table(spark, d, "eval_lora").dropDuplicates(["run_id"]).select("run_id", F.array_join(F.transform(F.array_sort(F.transform("baseline_test", lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["response"], F.lit("")).alias("r")))), lambda x: x["r"]), "\n\n").alias("text"))
    runs.repartition("run_id").write.partitionBy("run_id").option("lineSep", "\x00").text(path)
    found = files.read_documents(spark, f"{path}/*/*", lambda _, content: content.decode("utf-8").rstrip("\x00"))
    name = F.concat(F.url_decode(F.regexp_extract("source_path", "run_id=([^/]+)/", 1)), F.lit(".md"))
    return found.select(name.alias("file_name"), "metadata.n_chars", "markdown")


@query("select * from (values ('a', 'bfloat16'), ('b', 'float16'), ('c', null), ('d', 'int8')) t(name, dtype)")
def config_dtype(spark, d):
    rows = [("a", {"bnb_4bit_compute_dtype": "torch.bfloat16"}), ("b", {"bnb_4bit_compute_dtype": "fp16", "x": "1"}), ("c", {"load_in_8bit": "true"}), ("d", {"bnb_4bit_compute_dtype": "int8"})]
    df = spark.createDataFrame(rows, "name string, config map<string,string>")
    return df.select("name", F.try_element_at(evalops.with_dtype(F.col("config")), F.lit("bnb_4bit_compute_dtype")).alias("dtype"))


@query("select * from (values ('a', 3, '0.1|0.2'), ('b', null, null)) t(element_id, page_no, bbox)")
def element_provenance(spark, d):
    rows = spark.createDataFrame([("a", [(3, [0.1, 0.2]), (4, [0.5])]), ("b", [])], "element_id string, prov array<struct<page_no:int,bbox:array<double>>>")
    return elements.with_provenance(rows).select("element_id", "page_no", F.array_join(F.col("bbox").cast("array<string>"), "|").alias("bbox"))
