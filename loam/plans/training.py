"""Queries of the general training-data operators, by name, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import boundary_split, format_duplicates, proportional_sample, word_overlap
from loam.session import materialize, table


def _report(spark: SparkSession, d: str) -> DataFrame:
    rows = proportional_sample.categorised(table(spark, d, "sft_examples"), table(spark, d, "plans"))
    return proportional_sample.target_report(rows, table(spark, d, "sample_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).where("not met").select("target_set", "source", "challenge_type")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(proportional_sample.categorised(table(spark, d, "sft_examples"), table(spark, d, "plans")), "rows")
    report = materialize(proportional_sample.target_report(rows, table(spark, d, "sample_targets")), "report")
    return proportional_sample.draw(rows, report)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = word_overlap.cross_split_pairs(table(spark, d, "sft_examples"))
    return pairs.select(F.least("train_id", "eval_id").alias("example_id_a"), F.greatest("train_id", "eval_id").alias("example_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_examples")
    return word_overlap.overlap_report(word_overlap.cross_split_links(rows), rows)


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return word_overlap.cross_split_links(table(spark, d, "sft_examples")).select(F.col("id").alias("example_id"), "split", "class_id", "links")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = format_duplicates.collapse(table(spark, d, "sft_examples"))
    return pairs.select(F.col("id").alias("example_id_a"), F.col("member").alias("example_id_b"))


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    counts, _ = format_duplicates.collapse(table(spark, d, "sft_examples"))
    return counts.select(F.col("id").alias("example_id"), "copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = word_overlap.near_groups(table(spark, d, "sft_examples"), "example_id", "context", "response")
    return groups.select(F.col("id").alias("example_id_a"), F.col("member").alias("example_id_b"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    config = table(spark, d, "chunk_config")
    parts = []
    for kind in ("parent", "child"):
        texts = table(spark, d, f"{kind}_chunk").select(F.col(f"{kind}_id").alias("chunk_id"), "text")
        parts.append(boundary_split.split_oversized(texts, boundary_split.limits_of(config, kind), kind))
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0 and piece_count > 1").select("record_kind", "chunk_id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


P1_SQL = r"""
with own as (
  select distinct example_id, source, plan_id,
    regexp_replace(lower(regexp_replace(challenge_type, '^[\s ]+|[\s ]+$', '', 'g')), '[\s _-]+', '_', 'g') c
  from sft_examples where example_id is not null and source is not null),
r as (
  select o.source, coalesce(case when o.c not in ('', 'introuvable') then o.c end, p.challenge_type) category
  from own o left join plans p on p.plan_id = o.plan_id),
h as (select source, category, count(*) n from r where category is not null group by 1, 2),
s as (select source, sum(n) n from h group by 1)
select t.target_set, t.source, t.challenge_type from sample_targets t
left join h on h.source = t.source and h.category = t.challenge_type left join s on s.source = t.source
where coalesce(h.n, 0) < greatest(t.min_rows, ceil(floor(coalesce(s.n, 0) * t.sample_pct / 100) * t.target_pct / 100))
"""

#: The estimate of a text's tokens, for blank text 0.
_TOKENS = r"case when regexp_full_match(text, '\s*') then 0 else ceil(length(text) / 4.0) end"
P7_SQL = f"""
select distinct 'parent' record_kind, parent_id chunk_id from parent_chunk, chunk_config where {_TOKENS} > parent_max_tokens
union all
select distinct 'child', child_id from child_chunk, chunk_config where {_TOKENS} > child_max_tokens
"""



def _fold(c: str) -> str:
    return f"lower(upper(coalesce({c}, '')))"


def _words(c: str) -> str:
    return rf"trim(regexp_replace({_fold(c)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _letters(c: str) -> str:
    return rf"regexp_replace({_fold(c)}, '[^\p{{L}}\p{{N}}]+', '', 'g')"


#: Fields of a JSON object in key order, for other texts null.
_FIELDS = "case when ltrim(response, ' ')[:1] = '{' then list_sort(map_entries(try_cast(try_cast(response as json) as map(varchar, varchar)))) end"
_BY_FIELD = f"case when len({_FIELDS}) > 0 then '{{' || array_to_string(list_transform({_FIELDS}, lambda e: {_letters('e.key')} || '=' || {_letters('e.value')}), ';') else {_letters('response')} end"
_BY_VALUES = f"case when len({_FIELDS}) > 0 then {_words(f"array_to_string(list_transform({_FIELDS}, lambda e: coalesce(e.value, '')), ' ')")} else {_words('response')} end"

_COPIES = f"""
select example_id, min(example_id) over (partition by k) first_id, count(*) over (partition by k) copies
from (select distinct on (example_id) example_id, {_letters('instruction')} || '|' || {_letters('context')} || '|' || {_BY_FIELD} k from sft_examples where example_id is not null)
"""
P3_SQL = f"select first_id example_id_a, example_id example_id_b from ({_COPIES}) where example_id > first_id"
P3_COPIES_SQL = f"select example_id, copies from ({_COPIES}) where example_id = first_id"


def _tokens_of(source: str, key: str, text: str) -> str:
    """Words of each text, numbered where they repeat, so that joining them counts words in common."""
    return f"select {key}, w, row_number() over (partition by {key}, w) nth from (select {key}, unnest(string_split({text}, ' ')) w from {source})"


def _n(c: str) -> str:
    return f"len(string_split({c}, ' '))"


P2_PAIRS = f"""
with e as (select distinct on (example_id) example_id, split_name, {_words('context')} c, {_words('instruction')} i from sft_examples
    where example_id is not null and split_name in ('train', 'val', 'test') and {_words('context')} <> '' and {_words('instruction')} <> ''),
cs as (select c, row_number() over () cid, {_n('c')} n, bool_or(split_name = 'train') t, bool_or(split_name <> 'train') v from e group by c),
ins as (select i, row_number() over () iid, {_n('i')} n from (select distinct i from e)),
ct as ({_tokens_of('cs', 'cid', 'c')}), it as ({_tokens_of('ins', 'iid', 'i')}),
cp as (select a, b from (select x.cid a, y.cid b, count(*) k from ct x join ct y using (w, nth) where x.cid in (select cid from cs where v) and y.cid in (select cid from cs where t) group by all)
  join cs p on p.cid = a join cs q on q.cid = b where k >= 0.7 * greatest(p.n, q.n)),
ip as (select a, b from (select x.iid a, y.iid b, count(*) k from it x join it y using (w, nth) group by all)
  join ins p on p.iid = a join ins q on q.iid = b where k >= 0.6 * greatest(p.n, q.n)),
m as (select example_id, split_name, cid, iid from e join cs using (c) join ins using (i)),
found as (select v.example_id eval_id, v.split_name eval_split, t.example_id train_id from m v join cp on cp.a = v.cid join m t on t.cid = cp.b join ip on ip.a = v.iid and ip.b = t.iid where v.split_name <> 'train' and t.split_name = 'train')
"""
P2_SQL = P2_PAIRS + "select least(eval_id, train_id) example_id_a, greatest(eval_id, train_id) example_id_b from found"
P2_LINKS_SQL = P2_PAIRS + """, linked as (select eval_id id, count(*) links from found group by 1 union all select train_id, count(*) from found group by 1),
named as (select example_id id, split_name split, min(example_id) over (partition by cid, iid) class_id from m)
select id example_id, split, class_id, links from named join linked using (id)"""
P2_REPORT_SQL = P2_PAIRS + """, hits as (select eval_id, count(*) pairs from found group by 1),
base as (select example_id eval_id, min(split_name) split_name, min(source) source from sft_examples where split_name in ('val', 'test') group by 1)
select split_name, source, count(*) eval_rows, count(pairs) overlapping_rows, coalesce(sum(pairs), 0)::bigint pairs from base left join hits using (eval_id) group by all"""

P4_SQL = f"""
with recursive e as (select * from (select distinct on (example_id) example_id id, {_words('context')} c, {_BY_VALUES} r, {_letters('context')} lc, {_BY_FIELD} lr from sft_examples where example_id is not null) where c <> '' and lr <> ''),
g as (select *, min(id) over (partition by lc, lr) rep from e),
reps as (select id, c, r, {_n('c')} nc, {_n('r')} nr from g where id = rep),
ct as ({_tokens_of('reps', 'id', 'c')}), rt as ({_tokens_of('reps', 'id', 'r')}),
cp as (select a, b from (select x.id a, y.id b, count(*) k from ct x join ct y using (w, nth) where x.id < y.id group by all) join reps p on p.id = a join reps q on q.id = b where k >= 0.7 * greatest(p.nc, q.nc)),
links as (select a, b from (select a, b, count(*) k from cp join rt x on x.id = a join rt y on y.id = b and y.w = x.w and y.nth = x.nth group by all) join reps p on p.id = a join reps q on q.id = b where k >= 0.7 * greatest(p.nr, q.nr)),
both_ways as (select a, b from links union select b, a from links),
reach as (select a, b from both_ways union select r.a, n.b from reach r join both_ways n on n.a = r.b),
root as (select a id, least(a, min(b)) root from reach group by a)
select coalesce(root, rep) example_id_a, g.id example_id_b from g left join root on root.id = g.rep where g.id > coalesce(root, rep)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p2_found, p2_report, p2_links, p3_found, p3_copies, p4_found, p7_found, p7_pieces)}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_report": P2_REPORT_SQL, "p2_links": P2_LINKS_SQL, "p3_found": P3_SQL, "p3_copies": P3_COPIES_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL}
