"""Parts of SQL that several queries share: text steps, packing of texts, elements and chunks."""

from __future__ import annotations

from loam.functions import layout
from loam.functions import text as T
from loam.operators import elements

#: White space as a regular expression class for RE2, the same set as the Spark side uses.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def blank(c: str) -> str:
    return f"coalesce(regexp_full_match({c}, '{WS}*'), true)"


def tokens(c: str) -> str:
    return f"(case when {blank(c)} then 0 else ceil(length({c}) / 4.0) end)::int"


def clean(c: str) -> str:
    return rf"regexp_replace({strip(c)}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def kept(parts: str) -> str:
    """Stripped, non-blank entries of a list."""
    return f"list_filter(list_transform({parts}, lambda k: {strip('k')}), lambda k: k <> '')"


def sentences(c: str) -> str:
    return kept(rf"string_split(regexp_replace({c}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))")


def paragraphs(c: str) -> str:
    return kept(f"string_split({c}, chr(10) || chr(10))")


def lines(c: str, keep_indent: bool = False) -> str:
    parts = rf"regexp_split_to_array({c}, '\r\n|[\n-\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')"
    if keep_indent:
        return f"list_filter(list_transform({parts}, lambda k: regexp_replace(k, '{WS}+$', '')), lambda k: k <> '')"
    return kept(parts)


def hard_split(c: str, chars: str) -> str:
    return f"list_filter(list_transform(range(0, greatest(1, ceil(length({c}) / ({chars})::double)::int)), lambda h: {strip(f'substring({c}, (h * ({chars}) + 1)::int, ({chars})::int)')}), lambda h: h <> '')"


# Steps of the layout repair.


def _replaced(pattern: str, to: str):
    return lambda c: f"regexp_replace({c}, '{pattern}', {to}, 'g')"


def _in_order(*steps):
    def run(c):
        for step in steps:
            c = step(c)
        return c
    return run


#: A line feed before a list item is set aside under a sign of its own, twice as one item's end may be the next one's start.
_aside = _replaced(rf"\n( *{T.LIST_MARK}[\t-\r ])", r"chr(1) || '\1'")
STEPS = {
    T.collapse_spaces: _replaced(r"[ \t\f\v]+", "' '"),
    T.strip_around_newlines: _in_order(_replaced(r"[ \t]+\n", "chr(10)"), _replaced(r"\n[ \t]+", "chr(10)")),
    T.join_hyphenated: _replaced(f"([{T.LOWER}]{{3,}})-\\n([{T.LOWER}]{{2,}})", r"'\1\2'"),
    T.join_title_lines: _in_order(*[_replaced(r"(^|[^\n])\n([^\n]|$)", r"'\1 \2'")] * 2),
    T.join_paragraph_lines: _in_order(_aside, _aside, _replaced(r"\n([^\n\x{1}]|$)", r"' \1'"), lambda c: f"replace({c}, chr(1), chr(10))"),
    T.collapse_blank_lines: _replaced(r"\n{3,}", "chr(10) || chr(10)"),
    T.squeeze_blanks: _replaced(" {2,}", "' '"),
    layout.strip_line_ends: _replaced(r"[ \t]+(\n|$)", r"'\1'"),
    layout._colon: _replaced(f"{WS}*:{WS}*", "': '"),
    layout._equal: _replaced(f"{WS}*={WS}*", "' = '"),
}


def repair(c: str, kind: str) -> str:
    ends = f"replace(replace(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(173) || chr(10), '')"
    return strip(_in_order(*(STEPS[step] for step in layout.STEPS[kind]))(ends))


def unicode_normalized(c: str) -> str:
    """Compatibility composition of texts whose only compatibility signs are the no-break space and the spacing diaeresis, as in the tables."""
    return f"replace(replace(replace(nfc_normalize(replace(replace(coalesce({c}, ''), chr(160), ' '), chr(168), ' ' || chr(776))), chr(8203), ''), chr(173), ''), chr(65279), '')"


# Packing of texts.


def packed(parts: str, target: str, joiner: str, finer=None, frame: str | None = None, v: str = "") -> str:
    """Texts joined as long as the estimate stays within ``target``; ``finer`` gives the list that replaces a part, empty for most."""
    s, x = f"s{v}", f"x{v}"
    head = lambda y: f"{frame} || {joiner} || {y}" if frame else y
    items = f"list_transform({parts}, lambda u{v}: {{'done': {finer(f'u{v}') if finer else '[]::varchar[]'}, 'open': u{v}}})"
    longer = f"(case when {s}['open'] = '' then {x}['open'] else {s}['open'] || {joiner} || {x}['open'] end)"
    held = f"{s}['open']"
    flushed = f"(case when {held} = '' then {s}['done'] else {s}['done'] || [{head(held)}] end)"
    step = (
        f"case when {tokens(head(longer))} <= {target} then {{'done': {s}['done'], 'open': {longer}}}"
        f" when len({x}['done']) > 0 then {{'done': {flushed} || {x}['done'], 'open': ''}} else {{'done': {flushed}, 'open': {x}['open']}} end"
    )
    last = f"r{v}['open']"
    folded = f"list_reduce({items}, lambda {s}, {x}: {step}, {{'done': []::varchar[], 'open': ''}})"
    return f"list_transform([{folded}], lambda r{v}: case when {last} = '' then r{v}['done'] else r{v}['done'] || [{head(last)}] end)[1]"


def split_text(c: str, target: str, most: str, v: str = "") -> str:
    """A text over ``most`` as packs of sentences, sentences over ``most`` cut hard; else the text itself."""
    parts = sentences(c)
    over = lambda y: f"case when {tokens(y)} > {most} then {hard_split(y, f'{most} * 4')} else []::varchar[] end"
    return f"case when {tokens(c)} <= {most} then [{c}] when len({parts}) = 0 then {hard_split(c, f'{most} * 4')} else {packed(parts, target, chr(39) + ' ' + chr(39), over, v=v)} end"


# Elements of documents.

_CLASS = "case when f[:2] = '# ' then 'TitleItem' when f[:1] = '#' then 'SectionHeaderItem' when f[:3] = '```' then 'CodeItem' when f[:1] = '|' then 'TableItem' when regexp_matches(f, '^[-*•][\\t-\\r ]') then 'ListItem' else 'TextItem' end"
_KINDS = {c: elements.TYPES[c] for c in ("TitleItem", "SectionHeaderItem", "CodeItem", "TableItem", "ListItem", "TextItem")}
ELEMENTS = f"""
  select doc_id, pos, printf('el_%06d', pos) element_id, element_type, level, null::int page_no, normalized_text,
    case when {blank('raw_text')} then 'blank' when {blank('normalized_text')} then 'blank after repair' end reject_reason
  from (select *, case element_type {' '.join(f"when '{k}' then {repair('clear', k)}" for k in dict.fromkeys(_KINDS.values()))} end normalized_text
    from (select *, case cls {' '.join(f"when '{c}' then '{k}'" for c, k in _KINDS.items())} end element_type, {unicode_normalized('raw_text')} clear
      from (select doc_id, pos, cls, greatest(1, length(regexp_extract(f, '^(#+)', 1))) level, case when cls in ('TitleItem', 'SectionHeaderItem') then regexp_replace(f, '^#+{WS}*', '') else part end raw_text
        from (select *, {_CLASS} cls from (select *, ltrim(part, ' ') f from (
          select doc_id, unnest(parts) part, generate_subscripts(parts, 1)::int - 1 pos from (
            select doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '\\n{{2,}}') parts from documents where doc_id is not null)))))))"""

_SEP = r"^[|:\- \t]*-[|:\- \t]*$"
#: Metadata of the elements of ``ELEMENTS``, by doc_id and pos.
ELEMENT_METADATA = f"""
  select doc_id, pos, cls docling_class, case when cls = 'TableItem' then len(list_filter(rows_, lambda x: not regexp_matches(x, '{_SEP}')))::int end num_rows,
    case when cls = 'TableItem' then len(string_split(regexp_replace(regexp_replace(rows_[1], '^{WS}*[|]', ''), '[|]{WS}*$', ''), '|'))::int end num_cols, level docling_level
  from (select *, list_filter(string_split(part, chr(10)), lambda x: not {blank('x')}) rows_, greatest(1, length(regexp_extract(f, '^(#+)', 1))) level
    from (select *, {_CLASS} cls from (select *, ltrim(part, ' ') f from (
      select doc_id, unnest(parts) part, generate_subscripts(parts, 1)::int - 1 pos from (
        select doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '\\n{{2,}}') parts from documents where doc_id is not null)))))"""

# Parents of ordered elements.

_HEADINGS = ", ".join(f"'{k}'" for k in elements.HEADINGS)
_SPECIAL = ", ".join(f"'{k}'" for k in elements.SPECIAL)


def _out(kind: str, ids: str, types: str, page: str, path: str, body: str, big: str) -> str:
    return f"{{'kind': {kind}, 'ids': {ids}, 'types': {types}, 'page': {page}, 'path': {path}, 'body': {body}, 'big': {big}}}"


def parents(source: str) -> str:
    """Common table expressions, ending in ``parents``, over the rows (doc_id, pos, element_id, element_type, level, page_no, normalized_text, reject_reason) of ``source``."""
    held = _out("'narrative_section'", "ids", "types", "page", "path", "held", "false")
    return f"""
with recursive el as (select *, row_number() over (partition by doc_id order by pos) i from ({source}) where reject_reason is null),
scan as (
  select doc_id, 0::bigint i, []::varchar[] path, []::varchar[] ids, []::varchar[] types, null::int page, '' held, []::struct(kind varchar, ids varchar[], types varchar[], page int, path varchar[], body varchar, big boolean)[] outs
  from (select distinct doc_id from el)
  union all
  select doc_id, i, case when heading then path[:level - 1] || [body] else path end,
    case when closed or not narrative then []::varchar[] else new_ids end, case when closed or not narrative then []::varchar[] else new_types end, case when closed or not narrative then null else new_page end, case when closed or not narrative then '' else new_held end,
    (case when flush then [{held}] else [] end)
      || (case when special then [{_out("kind", "[eid]", "[kind]", "epage", "path", "body", "false")}] when big then [{_out("'narrative_section'", "[eid]", "[kind]", "epage", "path", "whole", "true")}]
        when closed then [{_out("'narrative_section'", "new_ids", "new_types", "new_page", "path", "new_held", "false")}] else [] end)
  from (select *, narrative and {tokens('new_held')} >= parent_target_tokens closed
    from (select *, (case when flush then [] else ids end) || [eid] new_ids, (case when flush then [] else types end) || [kind] new_types, coalesce(case when not flush then page end, epage) new_page,
        case when flush or held = '' then body else held || chr(10) || chr(10) || body end new_held
      from (select *, len(ids) > 0 and (not narrative or {tokens('held')} + {tokens('whole')} > parent_max_tokens) flush
        from (select *, not heading and not special and not big narrative
          from (select s.doc_id, e.i, s.path, s.ids, s.types, s.page, s.held, e.element_id eid, e.element_type kind, greatest(1, coalesce(e.level, 1)) level, e.page_no epage, e.normalized_text whole, {strip('e.normalized_text')} body,
              e.element_type in ({_HEADINGS}) heading, e.element_type in ({_SPECIAL}) special, e.element_type not in ({_HEADINGS}, {_SPECIAL}) and {tokens('e.normalized_text')} > c.parent_max_tokens big, c.*
            from scan s join el e on e.doc_id = s.doc_id and e.i = s.i + 1 cross join chunk_config c)))))),
emitted as (
  select doc_id, i, unnest(outs) o, generate_subscripts(outs, 1) j from scan
  union all
  select doc_id, i + 1, {held}, 1 from (select *, row_number() over (partition by doc_id order by i desc) r from scan) where r = 1 and len(ids) > 0),
cut as (
  select doc_id, row_number() over (partition by doc_id order by i, j)::int - 1 pos, o, case when o['big'] then {split_text("o['body']", 'parent_target_tokens', 'parent_max_tokens', 'p')} else [o['body']] end texts
  from emitted cross join chunk_config),
parents as (
  select sha256(doc_id || '|' || array_to_string(o['ids'], '|') || '|' || substring(case when o['big'] then split_index || '|' || body else body end, 1, 200)) parent_id, doc_id::varchar doc_id, pos, split_index, split_count, o['page'] page_no,
    o['ids'] element_ids, o['types'] element_types, o['kind'] parent_type, o['path'] title_context, {strip('body')} as text
  from (select doc_id, pos, o, len(texts)::int split_count, unnest(texts) body, generate_subscripts(texts, 1)::int - 1 split_index from cut))"""


# Children of parents.


def _with_overlap(texts: str) -> str:
    tail = f"{strip('right(l[n - 1], overlap_tokens * 4)')}"
    longer = f"{tail} || chr(10) || chr(10) || y"
    each = f"case when overlap_tokens > 0 and n > 1 and {tail} <> '' and {tokens(longer)} <= child_max_tokens then {longer} else y end"
    return f"list_transform([{texts}], lambda l: list_transform(l, lambda y, n: {each}))[1]"


def children(rows: str) -> str:
    """Children of the parents that the select ``rows`` gives (parent_id, doc_id, parent_type, page_no, element_ids, text)."""
    target, most = "child_target_tokens", "child_max_tokens"
    finer = lambda y: f"case when {tokens(y)} > {most} then {split_text(y, target, most, 'f')} else []::varchar[] end"
    narrative = _with_overlap(packed(paragraphs("t"), target, "chr(10) || chr(10)", finer, v="n"))
    table = f"case when len(rows_) < 3 then [{strip('t')}] else {packed('rows_[3:]', target, 'chr(10)', frame='rows_[1] || chr(10) || rows_[2]', v='t')} end"
    return f"""
  select sha256(parent_id || '|' || child_index || '|' || substring(body, 1, 200)) child_id, parent_id, doc_id, page_no, element_ids, parent_type,
    case when fits then 'single_child_from_parent' else 'split_from_parent' end child_origin, child_index, child_count, {strip('body')} as text
  from (select *, len(texts)::int child_count, unnest(texts) body, generate_subscripts(texts, 1)::int - 1 child_index
    from (select *, case when fits then [t] when parent_type in ('narrative_section', 'paragraph', 'mixed') then {narrative} when parent_type = 'table' then {table}
        when parent_type = 'code' then {packed(lines('t', True), target, 'chr(10)', v='c')} when parent_type = 'form' then {packed(lines('t'), target, 'chr(10)', v='o')}
        else {split_text('t', target, most, 'e')} end texts
      from (select *, {tokens('t')} <= child_max_tokens or parent_type = 'formula' fits, {lines('t')} rows_ from (select p.* exclude (text), p.text t, c.* from ({rows}) p cross join chunk_config c) where not {blank('t')})))
  where not {blank('body')}"""
