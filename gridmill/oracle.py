"""SQL for the registered queries, over the same tables."""

from __future__ import annotations

# White space at the ends of a cell.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(replace(replace(replace({x}, 'ß', 'ss'), 'ſ', 's'), 'µ', 'μ')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _safe(x: str) -> str:
    return rf"case when regexp_matches({x}, '^([\t\r\n]|[ \t\r\n]*[=+@-])') then '''' || {x} else {x} end"


def _csv(x: str) -> str:
    return rf"case when regexp_matches({x}, '[\x22,\r\n]') then chr(34) || replace({x}, chr(34), chr(34) || chr(34)) || chr(34) else {x} end"


PARAGRAPHS = f"""
pieces as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as para_index from documents where text is not null),
paras as (select doc_id, cast(para_index as bigint) as para_index, {_strip('raw')} as text from pieces where {_strip('raw')} <> '')"""

LINES = """
lines as (
  select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as ix,
         'P' || l_partkey as item,
         case when l_partkey % 17 = 0 then 'many' when l_partkey % 19 = 0 then '' when l_partkey % 23 = 0 then '-3' else cast(cast(l_quantity as bigint) as varchar) end as qty,
         cast(cast(l_extendedprice as decimal(18,2)) as varchar) as price
  from lineitem)"""

ORDER = f"""{LINES},
placed as (select *, ix // 5 as table_seq, ix % 5 as pos, (ix // 5 = 0 or doc_id % 3 <> 0) as headed from lines),
pages as (select doc_id, table_seq, headed from placed where pos = 0),
lasts as (select doc_id, max(table_seq) as last from pages group by doc_id),
heads as (
  select doc_id, table_seq, 0 as row,
         list_concat(case when doc_id % 13 = 0 then ['Item', 'Qty', case when doc_id % 2 = 0 then 'Remark' else 'Total' end]
              when doc_id % 2 = 0 then ['Item', 'Qty', 'Price'] else [' DESCRIPTION ', 'quantity:', 'Unit  price!'] end,
         case when doc_id % 5 = 0 then [case when doc_id % 2 = 0 then 'description' else 'Colour' end] else cast([] as varchar[]) end) as cells
  from pages where headed),
strays as (
  select doc_id, last + 1 as table_seq, i - 1 as row,
         case when doc_id % 2 = 0 then case i when 1 then ['Item', 'Code'] else ['x', ''] end else case i when 1 then ['Date', 'Operator'] else ['', ''] end end as cells
  from lasts, range(1, 3) r(i) where doc_id % 7 = 0),
rws as (
  select doc_id, table_seq, pos + cast(headed as int) as row, list_concat([item, qty, price], case when doc_id % 5 = 0 then ['c' || ix] else cast([] as varchar[]) end) as cells from placed
  union all select * from heads union all select * from strays),
tabs as (
  select doc_id, table_seq, table_seq + 1 as page, 0 as table_index from pages
  union all select doc_id, last + 1, last + 1, 1 from lasts where doc_id % 7 = 0)"""

EVENT = """
ev as (
  select user_id as doc_id, date_diff('day', date '2024-01-01', cast(ts as date)) as day, event_id, event_type, cast(cast(value as decimal(18,2)) as varchar) as v from events),
evw as (
  select *, 2 + min(event_id) over (partition by doc_id, day) % 2 as w, row_number() over (partition by doc_id, day order by event_id) - 1 as row,
         dense_rank() over (partition by doc_id order by day) - 1 as table_seq from ev),
rws as (
  select doc_id, table_seq, row, list_concat(list_slice(case when row = 0 then ['type', 'value', 'x'] else [event_type, case when event_id % 2 = 0 then '' else v end, case when event_id % 3 = 0 then '' else 'x' end] end, 1, w),
         case when (doc_id + day) % 5 = 0 and row = 0 then ['more'] else cast([] as varchar[]) end) as cells
  from evw),
tabs as (select doc_id, table_seq, day + 1 as page, 0 as table_index from evw where row = 0)"""

ASSESS = """
stats as (
  select doc_id, table_seq, count(*) as n_rows, list_sort(list(distinct len(cells))) as widths, sum(len(cells)) as n_cells,
         sum(len(list_filter(cells, lambda c: c = ''))) as n_empty from rws group by doc_id, table_seq),
rated as (select *, round(n_empty / n_cells, 3) as empty_ratio from stats),
assessed as (
  select t.doc_id, t.table_seq, t.page, t.table_index, n_rows, case when len(widths) = 1 then widths[1] end as column_count,
         cast(n_cells as bigint) as n_cells, cast(n_empty as bigint) as n_empty, empty_ratio,
         list_filter([case when len(widths) > 1 then 'ragged: rows have [' || array_to_string(widths, ', ') || '] columns (grid may be misdetected)' end,
                      case when empty_ratio > 0.4 then cast(trunc(empty_ratio * 100) as int) || '% of cells are empty (extraction may be off)' end], lambda x: x is not null) as warnings
  from tabs t join rated r using (doc_id, table_seq))"""

ISLANDS = """
lagged as (
  select *, coalesce(column_count = lag(column_count) over w and page = lag(page) over w + 1, false) as continues
  from assessed window w as (partition by doc_id order by table_seq)),
islands as (
  select * exclude (continues), last_value(case when not continues then table_seq end ignore nulls) over (partition by doc_id order by table_seq rows between unbounded preceding and current row) as island
  from lagged)"""

MATCH = f"""{ASSESS},
aliases(alias, field) as (values ('item', 'item'), ('description', 'item'), ('quantity', 'quantity'), ('qty', 'quantity'), ('unit_price', 'unit_price'), ('price', 'unit_price'), ('unit price', 'unit_price'), ('note', 'note'), ('remark', 'note')),
cellz as (select doc_id, table_seq, row, i - 1 as col, cells[i] as raw from rws, unnest(range(1, len(cells) + 1)) u(i)),
named as (select c.*, a.field from cellz c join aliases a on a.alias = {_norm('c.raw')} where row < 3),
firsts as (select doc_id, table_seq, row, field, min(col) as col, count(*) - 1 as extra from named group by all),
cand as (
  select r.doc_id, r.table_seq, r.row, r.cells, count(f.field) as n_mapped, count(f.field) filter (where f.field <> 'note') as n_required,
         max(f.col) filter (where f.field = 'item') as c_item, max(f.col) filter (where f.field = 'quantity') as c_quantity,
         max(f.col) filter (where f.field = 'unit_price') as c_price, max(f.col) filter (where f.field = 'note') as c_note,
         coalesce(sum(f.extra), 0) as n_doubles
  from rws r left join firsts f using (doc_id, table_seq, row) where r.row < 3 group by r.doc_id, r.table_seq, r.row, r.cells),
best as (select *, row_number() over (partition by doc_id, table_seq order by n_required desc, n_mapped desc, row) as rn from cand),
matched as (
  select a.*, b.row as header_row, b.cells as header, n_mapped, n_required, c_item, c_quantity, c_price, c_note, n_doubles,
         case when n_mapped < 3 then 'unmatched' when n_required < 3 then 'rejected' else 'compatible' end as kind
  from assessed a join best b using (doc_id, table_seq) where rn = 1),
anchored as (
  select *, last_value(case when kind <> 'unmatched' then {{'seq': table_seq, 'kind': kind, 'page': page, 'width': column_count, 'i': c_item, 'q': c_quantity, 'p': c_price, 'n': c_note}} end ignore nulls)
         over (partition by doc_id order by table_seq rows between unbounded preceding and 1 preceding) as anchor from matched),
fitted as (select *, coalesce(kind = 'unmatched' and table_index = 0 and anchor.kind = 'compatible' and column_count = anchor.width and page > anchor.page, false) as fits from anchored),
nth as (select *, sum(cast(fits as int)) over (partition by doc_id, anchor.seq order by table_seq rows between unbounded preceding and current row) as k from fitted),
carried as (
  select doc_id, table_seq, page, table_index, n_rows, column_count, warnings, header_row, header, n_mapped, n_required, n_doubles,
         fits and page = anchor.page + k as continued,
         case when fits and page = anchor.page + k then 'continued' else kind end as kind,
         case when fits and page = anchor.page + k then anchor.i else c_item end as c_item,
         case when fits and page = anchor.page + k then anchor.q else c_quantity end as c_quantity,
         case when fits and page = anchor.page + k then anchor.p else c_price end as c_price,
         case when fits and page = anchor.page + k then anchor.n else c_note end as c_note
  from nth)"""

RECORDS = f"""{MATCH},
datar as (
  select r.doc_id, r.table_seq, r.row, r.cells, c.page, c.table_index, c.c_item, c.c_quantity, c.c_price, c.c_note, c.continued, c.warnings, c.n_doubles, c.header, c.kind
  from rws r join carried c using (doc_id, table_seq)
  where c.kind in ('compatible', 'continued') and (c.continued or r.row > c.header_row) and len(list_filter(r.cells, lambda x: {_strip('x')} <> '')) > 0),
recs as (
  select *, row_number() over (partition by doc_id order by table_seq, row) - 1 as record_index,
         coalesce(cells[c_item + 1], '') as item, coalesce(cells[c_quantity + 1], '') as qty, coalesce(cells[c_price + 1], '') as price,
         (continued or len(warnings) > 0 or n_doubles > 0) as table_flagged
  from datar),
cell_issues as (
  select doc_id, record_index, table_seq, row, 'item' as field, 'blank_required_value' as code from recs where item = ''
  union all select doc_id, record_index, table_seq, row, 'quantity', case when qty = '' then 'blank_required_value' when qty = 'many' then 'invalid_type' else 'below_minimum' end from recs where qty in ('', 'many', '-3')
  union all select doc_id, record_index, table_seq, row, 'unit_price', 'above_maximum' from recs where cast(price as decimal(18,2)) > 90000),
keyed as (select *, min(record_index) over (partition by doc_id, item) as first_index from recs),
dups as (select doc_id, first_index, record_index from keyed where item <> '' and first_index < record_index),
table_issues as (
  select doc_id, table_seq, 'headerless_continuation' as code from carried where continued
  union all select doc_id, table_seq, 'extractor_warning' from carried, unnest(warnings) where kind in ('compatible', 'continued')
  union all select doc_id, table_seq, 'duplicate_mapped_column' from carried where kind = 'compatible' and n_doubles > 0
  union all select doc_id, table_seq, 'partial_profile_match' from carried where kind = 'unmatched' and n_mapped > 0
  union all select doc_id, table_seq, 'missing_required_columns' from carried where kind = 'rejected'
  union all select c.doc_id, c.table_seq, 'empty_matched_table' from carried c where kind in ('compatible', 'continued') and not exists (select 1 from recs r where r.doc_id = c.doc_id and r.table_seq = c.table_seq)),
counts as (
  select l.doc_id, t.detected_tables, t.matched_tables, t.compatible_tables, t.headerless_continuations, coalesce(r.records, 0) as records
  from lasts l
  left join (select doc_id, count(*) as detected_tables, count(*) filter (where kind in ('compatible', 'rejected')) as matched_tables, count(*) filter (where kind = 'compatible') as compatible_tables,
                    count(*) filter (where kind = 'continued') as headerless_continuations from carried group by doc_id) t using (doc_id)
  left join (select doc_id, count(*) as records from recs group by doc_id) r using (doc_id)),
doc_issues as (
  select doc_id, case when matched_tables = 0 then 'no_matching_table' else 'no_compatible_table' end as code from counts where compatible_tables = 0
  union all select doc_id, 'insufficient_records' from counts where records < 1),
every as (
  select doc_id, 0 as scope, code from doc_issues union all select doc_id, 0, 'duplicate_record_key' from dups
  union all select doc_id, 1, code from table_issues union all select doc_id, 2, code from cell_issues),
stated as (
  select r.doc_id, r.record_index, r.item, r.qty, r.price,
         case when r.table_flagged or exists (select 1 from cell_issues i where i.doc_id = r.doc_id and i.record_index = r.record_index)
                or exists (select 1 from dups d where d.doc_id = r.doc_id and (d.record_index = r.record_index or d.first_index = r.record_index)) then 'needs_review' else 'accepted' end as status
  from recs r),
decided as (
  select c.*, coalesce(s.accepted_records, 0) as accepted_records, coalesce(e.issues, 0) as issues,
         case when exists (select 1 from doc_issues d where d.doc_id = c.doc_id) then 'rejected' when e.issues > 0 then 'needs_review' else 'accepted' end as decision
  from counts c
  left join (select doc_id, count(*) filter (where status = 'accepted') as accepted_records from stated group by doc_id) s using (doc_id)
  left join (select doc_id, count(*) as issues from every group by doc_id) e using (doc_id))"""

#: What the CSV export says of a record's issues: its cells by column, its own repeated key, then later records that repeat it.
ISSUE_TEXTS = """
said as (
  select doc_id, record_index, case field when 'item' then 0 when 'quantity' then 1 else 2 end as place, 0 as other, code || ': ' || field || case code
    when 'blank_required_value' then ' may not be blank' when 'invalid_type' then ' is not a valid decimal' when 'below_minimum' then ' is below its minimum' else ' is above its maximum' end as text from cell_issues
  union all select doc_id, record_index, 3, 0, 'duplicate_record_key: duplicate record key for item' from dups
  union all select doc_id, first_index, 4, record_index, 'duplicate_record_key: duplicate record key for item' from dups),
texts as (select doc_id, record_index, string_agg(text, '; ' order by place, other) as listed from said group by doc_id, record_index)"""

#: Ground truth of the order grid: what was asked for, with an error in every 29th line; expected decisions from the order's number.
TRUTH = """
truth as (
  select doc_id, ix, item, case when ix % 29 = 3 or doc_id % 31 = 0 then '1' else qty end as qty, price from lines where doc_id % 13 <> 0),
expected as (
  select doc_id as case_id, ix as row, 'item' as field, item as value from truth union all
  select doc_id, ix, 'quantity', case when qty = '' then null else qty end from truth union all
  select doc_id, ix, 'unit_price', price from truth),
predicted as (
  select doc_id as case_id, record_index as row, 'item' as field, case when item = '' then null else item end as value from recs union all
  select doc_id, record_index, 'quantity', case when qty = '' then null else qty end from recs union all
  select doc_id, record_index, 'unit_price', price from recs),
pb as (select case_id, row, field, value, count(*) as p from predicted where value is not null group by all),
eb as (select case_id, row, field, value, count(*) as e from expected where value is not null group by all),
bags as (select case_id, coalesce(p, 0) as p, coalesce(e, 0) as e from pb full join eb using (case_id, row, field, value)),
cellsum as (select case_id, sum(least(p, e)) as tp, sum(p - least(p, e)) as fp, sum(e - least(p, e)) as fn from bags group by case_id),
wp as (select case_id, row, list((field, value) order by field, value) as p from predicted group by all),
we as (select case_id, row, list((field, value) order by field, value) as e from expected group by all),
recsum as (select case_id, count(*) filter (where p = e) as exact_records, count(p) as predicted_records, count(e) as expected_records from wp full join we using (case_id, row) group by case_id),
cases as (
  select d.doc_id as case_id, d.decision, case when d.doc_id % 13 = 0 then 'rejected' when d.doc_id % 2 = 0 then 'needs_review' else 'accepted' end as expected_decision,
         cast(coalesce(tp, 0) as bigint) as true_positive, cast(coalesce(fp, 0) as bigint) as false_positive, cast(coalesce(fn, 0) as bigint) as false_negative,
         coalesce(exact_records, 0) as exact_records, coalesce(predicted_records, 0) as predicted_records, coalesce(expected_records, 0) as expected_records
  from decided d left join cellsum s on s.case_id = d.doc_id left join recsum r on r.case_id = d.doc_id),
summed as (
  select case_id, sum(true_positive) as tp, sum(false_positive) as fp, sum(false_negative) as fn, sum(exact_records) as ex, sum(greatest(predicted_records, expected_records)) as den,
         sum(cast(decision = expected_decision as int)) as ok, count(*) as cases
  from cases group by grouping sets ((case_id), ()))"""


def _with(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select}"


_COUNTERS = "cast(tp as bigint) as true_positive, cast(fp as bigint) as false_positive, cast(fn as bigint) as false_negative, cast(ex as bigint) as exact_records, cast(den as bigint) as record_denominator, cast(ok as bigint) as decision_correct, cases"
_ISSUED = f"{ORDER}, {RECORDS}"


def oracle_sql() -> dict[str, str]:
    digits = "case when raw like '-%' and d <> '0' then '-' || d else d end"
    return {
        "paragraphs": _with(PARAGRAPHS, "select doc_id, para_index, text from paras"),
        "text_warnings": _with(PARAGRAPHS, "select d.doc_id, count(p.doc_id) as n_paragraphs, case when count(p.doc_id) = 0 then 'no paragraph text detected in Word document' end as warning from documents d left join paras p using (doc_id) group by d.doc_id"),
        "full_text": _with(PARAGRAPHS, "select doc_id, string_agg(text, chr(10) order by para_index) as text from paras group by doc_id"),
        "sha256_docs": "select doc_id, sha256(text) as sha256, cast(octet_length(encode(text)) as bigint) as bytes from documents",
        "upload_check": r"select page_id, case when length(f) > 180 then substr(regexp_replace(f, '([^.])\.[^.]+$', '\1'), 1, 160) || lower(regexp_extract(f, '[^.](\.[^.]+)$', 1)) else f end as filename, case when lower(f) like '%.docx' then starts_with(html, 'PK') else contains(html[:1024], '<!DOCTYPE') end as signature_ok, octet_length(encode(html)) <= 26214400 as size_ok from (select *, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) as f from pages)",
        "output_filename": r"select page_id, case when substring(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[^A-Za-z0-9._ -]+', '_', 'g'), 1, 100) = '' then 'document' else substring(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[^A-Za-z0-9._ -]+', '_', 'g'), 1, 100) end || '-tables.csv' as filename from pages",
        "header_normalize": _with(PARAGRAPHS, f"select doc_id, para_index, {_norm('text')} as header from paras"),
        "sheet_safe": _with(PARAGRAPHS, f"select doc_id, para_index, {_safe('t')} as safe from (select doc_id, para_index, ['=', '  +', '-', ' @', chr(9), ''][doc_id % 6 + 1] || text as t from paras)"),
        "csv_line": _with(LINES, f"select doc_id, ix, {_csv('a')} || ',' || {_csv('b')} || ',' || {_csv('c')} as line from (select doc_id, ix, item as a, qty || case when doc_id % 3 = 0 then ', ' || chr(34) || price || chr(34) else '' end as b, case when doc_id % 4 = 0 then 'x' || chr(10) || price else price end as c from lines)"),
        "clipped_text": "select doc_id, case when length(text) > 160 then substring(text, 1, 157) || '...' else text end as shown from documents",
        "convert_integer": _with(LINES, f"select doc_id, ix, raw, case when regexp_matches(raw, '^[+-]?[0-9]+$') then {digits} end as value from (select *, regexp_replace(raw, '^[+-]?0*([0-9])', '\\1') as d from (select doc_id, ix, case doc_id % 5 when 0 then '+00' || qty when 1 then '-' || qty when 2 then qty || '.0' when 3 then '-000' else qty end as raw from lines))"),
        "convert_decimal": _with(LINES, "select doc_id, ix, raw, case when regexp_matches(raw, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then case when raw like '-%' then '-' else '' end || case when w = '' then '0' else w end || case when f <> '' then '.' || f else '' end end as value from (select *, regexp_replace(split_part(body, '.', 1), '^0+([0-9])', '\\1') as w, split_part(body, '.', 2) as f from (select *, regexp_replace(raw, '^[+-]', '') as body from (select doc_id, ix, case doc_id % 6 when 0 then '00' || price when 1 then '-' || price when 2 then '.' || qty when 3 then qty || '.' when 4 then '1,' || price else qty end as raw from lines)))"),
        "convert_boolean": "select c_custkey, raw, case when lower(raw) in ('true', 'yes', 'y', '1') then 'true' when lower(raw) in ('false', 'no', 'n', '0') then 'false' end as value from (select c_custkey, ['TRUE', 'Yes', 'y', '1', 'False', 'NO', 'n', '0', 't', ''][c_custkey % 10 + 1] as raw from customer)",
        "convert_date": "select o_orderkey, raw, case when o_orderkey % 7 in (5, 6) then null else strftime(o_orderdate, '%Y-%m-%d') end as value from (select o_orderkey, o_orderdate, case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%d %b %Y') when 3 then strftime(o_orderdate, '%Y-%-m-%-d') when 4 then strftime(o_orderdate, '%d/%m/%Y') when 5 then strftime(o_orderdate, '%Y-13-%d') else strftime(o_orderdate, '%Y%m%d') end as raw from orders)",
        "blank_required": _with(LINES, "select doc_id, ix from lines where qty = ''"),
        "pattern_check": "select c_custkey, name from (select c_custkey, case when c_custkey % 13 = 0 then replace(c_name, '#', '-') when c_custkey % 13 = 1 then c_name || chr(10) else c_name end as name from customer) where not regexp_full_match(name, 'Customer#[0-9]{9}')",
        "enum_check": "select o_orderkey, o_orderpriority as priority from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')",
        "bounds_check": "select p_partkey, case when p_retailprice < 1000 then 'below_minimum' else 'above_maximum' end as code from part where cast(p_retailprice as decimal(18,2)) < 1000 or cast(p_retailprice as decimal(18,2)) > 1500.5",
        "page_select": _with(LINES, "select doc_id, ix, item, qty, price from lines where ix // 5 + 1 = 2"),
        "page_count": _with(LINES, "select doc_id, max(ix // 5 + 1) as pages from lines group by doc_id"),
        "table_assess": _with(f"{EVENT}, {ASSESS}", "select doc_id, table_seq, page, n_rows, column_count, n_cells, n_empty, len(warnings) = 0 as looks_clean, array_to_string(warnings, '; ') as warnings from assessed"),
        "ragged_tables": _with(f"{EVENT}, {ASSESS}", "select doc_id, table_seq from assessed where column_count is null"),
        "tables_needing_review": _with(f"{EVENT}, {ASSESS}", "select doc_id, count(*) as n_tables, count(*) filter (where len(warnings) > 0) as needing_review from assessed group by doc_id"),
        "stitch_islands": _with(f"{EVENT}, {ASSESS}, {ISLANDS}", "select doc_id, table_seq, page, island from islands"),
        "stitch_header_drop": _with(f"{EVENT}, {ASSESS}, {ISLANDS}", "select doc_id, island as table_seq, min(page) as first_page, max(page) as last_page, cast(sum(n) as bigint) as n_rows from (select i.doc_id, i.island, i.table_seq, i.page, count(*) - count(*) filter (where r.row = 0 and i.table_seq <> i.island and r.cells = h.cells) as n from islands i join rws r using (doc_id, table_seq) join rws h on h.doc_id = i.doc_id and h.table_seq = i.island and h.row = 0 group by all) group by doc_id, island"),
        "alias_join": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, row, col, field from named"),
        "header_score": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, row, n_mapped, n_mapped / 4 as score, n_required / 3 as required_score from cand"),
        "header_best_row": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, header_row, c_item, c_quantity, c_price, c_note from matched"),
        "duplicate_headers": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, cast(n_doubles as int) as n_doubles from matched where n_doubles > 0"),
        "missing_required": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, array_to_string(list_filter([case when c_item is null then 'item' end, case when c_quantity is null then 'quantity' end, case when c_price is null then 'unit_price' end], lambda x: x is not null), ', ') as missing from matched where n_required < 3"),
        "unmapped_columns": _with(f"{ORDER}, {MATCH}", f"select doc_id, table_seq, i - 1 as source_column, header[i] as header from carried, unnest(range(1, len(header) + 1)) u(i) where kind = 'compatible' and {_strip('header[i]')} <> '' and not coalesce(list_contains(list_filter([c_item, c_quantity, c_price, c_note], lambda x: x is not null), i - 1), false)"),
        "partial_match": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, n_mapped / 4 as score from carried where kind = 'unmatched' and n_mapped > 0"),
        "table_classify": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, kind from matched"),
        "continuation": _with(f"{ORDER}, {MATCH}", "select doc_id, table_seq, page, kind, c_item, c_quantity, c_price from carried"),
        "blank_row_filter": _with(ORDER, f"select doc_id, table_seq, row from rws where len(list_filter(cells, lambda x: {_strip('x')} <> '')) = 0"),
        "record_index": _with(_ISSUED, "select doc_id, table_seq, row, record_index from recs"),
        "record_wide": _with(_ISSUED, "select doc_id, record_index, status, item, case when qty = '' then null else qty end as quantity, price as unit_price, cast(null as varchar) as note from stated"),
        "evidence_lookup": _with(_ISSUED, "select doc_id, record_index, 'quantity' as field, qty as raw, page, table_index, row, c_quantity as source_column from recs"),
        "issue_long": _with(_ISSUED, "select doc_id, record_index, row, field, code from cell_issues"),
        "unique_by": _with(_ISSUED, "select doc_id, first_index, record_index from dups"),
        "issue_counts": _with(_ISSUED, "select code, count(*) as n, count(distinct doc_id) as n_documents from every group by code"),
        "issue_dedupe": _with(_ISSUED, "select doc_id, scope, code, count(*) as n from every group by all"),
        "document_issues": _with(_ISSUED, "select doc_id, code from doc_issues"),
        "decision": _with(_ISSUED, "select doc_id, decision, issues from decided"),
        "summary": _with(_ISSUED, "select doc_id, detected_tables, matched_tables, compatible_tables, headerless_continuations, records, accepted_records, issues from decided"),
        "table_reports": _with(_ISSUED, "select c.doc_id, c.table_seq, c.page, case when kind = 'rejected' then 'rejected' when coalesce(i.n, 0) > 0 then 'needs_review' when kind = 'unmatched' then 'not_matched' else 'accepted' end as status, coalesce(r.n, 0) as record_count, coalesce(i.n, 0) as n_issues from carried c left join (select doc_id, table_seq, count(*) as n from table_issues group by all) i using (doc_id, table_seq) left join (select doc_id, table_seq, count(*) as n from recs group by all) r using (doc_id, table_seq)"),
        "fingerprint": """select doc_id, sha256('{"document_sha256":"' || sha256(text) || '","engine":{"name":"grid","version":"1"},"gridmill_version":"0.1.0","profile_sha256":"89f09bbccbb26e96a4257fb54fe28f22c358f32151c5888e8f38f82e4ea7cfc4","result_schema_version":"1.0"}') as fingerprint from documents""",
        "review_rows": _with(f"{ORDER}, {ASSESS}", "select doc_id, row_number() over (partition by doc_id order by table_seq) as table_number, 'page ' || page as location, n_rows, column_count, len(warnings) = 0 as looks_clean, false as has_merged_cells, array_to_string(warnings, '; ') as warnings from assessed"),
        "table_location": _with(f"{EVENT}, {ASSESS}, {ISLANDS}", "select doc_id, island as table_seq, case when count(*) > 1 then 'Pages ' || min(page) || '-' || max(page) else 'Page ' || min(page) end as location from islands group by doc_id, island"),
        "table_csv": _with(ORDER, f"select doc_id, table_seq, string_agg(line || chr(13) || chr(10), '' order by row) as csv from (select doc_id, table_seq, row, array_to_string(list_transform(cells, lambda x: {_csv('x')}), ',') as line from rws) group by doc_id, table_seq"),
        "preview_rows": _with(f"{ORDER}, {ASSESS}", "select r.doc_id, t.table_number, r.row, array_to_string(list_transform(r.cells, lambda c: case when length(c) > 160 then c[:157] || '...' else c end), '|') as cells from rws r join (select doc_id, table_seq, row_number() over (partition by doc_id order by table_seq) as table_number from assessed) t using (doc_id, table_seq) where table_number <= 10 and row < 25"),
        "tables_csv_export": _with(f"{ORDER}, {ASSESS}", f"""select doc_id, row_number() over (partition by doc_id order by t, part, n) as line_no, line from (
            select doc_id, -1 as t, 0 as part, i as n, case i when 1 then 'source,order ' || doc_id when 2 then 'source_type,grid' when 3 then 'document_warning,made up' else '' end as line from lasts, range(1, 5) r(i)
            union all select doc_id, table_seq, 0, i, case i when 1 then 'Table ' || row_number() over (partition by doc_id, i order by table_seq) || ',page ' || page
                when 2 then 'looks_clean,' || case when len(warnings) = 0 then 'True' else 'False' end when 3 then 'warnings,' || {_csv("array_to_string(warnings, '; ')")} else '' end from assessed, range(1, 5) r(i)
            union all select doc_id, table_seq, 1, row, array_to_string(list_transform(cells, lambda c: {_csv(_safe('c'))}), ',') from rws
            union all select doc_id, table_seq, 2, 0, '' from assessed)"""),
        "csv_export": _with(f"{_ISSUED}, {ISSUE_TEXTS}", f"""
            select doc_id, i as line_no, case i when 1 then 'decision,' || decision when 2 then 'profile,order-lines-v1' when 3 then 'document_sha256,' || sha256(cast(doc_id as varchar)) when 4 then ''
                else 'record,status,item,quantity,unit_price,note,issues' end as line from decided, range(1, 6) r(i)
            union all
            select doc_id, record_index + 6, (record_index + 1) || ',' || status || ',' || {_csv(_safe('item'))} || ',' || {_csv(_safe("coalesce(qty, '')"))} || ',' || {_csv(_safe('price'))} || ',,' || {_csv("coalesce(t.listed, '')")}
            from stated left join texts t using (doc_id, record_index)"""),
        "eval_cells": _with(f"{_ISSUED}, {TRUTH}", "select case_id, true_positive, false_positive, false_negative from cases"),
        "eval_records": _with(f"{_ISSUED}, {TRUTH}", "select case_id, exact_records, predicted_records, expected_records from cases"),
        "eval_micro": _with(f"{_ISSUED}, {TRUTH}", f"select {_COUNTERS} from summed where case_id is null"),
        "eval_by_case_grouping_sets": _with(f"{_ISSUED}, {TRUTH}", f"select case_id, {_COUNTERS} from summed"),
        "gate": _with(f"{_ISSUED}, {TRUTH}", "select tp / (tp + fp) >= 0.5 and ok / cases >= 0.9 as passed from summed where case_id is null"),
        "decision_pivot": _with(f"{_ISSUED}, {TRUTH}", "select expected_decision, count(*) filter (where decision = 'accepted') as accepted, count(*) filter (where decision = 'needs_review') as needs_review, count(*) filter (where decision = 'rejected') as rejected from cases group by expected_decision"),
        "duplicate_documents": "select text_sha256, n from (select sha256(text) as text_sha256, count(*) as n from documents group by 1) where n > 1",
        "profile_columns": "select * from (values ('invoice-lines-v1', 0, 'item'), ('invoice-lines-v1', 1, 'quantity'), ('invoice-lines-v1', 2, 'unit_price'), ('lab-coa-v1', 0, 'analyte'), ('lab-coa-v1', 1, 'result'), ('lab-coa-v1', 2, 'unit')) v(profile, position, name)",
    }
