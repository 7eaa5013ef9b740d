"""The knowledge queries in SQL, for comparison."""

_N = "n as (select id, any_value(name) name, any_value(kind) kind, any_value(review_state) review_state, any_value(ord) ord, any_value(condition) condition from taxonomy_node where id is not null group by id)"
_B = "b as (select block_id, any_value(parse_id) parse_id, any_value(structural_key) structural_key, any_value(kind) kind, any_value(title) title, any_value(text_raw) text_raw, any_value(source) source from content_block where block_id is not null group by block_id)"
_FACTS = f"""{_N},
raw as (select id, 'packaging' field, '罐装' v, 'verified' s from n where contains(name, '罐头')
  union all select id, 'packaging', '瓶装', 'verified' from n where contains(name, '饮料') or contains(name, '汁')
  union all select id, 'process', '熟制', 'verified' from n where contains(name, '熟制') union all select id, 'process', '速冻', 'verified' from n where contains(name, '速冻')
  union all select id, 'process', '生鲜', 'unverified' from n where contains(name, '生干')
  union all select id, 'food_part', '根', 'verified' from n where contains(name, '莲藕') or contains(name, '萝卜')
  union all select id, 'food_part', '果', 'conflicting' from n where contains(name, '辣椒') or contains(name, '番茄')),
fold as (select id, field, case when bool_or(s = 'conflicting') or count(distinct case when s = 'verified' then v end) > 1 then 'conflicting'
  when bool_and(s = 'verified') then 'known' else 'unknown' end state, min(case when s = 'verified' then v end) v from raw group by id, field)"""
_WALK = """links as (select child_id c, min(parent_id) p from taxonomy_relation where child_id <> '' and parent_id <> '' group by child_id),
walk as (select p node, [p] path from (select distinct p from links where p not in (select c from links))
  union all select l.c, list_append(w.path, l.c) from walk w join links l on l.p = w.node),
line as (select node, path[i] ancestor, i - 1 pos, len(path) - i distance from (select node, path, unnest(range(1, len(path) + 1)) i from walk))"""
_V = "v as (select designation, min(published_at) d, regexp_replace(regexp_replace(trim(designation), '\\s*[-—–]\\s*\\d{4}$', ''), '\\.\\d+$', '') family from documents where designation is not null and published_at is not null group by designation)"
_LINES = f"""{_B}, doc as (select block_id, string_split(replace(replace(text_raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) l from b where text_raw is not null),
lines as (select block_id, i as line, l[i] as text from (select block_id, l, unnest(range(1, len(l) + 1)) i from doc))"""
_CELLS = f"""{_LINES},
bar as (select *, line - row_number() over (partition by block_id order by line) isl from lines where contains(text, '|')),
rk as (select *, row_number() over (partition by block_id, isl order by line) r from bar),
tb as (select block_id, isl, dense_rank() over (partition by block_id order by isl) table_no from rk where r = 2 and regexp_matches(text, '^\\s*\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?\\s*$')),
body as (select block_id, isl, table_no, case when r = 1 then 0 else r - 2 end row_index, list_transform(string_split(regexp_replace(trim(text), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)) c from rk join tb using (block_id, isl) where r <> 2),
wide as (select *, greatest(max(case when row_index = 0 then len(c) end) over (partition by block_id, isl), len(c)) w from body),
cells as (select block_id, table_no, row_index, i - 1 as col, c[i] as val, row_index = 0 is_header, i > len(c) missing from (select *, unnest(range(1, w + 1)) i from wide)),
req as (select block_id, table_no, row_index, max(val) filter (col = 0) p, max(val) filter (col = 1) l, max(val) filter (col = 2) method from cells where not is_header and col < 3 group by block_id, table_no, row_index),
lim as (select block_id, row_index, trim(regexp_replace(p, '[（(][^（()）]*[)）]\\s*$', '')) project, nullif(regexp_extract(p, '[（(]([^（()）]*)[)）]\\s*$', 1), '') unit,
  case when regexp_extract(l, '^\\s*([≤≥<>＜＞])', 1) in ('≥', '>', '＞') then 'lower_limit' when regexp_extract(l, '^\\s*([≤≥<>＜＞])', 1) in ('≤', '<', '＜') then 'upper_limit' else 'qualitative' end comparator,
  regexp_extract(regexp_replace(regexp_extract(l, '([0-9][0-9 .]*)', 1), '\\s', '', 'g'), '^\\d+(?:\\.\\d+)?$') value, method from req)"""
_STD = r"'(?:^|[^A-Za-z])((?:GB|NY|SN|FS|SQ)(?:/[TZ])?\s*\d+(?:\.\d+)*(?:[-—–]\d{4})?)'"
_CITED = f"""{_B}, cited as (select block_id, any_value(parse_id) parse_id, s from (select block_id, parse_id, trim(regexp_replace(unnest(regexp_extract_all(text_raw, {_STD}, 1)), '\\s+', ' ', 'g')) s from b) group by block_id, s)"""

ORACLE = {
    "fact_fold": f"with {_FACTS} select id, field, state, case when state = 'known' then v end as value from fold",
    "condition_states": f"""with {_FACTS},
ev as (select n.id, condition c, json_extract_string(condition.ast_json, '$.field') f, json_extract_string(condition.ast_json, '$.value') want, coalesce(condition.required_facts, []) need from n),
req as (select id, bool_or(coalesce(fold.state, 'unknown') = 'conflicting') clash, bool_or(coalesce(fold.state, 'unknown') = 'unknown') lacking
  from (select id, unnest(need) nf from ev) q left join fold using (id) where fold.field = nf or fold.field is null group by id, nf),
need as (select q.id, bool_or(coalesce(f.state, 'unknown') = 'conflicting') clash, bool_or(coalesce(f.state, 'unknown') = 'unknown') lacking
  from (select id, unnest(need) nf from ev) q left join fold f on f.id = q.id and f.field = q.nf group by q.id),
inn as (select ev.*, case when f.state is null or f.state = 'unknown' then 'unknown' when f.state = 'conflicting' then 'conflicting' when f.v = want then 'applicable' else 'not_applicable' end i from ev left join fold f on f.id = ev.id and f.field = ev.f)
select inn.id, case
  when c is null or not coalesce(c.state in ('structured', 'resolved', 'unconditional') and c.has_evidence, false) then case when coalesce(clash, false) then 'conflicting' else 'unknown' end
  when c.ast_json is null then case when c.state = 'unconditional' and len(need) = 0 then 'applicable' else 'unknown' end
  when coalesce(clash, false) then 'conflicting' when i = 'applicable' and coalesce(lacking, false) then 'unknown' else i end state
from inn left join need nd on nd.id = inn.id""",
    "condition_compiled": """select case when l_quantity >= 10 and l_quantity < 24 and (l_returnflag in ('A', 'R') or not l_discount > 0.05) then 'applicable' else 'not_applicable' end state, l_returnflag, count(*) n from lineitem group by all""",
    "inherited_states": f"""with recursive {_WALK}, {_N},
s as (select line.node, case when review_state in ('approved', 'machine_checked') then 'applicable' when review_state = 'review_pending' then 'not_applicable' else 'unknown' end st from line left join n on n.id = line.ancestor)
select node, case when bool_or(st = 'conflicting') then 'conflicting' when bool_or(st = 'not_applicable') then 'not_applicable' when bool_or(st = 'unknown') then 'unknown' else 'applicable' end state from s group by node""",
    "inherited_requirements": f"""with recursive {_WALK}, {_N} select node, count(*) n_requirements, count(distinct condition.ast_json) n_kinds, min(distance)::bigint nearest
from line join n on n.id = ancestor where condition.state = 'structured' group by node""",
    "nearest_approved": f"""with recursive {_WALK}, {_N} select node, arg_min(ancestor, distance) nearest, min(distance)::bigint distance from line join n on n.id = ancestor where review_state = 'approved' and kind = 'category' group by node""",
    "shared_targets": """with b as (select bridge_id, any_value(section_id) section_id, any_value(targets) targets from inspection_bridges group by bridge_id),
m as (select split_part(section_id, '-', 1) chapter, section_id, c.family from (select section_id, unnest(targets) t from b) x join canonical_food c on c.name = t where section_id is not null),
need as (select chapter, count(distinct section_id) k from m group by chapter)
select chapter, family from m join need using (chapter) group by chapter, family, k having count(distinct section_id) = k""",
    "prefix_descendants": f"""with {_B}, p as (select structural_key k, bool_or(kind = 'table') resolved from b where regexp_matches(structural_key, '^\\d+(\\.\\d+)*$') group by k)
select a.k as path, count(c.k) n_resolved from p a left join p c on c.resolved and starts_with(c.k, a.k || '.') where not a.resolved group by a.k""",
    "impact_closure": """
with recursive e as (select source_asset_id s, record_id d from evidence where source_asset_id <> '' and record_id <> '' union select parent_id, child_id from taxonomy_relation where parent_id <> '' and child_id <> '' and parent_id <> child_id),
w as (select distinct asset_id node, 0 depth from source_asset where deleted_at is not null union select e.d, w.depth + 1 from w join e on e.s = w.node where w.depth < 256)
select depth::bigint depth, count(*) n_nodes from (select node, min(depth) depth from w group by node) group by depth""",
    "category_expansion": f"""with {_N}, e as (select parent_id s, child_id d, bool_or(coalesce(has_evidence, false)) ok from taxonomy_relation where parent_id <> '' and child_id <> '' group by s, d),
l0 as (select id start, id node, [id] path from n where kind = 'category'),
t1 as (select l0.start, e.d, e.ok, list_contains(path, e.d) cyc, list_append(path, e.d) path from l0 join e on e.s = l0.node),
l1 as (select start, d node, any_value(path) path from t1 where ok and not cyc group by start, d),
t2 as (select l1.start, e.d, e.ok, list_contains(path, e.d) cyc, list_append(path, e.d) path from l1 join e on e.s = l1.node),
l2 as (select start, d node, any_value(path) path from t2 where ok and not cyc group by start, d),
t3 as (select l2.start, e.d, e.ok, list_contains(path, e.d) cyc, list_append(path, e.d) path from l2 join e on e.s = l2.node),
l3 as (select start, d node, any_value(path) path from t3 where ok and not cyc group by start, d),
t4 as (select l3.start, e.d, e.ok, list_contains(path, e.d) cyc from l3 join e on e.s = l3.node),
r as (select start, 0 depth from l0 union all select start, 1 from l1 union all select start, 2 from l2 union all select start, 3 from l3),
u as (select start, false deep, not ok unk from t1 union all select start, false, not ok from t2 union all select start, false, not ok from t3 union all select start, ok and not cyc, not ok from t4)
select a.start, n_reached, depth, coalesce(n_too_deep, 0) n_too_deep, coalesce(n_unknown, 0) n_unknown
from (select start, count(*) n_reached, max(depth)::bigint depth from r group by start) a left join (select start, count(*) filter (deep) n_too_deep, count(*) filter (unk) n_unknown from u group by start) b using (start)""",
    "broken_edges": """with e as (select distinct id, child_id s, parent_id d from taxonomy_relation where parent_id <> '' and child_id <> ''), n as (select distinct id from taxonomy_node),
x as (select 'MISSING_TARGET' code, id from e where d not in (select id from n where id is not null) union all select 'MISSING_SOURCE', id from e where s not in (select id from n where id is not null)
  union all select 'SELF_LINK', id from e where s = d union all select 'DUPLICATE_LINK', min(id) from e group by s, d having count(distinct id) > 1)
select code, count(distinct id) n from x group by code""",
    "version_intervals": f"""with {_V}, w as (select family, d lower, lead(d) over (partition by family order by d) upper from (select distinct family, d from v)),
p as (select v.family, v.designation, w.lower, w.upper from v join w on w.family = v.family and w.lower = v.d),
c as (select doc_id, regexp_replace(regexp_replace(trim(designation), '\\s*[-—–]\\s*\\d{{4}}$', ''), '\\.\\d+$', '') family, published_at + interval 200 day bd from documents where designation is not null and published_at is not null),
m as (select doc_id, designation, bd >= lower and (upper is null or bd < upper) ok from c join p using (family)),
s as (select doc_id, count(*) filter (ok) k, min(designation) filter (ok) win from m group by doc_id)
select doc_id case_id, case when k > 1 then 'conflicting' when k = 1 then 'applicable' else 'not_applicable' end state, case when k = 1 then win end version_id, k n_applicable from s""",
    "version_order": f"with {_V} select family, designation, rank from (select family, designation, row_number() over (partition by family order by d desc, designation) as rank from v) where rank <= 2",
    "bound_references": f"""with {_CITED}, r as (select distinct s, trim(regexp_replace(s, '\\s*[-—–]\\s*\\d{{4}}$', '')) f, regexp_matches(s, '[-—–]\\d{{4}}$') dated from cited),
h as (select distinct designation d, trim(regexp_replace(trim(designation), '\\s*[-—–]\\s*\\d{{4}}$', '')) f from documents where designation is not null),
j as (select r.s, h.d from r left join h on (dated and h.d = r.s) or (not dated and h.f = r.f))
select s reference_id, case when count(distinct d) = 1 then 'bound' when count(distinct d) > 1 then 'ambiguous' else 'unbound' end binding, case when count(distinct d) = 1 then min(d) end version_id, count(distinct d) n_targets from j group by s""",
    "folded_dates": """select designation, case when count(distinct published_at::date) > 1 then 'conflicting' when bool_and(coalesce(source <> 'review_note', false) and published_at is not null) then 'applicable' else 'unknown' end state,
  case when count(distinct published_at::date) <= 1 and bool_and(coalesce(source <> 'review_note', false) and published_at is not null) then min(published_at::date)::varchar end as value from documents where designation is not null group by designation""",
    "incoming_outcomes": """
with h as (select id, coalesce(food, chr(1)) || '|' || coalesce(status, chr(1)) || '|' || coalesce(owner, chr(1)) h, ingested_at >= '2025-01-01' new from queries where id is not null),
x as (select id, min(h) filter (new) nl, max(h) filter (new) nh, min(h) filter (not new) ol, max(h) filter (not new) oh from h group by id)
select case when nl <> nh then 'conflict' when ol is null then 'new' when ol = nl and oh = nl then 'duplicate' else 'conflict' end outcome, count(*) n from x where nl is not null group by 1""",
    "absent_assets": "select distinct source_asset_id asset_id from evidence where source_asset_id <> '' and source_asset_id not in (select asset_id from source_asset where asset_id is not null)",
    "first_wins": """
with f as (select designation, arg_min(coalesce(title, chr(1)), doc_id) t, arg_min(coalesce(lang, chr(1)), doc_id) l from documents where designation is not null group by designation)
select doc_id, designation from documents join f using (designation) where (title <> t and title <> '' and t <> '' and t <> chr(1)) or (lang <> l and lang <> '' and l <> '' and l <> chr(1))""",
    "latest_reviews": "select query_id, action from (select query_id, action, row_number() over (partition by query_id order by created_at desc, id desc) rk from reviews where query_id <> '') where rk = 1",
    "review_transitions": """
with r as (select distinct id, query_id, created_at, action from reviews where query_id <> '' and action is not null), p as (select lag(action) over (partition by query_id order by created_at, id) a, action b from r)
select a from_value, b to_value, count(*) n from p where a is not null and b is not null group by all""",
    "monthly_outcomes": """
with q as (select distinct id, status, strftime(created_at, '%Y-%m') as month from queries)
select month, count(*) filter (status = 'matched') n_matched, count(*) filter (status = 'no_match') n_no_match, count(*) filter (status = 'ambiguous') n_ambiguous, count(*) filter (status = 'needs_fact') n_needs_fact,
  count(*) filter (status not in ('matched', 'no_match', 'ambiguous', 'needs_fact')) n_other, count(*) filter (status is null) n_null from q group by month""",
    "tiered_binding": """
with b as (select bridge_id, any_value(name) name, any_value(targets) targets from inspection_bridges where bridge_id is not null group by bridge_id),
t as (select bridge_id, entry_id e, 1 tier from b join canonical_food c on c.name = b.name
  union all select bridge_id, entry_id, 2 from b join (select entry_id, unnest(aliases) a from canonical_food) on a = b.name
  union all select bridge_id, entry_id, 3 from (select bridge_id, unnest(targets) t from b) join canonical_food c on c.name = t),
f as (select bridge_id, min(tier) tier from t group by bridge_id), g as (select t.bridge_id, t.tier, count(distinct e) k, min(e) e from t join f using (bridge_id, tier) group by all)
select bridge_id, case when k = 1 then e end target, tier::bigint tier from b left join g using (bridge_id)""",
    "asset_manifests": """
with h as (select distinct media_type, sha256(asset_id) h from source_asset where asset_id is not null),
c as (select media_type, ('0x' || substr(h, 1, 8))::bigint % 1024 cell, count(*) n, sha256(string_agg(h, '' order by h)) c from h group by 1, 2)
select media_type, sum(n)::bigint n_members, sha256(string_agg(c, '' order by cell)) manifest from c group by media_type""",
    "file_checks": """select media_type, case when not coalesce(regexp_matches(asset_id, '^[0-9a-f]{64}$'), false) then 'malformed_id' when coalesce(storage_key <> 'objects/' || substr(asset_id, 1, 2) || '/' || asset_id, true) then 'misplaced' else 'ok' end status,
  count(distinct asset_id) n from source_asset group by all""",
    "manifest_status": """
with a as (select block_ids[1] block_id, min(sha256(retrieval_text)) h from chunk where chunk_id is not null group by 1), b as (select block_id, min(sha256(text_raw)) h from content_block where block_id is not null group by 1)
select case when b.h is null then 'missing' when a.h is null then 'unlisted' when a.h = b.h then 'verified' else 'mismatch' end status, count(*) n from a full join b using (block_id) group by 1""",
    "snapshot_changes": """
with o as (select query_id, string_agg(distinct coalesce(action, chr(1)), '|' order by coalesce(action, chr(1))) h from reviews where query_id <> '' and ingested_at < '2025-01-01' group by 1),
n as (select query_id, string_agg(distinct coalesce(action, chr(1)), '|' order by coalesce(action, chr(1))) h from reviews where query_id <> '' and ingested_at >= '2024-01-01' group by 1)
select change, count(*) n from (select case when o.h is null then 'added' when n.h is null then 'removed' when o.h <> n.h then 'changed' end change from o full join n using (query_id)) where change is not null group by change""",
    "block_coverage": """
with u as (select block_id, count(*) k, bool_or(coalesce(e, false)) e from (select unnest(block_ids) block_id, e from (select chunk_id, any_value(block_ids) block_ids, any_value(retrieval_enabled) e from chunk group by chunk_id)) group by block_id)
select case when k is null then 'uncovered' when e then 'retrievable' else 'context_only' end status, count(*) n, sum(k)::bigint n_uses from (select distinct block_id from content_block where block_id is not null) left join u using (block_id) group by 1""",
    "violations": """
with x as (select 'CHUNK_TEXT_MISSING' code, chunk_id id from chunk where retrieval_text is null or retrieval_text = ''
  union select 'CHUNK_BLOCK_MISSING', chunk_id from (select chunk_id, unnest(block_ids) bl from chunk) where bl not in (select block_id from content_block where block_id is not null)
  union select 'TOKEN_COUNT_UNKNOWN', chunk_id from chunk where token_count is null union select 'NODE_NAME_MISSING', id from taxonomy_node where name is null or name = ''
  union select 'CONDITION_UNEVIDENCED', id from taxonomy_node where condition.state = 'structured' and not condition.has_evidence union select 'QUOTE_MISSING', evidence_id from evidence where quote is null or quote = '')
select code, count(*) n from x group by code""",
    "line_ranges": f"""with {_B}, r as (select distinct parse_id, r[1]::bigint a, r[2]::bigint z from (select parse_id, unnest(source.line_ranges) r from b) where r[2] >= r[1]),
m as (select *, max(z) over (partition by parse_id order by a, z rows between unbounded preceding and 1 preceding) reach from r),
g as (select *, sum(case when reach is null or a > reach + 1 then 1 else 0 end) over (partition by parse_id order by a, z rows unbounded preceding) i from m)
select parse_id, min(a) as first, max(z) as last from g group by parse_id, i""",
    "page_islands": """with p as (select distinct source_asset_id, pdf_page::bigint n from evidence where source_asset_id <> '' and pdf_page is not null)
select source_asset_id, min(n) as first, max(n) as last from (select *, n - row_number() over (partition by source_asset_id order by n) i from p) group by source_asset_id, i""",
    "titles_filled_down": f"with {_B} select block_id, last_value(title ignore nulls) over (partition by parse_id order by source.line_start nulls first, block_id rows between unbounded preceding and current row) title_filled from b",
    "text_sections": f"""with {_LINES}, h as (select *, regexp_matches(text, '^\\s{{0,3}}(?:#{{1,6}}\\s+.*|(?:[A-Z]\\.)?\\d+(?:\\.\\d+)*[ \\t　]+\\S.*)$') hd from lines),
s as (select *, sum(case when hd then 1 else 0 end) over (partition by block_id order by line rows unbounded preceding) k from h)
select block_id, min(line)::bigint as first, max(line)::bigint as last, sum(length(text))::bigint n_chars, bool_or(hd) has_heading from s group by block_id, k""",
    "table_cells": f"with {_CELLS} select block_id, table_no, row_index, col as \"column\", case when not missing then val end as value, is_header, missing from cells",
    "requirement_rows": f"with {_CELLS} select block_id, row_index, project, unit, comparator, nullif(value, '') as value, method from lim",
    "limit_conflicts": f"""with {_CELLS}, g as (select block_id, project, unit, count(distinct try_cast(value as decimal(38,18))) filter (comparator = 'upper_limit') u, count(distinct try_cast(value as decimal(38,18))) filter (comparator = 'lower_limit') l,
  min(try_cast(value as decimal(38,18))) filter (comparator = 'upper_limit') lu, max(try_cast(value as decimal(38,18))) filter (comparator = 'lower_limit') ml from lim where project is not null and unit is not null and value <> '' group by all)
select block_id, project, unit, case when ml > lu then 'crossing' else 'different_values' end reason from g where ml > lu or u > 1 or l > 1""",
    "greedy_context": f"""with recursive {_B}, o as (select parse_id, block_id, coalesce(length(text_raw), 0) n, row_number() over (partition by parse_id order by source.line_start nulls first, block_id) i from b where parse_id is not null),
w as (select parse_id, block_id, i, n <= 3000 kept, case when n <= 3000 then n else 0 end total, case when n <= 3000 then 1 else 0 end k from o where i = 1
  union all select o.parse_id, o.block_id, o.i, w.k < 40 and w.total + o.n <= 3000, w.total + case when w.k < 40 and w.total + o.n <= 3000 then o.n else 0 end, w.k + case when w.k < 40 and w.total + o.n <= 3000 then 1 else 0 end
    from w join o on o.parse_id = w.parse_id and o.i = w.i + 1)
select parse_id, block_id, kept from w""",
    "standards_usage": f"with {_CITED} select s standard, trim(regexp_replace(s, '\\s*[-—–]\\s*\\d{{4}}$', '')) family, count(*) n_blocks, count(distinct parse_id) n_parses from cited group by s",
    "designations": "select distinct designation, regexp_replace(trim(designation), '\\s*[-—–]\\s*\\d{4}$', '') family, try_cast(regexp_extract(designation, '[-—–]\\s*(\\d{4})$', 1) as bigint) as year from documents where designation is not null",
    "pointer_parts": """select regexp_extract(json_pointer, '^/([^/]+)/(\\d+)$', 1) as part, count(*) n, count(*) filter ('/' || regexp_extract(json_pointer, '^/([^/]+)/(\\d+)$', 1) || '/' || regexp_extract(json_pointer, '^/([^/]+)/(\\d+)$', 2) = json_pointer) n_same,
  max(try_cast(regexp_extract(json_pointer, '^/([^/]+)/(\\d+)$', 2) as bigint)) largest from evidence where json_pointer is not null group by 1""",
    "distinct_content": "select content_hash, min(chunk_id) chunk_id, count(distinct chunk_id) n_chunks from chunk where retrieval_enabled and content_hash is not null and chunk_id is not null group by content_hash",
    "evidence_trace": f"""with {_N}, e as (select evidence_id, any_value(record_id) record_id, any_value(source_asset_id) a, any_value(locator_quality) locator_quality from evidence where evidence_id is not null group by 1),
s as (select asset_id a, min(media_type) media_type from source_asset where asset_id is not null group by 1)
select kind, media_type, locator_quality, count(*) n from e left join n on n.id = e.record_id left join s using (a) group by all""",
    "evidence_quality": """with e as (select evidence_id, any_value(locator_quality) locator_quality, any_value(quote) quote, any_value(pdf_page) pdf_page from evidence where evidence_id is not null group by 1)
select locator_quality, count(*) n, round(count(quote) / count(*), 6) quoted, round(count(pdf_page) / count(*), 6) paged from e group by 1""",
    # A blank after each word that may follow a clause keeps neighbouring citations apart: the patterns here cannot look around.
    "clause_citations": f"""with {_B}, t as (select block_id, regexp_replace(regexp_replace(regexp_replace(text_raw, '(?m)^\\s*(?:[A-Z]\\.)?\\d+(?:\\.\\d+)*\\s', ' ', 'g'), '<[^>]*>|[（(]\\s*[A-Z]?\\.?\\d+\\s*[)）]', ' ', 'g'), '(的|中|规定|条|款)', '\\1 ', 'g') t from b),
c as (select distinct block_id, unnest(regexp_extract_all(t, '(?:^|[^A-Za-z0-9.])([A-Z](?:\\.\\d+)+|\\d+(?:\\.\\d+)+)(?:的|中|规定|条|款)', 1)) clause from t)
select clause, count(*) n_blocks from c group by clause""",
    "text_quality": """with d as (select doc_id, text, regexp_replace(text, '[\\s\\x0b\\x85\\p{Z}]', '', 'g') seen from documents),
ch as (select doc_id, c, row_number() over (partition by doc_id) i from (select doc_id, unnest(string_split(text, '')) c from documents where text <> '')),
runs as (select doc_id, c, i - row_number() over (partition by doc_id, c order by i) g from ch where not regexp_matches(c, '\\s')),
rep as (select distinct doc_id from (select doc_id from runs group by doc_id, c, g having count(*) >= 20))
select concat_ws(',', case when text is null or seen = '' then 'empty' end, case when regexp_matches(text, '\\x{FFFD}|[\\x{E000}-\\x{F8FF}]|\\(cid:\\d+\\)') then 'garbled' end,
  case when rep.doc_id is not null then 'repeated' end, case when seen <> '' and length(regexp_replace(seen, '[^\\p{P}\\p{S}]', '', 'g')) * 2 > length(seen) then 'symbols' end) flags, count(*) n
from d left join rep using (doc_id) group by 1""",
}
