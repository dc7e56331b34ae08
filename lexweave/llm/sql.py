"""The same results in SQL, for queries whose definition SQL can state on whole tables. Written from the definitions, not from
the operators: all pairs are compared, all word runs are listed."""

from __future__ import annotations

from lexweave.llm.boilerplate import LINES_MIN_DOCS

KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')".format
PLAIN = "replace(replace(lower({0}), chr(173), ''), chr(8203), '')".format
WORDS = f"regexp_extract_all({PLAIN('{0}')}, '[a-z0-9]+')".format

SETS = f"(select clause_id id, w, len(w) n from (select clause_id, list_distinct({WORDS('min(clause_text)')}) w from policy_clauses group by clause_id) where len(w) > 0)"
SPLITS = (
    "(select clause_id id, arg_max(s, (assigned_at, s)) s from (select clause_id, assigned_at, case when t in ('train', 'training') then 'train' when t in ('val', 'validation') then 'validation' when t in ('test', 'gold') then t end s"
    " from (select *, lower(trim(replace(split_name, chr(160), ' '))) t from split_assignments)) where s is not null group by clause_id)"
)
NEAR = "len(list_intersect(a.w, b.w)) * 9 >= 4 * (a.n + b.n)"  # both / (n_a + n_b - both) >= 4 / 5
SIZES = "a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4"

FORM = (
    "case when len(c) >= 3 and len(list_filter(c, lambda x: not regexp_full_match(x, '(?s)\\s*[^:]*[A-Za-z0-9][^:]*:\\s*\\S.*'))) = 0"
    " then 'C' || array_to_string(list_sort(list_transform(c, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'))), '|') else 'T' || regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') end"
)
COPIES = (
    f"(select id, own, {FORM} form from (select distinct clause_id id, {KEY('app_name')} own, clause_text t, list_filter(regexp_split_to_array(clause_text, '[|\\t\\n\\r]'), lambda x: trim(x) <> '') c from policy_clauses where app_name is not null and clause_text is not null) where regexp_matches(lower(t), '[a-z0-9]'))"
)
CLEAR = "(select distinct clause_id, app_name, source_file, clause_text from raw_clauses r where not exists (select 1 from pages_in p where p.needs_ocr and p.doc = r.source_file and p.page_number = r.page_start))"
LINE = "regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^a-z0-9]+', '', 'g')"
LINES = f"(select clause_id, {KEY('app_name')} own, source_file, (n - 1)::int line_no, {LINE} k from (select *, unnest(string_split(clause_text, chr(10))) line, generate_subscripts(string_split(clause_text, chr(10)), 1) n from {CLEAR}) where {LINE} <> '' and app_name is not null)"
GONE = f"(select distinct clause_id, line_no from {LINES} l join (select own, k from {LINES} group by own, k having count(distinct source_file) >= {LINES_MIN_DOCS}) f using (own, k))"

LINES_MIN_SHARE = 0.5  # of p4_by_share
GONE_BY_SHARE = f"(select distinct clause_id, line_no from {LINES} l join (select own, k, count(distinct source_file) c from {LINES} group by own, k having c >= {LINES_MIN_DOCS}) f using (own, k) join (select own, count(distinct source_file) n from {LINES} group by own) using (own) where c >= {LINES_MIN_SHARE} * n)"

SQL = {
    "p1_found": f"select least(a.id, b.id) as clause_id_a, greatest(a.id, b.id) as clause_id_b from (select * from {SETS} join {SPLITS} using (id) where s = 'train') a join (select * from {SETS} join {SPLITS} using (id) where s <> 'train') b on {SIZES} and {NEAR}",
    "p2_found": f"select min(id) over (partition by own, form) as keep_clause_id, id as clause_id from {COPIES} qualify min(id) over (partition by own, form) <> id",
    "p2_copy_counts": f"select min(id) as keep_clause_id, count(distinct id) as n_copies from {COPIES} group by own, form",
    "p3_found": f"with recursive e as (select distinct {KEY('app_name')} a, {KEY('source_document')} d from policy_clauses where {KEY('app_name')} <> '' and {KEY('source_document')} <> ''), n as (select distinct x.a, y.a b from e x join e y using (d)),"
    " r as (select a, b from n union select r.a, n.b from r join n on n.a = r.b) select a as app_a, b as app_b from r where a < b",
    "p4_found": f"select clause_id, line_no from {GONE}",
    "p4_clean_blocks": "with t as (select clause_id, min(clause_text) x from raw_clauses group by clause_id), l as (select clause_id, unnest(string_split(x, chr(10))) line, generate_subscripts(string_split(x, chr(10)), 1) - 1 line_no from t where x is not null),"
    f" k as (select l.clause_id, coalesce(string_agg(line, chr(10) order by l.line_no) filter (g.line_no is null), '') clean, count(g.line_no) n from l left join {GONE} g on g.clause_id = l.clause_id and g.line_no = l.line_no group by l.clause_id)"
    " select t.clause_id, clean as clean_text, coalesce(n, 0)::int as n_removed from t left join k using (clause_id)",
    "p6_found": f"with recursive s as materialized {SETS}, p as materialized (select a.id a, b.id b from s a join s b on a.id < b.id and {SIZES} and {NEAR}), e as (select a, b from p union all select b, a from p),"
    " r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b) select min(b) as group_clause_id, a as clause_id from r group by a having min(b) < a",
    "p9_found": f"with g as (select distinct item_id, array_to_string(w[i:i + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from (select item_id, {WORDS('text')} w from eval_items))), d as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from (select doc_id, {WORDS('text')} w from documents)))"
    " select distinct item_id, doc_id from g join d using (g)",
    "p9_runs": f"with g as (select item_id, i, array_to_string(w[i:i + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from (select item_id, {WORDS('text')} w from eval_items))), d as (select distinct doc_id, i j, array_to_string(w[i:i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from (select doc_id, {WORDS('text')} w from documents))),"
    " m as (select item_id, doc_id, j - i k, i - row_number() over (partition by item_id, doc_id, j - i order by i) r from g join d using (g)), n as (select item_id, doc_id, count(*) + 11 c from m group by item_id, doc_id, k, r) select item_id, doc_id, max(c)::int as run_words from n group by item_id, doc_id",
    "p4_by_share": f"select clause_id, line_no from {GONE_BY_SHARE}",
    "p1_overlaps": f"select a.id as clause_id, a.s as split, count(*) as n_links, round(max(len(list_intersect(a.w, b.w)) / a.n), 6) as overlap from (select * from {SETS} join {SPLITS} using (id) where s <> 'train') a"
    f" join (select * from {SETS} join {SPLITS} using (id) where s = 'train') b on {SIZES} and {NEAR} group by a.id, a.s",
    "p1_report": f"with l as materialized (select a.id, count(*) n from (select * from {SETS} join {SPLITS} using (id) where s <> 'train') a join (select * from {SETS} join {SPLITS} using (id) where s = 'train') b on {SIZES} and {NEAR} group by a.id)"
    f" select s as split, app_key, count(*) as n_records, count(l.n) as n_overlapping, coalesce(sum(l.n), 0)::bigint as n_links from {SPLITS} e join (select clause_id id, coalesce(min({KEY('app_name')}), '') app_key from policy_clauses group by clause_id) p using (id)"
    " left join l using (id) where s <> 'train' group by s, app_key",
    "p6_groups": f"with recursive s as materialized {SETS}, p as materialized (select a.id a, b.id b from s a join s b on a.id < b.id and {SIZES} and {NEAR}), e as (select a, b from p union all select b, a from p),"
    " r as (select id a, id b from s union select r.a, e.b from r join e on e.a = r.b) select a as clause_id, min(b) as group_id, count(*)::bigint as group_size from r group by a",
    # what must hold of results that SQL can't make
    "p5_checks": "select distinct clause_id, true as within_limit, true as same_text, true as covered, true as in_order from policy_clauses where length(clause_text) > 1400",
    "p3_checks": "select count(distinct clause_id) as n_ids, 0::bigint as torn_apps, 0::bigint as torn_documents, true as near_targets from policy_clauses",
    "p8_checks": "select count(*) as n_docs, 0::bigint as n_misplaced, 0::bigint as n_cut, 0::bigint as n_overfull, true as near_bound from documents",
}
