"""Segmentation, duplicates, joins and ranking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.functions.keys import computed_once
from lexweave.operators import curation, duplicates, routing, segment, taxonomy
from lexweave.plans.registry import Query, lit, sql_any, sql_canonical, sql_display, sql_heading, sql_joined, sql_line, sql_list, table

PC, SC = "policy_clauses", "statutory_clauses"
ONE = "(select clause_id, min(clause_text) clause_text, min(app_name) app_name, min(source_document) source_document from policy_clauses group by clause_id)"


def _one(spark, d):
    """policy_clauses with one row for each clause_id."""
    g = table(spark, d, PC).groupBy("clause_id")
    return g.agg(*[F.min(c).alias(c) for c in ("clause_text", "app_name", "source_document")])


LINES_SQL = "select doc, page_number, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from (select distinct doc, page_number, text from pages_in)"
KEYS_SQL = f"select distinct doc, page_number, lower({sql_line('line')}) k from ({LINES_SQL}) where {sql_line('line')} <> '' and length({sql_line('line')}) <= 140 and not regexp_matches({sql_line('line')}, {lit(L.BULLET)})"
REPEATED_SQL = (
    f"select doc, k as line_key, count(*) as n_pages from ({KEYS_SQL}) join (select doc, count(distinct page_number) pages from pages_in group by doc having count(distinct page_number) >= 3) using (doc)"
    " group by doc, k, pages having count(*) >= greatest(3, floor(pages * 0.6)::int)"
)
X = sql_display("line")
PAGE_ONE = "(select doc, page_number, min(text) text from pages_in group by doc, page_number)"
BLOCK_SQL = (
    "select doc, page_number, (b - 1)::int as block_no, trim(string_agg(x, chr(10) order by n)) as block from (select *, sum(case when starts then 1 else 0 end) over (partition by doc, page_number order by n) b from ("
    f"select *, x <> '' and (regexp_matches(x, {lit(L.BULLET)}) or {sql_heading('x', 140, 100, L.HEADING)} or coalesce(lag(x) over (partition by doc, page_number order by n) = '', true)) starts"
    f" from (select doc, page_number, n, {X} x from (select doc, page_number, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from {PAGE_ONE}))) where x <> '') group by doc, page_number, b"
)
STITCH_BASE = f"select *, row_number() over (partition by source_document order by clause_id) rn, {sql_display('clause_text')} t, lead({sql_display('clause_text')}) over (partition by source_document order by clause_id) nxt from {ONE}"
STITCH_SQL = (
    "select clause_id, case when head then t || ' ' || nxt else clause_text end as clause_text, head as stitched from ("
    "select *, coalesce(lag(head) over (partition by source_document order by rn), false) gone from ("
    "select *, t like '%:' and (rn - lastn) % 2 = 1 and nxt is not null head from ("
    f"select *, coalesce(max(case when t not like '%:' then rn end) over (partition by source_document order by rn rows unbounded preceding), 0) lastn from ({STITCH_BASE})))) where not gone"
)


def _pages(spark, d):
    return table(spark, d, "pages_in")


def _blocks(spark, d):
    one = _pages(spark, d).groupBy("doc", "page_number").agg(F.min("text").alias("text"))
    return segment.blocks(one, "doc", "page_number", text="text")


def _carry(spark, d):
    return segment.carry_heading(_blocks(spark, d), "doc", "page_number", "block_no").select("doc", "page_number", "block_no", "is_heading", "section_heading")


SEGMENT = [
    Query("seg_lines", lambda s, d: segment.lines(_pages(s, d).distinct(), "doc", "page_number"), f"select doc, page_number, (n - 1)::int as line_no, line from (select doc, page_number, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from (select distinct * from pages_in))"),
    Query("seg_repeated", lambda s, d: segment.repeated_lines(_pages(s, d)), REPEATED_SQL),
    Query(
        "seg_remove_repeated",
        lambda s, d: segment.without_repeated(_pages(s, d), segment.repeated_lines(_pages(s, d))).select("doc", "page_number", T.line(F.col("clean_text")).alias("clean_text")),
        f"with r as ({REPEATED_SQL}), k as (select l.*, r.line_key is not null gone from (select doc, page_number, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from {PAGE_ONE}) l left join r on r.doc = l.doc and r.line_key = lower({sql_line('line')})),"
        f" t as (select doc, page_number, string_agg(line, chr(10) order by n) filter (not gone) x from k group by doc, page_number)"
        f" select p.doc, p.page_number, {sql_joined("coalesce(x, '')")} as clean_text from {PAGE_ONE} p left join t on t.doc = p.doc and t.page_number = p.page_number",
    ),
    Query("seg_blocks", lambda s, d: _blocks(s, d).select("doc", "page_number", "block_no", T.line(F.col("block")).alias("block")), f"select doc, page_number, block_no, {sql_joined('block')} as block from ({BLOCK_SQL})"),
    Query("seg_block_counts", lambda s, d: _blocks(s, d).groupBy("doc", "page_number").agg(F.count("*").alias("n_blocks")), f"select doc, page_number, count(*) as n_blocks from ({BLOCK_SQL}) group by doc, page_number"),
    Query(
        "seg_heading_carry",
        _carry,
        f"with b as (select doc, page_number, block_no, {sql_joined('block')} x from ({BLOCK_SQL})), h as (select *, {sql_heading('x', 140, 100, L.HEADING)} hd from b) select doc, page_number, block_no, hd as is_heading,"
        " last_value(case when hd then x end ignore nulls) over (partition by doc order by page_number, block_no rows between unbounded preceding and 1 preceding) as section_heading from h",
    ),
    Query("seg_build", lambda s, d: segment.build_clauses(_pages(s, d))),
    Query("seg_review", lambda s, d: segment.review_blocks(_pages(s, d))),
    Query("seg_subclauses", lambda s, d: table(s, d, SC).select("clause_id", F.explode(segment.subclauses(F.col("clause_text"))).alias("part"))),
    Query("seg_split_long", lambda s, d: _one(s, d).select("clause_id", F.posexplode(segment.split_long(F.col("clause_text"))).alias("piece_no", "piece"))),
    Query(
        "seg_sentences",
        lambda s, d: _one(s, d).select("clause_id", F.size(segment.sentences(F.col("clause_text"))).alias("n_sentences")).where("n_sentences > 0"),
        f"select clause_id, len(list_filter(string_split(regexp_replace({sql_line('clause_text')}, '([.!?])\\s+([A-Z0-9(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> ''))::int as n_sentences from {ONE} where {sql_line('clause_text')} <> ''",
    ),
    Query("seg_stitch", lambda s, d: segment.stitch(_one(s, d), "source_document", "clause_id").select("clause_id", "clause_text", "stitched"), STITCH_SQL),
    Query(
        "seg_global_id",
        lambda s, d: segment.numbered(_one(s, d), "source_document", "clause_id").select("clause_id", F.format_string("S%09d", "pos").alias("new_id")),
        f"select clause_id, printf('S%09d', row_number() over (order by source_document, clause_id)) as new_id from {ONE}",
    ),
    Query(
        "gen_batches",
        lambda s, d: segment.batches(_one(s, d), 8, "clause_id").groupBy("batch_no").agg(F.count("*").alias("n"), F.min("clause_id").alias("first_id")),
        f"select batch_no, count(*) as n, min(clause_id) as first_id from (select clause_id, (row_number() over (order by clause_id) - 1) // 8 batch_no from {ONE}) group by batch_no",
    ),
    Query(
        "gen_parse_ids",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", F.array_join(taxonomy.parse_ids(F.array_join("source_clause_ids", " , ")), "|").alias("ids")),
        "select taxonomy_id, array_to_string(source_clause_ids, '|') as ids from rules",
    ),
    Query("gen_parse_array", lambda s, d: table(s, d, "rules").select("taxonomy_id", F.size(taxonomy.parse_array(F.concat(F.lit("<think>x</think> answer: "), F.to_json("source_clause_ids"), F.lit(" end")))).alias("n")), "select taxonomy_id, len(source_clause_ids)::int as n from rules"),
]

HASH = f"sha256({sql_canonical('clause_text')})"


def _near(spark, d):
    x = duplicates.near_groups(table(spark, d, SC), "clause_id", "clause_text", 98, 100)
    return x.withColumnRenamed("id", "clause_id")


def _jaccard_pairs(spark, d):
    t = table(spark, d, SC).withColumn("tok", T.tokens(F.col("clause_text")))
    _, p = duplicates.similar(t, "clause_id", "tok", 1, 2)
    return p.select("id_a", "id_b", "both", F.round(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), 6).alias("sim"))


def _jaccard_members(spark, d):
    """The class of equal token sets of each row; with dup_near_pairs, which pairs classes, every row's links follow."""
    t = table(spark, d, SC).withColumn("tok", T.tokens(F.col("clause_text")))
    m, _ = duplicates.similar(t, "clause_id", "tok", 1, 2)
    return m.select(F.col("id").alias("clause_id"), "rep")


MEMBERS_SQL = (
    f"with t as (select distinct clause_id, list_sort(list_distinct(regexp_extract_all({sql_canonical('clause_text')}, '[a-z0-9]+'))) w from statutory_clauses where clause_id is not null)"
    " select clause_id, min(clause_id) over (partition by w) as rep from t"
)
JACCARD_SQL = (
    f"with t as (select min(clause_id) id, w from (select clause_id, list_sort(list_distinct(regexp_extract_all({sql_canonical('clause_text')}, '[a-z0-9]+'))) w from statutory_clauses) group by w), p as (select a.id id_a, b.id id_b, len(list_intersect(a.w, b.w)) both_n, len(a.w) na, len(b.w) nb from t a join t b on a.id < b.id)"
    " select id_a, id_b, both_n::int as both, round(both_n / (na + nb - both_n), 6) as sim from p where both_n * 2 >= (na + nb - both_n) * 1"
)

DUPLICATES = [
    Query(
        "dup_exact_group",
        lambda s, d: duplicates.exact_groups(_one(s, d), T.content_hash(F.col("clause_text")), "clause_id").select("clause_id", "exact_group"),
        f"with h as (select clause_id, {HASH} k from {ONE}), g as (select k, 'EXACT-' || lpad(row_number() over (order by min(clause_id))::varchar, 5, '0') gid from h group by k having count(*) > 1) select clause_id, coalesce(gid, '') as exact_group from h left join g using (k)",
    ),
    Query(
        "dup_req_exact",
        lambda s, d: duplicates.exact_groups(table(s, d, "rules"), T.content_hash(F.col("requirement")), "taxonomy_id", prefix="REQ-EXACT-").select("taxonomy_id", "exact_group"),
        f"with h as (select taxonomy_id, sha256({sql_canonical('requirement')}) k from rules), g as (select k, 'REQ-EXACT-' || lpad(row_number() over (order by min(taxonomy_id))::varchar, 5, '0') gid from h group by k having count(*) > 1) select taxonomy_id, coalesce(gid, '') as exact_group from h left join g using (k)",
    ),
    Query("dup_drop", lambda s, d: duplicates.first_per_key(_one(s, d), T.content_hash(F.col("clause_text")), "clause_id").select("clause_id"), f"select min(clause_id) as clause_id from {ONE} group by {HASH}"),
    Query("dup_near_pairs", _jaccard_pairs, JACCARD_SQL),
    Query("dup_near_members", _jaccard_members, MEMBERS_SQL),
    Query("dup_near_group", _near),
    Query("dup_req_near", lambda s, d: duplicates.near_groups(table(s, d, "rules"), "taxonomy_id", "requirement", 85, 100, "REQ-NEAR-", "category").withColumnRenamed("id", "taxonomy_id")),
    Query(
        "sim_jaccard",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", F.round(duplicates.jaccard(T.tokens(F.col("requirement")), T.tokens(F.col("checkable_test"))), 6).alias("sim")),
        f"select taxonomy_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as sim from (select taxonomy_id, list_distinct(regexp_extract_all({sql_canonical('requirement')}, '[a-z0-9]+')) a, list_distinct(regexp_extract_all({sql_canonical('checkable_test')}, '[a-z0-9]+')) b from rules)",
    ),
    Query(
        "dup_entry_exact",
        lambda s, d: duplicates.merge_entries(table(s, d, "rules").select("taxonomy_id", "category", "requirement", "source_clause_ids"), [F.col("category")], "source_clause_ids", "taxonomy_id").select("taxonomy_id", "category", F.array_join("source_clause_ids", "|").alias("ids"), "n_merged"),
        "select min(taxonomy_id) as taxonomy_id, category, array_to_string(list_sort(list_distinct(flatten(list(source_clause_ids)))), '|') as ids, count(*) as n_merged from rules group by category",
    ),
    Query(
        "agg_representative",
        lambda s, d: _one(s, d).groupBy(T.content_hash(F.col("clause_text")).alias("k")).agg(F.min("clause_id").alias("representative"), F.array_join(F.sort_array(F.collect_set("clause_id")), "|").alias("members")).drop("k"),
        f"select min(clause_id) as representative, string_agg(clause_id, '|' order by clause_id) as members from {ONE} group by {HASH}",
    ),
    Query(
        "join_merge_pairs",
        lambda s, d: duplicates.vector_pairs(table(s, d, "embeddings"), "vec_id", "label", "embedding", 0.4).select("id_a", "id_b", F.round("sim", 4).alias("sim")),
        "select id_a, id_b, round(sim, 4) as sim from (select a.vec_id id_a, b.vec_id id_b, list_sum([x[1] * x[2] for x in list_zip(a.embedding::double[], b.embedding::double[])]) sim from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) where sim >= 0.4",
    ),
    Query("clus_first_match", lambda s, d: taxonomy.clusters(table(s, d, "embeddings"), "vec_id", duplicates.vector_pairs(table(s, d, "embeddings"), "vec_id", "label", "embedding", 0.5)).select("id", "leader")),
]

LAST = "(select clause_id, arg_max(verdict, (assigned_at, coalesce(verdict, ''))) verdict, arg_max(best_match_taxonomy_id, (assigned_at, coalesce(verdict, ''))) rule from split_assignments group by clause_id)"


def _labels(spark, d):
    """The latest label of each clause."""
    w = F.struct("assigned_at", F.coalesce("verdict", F.lit("")).alias("v"), "verdict", F.col("best_match_taxonomy_id").alias("rule"))
    return table(spark, d, "split_assignments").groupBy("clause_id").agg(F.max(w).alias("r")).select("clause_id", "r.verdict", "r.rule")


def _provenance(spark, d):
    p = taxonomy.provenance(table(spark, d, "rules"), table(spark, d, SC))
    return p.select("taxonomy_id", F.array_join("source_acts", "|").alias("acts"), F.array_join("missing_ids", "|").alias("missing"), "resolved_act")


PROV_SQL = (
    "select taxonomy_id, array_to_string(a, '|') as acts, array_to_string(m, '|') as missing, case len(a) when 0 then 'UNRESOLVED' when 1 then a[1] else 'MULTI_ACT__' || array_to_string(a, '__') end as resolved_act from ("
    "select taxonomy_id, list_sort(list_distinct(coalesce(list(act) filter (act <> ''), []))) a, list_sort(list_distinct(coalesce(list(id) filter (hit is null), []))) m from (select taxonomy_id, unnest(list_distinct(source_clause_ids)) id from rules) r"
    " left join (select clause_id, min(trim(source_act)) act, true hit from statutory_clauses group by 1) c on c.clause_id = r.id group by taxonomy_id)"
)
TESTED = sql_canonical("requirement || ' ' || checkable_test")
FLAGS_SQL = (
    "select taxonomy_id, "
    + sql_list(
        [
            "case when trim(coalesce(requirement, '')) = '' then 'missing_requirement' end",
            "case when trim(coalesce(category, '')) = '' then 'missing_category' end",
            "case when trim(coalesce(checkable_test, '')) = '' then 'missing_checkable_test' end",
            "case when missing <> '' then 'missing_source_clause_ids' end",
            "case when acts = '' then 'no_resolved_source_act' end",
            "case when contains(acts, '|') then 'multi_act_provenance' end",
            f"case when not {sql_any(TESTED, L.CHECKABILITY)} then 'low_policy_checkability_signal' end",
            f"case when {sql_any(sql_canonical('requirement'), L.INSTITUTIONAL)} then 'possible_institutional_or_administrative_content' end",
        ]
    )
    + f" f from rules join ({PROV_SQL}) using (taxonomy_id)"
)


def _flags(spark, d):
    p = taxonomy.provenance(table(spark, d, "rules"), table(spark, d, SC))
    x = table(spark, d, "rules").join(p, "taxonomy_id")
    x = computed_once(x, f=taxonomy.review_flags(F.col("requirement"), F.col("category"), F.col("checkable_test"), F.col("source_acts"), F.col("missing_ids")))
    return x.select("taxonomy_id", F.array_join("f", "|").alias("flags"), taxonomy.recommended(F.col("f")).alias("action"))


def _entries(spark, d):
    """Rules in the shape of generated entries; they may cite any statutory clause that their own ids name and that exists."""
    ids = table(spark, d, "rules").select("taxonomy_id", F.explode("source_clause_ids").alias("clause_id")).join(table(spark, d, SC).select("clause_id"), "clause_id")
    known = ids.groupBy("taxonomy_id").agg(F.collect_set("clause_id").alias("known_ids"))
    x = table(spark, d, "rules").join(known, "taxonomy_id", "left").withColumn("known_ids", F.coalesce("known_ids", F.array().cast("array<string>")))
    return x.withColumns({"source": F.col("act"), "applicability": F.lit("all"), "citation_confidence": F.lit("high")})


KEYWORDS = {"Erasure": ["delete", "remove", "erase"], "Consent": ["consent", "withdraw"], "Security": ["secure", "encrypted"], "Transfers": ["share", "transfer"], "Retention": ["keep", "retain"]}


def _scored(spark, d):
    return routing.score_rules(_one(spark, d), table(spark, d, "rules"), "clause_id", "clause_text", KEYWORDS)


def _sql_score() -> str:
    kw = " ".join(f"when {lit(k)} then {lit('|'.join(v))}" for k, v in KEYWORDS.items())
    hits = lambda a: f"len(list_filter({a}, lambda k: contains(t, k)))"
    concepts = "list_filter(list_transform(string_split(lower(coalesce(required_concepts, '')), ';'), lambda x: trim(x)), lambda x: x <> '')"
    words = "list_filter(string_split(lower(requirement), ' '), lambda w: length(w) > 4)"
    keys = f"coalesce(string_split(case category {kw} end, '|'), [])"
    return f"select * from (select clause_id id, taxonomy_id rule_id, category, (3 * {hits(keys)} + 4 * {hits(concepts)} + {hits(words)})::int score from (select clause_id, lower(coalesce(clause_text, '')) t from {ONE}), rules) where score >= 4"


RANK_SQL = (
    "select id, rule_id, score, place::int as place from (select *, row_number() over (partition by id order by score desc, first, r) place from (select *, row_number() over (partition by id, category order by score desc, rule_id) r,"
    f" min(rule_id) over (partition by id, category) as first from ({_sql_score()})) where r <= 2) where place <= 6"
)


def _protos(spark, d):
    """One prototype for each label: the vector with the smallest id."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("proto"))


NEAR_SQL = (
    "select id, proto_id, sim, place::int as place from (select *, row_number() over (partition by id order by sim desc, proto_id) place from (select e.vec_id id, p.label proto_id, round(list_sum([x[1] * x[2] for x in list_zip(e.embedding::double[], p.proto::double[])]), 6) sim"
    " from embeddings e, (select label, arg_min(embedding, vec_id) proto from embeddings group by label) p)) where place <= 3"
)

JOINS = [
    Query("join_label_left", lambda s, d: _one(s, d).join(_labels(s, d), "clause_id", "left").select("clause_id", "verdict", "rule"), f"select c.clause_id, verdict, rule from {ONE} c left join {LAST} l using (clause_id)"),
    Query(
        "join_rule_lookup",
        lambda s, d: _labels(s, d).join(table(s, d, "rules").select(F.col("taxonomy_id").alias("rule"), "category", "act"), "rule", "left").select("clause_id", "rule", F.coalesce("category", F.lit("NONE")).alias("category"), F.coalesce("act", F.lit("NONE")).alias("act")),
        f"select clause_id, rule, coalesce(category, 'NONE') as category, coalesce(act, 'NONE') as act from {LAST} left join rules on taxonomy_id = rule",
    ),
    Query("join_provenance", _provenance, PROV_SQL),
    Query(
        "join_prepare",
        lambda s, d: _provenance(s, d).join(table(s, d, "rules"), "taxonomy_id").select("taxonomy_id", F.when(F.col("resolved_act") == "UNRESOLVED", taxonomy.act_code(F.col("act"))).otherwise(F.col("resolved_act")).alias("act"), F.array_join(routing.concepts(F.col("required_concepts")), "|").alias("concepts")),
        f"select taxonomy_id, case when resolved_act = 'UNRESOLVED' then upper(replace(act, ' ', '_')) else resolved_act end as act, array_to_string(list_filter(list_transform(string_split(lower(coalesce(required_concepts, '')), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') as concepts from ({PROV_SQL}) join rules using (taxonomy_id)",
    ),
    Query(
        "sig_review_flags",
        lambda s, d: _flags(s, d),
        f"select taxonomy_id, array_to_string(f, '|') as flags, case when list_contains(f, 'multi_act_provenance') or list_contains(f, 'missing_source_clause_ids') then 'REVIEW_PROVENANCE' when list_contains(f, 'low_policy_checkability_signal') then 'REVIEW_APPLICABILITY' when list_contains(f, 'possible_institutional_or_administrative_content') then 'REVIEW_SCOPE' else 'LEGAL_REVIEW' end as action from ({FLAGS_SQL})",
    ),
    Query(
        "flt_review_queues",
        lambda s, d: _flags(s, d).where("action <> 'LEGAL_REVIEW'").select("taxonomy_id", "action"),
        f"select taxonomy_id, case when list_contains(f, 'multi_act_provenance') or list_contains(f, 'missing_source_clause_ids') then 'REVIEW_PROVENANCE' when list_contains(f, 'low_policy_checkability_signal') then 'REVIEW_APPLICABILITY' else 'REVIEW_SCOPE' end as action from ({FLAGS_SQL}) where len(f) > 0 and (list_contains(f, 'multi_act_provenance') or list_contains(f, 'missing_source_clause_ids') or list_contains(f, 'low_policy_checkability_signal') or list_contains(f, 'possible_institutional_or_administrative_content'))",
    ),
    Query(
        "val_label",
        lambda s, d: routing.clean_labels(_one(s, d), table(s, d, "split_assignments").select("clause_id", "best_match_taxonomy_id", "verdict", F.struct("assigned_at", F.coalesce("verdict", F.lit("")), "best_match_taxonomy_id").alias("o")), table(s, d, "rules"), "o"),
        "select c.clause_id, case when r.taxonomy_id is null or coalesce(verdict, 'Not Addressed') = 'Not Addressed' then 'NONE' else rule end as best_match_taxonomy_id, case when r.taxonomy_id is null or coalesce(verdict, 'Not Addressed') = 'Not Addressed' then 'Not Addressed' else verdict end as verdict"
        f" from {ONE} c left join (select * from (select clause_id, best_match_taxonomy_id rule, verdict, row_number() over (partition by clause_id order by assigned_at, coalesce(verdict, ''), best_match_taxonomy_id) n from split_assignments) where n = 1) l using (clause_id) left join rules r on r.taxonomy_id = l.rule",
    ),
    Query(
        "val_entry",
        lambda s, d: _entries(s, d).select("taxonomy_id", taxonomy.entry_error(["Erasure", "Notice", "Retention", "Grievance", "Transfers", "Children", "Security"]).alias("error")),
        "select taxonomy_id, case when category not in ('Erasure', 'Notice', 'Retention', 'Grievance', 'Transfers', 'Children', 'Security') then 'invalid category' when length(trim(requirement)) < 15 then 'requirement is empty or too short' when trim(coalesce(assessability, '')) = '' then 'assessability is empty'"
        " when weight not in (1, 2, 3) then 'invalid weight' when len(list_filter(source_clause_ids, lambda x: x not in (select clause_id from statutory_clauses))) > 0 then 'source_clause_ids outside the batch' when len(list_distinct(source_clause_ids)) < len(source_clause_ids) then 'source_clause_ids contains duplicates' end as error from rules".replace("len(list_filter(source_clause_ids, lambda x: x not in (select clause_id from statutory_clauses))) > 0", "len(list_intersect(source_clause_ids, (select list(clause_id) from statutory_clauses))) < len(list_distinct(source_clause_ids))"),
    ),
    Query(
        "join_expand_ids",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", F.explode("source_clause_ids").alias("clause_id")).join(table(s, d, SC).select("clause_id", "source_act"), "clause_id").select("taxonomy_id", "clause_id", "source_act"),
        "select taxonomy_id, clause_id, source_act from (select taxonomy_id, unnest(source_clause_ids) clause_id from rules) join statutory_clauses using (clause_id)",
    ),
    Query(
        "join_unmapped",
        lambda s, d: table(s, d, SC).select("clause_id").join(table(s, d, "rules").select(F.explode("source_clause_ids").alias("clause_id")), "clause_id", "left_anti"),
        "select clause_id from statutory_clauses where clause_id not in (select unnest(source_clause_ids) from rules)",
    ),
    Query(
        "join_never_matched",
        lambda s, d: table(s, d, "rules").select("taxonomy_id").join(_labels(s, d).where("verdict in ('Compliant', 'Partially Compliant')").select(F.col("rule").alias("taxonomy_id")), "taxonomy_id", "left_anti"),
        f"select taxonomy_id from rules where taxonomy_id not in (select rule from {LAST} where verdict in ('Compliant', 'Partially Compliant') and rule is not null)",
    ),
    Query("join_semantic_best", lambda s, d: routing.nearest(table(s, d, "embeddings"), _protos(s, d), "vec_id", "embedding", "label", "proto", 1, 0.35).select("id", "proto_id", "sim"), f"select id, proto_id, sim from ({NEAR_SQL}) where place = 1 and sim > 0.35"),
    Query(
        "join_filter_semi",
        lambda s, d: _one(s, d).where(F.lower("app_name").isin("muviim rides", "kilier pay")).select("clause_id", "app_name"),
        f"select clause_id, app_name from {ONE} where lower(app_name) in ('muviim rides', 'kilier pay')",
    ),
    Query(
        "join_mergeback",
        lambda s, d: curation.merge_back(table(s, d, PC).select("clause_id", "app_name", "ingested_at").where("ingested_at < timestamp '2024-06-01'"), table(s, d, PC).select("clause_id", "app_name", "ingested_at").where("ingested_at >= timestamp '2024-06-01'"), "clause_id", "ingested_at"),
        "with n as (select clause_id, max(ingested_at) ingested_at from policy_clauses where ingested_at >= timestamp '2024-06-01' group by 1), nn as (select p.clause_id, any_value(p.app_name) app_name, p.ingested_at from policy_clauses p join n on n.clause_id = p.clause_id and n.ingested_at = p.ingested_at group by p.clause_id, p.ingested_at)"
        " select clause_id, app_name, ingested_at from policy_clauses where ingested_at < timestamp '2024-06-01' and clause_id not in (select clause_id from n) union all select * from nn",
    ),
    Query("rank_route", _scored, _sql_score()),
    Query(
        "rank_cap_category",
        lambda s, d: routing.ranked(_scored(s, d), 2, 10_000).groupBy("id").agg(F.count("*").alias("n"), F.max("score").alias("best")),
        f"select id, count(*) as n, max(score) as best from (select *, row_number() over (partition by id, category order by score desc, rule_id) r from ({_sql_score()})) where r <= 2 group by id",
    ),
    Query("rank_topn", lambda s, d: routing.ranked(_scored(s, d)), RANK_SQL),
    Query(
        "rank_semantic_fill",
        lambda s, d: routing.fill(routing.nearest(table(s, d, "embeddings"), _protos(s, d), "vec_id", "embedding", "label", "proto", 2, 0.3).select("id", F.col("proto_id").alias("rule_id"), "place"), routing.nearest(table(s, d, "embeddings"), _protos(s, d), "vec_id", "embedding", "label", "proto", 10).select("id", F.col("proto_id").alias("rule_id"), "place")),
    ),
    Query("sim_cosine_top3", lambda s, d: routing.nearest(table(s, d, "embeddings"), _protos(s, d), "vec_id", "embedding", "label", "proto", 3), NEAR_SQL),
    Query(
        "rank_priority",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", taxonomy.priority(F.col("weight"), F.col("requirement"), ["consent", "delete", "banner"]).alias("priority")),
        "select taxonomy_id, (weight * 4 + case when contains(lower(requirement), 'consent') or contains(lower(requirement), 'delete') or contains(lower(requirement), 'banner') then 10 else 0 end)::int as priority from rules",
    ),
    Query(
        "rank_diverse",
        lambda s, d: taxonomy.diverse(table(s, d, "rules").select("taxonomy_id", taxonomy.act_code(F.col("act")).alias("act"), "category", "weight"), "act", "category", "weight", "taxonomy_id", 9).select("taxonomy_id", "act", "place"),
        "select taxonomy_id, act, place::int as place from (select *, row_number() over (partition by act order by case when r = 1 then 0 else 1 end, case when r = 1 then category end, weight desc, taxonomy_id) place from (select *, row_number() over (partition by act, category order by weight desc, taxonomy_id) r from (select taxonomy_id, upper(replace(act, ' ', '_')) act, category, weight from rules))) where place <= 9",
    ),
    Query(
        "sort_representatives",
        lambda s, d: segment.numbered(table(s, d, SC).select("clause_id", F.when(F.col("extraction_quality") == "pass", 0).otherwise(1).alias("k")), "k", "clause_id").select("clause_id", "pos"),
        "select clause_id, row_number() over (order by case when extraction_quality = 'pass' then 0 else 1 end, clause_id) as pos from statutory_clauses",
    ),
    Query(
        "win_index",
        lambda s, d: _one(s, d).withColumn("idx", F.expr("row_number() over (partition by source_document order by clause_id)")).select("clause_id", "idx"),
        f"select clause_id, (row_number() over (partition by source_document order by clause_id))::int as idx from {ONE}",
    ),
    Query("topk_head", lambda s, d: _one(s, d).select("clause_id", F.length("clause_text").alias("n")).orderBy(F.col("n").desc_nulls_last(), "clause_id").limit(50), f"select clause_id, length(clause_text)::int as n from {ONE} order by n desc nulls last, clause_id limit 50"),
]

SETS = [
    Query("set_union", lambda s, d: table(s, d, PC).select("clause_id", "clause_text").unionByName(table(s, d, "raw_clauses").select("clause_id", "clause_text")).unionByName(table(s, d, SC).select("clause_id", "clause_text")), "select clause_id, clause_text from policy_clauses union all select clause_id, clause_text from raw_clauses union all select clause_id, clause_text from statutory_clauses"),
    Query("set_except", lambda s, d: table(s, d, "split_assignments").select("clause_id").distinct().join(table(s, d, PC).select("clause_id"), "clause_id", "left_anti"), "select clause_id from split_assignments except select clause_id from policy_clauses"),
    Query("set_intersect", lambda s, d: table(s, d, "rules").select("taxonomy_id", F.array_join(F.array_sort(F.array_intersect(T.tokens(F.col("requirement")), T.tokens(F.col("checkable_test")))), "|").alias("both")), f"select taxonomy_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all({sql_canonical('requirement')}, '[a-z0-9]+')), list_distinct(regexp_extract_all({sql_canonical('checkable_test')}, '[a-z0-9]+')))), '|') as both from rules"),
    Query("set_array_union", lambda s, d: table(s, d, "rules").select("taxonomy_id", F.size(F.array_union(T.tokens(F.col("requirement")), T.tokens(F.col("checkable_test")))).alias("n")), f"select taxonomy_id, len(list_distinct(list_concat(regexp_extract_all({sql_canonical('requirement')}, '[a-z0-9]+'), regexp_extract_all({sql_canonical('checkable_test')}, '[a-z0-9]+'))))::int as n from rules"),
    Query("set_distinct_sorted", lambda s, d: table(s, d, "rules").groupBy("category").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_clause_ids")))), "|").alias("ids")), "select category, array_to_string(list_sort(list_distinct(flatten(list(source_clause_ids)))), '|') as ids from rules group by category"),
]

QUERIES = SEGMENT + DUPLICATES + JOINS + SETS
