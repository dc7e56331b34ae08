"""Validation, gates, calibration, ensembles, cached model calls and micro-batches over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators import curation, decisions, duplicates, features, models, routing, scorecard, taxonomy
from lexweave.plans.registry import Query, lit, sql_canonical, sql_display, sql_heading, sql_joined, sql_line, sql_whole, table
from lexweave.plans.report_queries import CONF_SQL, GUESS, PROB, RANK_SQL, REPORT_SQL, T_, WORDS, _confusion, _probabilities, _rankings
from lexweave.plans.structure_queries import BLOCK_SQL, HASH, KEYWORDS, NEAR_SQL, ONE, PAGE_ONE, REPEATED_SQL, _entries, _labels, _one, _protos, _sql_score
from lexweave.session import delete_later, materialize, shared_dir
from lexweave.sources import clients, readers
from lexweave.streaming import cache

PC, SC = "policy_clauses", "statutory_clauses"


# --- text -----------------------------------------------------------------------------------------------------------------------
NAMES = [("HARROW", "Harrow Data Law"), ("ORLEN", "Orlen Network Law")]


def _prepared(spark, d):
    r = table(spark, d, "rules")
    return r.select("taxonomy_id", T.context(("Category", F.col("category")), ("Requirement", F.col("requirement")), ("Assessability", F.col("assessability"))).alias("context"))


def _part(label: str, c: str) -> str:
    return f"case when {sql_display(c)} <> '' then '{label}: ' || {sql_display(c)} end"


JSON = "'{' || concat_ws(',', " + ", ".join(f"case when {c} is not null then '\"{c}\":' || to_json({c})::varchar end" for c in ("app_name", "clause_id", "clause_text")) + ") || '}'"
CUT = f"regexp_replace(clause_text, {lit(chr(40) + '?i)([;.])' + chr(92) + 's+(?:and' + chr(92) + 's+)?(' + chr(92) + '([a-z]{1,3}' + chr(92) + ')[' + chr(92) + 's“‘' + chr(34) + chr(39) + '])')}, '\\1' || chr(1) || '\\2', 'g')"
PARTS = f"list_filter(list_transform(string_split({CUT}, chr(1)), lambda x: {sql_line('x')}), lambda x: x <> '')"
SUBCLAUSES_SQL = (
    f"select clause_id, unnest(case when len(regexp_extract_all(clause_text, {lit('(?i)' + L.SUBCLAUSE)})) >= 2 and len(p) > 1 then p else [clause_text] end) as part from (select clause_id, clause_text, {PARTS} p from statutory_clauses)"
)
FLAT = sql_line("clause_text")
SENTENCES = f"list_filter(string_split(regexp_replace({FLAT}, '([.!?])\\s+([A-Z0-9(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> '')"
PACKED = f"list_reduce({SENTENCES}, lambda a, x: case when length(string_split(a, chr(1))[-1]) + 1 + length(x) > {L.MAX_CHARS} then a || chr(1) || x else a || ' ' || x end)"
SPLIT_SQL = (
    f"select clause_id, (generate_subscripts(p, 1) - 1)::int as piece_no, unnest(p) as piece from (select clause_id, case when length({FLAT}) <= {L.MAX_CHARS} then [{FLAT}] else string_split({PACKED}, chr(1)) end p from {ONE} where clause_text is not null)"
)
TEXT = [
    Query("txt_act_display", lambda s, d: table(s, d, "rules").select("taxonomy_id", T.display_name(F.col("taxonomy_id"), F.col("act"), NAMES, "Other").alias("name")), "select taxonomy_id, case when contains(upper(taxonomy_id || ' ' || act), 'HARROW') then 'Harrow Data Law' when contains(upper(taxonomy_id || ' ' || act), 'ORLEN') then 'Orlen Network Law' else 'Other' end as name from rules"),
    Query("txt_rule_context", _prepared, f"select taxonomy_id, concat_ws(' ', {_part('Category', 'category')}, {_part('Requirement', 'requirement')}, {_part('Assessability', 'assessability')}) as context from rules"),
]
# SQL for queries of other modules, by name
SQL = {
    "txt_json_hash": f"select clause_id, sha256({JSON}) as out from policy_clauses",
    "seg_subclauses": SUBCLAUSES_SQL,
    "seg_split_long": SPLIT_SQL,
    "agg_run_summary": "select " + ", ".join(f"(select '{{' || string_agg(to_json(k)::varchar || ':' || n, ',' order by k) || '}}' from (select coalesce({c}, '') k, count(*) n from policy_clauses group by 1)) as {a}" for c, a in (("extraction_method", "methods"), ("extraction_quality", "qualities"))),
}


# --- greedy leaders in recursive SQL ------------------------------------------------------------------------------------------------
def sql_leaders(ids: str, pairs: str, best: bool = True) -> str:
    """ids(id) and pairs(a < b, sim) -> (id, leader, sim): in id order, a row without a leader among its neighbours leads; the others
    join the most similar leader (ties: the earliest), or the earliest. Only rows with an earlier neighbour are walked through."""
    order = "sim desc, a" if best else "a"
    return (
        f"(with recursive ids as materialized ({ids}), p as materialized ({pairs}), n as materialized (select b id, list(a) nb, row_number() over (order by b) r from p group by b),"
        " g as (select 0::bigint r, []::varchar[] fell union all select n.r, case when len(list_filter(nb, lambda x: not list_contains(fell, x))) > 0 then list_append(fell, n.id) else fell end from g join n on n.r = g.r + 1),"
        " f as (select unnest(fell) id from g where r = (select max(r) from g))"
        f" select id, id as leader, 1.0::double as sim from ids where id not in (select id from f) union all select b, a, sim from (select b, a, sim, row_number() over (partition by b order by {order}) k from p where b in (select id from f) and a not in (select id from f)) where k = 1)"
    )


def sql_near(source: str, id_: str, text: str, num: int, den: int, prefix: str, block: str = "''") -> str:
    """near_groups in SQL: pairs of token sets by all comparisons, greedy leaders, groups numbered over all leaders."""
    tok = f"select {id_} id, {block} blk, list_distinct(regexp_extract_all({sql_canonical(text)}, '[a-z0-9]+')) w from {source}"
    sizes = f"len(a.w) * {den} >= len(b.w) * {num} and len(b.w) * {den} >= len(a.w) * {num}"
    both = "len(list_intersect(a.w, b.w))"
    same = "len(a.w) = 0 and len(b.w) = 0"
    pairs = (
        f"select a.id a, b.id b, case when {same} then 1.0::double else {both} / (len(a.w) + len(b.w) - {both}) end sim from ({tok}) a join ({tok}) b on a.id < b.id and a.blk = b.blk and {sizes} where {same} or {both} * {den} >= (len(a.w) + len(b.w) - {both}) * {num}"
    )
    led = sql_leaders(f"select {id_} id from {source}", pairs)
    return (
        f"with l as materialized (select * from {led}), z as (select leader, count(*) n, row_number() over (order by leader) k from l group by leader)"
        f" select id as {id_}, leader, round(sim, 6) as sim, case when n > 1 then '{prefix}' || lpad(k::varchar, 5, '0') else '' end as near_group from l join z using (leader)"
    )


DOT = "list_sum([x[1] * x[2] for x in list_zip(a.embedding::double[], b.embedding::double[])])"
SQL |= {
    "dup_near_group": sql_near("statutory_clauses", "clause_id", "clause_text", 98, 100, "NEAR-"),
    "dup_req_near": sql_near("rules", "taxonomy_id", "requirement", 85, 100, "REQ-NEAR-", "category"),
    "dup_near_policy": sql_near(f"(select * from {ONE} where clause_text <> '')", "clause_id", "clause_text", 98, 100, "NEAR-"),
    "rank_semantic_fill": (
        f"with c as (select id, proto_id rule_id, place from (select *, row_number() over (partition by id order by sim desc, proto_id)::int p2 from ({NEAR_SQL}) where sim > 0.3) where p2 <= 2), n as (select id, count(*) n from c group by id),"
        " a as (select id, proto_id rule_id, place from (select id, proto_id, row_number() over (partition by id order by sim desc, proto_id) place from (select e.vec_id id, p.label proto_id, round(list_sum([x[1] * x[2] for x in list_zip(e.embedding::double[], p.proto::double[])]), 6) sim"
        " from embeddings e, (select label, arg_min(embedding, vec_id) proto from embeddings group by label) p)) where place <= 10),"
        " m as (select a.id, a.rule_id, coalesce(n, 0) + row_number() over (partition by a.id order by a.place) place from a left join n using (id) where coalesce(n, 0) < 3 and not exists (select 1 from c where c.id = a.id and c.rule_id = a.rule_id))"
        " select id, rule_id, place::bigint as place, 'keyword' as kind from c union all select id, rule_id, place::bigint, 'semantic' from m where place <= 6"
    ),
}
# vectors are numbered, so the order of ids is the order of numbers
SQL["clus_first_match"] = "select id::bigint as id, leader::bigint as leader from " + sql_leaders(
    "select lpad(vec_id::varchar, 12, '0') id from embeddings",
    f"select a, b, sim from (select lpad(a.vec_id::varchar, 12, '0') a, lpad(b.vec_id::varchar, 12, '0') b, {DOT} sim from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) where sim >= 0.5",
    best=False,
)


# --- clauses built from pages in SQL ------------------------------------------------------------------------------------------------
def sql_normalize(c: str) -> str:
    """normalize() with its line breaks."""
    x = f"replace(replace({c}, chr(173), ''), chr(160), ' ')"
    for pattern, by in (("\\r\\n?", "\n"), ("(\\w)-\\n(\\w)", "\\1\\2"), ("(\\w)-\\n(\\w)", "\\1\\2"), ("[ \\t]+", " "), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", "")):
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"
    return x


CLEAN_SQL = (
    f"(with r as ({REPEATED_SQL}), k as (select l.*, r.line_key is not null gone from (select doc, page_number, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from {PAGE_ONE}) l left join r on r.doc = l.doc and r.line_key = lower({sql_line('line')})),"
    f" t as (select doc, page_number, string_agg(line, chr(10) order by n) filter (not gone) x from k group by doc, page_number) select p.doc, p.page_number, {sql_normalize("coalesce(x, '')")} as text from {PAGE_ONE} p left join t on t.doc = p.doc and t.page_number = p.page_number)"
)
CLEAN_BLOCKS = f"(select doc, page_number, block_no, {sql_joined('block')} f from ({BLOCK_SQL.replace(PAGE_ONE, CLEAN_SQL)}))"
IS_JUNK = f"(f = '' or {sql_whole('f', L.JUNK_POLICY)})"
IS_HEADING = sql_heading("f", 140, 100, L.HEADING)
PIECES = SPLIT_SQL.split("case when", 1)[1].split(" p from", 1)[0]
SQL |= {
    "seg_review": f"select doc, page_number, block_no, left(f, 2000) as review_text, case when {IS_JUNK} then 'navigation' else 'very short' end as reason from {CLEAN_BLOCKS} where {IS_JUNK} or (not {IS_HEADING} and length(f) < {L.MIN_REVIEWABLE})",
    "seg_build": (
        f"with b as (select *, {IS_HEADING} h, {IS_JUNK} j from {CLEAN_BLOCKS}), c as (select *, last_value(case when h then f end ignore nulls) over (partition by doc order by page_number, block_no rows between unbounded preceding and 1 preceding) sh from b),"
        f" s as (select doc, page_number, block_no, sh, case when {PIECES.replace(FLAT, 'f')} ps from c where not h and not j), q as (select doc, page_number, block_no, sh, unnest(ps) x, generate_subscripts(ps, 1) i from s)"
        f" select doc, page_number, sh as section_heading, (row_number() over (partition by doc order by page_number, block_no, i))::int as clause_index, x as clause_text, length(x) < {L.MIN_REVIEWABLE} as tiny from q"
    ),
}
CITED = f"select distinct c || chr(1) || category || chr(1) || taxonomy_id id, c || chr(1) || category blk, list_distinct(regexp_extract_all({sql_canonical('requirement')}, '[a-z0-9]+')) w from (select taxonomy_id, category, requirement, unnest(source_clause_ids) c from rules)"
BOTH = "len(list_intersect(a.w, b.w))"
SQL["dup_multi_map"] = "select split_part(id, chr(1), 1) as clause_id, split_part(id, chr(1), 3) as id from " + sql_leaders(
    f"select id from ({CITED})", f"select a.id a, b.id b, 1.0::double sim from ({CITED}) a join ({CITED}) b on a.blk = b.blk and a.id < b.id where (len(a.w) = 0 and len(b.w) = 0) or {BOTH} * 100 >= (len(a.w) + len(b.w) - {BOTH}) * 85"
) + " where id = leader"


# --- duplicates: classes and members ------------------------------------------------------------------------------------------------
def _entry_key():
    return [F.col("category"), T.canonical(F.col("requirement")), T.canonical(F.col("act"))]


ENTRY_KEY = f"category, {sql_canonical('requirement')}, {sql_canonical('act')}"
DUPLICATES = [
    Query("agg_class_counts", lambda s, d: duplicates.entry_classes(_one(s, d), [T.content_hash(F.col("clause_text"))], "clause_id")[0], f"select min(clause_id) as representative, count(*) as n_members from {ONE} group by {HASH}"),
    Query("agg_class_members", lambda s, d: duplicates.entry_classes(_one(s, d), [T.content_hash(F.col("clause_text"))], "clause_id")[1], f"select clause_id as id, min(clause_id) over (partition by {HASH}) as representative from {ONE}"),
    Query(
        "dup_entry_full_key",
        lambda s, d: duplicates.merge_entries(table(s, d, "rules").unionByName(table(s, d, "rules").withColumn("taxonomy_id", F.concat("taxonomy_id", F.lit("-B"))).withColumn("requirement", F.upper("requirement"))), _entry_key(), "source_clause_ids", "taxonomy_id").select("taxonomy_id", F.array_join("source_clause_ids", "|").alias("ids"), "n_merged"),
        f"select min(taxonomy_id) as taxonomy_id, array_to_string(list_sort(list_distinct(flatten(list(source_clause_ids)))), '|') as ids, count(*) as n_merged from (select taxonomy_id, category, requirement, act, source_clause_ids from rules union all select taxonomy_id || '-B', category, upper(requirement), act, source_clause_ids from rules) group by {ENTRY_KEY}",
    ),
    Query(
        "dup_entry_ids",
        lambda s, d: duplicates.entry_ids(duplicates.entry_classes(table(s, d, "rules"), [F.col("category")], "taxonomy_id")[1], table(s, d, "rules"), "taxonomy_id", "source_clause_ids"),
        "select distinct min(taxonomy_id) over (partition by category) as representative, cited from (select taxonomy_id, category, unnest(source_clause_ids) cited from rules)",
    ),
]


# --- validation, gates, routing -----------------------------------------------------------------------------------------------------
CATEGORIES = ["Erasure", "Notice", "Retention", "Grievance", "Transfers", "Children", "Security"]
GATES = [("Erasure", "delete|erase", "delete; erase", "archive"), ("Erasure", None, "remove", ""), ("Security", "encrypt", "encrypt; secure", "public"), ("Notice", None, "notice; inform", "")]
SCOPE = [r"\bboard\b", r"\bgovernment\b", r"\bregional\b", r"\barbitrators?\b"]
GATED = {"Erasure": (["your", "account"], ["we", "you"]), "Consent": (["nobody-says-this"], ["you"])}
JOINED = "coalesce(requirement, '') || ' ' || coalesce(checkable_test, '')"


def _gated(spark, d):
    return routing.score_rules(_one(spark, d), table(spark, d, "rules"), "clause_id", "clause_text", KEYWORDS, gated=GATED)


def _gated_sql() -> str:
    own = r"string_split_regex(t, '\s+')"
    tests = " ".join(f"when {lit(c)} then list_has_any({own}, [{', '.join(map(lit, a))}]) and list_has_any({own}, [{', '.join(map(lit, b))}])" for c, (a, b) in GATED.items())
    return _sql_score().replace("case category ", f"case (case when (case category {tests} else true end) then category end) ", 1)


def _defaulted(spark, d):
    routed = routing.ranked(_gated(spark, d)).select("id", "rule_id", F.col("place").cast("bigint").alias("place"), F.lit("keyword").alias("kind"))
    return routing.by_default(_one(spark, d), "clause_id", materialize(routed, "routed"), table(spark, d, "rules"), ["Notice", "Security"], 3)


RANKED_SQL = (
    "select id, rule_id, place from (select *, row_number() over (partition by id order by score desc, first, r) place from (select *, row_number() over (partition by id, category order by score desc, rule_id) r,"
    f" min(rule_id) over (partition by id, category) as first from ({_gated_sql()})) where r <= 2) where place <= 6"
)


def _answers(spark, d):
    """Answers in the shape a model gives them: one entry of each rule, some broken."""
    r = table(spark, d, "rules")
    fields = ["category", "requirement", F.col("act").alias("source"), "weight", "source_clause_ids", "checkable_test", F.lit("all").alias("applicability"), "assessability", F.lit("high").alias("citation_confidence")]
    whole = F.to_json(F.struct(*fields, F.lit("").alias("notes")))
    kind = F.pmod(F.substring("taxonomy_id", 4, 3).cast("int"), F.lit(3))
    answer = F.when(kind == 0, F.concat(F.lit("<think>[1]</think> Here: ["), whole, F.lit("] (done)"))).when(kind == 1, F.concat(F.lit('["only text", '), F.to_json(F.struct("category")), F.lit("]"))).otherwise(F.lit("no entries"))
    return r.select("taxonomy_id", F.explode_outer(taxonomy.parsed_entries(answer)).alias("e")).select("taxonomy_id", F.get_json_object(F.to_json("e.entry"), "$.category").alias("category"), "e.problem")


ANSWERS_SQL = (
    "select taxonomy_id, unnest(case substr(taxonomy_id, 4, 3)::int % 3 when 0 then [category] when 1 then [null, category] else [null] end) as category, unnest(case substr(taxonomy_id, 4, 3)::int % 3"
    " when 0 then [case when assessability is null then 'missing fields: assessability' end] when 1 then ['entry is not an object', 'missing fields: applicability, assessability, checkable_test, citation_confidence, notes, requirement, source, source_clause_ids, weight'] else [null] end) as problem from rules"
)
VALIDATION = [
    Query("val_answers", _answers, ANSWERS_SQL),
    Query(
        "val_entry_weights",
        lambda s, d: _entries(s, d).withColumn("weight", F.when(F.col("weight") == 2, "2").when(F.col("weight") == 1, "one").otherwise("7")).withColumn("assessability", F.lit("High")).select("taxonomy_id", taxonomy.entry_error(CATEGORIES).alias("error")),
        "select taxonomy_id, case when category not in (" + ", ".join(map(lit, CATEGORIES)) + ") then 'invalid category' when length(trim(requirement)) < 15 then 'requirement is empty or too short' when weight = 1 then 'weight is not an integer' when weight <> 2 then 'invalid weight'"
        " when len(list_filter(source_clause_ids, lambda x: not list_contains(known, x))) > 0 then 'source_clause_ids outside the batch' when len(list_distinct(source_clause_ids)) < len(source_clause_ids) then 'source_clause_ids contains duplicates' end as error from rules, (select list(clause_id) known from statutory_clauses)",
    ),
    Query(
        "val_schema_json",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", taxonomy.label_schema(F.col("source_clause_ids"), F.array("taxonomy_id"), decisions.LABELS).alias("schema")),
        "select taxonomy_id, '{\"type\":\"array\",\"items\":{\"type\":\"object\",\"properties\":{\"clause_id\":{\"type\":\"string\",\"enum\":' || to_json(source_clause_ids)::varchar || '},\"best_match_taxonomy_id\":{\"type\":\"string\",\"enum\":[\"NONE\",\"' || taxonomy_id || '\"]},\"verdict\":{\"type\":\"string\",\"enum\":[\"Compliant\",\"Partially Compliant\",\"Not Addressed\"]},"
        "\"justification\":{\"type\":\"string\"}},\"required\":[\"clause_id\",\"best_match_taxonomy_id\",\"verdict\",\"justification\"]}}' as schema from rules",
    ),
    Query(
        "sig_gates",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", *[c.alias(n) for c, n in zip(taxonomy.gates(F.col("category"), F.col("requirement"), GATES), ("required", "excluded"))]),
        "select taxonomy_id, case when category = 'Erasure' and regexp_matches(lower(requirement), 'delete|erase') then 'delete; erase' when category = 'Erasure' then 'remove' when category = 'Security' and regexp_matches(lower(requirement), 'encrypt') then 'encrypt; secure' when category = 'Notice' then 'notice; inform' else '' end as required,"
        " case when category = 'Erasure' and regexp_matches(lower(requirement), 'delete|erase') then 'archive' when category = 'Security' and regexp_matches(lower(requirement), 'encrypt') then 'public' else '' end as excluded from rules",
    ),
    Query("sig_gov_only", lambda s, d: table(s, d, "rules").select("taxonomy_id", taxonomy.out_of_scope(SCOPE, F.col("requirement"), F.col("checkable_test")).alias("out_of_scope")), f"select taxonomy_id, regexp_matches({JOINED}, {lit('(?i)' + '|'.join(SCOPE))}) as out_of_scope from rules"),
    Query("rank_gated", _gated, _gated_sql()),
    Query("rank_default", _defaulted, f"with r as ({RANKED_SQL}), f as (select taxonomy_id rule_id, row_number() over (order by taxonomy_id) place from rules where category in ('Notice', 'Security') order by taxonomy_id limit 3) select id, rule_id, place::bigint as place, 'keyword' as kind from r union all select clause_id, rule_id, place::bigint, 'default' from {ONE}, f where clause_id not in (select id from r)"),
]


# --- features, metrics, models ------------------------------------------------------------------------------------------------------
def _presence(spark, d):
    return _one(spark, d).select("clause_id", *[(F.round(v, 6) if k in ("length", "action_share") else v).alias(k) for k, v in features.presence(F.col("clause_text")).items()])


def _has(terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({T_}, {lit(t)})::int" for t in terms) + ")"


ACTS_SQL = f"({_has(L.PRESENCE_ACTIONS)} + {_has(L.PRESENCE_MECHANISMS)} + {_has(L.PRESENCE_COMMITMENTS)})"
PRESENCE_SQL = (
    f"select clause_id, {_has(L.PRESENCE_HEDGES)}::int as hedges, {_has(L.PRESENCE_ACTIONS)}::int as actions, (contains({T_}, '>') or contains(coalesce(clause_text, ''), 'http') or contains({T_}, '@') or contains({T_}, 'click'))::int as has_pointer, round({WORDS} / 100.0, 6)::double as length,"
    f" {_has(L.PRESENCE_REQUIREMENTS)}::int as requirements, {_has(L.PRESENCE_COMMITMENTS)}::int as commitments, {_has(L.PRESENCE_MECHANISMS)}::int as mechanisms, round({ACTS_SQL} / greatest(1, {_has(L.PRESENCE_HEDGES)} + {ACTS_SQL}), 6) as action_share from {ONE}"
)


def _guesses(spark, d):
    return _probabilities(spark, d).withColumn("guess", decisions.decide(F.col("p_yes"), F.col("p_part"), F.lit(0.6), F.lit(0.5)))


ROUNDS = 20
POISSON = "[" + ", ".join(repr(sum(2.718281828459045**-1 / f for f in fs)) for fs in [[1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800][: k + 1] for k in range(11)]) + "]"
BOOT_SQL = (
    f"with g as (select clause_id, (verdict = {GUESS})::int ok from {PROB}), r as (select k, ok, len(list_filter({POISSON}, lambda s: ('0x' || left(sha256(clause_id || ':' || k), 8))::bigint / 4294967296 >= s)) w from g, (select unnest(range(1, {ROUNDS + 1})) k)),"
    " a as (select k, sum(w * ok) / sum(w) a from r group by k) select round((select avg(ok) from g), 6) as accuracy, round(quantile_cont(a, 0.025), 6) as low, round(quantile_cont(a, 0.975), 6) as high from a"
)
MCC_SQL = (
    f"with c as ({CONF_SQL}), t as (select truth l, sum(n)::double t from c group by 1), g as (select guess l, sum(n)::double g from c group by 1), x as (select sum(n)::double n, coalesce(sum(n) filter (truth = guess), 0)::double h from c), s as (select sum(t * g) tg, sum(t * t) tt, sum(g * g) gg from t join g using (l))"
    " select round(coalesce((h * n - tg) / nullif(sqrt((n * n - tt) * (n * n - gg)), 0), 0), 6) as mcc from x, s"
)


def _labelled(spark, d):
    return _labels(spark, d).join(_one(spark, d).select("clause_id", "clause_text"), "clause_id")


def _stored(spark, d):
    """A fitted pipeline is stored, loaded and used for clauses without a verdict."""
    x = _labelled(spark, d)
    folder = f"{shared_dir(spark)}/lexweave-model-{uuid.uuid4().hex}"
    delete_later(spark, folder)
    models.save(models.logistic(x.where("verdict is not null"), "clause_text", "verdict", buckets=1 << 10, steps=30), folder)
    return models.predict(models.load(folder), x.where("verdict is null"), "clause_text").select("clause_id", "guess")


def _averaged(spark, d):
    x = _labelled(spark, d)
    known = materialize(x.where("verdict is not null"), "labelled")
    two = [(models.logistic(known, "clause_text", "verdict", buckets=1 << 10, steps=30), 0.5), (models.svm(known, "clause_text", "verdict", buckets=1 << 10, steps=15), 0.5)]
    return models.ensemble(two, x.where("verdict is null"), "clause_text", "clause_id").select(F.col("id").alias("clause_id"), "guess", F.round("score", 4).alias("score"))


def _calibrated(spark, d):
    x = _probabilities(spark, d).withColumn("hit", (F.col("verdict") == "Compliant").cast("int"))
    out = decisions.calibrated(x, x, "p_yes", "hit")
    return out.select("clause_id", F.round("calibrated", 6).alias("calibrated"))


METRICS = [
    Query("fe_presence8", _presence, PRESENCE_SQL),
    Query("met_mcc", lambda s, d: decisions.matthews(_confusion(s, d)).select(F.round("mcc", 6).alias("mcc")), MCC_SQL),
    Query("met_bootstrap", lambda s, d: decisions.bootstrap_accuracy(_guesses(s, d), "clause_id", "verdict", "guess", ROUNDS).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "low", "high")]), BOOT_SQL),
    Query("ml_isotonic", _calibrated),
    Query("ml_ensemble", _averaged),
    Query("api_predict", _stored),
    Query(
        "api_metrics",
        lambda s, d: scorecard.metrics_card(decisions.summary(decisions.report(_confusion(s, d))).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1")), "stand-in", "thresholds"),
        f"select 'stand-in' as name, 'thresholds' as kind, (select round(sum(n) filter (truth = guess) / sum(n), 6) from ({CONF_SQL})) as accuracy, (select round(avg(f1), 6) from ({REPORT_SQL})) as macro_f1",
    ),
    Query("sort_rankings", lambda s, d: scorecard.placed(_rankings(s, d)).select("owner", "effective", "place"), f"select owner, effective, row_number() over (order by effective desc nulls last, owner) as place from ({RANK_SQL})"),
    Query("api_rankings", lambda s, d: scorecard.placed(_rankings(s, d)).select(F.col("owner").alias("platform"), F.col("place").alias("rank"), F.col("effective").alias("final")), f"select owner as platform, row_number() over (order by effective desc nulls last, owner) as rank, effective as final from ({RANK_SQL})"),
]


# --- sources, cached calls, micro-batches -------------------------------------------------------------------------------------------
def _asked(spark, d):
    """Rules are put to a stand-in client, but for those whose answer the cache holds."""
    r = table(spark, d, "rules").select("taxonomy_id", "requirement")
    held = r.where("taxonomy_id < 'TX-020'").select("taxonomy_id", F.lit("held").alias("response"), F.when(F.col("taxonomy_id") < "TX-005", "FAILED").otherwise("SUCCESS").alias("status"))
    looked = materialize(curation.cached(r, held, "taxonomy_id"), "looked")

    def client(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise RuntimeError("refused")
        return f"{len(prompt)} characters"

    new = clients.ask(looked.where("status = 'NEW'"), "taxonomy_id", "requirement", client, retries=2, wait=0.0)
    return looked.where("status = 'CACHED'").select("taxonomy_id", "response", "status").unionByName(new.select("taxonomy_id", "response", "status"))


def _streamed(spark, d):
    """Clauses arrive as a stream; each distinct text's length is worked out once, in micro-batches over the cache."""
    folder = f"{shared_dir(spark)}/lexweave-stream-{uuid.uuid4().hex}"
    delete_later(spark, folder)
    source = table(spark, d, SC).select("clause_id", "clause_text").repartition(4)
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    keyed = stream.select(F.sha2("clause_text", 256).alias("key"), "clause_text")
    cache.run(keyed, f"{folder}/cache", "key", lambda new: new.select("key", F.length("clause_text").alias("n")), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key", "n").distinct()


def _union(spark, d):
    paths = [f"{d}/{n}.parquet" for n in ("no_such_table", PC, "raw_clauses")]
    return readers.union_of_splits(spark, *paths).select("clause_id", "clause_text")


SOURCES = [
    Query("udf_llm", _asked, "select taxonomy_id, case when taxonomy_id < 'TX-020' and taxonomy_id >= 'TX-005' then 'held' when length(requirement) % 7 = 0 then 'RuntimeError: refused' else length(requirement) || ' characters' end as response, case when taxonomy_id < 'TX-020' and taxonomy_id >= 'TX-005' then 'CACHED' when length(requirement) % 7 = 0 then 'FAILED' else 'SUCCESS' end as status from rules"),
    Query("stream_cache", _streamed, "select distinct sha256(clause_text) as key, length(clause_text)::int as n from statutory_clauses"),
    Query("src_fallback", _union, "select clause_id, min(clause_text) as clause_text from policy_clauses group by clause_id union all select clause_id, min(clause_text) from raw_clauses group by clause_id"),
    Query("src_rules", lambda s, d: readers.load_rules(table(s, d, "rules").unionByName(table(s, d, "rules").withColumn("requirement", F.lit("later")).withColumn("weight", F.lit(99))), "weight", ("TX-001",)).select("taxonomy_id", "requirement", "weight"), f"select taxonomy_id, {sql_display('requirement')} as requirement, weight from rules where taxonomy_id <> 'TX-001'"),
]

QUERIES = TEXT + DUPLICATES + VALIDATION + METRICS + SOURCES
