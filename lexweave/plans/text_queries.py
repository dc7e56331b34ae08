"""Text functions and signals over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.functions.keys import computed_once
from lexweave.operators import signals as S
from lexweave.plans.registry import Query, lit, sql_any, sql_canonical, sql_display, sql_heading, sql_line, sql_list, sql_whole, table

PC = "policy_clauses"


def _text(fn, name, out="out", source=PC, key="clause_id", column="clause_text"):
    return lambda spark, d: table(spark, d, source).select(key, fn(F.col(column)).alias(out))


NORMAL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(clause_text, chr(173), ''), chr(160), ' '),"
    " '\\r\\n?', chr(10), 'g'), '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))"
)
TEXT = [
    Query("txt_normalize", _text(T.normalize, "txt_normalize"), f"select clause_id, {NORMAL} as out from {PC}"),
    Query("txt_line", _text(T.line, "txt_line"), f"select clause_id, {sql_line('clause_text')} as out from {PC}"),
    Query("txt_display", _text(T.display, "txt_display"), f"select clause_id, {sql_display('clause_text')} as out from {PC}"),
    Query("txt_canonical", _text(T.canonical, "txt_canonical"), f"select clause_id, {sql_canonical('clause_text')} as out from {PC}"),
    Query("txt_canonical_nfkc", _text(T.canonical_nfkc, "txt_canonical_nfkc")),
    Query("txt_canonical_dash", _text(T.canonical_dash, "txt_canonical_dash"), f"select clause_id, replace(replace(replace({sql_canonical('clause_text')}, chr(8211), '-'), chr(8212), '-'), chr(8217), '''') as out from {PC}"),
    Query("txt_canonical_alnum", _text(T.canonical_alnum, "txt_canonical_alnum"), f"select clause_id, trim(regexp_replace({sql_canonical('clause_text')}, '[^a-z0-9]+', ' ', 'g')) as out from {PC}"),
    Query("txt_tokens", _text(lambda c: F.array_join(T.tokens(c), " "), "txt_tokens"), f"select clause_id, array_to_string(list_sort(list_distinct(regexp_extract_all({sql_canonical('clause_text')}, '[a-z0-9]+'))), ' ') as out from {PC}"),
    Query("txt_hash", _text(T.content_hash, "txt_hash"), f"select clause_id, sha256({sql_canonical('clause_text')}) as out from {PC}"),
    Query("txt_json_hash", lambda s, d: table(s, d, PC).select("clause_id", T.json_hash("clause_id", "clause_text", "app_name").alias("out"))),
    Query("txt_stable_id", _text(lambda c: T.stable_id(c, "C-"), "txt_stable_id"), f"select clause_id, 'C-' || left(sha256({sql_canonical('clause_text')}), 16) as out from {PC}"),
    Query("txt_safe_name", _text(T.safe_name, "", column="app_name"), f"select clause_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(app_name, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') as out from {PC}"),
    Query(
        "txt_act_from_file",
        lambda s, d: table(s, d, "statutory_clauses").select("source_file").distinct().select("source_file", T.name_from_file(F.col("source_file"), {"harrow_data": "HARROW", "harrow_data_rules": "HARROW_RULES"}).alias("out")),
        "select distinct source_file, case when contains(s, 'harrow_data_rules') then 'HARROW_RULES' when contains(s, 'harrow_data') then 'HARROW' else upper(s) end as out"
        " from (select source_file, lower(regexp_replace(regexp_replace(source_file, '\\.[^.]*$', ''), '[^A-Za-z0-9]+', '_', 'g')) s from statutory_clauses)",
    ),
    Query("txt_assess", _text(T.level, "", source="rules", key="taxonomy_id", column="assessability"), "select taxonomy_id, case lower(trim(assessability)) when 'high' then 'High' when 'low' then 'Low' else 'Medium' end as out from rules"),
    Query("txt_truncate_words", _text(lambda c: T.truncate_words(c, 12), ""), f"select clause_id, case when len(string_split(x, ' ')) > 12 then array_to_string(string_split(x, ' ')[1:12], ' ') else clause_text end as out from (select clause_id, clause_text, {sql_line('clause_text')} x from {PC})"),
    Query(
        "txt_parse_pct",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", T.parse_percent(F.concat("assessability", F.lit("%"))).alias("out")),
        "select taxonomy_id, coalesce(try_cast(trim(replace(assessability || '%', '%', '')) as double), 0.0) as out from rules",
    ),
    Query(
        "txt_prompt",
        lambda s, d: table(s, d, "rules").groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("taxonomy_id", F.format_string("[%s] %s\n  Test: %s", "taxonomy_id", "requirement", "checkable_test").alias("x")))), lambda r: r["x"]), "\n\n").alias("prompt")),
        "select category, string_agg('[' || taxonomy_id || '] ' || requirement || chr(10) || '  Test: ' || checkable_test, chr(10) || chr(10) order by taxonomy_id) as prompt from rules group by category",
    ),
    Query(
        "prj_format_pct",
        lambda s, d: table(s, d, "split_assignments").groupBy("best_match_taxonomy_id").agg(F.format_string("%5.1f%%", F.count("verdict") * 100 / F.count("*")).alias("pct")),
        "select best_match_taxonomy_id, printf('%5.1f%%', count(verdict) * 100.0 / count(*)) as pct from split_assignments group by 1",
    ),
]


def _policy(spark, d):
    return table(spark, d, PC)


def _statute(spark, d):
    return table(spark, d, "statutory_clauses")


def _c():
    return F.col("clause_text")


def _h():
    return F.col("section_heading")


CAN = sql_canonical("coalesce(section_heading, '') || ' ' || coalesce(clause_text, '')")


def _sql_categories(c: str, lexicon: dict[str, list[str]]) -> str:
    return sql_list([f"case when {sql_any(c, v)} then {lit(k)} end" for k, v in lexicon.items()])


def _relevance(spark, d):
    x = computed_once(_statute(spark, d), canon=S.with_heading(_c(), _h()))
    x = computed_once(x, cats=S.relevance(F.col("canon")))
    return x.select("clause_id", F.array_join("cats", "|").alias("categories"), F.size("cats").alias("score"), S.relevance_level(F.size("cats")).alias("level"))


REL_SQL = (
    f"select clause_id, array_to_string(cats, '|') as categories, len(cats)::int as score, case when len(cats) >= 4 then 'high' when len(cats) >= 2 then 'medium' when len(cats) = 1 then 'low' else 'unknown' end as level"
    f" from (select clause_id, list_concat({_sql_categories('c', L.RELEVANCE)}, case when {sql_any('c', L.CONTROL_WORDS)} then ['normative_or_conditional_language'] else [] end) cats from (select clause_id, {CAN} c from statutory_clauses))"
)


def _statutory(spark, d):
    x = computed_once(_policy(spark, d).select("clause_id", "clause_text", "section_heading"), canon=S.with_heading(_c(), _h()))
    x = computed_once(x, cats=S.statutory(F.col("canon")), normative=S.normative(F.col("canon")))
    score = S.statutory_score(F.col("cats"), F.col("normative"))
    return x.select("clause_id", F.array_join("cats", "|").alias("categories"), "normative", score.alias("score"), S.statutory_level(score).alias("level"))


STAT_INNER = f"select *, {_sql_categories('c', L.STATUTORY)} cats, {sql_any('c', L.NORMATIVE)} normative from (select *, {CAN} c from {PC})"
STAT_SQL = (
    "select clause_id, array_to_string(cats, '|') as categories, normative, score::int as score, case when score >= 3 then 'high' when score >= 1 then 'medium' else 'low' end as level"
    f" from (select *, len(cats) + case when normative and len(cats) > 0 then 1 else 0 end score from ({STAT_INNER}))"
)


def _sql_reason(c: str) -> str:
    return "case " + " ".join(f"when {sql_whole(c, [p])} then {lit(r)}" for p, r in L.BOILERPLATE) + " else '' end"


def _sql_domain(c: str) -> str:
    return f"case when {sql_any(f'lower({c})', L.PRIVACY_NAMES)} then 'data_privacy' when {sql_any(f'lower({c})', L.COMMERCIAL_NAMES)} then 'commercial_advertising' else 'platform_governance' end"


def _admin(spark, d):
    x = _statute(spark, d).select("clause_id", S.administrative(_c(), _h()).alias("r"))
    return x.select("clause_id", F.array_join("r", "|").alias("reasons"), F.size("r").alias("score"), S.administrative_level(F.col("r")).alias("level"))


ADMIN_SQL = (
    "select clause_id, array_to_string(r, '|') as reasons, len(r)::int as score, case len(r) when 0 then 'none' when 1 then 'weak' else 'possible' end as level from (select clause_id, "
    + sql_list([f"case when regexp_matches(clause_text, {lit('(?is)' + p)}) then {lit(r)} end" for p, r in L.ADMINISTRATIVE] + [f"case when {sql_any(sql_canonical('section_heading'), L.ADMINISTRATIVE_HEADINGS)} then 'administrative-sounding heading' end"])
    + " r from statutory_clauses)"
)


def _quality(c):
    return S.quality(c, 12, missing_source_document=F.col("source_document"), missing_app_name=F.col("app_name"))


def _triage(spark, d):
    """All triage columns of the policy clauses in one projection."""
    x = _policy(spark, d).select("clause_id", "clause_text", "section_heading", "source_document", "app_name", "ingested_at")
    x = computed_once(x, canon=S.with_heading(_c(), _h()), flat=T.display(_c()))
    x = computed_once(
        x,
        flags=_quality(F.col("flat")),
        boilerplate_reason=S.boilerplate_reason(F.col("flat")),
        domain=S.domain(F.col("source_document")),
        cats=S.statutory(F.col("canon")),
        normative=S.normative(F.col("canon")),
        hash=T.content_hash(_c()),
    ).drop("canon", "flat")
    x = x.withColumn("score", S.statutory_score(F.col("cats"), F.col("normative")))
    return x.withColumn("queue", S.policy_queue(F.col("flags"), F.col("boilerplate_reason") != "", F.col("score"), F.col("domain")))


FLAGS_SQL = sql_list(
    [
        f"case when {sql_display('clause_text')} = '' then 'empty_clause_text' end",
        f"case when length({sql_display('clause_text')}) < 12 then 'very_short_text' end",
        f"case when length({sql_display('clause_text')}) > 5000 then 'very_long_text' end",
        "case when trim(coalesce(source_document, '')) = '' then 'missing_source_document' end",
        "case when trim(coalesce(app_name, '')) = '' then 'missing_app_name' end",
    ]
)
TRIAGE_SQL = (
    "select *, case when len(flags) > 0 then 'quality_check' when reason <> '' then 'boilerplate_review' when score >= 2 and domain = 'data_privacy' then 'high' when score >= 1 or domain = 'data_privacy' then 'medium' else 'low' end queue from ("
    f"select clause_id, ingested_at, {FLAGS_SQL} flags, {_sql_reason(sql_display('clause_text'))} reason, {_sql_domain('source_document')} domain, sha256({sql_canonical('clause_text')}) hash, cats, len(cats) + case when normative and len(cats) > 0 then 1 else 0 end score from ({STAT_INNER}))"
)


def _labelling(spark, d):
    """Candidates for labelling: wanted queue, no boilerplate, not commercial, no flags; the first row for each content hash."""
    x = _triage(spark, d).where("queue in ('high', 'medium') and boilerplate_reason = '' and domain <> 'commercial_advertising' and size(flags) = 0")
    first = x.groupBy("hash").agg(F.min(F.struct("ingested_at", "clause_id")).alias("r"))
    return first.select("r.clause_id", "hash")


def _headings(spark, d):
    return table(spark, d, "raw_clauses").select("clause_id", F.posexplode(F.split("clause_text", "\n", -1)).alias("line_no", "line")).select(
        "clause_id", "line_no", S.junk(F.col("line")).alias("junk"), S.heading(F.col("line")).alias("heading"), S.bullet(F.col("line")).alias("bullet")
    )


X = sql_display("line")
HEAD_SQL = (
    f"select clause_id, (n - 1)::int as line_no, x = '' or {sql_whole('x', L.JUNK_POLICY)} as junk, {sql_heading('x', 140, 100, L.HEADING)} as heading, regexp_matches(x, {lit(L.BULLET)}) as bullet"
    f" from (select clause_id, n, {X} x from (select clause_id, unnest(string_split(clause_text, chr(10))) line, generate_subscripts(string_split(clause_text, chr(10)), 1) n from raw_clauses))"
)

SIGNALS = [
    Query("sig_line_kinds", _headings, HEAD_SQL),
    Query("sig_boilerplate", lambda s, d: computed_once(_policy(s, d).select("clause_id", "clause_text"), flat=T.display(_c())).select("clause_id", S.boilerplate_reason(F.col("flat")).alias("reason")), f"select clause_id, {_sql_reason(sql_display('clause_text'))} as reason from {PC}"),
    Query("sig_admin", _admin, ADMIN_SQL),
    Query("sig_relevance", _relevance, REL_SQL),
    Query("sig_statutory", _statutory, STAT_SQL),
    Query("sig_domain", lambda s, d: _policy(s, d).select("clause_id", S.domain(F.col("source_document")).alias("domain")), f"select clause_id, {_sql_domain('source_document')} as domain from {PC}"),
    Query("sig_quality", lambda s, d: computed_once(_policy(s, d), flat=T.display(_c())).select("clause_id", F.array_join(_quality(F.col("flat")), "|").alias("flags")), f"select clause_id, array_to_string({FLAGS_SQL}, '|') as flags from {PC}"),
    Query(
        "sig_priority_gov",
        lambda s, d: computed_once(_statute(s, d), canon=S.with_heading(_c(), _h())).select("clause_id", S.statute_queue(S.quality(T.display(_c()), 10, missing_page_start=F.col("page_start"), missing_source_file=F.col("source_file"), missing_source_act=F.col("source_act")), F.size(S.relevance(F.col("canon"))), S.administrative_level(S.administrative(_c(), _h()))).alias("queue")),
        "select s.clause_id, case when length(trim(coalesce(clause_text, ''))) < 10 or length(clause_text) > 5000 or page_start is null or trim(coalesce(source_file, '')) = '' or trim(coalesce(source_act, '')) = '' then 'quality_review'"
        " when score >= 2 then 'normal_or_high_relevance_review' when lv = 'possible' then 'administrative_review_optional' else 'standard_review' end as queue"
        f" from statutory_clauses s join ({REL_SQL}) r on r.clause_id = s.clause_id join (select clause_id, level lv from ({ADMIN_SQL})) a on a.clause_id = s.clause_id",
    ),
    Query("sig_priority_pol", lambda s, d: _triage(s, d).groupBy("queue", "domain").agg(F.count("*").alias("n")), f"select queue, domain, count(*) as n from ({TRIAGE_SQL}) group by queue, domain"),
    Query("flt_labeling", _labelling, f"select arg_min(clause_id, (ingested_at, clause_id)) as clause_id, hash from ({TRIAGE_SQL}) where queue in ('high', 'medium') and reason = '' and domain <> 'commercial_advertising' and len(flags) = 0 group by hash"),
    Query(
        "sig_signal_terms",
        lambda s, d: table(s, d, "rules").select("taxonomy_id", F.array_join(S.terms_found(T.canonical_dash(F.concat_ws(" ", "requirement", "checkable_test")), sorted(L.CHECKABILITY)), "|").alias("terms")),
        "select taxonomy_id, array_to_string(" + sql_list([f"case when contains(c, {lit(t)}) then {lit(t)} end" for t in sorted(L.CHECKABILITY)]) + f", '|') as terms from (select taxonomy_id, {sql_canonical("requirement || ' ' || checkable_test")} c from rules)",
    ),
    Query("prj_signal_coalesce", lambda s, d: _policy(s, d).select("clause_id", F.coalesce(F.nullif(F.lower(F.trim("section_heading")), F.lit("")), F.nullif(F.lower(F.trim("extraction_quality")), F.lit("")), F.lit("unknown")).alias("signal")), f"select clause_id, coalesce(nullif(lower(trim(section_heading)), ''), nullif(lower(trim(extraction_quality)), ''), 'unknown') as signal from {PC}"),
    Query("prj_essential", lambda s, d: _policy(s, d).select("clause_id", "app_name", "source_document", "source_file", "page_start", "page_end", "section_heading", "clause_text"), f"select clause_id, app_name, source_document, source_file, page_start, page_end, section_heading, clause_text from {PC}"),
]

QUERIES = TEXT + SIGNALS
