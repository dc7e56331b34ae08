"""Aggregations, curation, sampling, features, decisions and reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.functions.keys import computed_once
from lexweave.operators import curation, decisions, duplicates, features, models, sampling, scorecard, segment, taxonomy
from lexweave.plans.registry import Query, lit, sql_canonical, sql_line, table
from lexweave.plans.structure_queries import LAST, ONE, _labels, _one
from lexweave.sources.readers import records

ACTS = ["HARROW_DATA_ACT", "HARROW_DATA_RULES", "ORLEN_NETWORK_ACT"]
KEY = "regexp_replace(lower(app_name), '[^a-z0-9]+', '', 'g')"


def _rules(spark, d):
    return table(spark, d, "rules").withColumn("act", taxonomy.act_code(F.col("act")))


RULES = "(select * replace (upper(replace(act, ' ', '_')) as act) from rules)"


def _judged(spark, d):
    """Each labelled clause with its app key, rule, category and verdict."""
    c = _one(spark, d).select("clause_id", F.regexp_replace(F.lower("app_name"), "[^a-z0-9]+", "").alias("app"))
    r = _rules(spark, d).select(F.col("taxonomy_id").alias("rule"), "category", "act")
    return _labels(spark, d).join(c, "clause_id").join(r, "rule", "left").withColumnRenamed("rule", "best_match_taxonomy_id")


JUDGED = f"(select l.clause_id, {KEY} app, rule, verdict, category, act from {LAST} l join {ONE} c using (clause_id) left join {RULES} r on r.taxonomy_id = l.rule)"
SCORE = "case verdict when 'Compliant' then 1.0::double when 'Partially Compliant' then 0.5::double else 0.0::double end"
POINTS = (
    f"(select o.owner, r.act grp, r.taxonomy_id as rule, coalesce(g.points, 0.0) points from (select distinct app as owner from {JUDGED} where app is not null) o cross join (select distinct taxonomy_id, act from {RULES}) r"
    f" left join (select app as owner, rule, max({SCORE}) points from {JUDGED} group by 1, 2) g on g.owner = o.owner and g.rule = r.taxonomy_id)"
)


def _points(spark, d):
    return scorecard.rule_points(_judged(spark, d), _rules(spark, d), "app")


def _matrix(spark, d):
    m = scorecard.matrix(_points(spark, d), ACTS)
    return m.select("owner", *[F.round(a, 6).alias(a.lower()) for a in ACTS], F.round("combined", 6).alias("combined"))


MATRIX_SQL = "select owner, " + ", ".join(f"round(least(100.0, sum(points) filter (grp = '{a}') * 100 / count(*) filter (grp = '{a}')), 6) as {a.lower()}" for a in ACTS) + f", round(sum(points) * 100 / count(*), 6) as combined from {POINTS} group by owner"


def _rankings(spark, d):
    rules = _rules(spark, d)
    n, scope = rules.agg(F.count_distinct("taxonomy_id"), F.count_if(T.level(F.col("assessability")) == "High")).first()
    r = scorecard.rankings(_judged(spark, d), _points(spark, d), "app", n, scope)
    return r.select("owner", "audited", "positive", "rules_covered", "full", "part", *[F.round(c, 4).alias(c) for c in ("quality", "combined", "coverage", "scope", "effective")])


POS = "verdict in ('Compliant', 'Partially Compliant')"
RANK_SQL = (
    "select owner, audited, positive, rules_covered, \"full\", part, round(quality, 4) as quality, round(combined, 4) as combined, round(rules_covered * 100.0 / n, 4) as coverage, round(rules_covered * 100.0 / s, 4) as scope, round(0.4 * quality + 0.6 * combined, 4) as effective from ("
    f"select app as owner, count(*) audited, count(*) filter ({POS}) positive, count(distinct rule) filter ({POS}) rules_covered, count(*) filter (verdict = 'Compliant') as \"full\", count(*) filter (verdict = 'Partially Compliant') part, coalesce(avg({SCORE}) filter ({POS}) * 100, 0.0) quality from {JUDGED} where app is not null group by app)"
    f" join (select owner, sum(points) * 100 / count(*) combined from {POINTS} group by owner) using (owner), (select count(distinct taxonomy_id) n, count(*) filter (lower(trim(assessability)) = 'high') s from rules)"
)


def _gaps(spark, d):
    return scorecard.gaps(_judged(spark, d).where("category is not null"), "app", "category").withColumn("quality", F.round("quality", 6))


GAP_SQL = f"select category, count(*) as n, count(distinct app) as owners, round(avg({SCORE}) * 100, 6) as quality, any_value(a) - count(distinct app) as owners_missing from {JUDGED}, (select count(distinct app) a from {JUDGED} where category is not null) where {POS} and category is not null group by category"

AGGREGATES = [
    Query("agg_value_counts", lambda s, d: scorecard.value_counts(table(s, d, "policy_clauses"), "extraction_quality").withColumn("share", F.round("share", 6)), "select extraction_quality as value, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as share from policy_clauses group by 1"),
    Query(
        "agg_doc_quality",
        lambda s, d: scorecard.document_quality(table(s, d, "pages_in")),
        "select doc, count(*) as pages, count(*) filter (trim(coalesce(t, '')) <> '') as pages_with_text, count(*) filter (o) as pages_needing_ocr, count(w) as pages_with_warnings, coalesce(sum(length(t)), 0)::bigint as characters, case when count(*) filter (trim(coalesce(t, '')) <> '') = 0 then 'FAIL' when count(w) > 0 then 'REVIEW' else 'PASS' end as status"
        " from (select doc, page_number, max(text) t, bool_or(needs_ocr) o, max(warning) w from pages_in group by 1, 2) group by doc",
    ),
    Query("agg_run_summary", lambda s, d: scorecard.bucket_summary(table(s, d, "policy_clauses"), "extraction_method", "extraction_quality").select(F.to_json("extraction_method").alias("methods"), F.to_json("extraction_quality").alias("qualities"))),
    Query(
        "agg_coverage",
        lambda s, d: table(s, d, "statutory_clauses").select("clause_id").join(table(s, d, "rules").select(F.explode("source_clause_ids").alias("clause_id")).distinct().withColumn("m", F.lit(1)), "clause_id", "left").agg(F.count("m").alias("mapped"), F.count_if(F.col("m").isNull()).alias("unmapped"), F.round(F.count("m") * 100 / F.count("*"), 6).alias("pct")),
        "select count(*) filter (m) as mapped, count(*) filter (not m) as unmapped, round(count(*) filter (m) * 100.0 / count(*), 6) as pct from (select clause_id in (select unnest(source_clause_ids) from rules) m from statutory_clauses)",
    ),
    Query(
        "agg_act_targets",
        lambda s, d: _rules(s, d).groupBy("act").agg(F.count("*").alias("n")).join(s.createDataFrame([("HARROW_DATA_ACT", 10, 12), ("HARROW_DATA_RULES", 10, 15)], "act string, low int, high int"), "act", "left").select("act", "n", scorecard.target_status(F.col("n"), F.col("low"), F.col("high")).alias("status")),
        f"select act, count(*) as n, case act when 'HARROW_DATA_ACT' then case when count(*) < 10 then 'BELOW_TARGET' when count(*) > 12 then 'ABOVE_TARGET' else 'WITHIN_TARGET' end when 'HARROW_DATA_RULES' then case when count(*) < 10 then 'BELOW_TARGET' when count(*) > 15 then 'ABOVE_TARGET' else 'WITHIN_TARGET' end else 'NO_TARGET_DEFINED' end as status from {RULES} group by act",
    ),
    Query("agg_denominators", lambda s, d: _rules(s, d).groupBy("act").agg(F.greatest(F.lit(1), F.count_distinct("taxonomy_id")).alias("n")), f"select act, greatest(1, count(distinct taxonomy_id)) as n from {RULES} group by act"),
    Query("agg_rule_points", lambda s, d: _points(s, d).select("owner", F.col("grp").alias("act"), "rule", "points"), f"select owner, grp as act, rule, points from {POINTS}"),
    Query("rep_matrix", _matrix, MATRIX_SQL),
    Query("rep_rankings", _rankings, RANK_SQL),
    Query("rep_gaps", _gaps, GAP_SQL),
    Query("agg_distinct_scope", lambda s, d: table(s, d, "rules").where(T.level(F.col("assessability")) == "High").agg(F.count_distinct("taxonomy_id").alias("n")), "select count(distinct taxonomy_id) as n from rules where lower(trim(assessability)) = 'high'"),
    Query("agg_batch_manifest", lambda s, d: segment.batches(_labels(s, d), 50, "clause_id").groupBy("batch_no").agg(F.count("*").alias("n"), F.count("verdict").alias("valid"), F.count_if(F.col("verdict").isNull()).alias("invalid")), f"select batch_no, count(*) as n, count(verdict) as valid, count(*) filter (verdict is null) as invalid from (select verdict, (row_number() over (order by clause_id) - 1) // 50 batch_no from {LAST}) group by batch_no"),
    Query("agg_merge_audit", lambda s, d: table(s, d, "rules").where("candidate_count > 1").select("taxonomy_id", F.array_join("source_candidate_ids", "|").alias("members")), "select taxonomy_id, array_to_string(source_candidate_ids, '|') as members from rules where candidate_count > 1"),
    Query("agg_concentration", lambda s, d: scorecard.concentration(_judged(s, d)).withColumn("top_share", F.round("top_share", 6)), f"select round(coalesce(max(n) / sum(n), 0.0), 6) as top_share, count(*) as rules from (select rule, count(*) n from {JUDGED} where {POS} group by rule)"),
    Query("agg_verbosity_corr", lambda s, d: computed_once(_one(s, d).where("clause_text is not null"), chars=F.length("clause_text"), words=features.word_count(F.col("clause_text"))).groupBy("source_document").agg(F.count("*").alias("n"), F.round(scorecard.correlation(F.col("chars"), F.col("words")), 6).alias("r")).where("n > 1"), f"select source_document, count(*) as n, round(corr(length(clause_text)::double, len(list_filter(string_split({sql_line('clause_text')}, ' '), lambda w: w <> ''))::double), 6) as r from {ONE} where clause_text is not null group by 1 having count(*) > 1"),
    Query("api_matrix", lambda s, d: _matrix(s, d).select(F.col("owner").alias("platform"), F.col("combined").alias("final"), F.round((F.col(ACTS[0].lower()) + F.col(ACTS[1].lower()) + F.col(ACTS[2].lower())) / 3, 4).alias("mean")), f"select owner as platform, combined as final, round(({' + '.join(a.lower() for a in ACTS)}) / 3, 4) as mean from ({MATRIX_SQL})"),
    Query("ui_band", lambda s, d: _matrix(s, d).select("owner", scorecard.band(F.col("combined")).alias("band")), f"select owner, case when combined >= 25 then 'high' when combined >= 10 then 'medium' else 'low' end as band from ({MATRIX_SQL})"),
    Query("ui_means", lambda s, d: _matrix(s, d).agg(*[F.round(F.avg(a.lower()), 4).alias(a.lower()) for a in ACTS]), "select " + ", ".join(f"round(avg({a.lower()}), 4) as {a.lower()}" for a in ACTS) + f" from ({MATRIX_SQL})"),
]


def _overridden(spark, d):
    p = table(spark, d, "split_assignments").where("verdict = 'Compliant'").select("clause_id", F.upper("verdict").alias("new_value"), F.lit("upper").alias("reason"))
    return curation.override(_labels(spark, d), p, "clause_id", "verdict").select("clause_id", "verdict", "old_value", "reason")


CURATION = [
    Query("upd_value_map", lambda s, d: curation.map_values(_one(s, d), "app_name", {"muviimrides": "Muviim", "kilierpay": "Kilier"}, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")).select("clause_id", "app_name"), f"select clause_id, case {KEY} when 'muviimrides' then 'Muviim' when 'kilierpay' then 'Kilier' else app_name end as app_name from {ONE}"),
    Query("upd_override", _overridden, f"select l.clause_id, case when p.clause_id is not null then 'COMPLIANT' else verdict end as verdict, case when p.clause_id is not null then verdict end as old_value, case when p.clause_id is not null then 'upper' end as reason from {LAST} l left join (select distinct clause_id from split_assignments where verdict = 'Compliant') p on p.clause_id = l.clause_id"),
    Query(
        "upd_quota",
        lambda s, d: curation.quota(_judged(s, d).where("app is not null"), ["app", "best_match_taxonomy_id"], F.col("verdict").isin("Compliant", "Partially Compliant"), "verdict", "Not Addressed", "clause_id").select("clause_id", "verdict"),
        f"select clause_id, case when ok and r = 1 then verdict else 'Not Addressed' end as verdict from (select *, row_number() over (partition by ok, app, rule order by clause_id) r from (select *, coalesce({POS}, false) ok from {JUDGED} where app is not null))",
    ),
    Query("upd_fix_act", lambda s, d: _labels(s, d).select("clause_id", F.when(F.contains("rule", F.lit("TX-00")), "FIRST").when(F.contains("rule", F.lit("TX-")), "OTHER").otherwise(F.lit(None)).alias("act")), f"select clause_id, case when contains(rule, 'TX-00') then 'FIRST' when contains(rule, 'TX-') then 'OTHER' end as act from {LAST}"),
    Query("upd_append", lambda s, d: curation.append_numbered(_one(s, d).select("clause_id", "clause_text"), table(s, d, "statutory_clauses").select(F.col("clause_id").alias("old_id"), "clause_text"), "clause_id", "S", 9, "old_id").select("clause_id", "clause_text"), f"select clause_id, clause_text from {ONE} union all select 'S' || lpad((row_number() over (order by clause_id) + (select max(substr(clause_id, 2)::bigint) from policy_clauses))::varchar, 9, '0'), clause_text from statutory_clauses"),
    Query("upd_cache", lambda s, d: curation.cached(_one(s, d).select("clause_id"), _labels(s, d).where("verdict is not null").select("clause_id", "verdict", F.lit("SUCCESS").alias("status")), "clause_id").select("clause_id", "verdict", "status"), f"select clause_id, l.verdict, case when l.clause_id is not null then 'CACHED' else 'NEW' end as status from {ONE} c left join (select * from {LAST} where verdict is not null) l using (clause_id)"),
    Query("txt_context", lambda s, d: _judged(s, d).join(_one(s, d).select("clause_id", "clause_text"), "clause_id").join(table(s, d, "rules").select(F.col("taxonomy_id").alias("best_match_taxonomy_id"), "checkable_test"), "best_match_taxonomy_id", "left").select("clause_id", F.concat(F.lit("["), F.coalesce("app", F.lit("Platform")), F.lit("] Mandate: "), F.coalesce("checkable_test", F.lit("General Policy")), F.lit(" | Policy: "), F.coalesce("clause_text", F.lit(""))).alias("context")), f"select j.clause_id, '[' || coalesce(app, 'Platform') || '] Mandate: ' || coalesce(checkable_test, 'General Policy') || ' | Policy: ' || coalesce(clause_text, '') as context from {JUDGED} j join {ONE} c on c.clause_id = j.clause_id left join rules r on r.taxonomy_id = j.rule"),
]


def _sampled(spark, d):
    return _labels(spark, d).where("verdict is not null").select("clause_id", "verdict")


SAMPLE_SQL = f"select *, row_number() over (partition by verdict order by sha256('42:' || clause_id), clause_id) r, count(*) over (partition by verdict) n from {LAST} where verdict is not null"
SAMPLING = [
    Query("smp_split", lambda s, d: sampling.stratified_split(_sampled(s, d), "clause_id", "verdict").select("clause_id", "split"), f"select clause_id, case when n < 2 or r <= round(n * 0.7) then 'train' when r <= round(n * 0.85) then 'validation' else 'test' end as split from ({SAMPLE_SQL})"),
    Query("smp_kfold", lambda s, d: sampling.folds(_sampled(s, d), "clause_id", "verdict", 5).select("clause_id", "fold"), f"select clause_id, ((r - 1) % 5)::int as fold from ({SAMPLE_SQL})"),
    Query("smp_downsample", lambda s, d: sampling.downsample(_sampled(s, d), "clause_id", "verdict", "Not Addressed", 100).select("clause_id", "verdict"), f"select clause_id, verdict from ({SAMPLE_SQL}) where verdict <> 'Not Addressed' or r <= 100"),
    Query("smp_augment", lambda s, d: sampling.augment(table(s, d, "rules").select("taxonomy_id", "requirement"), "requirement", ["Note: ", "In short, "], 3).select("taxonomy_id", "copy_no", "requirement"), "select taxonomy_id, k::int as copy_no, case when k % 2 = 0 then 'Note: ' else 'In short, ' end || requirement as requirement from rules, (select unnest([0, 1, 2]) k)"),
]


def _ngram_sql(source: str, pattern: str, tf: str, stop: list[str] = (), top: int | None = None) -> str:
    """TF-IDF over words and pairs of words; source is a query of (id, s)."""
    keep = f"list_filter(regexp_extract_all(lower(coalesce(s, '')), {lit(pattern)}), lambda x: x not in ({', '.join(map(lit, stop))}))" if stop else f"regexp_extract_all(lower(coalesce(s, '')), {lit(pattern)})"
    cut = f" where term in (select term from o group by term order by count(*) desc, term limit {top})" if top else ""
    return (
        f"with c as ({source}), k as (select id, {keep} w from c), o as (select id, unnest(w) term from k union all select id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) term from k), t as (select id, term, count(*) tf from o{cut} group by 1, 2),"
        f" i as (select term, ln((1 + (select count(distinct id) from c)) / (1 + count(*))) + 1 idf from t group by 1), w as (select id, term, {tf} * idf w from t join i using (term)) select id, term, w / sqrt(sum(w * w) over (partition by id)) as weight from w"
    )


TOKEN = r"\b[a-z_][a-z0-9_-]+\b"
WORD2 = r"[\p{L}\p{N}_]{2,}"


def _count(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"len(string_split({c}, {lit(t)})) - 1" for t in terms) + ")"


T_ = "lower(coalesce(clause_text, ''))"
WORDS = f"len(list_filter(string_split({sql_line(chr(99) + 'oalesce(clause_text, ' + chr(39) * 2 + ')')}, ' '), lambda w: w <> ''))"


def _flag(p: str) -> str:
    return f"regexp_matches(coalesce(clause_text, ''), {lit('(?i)' + p)})::int"


def _features(spark, d):
    f = features.actionability(F.col("clause_text"))
    return _one(spark, d).select("clause_id", *[(F.round(v, 6) if k in ("hedge_density", "commitment_ratio", "clause_length_norm") else v).alias(k) for k, v in f.items()])


FEATURES_SQL = (
    f"select clause_id, round({_count(T_, L.HEDGES)} / greatest(1, {WORDS}), 6) as hedge_density, {_count(T_, L.ACTIONS)}::int as action_verb_count, {_flag(L.UI_PATH)} as has_ui_path, {_flag(L.CONTACT)} as has_contact_mechanism, {_flag(L.TIMELINE)} as has_timeline_sla,"
    f" round({_count(T_, L.COMMITMENTS)} / ({_count(T_, L.COMMITMENTS)} + {_count(T_, L.HEDGES)} + 1e-8), 6) as commitment_ratio, round(least(1.0::double, {WORDS} / 100), 6) as clause_length_norm, {_flag(L.PARENTAL)} as parental_verification_marker from {ONE}"
)


def _probabilities(spark, d):
    """Deterministic stand-in probabilities from a hash of the id, with the label as truth."""
    h = lambda k: F.conv(F.substring(F.sha2(F.concat(F.col("clause_id"), F.lit(k)), 256), 1, 4), 16, 10).cast("double") / 65536
    return _sampled(spark, d).select("clause_id", "verdict", h("a").alias("p_yes"), h("b").alias("p_part"))


PROB = f"(select clause_id, verdict, ('0x' || left(sha256(clause_id || 'a'), 4))::int / 65536 p_yes, ('0x' || left(sha256(clause_id || 'b'), 4))::int / 65536 p_part from {LAST} where verdict is not null)"
GUESS = "case when p_yes >= 0.6 then 'Compliant' when p_part >= 0.5 then 'Partially Compliant' else 'Not Addressed' end"
LABELS = ["Compliant", "Partially Compliant", "Not Addressed"]
GRID = "(select unnest(['Compliant', 'Partially Compliant', 'Not Addressed']) truth), (select unnest(['Compliant', 'Partially Compliant', 'Not Addressed']) guess)"
CONF_SQL = f"select truth, guess, coalesce(n, 0) as n from (select * from {GRID}) left join (select verdict truth, {GUESS} guess, count(*) n from {PROB} group by 1, 2) using (truth, guess)"
REPORT_INNER = f"select t.label, coalesce(hits / nullif(guessed, 0), 0) p, coalesce(hits / nullif(support, 0), 0) r, support, hits from (select truth as label, sum(n) support, sum(n) filter (truth = guess) hits from ({CONF_SQL}) group by 1) t join (select guess as label, sum(n) guessed from ({CONF_SQL}) group by 1) g on g.label = t.label"
REPORT_SQL = f"select label, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, support::bigint as support from ({REPORT_INNER})"


def _confusion(spark, d):
    x = _probabilities(spark, d).withColumn("guess", decisions.decide(F.col("p_yes"), F.col("p_part"), F.lit(0.6), F.lit(0.5)))
    return decisions.confusion(x, "verdict", "guess")


CELLS = [(round(0.3 + 0.1 * i, 2), round(0.2 + 0.1 * j, 2)) for i in range(4) for j in range(3)]
GRID_SQL = (
    f"with g as (select unnest([{', '.join(f'{{pos: {i}, tc: {a}::double, tp: {b}::double}}' for i, (a, b) in enumerate(CELLS))}], recursive := true)), x as (select pos, tc, tp, verdict truth, case when p_yes >= tc then 'Compliant' when p_part >= tp then 'Partially Compliant' else 'Not Addressed' end guess from {PROB}, g),"
    " l as (select unnest(['Compliant', 'Partially Compliant', 'Not Addressed']) label), m as (select pos, tc, tp, label, count(*) filter (truth = label and guess = label) h, count(*) filter (guess = label) g, count(*) filter (truth = label) s from x, l group by all),"
    " f as (select pos, tc, tp, avg(coalesce(2 * h / nullif(g + s, 0), 0)) macro, max(case when label = 'Compliant' then coalesce(h / nullif(g, 0), 0) end) pr from m group by all)"
    " select tc as t_yes, tp as t_part, round(macro, 6) as macro_f1 from f where pr >= 0.05 order by round(macro, 12) desc, pos limit 1"
)

FEATURES = [
    Query("fe_actionability", _features, FEATURES_SQL),
    Query("fe_advanced8", lambda s, d: _one(s, d).select("clause_id", features.terms_present(F.col("clause_text"), L.HEDGES).alias("hedges"), features.terms_present(F.col("clause_text"), L.ACTIONS).alias("actions")), "select clause_id, (" + " + ".join(f"contains({T_}, {lit(t)})::int" for t in L.HEDGES) + ")::int as hedges, (" + " + ".join(f"contains({T_}, {lit(t)})::int" for t in L.ACTIONS) + f")::int as actions from {ONE}"),
    Query(
        "fe_robust_scale",
        lambda s, d: features.robust_scale(_one(s, d).select("clause_id", F.length("clause_text").cast("double").alias("x")).where("x is not null"), ["x"], F.lit(True)).select("clause_id", F.round("x", 6).alias("x")),
        f"select clause_id, round((length(clause_text) - m) / case when w = 0 then 1 else w end, 6) as x from {ONE}, (select quantile_cont(length(clause_text), 0.5) m, quantile_cont(length(clause_text), 0.75) - quantile_cont(length(clause_text), 0.25) w from {ONE} where clause_text is not null) where clause_text is not null",
    ),
    Query(
        "fe_tfidf",
        lambda s, d: features.tfidf(table(s, d, "statutory_clauses"), "clause_id", "clause_text").select("id", "term", F.round("weight", 6).alias("weight")),
        f"with t as (select clause_id id, term, count(*) tf from (select clause_id, unnest(regexp_extract_all({sql_canonical('clause_text')}, '[a-z0-9]+')) term from statutory_clauses) where length(term) > 1 group by 1, 2), i as (select term, ln((1 + (select count(distinct clause_id) from statutory_clauses)) / (1 + count(*))) + 1 idf from t group by 1), w as (select id, term, (1 + ln(tf)) * idf w from t join i using (term))"
        " select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from w",
    ),
    Query(
        "fe_tfidf_policy",
        lambda s, d: features.tfidf(_one(s, d), "clause_id", "clause_text", ngrams=(1, 2), pattern=TOKEN, stop_words=L.STOP_WORDS, max_features=5000).select("id", "term", F.round("weight", 6).alias("weight")),
        f"select id, term, round(weight, 6) as weight from ({_ngram_sql(f'select clause_id id, clause_text s from {ONE}', TOKEN, '(1 + ln(tf))', L.STOP_WORDS, 5000)})",
    ),
    Query("ml_class_weight", lambda s, d: decisions.class_weights(_sampled(s, d), "verdict").select("verdict", "n", F.round("weight", 6).alias("weight")), f"select verdict, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as weight from {LAST} where verdict is not null group by verdict"),
    Query("dec_threshold", lambda s, d: _probabilities(s, d).select("clause_id", decisions.decide(F.col("p_yes"), F.col("p_part"), F.lit(0.6), F.lit(0.5)).alias("guess")), f"select clause_id, {GUESS} as guess from {PROB}"),
    Query("dec_threshold_dom", lambda s, d: _probabilities(s, d).select("clause_id", decisions.decide(F.col("p_yes"), F.col("p_part"), F.lit(0.6), F.lit(0.5), 0.85).alias("guess")), f"select clause_id, case when p_yes >= 0.6 and p_yes >= 0.85 * p_part then 'Compliant' when p_part >= 0.5 then 'Partially Compliant' else 'Not Addressed' end as guess from {PROB}"),
    Query("dec_grid", lambda s, d: decisions.grid_search(_probabilities(s, d), "verdict", "p_yes", "p_part", CELLS, 0.05).withColumn("macro_f1", F.round("macro_f1", 6)), GRID_SQL),
    Query("met_confusion", _confusion, CONF_SQL),
    Query("met_report", lambda s, d: decisions.report(_confusion(s, d)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"), REPORT_SQL),
    Query("met_summary", lambda s, d: decisions.summary(decisions.report(_confusion(s, d))).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")]), f"select round(sum(hits) / sum(support), 6) as accuracy, round(avg(f), 6) as macro_f1, round(sum(f * support) / sum(support), 6) as weighted_f1, round(avg(r), 6) as balanced_accuracy from (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) f from ({REPORT_INNER}))"),
    Query("met_cv_summary", lambda s, d: sampling.folds(_probabilities(s, d), "clause_id", "verdict", 5).groupBy("fold").agg(F.avg("p_yes").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"), F.round(F.median("m"), 6).alias("median")), f"select round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, round(median(m), 6) as median from (select (r - 1) % 5 fold, avg(p_yes) m from (select p.*, row_number() over (partition by verdict order by sha256('42:' || clause_id), clause_id) r from {PROB} p) group by 1)"),
]

def _predicted(spark, d):
    """Labels of clauses without a verdict, by a model fitted on the labelled ones."""
    x = _labels(spark, d).join(_one(spark, d).select("clause_id", "clause_text"), "clause_id")
    model = models.logistic(x.where("verdict is not null"), "clause_text", "verdict", steps=100)
    return models.predict(model, x.where("verdict is null"), "clause_text").select("clause_id", "guess")


def _scans(spark, d):
    x = _probabilities(spark, d)
    cells = F.array(*[F.struct(F.lit(f"m{i}").alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(CELLS[:4])])
    x = x.select("*", F.explode(cells).alias("m")).withColumn("guess", decisions.decide(F.col("p_yes"), F.col("p_part"), F.col("m.a"), F.col("m.b")))
    return decisions.best_checkpoint(x.withColumn("model", F.col("m.model")), "model", "verdict", "guess").withColumn("macro_f1", F.round("macro_f1", 6))


SCAN_SQL = (
    f"with g as (select unnest([{', '.join(f'{{model: {chr(39)}m{i}{chr(39)}, tc: {a}::double, tp: {b}::double}}' for i, (a, b) in enumerate(CELLS[:4]))}], recursive := true)), x as (select model, verdict truth, case when p_yes >= tc then 'Compliant' when p_part >= tp then 'Partially Compliant' else 'Not Addressed' end guess from {PROB}, g),"
    " l as (select unnest(['Compliant', 'Partially Compliant', 'Not Addressed']) label), m as (select model, label, count(*) filter (truth = label and guess = label) h, count(*) filter (guess = label) g, count(*) filter (truth = label) s from x, l group by all),"
    " f as (select model, avg(coalesce(2 * h / nullif(g + s, 0), 0)) macro from m group by model) select model, round(macro, 6) as macro_f1, (row_number() over (order by round(macro, 12) desc, model))::int as place from f"
)
TFIDF = f"(with t as (select taxonomy_id id, term, count(*) tf from (select taxonomy_id, unnest(regexp_extract_all({sql_canonical('requirement')}, '[a-z0-9]+')) term from rules) where length(term) > 1 group by 1, 2), i as (select term, ln((1 + (select count(distinct taxonomy_id) from rules)) / (1 + count(*))) + 1 idf from t group by 1), w as (select id, term, (1 + ln(tf)) * idf w from t join i using (term)) select id, term, w / sqrt(sum(w * w) over (partition by id)) weight from w)"

RULE_TEXTS = "select taxonomy_id id, coalesce(requirement, '') || ' ' || coalesce(checkable_test, '') s from rules"

MODELS = [
    Query("ml_logreg", _predicted),
    Query("met_checkpoint_scan", _scans, SCAN_SQL),
    Query("met_accept", lambda s, d: _scans(s, d).where("place > 1").crossJoin(F.broadcast(_scans(s, d).where("place = 1").select(F.col("macro_f1").alias("best")))).select("model", decisions.accepted(F.col("macro_f1"), F.col("best"), F.lit(0.0)).alias("verdict")), f"with s as ({SCAN_SQL}) select model, case when (select macro_f1 from s where place = 1) - macro_f1 >= 0.01 then 'ACCEPT' else 'REJECT' end as verdict from s where place > 1"),
    Query("sim_engine", lambda s, d: duplicates.tfidf_pairs(features.tfidf(table(s, d, "rules"), "taxonomy_id", "requirement"), 0.2).withColumn("sim", F.round("sim", 5)), f"with t as materialized {TFIDF} select id_a, id_b, round(sim, 5) as sim from (select a.id id_a, b.id id_b, sum(a.weight * b.weight) sim from t a join t b on a.term = b.term and a.id < b.id group by 1, 2) where sim >= 0.2"),
    Query(
        "sim_engine_texts",
        lambda s, d: duplicates.tfidf_pairs(features.tfidf(table(s, d, "rules").withColumn("s", F.concat(F.coalesce("requirement", F.lit("")), F.lit(" "), F.coalesce("checkable_test", F.lit("")))), "taxonomy_id", "s", ngrams=(1, 2), sublinear=False, pattern=WORD2), 0.2).withColumn("sim", F.round("sim", 5)),
        f"with t as materialized ({_ngram_sql(RULE_TEXTS, WORD2, 'tf')}) select id_a, id_b, round(sim, 5) as sim from (select a.id id_a, b.id id_b, sum(a.weight * b.weight) sim from t a join t b on a.term = b.term and a.id < b.id group by 1, 2) where sim >= 0.2",
    ),
    Query("dup_multi_map", lambda s, d: duplicates.distinct_entries(table(s, d, "rules"), "taxonomy_id", "source_clause_ids", "category", "requirement")),
    Query("dup_near_policy", lambda s, d: duplicates.near_groups(_one(s, d).where("clause_text <> ''"), "clause_id", "clause_text", 98, 100).withColumnRenamed("id", "clause_id")),
]

SOURCES = [
    Query("src_records", lambda s, d: records(table(s, d, "policy_clauses")).select("clause_id", "clause_text"), "select clause_id, coalesce(clause_text, '') as clause_text from policy_clauses where clause_id is not null"),
    Query("src_unique_key", lambda s, d: table(s, d, "policy_clauses").groupBy("clause_id").agg(F.count("*").alias("n")).where("n > 1"), "select clause_id, count(*) as n from policy_clauses group by 1 having count(*) > 1"),
    Query("src_input_ids", lambda s, d: segment.numbered(_one(s, d).select("clause_id"), "clause_id").select("clause_id", F.format_string("INPUT-%07d", "pos").alias("input_id")), f"select clause_id, printf('INPUT-%07d', row_number() over (order by clause_id)) as input_id from {ONE}"),
    Query("src_records_rule", lambda s, d: table(s, d, "rules").where(~F.col("taxonomy_id").isin("TX-001", "TX-002")).groupBy("taxonomy_id").agg(F.min(T.display(F.col("requirement"))).alias("requirement")), f"select taxonomy_id, min({sql_line('requirement')}) as requirement from rules where taxonomy_id not in ('TX-001', 'TX-002') group by 1"),
    Query("src_sha256", lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256")), "select doc_id, sha256(text) as sha256 from documents"),
]


QUERIES = AGGREGATES + CURATION + SAMPLING + FEATURES + MODELS + SOURCES
