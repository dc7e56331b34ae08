"""Rule candidates: parse, validate, trace to sources, flag, rank, cluster, select."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.operators import duplicates as D
from lexweave.operators import signals as S


def parse_ids(c: Column) -> Column:
    """JSON list or comma text -> array of trimmed ids; null or empty gives []."""
    t = F.trim(c)
    raw = F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.split(t, ","))).otherwise(F.split(t, ","))
    return F.coalesce(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


THOUGHTS = re.compile("<think>.*?</think>", re.DOTALL)


def _decoded(text: str, opening: str):
    """The JSON values that begin at occurrences of the opening bracket, from left to right; what one holds isn't looked at again."""
    decoder = json.JSONDecoder()  # made here, for it can't be sent to workers
    at = text.find(opening)
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            value, end = None, at + 1
        if value is not None:
            yield value
        at = text.find(opening, end)


def first_array(text: str | None) -> list | None:
    """The list in a model's answer: the first JSON list that stands on its own, thoughts set aside; text before and after it
    doesn't matter. Where the answer is an object, its first member that is a list. None if there is neither."""
    plain = THOUGHTS.sub("", text or "")
    brace, bracket = plain.find("{"), plain.find("[")
    if 0 <= brace < bracket or bracket < 0:
        for whole in _decoded(plain, "{"):
            held = [v for v in whole.values() if isinstance(v, list)]
            if held:
                return held[0]
    return next(_decoded(plain, "["), None)


@F.pandas_udf(ArrayType(StringType()))
def parse_array(s: pd.Series) -> pd.Series:
    """Answers -> the elements of their array as JSON texts; null where there is no array."""

    def one(x):
        got = first_array(x)
        return None if got is None else [json.dumps(e, sort_keys=True, ensure_ascii=False) for e in got]

    return s.map(one)


def parsed_entries(c: Column) -> Column:
    """A model's answer -> an array of (entry, problem): each element as a map of its fields' JSON texts, or what is wrong with its form."""
    made = F.transform(parse_array(c), lambda x: F.struct(F.from_json(x, "map<string,string>").alias("entry"), x.alias("json")))

    def judged(e):
        lacking = F.array_except(F.array(*map(F.lit, L.ENTRY_FIELDS)), F.map_keys(e["entry"]))
        problem = F.when(~e["json"].startswith("{"), "entry is not an object").when(F.size(lacking) > 0, F.concat(F.lit("missing fields: "), F.array_join(lacking, ", ")))
        return F.struct(e["entry"].alias("entry"), problem.alias("problem"))

    return F.transform(made, judged)


def entry_error(allowed: list[str], known_ids: str = "known_ids", confidence: str = "citation_confidence") -> Column:
    """The first rule that an entry breaks, null if none; known_ids is an array column of the ids the entry may cite. The weight
    may be a number or a text."""
    s = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("category", "requirement", "source", "checkable_test", "applicability", "assessability")}
    ids = F.transform("source_clause_ids", lambda x: F.trim(F.coalesce(x, F.lit(""))))
    weight = F.trim(F.col("weight").cast("string"))
    return (
        F.when(~s["category"].isin(*allowed), "invalid category")
        .when(F.length(s["requirement"]) < 15, "requirement is empty or too short")
        .when(F.length(s["requirement"]) > 1000, "requirement is unusually long")
        .when(s["checkable_test"] == "", "checkable_test is empty")
        .when(s["applicability"] == "", "applicability is empty")
        .when(s["assessability"] == "", "assessability is empty")
        .when(~F.lower(F.trim(F.coalesce(F.col(confidence), F.lit("")))).isin(*L.CONFIDENCES), "invalid citation_confidence")
        .when(s["source"].rlike("(?i)" + L.FILE_NAME), "source looks like a filename")
        .when(~F.coalesce(weight.rlike(r"\A[+-]?[0-9]+\z"), F.lit(False)), "weight is not an integer")
        .when(~F.coalesce(weight.try_cast("int").isin(*L.WEIGHTS), F.lit(False)), "invalid weight")
        .when(F.coalesce(F.size("source_clause_ids"), F.lit(0)) < 1, "source_clause_ids is empty")
        .when(F.exists(ids, lambda x: x == ""), "source_clause_ids contains an empty ID")
        .when(F.size(F.array_except(ids, known_ids)) > 0, "source_clause_ids outside the batch")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "source_clause_ids contains duplicates")
    )


def label_schema(clause_ids: Column, rule_ids: Column, verdicts: list[str]) -> Column:
    """The JSON schema that an answer for these clauses must keep to: an array of objects whose clause, rule (or NONE) and verdict are
    drawn from the given ones. Arrays of texts in, JSON text out."""
    text = F.struct(F.lit("string").alias("type"))
    one_of = lambda a: F.struct(F.lit("string").alias("type"), a.alias("enum"))
    names = ["clause_id", "best_match_taxonomy_id", "verdict", "justification"]
    kinds = [one_of(clause_ids), one_of(F.concat(F.array(F.lit("NONE")), F.array_sort(F.array_distinct(rule_ids)))), one_of(F.array(*map(F.lit, verdicts))), text]
    items = F.struct(F.lit("object").alias("type"), F.struct(*[k.alias(n) for n, k in zip(names, kinds)]).alias("properties"), F.array(*map(F.lit, names)).alias("required"))
    return F.to_json(F.struct(F.lit("array").alias("type"), items.alias("items")))


def gates(category: Column, text: Column, rules: list[tuple[str, str | None, str, str]]) -> tuple[Column, Column]:
    """(required, excluded) concept texts of the first rule that fits: rules are (category, pattern that the lower-cased text must hold
    or None, required, excluded), in order. A record without a fitting rule gets two empty texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = []
    for k in (2, 3):
        col = None
        for rule in rules:
            fits = category == rule[0]
            fits = fits & low.rlike(rule[1]) if rule[1] else fits
            col = (F if col is None else col).when(fits, F.lit(rule[k]))
        out.append(F.lit("") if col is None else col.otherwise(""))
    return out[0], out[1]


def out_of_scope(patterns: list[str], *texts: Column) -> Column:
    """Whether any of the patterns occurs in the texts, joined by spaces; case doesn't matter, nulls count as ''."""
    joined = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return joined.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def provenance(rules: DataFrame, clauses: DataFrame, rule_id: str = "taxonomy_id", ids: str = "source_clause_ids", act: str = "source_act") -> DataFrame:
    """(rule_id, source_acts, missing_ids, resolved_act): the acts of a rule's source clauses, one act, MULTI_ACT__... or UNRESOLVED."""
    one = rules.select(rule_id, F.explode_outer(F.array_distinct(ids)).alias("clause_id"))
    acts = clauses.groupBy("clause_id").agg(F.min(F.trim(act)).alias("_act"), F.lit(True).alias("_hit"))
    got = one.join(acts, "clause_id", "left").groupBy(rule_id).agg(
        F.array_sort(F.collect_set(F.when(F.col("_act") != "", F.col("_act")))).alias("source_acts"),
        F.array_sort(F.collect_set(F.when(F.col("_hit").isNull(), F.col("clause_id")))).alias("missing_ids"),
    )
    n = F.size("source_acts")
    resolved = F.when(n == 0, "UNRESOLVED").when(n == 1, F.get("source_acts", F.lit(0))).otherwise(F.concat(F.lit("MULTI_ACT__"), F.array_join("source_acts", "__")))
    return got.withColumn("resolved_act", resolved)


def act_code(c: Column) -> Column:
    """Spellings of an act's name -> upper snake case; empty is UNRESOLVED."""
    s = F.upper(F.regexp_replace(T.canonical_alnum(c), " ", "_"))
    return F.when(F.coalesce(s, F.lit("")) == "", "UNRESOLVED").otherwise(s)


def review_flags(requirement: Column, category: Column, test: Column, acts: Column, missing: Column) -> Column:
    """Flags in order."""
    blank = lambda c: F.coalesce(T.display(c), F.lit("")) == ""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  # the text is worked out once, not for each term
    return F.array_compact(
        F.array(
            F.when(blank(requirement), "missing_requirement"),
            F.when(blank(category), "missing_category"),
            F.when(blank(test), "missing_checkable_test"),
            F.when(F.size(missing) > 0, "missing_source_clause_ids"),
            F.when(F.size(acts) == 0, "no_resolved_source_act"),
            F.when(F.size(acts) > 1, "multi_act_provenance"),
            once(T.canonical_dash(F.concat_ws(" ", requirement, test)), lambda x: F.when(~S.any_term(x, L.CHECKABILITY), "low_policy_checkability_signal")),
            once(T.canonical_dash(requirement), lambda x: F.when(S.any_term(x, L.INSTITUTIONAL), "possible_institutional_or_administrative_content")),
        )
    )


def recommended(flags: Column) -> Column:
    has = lambda f: F.array_contains(flags, f)
    return (
        F.when(has("multi_act_provenance") | has("missing_source_clause_ids"), "REVIEW_PROVENANCE")
        .when(has("low_policy_checkability_signal"), "REVIEW_APPLICABILITY")
        .when(has("possible_institutional_or_administrative_content"), "REVIEW_SCOPE")
        .otherwise("LEGAL_REVIEW")
    )


def priority(weight: Column, requirement: Column, phrases: list[str]) -> Column:
    return weight * 4 + F.when(S.any_term(F.lower(requirement), phrases), 10).otherwise(0)


def diverse(rules: DataFrame, group: str, category: str, score: str, tie: str, most: int) -> DataFrame:
    """Per group: the best rule of every category first, then the others by score, cut at `most`."""
    in_cat = Window.partitionBy(group, category).orderBy(F.col(score).desc(), tie)
    w = Window.partitionBy(group).orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), F.when(F.col("_r") == 1, F.col(category)), F.col(score).desc(), tie)
    return rules.withColumn("_r", F.row_number().over(in_cat)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("_r")


def clusters(entries: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """First-match clusters: each entry joins the earliest leader among its neighbours in pairs(id_a, id_b, sim)."""
    return D.leaders(entries.select(F.col(id_col).alias("id")), pairs, best=False)
