"""Scoring every record against every rule, ranking with caps, semantic fill, label clean-up.

Rules are a stated set held against all records. They are broadcast in blocks of at most BROADCAST_RULES rows; more rules give more
blocks, and the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.keys import computed_once
from lexweave.operators import segment
from lexweave.operators.duplicates import cosine
from lexweave.session import materialize

BROADCAST_RULES = 5_000


def against_rules(records: DataFrame, rules: DataFrame, most: int | None = None) -> DataFrame:
    """Every record with every rule. The rules are a stated set; they are broadcast in blocks of at most `most` rows."""
    most = most or BROADCAST_RULES
    rules = materialize(rules, "rules")
    n = rules.count()
    if n <= most:
        return records.crossJoin(F.broadcast(rules))
    keyed = materialize(segment.numbered(rules, *rules.columns[:1], name="_no"), "rules")
    out = None
    for lo in range(0, n, most):
        block = keyed.where((F.col("_no") > lo) & (F.col("_no") <= lo + most)).drop("_no")
        part = records.crossJoin(F.broadcast(block))
        out = part if out is None else out.unionByName(part)
    return out


def concepts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ";"), lambda x: F.trim(x)), lambda x: x != "")


def score_rules(records: DataFrame, rules: DataFrame, id_col: str, text: str, keywords: dict[str, list[str]], least: int = 4, gated: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(id, rule_id, category, score): 3 for each keyword of the rule's category, 4 for each required concept, 1 for each
    word of over 4 letters of the requirement that the lower-cased text contains; scores below `least` are dropped.

    gated: category -> (words, words): its keywords count only where the text has a word of each of the two lists as a word of its own
    (divided by white space), for keywords that are common in texts of any kind."""
    words = F.filter(F.split(F.lower("requirement"), " "), lambda w: F.length(w) > 4)
    kw = F.map_from_arrays(F.array(*map(F.lit, keywords)), F.array(*[F.array(*map(F.lit, v)) for v in keywords.values()])) if keywords else F.lit(None).cast("map<string,array<string>>")
    empty = F.array().cast("array<string>")
    r = rules.select(F.col("taxonomy_id").alias("rule_id"), "category", concepts(F.col("required_concepts")).alias("_c"), words.alias("_w"), F.coalesce(F.try_element_at(kw, F.col("category")), empty).alias("_k"))
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    x = records.select(F.col(id_col).alias("id"), t.alias("_t"))
    if gated:
        own = F.split(F.col("_t"), r"\s+")
        shut = [F.when(~(F.arrays_overlap(own, F.array(*map(F.lit, one))) & F.arrays_overlap(own, F.array(*map(F.lit, other)))), F.lit(c)) for c, (one, other) in gated.items()]
        x = computed_once(x, _shut=F.array_compact(F.array(*shut)))  # for each record, before it meets the rules
    x = against_rules(x, r)
    if gated:
        x = x.withColumn("_k", F.when(F.array_contains("_shut", F.coalesce("category", F.lit(""))), empty).otherwise(F.col("_k")))
    hit = lambda a: F.size(F.filter(a, lambda k: F.contains(F.col("_t"), k)))
    return x.select("id", "rule_id", "category", (3 * hit("_k") + 4 * hit("_c") + hit("_w")).alias("score")).where(F.col("score") >= least)


def ranked(scored: DataFrame, per_category: int = 2, most: int = 6) -> DataFrame:
    """(id, rule_id, score, place): at most per_category rules of a category and `most` in all, by score; ties by category of the
    first qualifying rule, then rule id."""
    cat = Window.partitionBy("id", "category").orderBy(F.col("score").desc(), "rule_id")
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "_first", "_r")
    first = F.min("rule_id").over(Window.partitionBy("id", "category"))
    x = scored.withColumn("_first", first).withColumn("_r", F.row_number().over(cat)).where(F.col("_r") <= per_category)
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("id", "rule_id", "score", "place")


def nearest(records: DataFrame, prototypes: DataFrame, id_col: str, vector: str, proto_id: str, proto_vector: str, k: int = 1, least: float | None = None) -> DataFrame:
    """(id, proto_id, sim, place): the k prototypes with the largest cosine (rounded to 6 digits; ties: smaller id)."""
    p = prototypes.select(F.col(proto_id).alias("proto_id"), F.col(proto_vector).alias("_p"))
    x = records.select(F.col(id_col).alias("id"), F.col(vector).alias("_v"))
    x = against_rules(x, p)
    x = x.select("id", "proto_id", F.round(cosine(F.col("_v"), F.col("_p")), 6).alias("sim"))
    if least is not None:
        x = x.where(F.col("sim") > least)
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "proto_id")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def by_default(records: DataFrame, id_col: str, routed: DataFrame, rules: DataFrame, categories: list[str], most: int = 4) -> DataFrame:
    """routed(id, rule_id, place, kind), and for records without any rule the first `most` rules (by id) of the default categories."""
    few = rules.where(F.col("category").isin(*categories)).select(F.col("taxonomy_id").alias("rule_id")).distinct().orderBy("rule_id").limit(most)
    few = few.withColumn("place", F.row_number().over(Window.orderBy("rule_id")).cast("bigint"))  # at most `most` rows
    left = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().join(routed.select("id"), "id", "left_anti")
    return routed.unionByName(left.crossJoin(F.broadcast(few)).select("id", "rule_id", "place", F.lit("default").alias("kind")))


def fill(chosen: DataFrame, extra: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """(id, rule_id, place, kind): chosen(id, rule_id, place); ids of extra(id, rule_id, place) with fewer than `least` chosen rules
    are filled up to `most` in extra's order, skipping what was chosen."""
    n = chosen.groupBy("id").agg(F.count("*").alias("n"))
    more = extra.join(chosen.select("id", "rule_id"), ["id", "rule_id"], "left_anti").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)
    w = Window.partitionBy("id").orderBy("place")
    more = more.withColumn("place", F.col("n") + F.row_number().over(w)).where(F.col("place") <= most)
    return chosen.select("id", "rule_id", F.col("place").cast("bigint"), F.lit("keyword").alias("kind")).union(more.select("id", "rule_id", F.col("place").cast("bigint"), F.lit("semantic").alias("kind")))


def clean_labels(expected: DataFrame, results: DataFrame, rules: DataFrame, order: str) -> DataFrame:
    """One label for each expected clause_id: the first result by `order`; unknown rules become NONE, NONE and Not Addressed go
    together, justifications are cut at 45 words, missing ids are filled."""
    w = Window.partitionBy("clause_id").orderBy(order)
    r = results.where("clause_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    known = rules.select(F.col("taxonomy_id").alias("best_match_taxonomy_id"), F.lit(True).alias("_known")).distinct()
    x = expected.select("clause_id").distinct().join(r, "clause_id", "left").join(known, "best_match_taxonomy_id", "left")
    verdict = T.display(F.coalesce("verdict", F.lit("Not Addressed")))
    none = F.col("_known").isNull() | (verdict == "Not Addressed")
    return x.select(
        "clause_id",
        F.when(none, "NONE").otherwise(F.col("best_match_taxonomy_id")).alias("best_match_taxonomy_id"),
        F.when(none, "Not Addressed").otherwise(verdict).alias("verdict"),
    )
