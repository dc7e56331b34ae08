"""Feature columns of a clause. A null text counts as ''."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.session import materialize


def _t(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(T.line(_t(c)), " "), lambda w: w != ""))


def term_count(c: Column, terms: list[str]) -> Column:
    """Occurrences of the terms as substrings of the lower-cased text, without overlaps within a term."""
    low = F.lower(_t(c))
    total = F.lit(0)
    for t in terms:
        total = total + F.regexp_count(low, F.lit(re.escape(t)))
    return total


def terms_present(c: Column, terms: list[str]) -> Column:
    low = F.lower(_t(c))
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)))


def hedge_density(c: Column) -> Column:
    return term_count(c, L.HEDGES) / F.greatest(F.lit(1), word_count(c))


def flag(c: Column, pattern: str) -> Column:
    return _t(c).rlike("(?i)" + pattern).cast("int")


def commitment_ratio(c: Column) -> Column:
    n = term_count(c, L.COMMITMENTS)
    return n / (n + term_count(c, L.HEDGES) + F.lit(1e-8))


def length_norm(c: Column) -> Column:
    return F.least(F.lit(1.0), word_count(c) / 100)


def actionability(c: Column) -> dict[str, Column]:
    """The eight features by name."""
    return {
        "hedge_density": hedge_density(c),
        "action_verb_count": term_count(c, L.ACTIONS),
        "has_ui_path": flag(c, L.UI_PATH),
        "has_contact_mechanism": flag(c, L.CONTACT),
        "has_timeline_sla": flag(c, L.TIMELINE),
        "commitment_ratio": commitment_ratio(c),
        "clause_length_norm": length_norm(c),
        "parental_verification_marker": flag(c, L.PARENTAL),
    }


def presence(c: Column) -> dict[str, Column]:
    """The eight presence features by name: how many of each list's terms the text contains (not how often), whether it points
    somewhere, its length in hundreds of words, and the share of action among action and hedging."""
    n = {k: terms_present(c, getattr(L, "PRESENCE_" + k.upper())) for k in ("hedges", "actions", "requirements", "commitments", "mechanisms")}
    acts = n["actions"] + n["mechanisms"] + n["commitments"]
    points = F.greatest(*[F.contains(_t(c), F.lit(x)).cast("int") for x in (">", "http", "@")], F.contains(F.lower(_t(c)), F.lit("click")).cast("int"))
    return {
        "hedges": n["hedges"],
        "actions": n["actions"],
        "has_pointer": points,
        "length": word_count(c) / 100.0,
        "requirements": n["requirements"],
        "commitments": n["commitments"],
        "mechanisms": n["mechanisms"],
        "action_share": acts / F.greatest(F.lit(1), n["hedges"] + acts),
    }


def robust_scale(df: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """(x - median) / IQR with exact percentiles over the rows where fit_on holds; an IQR of 0 divides by 1."""
    p = [F.percentile(F.when(fit_on, F.col(c)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{c}") for c in columns]
    x = df.crossJoin(F.broadcast(df.agg(*p)))  # one row
    for c in columns:
        q = F.col(f"_{c}")
        width = q[2] - q[0]
        x = x.withColumn(c, (F.col(c) - q[1]) / F.when(width == 0, 1.0).otherwise(width)).drop(f"_{c}")
    return x


def tfidf(df: DataFrame, id_col: str, text: str, min_df: int = 1, ngrams: tuple[int, int] = (1, 1), sublinear: bool = True, pattern: str | None = None, stop_words: list[str] | None = None, max_features: int | None = None) -> DataFrame:
    """(id, term, weight): smoothed idf, term frequency (1 + ln tf if sublinear), L2 norm per record.

    Terms are runs of ngrams[0] to ngrams[1] neighbouring words that aren't stop words. Words are those of the canonical text, or
    the matches of pattern in the lower-cased text. max_features keeps the terms that are most frequent in the whole table (ties: by
    term) before norms are taken.
    """
    if pattern is None:
        tokens = F.filter(F.split(T.canonical(F.col(text)), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    else:
        tokens = F.regexp_extract_all(F.lower(_t(F.col(text))), F.lit(pattern), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(*stop_words))
    x = df.select(F.col(id_col).alias("id"), F.explode(F.array(tokens)).alias("_w"))
    lo, hi = ngrams

    def runs_of(n):
        starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
        return F.when(F.size("_w") >= n, F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in range(lo, hi + 1)]
    one = x.select("id", F.explode(F.concat(*runs) if hi > 1 else F.col("_w")).alias("term"))
    if max_features is not None:
        if min_df > 1:
            often = one.distinct().groupBy("term").agg(F.count("*").alias("_df")).where(F.col("_df") >= min_df).select("term")
            one = one.join(often, "term", "left_semi")
        top = one.groupBy("term").agg(F.count("*").alias("_all")).orderBy(F.col("_all").desc(), "term").limit(max_features)
        one = one.join(F.broadcast(materialize(top.select("term"), "terms")), "term")  # at most max_features rows
    tf = one.groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count_distinct(id_col).alias("n_docs"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).crossJoin(F.broadcast(n))  # one row
    idf = idf.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", ((1 + F.log("tf")) if sublinear else F.col("tf")) * F.col("idf"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))
