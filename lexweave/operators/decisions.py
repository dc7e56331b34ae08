"""Decisions from probabilities, threshold search, confusion tables and metrics."""

from __future__ import annotations

import math

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.keys import computed_once

LABELS = ["Compliant", "Partially Compliant", "Not Addressed"]


def decide(p_yes: Column, p_part: Column, t_yes, t_part, dominance: float | None = None) -> Column:
    yes = p_yes >= t_yes
    if dominance is not None:
        yes = yes & (p_yes >= dominance * p_part)
    return F.when(yes, LABELS[0]).when(p_part >= t_part, LABELS[1]).otherwise(LABELS[2])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_all / (classes * n)."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row for each class
    return g.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str] = LABELS, *keys: str) -> DataFrame:
    """(keys, truth, guess, n) over the full grid of labels."""
    got = df.groupBy(*keys, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    lab = F.array(*map(F.lit, labels))
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = base.select(*keys, F.explode(lab).alias("truth")).select("*", F.explode(lab).alias("guess"))
    return grid.join(got, [*keys, "truth", "guess"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, precision, recall, f1, support) of a confusion table; 0 where a denominator is 0."""
    hit = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    by_t = table.groupBy(*keys, F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    by_g = table.groupBy(*keys, F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    x = by_t.join(by_g, [*keys, "label"])
    safe = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    x = x.withColumn("precision", safe("hits", "guessed")).withColumn("recall", safe("hits", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return x.withColumn("f1", f1).select(*keys, "label", "precision", "recall", "f1", "support", "hits")


def summary(rep: DataFrame, *keys: str) -> DataFrame:
    """(keys, accuracy, macro_f1, weighted_f1, balanced_accuracy)."""
    n = F.sum("support")
    return rep.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("hits"), n), F.lit(0.0)).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), n), F.lit(0.0)).alias("weighted_f1"),
        F.avg("recall").alias("balanced_accuracy"),
    )


def matthews(table: DataFrame, *keys: str) -> DataFrame:
    """(keys, mcc) of a confusion table over any number of classes; 0 where either side has one class only."""
    n, hit = F.sum("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    square = lambda side: table.groupBy(*keys, side).agg(F.sum("n").alias("_n"))
    t = square("truth").withColumnsRenamed({"truth": "_l", "_n": "_t"})
    g = square("guess").withColumnsRenamed({"guess": "_l", "_n": "_g"})
    sums = t.join(g, [*keys, "_l"]).groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_g")).alias("tg"), F.sum(F.col("_t") * F.col("_t")).alias("tt"), F.sum(F.col("_g") * F.col("_g")).alias("gg"))
    x = table.groupBy(*keys).agg(n.cast("double").alias("_n"), hit.cast("double").alias("_h"))
    x = x.join(sums, list(keys)) if keys else x.crossJoin(F.broadcast(sums))  # one row each
    down = F.sqrt((F.col("_n") * F.col("_n") - F.col("tt")) * (F.col("_n") * F.col("_n") - F.col("gg")))
    return x.select(*keys, F.coalesce(F.try_divide(F.col("_h") * F.col("_n") - F.col("tg"), down), F.lit(0.0)).alias("mcc"))


def bootstrap_accuracy(df: DataFrame, id_col: str, truth: str, guess: str, rounds: int = 200, share: float = 0.95) -> DataFrame:
    """One row (accuracy, low, high): the accuracy and its bootstrap interval.

    In each round every row counts a Poisson(1) number of times, drawn from a hash of its id and the round, so no round gathers or
    samples anything: rows are folded into two numbers for each round before they are shuffled."""
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(1, 12):
        total += p
        steps.append(total)
        p /= k
    x = df.select(F.col(id_col).cast("string").alias("_i"), F.col(truth).eqNullSafe(F.col(guess)).cast("int").alias("_ok")).select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = F.conv(F.left(F.sha2(F.concat_ws(":", "_i", "round"), 256), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    times = F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: F.col("_u") >= s))
    each = computed_once(x, _u=u).withColumn("_w", times).groupBy("round").agg((F.sum(F.col("_w") * F.col("_ok")) / F.nullif(F.sum("_w"), F.lit(0))).alias("a"))
    ends = each.agg(*[F.percentile("a", F.lit(q)).alias(n) for q, n in (((1 - share) / 2, "low"), ((1 + share) / 2, "high"))])
    whole = df.agg(F.avg(F.col(truth).eqNullSafe(F.col(guess)).cast("double")).alias("accuracy"))
    return whole.crossJoin(F.broadcast(ends))  # one row each


def calibrated(fit_on: DataFrame, df: DataFrame, score: str, hit: str, name: str = "calibrated") -> DataFrame:
    """df with an isotonic calibration of `score`, fitted on fit_on(score, hit 0 or 1); scores beyond the fitted range take its ends.
    Rows without a score stay without one; without rows to fit on the score itself is kept."""
    rows = fit_on.where(F.col(score).isNotNull() & F.col(hit).isNotNull()).select(F.col(score).cast("double").alias("_s"), F.col(hit).cast("double").alias("label"))
    if rows.isEmpty():
        return df.withColumn(name, F.col(score).cast("double"))
    # the model's steps are a function of scores: at most one for each distinct score, of rows counted beforehand
    counted = rows.groupBy(F.round("_s", 6).alias("features")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight", predictionCol=name).fit(counted)
    known = model.setFeaturesCol("_s").transform(df.where(F.col(score).isNotNull()).withColumn("_s", F.col(score).cast("double"))).drop("_s")
    return known.unionByName(df.where(F.col(score).isNull()).withColumn(name, F.lit(None).cast("double")))


def grid_search(df: DataFrame, truth: str, p_yes: str, p_part: str, grid: list[tuple[float, float]], least_precision: float = 0.7) -> DataFrame:
    """One row (t_yes, t_part, macro_f1): the thresholds with the best macro F1 whose precision for the first label reaches the
    bound; the first of equals in the grid's order; no row if none does. One pass over the data: counts per cell of the grid."""
    spark = df.sparkSession
    g = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(grid)], "pos int, t_yes double, t_part double")
    x = df.select(truth, p_yes, p_part).crossJoin(F.broadcast(g))  # the grid is a parameter
    x = x.withColumn("guess", decide(F.col(p_yes), F.col(p_part), F.col("t_yes"), F.col("t_part")))
    rep = report(confusion(x, truth, "guess", LABELS, "pos", "t_yes", "t_part"), "pos", "t_yes", "t_part")
    ok = rep.where((F.col("label") == LABELS[0]) & (F.col("precision") >= least_precision)).select("pos")
    f1 = rep.groupBy("pos", "t_yes", "t_part").agg(F.avg("f1").alias("macro_f1")).join(ok, "pos")
    return f1.orderBy(F.round("macro_f1", 12).desc(), "pos").limit(1).select("t_yes", "t_part", "macro_f1")


def best_checkpoint(scores: DataFrame, model: str, truth: str, guess: str) -> DataFrame:
    """(model, macro_f1, place): models by macro F1 on rows of the validation split, best first; ties by name."""
    s = summary(report(confusion(scores, truth, guess, LABELS, model), model), model)
    w = Window.partitionBy(F.lit(1)).orderBy(F.round("macro_f1", 12).desc(), model)  # one row for each model
    return s.select(model, "macro_f1", F.row_number().over(w).alias("place"))


def accepted(old_macro: Column, new_macro: Column, worst_drop: Column, gain: float = 0.01, drop: float = 0.02) -> Column:
    """Whether a change gains enough overall and costs no class too much."""
    return F.when((new_macro - old_macro >= gain) & (worst_drop <= drop), "ACCEPT").otherwise("REJECT")
