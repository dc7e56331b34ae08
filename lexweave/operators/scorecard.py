"""Aggregations for reports: counts, shares, coverage matrices, rankings, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions.keys import reject_missing
from lexweave.operators import segment
from lexweave.operators.routing import against_rules


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share in %), null as a value of its own."""
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") * 100 / F.col("total")).alias("share"))  # one row


def verdict_score(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in L.VERDICT_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(0.0))


def document_quality(pages: DataFrame, doc: str = "doc", page: str = "page_number") -> DataFrame:
    """(doc, pages, pages_with_text, pages_needing_ocr, pages_with_warnings, characters, status); repeated pages count once."""
    one = pages.groupBy(doc, page).agg(F.max("text").alias("text"), F.bool_or("needs_ocr").alias("ocr"), F.max("warning").alias("warning"))
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    g = one.groupBy(doc).agg(
        F.count("*").alias("pages"),
        F.count_if(has_text).alias("pages_with_text"),
        F.count_if("ocr").alias("pages_needing_ocr"),
        F.count("warning").alias("pages_with_warnings"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
    )
    return g.withColumn("status", F.when(F.col("pages_with_text") == 0, "FAIL").when(F.col("pages_with_warnings") > 0, "REVIEW").otherwise("PASS"))


def rule_points(labels: DataFrame, rules: DataFrame, owner: str, rule: str = "best_match_taxonomy_id", group: str = "act") -> DataFrame:
    """(owner, group, rule, points) over every owner and rule: 1 if any label is Compliant, 0.5 if any is Partially Compliant, else 0.

    Only found combinations are aggregated; the dense grid is the rule list held against the owners.
    """
    got = labels.groupBy(F.col(owner).alias("owner"), F.col(rule).alias("rule")).agg(F.max(verdict_score(F.col("verdict"))).alias("points"))
    owners = labels.where(F.col(owner).isNotNull()).select(F.col(owner).alias("owner")).distinct()
    grid = against_rules(owners, rules.select(F.col("taxonomy_id").alias("rule"), F.col(group).alias("grp")).distinct())
    return grid.join(got, ["owner", "rule"], "left").withColumn("points", F.coalesce("points", F.lit(0.0)))


def matrix(points: DataFrame, groups: list[str]) -> DataFrame:
    """(owner, one percentage for each group, combined): points by rules, at most 100; combined is over all rules."""
    g = points.groupBy("owner", "grp").agg(F.sum("points").alias("p"), F.count("*").alias("n"))
    pct = F.first(F.least(F.lit(100.0), F.col("p") * 100 / F.greatest(F.lit(1), F.col("n"))))
    wide = g.groupBy("owner").pivot("grp", groups).agg(pct)
    total = points.groupBy("owner").agg((F.sum("points") * 100 / F.count("*")).alias("combined"))
    return wide.join(total, "owner")


def rankings(labels: DataFrame, points: DataFrame, owner: str, n_rules: int, n_scope: int, rule: str = "best_match_taxonomy_id") -> DataFrame:
    """Ten figures for each owner; quality is the mean score of its positive labels, effective is 0.4 quality + 0.6 combined."""
    pos = F.col("verdict").isin("Compliant", "Partially Compliant")
    s = verdict_score(F.col("verdict"))
    g = labels.where(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("owner")).agg(
        F.count("*").alias("audited"),
        F.count_if(pos).alias("positive"),
        F.count_distinct(F.when(pos, F.col(rule))).alias("rules_covered"),
        F.count_if(F.col("verdict") == "Compliant").alias("full"),
        F.count_if(F.col("verdict") == "Partially Compliant").alias("part"),
        F.coalesce(F.avg(F.when(pos, s)) * 100, F.lit(0.0)).alias("quality"),
    )
    total = points.groupBy("owner").agg((F.sum("points") * 100 / F.count("*")).alias("combined"))
    g = g.join(total, "owner").withColumn("coverage", F.col("rules_covered") * 100 / n_rules).withColumn("scope", F.col("rules_covered") * 100 / max(1, n_scope))
    return g.withColumn("effective", 0.4 * F.col("quality") + 0.6 * F.col("combined"))


def gaps(labels: DataFrame, owner: str, category: str) -> DataFrame:
    """(category, n, owners, quality, owners_missing) over positive labels."""
    pos = labels.where(F.col("verdict").isin("Compliant", "Partially Compliant"))
    n = labels.agg(F.count_distinct(owner).alias("all_owners"))
    g = pos.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners"), (F.avg(verdict_score(F.col("verdict"))) * 100).alias("quality"))
    return g.crossJoin(F.broadcast(n)).select("category", "n", "owners", "quality", (F.col("all_owners") - F.col("owners")).alias("owners_missing"))  # one row


def concentration(labels: DataFrame, rule: str = "best_match_taxonomy_id") -> DataFrame:
    """One row: share of the positive labels that fall on the most used rule."""
    g = labels.where(F.col("verdict").isin("Compliant", "Partially Compliant")).groupBy(rule).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0)).alias("top_share"), F.count("*").alias("rules"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of two whole numbers over the rows that have both. Of exact sums, so that order and partitions don't matter; NaN
    where one of the two doesn't vary, where corr() divides by zero, and null without rows."""
    x, y = F.when(y.isNotNull(), x).cast("long"), F.when(x.isNotNull(), y).cast("long")
    n, sx, sy, sxx, syy, sxy = (F.sum(v.cast("decimal(20,0)")) for v in (F.when(x.isNotNull(), 1), x, y, x * x, y * y, x * y))
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    r = (n * sxy - sx * sy).cast("double") / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double")))
    return F.when((vx == 0) | (vy == 0), float("nan")).otherwise(r)


def target_status(n: Column, low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "NO_TARGET_DEFINED").when(n < low, "BELOW_TARGET").when(n > high, "ABOVE_TARGET").otherwise("WITHIN_TARGET")


def band(c: Column) -> Column:
    return F.when(c >= 25, "high").when(c >= 10, "medium").otherwise("low")


def metrics_card(summary: DataFrame, name: str, kind: str, needed: tuple[str, ...] = ("accuracy", "macro_f1")) -> DataFrame:
    """One row (name, kind, the needed figures) of a metrics summary; fails if a figure is missing rather than to make one up."""
    reject_missing(summary, *needed)
    row = summary.select(*needed).limit(1)
    figures = row.first()
    if figures is None or any(v is None for v in figures):
        raise ValueError("the metrics have no values")
    return row.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), *needed)


def placed(rankings: DataFrame, score: str = "effective", tie: str = "owner") -> DataFrame:
    """rankings with `place` from 1, the best score first; ties by name, nulls last."""
    return segment.numbered(rankings, F.col(score).desc_nulls_last(), F.col(tie), name="place")


def bucket_summary(df: DataFrame, *columns: str) -> DataFrame:
    """One row: number of rows and, for each column, its values with their counts as a map."""
    parts = None
    for c in columns:
        g = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
        one = g.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(c))
        parts = one if parts is None else parts.crossJoin(one)  # one row each
    return parts


