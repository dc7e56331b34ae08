"""Deterministic splits and samples: ranks by a seeded hash stand in for shuffling, so a run can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import materialize


def draw(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col)), 256)


def _ranked(df: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """Adds _r, the place within the class, and _n, the class's size. Rows are range-partitioned by class and hash, and counted by
    class and partition, so a class that has most rows is spread over as many tasks as it needs."""
    order = [F.col(label), F.col("_d"), F.col(id_col)]
    placed = df.withColumn("_d", draw(id_col, seed)).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.drop("_d").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "placed")
    shares = placed.groupBy(F.col(label).alias("_l"), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"), F.min("_row").alias("_first"))
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of a class
    shares = shares.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy("_l")))
    shares = materialize(shares.drop("_c"), "shares")
    x = placed.join(shares, (F.col("_part") == F.col("_p")) & F.col(label).eqNullSafe(F.col("_l")))
    return x.withColumn("_r", F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_l", "_p", "_first", "_before")


def stratified_split(df: DataFrame, id_col: str, label: str, seed: int = 42, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Adds split: within each class the first 70 % by hash are train, the next 15 % validation, the rest test; classes of one go to train."""
    x = _ranked(df, id_col, label, seed)
    a, b = F.round(F.col("_n") * train), F.round(F.col("_n") * (train + validation))
    split = F.when((F.col("_n") < 2) | (F.col("_r") <= a), "train").when(F.col("_r") <= b, "validation").otherwise("test")
    return x.withColumn("split", split).drop("_r", "_n")


def folds(df: DataFrame, id_col: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Adds fold (0 to k-1), dealt in turn within each class."""
    return _ranked(df, id_col, label, seed).withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r", "_n")


def downsample(df: DataFrame, id_col: str, label: str, value: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of one class, all rows of the others."""
    x = _ranked(df, id_col, label, seed)
    return x.where(~F.col(label).eqNullSafe(F.lit(value)) | (F.col("_r") <= n)).drop("_r", "_n")


def augment(df: DataFrame, text: str, templates: list[str], copies: int) -> DataFrame:
    """`copies` rows for each row, the k-th with the k-th template (in turn) before its text. Adds copy_no."""
    t = F.array(*map(F.lit, templates))
    x = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return x.withColumn(text, F.concat(F.element_at(t, F.pmod(F.col("copy_no"), F.lit(len(templates))) + 1), F.col(text)))
