"""Writing results: Parquet, CSV and JSON exports, partitions by a safe name, side outputs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, for formats without nesting."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def export_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header, everything quoted. With bom, every file begins with a byte order mark, for spreadsheets."""
    x = flat(df)
    if bom:
        x = x.withColumnRenamed(x.columns[0], "\ufeff" + x.columns[0])
    x.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def partitioned(df: DataFrame, column: str, path: str, fmt: str = "parquet") -> None:
    """One folder for each value of column, named by its safe form."""
    df.withColumn(f"{column}_key", T.safe_name(F.col(column))).write.mode("overwrite").partitionBy(f"{column}_key").format(fmt).save(path)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}" if name else path)
    return at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, version) that the newest pointer below path names; (0, None) if there is none."""
    fs, at = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at())] if fs.exists(at()) else []
    found = [(int(m.group(1)), m.group(2)) for m in (re.fullmatch(r"current-(\d+)-(v[0-9a-f]+)", n) for n in names) if m]
    return max(found, default=(0, None))


def replace_atomically(df: DataFrame, path: str) -> None:
    """Makes df the table at path: readers (read_current) see the old or the new table, never a part and never nothing.

    A version is written into a folder of its own; an empty pointer file, whose name says which version is current, comes into being last.
    A run that fails before leaves the old pointer. The version before last and older ones are removed afterwards, so a reader
    has until the second next replacement to finish."""
    spark = df.sparkSession
    fs, at = _files(spark, path)
    number, last = _newest(spark, path)
    version = f"v{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    if not fs.createNewFile(at(f"current-{number + 1:09d}-{version}")):
        raise RuntimeError(f"{path}: the pointer to the new version couldn't be made")
    for f in fs.listStatus(at()):
        name = f.getPath().getName()
        pointer = re.fullmatch(r"current-(\d+)-v[0-9a-f]+", name)
        if (pointer and int(pointer.group(1)) < number) or (name.startswith("v") and name not in (version, last)):
            fs.delete(f.getPath(), True)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table that replace_atomically last put at path."""
    version = _newest(spark, path)[1]
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def side_outputs(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(kept, review): rows without and with a reason; both come from one plan."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())
