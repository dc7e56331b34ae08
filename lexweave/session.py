"""Session set-up and materialised intermediate tables.

Intermediate results that are read more than once are written as Parquet under the folder that the cluster
names in ``spark.checkpoint.dir``, which all executors share. A lost executor then costs only the tasks that
were running on it: no later stage depends on blocks that lived in one executor's memory or on its disk.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime
import math
import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(cores: int | str = "*", name: str = "lexweave") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass the cluster's own session instead."""
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where it is unset, a temporary one."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if named.startswith("file:") and jsc.master().startswith("spark://"):
            # a mounted share looks just like this, so it's only worth a word
            warnings.warn("spark.checkpoint.dir is a file: folder; every executor must see the same one", stacklevel=2)
        return named.rstrip("/")
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lexweave-")
    spark.sparkContext.setCheckpointDir(made)
    return jsc.getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the cluster's own clean-up then removes the folder
        pass


_SCOPES: list[list[str]] = []  # paths only: functions sent to workers may bring this module along, and a session can't be sent


@contextlib.contextmanager
def scratch():
    """Intermediate tables made inside are deleted at the end of the block: read or write the result within it. Without such a
    block they stay until the process ends, for a DataFrame that is still to be run may need them."""
    mine: list[str] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        spark = SparkSession.getActiveSession()
        for path in mine if spark else ():
            _delete(spark, path)


def delete_later(spark: SparkSession, path: str) -> None:
    """Deletes the folder at the end of the innermost scratch() block, or when the process ends."""
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_delete, spark, path)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave-{name}-{uuid.uuid4().hex}"
    delete_later(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_stamp(now: datetime.datetime | None = None) -> Column:
    """The time of the run as text (UTC, ISO 8601, whole seconds): a literal, so every row and every retry has the same."""
    at = (now or datetime.datetime.now(datetime.UTC)).astimezone(datetime.UTC).replace(microsecond=0)
    return F.lit(at.isoformat())


def rows_of(df: DataFrame) -> int:
    """Row count; of a materialised table it comes from the Parquet footers."""
    return df.count()


def partitions_for(rows: int, per_partition: int) -> int:
    return max(1, math.ceil(rows / per_partition))
