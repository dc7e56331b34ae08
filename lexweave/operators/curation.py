"""Updates with an audit trail: value maps, overrides, quotas, appends, caches, merges of old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import segment
from lexweave.session import materialize


def map_values(df: DataFrame, column: str, table: dict[str, str], key=lambda c: c) -> DataFrame:
    """Replaces values whose key is in the table; others stay. The table is part of the plan, so keep it small."""
    if not table:
        return df
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(m, key(F.col(column))), F.col(column)))


def override(df: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """patches(key, new_value, reason) -> df with the column patched, and old_value and reason where it changed. Null patches don't count."""
    p = patches.where("new_value is not null").groupBy(key).agg(F.max(F.struct("new_value", "reason")).alias("_p"))
    x = df.join(p, key, "left")
    changed = F.col("_p").isNotNull() & ~F.col("_p.new_value").eqNullSafe(F.col(column))
    return x.withColumn("old_value", F.when(changed, F.col(column))).withColumn("reason", F.when(changed, F.col("_p.reason"))).withColumn(column, F.when(changed, F.col("_p.new_value")).otherwise(F.col(column))).drop("_p")


def quota(df: DataFrame, keys: list[str], allowed: Column, column: str, reset: str, *order: str) -> DataFrame:
    """The first row of each key among allowed rows keeps its value; all other rows are reset. First claim wins; of rows that tie, one.

    The first claims come from an aggregate over allowed rows, one row for each key, and are joined back: no key's rows are ranked."""
    x = materialize(df.withColumn("_ok", F.coalesce(allowed, F.lit(False))).withColumn("_u", F.monotonically_increasing_id()), "claims")
    first = x.where("_ok").groupBy(*keys).agg(F.min(F.struct(*order, "_u")).alias("_m")).select(F.col("_m._u").alias("_u"), F.lit(True).alias("_won"))
    x = x.join(first, "_u", "left")
    return x.withColumn(column, F.when(F.col("_won"), F.col(column)).otherwise(reset)).select(*df.columns)


def append_numbered(old: DataFrame, new: DataFrame, id_col: str, prefix: str, digits: int, *order: str) -> DataFrame:
    """new rows get the ids after the largest of old, in order."""
    top = old.agg(F.coalesce(F.max(F.substring(id_col, len(prefix) + 1, 20).cast("bigint")), F.lit(0)).alias("top"))
    n = segment.numbered(new, *order, name="_n").crossJoin(F.broadcast(top))  # one row
    made = n.withColumn(id_col, F.concat(F.lit(prefix), F.lpad((F.col("_n") + F.col("top")).cast("string"), digits, "0"))).drop("_n", "top")
    return old.unionByName(made, allowMissingColumns=True)


def cached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """requests with the cache's columns and status: CACHED, or NEW where the cache has no row (or a FAILED one)."""
    good = cache.where("coalesce(status, '') <> 'FAILED'").drop("status").dropDuplicates([key]).withColumn("_hit", F.lit(True))
    return requests.join(good, key, "left").withColumn("status", F.when(F.col("_hit"), "CACHED").otherwise("NEW")).drop("_hit")


def merge_back(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Old rows whose key new doesn't have, and of new the last row for each key by order."""
    last = new.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*new.columns), F.struct(*order)).alias("_l"))
    last = last.select(*[F.col("_l").getField(c).alias(c) for c in new.columns])
    return old.join(last.select(key), key, "left_anti").unionByName(last)
