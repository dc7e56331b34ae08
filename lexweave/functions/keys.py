"""Column expressions for keys and words. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVISIBLE = "­​"  # fixed values: soft hyphen and zero-width space, dropped before words are taken


def name_key(c: Column) -> Column:
    """Lower-cased name with only a-z0-9 kept; null stays null, a name without such characters becomes ''."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def alnum(c: Column) -> Column:
    """The text's sequence of a-z0-9 after lower-casing."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def words(c: Column) -> Column:
    """All maximal runs of a-z0-9 of the lower-cased text without soft hyphens and zero-width spaces; null gives []."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), INVISIBLE, "")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added behind a generator: filters aren't pushed below it and expressions aren't copied from it, so a
    costly column that several others use is worked out once for each row."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once")
    return df.select("*", made).select(*df.columns, *[F.col(f"_once.{k}").alias(k) for k in columns])


def reject_missing(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
