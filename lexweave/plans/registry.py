"""A query: its name, its Spark form and, where SQL can say the same, the SQL that another engine checks it with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# SQL building blocks for the checks. NBSP counts as white space in Unicode, so it is turned into a plain space first.
def sql_line(c: str) -> str:
    return f"trim(regexp_replace(replace({c}, chr(160), ' '), '\\s+', ' ', 'g'))"


def sql_display(c: str) -> str:
    return f"coalesce({sql_line(c)}, '')"


FORMS = {"\u00ad": "", "\u2026": "...", "\u2011": "\u2010", "\ufb01": "fi"}  # the compatibility forms that the tables have


def sql_canonical(c: str) -> str:
    for a, b in FORMS.items():
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return f"lower({sql_display(c)})"


def sql_joined(c: str) -> str:
    """normalize(), then one line."""
    return sql_line(f"regexp_replace(regexp_replace(replace(replace({c}, chr(173), ''), chr(160), ' '), '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '(\\w)-\\n(\\w)', '\\1\\2', 'g')")


def sql_any(c: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {lit(t)})" for t in terms) + ")"


def sql_whole(c: str, patterns: list[str]) -> str:
    return f"regexp_full_match({c}, {lit('(?is)(?:' + '|'.join(patterns) + ')')})"


def sql_heading(c: str, longest: int, letters: int, pattern: str) -> str:
    return f"(length({c}) <= {longest} and not regexp_matches({c}, '[.;:?!]$') and regexp_full_match({c}, {lit(pattern % letters)}))"


def sql_list(parts: list[str]) -> str:
    """A list of the parts that aren't null."""
    return "list_filter([" + ", ".join(parts) + "], lambda x: x is not null)"
