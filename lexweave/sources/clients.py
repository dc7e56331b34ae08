"""Calling an external model for rows that the cache doesn't know: injectable client, bounded retries, one call for each row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ask(df: DataFrame, key: str, prompt: str, client: Callable[[str], str], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, response, status, attempts): status is SUCCESS or FAILED, with the error as response. The wait grows by one `wait`
    for each try. The client is called in the workers; ask only for rows that a cache lookup left over."""

    def one(p):
        for n in range(1, retries + 1):
            try:
                return client(p), "SUCCESS", n
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if n < retries:
                    time.sleep(wait * n)
        return error, "FAILED", retries

    def run(parts: Iterator[pd.DataFrame]):
        for part in parts:
            got = [one(p) for p in part[prompt]]
            yield pd.DataFrame({key: part[key], "response": [g[0] for g in got], "status": [g[1] for g in got], "attempts": [g[2] for g in got]})

    kind = dict(df.dtypes)[key]
    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, response string, status string, attempts int")
