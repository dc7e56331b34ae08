"""Problem 6: groups of near-duplicate records, by HyperMinHash bands and collision-corrected Jaccard estimates.

Each record's sketch has bands x rows registers; a register keeps the leading zeros and ten further bits of the least hash
of the record's words under one function (records have tens of words, so registers take independent functions in place of
stochastic averaging, which would leave most of them empty). A band's key is the digest of its registers. Pairs that share
a band are estimated from one mantissa bit of each of 128 registers, corrected for chance collisions (a bit agrees by chance
in half the cases: J = 2 m - 1), and those near the threshold are verified on their sets. Links are closed into groups by
union-find.

Rows and bands follow from the threshold: with r rows and b bands a pair of similarity s meets in a band with probability
1 - (1 - s^r)^b, and b is the least number for which that is 0.9986 at the threshold itself; r is chosen so that about a fifth of
the bands agree there. At 0.8 these are 7 rows and 28 bands, which give 0.99998 at 0.85 and more beyond. More rows meet fewer
pairs below the threshold, for more bands: `rows` is a parameter, and grows by itself beyond MANY sets (rows_at).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm import setjoin
from lexweave.llm.forest import components

MET_AT_ONCE, LOST = 0.21, 0.0014
MANY = 400_000_000


def shape(num: int, den: int, rows: int | None = None) -> tuple[int, int]:
    """(rows, bands) for the threshold num/den; 1 asks for equal sets, which are one node anyway."""
    if not 0 < num < den:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = rows or max(1, round(math.log(MET_AT_ONCE) / math.log(num / den)))
    return rows, math.ceil(round(math.log(LOST) / math.log1p(-((num / den) ** rows)), 1))


def rows_at(n: int, num: int, den: int) -> int:
    """Rows of a band for n different sets: one more for every fourfold beyond MANY. Sets that share a template meet by s^rows, and their
    pairs grow faster than the sets; up to MANY, comparing them costs less than the further registers would."""
    return shape(num, den)[0] + max(0, math.ceil(math.log(n / MANY, 4)) if n else 0)


def band_keys(rows: int, bands: int):
    def keys(flat, off, with_payload):
        regs = setjoin.registers(flat, off, max(rows * bands, setjoin.PAYLOAD if with_payload else 0))
        n = len(off) - 1
        out = np.empty((n, bands), np.uint64)
        for band in range(bands):
            k = np.full(n, band + 1, np.uint64)
            for j in range(band * rows, (band + 1) * rows):
                k = (k ^ regs[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                k ^= k >> np.uint64(29)
            out[:, band] = k
        at = np.repeat(np.arange(n), bands)
        return at, out.ravel(), np.ones(n * bands, np.int32), setjoin.payload(regs) if with_payload else None

    return keys


def links(sets: DataFrame, num: int = 4, den: int = 5, rows: int | None = None) -> DataFrame:
    """(a, b, ...): all found pairs of different word sets with similarity of at least num/den."""
    rows = rows or rows_at(sets.where("w is not null").count(), num, den)
    found = setjoin.candidates(sets, band_keys(*shape(num, den, rows)), setjoin.mismatches(num, den))
    return setjoin.verified(sets, found, num, den)


def groups(df: DataFrame, id_col: str, text: str, num: int = 4, den: int = 5, rows: int | None = None) -> DataFrame:
    """(id, group_id): every id whose text has words; group_id is the smallest id of its group. Repeated ids count once."""
    sets = setjoin.nodes_of(df, id_col, text)
    found = links(sets, num, den, rows)
    roots = components(found.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    roots = roots.select(F.col("node").cast("bigint").alias("node"), F.col("root").cast("bigint").alias("root"))
    member = sets.select("id", "node").distinct().join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    # one row for each group of two or more, written out: a group that holds a third of the rows then meets a plain exchange,
    # which adaptive execution splits. An id with two different texts belongs to both of their groups
    least = setjoin.materialize(member.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1"), "groups")
    return member.join(least, "root", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n", F.lit(1)).alias("group_size"))
