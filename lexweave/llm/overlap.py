"""Problem 1: records of evaluation splits that also stand, exactly or almost, in the training split.

Content-defined chunks: a record is normalised to its distinct words, put in the order of a seeded hash (so that neither
repeats nor the order of sentences matter). A hash rolls over windows of WINDOW words, and the record is cut where it falls below the
record's level; a chunk reaches from its cut to the next one, and its digest covers its first `width` words, of which the window is
a part, so that the cut follows from the digest's own words. SEEDS orders give as many independent cuttings. Digests are joined across
splits, shared chunk lengths are added into each record's overlap fraction (`chunk_overlap`: the shared lengths by all the words
of all cuttings), and pairs are then checked exactly on their word sets.

Levels fall with the record's size, so that every record has about as many chunks (44 for the threshold 0.8 and 36 words or more), and
they are nested: two records share all cuts below the lower of their levels, whatever their sizes. The width follows from the
threshold: about a fifth of the chunks of two records at the threshold agree. Sets of few words (below 15 at 0.8) are keyed
by their subsets as well, and no pair of two such sets is lost. Of random pairs of sets at the threshold at most about one in a
thousand shares no digest.

Cutting in text order is the weaker choice here: on a test table of 40,572 rows, each of ten variants lost 3 to 1,799 of the 3,733
pairs of sets with a similarity of 0.8, at 0.2 to 14 million candidates, for most short chunks are phrases of templates that
thousands of records share.

Cases: null texts and texts without words take part in nothing; null, unknown and unassigned splits neither; an id counts once,
however often its row is repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import name_key, reject_missing
from lexweave.llm import setjoin

SEEDS, WINDOW = 8, 4
CHUNKS = 44  # of a record of 36 words or more, at any threshold; up to 65 of a smaller one
MET_AT_ONCE = 0.21
MOST_SUBSETS = 110

# The notations of split names, lower case and without outer blanks.
TRAIN = ("train", "training")
EVAL = ("val", "validation", "test", "gold")


def smallest(num: int, den: int) -> int:
    """Sets below this size are keyed by their subsets: the largest size for which these are at most MOST_SUBSETS."""
    size = 1
    while sum(math.comb(size + 1, gone) for gone in range((size + 1) * (den - num) // den + 1)) <= MOST_SUBSETS and size < 30:
        size += 1
    return size + 1


def width_of(num: int, den: int) -> int:
    """Words of a digest; small sets must still have some places for chunks."""
    return max(1, min(smallest(num, den) // 2, round(math.log(MET_AT_ONCE) / math.log(num / den))))


def subset_keys(flat, off, num: int, den: int):
    """(row, key, length): of each small set a digest of each subset that lacks at most a share of 1 - num/den of its words. The common
    words of two sets that reach the threshold are such a subset of both, so none of these pairs is lost."""
    n = np.diff(off)
    at, key, length = [], [], []
    for size in range(1, smallest(num, den)):
        rows = np.flatnonzero(n == size)
        if not len(rows):
            continue
        h = setjoin.mix64(flat[off[rows][:, None] + np.arange(size)].astype(np.uint64), 77)
        for gone in range(size * (den - num) // den + 1):
            for out in itertools.combinations(range(size), gone):
                at.append(rows)
                key.append(setjoin.mix64(h.sum(axis=1) - h[:, list(out)].sum(axis=1), 78))
                length.append(np.full(len(rows), size - gone))
    return at, key, length


def chunk_keys(num: int, den: int):
    """The keys function of setjoin.candidates: chunks of all records, and the subsets of small ones."""
    small, width = smallest(num, den), width_of(num, den)
    window = min(WINDOW, width)
    rng = np.random.default_rng(20240201)
    flip = rng.integers(0, 2**32, SEEDS, dtype=np.uint32)
    turn = rng.integers(0, 2**31, SEEDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def cuttings(block, size):
        """(row in block, key, length) for each seed; block has one record of `size` words in each row."""
        places = size - width + 1
        level = np.uint32(min(1.0, ((CHUNKS + max(0, 36 - size)) / SEEDS - 1) / max(1, places - 1)) * (2**32 - 1))
        for seed in range(SEEDS):
            h = (block ^ flip[seed]) * turn[seed]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h.sort(axis=1)
            roll = h[:, :places].copy()
            for j in range(1, window):
                roll *= np.uint32(0x01000193)
                roll += h[:, j : j + places]
            roll ^= roll >> np.uint32(16)
            roll *= np.uint32(0x7FEB352D)
            roll ^= roll >> np.uint32(15)
            cut = roll <= level
            cut[:, 0] = True
            i, c = np.nonzero(cut)
            last = np.r_[i[1:] != i[:-1], True]
            k = np.full(len(i), seed + 1, np.uint64)
            for j in range(width):
                k = k * np.uint64(0x9E3779B97F4A7C15) + h[i, c + j]
            yield i, setjoin.mix64(k, 11), np.where(last, size, np.r_[c[1:], 0]) - c

    def keys(flat, off, with_payload):
        n = np.diff(off)
        all_at, all_key, all_len = subset_keys(flat, off, num, den)
        order = np.argsort(n, kind="stable")
        sizes, first = np.unique(n[order], return_index=True)
        for size, rows in zip(sizes.tolist(), np.split(order, first[1:])):
            if size < max(width, small * num // den):  # their partners at the threshold are small, too
                continue
            for i, k, length in cuttings(flat[off[rows][:, None] + np.arange(size)], size):
                all_at.append(rows[i])
                all_key.append(k)
                all_len.append(length)
        if not all_at:
            all_at, all_key, all_len = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        sketch = setjoin.payload(setjoin.registers(flat, off, setjoin.PAYLOAD)) if with_payload else None
        return np.concatenate(all_at), np.concatenate(all_key), np.concatenate(all_len), sketch

    return keys


def sides(assignments: DataFrame) -> DataFrame:
    """(id, split, side): the latest assignment with a split for each id (ties: the last split by name); side 1 is training,
    2 evaluation; other names are left out."""
    reject_missing(assignments, "clause_id", "split_name", "assigned_at")
    name = F.lower(F.regexp_replace("split_name", r"(?U)^\s+|\s+$", ""))
    side = F.when(name.isin(*TRAIN), 1).when(name.isin(*EVAL), 2)
    split = F.when(name.isin(*TRAIN), "train").when(name.isin("val", "validation"), "validation").otherwise(name)
    rows = assignments.select(F.col("clause_id").cast("string").alias("id"), "assigned_at", split.alias("split"), side.alias("side"))
    rows = rows.where("id is not null and side is not null")
    last = rows.groupBy("id").agg(F.max(F.struct("assigned_at", "split", "side")).alias("last"))
    return last.select("id", "last.split", "last.side")


class CrossSplit:
    """The links across splits of one pair of tables; built once, read by pairs(), records() and the report.

    links(x, y, overlap, chunk_overlap): nodes x (of an evaluation record) and y (of a training record) that reach the threshold."""

    def __init__(self, clauses: DataFrame, assignments: DataFrame, num: int = 4, den: int = 5):
        reject_missing(clauses, "clause_id", "clause_text")
        if not 0 < num < den:
            raise ValueError("the threshold must lie between 0 and 1")
        sets = setjoin.nodes_of(clauses, "clause_id", "clause_text")
        self.members = setjoin.materialize(
            sets.select("id", "node").distinct().join(sides(assignments), "id").select("id", "node", "split", "side"), "members"
        )
        flags = self.members.select("node", (F.col("side") - 1).alias("side")).distinct()
        found = setjoin.candidates(sets, chunk_keys(num, den), setjoin.mismatches(num, den), flags)
        links = setjoin.verified(sets, found, num, den)
        # the chunks of one cutting make up the whole record; a small record's subsets count as one cutting more
        part = F.least(F.lit(1.0), F.col("shared_a") / (SEEDS * F.col("n_a")))
        same = self.members.groupBy("node").agg(F.bit_or("side").alias("f")).where("f = 3")
        one = links.select(F.col("a").alias("x"), F.col("b").alias("y"), (F.col("both") / F.col("n_a")).alias("overlap"), part.alias("chunk_overlap"))
        self.links = one.union(same.select(F.col("node").alias("x"), F.col("node").alias("y"), F.lit(1.0).alias("overlap"), F.lit(1.0).alias("chunk_overlap")))

    def pairs(self) -> DataFrame:
        """(id_a, id_b), smaller first: each pair of a training and an evaluation record; the result's definition lists pairs."""
        ev = self.members.where("side = 2").select(F.col("id").alias("e"), F.col("node").alias("x"))
        tr = self.members.where("side = 1").select(F.col("id").alias("t"), F.col("node").alias("y"))
        out = ev.join(self.links, "x").join(tr, "y").where("e <> t")
        return out.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b")).distinct()

    def records(self) -> DataFrame:
        """(id, split, n_links, overlap, chunk_overlap): each evaluation record with a training partner: their number, the largest
        share of its words that one of them has, and the largest share of its chunks. Copies aren't expanded."""
        tr = self.members.where("side = 1").groupBy(F.col("node").alias("y")).agg(F.count("*").alias("n"))
        per = self.links.join(tr, "y").groupBy(F.col("x").alias("node"))
        per = setjoin.materialize(per.agg(F.sum("n").alias("n_links"), F.max("overlap").alias("overlap"), F.max("chunk_overlap").alias("chunk_overlap")), "records")
        out = self.members.where("side = 2").join(per, "node").groupBy("id", "split")
        return out.agg(F.sum("n_links").alias("n_links"), F.max("overlap").alias("overlap"), F.max("chunk_overlap").alias("chunk_overlap"))


def report(clauses: DataFrame, assignments: DataFrame) -> DataFrame:
    """(split, app_key, n_records, n_overlapping, n_links): per evaluation split and app; a null app is ''."""
    found = CrossSplit(clauses, assignments).records()
    apps = clauses.groupBy(F.col("clause_id").cast("string").alias("id")).agg(F.coalesce(F.min(name_key(F.col("app_name"))), F.lit("")).alias("app_key"))
    all_eval = sides(assignments).where("side = 2").join(apps, "id")
    return (
        all_eval.join(found.select("id", "n_links"), "id", "left")
        .groupBy("split", "app_key")
        .agg(F.count("*").alias("n_records"), F.count("n_links").alias("n_overlapping"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))
    )
