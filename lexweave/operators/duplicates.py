"""Exact and near duplicates: groups, leaders, set-similarity joins on arrays of tokens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from lexweave.functions import text as T
from lexweave.functions.keys import computed_once
from lexweave.operators import segment
from lexweave.session import materialize


def exact_groups(df: DataFrame, key: Column, *order: str, prefix: str = "EXACT-", digits: int = 5, name: str = "exact_group") -> DataFrame:
    """Adds the group id of rows that share a key: numbered by first appearance; '' for single rows.

    Keys are counted before anything is joined, so a key that a third of the rows share costs one row in the shuffle of counts.
    """
    x = df.withColumn("_k", key)
    groups = x.groupBy("_k").agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first")).where("_n > 1")
    ids = segment.numbered(groups, "_first", name="_g").select("_k", F.concat(F.lit(prefix), F.lpad(F.col("_g").cast("string"), digits, "0")).alias(name))
    return x.join(ids, "_k", "left").withColumn(name, F.coalesce(name, F.lit(""))).drop("_k")


def first_per_key(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key; null keys are one key. An aggregate, so each task ships one row for each of its keys, however many
    rows share one; of rows that tie in all order columns any one is taken."""
    first = df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return first.select(*[F.col("_r").getField(c).alias(c) for c in df.columns])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similar(df: DataFrame, id_col: str, tokens: str, num: int, den: int, block: str | None = None) -> tuple[DataFrame, DataFrame]:
    """members(id, rep) and pairs(id_a, id_b, both, n_a, n_b): all pairs of different sets (of one block) with Jaccard >= num/den.

    Rows with equal sets are one class, named by its smallest id, and pairs stand between classes only: copies are never
    expanded into pairs. Exact: tokens are ranked by rising frequency; two sets that reach the threshold share a token among
    their first n - ceil(t n) + 1, so only these are joined, and every candidate is verified in integers. Null sets have no class;
    empty sets are one class.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(tokens).alias("t"), (F.col(block) if block else F.lit("")).alias("b"))
    rows = materialize(rows.where("id is not null and t is not null").withColumn("c", F.xxhash64("b", "t")), "rows")
    classes = materialize(rows.groupBy("b", "c").agg(F.min("id").alias("rep"), F.min("t").alias("t")), "classes")
    members = rows.select("id", "b", "c").distinct().join(classes.select("b", "c", "rep"), ["b", "c"]).select("id", "rep")
    long = classes.select("b", "rep", F.size("t").alias("n"), F.explode("t").alias("w"))
    # written out: a word that every set has then meets a plain exchange, which adaptive execution splits, or a broadcast by size
    seen = materialize(long.groupBy("b", "w").agg(F.count("*").alias("f")), "frequencies")
    w = Window.partitionBy("rep", "b").orderBy("f", "w")
    ranked = long.join(seen, ["b", "w"]).withColumn("r", F.row_number().over(w))
    head = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1).select("b", "w", "rep", "n")
    x, y = head.select("b", "w", F.col("rep").alias("id_a"), F.col("n").alias("na")), head.select("b", "w", F.col("rep").alias("id_b"), F.col("n").alias("nb"))
    sizes = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    cand = x.join(y, ["b", "w"]).where((F.col("id_a") < F.col("id_b")) & sizes).select("b", "id_a", "id_b").distinct()
    sets = classes.select("b", "rep", "t")
    pairs = cand.join(sets.select("b", F.col("rep").alias("id_a"), F.col("t").alias("ta")), ["b", "id_a"]).join(sets.select("b", F.col("rep").alias("id_b"), F.col("t").alias("tb")), ["b", "id_b"])
    pairs = computed_once(pairs, both=F.size(F.array_intersect("ta", "tb"))).select("id_a", "id_b", "both", F.size("ta").alias("n_a"), F.size("tb").alias("n_b"))
    return members, pairs.where(F.col("both") * den >= (F.col("n_a") + F.col("n_b") - F.col("both")) * num)


TAIL = 500_000  # undecided rows, and four times as many pairs of them, that one task may settle


def _settle(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The leaders among ids, in one task, row after row: pairs(id_a < id_b) of them. The caller bounds both."""
    schema = T_.StructType([T_.StructField("id", ids.schema["id"].dataType)])
    earlier = pairs.groupBy(F.col("id_b").alias("id")).agg(F.collect_list("id_a").alias("before"))

    def run(batches):
        lead: set = set()
        for batch in batches:
            new = []
            for i, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lead.isdisjoint(before or ()):
                    lead.add(i)
                    new.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(new, batch.column(0).type)], ["id"])

    return ids.join(earlier, "id", "left").repartition(1).sortWithinPartitions("id").mapInArrow(run, schema)


def leaders(ids: DataFrame, pairs: DataFrame, best: bool = True, tail: int = TAIL) -> DataFrame:
    """Greedy leaders in id order: ids(id), pairs(id_a < id_b, sim) -> (id, leader, sim).

    A row is a leader if no earlier leader is its neighbour (the lexicographically first maximal independent set). Others join the
    most similar leader (ties: the earliest), or the earliest one with best=False. A round settles every row whose earlier neighbours
    are settled, which leaves ever fewer rows; once at most `tail` are left (with at most four times as many pairs), one task settles
    these in order. Rounds are thus spent only on what is larger than that: a chain of neighbours of tail + 2 n rows takes n of them.
    """
    pairs = materialize(pairs.select("id_a", "id_b", "sim"), "pairs")
    later = pairs.select(F.col("id_b").alias("id")).distinct()
    lead = materialize(ids.select("id").join(later, "id", "left_anti"), "leaders")
    rest, fell = materialize(later, "open"), None
    while True:
        hit = pairs.join(lead.withColumnRenamed("id", "id_a"), "id_a").select(F.col("id_b").alias("id")).distinct()
        fell = materialize(hit if fell is None else hit.union(fell).distinct(), "fell")
        rest = materialize(rest.join(fell, "id", "left_anti").join(lead, "id", "left_anti"), "open")
        n = rest.count()
        if not n:
            break
        among = pairs.join(rest.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(rest.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
        among = materialize(among.select("id_a", "id_b"), "among")
        if n <= tail and among.count() <= 4 * tail:
            lead = materialize(lead.union(_settle(rest, among)), "leaders")
            break
        lead = materialize(lead.union(rest.join(among.select(F.col("id_b").alias("id")), "id", "left_anti")), "leaders")
    follow = pairs.join(lead.withColumnRenamed("id", "id_a"), "id_a").join(lead.withColumnRenamed("id", "id_b"), "id_b", "left_anti")
    order = [F.col("sim").desc(), F.col("id_a")] if best else [F.col("id_a")]
    w = Window.partitionBy("id_b").orderBy(*order)
    follow = follow.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("id_b").alias("id"), F.col("id_a").alias("leader"), "sim")
    return lead.select("id", F.col("id").alias("leader"), F.lit(1.0).alias("sim")).union(follow)


def near_groups(df: DataFrame, id_col: str, text: str, num: int, den: int, prefix: str = "NEAR-", block: str | None = None, digits: int = 5) -> DataFrame:
    """(id, leader, sim, near_group): greedy near-duplicate groups by Jaccard of canonical tokens. near_group is numbered over
    all leaders in id order and '' for groups of one; sim is rounded to 6 digits."""
    members, pairs = similar(df.withColumn("_tok", T.tokens(F.col(text))), id_col, "_tok", num, den, block)
    pairs = materialize(pairs.select("id_a", "id_b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("sim")), "pairs")
    # only the first row of a class can lead, so leaders are elected among the classes' first rows ...
    lead = leaders(members.select(F.col("rep").alias("id")).distinct(), pairs).where("id = leader").select("leader")
    both = pairs.select(F.col("id_a").alias("leader"), F.col("id_b").alias("rep"), "sim").union(pairs.select(F.col("id_b").alias("leader"), F.col("id_a").alias("rep"), "sim"))
    near = both.join(lead, "leader").union(lead.select("leader", F.col("leader").alias("rep"), F.lit(1.0).alias("sim")))
    # ... but a later copy may find a better leader than its class's first row did: each row takes the best that comes before it
    best = F.min(F.struct((-F.col("sim")).alias("s"), "leader"))
    led = members.join(near, "rep").where(F.col("leader") <= F.col("id")).groupBy("id").agg(best.alias("r"))
    led = materialize(led.select("id", "r.leader", (-F.col("r.s")).alias("sim")), "led")
    size = led.groupBy("leader").agg(F.count("*").alias("n"))
    ids = segment.numbered(size, "leader", name="g").select("leader", F.when(F.col("n") > 1, F.concat(F.lit(prefix), F.lpad(F.col("g").cast("string"), digits, "0"))).otherwise("").alias("near_group"))
    return led.join(ids, "leader").select("id", "leader", F.round("sim", 6).alias("sim"), "near_group")


def vector_pairs(df: DataFrame, id_col: str, block: str, vector: str, least: float, lost: float = 1e-4, seed: int = 42) -> DataFrame:
    """(id_a, id_b, sim): pairs of unit vectors within a block with cosine >= least.

    Random hyperplanes cut every vector into bands of sign bits; vectors that share a band are compared exactly. Bits and bands follow
    from the threshold: two vectors at the angle of the threshold agree in a bit with probability p = 1 - angle / pi; a quarter
    of their bands agree, and there are enough bands to lose a pair there with probability `lost` only. Work grows with the vectors
    that are near each other and, by p^bits, with the square of a block; low thresholds leave few bits and compare nearly everything.
    Null ids, blocks and vectors take part in nothing; repeated ids give their pairs once.
    """
    if not 0 < least < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    x = df.where(F.col(id_col).isNotNull() & F.col(block).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).alias("id"), F.col(block).alias("k"), F.col(vector).alias("v"))
    p = 1 - math.acos(least) / math.pi
    bits = max(1, round(math.log(0.25) / math.log(p)))
    bands = math.ceil(math.log(lost) / math.log1p(-(p**bits)))
    kind = x.schema["id"].dataType

    def run(batches):
        planes = None
        for batch in batches:
            v = batch.column(2)
            size = len(v[0]) if len(v) else 0
            m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) if size else np.zeros((0, 1))
            if planes is None or planes.shape[0] != m.shape[1]:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], bits * bands))
            signs = (m @ planes > 0).reshape(len(m), bands, bits)
            key = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) + (np.arange(bands, dtype=np.int64) << bits)
            at = pa.array(np.repeat(np.arange(len(m)), bands))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key.ravel())], ["id", "k", "band"])

    schema = T_.StructType([T_.StructField("id", kind), T_.StructField("k", x.schema["k"].dataType), T_.StructField("band", T_.LongType())])
    keys = x.mapInArrow(run, schema)
    met = keys.select(F.col("id").alias("id_a"), "k", "band").join(keys.select(F.col("id").alias("id_b"), "k", "band"), ["k", "band"]).where("id_a < id_b").select("k", "id_a", "id_b").distinct()
    va, vb = x.select("k", F.col("id").alias("id_a"), F.col("v").alias("va")), x.select("k", F.col("id").alias("id_b"), F.col("v").alias("vb"))
    sim = computed_once(met.join(va, ["k", "id_a"]).join(vb, ["k", "id_b"]), sim=cosine(F.col("va"), F.col("vb")))
    return sim.where(F.col("sim") >= least).select("id_a", "id_b", "sim").distinct()


def merge_entries(df: DataFrame, keys: list[Column], ids: str, *order: str) -> DataFrame:
    """Rows equal in all keys become one: the first row, the sorted union of their id arrays, their number. The union grows with the
    group: where groups have no bound, take entry_classes() and entry_ids()."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    rest = [c for c in df.columns if c != ids]
    g = df.select(*df.columns, *named).groupBy(*[f"_k{i}" for i in range(len(keys))])
    out = g.agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))).alias(ids), F.count("*").alias("n_merged"))
    return out.select(*[F.col(f"r.{c}").alias(c) for c in rest], ids, "n_merged")


def entry_classes(df: DataFrame, keys: list[Column], id_col: str) -> tuple[DataFrame, DataFrame]:
    """classes(representative, n_members) and members(id, representative) of rows equal in all keys; the representative is the
    smallest id. One row for each class and one for each id, whatever the size of a class; null keys are equal, null ids left out."""
    x = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})).alias("_k")).distinct()
    classes = materialize(x.groupBy("_k").agg(F.min("id").alias("representative"), F.count("*").alias("n_members")), "classes")
    return classes.drop("_k"), x.join(classes.select("_k", "representative"), "_k").select("id", "representative")


def entry_ids(members: DataFrame, df: DataFrame, id_col: str, ids: str) -> DataFrame:
    """(representative, cited): the distinct ids that the members of each class cite, one row for each."""
    cited = df.select(F.col(id_col).alias("id"), F.explode(ids).alias("cited"))
    return members.join(cited, "id").select("representative", "cited").distinct()


def distinct_entries(entries: DataFrame, id_col: str, ids: str, category: str, text: str, num: int = 85, den: int = 100) -> DataFrame:
    """(clause_id, id): of the entries that cite one clause, every category keeps those that aren't near-duplicates (by Jaccard)
    of an entry kept before, in id order."""
    one = entries.select(F.explode(F.array_distinct(ids)).alias("clause_id"), F.col(id_col).alias("_e"), F.col(category).alias("_c"), T.tokens(F.col(text)).alias("_tok"))
    one = one.withColumn("_id", F.concat_ws("\u0001", "clause_id", "_c", "_e")).withColumn("_b", F.concat_ws("\u0001", "clause_id", "_c"))
    members, pairs = similar(one, "_id", "_tok", num, den, "_b")
    kept = leaders(members.select(F.col("rep").alias("id")).distinct(), pairs.select("id_a", "id_b", F.lit(1.0).alias("sim"))).where("id = leader").select(F.split("id", "\u0001").alias("k"))
    return kept.select(F.get("k", F.lit(0)).alias("clause_id"), F.get("k", F.lit(2)).alias("id"))


def tfidf_pairs(weights: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, sim) from (id, term, weight) with unit norm and no negative weight: cosine, at least `least`.

    Prefix filter: with rare terms first, a record's terms are cut off where the norm of the rest falls
    below the threshold; a pair that reaches it shares a term before the cut, since the rest can't bring more than its
    norm. Only these terms are joined, and every candidate is then computed over all terms."""
    if not 0 < least <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    weights = materialize(weights.select("id", "term", "weight"), "weights")
    seen = materialize(weights.groupBy("term").agg(F.count("*").alias("f")), "frequencies")
    rest = Window.partitionBy("id").orderBy(F.col("f").desc(), F.col("term").desc()).rowsBetween(Window.unboundedPreceding, 0)
    head = weights.join(seen, "term").withColumn("_rest", F.sum(F.col("weight") * F.col("weight")).over(rest))
    head = head.where(F.col("_rest") >= least * least * (1 - 1e-9)).select("id", "term")
    met = head.select(F.col("id").alias("id_a"), "term").join(head.select(F.col("id").alias("id_b"), "term"), "term").where("id_a < id_b").select("id_a", "id_b").distinct()
    bags = weights.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("bag"))  # as large as one record
    x = met.join(bags.select(F.col("id").alias("id_a"), F.col("bag").alias("ba")), "id_a").join(bags.select(F.col("id").alias("id_b"), F.col("bag").alias("bb")), "id_b")
    dot = F.aggregate(F.map_entries("ba"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("bb"), e["key"]), F.lit(0.0)))
    return computed_once(x, sim=dot).where(F.col("sim") >= least).select("id_a", "id_b", "sim")
