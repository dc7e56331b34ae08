"""Set similarity over distinct words: what problems 1 and 6 share.

Records become sorted arrays of 32-bit word hashes; records with the same set of words share one *node* (a 64-bit digest
of the set), so copies are handled once. A caller's ``keys`` function turns sets into bucket keys (bands of sketch registers,
content-defined chunks); pairs of nodes that share a key are candidates, and every candidate is verified on the sets.

Most keys occur once and can't make a pair. A first pass therefore marks, in a bitmap of 2^27 slots (16 MB, whatever the
input), the slots that at least two keys fall into (or a key of either side, where only pairs across two sides count); the
second pass ships only keys in such slots. Where the bitmap fills up, more keys are shipped, none fewer. A key's rows carry 128
one-bit registers of a HyperMinHash sketch, and a pair is dropped inside the join if its collision-corrected estimate lies more
than four deviations under the threshold; how many bits may differ follows from the threshold.

Each node's words stand in exactly one row of the sets, so keys need no deduplication: both sides of the join are plain exchanges,
which adaptive execution splits where a key is hot. Copies of a node go to the reducer of their own ids, not to their node's.

Cases: null texts and texts without words have no node and take part in nothing; an empty table gives empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import computed_once, words
from lexweave.session import materialize

SLOT_BITS, BLOCK_BITS = 27, 16
PAYLOAD = 128  # one-bit registers that each row carries
ROWS_AT_ONCE = 50_000  # sets whose keys are worked out together


def word_set(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of the text's words."""
    return F.sort_array(F.array_distinct(F.transform(words(text), lambda w: F.hash(w))))


def mismatches(num: int, den: int) -> int:
    """How many of the one-bit registers of two sets of similarity num/den may differ: the mean and four deviations (27 at 0.8)."""
    q = (1 - num / den) / 2
    return math.ceil(PAYLOAD * q + 4 * math.sqrt(PAYLOAD * q * (1 - q)))


def _first_of_node(batches):
    """Takes the words from every row whose node this task has had before."""
    seen: set = set()
    for batch in batches:
        at = []
        for i, (x, held) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).is_valid().to_pylist())):
            at.append(i if held and x not in seen else None)
            if held:
                seen.add(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).take(pa.array(at, pa.int64()))], ["id", "node", "w"])


def nodes_of(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, node, w), one row for each input row whose text has words; w stands in one row of each node and is null in the
    others. Written to the shared folder."""
    kind = "id string, node bigint, w array<int>"
    out = df.select(F.col(id_col).cast("string").alias("id"), F.explode(F.array(word_set(F.col(text)))).alias("w"))
    out = out.where("id is not null and size(w) > 0").select("id", F.xxhash64("w").alias("node"), "w")
    moved = out.mapInArrow(_first_of_node, kind).repartition(F.col("node"), F.when(F.col("w").isNull(), F.xxhash64("id")))
    return materialize(moved.mapInArrow(_first_of_node, kind), "sets")


def in_blocks(batches, rows: int = ROWS_AT_ONCE):
    """Batches joined until they have the given number of rows: small arrays cost more than they should."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def flat_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node ids, flat uint32 words, start offsets)."""
    w = batch.column(1)
    off = w.offsets.to_numpy()
    flat = w.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint32)
    return batch.column(0).to_numpy(zero_copy_only=False), flat, (off - off[0]).astype(np.int64)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def registers(flat: np.ndarray, off: np.ndarray, count: int, first: int = 0) -> np.ndarray:
    """HyperMinHash registers [record, count]: of the least hash under each function, the exponent (leading zeros) and the
    ten bits that follow the leading one. Both stand side by side in the float32 form of an integer."""
    rng = np.random.default_rng(20240101)
    a = rng.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, 4096, dtype=np.uint32)
    n = np.diff(off)
    out = np.empty((len(n), count), np.uint32)
    order = np.argsort(n, kind="stable")
    for at in range(0, len(order), 256):  # records of like length side by side; the last word is repeated to fill up
        some = order[at : at + 256]
        steps = np.arange(n[some].max())[:, None]
        block = flat[off[:-1][some] + np.minimum(steps, n[some] - 1)]
        h = np.empty_like(block)
        for j in range(count):
            np.bitwise_xor(block, b[first + j], out=h)
            np.multiply(h, a[first + j], out=h)
            out[some, j] = h.min(axis=0).astype(np.float32).view(np.uint32) >> np.uint32(13)
    return out


def payload(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest mantissa bit of the first 128 registers, as two int64."""
    bits = np.packbits((regs[:, :PAYLOAD] & 1).astype(np.uint8), axis=1)
    both = np.ascontiguousarray(bits).view(np.int64)
    return both[:, 0], both[:, 1]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 7) >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def _slot_rows(slots: np.ndarray):
    slots = np.sort(slots)
    block = slots >> np.uint32(BLOCK_BITS)
    at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    lows = (slots & np.uint32((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes()
    ends = np.r_[at[1:], len(slots)]
    return pa.RecordBatch.from_arrays(
        [pa.array(block[at].astype(np.int32)), pa.array([lows[2 * i : 2 * j] for i, j in zip(at, ends)], pa.binary())],
        ["block", "lows"],
    )


def _marks(least: int):
    def run(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        n = 1 << BLOCK_BITS
        for batch in batches:
            for block, lows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block not in once:
                    once[block], twice[block] = np.zeros(n, bool), np.zeros(n, bool)
                low = np.frombuffer(lows, np.uint16)  # sorted
                twice[block][low[1:][low[1:] == low[:-1]]] = True
                twice[block][low[once[block][low]]] = True
                once[block][low] = True
        for block in once:
            bits = np.packbits((twice if least > 1 else once)[block]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

    return run


def slot_bitmap(df: DataFrame, emit, least: int, planes: int = 1) -> np.ndarray:
    """Bitmaps [planes, bytes] of the slots in which at least `least` (1 or 2) of the emitted keys fall; 16 MB each at most.

    emit(batch) -> (keys, plane of each key, or None for plane 0).
    """

    def run(batches):
        for batch in in_blocks(batches):
            keys, plane = emit(batch)
            if len(keys):
                slots = _slots(keys)
                yield _slot_rows(slots if plane is None else slots | plane.astype(np.uint32) << np.uint32(SLOT_BITS))

    rows = df.mapInArrow(run, "block int, lows binary").repartition("block")
    bits = np.zeros(planes * (1 << SLOT_BITS) // 8, np.uint8)
    size = (1 << BLOCK_BITS) // 8
    for block, part in rows.mapInArrow(_marks(least), "block int, bits binary").toLocalIterator():
        bits[block * size : (block + 1) * size] |= np.frombuffer(bytes(part), np.uint8)
    return bits.reshape(planes, -1)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = _slots(keys)
    return (bits[s >> np.uint32(3)] >> (np.uint8(7) - (s & np.uint32(7)).astype(np.uint8))) & 1 == 1


def node_slots(df: DataFrame, planes: int = 1) -> np.ndarray:
    """Bitmaps of the slots of df's nodes (first column); with two planes, the second column says which."""

    def emit(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return keys, batch.column(1).to_numpy(zero_copy_only=False) if planes > 1 else None

    return slot_bitmap(df, emit, 1, planes)


def candidates(sets: DataFrame, keys, most_off: int, sides: DataFrame | None = None) -> DataFrame:
    """(a, b, shared_a, shared_b): pairs of nodes that share a key, with the sums of the shared keys' lengths; materialised.

    keys(flat, off, with_payload) -> (row index, uint64 key, length, 128-bit payload of every record as two int64 arrays).
    Without sides, pairs have a < b. With sides(node, side 0 or 1), a is of side 1 and b of side 0, a <> b; the sides of nodes
    are known by slot, so that where slots are shared a node may be taken for both: the caller checks the sides of what it keeps.
    """
    spark = sets.sparkSession
    source = sets.where("w is not null").select("node", "w")
    known = spark.sparkContext.broadcast([x.tobytes() for x in node_slots(sides.select("node", "side"), 2)]) if sides else None

    def of_sides(node):
        return [marked(np.frombuffer(x, np.uint8), node.view(np.uint64)) for x in known.value]

    def only_keys(batch):
        node, flat, off = flat_sets(batch)
        at, key = keys(flat, off, False)[:2]
        if not known:
            return key, None
        each = [s[at] for s in of_sides(node)]
        return np.concatenate([key[s] for s in each]), np.repeat(np.arange(2), [s.sum() for s in each])

    bits = slot_bitmap(source, only_keys, 1 if sides else 2, 2 if sides else 1)
    marks = spark.sparkContext.broadcast((bits[0] & bits[-1]).tobytes())

    def rows(batches):
        slots = np.frombuffer(marks.value, np.uint8)
        for batch in in_blocks(batches):
            node, flat, off = flat_sets(batch)
            at, key, length, (p, q) = keys(flat, off, True)
            keep = marked(slots, key)
            side = np.full(len(node), 3, np.int8)
            if known:
                zero, one = of_sides(node)
                side = zero + 2 * one.astype(np.int8)
                keep &= side[at] > 0
            at = at[keep]
            cols = (key[keep].view(np.int64), node[at], p[at], q[at], length[keep].astype(np.int32), side[at].astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "node", "p", "q", "len", "side"])

    kept = source.mapInArrow(rows, "key bigint, node bigint, p bigint, q bigint, len int, side tinyint")
    x = kept.select("key", F.col("node").alias("a"), F.col("p").alias("pa"), F.col("q").alias("qa"), F.col("len").alias("len_a"), F.col("side").alias("sa"))
    y = kept.select("key", F.col("node").alias("b"), F.col("p").alias("pb"), F.col("q").alias("qb"), F.col("len").alias("len_b"), F.col("side").alias("sb"))
    off = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count(F.col("qa").bitwiseXOR(F.col("qb")))
    # one condition on both sides: filters of one side alone would make two exchanges, and have the keys worked out twice
    paired = (F.col("a") != F.col("b")) & (F.col("sa").bitwiseAND(F.lit(2)) + F.col("sb").bitwiseAND(F.lit(1)) == 3) if sides else F.col("a") < F.col("b")
    near = x.hint("merge").join(y, "key").where(paired & (off <= most_off))
    return materialize(near.groupBy("a", "b").agg(F.sum("len_a").alias("shared_a"), F.sum("len_b").alias("shared_b")), "pairs")


def verified(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs(a, b, ...), those whose sets have |A and B| / |A or B| >= num/den, with n_a, n_b and both; materialised."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    marks = sets.sparkSession.sparkContext.broadcast(node_slots(ends)[0].tobytes())

    def involved(batches):
        bits = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(marked(bits, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    some = sets.where("w is not null").select("node", "w").mapInArrow(involved, "node bigint, w array<int>")
    met = pairs.join(some.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a").join(some.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b")
    both = computed_once(met, both=F.size(F.array_intersect("wa", "wb"))).withColumn("n_a", F.size("wa")).withColumn("n_b", F.size("wb")).drop("wa", "wb")
    return materialize(both.where(F.col("both") * den >= (F.col("n_a") + F.col("n_b") - F.col("both")) * num), "links")
