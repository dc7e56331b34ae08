"""Problem 8: filling fixed-capacity containers with texts measured in tokens of a public tokenizer.

Documents are dealt at random (by a seeded hash of their id) into groups of about ``group_size``; each group is packed on its
own by first-fit decreasing, where a tournament tree over the bins' free space finds the first bin that fits in log(bins)
steps. Only a text above the capacity is divided: into full containers and one remainder, which is packed like any other item.

Cases: null and empty texts have 0 tokens and are placed too; rows with a null id are left out; of repeated ids the longest
text is placed; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import reject_missing
from lexweave.session import partitions_for

CAPACITY, GROUP = 2048, 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(df: DataFrame, id_col: str, text: str, vocabulary: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens). The vocabulary file (under 1 MB) is read once and broadcast, so executors need no copy of it."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens bigint")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item (same order as sizes); every size is at most the capacity."""
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [capacity] * (2 * width)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s, at = sizes[i], 1
        while at < width:
            at *= 2
            if tree[at] < s:
                at += 1
        out[i] = at - width
        tree[at] -= s
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return out


def pack(counts: DataFrame, rows: int, capacity: int = CAPACITY, group_size: int = GROUP, seed: int = 17) -> DataFrame:
    """counts(id, n_tokens) -> (container_id, id, piece_no, first_token, n_tokens), one row for each piece.

    rows: number of documents, from which the number of groups follows. container_id is group * 2^32 + bin.
    """
    groups = partitions_for(rows, group_size)
    kind = dict(counts.dtypes)["id"]
    dealt = counts.withColumn("grp", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)))

    def packed(group: int, ids: list, sizes: list):
        longest: dict = {}
        for d, n in zip(ids, sizes):
            longest[d] = max(n, longest.get(d, 0))
        whole, items = [], []
        for d in sorted(longest):
            n = longest[d]
            full, rest = divmod(n, capacity)
            if n > 0 and rest == 0:
                full, rest = full - 1, capacity
            whole += [(d, k, k * capacity, capacity) for k in range(full)]
            items.append((d, full, full * capacity, rest))
        bins = first_fit_decreasing([x[3] for x in items], capacity)
        used = max(bins, default=-1) + 1
        rows = [(group << 32 | b, *x) for b, x in zip(bins, items)] + [(group << 32 | (used + k), *x) for k, x in enumerate(whole)]
        types = (pa.int64(), kinds, pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["container_id", "id", "piece_no", "first_token", "n_tokens"]
        )

    kinds = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()

    def run(batches):
        at, ids, sizes = None, [], []
        for batch in batches:
            for g, d, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if g != at and ids:
                    yield packed(at, ids, sizes)
                    ids, sizes = [], []
                at = g
                ids.append(d)
                sizes.append(n)
        if ids:
            yield packed(at, ids, sizes)

    ready = dealt.select("grp", "id", "n_tokens").repartition("grp").sortWithinPartitions("grp")
    return ready.mapInArrow(run, f"container_id bigint, id {kind}, piece_no int, first_token bigint, n_tokens bigint")


def containers(df: DataFrame, id_col: str, text: str, vocabulary: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    reject_missing(df, id_col, text)
    return pack(token_counts(df, id_col, text, vocabulary), df.count(), capacity)


def usage(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens placed, share of the space that is used."""
    per = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_pieces"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.sum("n_pieces").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * capacity), 4).alias("fill"),
    )
