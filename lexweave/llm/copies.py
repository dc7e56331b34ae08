"""Problem 2: duplicates hidden by formatting differences, kept in an incremental ledger.

A record's canonical key is its lower-cased run of a-z0-9; a text that consists only of three or more cells
``Label: value`` is keyed by the bag of its cells. The ledger holds, in hash buckets, one row for each key
(number of distinct ids, smallest id) and one row for each (key, id) already counted. A new batch is aggregated
first, and only the buckets it touches are read and full-outer-joined; all other buckets' files are taken over by the next
version's manifest. A ledger outlives its Python object: opened again on its folder, it goes on where it was.

Cases: null or empty texts and texts without a-z0-9 have no key and are left out; so are rows whose owner is null.
Repeated rows and ids delivered again in a later batch count once. An empty batch leaves the ledger as it is.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.keys import alnum, name_key, reject_missing
from lexweave.session import materialize

CELL = r"(?s)^\s*[^:]*[A-Za-z0-9][^:]*:\s*\S.*$"
CELL_BREAK = r"[|\t\n\r]"
MIN_CELLS = 3


def canonical(text: Column) -> Column:
    """'' for texts without a-z0-9, else the canonical form ('T' and 'C' keep plain and cell forms apart)."""
    cells = F.filter(F.split(text, CELL_BREAK), lambda x: F.trim(x) != "")
    colons = F.length(text) - F.length(F.translate(text, ":", ""))
    is_table = (colons >= MIN_CELLS) & (F.size(cells) >= MIN_CELLS) & F.forall(cells, lambda x: x.rlike(CELL))
    table = F.concat(F.lit("C"), F.array_join(F.array_sort(F.transform(cells, alnum)), "|"))
    return F.when(is_table, table).otherwise(F.regexp_replace(F.concat(F.lit("T"), alnum(text)), "^T$", ""))


def keyed(df: DataFrame, text: str, owner: str | None, id_col: str, buckets: int) -> DataFrame:
    """(bucket, key, id): key is a 128-bit digest of owner key and canonical text; distinct."""
    reject_missing(df, text, id_col, *([owner] if owner else []))
    own = name_key(F.col(owner)) if owner else F.lit("")
    # the generator keeps the optimizer from working out the form once for the filter and again for the digest
    form = F.explode(F.array(F.struct(own.alias("own"), canonical(F.col(text)).alias("form"))))
    return (
        df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("id"), form.alias("k"))
        .where("k.own is not null and k.form <> ''")
        .select(F.unhex(F.md5(F.concat_ws("\x1f", "k.own", "k.form"))).alias("key"), "id")
        .select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "id")
        .distinct()
    )


class CopyLedger:
    """Bucketed counts of canonical keys under one folder; update() folds in a batch, counts() reads the state.

    A ledger opened on a folder goes on from the newest manifest there. A manifest names, for every bucket, the folder that holds its
    counts and the folders that hold its members: members are only added to, counts are written anew for the buckets a batch
    touches. A manifest comes into force by one rename after all its files are complete, so an update that fails at any point
    leaves the last version as it is, and what it had written is never read; the folder's counts that no manifest needs any more are
    removed after the next update. Where a bucket's members lie in more than `most_parts` folders, they are put together. One writer
    at a time: of two, the second's rename fails and its update counts for nothing.
    """

    COUNTS = "key binary, n_copies bigint, keep_id string"
    MEMBERS = "key binary, id string"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, most_parts: int = 16):
        self.spark, self.folder, self.buckets, self.most_parts = spark, folder.rstrip("/"), buckets, most_parts
        self.state: dict = {"version": 0, "buckets": buckets, "counts": {}, "members": {}}  # at most `buckets` entries each
        root = self._path("")
        names = [f.getPath().getName() for f in self._fs().listStatus(root)] if self._fs().exists(root) else []
        versions = [int(m.group(1)) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in names) if m]
        if versions:
            self.state = json.loads(spark.read.text(f"{self.folder}/manifest-{max(versions)}.json", wholetext=True).first()[0])
            if self.state["buckets"] != buckets:
                raise ValueError(f"the ledger has {self.state['buckets']} buckets")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _read(self, kind: str, schema: str, only: list[int]) -> DataFrame:
        held = self.state[kind]
        by_part: dict[str, list[str]] = {}
        for b in only:
            for part in held.get(str(b), []):
                by_part.setdefault(part, []).append(f"{self.folder}/{kind}/{part}/bucket={b}")
        out = self.spark.createDataFrame([], f"{schema}, bucket int") if not by_part else None
        for part, paths in by_part.items():
            read = self.spark.read.option("basePath", f"{self.folder}/{kind}/{part}").schema(f"{schema}, bucket int").parquet(*paths)
            out = read if out is None else out.unionByName(read)
        return out

    def counts(self) -> DataFrame:
        return self._read("counts", self.COUNTS, list(range(self.buckets)))

    def members(self) -> DataFrame:
        return self._read("members", self.MEMBERS, list(range(self.buckets)))

    def _write(self, df: DataFrame, kind: str, part: str) -> DataFrame:
        # rebalanced, not repartitioned: a bucket with many rows is split over several tasks and files
        df.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/{kind}/{part}")
        return self.spark.read.schema(f"{getattr(self, kind.upper())}, bucket int").parquet(f"{self.folder}/{kind}/{part}")

    def update(self, batch: DataFrame) -> None:
        """batch: (bucket, key, id) from keyed(). Reads the buckets that the batch touches, adds to their members, rewrites their counts."""
        batch = materialize(batch, "batch")
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most self.buckets numbers
        if not touched:
            return
        part = f"v{self.state['version'] + 1}-{uuid.uuid4().hex}"
        known = self._read("members", self.MEMBERS, touched)
        fresh = self._write(batch.join(known, ["bucket", "key", "id"], "left_anti"), "members", part)
        added = fresh.groupBy("bucket", "key").agg(F.count("*").alias("add_n"), F.min("id").alias("add_id"))
        old = self._read("counts", self.COUNTS, touched)
        merged = old.join(added, ["bucket", "key"], "full_outer").select(
            "bucket",
            "key",
            (F.coalesce("n_copies", F.lit(0)) + F.coalesce("add_n", F.lit(0))).alias("n_copies"),
            F.least("keep_id", "add_id").alias("keep_id"),
        )
        self._write(merged, "counts", part)
        grown = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most self.buckets numbers
        members = self.state["members"] | {str(b): [*self.state["members"].get(str(b), []), part] for b in grown}
        self._commit({"counts": self.state["counts"] | {str(b): [part] for b in touched}, "members": members})
        many = [int(b) for b, parts in members.items() if len(parts) > self.most_parts]
        if many:
            part = f"v{self.state['version'] + 1}-{uuid.uuid4().hex}"
            self._write(self._read("members", self.MEMBERS, many), "members", part)
            self._commit({"members": members | {str(b): [part] for b in many}})

    def _commit(self, changed: dict) -> None:
        """Brings the next version into force; then removes folders of counts and members that only older versions but the last one name."""
        fs, v, last = self._fs(), self.state["version"] + 1, self.state
        state = last | changed | {"version": v}
        made, named = self._path(f".manifest-{v}-{uuid.uuid4().hex}"), self._path(f"manifest-{v}.json")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(named) or not fs.rename(made, named):
            fs.delete(made, False)
            raise RuntimeError(f"version {v} of the ledger was written by another update")
        self.state = state
        for kind in ("counts", "members"):
            kept = {part for s in (state, last) for parts in s[kind].values() for part in parts}
            for f in fs.listStatus(self._path(kind)):
                number = re.match(r"v(\d+)-", f.getPath().getName())
                if number and int(number.group(1)) < v and f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)


def batches_by_time(df: DataFrame, time_col: str, share: float = 0.5) -> list[DataFrame]:
    """Two batches in order of arrival, cut at a share of the time range; rows without a time come in the first."""
    lo, hi = df.agg(F.min(time_col), F.max(time_col)).first()
    if lo is None or lo == hi:
        return [df]
    cut = lo + (hi - lo) * share
    late = F.coalesce(F.col(time_col) > F.lit(cut), F.lit(False))
    return [df.where(~late), df.where(late)]


def copy_pairs(ledger: CopyLedger) -> DataFrame:
    """(keep_id, id): every id other than the smallest of its key."""
    many = ledger.counts().where("n_copies > 1").select("bucket", "key", "keep_id")
    return ledger.members().join(many, ["bucket", "key"]).where("id <> keep_id").select("keep_id", "id")

