"""Problems 1, 2, 3 and 6 against brute force on small tables with awkward rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import copies, forest, neardup, overlap, setjoin, splits

VOCAB = [f"w{i}" for i in range(400)]


def word_list(t):
    return re.findall("[a-z0-9]+", (t or "").lower().replace("\xad", "").replace("​", ""))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [w[i], rng.choice(VOCAB)], [rng.choice(VOCAB)]])
    return " ".join(w)


@pytest.fixture(scope="module")
def records():
    """Texts with near-copies, a text that a third of the rows share, short, empty, null and wordless texts, repeated rows."""
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        base = " ".join(rng.choice(VOCAB) for _ in range(rng.choice([6, 9, 14, 20, 40, 80])))
        rows.append(base)
        for _ in range(rng.randrange(3)):
            s = edited(rng, base, rng.randrange(0, max(2, len(base.split()) // 9)))
            parts = s.split()
            cut = rng.randrange(len(parts) + 1)
            rows.append(" ".join(parts[cut:] + parts[:cut]))
    hot = " ".join(VOCAB[:30])
    rows += [random.Random(i).choice([hot, hot.upper(), hot.replace(" ", ",  ")]) for i in range(50)]
    rows += [None, "", "...", "­​", "One", "one", "a b", "a b c", "x" * 50_000, hot + " " + "y" * 10]
    rng.shuffle(rows)
    table = [(f"S{i:04d}", f"App {i % 7}", t) for i, t in enumerate(rows)]
    return table + table[:15]


def frame(spark, records):
    df = spark.createDataFrame(records, "clause_id string, app_name string, clause_text string")
    return df.withColumns({c: F.lit("clash") for c in ("id", "node", "w", "key", "a", "b", "text", "n", "root", "side")})


def similar(records):
    sets = {i: frozenset(word_list(t)) for i, _, t in records}
    ids = sorted(i for i, s in sets.items() if s)
    return [(x, y) for x, y in itertools.combinations(ids, 2) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])], ids


def assignments(spark, records):
    rng = random.Random(8)
    names = ["train", " Training ", "TEST", "val", "gold ", "Validation", None, "other"]
    rows = [(i, rng.choice(names), k) for i, _, _ in records for k in range(rng.choice([0, 1, 1, 2]))] + [("none", "train", 1), (None, "test", 1)]
    last = {}
    for i, s, k in sorted((r for r in rows if r[0] and r[1] and r[1] != "other"), key=lambda r: (r[2], r[1].strip().lower())):
        last[i] = "train" if s.strip().lower().startswith("train") else "eval"
    df = spark.createDataFrame(rows, "clause_id string, split_name string, k int")
    return df.withColumn("assigned_at", F.timestamp_seconds("k")), last


def test_overlap_equals_brute_force(spark, records):
    split, last = assignments(spark, records)
    pairs, _ = similar(records)
    want = {p for p in pairs if {last.get(p[0]), last.get(p[1])} == {"train", "eval"}}
    c = overlap.CrossSplit(frame(spark, records), split)
    got = [tuple(r) for r in c.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    n = {}
    for p in want:
        for x in p:
            if last[x] == "eval":
                n[x] = n.get(x, 0) + 1
    assert {r["id"]: r["n_links"] for r in c.records().collect()} == n
    rep = overlap.report(frame(spark, records), split)
    assert sum(r["n_overlapping"] for r in rep.collect()) == len(n)


@pytest.mark.parametrize(("n_a", "n_b", "both", "most"), [(5, 4, 4, 0), (5, 6, 5, 0), (7, 6, 6, 0), (12, 10, 10, 0), (14, 13, 12, 0), (15, 12, 12, 0.004), (30, 24, 24, 0.004), (31, 32, 28, 0.004), (36, 36, 32, 0.004), (45, 36, 36, 0.004), (80, 64, 64, 0.004), (120, 96, 96, 0.004), (13, 16, 13, 0.004), (20, 25, 20, 0.004)])
def test_pairs_at_the_threshold_share_a_key(n_a, n_b, both, most):
    rng, draws = np.random.default_rng(n_a), 2000
    words = [rng.integers(0, 2**32, n_a + n_b - both, dtype=np.uint32) for _ in range(draws)]
    sets = [np.sort(s) for w in words for s in (w[:n_a], np.r_[w[:both], w[n_a:]])]
    off = np.cumsum([0, *map(len, sets)])
    at, key, _, _ = overlap.chunk_keys(4, 5)(np.concatenate(sets), off, False)
    of = [set() for _ in sets]
    for i, k in zip(at.tolist(), key.tolist()):
        of[i].add(k)
    assert sum(not of[2 * i] & of[2 * i + 1] for i in range(draws)) <= most * draws


@pytest.mark.parametrize(("num", "den"), [(1, 2), (7, 10), (4, 5), (9, 10)])
def test_recall_at_other_thresholds(spark, num, den):
    """Planted pairs at (or just over) the threshold, every size from 4 to 90 words: at least 0.98 of them are found by both operators."""
    rng = random.Random(num)
    clauses, split, want = [], [], set()
    for k in range(400):
        both = rng.randrange(4, 90)
        extra = both * (den - num) // num
        left = rng.randrange(extra + 1)
        words = [f"v{k}x{i}" for i in range(both + extra)]
        a, b = words[: both + left], words[:both] + words[both + left :]
        if set(a) == set(b):
            continue
        clauses += [(f"E{k}", " ".join(a)), (f"T{k}", " ".join(b))]
        split += [(f"E{k}", "test", 1), (f"T{k}", "train", 1)]
        want.add((f"E{k}", f"T{k}"))
    c = spark.createDataFrame(clauses, "clause_id string, clause_text string").withColumn("app_name", F.lit("a"))
    s = spark.createDataFrame(split, "clause_id string, split_name string, k int").withColumn("assigned_at", F.timestamp_seconds("k"))
    got = {tuple(r) for r in overlap.CrossSplit(c, s, num, den).pairs().collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    linked = {r["id"] for r in neardup.groups(c, "clause_id", "clause_text", num, den).where("group_size > 1").collect()}
    assert len(linked) >= 0.98 * 2 * len(want)


def test_bands_follow_from_threshold_and_size():
    assert neardup.shape(4, 5) == (7, 28) and setjoin.mismatches(4, 5) == 27
    for n, rows in ((0, 7), (1000, 7), (400_000_000, 7), (400_000_001, 8), (6_000_000_000, 9)):
        assert neardup.rows_at(n, 4, 5) == rows
    for num, den in ((1, 2), (7, 10), (4, 5), (9, 10)):
        for more in range(4):
            r, b = neardup.shape(num, den, neardup.shape(num, den)[0] + more)
            assert 1 - (1 - (num / den) ** r) ** b >= 0.998
    for num, den in ((0, 1), (1, 1), (3, 2)):
        with pytest.raises(ValueError):
            neardup.shape(num, den)


def test_words_of_a_node_stand_once(spark):
    """A text that half of the rows share is held once, and its other rows are spread by their ids."""
    rows = [(f"S{i:05d}", "one two three four" if i % 2 else f"a{i} b{i} c{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "clause_id string, clause_text string").repartition(16)
    sets = setjoin.nodes_of(df, "clause_id", "clause_text")
    assert sets.count() == 4000 and sets.where("w is not null").count() == 2001
    assert sets.where("w is not null").select("node").distinct().count() == 2001


def test_join_of_a_hot_key_is_split(spark):
    """Half of the records share one chunk: adaptive execution splits the join, for both of its sides are plain exchanges."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "4000000", "spark.sql.files.maxPartitionBytes": "4000000", "spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in conf}
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(f"S{i:05d}", f"{common} x{i} y{i} z{i} u{i} v{i}" if i % 2 else " ".join(f"q{i}w{j}" for j in range(20))) for i in range(1200)]
    df = spark.createDataFrame(rows, "clause_id string, clause_text string").repartition(8)
    plans = []
    kept = setjoin.materialize
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        setjoin.materialize = lambda d, name="stage": (d.collect() if name == "pairs" else None, plans.append(d._jdf.queryExecution().executedPlan().toString()) if name == "pairs" else None, kept(d, name))[2]
        n = setjoin.candidates(setjoin.nodes_of(df, "clause_id", "clause_text"), neardup.band_keys(7, 28), 60).count()
    finally:
        setjoin.materialize = kept
        for k, v in old.items():
            spark.conf.set(k, v)



def test_groups_equal_brute_force(spark, records):
    pairs, ids = similar(records)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in pairs:
        a, b = sorted((find(x), find(y)))
        parent[b] = a
    got = neardup.groups(frame(spark, records), "clause_id", "clause_text").collect()
    assert {r["id"]: r["group_id"] for r in got} == {i: find(i) for i in ids} and len(got) == len(ids)


def test_empty_tables(spark, records):
    none = frame(spark, records).limit(0)
    split, _ = assignments(spark, records)
    assert neardup.groups(none, "clause_id", "clause_text").count() == 0
    assert overlap.CrossSplit(none, split).pairs().count() == 0
    assert overlap.CrossSplit(frame(spark, records), split.limit(0)).pairs().count() == 0
    assert splits.assign(none.withColumn("source_document", F.lit("x")), "clause_id", "app_name", "source_document").count() == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="clause_text"):
        overlap.CrossSplit(spark.createDataFrame([("1",)], "clause_id string"), spark.createDataFrame([("1", "x", 1)], "clause_id string, split_name string, assigned_at int"))


def test_sketch_estimates_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**32, 300, dtype=np.uint32)
    a, b = u[:270], u[30:]
    r = setjoin.registers(np.concatenate([a, b]), np.array([0, 270, 540]), 2000)
    assert abs((r[0] == r[1]).mean() - 240 / 300) < 0.04
    p, q = setjoin.payload(r)
    off = bin((int(p[0]) ^ int(p[1])) & (2**64 - 1)).count("1") + bin((int(q[0]) ^ int(q[1])) & (2**64 - 1)).count("1")
    assert abs(1 - 2 * off / 128 - 0.8) < 0.3


def canonical(t):
    cells = [c for c in re.split(r"[|\t\n\r]", t) if c.strip()]
    flat = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    if len(cells) >= 3 and all(re.fullmatch(r"(?s)\s*[^:]*[A-Za-z0-9][^:]*:\s*\S.*", c) for c in cells):
        return "C" + "|".join(sorted(map(flat, cells)))
    return "T" + flat(t)


COPIES = [
    ("1", "App", "Hello, World"), ("2", "app ", "hello world!"), ("3", "APP", "hel lo world"), ("4", "Other", "hello world"), ("5", None, "hello world"),
    ("6", "App", None), ("7", "App", ""), ("8", "App", "..."), ("9", "App", "A: x | B: y | C: z"), ("10", "App", "B: Y\nC: z\nA: x"), ("11", "App", "A: x | B: y"),
    ("12", "App", "B: y | A: x"), ("13", "App", "x: a | b | C: z"), ("1", "App", "Hello, World"), ("14", "App", "C: z\tA: x\tB:y"), ("15", "App", "z" * 100_000), ("16", "App", "Z" * 100_000),
]


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_ledger_counts_batches_like_one_load(spark, tmp_path, parts):
    ledger = copies.CopyLedger(spark, f"file://{tmp_path}/ledger", buckets=4)
    for k in range(parts):
        batch = spark.createDataFrame([(*r, "clash", "clash") for r in COPIES[k::parts]], "clause_id string, app_name string, clause_text string, id string, key string")
        ledger.update(copies.keyed(batch, "clause_text", "app_name", "clause_id", 4))
    again = spark.createDataFrame(COPIES[:5], "clause_id string, app_name string, clause_text string")
    ledger.update(copies.keyed(again, "clause_text", "app_name", "clause_id", 4))
    ledger.update(copies.keyed(again.limit(0), "clause_text", "app_name", "clause_id", 4))
    groups = {}
    for i, a, t in COPIES:
        if a is not None and t and re.search("[a-z0-9]", t.lower()):
            groups.setdefault((a.strip().lower(), canonical(t)), set()).add(i)
    assert sorted((r["keep_id"], r["n_copies"]) for r in ledger.counts().collect()) == sorted((min(g), len(g)) for g in groups.values())
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in copies.copy_pairs(ledger).collect()} == want


def test_ledger_goes_on_after_a_failure(spark, tmp_path):
    """Opened again it continues; an update that fails in the middle leaves the last version; old folders are removed."""
    folder, rows = f"file://{tmp_path}/ledger", [(f"S{i:03d}", "App", f"text {i % 7}") for i in range(60)]
    batch = lambda lo, hi: copies.keyed(spark.createDataFrame(rows[lo:hi], "clause_id string, app_name string, clause_text string"), "clause_text", "app_name", "clause_id", 4)
    state = lambda: sorted((r["keep_id"], r["n_copies"]) for r in copies.CopyLedger(spark, folder, 4).counts().collect())
    want = lambda n: sorted((f"S{k:03d}", len(range(k, n, 7))) for k in range(7))
    copies.CopyLedger(spark, folder, 4).update(batch(0, 20))
    assert state() == want(20)
    broken = copies.CopyLedger(spark, folder, 4)
    broken._commit = lambda changed: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.update(batch(20, 40))
    assert state() == want(20)
    first, second = copies.CopyLedger(spark, folder, 4, most_parts=2), copies.CopyLedger(spark, folder, 4)
    first.update(batch(10, 40))
    with pytest.raises(RuntimeError):  # opened before the other's update
        second.update(batch(40, 60))
    assert state() == want(40)
    first.update(batch(40, 60))
    assert state() == want(60) and copies.copy_pairs(copies.CopyLedger(spark, folder, 4)).count() == 53
    held = {p for s in (first.state,) for parts in s["members"].values() for p in parts}
    assert len(held) < 3 and len(list((tmp_path / "ledger" / "counts").iterdir())) <= 2
    with pytest.raises(ValueError):
        copies.CopyLedger(spark, folder, 8)


@pytest.mark.parametrize("limit", [1_000_000, 40, 3])
def test_components_at_every_size(spark, limit):
    rng = random.Random(limit)
    edges = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(150)]
    edges += [("hub", f"h{i:03d}") for i in range(120)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("a", "a"), ("n001", None), (None, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x and y and x != y:
            a, b = sorted((find(x), find(y)))
            parent[b] = a
    got = forest.components(spark.createDataFrame(edges, "a string, b string").repartition(5), limit=limit).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(2)
    rows = [(f"c{i:05d}", rng.choice([None, "", *[f"App {k}" for k in range(300)]]), rng.choice([None, *[f"doc-{k}" for k in range(1500)]])) for i in range(3000)]
    rows += [(f"h{i:05d}", "Big", f"big {i % 3}") for i in range(1000)] + rows[:50]
    df = spark.createDataFrame(rows, "clause_id string, app_name string, source_document string").withColumns({c: F.lit("x") for c in ("a", "d", "node", "root", "size", "id")})
    got = {r["id"]: r for r in splits.assign(df, "clause_id", "app_name", "source_document").collect()}
    assert len(got) == 4000
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower()) if s else None
    for col in (1, 2):
        seen = {}
        for r in rows:
            if key(r[col]):
                assert seen.setdefault(key(r[col]), got[r[0]]["split"]) == got[r[0]]["split"]
    assert len({r["group_id"] for r in got.values() if r["split"] == "train"} & {r["group_id"] for r in got.values() if r["split"] != "train"}) == 0
    alone = spark.createDataFrame([(str(i), f"a{i}", f"d{i}") for i in range(2000)], "clause_id string, app_name string, source_document string")
    share = {r["split"]: r["count"] for r in splits.assign(alone, "clause_id", "app_name", "source_document").groupBy("split").count().collect()}
    assert share == {"train": 1400, "validation": 300, "test": 300}


def test_greedy_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [(s, rng.randrange(1, 60)) for s in sorted(rng.sample(range(1, 200), rng.randrange(1, 6)))]
        total = sum(s * n for s, n in sizes)
        short = {k: v * total for k, v in splits.TARGETS.items()}
        want = {}
        for s, n in sorted(sizes, reverse=True):
            for _ in range(n):
                k = max(short, key=lambda x: short[x])
                short[k] -= s
                want[s, k] = want.get((s, k), 0) + 1
        got = {(s, k): n for s, parts in splits.greedy(sizes).items() for k, n in parts}
        assert sum(s * n for (s, _), n in got.items()) == total
        for k in splits.TARGETS:  # ties may fall otherwise, but no split ends further off than one item
            a, b = (sum(s * n for (s, j), n in x.items() if j == k) for x in (got, want))
            assert abs(a - b) <= max(s for s, _ in sizes)


def test_related_pairs(spark):
    rows = [("A", "d1"), ("B", "D-1"), ("B", "d2"), ("C", "d2"), ("D", "d9"), (None, "d9"), (None, "d1"), ("E", None), ("a ", "d7")]
    df = spark.createDataFrame(rows, "app_name string, source_document string")
    assert {tuple(r) for r in splits.related_pairs(df, "app_name", "source_document").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
