import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import curation, decisions, duplicates, routing, sampling, segment, taxonomy


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_repeated_lines(spark):
    page = lambda d, n, t: (d, n, t)
    data = [page("two", n, "Head\nx%d" % n) for n in range(2)]
    data += [page("three", n, "Head\n- item\nx%d" % n) for n in range(3)]
    data += [page("ten", n, ("Foot\n" if n < 6 else "") + ("Five\n" if n < 5 else "") + "Foot" * (n == 0)) for n in range(10)]
    df = spark.createDataFrame(data + data[:2], "doc string, page_number int, text string")
    got = {(r["doc"], r["line_key"]) for r in segment.repeated_lines(df).collect()}
    assert got == {("three", "head"), ("ten", "foot")}
    clean = {(r[0], r[1]): r[2] for r in segment.without_repeated(df, segment.repeated_lines(df)).collect()}
    assert clean["three", 0] == "- item\nx0" and clean["two", 0] == "Head\nx0" and len(clean) == 15


def test_blocks_and_clauses(spark):
    text = "Your Rights\nYou may ask us\nfor a copy.\n\n- one\n- two\nback to top\n\nok"
    df = spark.createDataFrame([("d", 1, text), ("d", 2, "Next para goes on here."), ("e", 1, "No heading before this.")], "doc string, page_number int, text string")
    got = rows(segment.blocks(df, "doc", "page_number", text="text"), "doc", "page_number", "block_no")
    assert [r[3] for r in got if r[0] == "d" and r[1] == 1] == ["Your Rights", "You may ask us\nfor a copy.", "- one", "- two\nback to top", "ok"]
    built = segment.build_clauses(df)
    assert [r["clause_text"] for r in built.where("doc = 'e'").collect()] == ["No heading before this."]
    assert {r["tiny"] for r in built.where("clause_text = 'ok'").collect()} == {True}
    assert segment.build_clauses(df.limit(0)).count() == 0


def sequential_stitch(rows_):
    out, i = [], 0
    while i < len(rows_):
        d, k, t = rows_[i]
        if t.endswith(":") and i + 1 < len(rows_) and rows_[i + 1][0] == d:
            out.append((d, k, t + " " + rows_[i + 1][2]))
            i += 2
        else:
            out.append((d, k, t))
            i += 1
    return out


def test_stitch_equals_the_sequential_loop(spark):
    rng = random.Random(3)
    data = [(f"d{d}", k, rng.choice(["a:", "b", "c:"])) for d in range(40) for k in range(rng.randrange(1, 9))]
    got = segment.stitch(spark.createDataFrame(data, "doc string, k int, clause_text string"), "doc", "k")
    assert rows(got.select("doc", "k", "clause_text"), "doc", "k") == sorted(sequential_stitch(sorted(data)))


def test_numbering_is_gap_free(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert rows(segment.numbered(df, "x"), "x") == [(i, i + 1) for i in range(1000)]
    assert segment.numbered(df.limit(0), "x").count() == 0
    b = segment.batches(df, 300, "x").groupBy("batch_no").count()
    assert rows(b, "batch_no") == [(0, 300), (1, 300), (2, 300), (3, 100)]


def jac(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize(("num", "den"), [(4, 5), (98, 100), (1, 2)])
def test_similar_sets_equal_brute_force(spark, num, den):
    rng = random.Random(num)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 9))] for _ in range(40)]
    sets = [sorted(set(s)) for s in base + base[:5] + [b[:-1] for b in base[5:20]] + [[], []]]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sets)] + [(999, None, "x")], "i int, t array<string>, rep string").withColumn("c", F.lit("clash"))
    members, pairs = duplicates.similar(df, "i", "t", num, den)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    assert {r["id"]: r["rep"] for r in members.collect()} == {i: first[tuple(s)] for i, s in enumerate(sets)}
    got = {(r["id_a"], r["id_b"]) for r in pairs.collect()}
    reps = sorted(first.values())
    assert got == {(i, j) for i in reps for j in reps if i < j and jac(sets[i], sets[j]) * den >= num - 1e-12 * den}


def test_near_groups_equal_the_greedy_loop(spark):
    rng = random.Random(13)
    base = [[rng.choice("abcdefghijklmnopqrstuvwx") for _ in range(rng.randrange(4, 10))] for _ in range(25)]
    texts = []
    for b in base:
        texts += [" ".join(b), " ".join(b[:-1] + [rng.choice("abcxyz")]), " ".join(b + ["q"])][: rng.randrange(1, 4)]
    texts = texts + texts[::3] + ["a b c d e f g"] * 40 + ["", "", None]
    rng.shuffle(texts)
    sets = [set((t or "").split()) for t in texts]
    lead, want = [], {}
    for i, s in enumerate(sets):
        near = [(jac(s, sets[j]), -j) for j in lead if jac(s, sets[j]) >= 0.7]
        want[i] = (-max(near)[1], round(max(near)[0], 6)) if near else (i, 1.0)
        if not near:
            lead.append(i)
    got = duplicates.near_groups(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", 70, 100)
    assert {r["id"]: (r["leader"], r["sim"]) for r in got.collect()} == want


def test_leaders_equal_the_greedy_loop(spark):
    rng = random.Random(9)
    n = 60
    sim = {(i, j): round(rng.random(), 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.08}
    lead, want = [], {}
    for i in range(n):
        near = [(sim[j, i], -j) for j in lead if (j, i) in sim]
        want[i] = -max(near)[1] if near else i
        if not near:
            lead.append(i)
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in sim.items()], "id_a int, id_b int, sim double")
    got = {r["id"]: r["leader"] for r in duplicates.leaders(spark.range(n).select(F.col("id").cast("int")), pairs).collect()}
    assert got == want
    first = {r["id"]: r["leader"] for r in duplicates.leaders(spark.range(n).select(F.col("id").cast("int")), pairs, best=False).collect()}
    assert all(first[i] == min([j for j in lead if (j, i) in sim], default=i) for i in range(n))


def test_exact_groups(spark):
    data = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "b"), (7, None), (8, None)]
    got = duplicates.exact_groups(spark.createDataFrame(data, "i int, t string"), F.coalesce("t", F.lit("")), "i")
    assert [r[2] for r in rows(got.select("i", "t", "exact_group"), "i")] == ["EXACT-00001", "EXACT-00002", "EXACT-00001", "", "EXACT-00002", "EXACT-00002", "EXACT-00003", "EXACT-00003"]


def test_near_groups_and_entries(spark):
    t = "one two three four five six seven eight nine ten"
    data = [("1", t, "c"), ("2", t + " eleven", "c"), ("3", "other words here", "c"), ("4", t, "d")]
    df = spark.createDataFrame(data, "i string, t string, c string")
    got = {r["id"]: (r["leader"], r["near_group"]) for r in duplicates.near_groups(df, "i", "t", 85, 100, block="c").collect()}
    assert got == {"1": ("1", "NEAR-00001"), "2": ("1", "NEAR-00001"), "3": ("3", ""), "4": ("4", "")}
    e = df.withColumn("ids", F.array(F.lit("G1"), F.lit("G2")))
    kept = rows(duplicates.distinct_entries(e, "i", "ids", "c", "t"), "clause_id", "id")
    assert kept == [(g, i) for g in ("G1", "G2") for i in ("1", "3", "4")]


def test_provenance_and_parsing(spark):
    rules = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["a", "c"]), ("r3", ["z"]), ("r4", None), ("r5", ["a", "z"])], "taxonomy_id string, source_clause_ids array<string>")
    clauses = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("a", "X")], "clause_id string, source_act string")
    got = {r["taxonomy_id"]: (r["resolved_act"], r["missing_ids"]) for r in taxonomy.provenance(rules, clauses).collect()}
    assert got == {"r1": ("X", []), "r2": ("MULTI_ACT__X__Y", []), "r3": ("UNRESOLVED", ["z"]), "r4": ("UNRESOLVED", []), "r5": ("X", ["z"])}
    df = spark.createDataFrame([('["a", " b "]',), ("a, b,",), ("",), (None,), ("[broken",)], "t string")
    assert [r[0] for r in df.select(taxonomy.parse_ids(F.col("t"))).collect()] == [["a", "b"], ["a", "b"], [], [], ["[broken"]]
    assert taxonomy.first_array('<think>[1]</think> x [{"a": "]"}] y') == [{"a": "]"}]
    assert taxonomy.first_array('Sure: {"note": "x", "items": [{"a": 1}], "more": [2]} and [3]') == [{"a": 1}] and taxonomy.first_array("see [the list] below: [1, 2] end") == [1, 2]
    assert taxonomy.first_array('{"a": 1} then [5]') == [5] and taxonomy.first_array(None) is None and taxonomy.first_array("<think>[1]</think>") is None
    assert taxonomy.first_array('{"items": [1, 2]}') == [1, 2] and taxonomy.first_array("none") is None and taxonomy.first_array('[{"a": 1}, {"b"') is None


def test_routing(spark):
    recs = spark.createDataFrame([("c1", "please delete my photo albums"), ("c2", None), ("c3", "nothing")], "clause_id string, t string")
    rules = spark.createDataFrame([("r1", "Erasure", "photo albums; x", "remove albums"), ("r2", "Erasure", None, "delete"), ("r3", "Erasure", "photo", ""), ("r4", "Other", "photo", "")], "taxonomy_id string, category string, required_concepts string, requirement string")
    scored = routing.score_rules(recs, rules, "clause_id", "t", {"Erasure": ["delete"]})
    assert {(r["rule_id"], r["score"]) for r in scored.collect()} == {("r1", 8), ("r2", 4), ("r3", 7), ("r4", 4)}
    assert [r[1] for r in rows(routing.ranked(scored).select("place", "rule_id"), "place")] == ["r1", "r3", "r4"]
    chosen = spark.createDataFrame([("c1", "a", 1)], "id string, rule_id string, place int")
    extra = spark.createDataFrame([("c1", "a", 1), ("c1", "b", 2), ("c2", "z", 1)], "id string, rule_id string, place int")
    assert rows(routing.fill(chosen, extra), "id", "place") == [("c1", "a", 1, "keyword"), ("c1", "b", 2, "semantic"), ("c2", "z", 1, "semantic")]
    # rules in blocks of two give what they give in one
    kept, routing.BROADCAST_RULES = routing.BROADCAST_RULES, 2
    try:
        blocks = routing.score_rules(recs, rules, "clause_id", "t", {"Erasure": ["delete"]})
        assert rows(blocks, "id", "rule_id") == rows(scored, "id", "rule_id")
    finally:
        routing.BROADCAST_RULES = kept
    gated = routing.score_rules(recs, rules, "clause_id", "t", {"Erasure": ["delete"]}, gated={"Erasure": (["please"], ["nothing"])})
    assert {(r["rule_id"], r["score"]) for r in gated.collect()} == {("r1", 5), ("r3", 4), ("r4", 4)}
    routed = spark.createDataFrame([("c1", "r1", 1, "keyword")], "id string, rule_id string, place bigint, kind string")
    assert rows(routing.by_default(recs, "clause_id", routed, rules, ["Erasure"], 2), "id", "place") == [("c1", "r1", 1, "keyword")] + [(c, r, n, "default") for c in ("c2", "c3") for n, r in ((1, "r1"), (2, "r2"))]


def test_labels(spark):
    exp = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "clause_id string")
    res = spark.createDataFrame([("1", "r1", "Compliant", 1), ("1", "r1", "Partially Compliant", 2), ("2", "zz", "Compliant", 1), ("3", "r1", "Not Addressed", 1), (None, "r1", "x", 1)], "clause_id string, best_match_taxonomy_id string, verdict string, o int")
    got = rows(routing.clean_labels(exp, res, spark.createDataFrame([("r1",)], "taxonomy_id string"), "o"), "clause_id")
    assert got == [("1", "r1", "Compliant"), ("2", "NONE", "Not Addressed"), ("3", "NONE", "Not Addressed"), ("4", "NONE", "Not Addressed")]


def test_curation(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", None)], "k string, v string")
    p = spark.createDataFrame([("1", "z", "why"), ("2", "y", "same"), ("3", "q", "r"), ("9", "q", "r")], "k string, new_value string, reason string")
    assert rows(curation.override(df, p, "k", "v"), "k") == [("1", "z", "x", "why"), ("2", "y", None, None), ("3", "q", None, "r")]
    new = spark.createDataFrame([("2", "b", 1), ("2", "c", 2), ("4", "d", 1)], "k string, v string, o int")
    assert rows(curation.merge_back(df.withColumn("o", F.lit(0)), new, "k", "o").select("k", "v"), "k") == [("1", "x"), ("2", "c"), ("3", None), ("4", "d")]
    assert rows(curation.map_values(df, "v", {"x": "X"}), "k")[0] == ("1", "X")
    cache = spark.createDataFrame([("1", "A", "SUCCESS"), ("2", "B", "FAILED")], "k string, answer string, status string")
    assert [(r["k"], r["status"]) for r in curation.cached(df, cache, "k").orderBy("k").collect()] == [("1", "CACHED"), ("2", "NEW"), ("3", "NEW")]


def test_splits(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 100 else "b" if i < 120 else "c") for i in range(121)], "k string, y string")
    got = {(r["y"], r["split"]): r["count"] for r in sampling.stratified_split(df, "k", "y").groupBy("y", "split").count().collect()}
    assert got == {("a", "train"): 70, ("a", "validation"): 15, ("a", "test"): 15, ("b", "train"): 14, ("b", "validation"): 3, ("b", "test"): 3, ("c", "train"): 1}
    assert {r["count"] for r in sampling.folds(df.where("y = 'a'"), "k", "y", 5).groupBy("fold").count().collect()} == {20}
    assert sampling.downsample(df, "k", "y", "a", 10).count() == 31


def test_metrics(spark):
    data = [("Compliant", 0.9, 0.1), ("Compliant", 0.2, 0.9), ("Not Addressed", 0.1, 0.1), ("Not Addressed", 0.6, 0.9)]
    df = spark.createDataFrame(data, "y string, a double, b double").withColumn("g", decisions.decide(F.col("a"), F.col("b"), F.lit(0.6), F.lit(0.5)))
    rep = {r["label"]: r for r in decisions.report(decisions.confusion(df, "y", "g")).collect()}
    assert (rep["Compliant"]["precision"], rep["Compliant"]["recall"], rep["Partially Compliant"]["f1"]) == (0.5, 0.5, 0.0)
    assert decisions.grid_search(df, "y", "a", "b", [(0.6, 0.5), (0.9, 0.95)], 0.7).collect()[0]["t_yes"] == 0.9
    assert decisions.grid_search(df.where("y = 'Not Addressed'"), "y", "a", "b", [(0.6, 0.5)], 0.7).count() == 0


def test_members_give_the_links_of_copies(spark, tmp_path):
    from lexweave.plans.all_queries import QUERIES

    run = {q.name: q.run for q in QUERIES}
    spark.createDataFrame([("a", "one two three"), ("b", "three one two two"), ("c", "one two four"), ("d", "other")], "clause_id string, clause_text string").write.parquet(f"{tmp_path}/statutory_clauses.parquet")
    members = dict(rows(run["dup_near_members"](spark, str(tmp_path)), "clause_id"))
    assert members == {"a": "a", "b": "a", "c": "c", "d": "d"}
    pairs = {(r["id_a"], r["id_b"]) for r in run["dup_near_pairs"](spark, str(tmp_path)).collect()}
    links = {(x, y) for x in members for y in members if x < y and (members[x] == members[y] or tuple(sorted((members[x], members[y]))) in pairs)}
    assert links == {("a", "b"), ("a", "c"), ("b", "c")}


def test_entries_of_answers(spark):
    full = {k: "x" for k in ("applicability", "assessability", "category", "checkable_test", "citation_confidence", "notes", "requirement", "source", "source_clause_ids", "weight")}
    some = {k: v for k, v in full.items() if k not in ("notes", "weight")}
    df = spark.createDataFrame([(json.dumps([full, some, "text", 3]),), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(F.transform(taxonomy.parsed_entries(F.col("t")), lambda e: e["problem"])).collect()]
    assert got == [[None, "missing fields: notes, weight", "entry is not an object", "entry is not an object"], None, None]


def test_hot_keys_are_aggregated_or_split(spark):
    """First rows and quotas come from aggregates, classes are numbered by ranges: no plan ranks the rows of a key in one window."""
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i % 5 == 0) for i in range(300)] + [(900, None, True), (0, "k0", True)], "id int, k string, ok boolean")
    first = duplicates.first_per_key(df, F.col("k"), "id")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and first.count() == 102 and first.where("k = 'hot'").first()["id"] == 1 and first.where("k is null").count() == 1
    q = curation.quota(df, ["k"], F.col("ok"), "id", F.lit(-1), "id")
    assert q.where("id >= 0 and k = 'hot'").count() == 1 and q.where("k = 'k0' and id = 0").count() == 1 and q.count() == 302
    n = sampling._ranked(df, "id", "k", 1)
    assert sorted(r["_r"] for r in n.where("k = 'hot'").collect()) == list(range(1, 201)) and {r["_n"] for r in n.where("k = 'hot'").collect()} == {200}
    assert n.where("k is null").first()["_r"] == 1 and sampling._ranked(df.limit(0), "id", "k", 1).count() == 0


def test_vector_and_term_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 16))
    v[30:] = v[:30] + 0.35 * rng.standard_normal((30, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows_ = [(i, "hot" if i % 2 else "b", v[i].tolist()) for i in range(60)] + [(99, None, v[0].tolist()), (98, "b", None), (0, "b", v[0].tolist())]
    df = spark.createDataFrame(rows_, "id int, k string, v array<double>").withColumn("band", F.lit("clash"))
    for least in (0.3, 0.7, 0.9):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and v[i] @ v[j] >= least}
        assert {(r["id_a"], r["id_b"]) for r in duplicates.vector_pairs(df, "id", "k", "v", least).collect()} == want
    assert duplicates.vector_pairs(df.limit(0), "id", "k", "v", 0.5).count() == 0
    w = [[(rng.integers(0, 12), float(x)) for x in rng.random(4)] for _ in range(50)]
    w = [{f"t{t}": x for t, x in r} for r in w]
    w = [{t: x / sum(y * y for y in r.values()) ** 0.5 for t, x in r.items()} for r in w]
    weights = spark.createDataFrame([(i, t, x) for i, r in enumerate(w) for t, x in r.items()], "id int, term string, weight double")
    for least in (0.2, 0.8, 0.99):
        want = {(i, j) for i in range(50) for j in range(i + 1, 50) if sum(x * w[j].get(t, 0) for t, x in w[i].items()) >= least}
        assert {(r["id_a"], r["id_b"]) for r in duplicates.tfidf_pairs(weights, least).collect()} == want


def test_leaders_of_a_long_chain(spark):
    """Each row is like the next one only: every second one leads. One task settles what is small enough, rounds do the rest."""
    for n, tail in ((2000, duplicates.TAIL), (14, 6)):
        ids = spark.createDataFrame([(f"{i:05d}",) for i in range(n)], "id string")
        pairs = spark.createDataFrame([(f"{i:05d}", f"{i + 1:05d}", 0.9) for i in range(n - 1)], "id_a string, id_b string, sim double")
        got = {r["id"]: r["leader"] for r in duplicates.leaders(ids, pairs, tail=tail).collect()}
        assert got == {f"{i:05d}": f"{i - i % 2:05d}" for i in range(n)}


def test_calibration_and_intervals(spark):
    df = spark.createDataFrame([(i, (i % 10) / 10, int((i * 7) % 10 < i % 10)) for i in range(400)], "id int, s double, hit int")
    got = {round(r["s"], 1): r["calibrated"] for r in decisions.calibrated(df, df.union(spark.createDataFrame([(-1, 5.0, 0), (-2, None, 0)], df.schema)), "s", "hit").collect() if r["s"] is not None}
    assert [got[k] for k in sorted(got)] == sorted(got.values()) and got[5.0] == got[0.9]
    x = df.select("id", F.lit("a").alias("t"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("g"))
    r = decisions.bootstrap_accuracy(x, "id", "t", "g", 60).first()
    assert r["accuracy"] == 0.75 and 0.68 < r["low"] < 0.75 < r["high"] < 0.82
    t = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "a", 2), ("b", "b", 4)], "truth string, guess string, n bigint")
    assert abs(decisions.matthews(t).first()["mcc"] - 10 / 600**0.5) < 1e-9
    assert decisions.matthews(t.where("truth = 'a' and guess = 'a'")).first()["mcc"] == 0
