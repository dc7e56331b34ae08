"""Problems 4, 5, 7, 8, 9 and 10 on small tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm import boilerplate, chunking, leakage, ocr, packing, reading

PAGES = "doc string, page_number int, text string, needs_ocr boolean"
BLOCKS = "clause_id string, app_name string, source_file string, page_start int, clause_text string"


def test_repeated_lines(spark):
    rows = [(f"b{i}", "My App" if i % 2 else "my-app", f"f{i}", 1, f"Body {chr(97 + i)} text\nCopyright 20{i:02d}\n\n***\nshare!") for i in range(8)]
    rows += [("s1", "My App", "f90", 1, "Copyright 2001"), ("n1", None, "f91", 1, "share!"), ("o1", "Other", "f92", 1, "share!"), ("e1", "My App", "f93", 1, None), ("e2", "My App", "f94", 1, ""), ("x1", "My App", "f95", 1, "different")]
    rows += [("t1", "Seven", f"g{i % 7}", 1, "only seven files") for i in range(20)] + rows[:3]
    blocks = spark.createDataFrame(rows, BLOCKS).withColumns({c: F.lit("x") for c in ("id", "line", "document", "source_key")})
    pages = spark.createDataFrame([("f90", 1, "x", True), ("f90", 1, "x", True), ("f0", 1, "x", False)], PAGES)
    got = boilerplate.repeated_lines(blocks, pages)
    assert {tuple(r) for r in got.collect()} == {(f"b{i}", k) for i in range(8) for k in (1, 4)}
    clean = {r["id"]: (r["clean_text"], r["n_removed"]) for r in boilerplate.without_lines(blocks, got).collect()}
    assert clean["b0"] == ("Body a text\n\n***", 2) and clean["e1"] == (None, 0) and clean["e2"] == ("", 0) and clean["s1"] == ("Copyright 2001", 0)
    assert boilerplate.repeated_lines(blocks.limit(0), pages.limit(0)).count() == 0
    assert boilerplate.repeated_lines(blocks, pages, 8, 0.8).count() == 16
    assert boilerplate.repeated_lines(blocks, pages, 8, 0.99).count() == 0


def test_join_of_a_hot_line_is_split(spark):
    """One notice stands in every document of a site that has all rows: the join with the frequent lines is split, without broadcasts."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5000",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    blocks = spark.createDataFrame([(f"b{i:05d}", "Site", f"f{i}", 1, f"All rights reserved\nOwn text {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(4000)], BLOCKS).repartition(8)
    pages = spark.createDataFrame([("none", 1, "x", True)], PAGES)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = boilerplate.repeated_lines(blocks, pages)
        n = got.count()
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == 4000 and "skew=true" in plan


STARTS = [
    ("One two. Three four.", ["Three"]),
    ("Use Sec. 4.2 and Art. 3 of No. 12, e.g. this, i.e. that vs. those. Next", ["Next"]),
    ("Rate of 3.5 per cent. 40 days later it ends. iPhone users wait.", ["40 days", "iPhone"]),
    ("Done by Foo Inc. of Bar for approx. 12 users. See Q. 10 on form B. 3 now.", ["See"]),
    ("“Quoted text ends.” (Then this one.) End", ["(Then", "End"]),
    ("We need: (a) one thing; (b) two under paragraph (c) above; and (d) three. After", ["(a)", "(b)", "(d)", "After"]),
    ("Items:\n- first;\n- second.\nAfter that", ["- first", "- second", "After"]),
    ("Items:\n1. first;\n2. second.\n\nnew para", ["1. first", "2. second", "new para"]),
    ("Wrapped under paragraph\n(b) of this\nPolicy text is one", []),
    ("Asked in Q. 10 on form B.\n3. Where it ends.\n4. Last", ["Where", "4. Last"]),
    ("Under No.\n12. We go on as in Art.\n222. After", ["We go", "After"]),
    ("Really! Is it? Yes.", ["Is it", "Yes"]),
    ("", []), ("no end", []), ("   Lead. Two", ["Two"]),
]


@pytest.mark.parametrize(("text", "starts"), STARTS)
def test_boundaries(text, starts):
    assert sorted(chunking.boundaries(text)) == sorted(text.index(s) for s in starts)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8, 63, 64, 120])
def test_sparse_table_equals_a_scan(size):
    import numpy as np

    rng = random.Random(1)
    at = np.array(sorted(rng.sample(range(1000), size)))
    strength = np.array([rng.randrange(6) for _ in at])
    table = chunking.StrongestCut(at, strength)
    for _ in range(500):
        lo, hi = sorted((rng.randrange(1000), rng.randrange(1000)))
        inside = [(s, int(p)) for p, s in zip(at, strength) if lo <= p <= hi]
        assert table.query(lo, hi) == ((max(inside)[1], max(inside)[0]) if inside else None)
        left = min(((-s, p) for s, p in inside), default=None)
        assert table.query(lo, hi, leftmost=True) == ((left[1], -left[0]) if left else None)
    for least in range(7):
        assert table.at_least(least) == [(int(p), int(s)) for p, s in zip(at, strength) if s >= least]


def test_strongest_cut_of_the_whole_window_and_longest_overlap():
    words = lambda n: ("word " * (n // 5 + 1))[: n - 1] + " "
    text = words(320)[:-1] + ".\n\n" + "Next " + words(370)[:-2] + ". " + "Then " + words(1500)
    assert chunking.split(text)[0] == (0, 322)  # the paragraph, not the later sentence
    plain = "word " * 800
    pieces = chunking.split(plain)
    assert all(136 <= b - c <= 140 for (_, b), (c, _) in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("limit, overlap", [(1400, 140), (50, 0), (60, 20)])
def test_pieces_cover_the_text(limit, overlap):
    rng = random.Random(limit)
    for n in range(40):
        text = "".join(rng.choice(["Word ", "and ", "x. ", "Y; ", "\n\n", "é" * 30, "(a) ", "a" * (n * 5)]) for _ in range(rng.randrange(1, 120)))
        pieces = chunking.split(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b in pieces) or text == ""
        for (_, b), (c, d) in zip(pieces, pieces[1:]):
            assert 0 <= b - c <= overlap and d > b
        assert "".join([text[a:b][(pieces[k - 1][1] - a if k else 0) :] for k, (a, b) in enumerate(pieces)]) == text


def test_pieces_cut_at_sentences(spark):
    s = "This sentence has exactly some words in it. "
    rows = [("1", "H", s * 60), ("2", None, "short"), ("3", None, None), ("4", "H", "x" * 3000), ("1", "H", s * 60), (None, "H", s * 60)]
    df = spark.createDataFrame(rows, "clause_id string, section_heading string, clause_text string").withColumns({c: F.lit("c") for c in ("id", "text", "heading", "piece")})
    got = chunking.pieces(df, "clause_id", "clause_text", "section_heading").orderBy("id", "piece_no").collect()
    assert {r["id"] for r in got} == {"1", "4"}
    one = [r for r in got if r["id"] == "1"]
    assert all(r["start_at"] % len(s) == 0 for r in one) and all(len(r["piece"]) <= 1400 and r["heading"] == "H" for r in one)
    assert [len(r["piece"]) for r in got if r["id"] == "4"][0] == 1400
    assert chunking.boundary_rows(df, "clause_id", "clause_text").where("id = '1'").count() == 59
    assert chunking.pieces(df.limit(0), "clause_id", "clause_text", "section_heading").count() == 0


def test_scanned_text(spark):
    words = "sections months consent device information needed because within where cross-border terminal collected"
    clean = [(f"c{i}", "Good App", f"web{i}", 1, words + "\n" + "we may need the information") for i in range(30)]
    body = "The lnformation is nee-\nded wheri m0nths of corisent apply to h264 cross-\nborder wifhin 7 rnonths"
    rows = [(f"s{i}", "Good App", "scan", i, ("GOOD APP policy for All\n" if i else "Good App policy for AII\n") + body.replace("wheri", "where") + f"\n\n- {i} -") for i in range(3)]
    rows += [("p1", "Good App", "scan", 9, "verif­\nied veriﬁed text\n[12]"), ("n1", None, "scan", 10, None), ("n2", None, "scan", 11, ""), rows[0]]
    raw = spark.createDataFrame(clean + rows, BLOCKS).withColumns({c: F.lit("x") for c in ("doc", "page", "text", "word", "n")})
    pages = spark.createDataFrame([("scan", i, "t", True) for i in (0, 1, 2, 9, 10, 11, 0)] + [("web1", 1, "t", False)], PAGES)
    r = ocr.Repair(raw, pages)
    got = {}
    for c, line, t in r.found().collect():
        got.setdefault(c, set()).add((line, t))
    for c in ("s0", "s1", "s2"):
        assert got[c] == {(0, ""), (1, "needed"), (2, "months"), (2, "consent"), (3, "within"), (3, "months"), (5, "")}
    assert got["p1"] == {(0, "verified"), (1, "verified"), (2, "")} and set(got) == {"s0", "s1", "s2", "p1"}
    text = {x["clause_id"]: x["clean_text"] for x in r.paragraphs().collect()}
    assert text["s1"] == "The lnformation is needed where months of consent apply to h264 cross-border within 7 months"
    assert text["n1"] is None and text["n2"] == "" and "c1" not in text
    assert ocr.Repair(raw.limit(0), pages).found().count() == 0


def test_letters_of_misread_words(spark):
    counts = spark.createDataFrame([("modern", 50, 50), ("under", 80, 70), ("nagaux", 9, 0), ("east", 90, 2), ("device", 40, 40), ("collect", 30, 30), ("profiles", 60, 60), ("profilcs", 2, 2)], "word string, n long, n_low long")
    bad = ["moclern", "undcr", "deviee", "co11ect", "urider", "uncler", "cast", "mp4", "b2c", "moderm", "1", "!nder", "proﬁles", "uniﬁes"]
    got = {r["word"]: r["right"] for r in ocr.corrections(spark.createDataFrame([(w,) for w in bad], "word string"), counts).collect()}
    assert got == {"moclern": "modern", "undcr": "under", "deviee": "device", "co11ect": "collect", "urider": "under", "uncler": "under", "proﬁles": "profiles", "uniﬁes": "unifies"}


def test_first_fit_decreasing_equals_a_scan():
    rng = random.Random(6)
    for _ in range(100):
        sizes = [rng.randrange(0, 101) for _ in range(rng.randrange(0, 80))]
        free, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            free[k] -= sizes[i]
            want[i] = k
        assert dict(enumerate(packing.first_fit_decreasing(sizes, 100))) == want


def test_packing(spark):
    rng = random.Random(3)
    n = {i: rng.choice([0, 1, 50, 700, 2047, 2048, 2049, 4096, 9000]) for i in range(500)}
    df = spark.createDataFrame([(i, v) for i, v in n.items()] + [(1, n[1]), (2, 0)], "id long, n_tokens long")
    got = packing.pack(df, 500, group_size=100).collect()
    per, fill = {}, {}
    for r in got:
        per.setdefault(r["id"], []).append((r["piece_no"], r["first_token"], r["n_tokens"]))
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
    assert set(per) == set(n) and max(fill.values()) <= 2048
    for i, parts in per.items():
        assert [p[0] for p in sorted(parts)] == list(range(len(parts))) and sum(p[2] for p in parts) == n[i]
        assert len(parts) == max(1, -(-n[i] // 2048)) and all(a[1] + a[2] == b[1] for a, b in zip(sorted(parts), sorted(parts)[1:]))
    assert packing.pack(df.limit(0), 0).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary file")
def test_token_counts(spark):
    import base64

    import tiktoken

    with open(packing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    e = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world, it's 2024.", "naïve café ☃", "<|endoftext|>", "", None, "a " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["n_tokens"] for r in packing.token_counts(df, "doc_id", "text").collect()} == {i: len(e.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def edit_distance_anywhere(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(7)
    for _ in range(300):
        p = [rng.choice("abcd") for _ in range(rng.randrange(1, 90))]
        t = [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]
        assert leakage.myers(p, t) == edit_distance_anywhere(p, t)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(60)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: make(rng.choice([3, 5, 11, 12, 30, 70])) for i in range(30)}
    docs = {}
    for d in range(120):
        w = make(rng.randrange(0, 60))
        if d % 2:
            it = items[rng.randrange(30)]
            a = rng.randrange(max(1, len(it) - 11))
            w[len(w) // 2 : len(w) // 2] = it[a : a + rng.choice([5, 11, 12, 13, 40])]
        docs[d] = w
    items[4] = make(40)
    docs[200] = items[4] * 20
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(i, d) for i, x in items.items() for d, y in docs.items() if runs(x) & runs(y)}
    df = spark.createDataFrame([(d, ", ".join(w).upper() + "é") for d, w in docs.items()] + [(900, None), (901, ""), (None, " ".join(items[4])), (1, ", ".join(docs[1]))], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, ""), (1, " ".join(items[1]))], "item_id long, text string")
    for block in (2_000_000, 50):
        got = leakage.matches(df, it, block_words=block)
        assert {(r["item_id"], r["doc_id"]) for r in got.where("run_words >= 12").collect()} == want
    whole = leakage.matches(df, it).where("doc_id = 200 and item_id = 4").first()
    assert (whole["run_words"], whole["edits"]) == (40, 0)
    assert leakage.matches(df, it.limit(0)).count() == 0 and leakage.matches(df.limit(0), it).count() == 0


def test_edits_within_the_budget_are_found(spark):
    """Passages with one edit: put in, left out, exchanged, at any place; string ids; against the plain distance."""
    rng = random.Random(3)
    items = {f"i{k}": [f"q{k}x{i}" for i in range(rng.choice([12, 13, 30]))] for k in range(12)}
    docs = {}
    for d in range(150):
        w = list(rng.choice(list(items.values())))
        a = rng.randrange(max(1, len(w) - 11))
        w = w[a : a + rng.choice([11, 12, 13])]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at], "new"]])
        docs[f"d{d}"] = ["pad"] * rng.randrange(9) + w + ["pad"] * rng.randrange(9)
    least = {(i, d): min(edit_distance_anywhere(x[s : s + 12], y) for s in range(len(x) - 11)) for i, x in items.items() for d, y in docs.items()}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id string, text string")
    got = leakage.matches(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id string, text string"))
    assert {(r["item_id"], r["doc_id"]): r["edits"] for r in got.collect()} == {k: e for k, e in least.items() if e <= 1}


def test_documents_with_several_running_headers(spark):
    """Headers alternate on left and right pages, and one is misread."""
    heads = ["Privacy Handbook Volume One", "Chapter on Sharing of Records"]
    rows = [(f"b{p}", "App", "f", p, f"{heads[p % 2] if p != 7 else 'Chapter 0n Shar1ng of Recerds'}\nBody of page {chr(97 + p)} goes here.\n{p}") for p in range(10)]
    pages = spark.createDataFrame([("f", p, "x", True) for p in range(10)], PAGES)
    found = ocr.Repair(spark.createDataFrame(rows, BLOCKS), pages).found().where("found_text = ''")
    assert {tuple(r) for r in found.select("clause_id", "line_no").collect()} == {(f"b{p}", k) for p in range(10) for k in (0, 2)}


EASY = ["The cat sat on the mat.", "We like to play ball.", "He can see a big dog.", "You and I eat jam."]
HARD = ["Notwithstanding the aforementioned stipulations, indemnification obligations shall survive termination.", "Jurisdictional determinations necessitate comprehensive documentation of contractual representations."]


def test_reading_levels(spark):
    rng = random.Random(2)
    text = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    samples = [(i, text(EASY, 12), 1) for i in range(8)] + [(50 + i, text(HARD, 6), 4) for i in range(8)] + [(99, None, 2), (98, "", 3)]
    model = reading.train(spark.createDataFrame(samples, "sample_id long, text string, level_no int"))
    rows = [(1, text(EASY, 30), "en"), (2, text(HARD, 20), "EN-gb"), (3, text(EASY, 30), "fr"), (4, text(EASY, 30), None), (5, "Too short.", "en"), (6, None, "en"), (7, text(HARD, 20).upper(), " English"), (8, text(EASY, 9000), "en_US"), (None, text(EASY, 30), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("level_no", F.lit("clash"))
    assert {r["doc_id"]: r["level_no"] for r in reading.score(df, model).collect()} == {1: 1, 2: 4, 7: 4, 8: 1}
    assert reading.score(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        reading.train(spark.createDataFrame([], "sample_id long, text string, level_no int"))
