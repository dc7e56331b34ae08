from pyspark.sql import functions as F

from lexweave.functions import lexicons as L
from lexweave.functions import text as T
from lexweave.functions.keys import computed_once, name_key, words
from lexweave.operators import features, segment
from lexweave.operators import signals as S
from lexweave.sources import readers


def ev(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_normalize(spark):
    got = ev(spark, T.normalize, "exam-\nple  a\t b", "a\r\n\n\n\nb", " x y ", None, "", "so­ft")
    assert got == ["example a b", "a\n\nb", "x y", None, "", "soft"]


def test_line_knows_unicode_space(spark):
    assert ev(spark, T.line, "  a  b\n", None, "\t") == ["a b", None, ""]
    assert ev(spark, T.display, None, " a ") == ["", "a"]


def test_canonical_forms(spark):
    assert ev(spark, T.canonical_nfkc, "ﬁNE  Straße", "A b", None) == ["fine strasse", "a b", ""]
    assert ev(spark, T.canonical_alnum, "It’s – 3 “Cats”!") == ["it s 3 cats"]
    assert ev(spark, T.canonical_dash, "A – b’s") == ["a - b's"]
    assert ev(spark, T.tokens, "b a, B! é2") == [["2", "a", "b"]]
    assert ev(spark, words, "Soft­word A1​b", None, "") == [["softword", "a1b"], [], []]
    assert ev(spark, name_key, "My App!", None, "--") == ["myapp", None, ""]


def test_small_scalars(spark):
    assert ev(spark, T.parse_percent, "12.3%", "", None, "bad", " 5 ") == [12.3, 0.0, 0.0, 0.0, 5.0]
    assert ev(spark, T.level, "HIGH", " low", "med", None, "2") == ["High", "Low", "Medium", "Medium", "Medium"]
    assert ev(spark, T.safe_name, "a b/c", None, "__", "x.y") == ["a_b_c", "unnamed", "unnamed", "x.y"]
    assert ev(spark, lambda c: T.truncate_words(c, 2), "a b c", "a b", None) == ["a b", "a b", None]
    assert ev(spark, lambda c: T.name_from_file(c, {"act_a": "A", "act_a_rules": "AR"}), "Act-A rules.pdf", "act_a.pdf", "My-file.x.pdf", ".pdf") == ["AR", "A", "MY_FILE_X", "UNKNOWN_SOURCE"]


def test_line_kinds(spark):
    assert ev(spark, S.junk, "Back to  Top", "page 3 of 9", "Page 3 of x", "", None, "Effective May 3, 2020") == [True, True, False, True, True, True]
    assert ev(spark, S.heading, "Your Rights", "Your rights.", "lower", "A" + "b" * 100, "A" + "b" * 101, "2.1 Scope") == [True, False, False, True, False, True]
    assert ev(spark, S.bullet, "- a", "(a) b", "1. c", "a", "•x") == [True, True, True, False, False]
    assert ev(spark, S.boilerplate_reason, "contents", "Privacy Policy", "last updated: x", "contents x") == ["document navigation", "bare document title line", "revision-date stamp", ""]


def test_signals(spark):
    assert ev(spark, lambda c: S.relevance(c), "because of age", "")[1] == []
    assert ev(spark, lambda c: S.domain(c), "Ad Policy", "Cookie ads", "x", None) == ["commercial_advertising", "data_privacy", "platform_governance", "platform_governance"]
    assert ev(spark, lambda c: F.array_join(S.quality(T.display(c), 12), "|"), "", "short", None, "long enough text") == ["empty_clause_text|very_short_text", "very_short_text", "empty_clause_text|very_short_text", ""]
    assert ev(spark, lambda c: S.statutory_score(S.statutory(c), S.normative(c)), "you shall have erasure", "you shall", "consent and complaint must") == [2, 0, 3]
    assert ev(spark, lambda c: F.size(S.administrative(c, F.lit("Staff"))), "pension and gratuity", None) == [3, 1]


def test_features(spark):
    assert ev(spark, lambda c: features.term_count(c, L.HEDGES), "may may maybe", None) == [3, 0]
    assert ev(spark, lambda c: features.terms_present(c, L.HEDGES), "may may could") == [2]
    assert ev(spark, features.word_count, " a  b ", "", None) == [2, 0, 0]
    assert ev(spark, features.hedge_density, "may b", None) == [0.5, 0.0]
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (5.0,)], "x double")
    assert [r[0] for r in features.robust_scale(df, ["x"], F.lit(True)).orderBy("x").collect()] == [-1.0, -0.5, 0.0, 0.5, 1.0]
    flat = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    assert [r[0] for r in features.robust_scale(flat, ["x"], F.lit(True)).collect()] == [0.0, 0.0]


def test_computed_once_keeps_nulls_and_columns(spark):
    df = computed_once(spark.createDataFrame([(None,), ("a",)], "v string"), w=F.upper("v"))
    assert sorted(map(tuple, df.collect()), key=str) == [("a", "A"), (None, None)]


def test_split_long(spark):
    a, b = "A" * 900 + ".", "B" * 600 + "."
    assert ev(spark, segment.split_long, a + " " + b, "x" * 1400, "x" * 1500) == [[a, b], ["x" * 1400], ["x" * 1500]]
    assert ev(spark, segment.subclauses, "(a) one; (b) two; and (c) three", "(a) alone") == [["(a) one;", "(b) two;", "(c) three"], ["(a) alone"]]


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"clause_id": "1", "n": 2}, {"clause_id": "2", "n": null}]}')
    got = readers.read_json(spark, str(tmp_path / "a.json"), "clause_id string, n int")
    assert sorted(map(tuple, got.collect())) == [("1", 2), ("2", None)]
    (tmp_path / "b.json").write_text('[{"clause_id": "1", "n": 2}]')
    assert [tuple(r) for r in readers.read_json(spark, str(tmp_path / "b.json"), "clause_id string, n int").collect()] == [("1", 2)]
    (tmp_path / "c.csv").write_text('clause_id,clause_text\n1,"a ""b""\nc"\n2,\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "c.csv")).collect())) == [("1", 'a "b"\nc'), ("2", "")]


def test_tfidf_of_ngrams(spark):
    df = spark.createDataFrame([("a", "The user may delete data; delete x"), ("b", "data delete"), ("c", None)], "i string, v string")
    got = {(r["id"], r["term"]) for r in features.tfidf(df, "i", "v", ngrams=(1, 2), pattern=r"\b[a-z_][a-z0-9_-]+\b", stop_words=L.STOP_WORDS).collect()}
    assert got == {("a", t) for t in ("user", "delete", "data", "user delete", "delete data", "data delete")} | {("b", t) for t in ("data", "delete", "data delete")}
    few = {(r["id"], r["term"]) for r in features.tfidf(df, "i", "v", ngrams=(1, 2), max_features=2).collect()}
    assert few == {(i, t) for i in "ab" for t in ("data", "delete")}


def test_rules_alike_only_in_their_tests(spark, tmp_path):
    from lexweave.plans.report_queries import QUERIES

    run = {q.name: q.run for q in QUERIES}["sim_engine_texts"]
    spark.createDataFrame([("A", "erase records", "ask for a copy"), ("B", "publish contacts", "ask for a copy")], "taxonomy_id string, requirement string, checkable_test string").write.parquet(f"{tmp_path}/rules.parquet")
    assert [(r["id_a"], r["id_b"]) for r in run(spark, str(tmp_path)).collect()] == [("A", "B")]
