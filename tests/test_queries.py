"""Every core query on the smallest tables: against SQL where there is SQL, else that it runs and names its columns."""

import os

import pytest

from lexweave.plans.all_queries import QUERIES
from lexweave.session import scratch

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return None if v != v else repr(round(v, 5))
        return None if v is None else str(v)

    return sorted([tuple(one(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.name)
def test_query(spark, duck, query):
    with scratch():
        df = query.run(spark, FOLDER)
        got = plain(df.collect(), df.columns)
    if query.sql is None:
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return
    c = duck.execute(query.sql)
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    assert got == plain(c.fetchall(), names)


def test_names_are_unique():
    assert len({q.name for q in QUERIES}) == len(QUERIES)


def test_verbosity_of_documents_that_do_not_vary(spark, tmp_path):
    """Texts of one length, of one number of words or of both have no correlation: NaN as in SQL, not a division by zero."""
    duckdb = pytest.importorskip("duckdb")
    texts = {
        "same": ["a text of five words"] * 49,
        "one length": ["abc", "a c"],
        "one count": ["abc", "abcd", "abcde"],
        "blank": ["", " ", " \t"],
        "varied": ["a", "a bc", "def", "a b c"],
        "with null": ["a", "a", None],
        "alone": ["a"],
    }
    rows = [(f"S{i:03d}{j:03d}", t, "app", k) for i, (k, ts) in enumerate(texts.items()) for j, t in enumerate(ts)]
    spark.createDataFrame(rows, "clause_id string, clause_text string, app_name string, source_document string").repartition(7).write.parquet(f"{tmp_path}/policy_clauses.parquet")
    query = next(q for q in QUERIES if q.name == "agg_verbosity_corr")
    got = {r["source_document"]: (r["n"], repr(r["r"])) for r in query.run(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view policy_clauses as select * from '{tmp_path}/policy_clauses.parquet/*.parquet'")
    assert got == {d: (n, repr(r)) for d, n, r in c.execute(query.sql).fetchall()}
    assert [k for k, (_, r) in sorted(got.items()) if r != "nan"] == ["varied"] and got["same"] == (49, "nan")
