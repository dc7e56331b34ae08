"""The registered queries on the smallest tables, against SQL where it can state them."""

import os

import pytest

from lexweave.llm.queries import QUERIES, SQL
from lexweave.llm.reading import ReadingModel, sentences
from lexweave.session import scratch
from tests.test_queries import FOLDER, duck, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "p1_found": {"clause_id_a", "clause_id_b"}, "p2_found": {"keep_clause_id", "clause_id"}, "p3_found": {"app_a", "app_b"}, "p4_found": {"clause_id", "line_no"}, "p5_found": {"clause_id", "boundary_at"},
    "p6_found": {"group_clause_id", "clause_id"}, "p7_found": {"clause_id", "line_no", "found_text"}, "p9_found": {"item_id", "doc_id"}, "p10_found": {"doc_id", "level_no"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):  # noqa: F811
    with scratch():
        df = QUERIES[name](spark, FOLDER)
        rows = df.collect()
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in SQL:
        c = duck.execute(SQL[name])
        names = [x[0] for x in c.description]
        assert sorted(names) == sorted(df.columns) and plain(rows, df.columns) == plain(c.fetchall(), names)


def test_held_out_reading_levels(spark):
    rows = [(r["text"], r["level_no"]) for r in spark.read.parquet(f"{FOLDER}/reading_samples.parquet").orderBy("sample_id").collect()]
    import numpy as np

    right = 0
    for fold in range(5):
        m = ReadingModel([r for i, r in enumerate(rows) if i % 5 != fold])
        test = [r for i, r in enumerate(rows) if i % 5 == fold]
        right += int((m.levels(np.stack([m.distributions(sentences(t)).mean(0) for t, _ in test])) == np.array([n for _, n in test])).sum())
    assert right >= 0.95 * len(rows)
