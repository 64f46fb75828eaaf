"""The registered queries over the smallest tables."""

import os

import numpy as np
import pytest

from lodestrata.llm import bpe
from lodestrata.llm.queries import registry
from lodestrata.testing.oracle import connect, differences

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p2_found": ["id", "piece_no", "start_line", "end_line"],
    "p3_found": ["file_id"],
    "p4_found": ["id_a", "id_b"],
    "p5_found": ["src_table", "src_id", "line_no"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_equals_sql(spark, name):
    _, _, only_spark, only_sql = differences(registry.fns[name](spark, DATA), connect(DATA), registry.sql[name])
    assert (only_spark, only_sql) == ([], [])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = registry.fns[name](spark, DATA)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert df.columns == COLUMNS[name] and rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(set(registry.fns) - set(COLUMNS)))
def test_runs(spark, name):
    assert registry.fns[name](spark, DATA).count() > 0


def test_round_trip_of_all_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    back = bpe.decode(registry.fns["p6_ids"](spark, DATA), bpe.vocabulary_path())
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == want


def test_recall_of_neighbours(spark):
    got = {tuple(r) for r in registry.fns["p4_found"](spark, DATA).collect()}
    rows = {r.id: r.vector for r in spark.read.parquet(f"{DATA}/vector_rows.parquet").collect()}
    fine = sorted((i, v) for i, v in rows.items() if v is not None and len(v) == 64 and not np.isnan(v).any() and np.any(v))
    x = np.array([v for _, v in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.clip(x @ x.T, -1, 1), 9)
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((fine[a][0], fine[b][0]))) for a in range(len(fine)) for b in np.lexsort((np.arange(len(fine)), -s[a]))[:10]}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
