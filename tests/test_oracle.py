"""Registered queries against their SQL, on the smallest tables.

A spread of queries by default; ``AGROCLIME_ALL_QUERIES=1`` runs every one.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from agroclime.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.QUERIES, {k: v for k, v in entry.oracle_sql().items() if k in catalog.QUERIES}
SPREAD = [
    "normalize_rain", "null_tokens", "extract_year", "facts", "join_rainfall_fan_out", "reject_counts", "summary_counts",
    "explorer_metrics", "sample_rows", "describe_facts", "crop_year_yield", "corr_matrix", "answer_parsed",
    "build_documents", "raw_csv", "similarity_topk", "similarity_topk_batch", "filter_by_question", "question_corr",
    "answer_hits", "map_subdivision_literal", "facts_csv_reordered", "facts_parquet", "corpus_sample_csv", "similarity_topk_blocks",
]
NAMES = sorted(ORACLE) if os.environ.get("AGROCLIME_ALL_QUERIES") else SPREAD


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert canonical(df.columns, df.collect()) == canonical(columns, result.fetchall())


def test_every_query_is_covered():
    assert set(ORACLE) <= set(QUERIES)
    assert set(catalog.QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).columns == ["crop", "avg_production"]
