"""Every registered query of the engine: against DuckDB where it has SQL, else it must run and give rows."""

import os

import duckdb
import pytest

from chunkloom import queries as Q


def canonical(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return tuple(map(canonical, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        c.execute(f"create view {f.split('.')[0]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n in Q.SQL])
def test_same_rows_as_sql(spark, sf, con, name):
    df = Q.QUERIES[name](spark, sf)
    got = sorted(repr(tuple(canonical(r[c]) for c in sorted(df.columns))) for r in df.collect())
    cur = con.execute(Q.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr(tuple(canonical(r[i]) for i in at)) for r in cur.fetchall())


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_gives_rows(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_greedy_takes_the_first_kept(spark):
    from chunkloom.operators.corpus import greedy_originals

    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (1, 5, 0.9), (4, 5, 0.9)], "a bigint, b bigint, similarity double")
    assert sorted((r[0], r[1]) for r in greedy_originals(pairs).collect()) == [(2, 1), (4, 3), (5, 1)]


def test_empty_dataset_is_reported(spark):
    from chunkloom.operators.corpus import histogram, validate

    c = spark.createDataFrame([], "id string, content string, document_id string, size int, previous_chunk string, next_chunk string")
    assert [r["code"] for r in validate(c).collect()] == ["EMPTY_DATASET"]
    assert histogram(c, "size").count() == 0
