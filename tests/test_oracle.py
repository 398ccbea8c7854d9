"""Every engine query against its SQL."""

import math

import duckdb
import pytest

from veritab.plans import oracle, queries, run, stored

ORACLE, QUERIES = oracle.ORACLE | stored.ORACLE, queries.QUERIES | stored.QUERIES

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return round(float(value), 6) if math.isfinite(value) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    rel = duck.execute(ORACLE[name])
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, rel.fetchall())
    assert sorted(got.columns) == sorted(columns)
    have = rows_of(got.columns, got.collect())
    assert len(have) == len(want)
    assert have == want, [(a, b) for a, b in zip(have, want) if a != b][:3]


@pytest.mark.parametrize("name", [
    "presentation",
    "sources_page",
    "source_ids",
    "master_mode_region",
    "master_segment_winner",
    "method_tally",
    "unresolved_by_entity",
    "branch_lists",
])
def test_from_the_source(spark, duck, sf, monkeypatch, name):
    """What one pass over the rows can tell needs no written rows, and what sources alone tell no entities."""
    def never(*_, **__):
        raise AssertionError("rows are written, or entities made")

    monkeypatch.setattr(run, "stage", never)
    if "source" in name or name == "presentation":
        monkeypatch.setattr(run.entity, "with_entity", never)
    queries.forget()
    try:
        test_query(spark, duck, sf, name)
    finally:
        queries.forget()
