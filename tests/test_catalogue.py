"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from newsloom.plans import flows, parsing  # noqa: F401  add their queries
from newsloom.plans.catalogue import ORACLE_SQL, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["greedy_distinct", "signal_dedup", "greedy_quota", "block_selection"])
def test_rows_do_not_depend_on_partitions(spark, sf_dir, name, monkeypatch):
    from newsloom.plans import catalogue

    first = rows(QUERIES[name](spark, sf_dir).toPandas())
    plain = catalogue.table
    monkeypatch.setattr(catalogue, "table", lambda s, d, n: plain(s, d, n).repartition(7))
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == first
