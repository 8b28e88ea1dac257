"""Queries with SQL twins, and the registry."""

import duckdb
import pytest

import __spark_entry__ as entry
from hitwatch.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, tmp_path):
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    con.execute(f"CREATE TABLE a AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    con.execute(f"CREATE TABLE b AS {ORACLE[name]}")
    names = ", ".join(sorted(r[0] for r in con.execute("DESCRIBE a").fetchall()))
    for x, y in ("ab", "ba"):
        assert con.execute(f"SELECT {names} FROM {x} EXCEPT ALL SELECT {names} FROM {y} LIMIT 3").fetchall() == []


def test_registry():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(ORACLE) <= set(names)
