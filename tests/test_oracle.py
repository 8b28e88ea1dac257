"""Every registered query of the core against its SQL twin in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from hitwatch.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/**/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf_dir, duck, tmp_path):
    QUERIES[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE b AS {ORACLE[name]}")
    columns = [{r[0] for r in duck.execute(f"DESCRIBE {t}").fetchall()} for t in "ab"]
    assert columns[0] == columns[1]
    names = ", ".join(f'"{c}"' for c in sorted(columns[0]))
    assert duck.execute("SELECT count(*) FROM b").fetchall()[0][0] > 0
    for x, y in ("ab", "ba"):
        assert duck.execute(f"SELECT {names} FROM {x} EXCEPT ALL SELECT {names} FROM {y} LIMIT 3").fetchall() == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
