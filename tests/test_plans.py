"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import datetime
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

if not os.path.isdir(FOLDER):
    pytest.skip("no tables here", allow_module_level=True)

duckdb = pytest.importorskip("duckdb")

from tidemark import plans  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return x + 0.0
        return str(x) if isinstance(x, datetime.datetime) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, con, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.sql(plans.SQL[name]).select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_give_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


def test_slaney_halves_round_as_in_sql(spark, tmp_path):
    """Prices whose place on the scale ends in half a hundredth."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS l_orderkey, 1::INT AS l_linenumber, (i * 690 / 100.0)::DOUBLE AS l_extendedprice FROM range(1, 3100) t(i)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = plans.QUERIES["signal_slaney_mel"](spark, str(tmp_path)).select("l_orderkey", "mel", "back").collect()
    assert plain(got) == plain(con.sql(f"SELECT l_orderkey, mel, back FROM ({plans.SQL['signal_slaney_mel']})").fetchall())
