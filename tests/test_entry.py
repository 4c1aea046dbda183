"""Every registered query of the archive engine against its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from marlstone import plans

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return out


def plain(rows):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_sql(spark, con, name):
    found = plans.queries()[name](spark, DATA)
    names = sorted(found.columns)
    want = con.sql(plans.oracle_sql()[name])
    assert names == sorted(want.columns)
    assert plain(map(tuple, found.select(*names).collect())) == plain(want.select(*[f'"{n}"' for n in names]).fetchall())


def test_types_beyond_unsigned_64_bits(spark, tmp_path):
    """Keys around the last one whose sum fits 64 bits, and of a table 60 times sf0.1."""
    keys = [0, 551_614, 551_615, 551_616, 1_199_999]
    duckdb.sql(f"COPY (SELECT p.* REPLACE (k AS p_partkey) FROM (SELECT unnest({keys}::BIGINT[]) AS k), (SELECT * FROM '{DATA}/part.parquet' LIMIT 5) p) TO '{tmp_path}/part.parquet'")
    found = plans.queries()["archive_types"](spark, str(tmp_path))
    names = sorted(found.columns)
    part = duckdb.connect()
    part.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = part.sql(plans.oracle_sql()["archive_types"])
    assert names == sorted(want.columns)
    assert plain(map(tuple, found.select(*names).collect())) == plain(want.select(*[f'"{n}"' for n in names]).fetchall())
    assert {"18446744073709551615", "18446744073709551616"} <= {r.unsigned for r in found.collect()}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
