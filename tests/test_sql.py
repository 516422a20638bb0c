"""Queries against their SQL on a small input."""

import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def against_sql(spark, name):
    """Rows of the query and of its SQL, sorted; floats are compared to nine digits."""
    got = queries()[name](spark, SF)
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted((tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows))
    return plain(got.select(*columns).collect()), plain(want.fetchall())


@pytest.mark.parametrize("name", ["accuracy_gate", "bim_walls"])
def test_query_is_its_sql(spark, name):
    got, want = against_sql(spark, name)
    assert got == want and got


def test_bim_relations_come_from_one_reading_of_the_walls(spark):
    assert "Window" not in queries()["bim_walls"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
