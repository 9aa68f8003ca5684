"""Places equally near to the places of a round distance, whose last bits differ, against the SQL."""

import duckdb
import pytest

from tidemark import plans

plans.load()

PARTS, SPOTS = [35983, 64817, 25033, 52081], [1500, 4515]


def tables(spark, path, parts, spots):
    part = spark.createDataFrame([(k, f"Brand#{k % 25}", k % 50 + 1) for k in parts], "p_partkey long, p_brand string, p_size int")
    part.write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(k, f"Supplier#{k}") for k in spots], "s_suppkey long, s_name string").write.parquet(f"{path}/supplier.parquet")
    duck = duckdb.connect()
    for name in ("part", "supplier"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), duck


@pytest.mark.parametrize("name", ["calibration_percentile", "calibration_summary"])
def test_ties_of_calibration(spark, tmp_path, name):
    path, duck = tables(spark, tmp_path, PARTS, SPOTS)
    got = plans.QUERIES[name](spark, path)
    want = duck.execute(plans.SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(*order).collect()) == sorted(want.fetchall())


def test_ties_of_capped_places(spark, tmp_path):
    path, duck = tables(spark, tmp_path, [538, 4058, 5528], [2053, 3553, 423, 1923, 1693, 3193])
    want = duck.execute(plans.SQL["nearest_capped"])
    order = [d[0] for d in want.description]
    got = plans.QUERIES["nearest_capped"](spark, path).select(*order)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
