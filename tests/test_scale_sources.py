"""Sources on demand, and derivations whose work stays small per row."""

import os

from pyspark.sql import functions as F

from meterlytics.sources import catalog, fixtures
from meterlytics.session import compile_methods


def driver_tables(spark, folder):
    """Orders of three customers; (1, 1995-01-01) has two orders, one of them
    with a null quantity, (2, 1996-02-03) an order without a known quantity."""
    orders = [(1, 1, "1995-01-01"), (2, 1, "1995-01-01"), (3, 2, "1996-02-03"), (4, None, "1996-02-03"), (5, 3, "1997-05-01")]
    lines = [(1, 4.0), (1, 1.0), (2, 9.0), (2, None), (2, 2.0), (3, None), (4, 5.0), (5, 1.0), (5, 3.0), (5, 8.0)]
    spark.createDataFrame([(k, k % 3) for k in (1, 2, 3)], "c_custkey long, c_nationkey long").write.parquet(f"{folder}/customer.parquet")
    (spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string")
     .select("o_orderkey", "o_custkey", F.col("d").cast("timestamp").alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")


def test_a_source_is_made_when_it_is_asked_for(spark, scratch):
    sf = os.path.join(scratch, "sf")
    driver_tables(spark, sf)
    spark.conf.set("spark.meterlytics.store", os.path.join(scratch, "own"))
    try:
        s = catalog.load_sources(spark, sf)
        assert s.bound("households") >= 3 and s.row_count("daily") is None
        assert sorted(os.listdir(s.root)) == ["households"]
        assert s.ready("half_hourly", "holidays") is s and sorted(os.listdir(s.root)) == ["half_hourly", "holidays", "households"]
        assert s.half_hourly.count() == 4 and s.half_hourly is catalog.load_sources(spark, sf).half_hourly
        plain = fixtures.half_hourly(spark, sf)
        assert s.half_hourly.drop("year").exceptAll(plain).count() == 0 and s.half_hourly.where("year <> substring(day, 1, 4)").count() == 0
    finally:
        spark.conf.unset("spark.meterlytics.store")


def test_daily_median_by_place_is_the_median(spark, scratch):
    sf = os.path.join(scratch, "sf")
    driver_tables(spark, sf)
    got = fixtures.daily(spark, sf)
    o, li = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    want = (o.join(li, o.o_orderkey == li.l_orderkey).groupBy(fixtures._lclid(F.col("o_custkey")).alias("LCLid"),
                                                            F.col("o_orderdate").cast("date").cast("string").alias("day"))
            .agg(F.median("l_quantity").alias("energy_median"), F.count("l_quantity").alias("energy_count")))
    assert got.count() == 4 and got.select(*want.columns).exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_huge_methods_are_left_to_split_expressions(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        compile_methods(spark)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "9000")
        compile_methods(spark)
        assert spark.conf.get(key) == "9000"
    finally:
        spark.conf.set(key, was or "8000")
