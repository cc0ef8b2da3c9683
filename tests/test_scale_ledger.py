"""The ledger's query: only its own source is copied, readings are added plainly."""

import os

from pyspark.sql import functions as F

from meterlytics.plans import registry as R
from meterlytics.sources import catalog


def test_ledger_rows_copy_their_source_alone(spark, scratch):
    sf = os.path.join(scratch, "sf")
    orders = [(k, k % 40, f"199{5 + k % 3}-01-{1 + k % 28:02d}") for k in range(400)]
    spark.createDataFrame([(k, k % 3) for k in range(40)], "c_custkey long, c_nationkey long").write.parquet(f"{sf}/customer.parquet")
    (spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string")
     .select("o_orderkey", "o_custkey", F.col("d").cast("timestamp").alias("o_orderdate")).write.parquet(f"{sf}/orders.parquet"))
    spark.createDataFrame([(1, 2.0)], "l_orderkey long, l_quantity double").write.parquet(f"{sf}/lineitem.parquet")
    spark.conf.set("spark.meterlytics.store", os.path.join(scratch, "own"))
    try:
        got = R.ledger_rows(spark, sf)
        s = catalog.load_sources(spark, sf)
        assert sorted(n for n in os.listdir(s.root) if n != "results") == ["half_hourly"]
        slots = F.array(*[F.col(f"hh_{i}") for i in range(48)])
        want = s.half_hourly.select("LCLid", "day", "year", F.size(F.filter(slots, lambda x: x.isNotNull())).alias("n"),
                                    F.aggregate(slots, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"))
        assert got.dtypes == want.dtypes and got.count() == want.count() and got.exceptAll(want).count() == 0
        assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert R.csv_households(spark, sf).count() == 40
    finally:
        spark.conf.unset("spark.meterlytics.store")
