"""Meter tables derived from the driver's TPC-H-style Parquet (FIXTURES.md §3).

The reference reads six CSV sources that are not shipped. These functions
build tables with exactly those schemas from ``customer``, ``orders`` and
``lineitem`` so that every query's work grows with the driver's scale factor.
The same derivations exist as SQL text in ``plans.oracle`` for DuckDB.

Plan notes: ``hd`` and ``daily`` are the only shuffles (group by customer and
date); the median of ``daily`` is taken by place in the sorted group (two windows
and the aggregate share one exchange; ``median`` itself keeps a map per group and
sends it serialised); the 48 reading columns are computed in one projection; the hourly
weather grid is ``explode(sequence(0, 23))`` over the distinct dates, not a
join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import PARTITION_YEAR, year_from_text
from ..schemas import N_SLOTS

EVENING_SLOTS = range(34, 42)   # fixed value: slots that get +48/64 kWh


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lclid(key: Column) -> Column:
    """Six digits at least; longer keys keep all of theirs (``lpad`` alone
    would cut them and merge households)."""
    text = key.cast("string")
    return F.concat(F.lit("MAC"), F.when(F.length(text) > 6, text).otherwise(F.lpad(text, 6, "0")))


def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    grp = F.col("c_nationkey") % 17
    return c.select(
        _lclid(F.col("c_custkey")).alias("LCLid"),
        F.when(F.col("c_custkey") % 5 == 0, "ToU").otherwise("Std").alias("stdorToU"),
        F.concat(F.lit("ACORN-"), F.expr("chr(CAST(65 + c_nationkey % 17 AS INT))")).alias("Acorn"),
        F.when(grp < 5, "Affluent").when(grp < 10, "Comfortable")
         .otherwise("Adversity").alias("Acorn_grouped"),
        # in every third block the Adversity households have a file of their
        # own, so that some files hold no household of the other groups
        F.concat(F.lit("block_"), F.floor(F.col("c_custkey") / 50).cast("long").cast("string"),
                 F.when((grp >= 10) & (F.floor(F.col("c_custkey") / 50) % 3 == 0), "a").otherwise("")).alias("file"),
    )


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hd``: one row per (customer, order date) with the smallest order key."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return (o.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("d"))
             .agg(F.min("o_orderkey").alias("k")))


def half_hourly(spark: SparkSession, sf_dir: str, by_year: bool = False) -> DataFrame:
    """``by_year`` adds the year and orders the partitions by it while the rows are
    still narrow, so that writing folders per year sorts no row of 48 readings."""
    hd = _order_days(spark, sf_dir)
    last = []
    if by_year:
        hd = hd.withColumn(PARTITION_YEAR, year_from_text(F.col("d").cast("string"))).sortWithinPartitions(PARTITION_YEAR)
        last = [PARTITION_YEAR]
    k = F.col("k")
    slots = []
    for i in range(N_SLOTS):
        raw = (k * 31 + 17 * i) % 64
        if i in EVENING_SLOTS:
            raw = raw + 48
        slots.append(F.when((k + 3 * i) % 29 == 0, F.lit(None).cast("double"))
                      .otherwise(raw.cast("double") / F.lit(64.0)).alias(f"hh_{i}"))
    return hd.select(_lclid(F.col("o_custkey")).alias("LCLid"),
                     F.col("d").cast("string").alias("day"), *slots, *last)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    q = F.col("l_quantity")
    group = Window.partitionBy("o_custkey", "d")
    # the one or two values in the middle of a group's n values (no null among them)
    middle = F.col("at").between(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))
    return (o.join(li, o.o_orderkey == li.l_orderkey)
             .select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), "l_quantity")
             .withColumn("at", F.row_number().over(group.orderBy(F.asc_nulls_last("l_quantity"))))
             .withColumn("n", F.count(q).over(group))
             .groupBy("o_custkey", "d")
             .agg(F.avg(F.when(middle, q)).alias("energy_median"), F.avg(q).alias("energy_mean"),
                  F.max(q).alias("energy_max"), F.count(q).alias("energy_count"),
                  F.round(F.stddev_samp(q), 6).alias("energy_std"),
                  F.sum(q).alias("energy_sum"), F.min(q).alias("energy_min"))
             .select(_lclid(F.col("o_custkey")).alias("LCLid"),
                     F.col("d").cast("string").alias("day"),
                     "energy_median", "energy_mean", "energy_max", "energy_count",
                     "energy_std", "energy_sum", "energy_min"))


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderdate")
    return o.select(F.col("o_orderdate").cast("date").alias("d")).distinct()


def _temp_base(d: Column) -> Column:
    return (F.dayofyear(d) * 7 + F.year(d)) % 34 - 6


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    doy = F.dayofyear(d)
    dates = _dates(spark, sf_dir)
    main = dates.select(
        F.concat(d.cast("string"), F.lit(" 00:00:00")).alias("time"),
        F.when(doy % 50 == 0, F.lit(None).cast("double"))
         .otherwise(_temp_base(d).cast("double")).alias("temperatureMin"),
        (_temp_base(d) + doy % 9).cast("double").alias("temperatureMax"),
        (((doy * 13) % 60 + 40).cast("double") / F.lit(128.0)).alias("humidity"))
    extra = dates.where(doy % 97 == 0).select(
        F.concat(d.cast("string"), F.lit(" 12:00:00")).alias("time"),
        F.lit(10.0).alias("temperatureMin"), F.lit(14.0).alias("temperatureMax"),
        F.lit(0.5).alias("humidity"))
    return main.unionByName(extra)


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, h = F.col("d"), F.col("h")
    doy = F.dayofyear(d)
    grid = _dates(spark, sf_dir).select("d", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    return grid.select(
        F.concat(d.cast("string"), F.lit(" "), F.lpad(h.cast("string"), 2, "0"),
                 F.lit(":00:00")).alias("time"),
        F.when((doy + h) % 41 == 0, F.lit(None).cast("double"))
         .otherwise((_temp_base(d) + h % 12).cast("double")).alias("temperature"),
        (((doy * 13 + h * 5) % 60 + 40).cast("double") / F.lit(128.0)).alias("humidity"))


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    m, dom = F.month(d), F.dayofmonth(d)
    hit = (((m == 1) & (dom == 1)) | ((m == 12) & dom.isin(25, 26))
           | ((m == 5) & (dom == 1)))
    return _dates(spark, sf_dir).where(hit).select(d.cast("string").alias("holiday"))


BUILDERS = {
    "households": households,
    "half_hourly": half_hourly,
    "daily": daily,
    "weather_daily": weather_daily,
    "weather_hourly": weather_hourly,
    "holidays": holidays,
}

# Driver tables each derived table reads (for the source fingerprint).
INPUTS = {
    "households": ["customer"],
    "half_hourly": ["orders"],
    "daily": ["orders", "lineitem"],
    "weather_daily": ["orders"],
    "weather_hourly": ["orders"],
    "holidays": ["orders"],
}
