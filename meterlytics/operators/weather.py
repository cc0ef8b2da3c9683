"""Weather second stage.

Inputs are the temperature results (A7 / A8); global figures (histogram
range, correlation) are single aggregates or scalar subqueries, never a
collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import temp_bin_order
from ..schemas import TEMP_BINS
from .quantiles import exact_quantiles


def filter_weather(df: DataFrame, months: Sequence[int] | None = None,
                   temp_bins: Sequence[str] | None = None) -> DataFrame:
    """``month IN months`` and ``temp_bin IN bins``; empty = all."""
    if months and "month" in df.columns:
        df = df.where(F.col("month").isin([int(m) for m in months]))
    if temp_bins and "temp_bin" in df.columns:
        df = df.where(F.col("temp_bin").isin(list(temp_bins)))
    return df


def temp_bin_summary(te: DataFrame) -> DataFrame:
    """Per known bin: rows, min / max / mean of the bin rows'
    mean temperature, in bin order."""
    return (te.where(F.col("temp_bin").isin(TEMP_BINS))
              .groupBy("temp_bin")
              .agg(F.count(F.lit(1)).alias("count"),
                   F.min("avg_temperature").alias("min_temp"),
                   F.max("avg_temperature").alias("max_temp"),
                   F.avg("avg_temperature").alias("avg_temp"))
              .orderBy(temp_bin_order("temp_bin")))


def temp_box(te: DataFrame, metric: str = "energy_mean", approx: bool = False,
             continuous: bool = False) -> DataFrame:
    """Box-plot figures per (bin, month): linear-interpolation quartiles
    and whiskers at the most extreme values within 1.5 IQR. ``approx=True``
    uses ``percentile_approx`` (bounded sketch) for large groups,
    ``continuous=True`` the exact selection of ``quantiles``."""
    keys = ["temp_bin", "month_name"]
    levels = (0.0, 0.25, 0.5, 0.75, 1.0)
    probs = F.array(*[F.lit(p) for p in levels])
    pct = (F.percentile_approx(F.col(metric), probs, 100_000) if approx
           else F.percentile(F.col(metric), probs))
    q = (te.groupBy(*keys)
           .agg(*([] if continuous else [pct.alias("_q")]),
                F.count(F.col(metric)).alias("n")))
    if continuous:
        q = q.join(exact_quantiles(te, metric, levels, keys, "_q"), keys, "left")
    q = q.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in
                              enumerate(["q_min", "q1", "median", "q3", "q_max"])])
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    x = F.col(metric)
    whiskers = (te.select(*keys, metric).join(q, keys)
                  .groupBy(*keys)
                  .agg(F.min(F.when(x >= lo, x)).alias("lower_whisker"),
                       F.max(F.when(x <= hi, x)).alias("upper_whisker")))
    return (q.join(whiskers, keys)
             .orderBy(temp_bin_order("temp_bin"), "month_name"))


def temp_histogram(te: DataFrame, column: str = "avg_temperature", bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max]; the maximum goes to the
    last bucket; every bucket is listed, empty ones with 0."""
    x = F.col(column)
    stats = te.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rng = stats.select(F.struct("lo", "hi")).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    width = hi - lo
    bucket = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((x - lo) * bins / width).cast("int") + 1, F.lit(bins)))
    counts = (te.where(x.isNotNull()).groupBy(bucket.alias("bucket"))
                .agg(F.count(F.lit(1)).alias("count")))
    grid = stats.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bucket"), "lo", "hi")
    b = F.col("bucket")
    return (grid.join(counts, "bucket", "left")
                .select("bucket",
                        (F.col("lo") + ((b - 1) * (F.col("hi") - F.col("lo"))) / bins).alias("bin_start"),
                        (F.col("lo") + (b * (F.col("hi") - F.col("lo"))) / bins).alias("bin_end"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
                .orderBy("bucket"))


def hour_temp_pivot(th: DataFrame) -> DataFrame:
    """Mean energy, hours down, temperature bins across (explicit pivot
    values: no extra pass to discover them)."""
    return (th.groupBy("hour").pivot("temp_bin", TEMP_BINS).agg(F.avg("energy"))
              .orderBy("hour"))


def peak_hour(th: DataFrame) -> DataFrame:
    """Hour with the highest mean energy (first hour on ties)."""
    return (th.groupBy("hour").agg(F.avg("energy").alias("energy"))
              .orderBy(F.desc("energy"), F.asc("hour")).limit(1))


def humidity_corr(th: DataFrame) -> DataFrame:
    """Pearson correlation of energy and humidity over the rows."""
    return th.agg(F.corr("energy", "avg_humidity").alias("humidity_corr"))


def weather_kpis(th: DataFrame) -> DataFrame:
    """A17 + A19: mean of the rows' mean temperature, distinct bins."""
    return th.agg(F.avg("avg_temperature").alias("avg_temperature"),
                  F.count_distinct("temp_bin").alias("temp_ranges"))
