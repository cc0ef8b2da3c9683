"""Household-segment second stage.

These run on the household result (one row per tariff x ACORN category) but
are plain DataFrame operators, so they also run unchanged on household-level
input with millions of rows: global quantile edges come from a scalar
subquery (one row, evaluated once and inlined by Spark), densification uses
``explode`` of the label list per observed group (no join of unbounded
sides), and shares use a window partitioned by the (few) quantile labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import QUANTILE_SCHEMES
from .quantiles import exact_quantiles


def filter_segments(df: DataFrame, tariffs: Sequence[str] | None = None,
                    acorns: Sequence[str] | None = None) -> DataFrame:
    """``stdorToU IN tariffs`` and ``Acorn IN acorns``; empty = all."""
    if tariffs:
        df = df.where(F.col("stdorToU").isin(list(tariffs)))
    if acorns:
        df = df.where(F.col("Acorn").isin(list(acorns)))
    return df


def segment_points(df: DataFrame) -> DataFrame:
    """Columns of the bubble / scatter views, no aggregation."""
    return df.select("Acorn_grouped", "stdorToU", "energy_mean", "energy_max",
                     "energy_median", "household_count", "days_count")


def tariff_overall(df: DataFrame, metric: str = "energy_mean") -> DataFrame:
    """A10: per tariff, unweighted mean of the metric over segment rows (Q32)
    plus total households and days."""
    return (df.groupBy("stdorToU")
              .agg(F.avg(metric).alias(metric),
                   F.sum("household_count").alias("household_count"),
                   F.sum("days_count").alias("days_count")))


def acorn_ranking(df: DataFrame, metric: str = "energy_mean") -> DataFrame:
    """Per ACORN group, mean metric and households, descending with
    NULLs first (Q30)."""
    return (df.groupBy("Acorn_grouped")
              .agg(F.avg(metric).alias(metric),
                   F.sum("household_count").alias("household_count"))
              .orderBy(F.desc_nulls_first(metric)))


def _n_unique_with_null(c: str) -> Column:
    """Q34: distinct count where NULL counts as one more value."""
    return (F.count_distinct(c)
            + F.coalesce(F.max(F.when(F.col(c).isNull(), 1).otherwise(0)), F.lit(0))).cast("long")


def segment_kpis(df: DataFrame) -> DataFrame:
    """The four headline figures in one pass."""
    return df.agg(F.coalesce(F.sum("household_count"), F.lit(0)).cast("long").alias("total_households"),
                  _n_unique_with_null("stdorToU").alias("tariff_types"),
                  _n_unique_with_null("Acorn_grouped").alias("acorn_groups"),
                  F.avg("energy_mean").alias("avg_energy"))


def _labels_frame(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per label with its position (a tiny literal list)."""
    return df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(lab) for lab in labels])).alias("order", "quantile_group"))


def quantile_edges(df: DataFrame, metric: str, quantiles: Sequence[float],
                   approx: bool = False, continuous: bool = False) -> Column:
    """W2 edges: linear-interpolation quantiles of ``metric`` (pandas / DuckDB
    ``quantile_cont`` agree) as a lazily evaluated scalar subquery.

    The exact form keeps one value->count map of the metric's distinct values
    in the final task; ``approx=True`` uses the mergeable, fixed-size
    ``percentile_approx`` sketch instead (for household-level inputs with
    millions of distinct values), and ``continuous=True`` the exact selection of
    ``quantiles``, whose state does not grow with the distinct values."""
    if continuous:
        return exact_quantiles(df, metric, [float(q) for q in quantiles]).select("quantiles").scalar()
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    x = F.col(metric).cast("double")
    agg = F.percentile_approx(x, qs, 100_000) if approx else F.percentile(x, qs)
    return df.select(agg).scalar()


def quantile_groups(df: DataFrame, metric: str = "energy_mean",
                    n_groups: int = 3, approx: bool = False, continuous: bool = False) -> DataFrame:
    """Label each row with its quantile bucket (right-closed, lowest value
    included; ties share a bucket, unlike ``ntile``). Repeated edges raise
    (Q26), as ``qcut`` does."""
    quantiles, labels = QUANTILE_SCHEMES[n_groups]
    edges = quantile_edges(df, metric, quantiles, approx, continuous)
    x = F.col(metric)
    n = len(labels)
    label = None
    for i in range(n):
        cond = x <= F.element_at(edges, i + 2)
        label = F.when(cond, labels[i]) if label is None else label.when(cond, labels[i])
    label = label.otherwise(F.lit(None).cast("string"))
    increasing = F.lit(True)
    for i in range(n):
        increasing = increasing & (F.element_at(edges, i + 1) < F.element_at(edges, i + 2))
    checked = F.when(x.isNull(), F.lit(None).cast("string")).when(
        ~increasing, F.raise_error(F.lit("quantile bin edges must be unique")).cast("string")
    ).otherwise(label)
    return df.withColumn("quantile_group", checked)


def consumer_groups(df: DataFrame, metric: str = "energy_mean", n_groups: int = 3,
                    approx: bool = False, continuous: bool = False) -> DataFrame:
    """Per quantile label (every label, even empty, Q28): mean
    of four metrics, total households, ToU share text ``"12.3% ToU"`` with
    half-even rounding (Q29); ordered by label position."""
    _, labels = QUANTILE_SCHEMES[n_groups]
    g = quantile_groups(df, metric, n_groups, approx, continuous).where(F.col("quantile_group").isNotNull())
    summary = g.groupBy("quantile_group").agg(
        F.avg("energy_mean").alias("energy_mean"), F.avg("energy_median").alias("energy_median"),
        F.avg("energy_max").alias("energy_max"), F.avg("energy_sum").alias("energy_sum"),
        F.sum("household_count").alias("household_count"),
        F.avg(F.when(F.col("stdorToU") == "ToU", 100.0).otherwise(0.0)).alias("_tou"))
    dense = _labels_frame(df, labels).join(summary, "quantile_group", "left")
    tou = F.bround(F.col("_tou"), 1)
    return (dense.select(
                "quantile_group", "energy_mean", "energy_median", "energy_max", "energy_sum",
                F.coalesce(F.col("household_count"), F.lit(0)).cast("long").alias("household_count"),
                F.concat(F.coalesce(tou.cast("string"), F.lit("nan")), F.lit("% ToU")).alias("stdorToU"),
                F.col("order").cast("int").alias("order"))
            .orderBy("order"))


def metrics_long(groups: DataFrame) -> DataFrame:
    """Wide to long over mean and median for the grouped bar view."""
    return groups.unpivot(["quantile_group", "order"], ["energy_mean", "energy_median"],
                          "variable", "value")


def consumer_group_mix(df: DataFrame, metric: str = "energy_mean", n_groups: int = 3,
                       approx: bool = False) -> DataFrame:
    """Rows per (quantile label, ACORN group), densified
    with zero counts, share of the label's rows (half-even to 1 place; NULL
    when the label is empty), ordered by label, share descending, group."""
    _, labels = QUANTILE_SCHEMES[n_groups]
    g = quantile_groups(df, metric, n_groups, approx).where(F.col("quantile_group").isNotNull())
    counts = g.groupBy("quantile_group", "Acorn_grouped").agg(F.count(F.lit(1)).alias("count"))
    grid = (df.select("Acorn_grouped").distinct()
              .select("Acorn_grouped",
                      F.posexplode(F.array(*[F.lit(lab) for lab in labels])).alias("order", "quantile_group")))
    dense = (grid.join(counts, ["quantile_group", "Acorn_grouped"], "left")
                 .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long")))
    total = F.sum("count").over(Window.partitionBy("quantile_group"))
    pct = F.bround(F.try_divide(F.col("count"), total) * 100, 1)
    return (dense.select("quantile_group", "Acorn_grouped", "count", pct.alias("percentage"),
                         F.col("order").cast("int").alias("order"))
                 .orderBy("order", F.desc_nulls_last("percentage"), "Acorn_grouped"))


def segment_hierarchy(df: DataFrame, metric: str = "energy_mean") -> DataFrame:
    """ACORN group -> tariff hierarchy with household totals and the
    household-weighted mean metric at both levels (grouping sets)."""
    hc = F.col("household_count")
    return (df.groupingSets([["Acorn_grouped"], ["Acorn_grouped", "stdorToU"]],
                            "Acorn_grouped", "stdorToU")
              .agg(F.sum(hc).alias("household_count"),
                   F.try_divide(F.sum(F.col(metric) * hc), F.sum(hc)).alias(metric),
                   F.grouping_id().alias("_gid"))
              .select("Acorn_grouped", "stdorToU",
                      F.when(F.col("_gid") == 0, "tariff").otherwise("group").alias("level"),
                      "household_count", metric)
              .orderBy("Acorn_grouped", F.asc_nulls_first("stdorToU")))
