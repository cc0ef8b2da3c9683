"""Exact quantiles by distributed selection, for values with few repeats.

``percentile`` keeps one entry per distinct value of a group, which for
continuous readings is the group itself. Here a rank is found by narrowing: a
first pass counts values per bucket of a logarithmic scale over all doubles;
each further pass splits the buckets that hold a wanted rank, by their least
and greatest value, and counts again. A pass is one partial/final aggregate
with at most ``BUCKETS`` counters per group and rank; rows are never shuffled
or gathered. After the first pass a bucket's values are within a factor of 1.5,
so four further passes reach single doubles; most data need two or three.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_root
from .joins import bounded_broadcast

BUCKETS = 8192
#: log2 of the doubles lies within this range of 0, shifted to stay above it
LOG_SPAN = 1100
MAX_PASSES = 8


def _log_bucket(v):
    """Bucket that never decreases with the value: -inf, negatives, zero, positives, inf, NaN."""
    place = F.floor((F.log2(F.abs(v)) + LOG_SPAN) * (BUCKETS / (4 * LOG_SPAN)))
    top = F.lit(BUCKETS).cast("long")
    return (F.when(F.isnan(v), top + 1).when(v == float("inf"), top).when(v == float("-inf"), -top)
            .when(v == 0, F.lit(0).cast("long")).when(v > 0, place + 1).otherwise(-place - 1))


def _located(hist: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """For every rank, the bucket of its histogram that holds it."""
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]
    at = F.col("r._rank") - F.col("r._below")
    inside = (at >= F.col("h._before")) & (at < F.col("h._before") + F.col("h._n"))
    on = inside
    for m in match:
        on = on & m
    keys = [c for c in by if c not in ("_lo", "_hi")]
    return (ranks.alias("r").join(hist.alias("h"), on)
            .select(*[F.col(f"r.{c}") for c in keys], F.col("r._rank"),
                    (F.col("r._below") + F.col("h._before")).alias("_below"), F.col("h._least").alias("_lo"), F.col("h._most").alias("_hi")))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), out: str = "quantiles",
                    total: str | None = None) -> DataFrame:
    """``keys`` and ``out``, the quantiles of ``value`` (array in the order of
    ``probs``, interpolated like ``percentile``); nulls are left out, NaN is the
    greatest value, a null key is a group; ``total`` names a column for the
    number of values. Without ``keys`` one row; no row for no values.

    Groups times ranks should be bounded (pattern keys, a whole table): they
    are the state of a pass, and go to the rows by a broadcast if they are few."""
    shared_root(df.sparkSession)
    keys = list(keys) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    counted = [F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")]
    hist = rows.groupBy(*keys, _log_bucket(F.col("_v")).alias("_b")).agg(*counted).checkpoint()
    sizes = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    place = [(F.lit(float(p)) * (F.col("_total") - 1)) for p in probs]
    wanted = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    ranks = sizes.select(*keys, F.explode(wanted).alias("_rank"), F.lit(0).cast("long").alias("_below"))
    found = _located(hist, ranks, keys).checkpoint()
    for _ in range(MAX_PASSES):
        open_ = found.where("_lo < _hi")
        n = open_.count()
        if not n:
            break
        spans = open_.select(*keys, "_lo", "_hi").distinct()
        on = (F.col("v._v") >= F.col("s._lo")) & (F.col("v._v") <= F.col("s._hi"))
        for k in keys:
            on = on & F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
        width = F.col("_hi") - F.col("_lo")
        hist = (rows.alias("v").join(bounded_broadcast(spans, n).alias("s"), on)
                .select(*[F.col(f"v.{k}") for k in keys], "_lo", "_hi", "_v")
                .groupBy(*keys, "_lo", "_hi", F.floor((F.col("_v") - F.col("_lo")) / width * BUCKETS).alias("_b")).agg(*counted))
        found = found.where("not (_lo < _hi)").unionByName(
            _located(hist, open_, [*keys, "_lo", "_hi"])).checkpoint()
    else:
        raise RuntimeError("quantiles did not close")
    value_at = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = on[0]
    for x in on[1:]:
        both = both & x
    cols = []
    for p in place:
        low, high = F.floor(p).cast("long"), F.ceil(p).cast("long")
        a, b = F.col("_at")[low], F.col("_at")[high]
        cols.append(F.when(a == b, a).otherwise((high - p) * a + (p - low) * b))
    res = sizes.alias("a").join(value_at.alias("b"), both).select(
        *[F.col(f"a.{k}") for k in keys if k != "_all"], F.array(*cols).alias(out),
        *([F.col("_total").alias(total)] if total else []))
    return res
