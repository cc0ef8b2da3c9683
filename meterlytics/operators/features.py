"""Model inputs from profile rows.

``build_features`` turns profile rows into ``(LCLid, day, reading, cond)``:
``reading`` is the readings array cut or zero-padded to the modal length;
``cond`` is one-hot weekday (7) + weekend (2) + season (4) followed by the
z-scored temperature and humidity (15 values). Every global statistic (modal
length, weekday range, means and population stds) is one aggregate pass
turned into a scalar subquery: no collect, no join of the fact rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONE_HOT = [("day_of_week", 7), ("is_weekend", 2), ("season", 4)]   # fixed order
NUMERIC = ["avg_temperature", "avg_humidity"]
COND_DIM = sum(n for _, n in ONE_HOT) + len(NUMERIC)


def encode_list(col: Column | str, sep: str = "|") -> Column:
    """V1: list -> pipe-joined text (NULL elements as ``None``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep, "None")


def decode_list(col: Column | str) -> Column:
    """V2: pipe-joined text -> list of doubles, dropping empty / ``none``."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.filter(F.split(c, r"\|"), lambda x: (x != "") & (F.lower(x) != "none"))
    return F.transform(parts, lambda x: x.cast("double"))


def modal_length(df: DataFrame, col: str = "hh_consumption") -> Column:
    """Most frequent array length; the smallest on a tie."""
    return df.select(F.mode(F.size(col), True)).scalar()


def pad_or_cut(col: Column | str, length: Column) -> Column:
    """V3: zero-pad at the end or cut to ``length``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.slice(F.concat(c, F.array_repeat(F.lit(0.0), length)), 1, length)


def one_hot(index: Column, n: int) -> Column:
    """V4 / Q23: one-hot of ``index`` clamped to [0, n-1]."""
    k = F.least(F.greatest(index, F.lit(0)), F.lit(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i == k, F.lit(1.0)).otherwise(F.lit(0.0)))


def weekend_index(df: DataFrame, col: str = "is_weekend") -> Column:
    """0/1 from a boolean, or from ``"true"`` / ``"false"`` text
    when the column arrives as text (e.g. from CSV)."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        low = F.lower(F.trim(c))
        return F.when(low == "true", 1).when(low == "false", 0).otherwise(c.cast("int"))
    return c.cast("int")


def _stats(df: DataFrame) -> Column:
    """One pass: modal array length, weekday range and, per numeric column,
    mean, population variance and counts (A25, A27, A28), as one struct
    scalar."""
    x = F.col("day_of_week")
    parts = [F.mode(F.size("hh_consumption"), True).alias("length"),
             F.min(x).alias("dow_min"), F.max(x).alias("dow_max"),
             F.count(F.lit(1)).alias("n")]
    for c in NUMERIC:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        parts += [F.avg(v).alias(f"{c}_mean"), F.var_pop(v).alias(f"{c}_var"),
                  F.count(v).alias(f"{c}_n")]
    return df.agg(*parts).select(F.struct("*")).scalar()


def zscore(col: str, st: Column) -> Column:
    """V5 / Q24: NaN/NULL -> column mean (0 if none), then centre and divide
    by the population std of the *filled* column (= sqrt(var * n_obs / n)),
    only centring when that std is below 1e-7."""
    mean = F.coalesce(st.getField(f"{col}_mean"), F.lit(0.0))
    v = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    filled = F.coalesce(v, mean)
    n_obs, n = st.getField(f"{col}_n"), st.getField("n")
    std = F.sqrt(F.coalesce(st.getField(f"{col}_var"), F.lit(0.0)) * n_obs / n)
    centred = filled - mean
    return F.when(std < 1e-7, centred).otherwise(centred / std)


def build_features(profiles: DataFrame, length: Column | int | None = None) -> DataFrame:
    """V6: ``LCLid, day, reading array<double>, cond array<double>(15)``.

    Scalar-subquery values are projected to plain columns first (Spark does
    not allow subqueries inside lambda functions)."""
    st = _stats(profiles)
    L = F.lit(length) if isinstance(length, int) else (
        length if length is not None else st.getField("length"))
    rebase = (st.getField("dow_min") >= 1) & (st.getField("dow_max") <= 7)     # Q22
    staged = profiles.select(
        "LCLid", "day", "hh_consumption", L.alias("_len"),
        (F.col("day_of_week") - F.when(rebase, F.lit(1)).otherwise(F.lit(0))).alias("_dow0"),
        weekend_index(profiles).alias("_weekend"),                             # Q25
        F.col("season").alias("_season"),
        *[zscore(c, st).alias(f"_z{i}") for i, c in enumerate(NUMERIC)])
    cond = F.concat(one_hot(F.col("_dow0"), 7), one_hot(F.col("_weekend"), 2),
                    one_hot(F.col("_season"), 4),
                    F.array(*[F.col(f"_z{i}") for i in range(len(NUMERIC))]))
    return staged.select("LCLid", "day",
                         pad_or_cut("hh_consumption", F.col("_len")).alias("reading"),
                         cond.alias("cond"))


@dataclass(frozen=True)
class FeatureSpec:
    """Frozen global statistics of a training table (for scoring new rows,
    e.g. a stream, exactly as the training rows were encoded)."""

    length: int
    dow_shift: int
    means: tuple[float, ...]
    stds: tuple[float, ...]


def fit_spec(profiles: DataFrame) -> FeatureSpec:
    """One aggregate pass; only its single row reaches the driver."""
    parts = [F.mode(F.size("hh_consumption"), True).alias("length"),
             F.min("day_of_week").alias("dmin"), F.max("day_of_week").alias("dmax"),
             F.count(F.lit(1)).alias("n")]
    for c in NUMERIC:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        parts += [F.avg(v).alias(f"{c}_m"), F.var_pop(v).alias(f"{c}_v"), F.count(v).alias(f"{c}_n")]
    r = profiles.agg(*parts).first()
    if r is None or r["n"] == 0:
        raise ValueError("cannot fit a feature spec on no rows")
    means, stds = [], []
    for c in NUMERIC:
        m = r[f"{c}_m"] if r[f"{c}_m"] is not None else 0.0
        var = (r[f"{c}_v"] or 0.0) * r[f"{c}_n"] / r["n"]
        means.append(float(m))
        stds.append(math.sqrt(float(var)))
    shift = 1 if (r["dmin"] is not None and r["dmin"] >= 1 and r["dmax"] <= 7) else 0
    return FeatureSpec(int(r["length"]), shift, tuple(means), tuple(stds))


def apply_spec(profiles: DataFrame, spec: FeatureSpec) -> DataFrame:
    """V6 with frozen statistics: row-local, so it also runs on a stream."""
    z = []
    for c, m, sd in zip(NUMERIC, spec.means, spec.stds):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        centred = F.coalesce(v, F.lit(m)) - F.lit(m)
        z.append(centred if sd < 1e-7 else centred / F.lit(sd))
    cond = F.concat(one_hot(F.col("day_of_week") - F.lit(spec.dow_shift), 7),
                    one_hot(weekend_index(profiles), 2), one_hot(F.col("season"), 4),
                    F.array(*z))
    return profiles.select("LCLid", "day", pad_or_cut("hh_consumption", F.lit(spec.length)).alias("reading"),
                           cond.alias("cond"))


def micro_text(col: Column | str) -> Column:
    """Array as text of whole millionths, ``round(x * 1e6)`` (a format that
    prints identically in every engine; for value comparison only)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(
        F.transform(c, lambda x: F.round(x * F.lit(1e6)).cast("long").cast("string")), "|")
