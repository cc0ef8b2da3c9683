"""Calendar, season, weekend and temperature-bin expressions.

All functions return ``Column`` expressions built from ``pyspark.sql.functions``
so that they stay inside whole-stage codegen; nothing here runs Python per row.
Two words have two meanings in the reference and keep two functions here:
weekend (Sat/Sun vs Fri/Sat/Sun) and season (ISO-week seasons vs month code).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONTH_NAMES, TEMP_BIN_UPPER, TEMP_BINS, WEEKDAY_NAMES

DATE_FMT = "yyyy-MM-dd"
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def year_from_text(day: Column | str) -> Column:
    """Characters 1-4 of a ``YYYY-MM-DD`` string as INT (Q35)."""
    return F.substring(_c(day), 1, 4).cast("int")


def parse_date(day: Column | str) -> Column:
    """Strict ``yyyy-MM-dd`` parse; malformed text raises under ANSI (Q33)."""
    return F.to_date(_c(day), DATE_FMT)


def parse_timestamp(text: Column | str) -> Column:
    """C4: naive timestamp (no session-zone shift)."""
    return F.to_timestamp_ntz(_c(text), F.lit(TS_FMT))


def iso_weekday(d: Column | str) -> Column:
    """1 = Monday .. 7 = Sunday (Q7)."""
    return F.weekday(_c(d)) + 1


def iso_week(d: Column | str) -> Column:
    """ISO week number, paired with the *calendar* year by callers (Q6)."""
    return F.weekofyear(_c(d))


def weekday_name(weekday: Column | str) -> Column:
    """English weekday name for 1..7."""
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), _c(weekday))


def month_name(month: Column | str) -> Column:
    """English month name for 1..12 (not ``date_format``: locale bound)."""
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), _c(month))


def week_season(week: Column | str) -> Column:
    """C11 / Q8: season from the ISO week: 1-9 and 49-53 Winter, 10-22 Spring,
    23-35 Summer, 36-48 Fall."""
    w = _c(week)
    return (F.when(w.between(1, 9), "Winter").when(w.between(10, 22), "Spring")
            .when(w.between(23, 35), "Summer").when(w.between(36, 48), "Fall")
            .when(w.between(49, 53), "Winter").otherwise("Unknown"))


def week_season_sequence(week: Column | str) -> Column:
    """C11: chronological position 1..5 (early winter 1, late winter 5)."""
    w = _c(week)
    return (F.when(w.between(1, 9), 1).when(w.between(10, 22), 2)
            .when(w.between(23, 35), 3).when(w.between(36, 48), 4)
            .when(w.between(49, 53), 5))


def week_in_season(week: Column | str) -> Column:
    """Week number inside its season. Late-winter 49-53 -> 1-5,
    early winter 1-9 -> 5-13, spring -9, summer -22, fall -35."""
    w = _c(week)
    return (F.when(w >= 49, w - 48).when(w <= 9, w + 4)
            .when(w <= 22, w - 9).when(w <= 35, w - 22).otherwise(w - 35))


def month_season_code(d: Column | str) -> Column:
    """(month % 12) div 3 -> DJF 0, MAM 1, JJA 2, SON 3."""
    return F.floor((F.month(_c(d)) % 12) / 3).cast("int")


def weekend_flag(weekday: Column | str, holiday_hit: Column,
                 weekend_from: int = 6) -> Column:
    """Weekday >= ``weekend_from`` or a bank holiday.

    The pattern query uses 6 (Sat, Sun); the feature job uses 5 (Fri-Sun).
    """
    return (_c(weekday) >= weekend_from) | F.coalesce(holiday_hit, F.lit(False))


def temp_bin(t: Column | str) -> Column:
    """C14 / Q14: left-closed 5-degree bins; NULL and NaN fall to the last bin."""
    t = _c(t)
    expr = None
    for upper, label in zip(TEMP_BIN_UPPER, TEMP_BINS):
        expr = F.when(t < upper, label) if expr is None else expr.when(t < upper, label)
    return expr.otherwise(TEMP_BINS[-1])


def temp_bin_order(label: Column | str) -> Column:
    """Ordinal of a bin label (0 = coldest), NULL for unknown text."""
    lab = _c(label)
    expr = None
    for i, name in enumerate(TEMP_BINS):
        expr = F.when(lab == name, i) if expr is None else expr.when(lab == name, i)
    return expr


def label_order(label: Column | str, labels: Sequence[str]) -> Column:
    """Position of ``label`` in ``labels``."""
    lab = _c(label)
    expr = None
    for i, name in enumerate(labels):
        expr = F.when(lab == name, i) if expr is None else expr.when(lab == name, i)
    return expr


def mean_temperature(tmax: Column | str, tmin: Column | str) -> Column:
    """(max + min) / 2 (pattern query; the feature job uses max only, Q12)."""
    return (_c(tmax) + _c(tmin)) / 2


def slot_label(slot: Column | str) -> Column:
    """``HH:MM`` for half-hour slot 0..47."""
    s = _c(slot)
    # looked up: a formatter run for every slot costs more than all else there
    labels = F.array(*[F.lit(f"{i // 2:02d}:{i % 2 * 30:02d}") for i in range(48)])
    return F.coalesce(F.get(labels, s.cast("int")), F.format_string("%02d:%02d", F.floor(s / 2).cast("int"), (s % 2) * 30))


def years_predicate(day: Column | str, years: Sequence[int] | None) -> Column | None:
    """F1 on the source text: ``year(day) IN years`` written as prefix tests so
    that it reaches the Parquet scan as ``StringStartsWith`` filters."""
    if not years:
        return None
    d = _c(day)
    pred = None
    for y in sorted(set(int(y) for y in years)):
        p = d.startswith(f"{y:04d}-")
        pred = p if pred is None else (pred | p)
    return pred


def year_range_predicate(day: Column | str, lo: int, hi: int) -> Column:
    """Inclusive year range as a text range on ``YYYY-MM-DD``."""
    d = _c(day)
    return (d >= F.lit(f"{lo:04d}-01-01")) & (d < F.lit(f"{hi + 1:04d}-01-01"))


PARTITION_YEAR = "year"   # partition column of the normalised fact tables
FILE_SLICE, FILE_SLICES = "file_slice", 16   # partition column of tables kept by block file


def file_slice(file: Column | str) -> Column:
    """The slice a block file's rows are stored in."""
    return F.pmod(F.xxhash64(_c(file)), F.lit(FILE_SLICES)).cast("int")


def filter_years(df, years: Sequence[int] | None, day: str = "day"):
    """F1 before aggregating: the exact text test on ``day`` plus, when the
    table is partitioned by ``year``, the same test on the partition column
    so that whole directories are pruned."""
    pred = years_predicate(day, years)
    if pred is None:
        return df
    if PARTITION_YEAR in df.columns:
        pred = F.col(PARTITION_YEAR).isin(sorted({int(y) for y in years})) & pred
    return df.where(pred)


def filter_year_range(df, lo: int, hi: int, day: str = "day"):
    """F7 / Q17 with partition pruning when the table is partitioned by year."""
    pred = year_range_predicate(day, lo, hi)
    if PARTITION_YEAR in df.columns:
        pred = F.col(PARTITION_YEAR).between(lo, hi) & pred
    return df.where(pred)
