"""Exact distinct households from mergeable bitmaps (A6, A12 over any period).

``count(distinct)`` cannot be merged: a year's count does not follow from its
days' counts. A bitmap can. Every household gets a number, and the households
of a date are one bitmap per 32,768 numbers; the bitmaps of any set of dates
are or-ed and their bits counted. The bitmaps are calendar sized times groups,
so the fact table is scanned once, whatever periods are asked for later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from .joins import bounded_broadcast


def numbered(households: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``LCLid, groups, household``: a number per household (unique, close
    together within a task, so that bitmaps are well filled). Of a household
    that is listed several times, each listing with other groups counts there;
    store the result before use, as numbers follow the layout of the rows."""
    ids = households.select("LCLid").where("LCLid is not null").distinct()
    ids = ids.sortWithinPartitions("LCLid").withColumn("household", F.monotonically_increasing_id() + 1)
    return households.select("LCLid", *groups).distinct().join(ids, "LCLid")


def household_bitmaps(rows: DataFrame, numbers: DataFrame, groups: Sequence[str] = (), number_rows: int | None = None) -> DataFrame:
    """State per date (``_d``), ``groups`` and range of numbers: the households
    with a row on that date."""
    joined = rows.select("LCLid", "day").join(bounded_broadcast(numbers, number_rows), "LCLid")
    n = F.col("household")
    return (joined.groupBy(cal.parse_date("day").alias("_d"), *groups, F.bitmap_bucket_number(n).alias("_range"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_bits")))


def distinct_households(bitmaps: DataFrame, *by: str | Column) -> DataFrame:
    """Households with a row in each group of ``by`` (expressions over the date
    and the groups), from the bitmaps alone."""
    ranges = bitmaps.groupBy(*by, "_range").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    names = [c for c in ranges.columns if c not in ("_range", "_bits")]
    return ranges.groupBy(*names).agg(F.sum(F.bitmap_count("_bits")).alias("household_count"))
