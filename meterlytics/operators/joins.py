"""Join helpers: broadcast only behind a proven size bound.

A side is broadcast when an exact upper bound on its rows is known and below
``max_rows``. The bound comes from the source catalog's recorded row counts
(a derived side such as "distinct holiday dates" has at most as many rows as
its source). Without a bound the join is left to the planner: a shuffle
(sort-merge) join, which AQE may still turn into a broadcast join from the
*measured* size of the materialised shuffle stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of the narrow rows that the bound counts in (``Sources.bound``).
ROW_BYTES = 40
# Rows of a narrow dimension (date, a few doubles) that we are willing to ship
# to every executor: 2M rows x ~40 B = ~80 MB at worst.
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def is_bounded(row_bound: int | None, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> bool:
    return row_bound is not None and row_bound <= max_rows


def bounded_broadcast(df: DataFrame, row_bound: int | None,
                      max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if ``row_bound`` proves it small, else ``df`` as is."""
    if row_bound is not None and row_bound <= max_rows:
        return F.broadcast(df)
    return df


def salted_semi_join(fact: DataFrame, keys: DataFrame, on: str, spread_by: str,
                     buckets: int = 16) -> DataFrame:
    """``fact LEFT SEMI JOIN keys ON on`` for a ``keys`` side too large to
    broadcast, robust to a hot key on the fact side.

    Each fact row gets a salt from a hash of ``spread_by`` (e.g. the day), and
    every key is repeated once per salt value, so the rows of one hot key are
    spread over ``buckets`` reduce tasks instead of one. ``keys`` must hold
    distinct values of ``on`` (a semi-join side); it grows ``buckets`` times,
    which is cheap next to the fact table. The hint keeps the planner's own
    estimate out: it takes the keys for the size of their compressed column, does
    not count the repeats, and would broadcast them all through the driver.
    """
    salt = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(buckets)).cast("int")
    salted_fact = fact.withColumn("_salt", salt)
    salted_keys = keys.select(on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted_fact.join(salted_keys.hint("merge"), [on, "_salt"], "left_semi").drop("_salt")
