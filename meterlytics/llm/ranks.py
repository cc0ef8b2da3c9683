"""Places of rows in a total order, and the written tables of one run.

A place is a row's index from 0 within its group. A window over a group would
sort the whole group in one task, so rows are laid out by range over groups
and order together: a hot group, and even a third of all rows that are equal,
spread over many tasks. Places then need only the number of rows that earlier
tasks hold of the same group, one small row per task and group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import delete_path, shared_root


class Scratch:
    """Tables of one run, written in the shared folder so that lineage is cut
    and a lost executor costs a re-read; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self.schemas = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        self.schemas[name] = df.schema
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        """The written table, read anew (both sides of a cogroup need that)."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for n in names:
            delete_path(self.spark, f"{self.root}/{n}")


def places(df: DataFrame, group: list[str], order: list[Column], scratch: Scratch, name: str,
           out: str = "pos", total: str | None = None) -> DataFrame:
    """``df`` with ``out``: the row's place (long, from 0) in its ``group``
    (null is a group) by ``order``; ``total`` names a column for the group's
    number of rows. Rows that tie get neighbouring places in an arbitrary but
    fixed order, so give ``order`` every column whose place must not vary."""
    rows = scratch.put(f"{name}-rows", df.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [F.col(g).asc_nulls_first() for g in group] + list(order) + [F.col("_tie").asc()]
    laid = scratch.put(f"{name}-laid", rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    scratch.drop(f"{name}-rows")
    # the upper bits of the id are the task, the lower ones the row in it
    here = F.shiftright("_at", 33)
    # a group only orders its own tasks: one row per task and group
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (laid.groupBy(*group, here.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .withColumn("_total", F.sum("_n").over(whole)))
    # written, so that the planner sees its size and ships it only when it is small
    runs = scratch.put(f"{name}-runs", runs.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                                                   "_part", "_first", "_before", "_total"))
    match = here == F.col("_part")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    cols = [*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(out)]
    return laid.join(runs, match).select(*cols, *([F.col("_total").alias(total)] if total else []))
