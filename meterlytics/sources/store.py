"""Result materialisation: table sink, typed reload, read-through.

The reference caches results as CSV plus a JSON type side-car; Parquet keeps
types and arrays, so a result is a Parquet folder under ``root``, which should
carry the fingerprint of the sources (``catalog.Sources.root`` does). A result
is written to a folder of its own and then renamed, so readers see all of it or
none, and of two builders of one name the first wins. The memory level is
``DataFrame.cache()``. Writes fail loudly (the reference swallows write errors,
Q39) and a ``refresh`` argument rebuilds explicitly.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, list_dir, modified, path_exists, publish

_NULL = "__HIVE_DEFAULT_PARTITION__"


class ResultStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._memory: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def save(self, name: str, df: DataFrame) -> None:
        """Write the named table, in place of one that stands."""
        made = f"{self.root}/.making-{name}-{uuid.uuid4().hex}"
        df.write.parquet(made)
        publish(self.spark, made, self.path(name), replace=True)

    def load(self, name: str) -> DataFrame | None:
        """The stored table with its types, or None when absent."""
        if not self.exists(name):
            return None
        return self.spark.read.parquet(self.path(name))

    def materialize(self, name: str, builder: Callable[[], DataFrame],
                    refresh: bool = False, memory: bool = True) -> DataFrame:
        """Memory -> stored table -> build, write, read back."""
        if not refresh and name in self._memory:
            return self._memory[name]
        df = None if refresh else self.load(name)
        if df is None:
            made = f"{self.root}/.making-{name}-{uuid.uuid4().hex}"
            builder().write.parquet(made)
            publish(self.spark, made, self.path(name), replace=refresh)
            df = self.spark.read.parquet(self.path(name))
        if memory:
            df = df.cache()
            self._memory[name] = df
        return df

    def materialize_parts(self, name: str, marks: dict[int | None, str],
                          build: Callable[[list[int | None]], DataFrame], column: str = "year") -> DataFrame:
        """S7 by part: the rows of ``name`` for the years of ``marks``, of which
        only those years are built whose fingerprint is new. ``build(years)``
        gives the rows of those years, with the year in ``column``, in one job;
        a year's folder carries its fingerprint, and the ones it replaces go."""
        base = f"{self.path(name)}.parts"
        folder = {y: f"{base}/{column}={_NULL if y is None else y}/mark={m}" for y, m in marks.items()}
        stale = [y for y in folder if not path_exists(self.spark, folder[y])]
        if stale:
            df = build(sorted(stale, key=lambda y: (y is not None, y)))
            made = f"{self.root}/.making-{name}-{uuid.uuid4().hex}"
            df.withColumn("mark", F.lit("")).write.partitionBy(column, "mark").parquet(made)
            for y in stale:
                part = f"{made}/{column}={_NULL if y is None else y}/mark={_NULL}"
                if not path_exists(self.spark, part):       # a year without rows is an empty table
                    df.where("false").drop(column).write.parquet(part)
                publish(self.spark, part, folder[y])
            delete_path(self.spark, made)
            self.spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{base}/schema")
        schema = self.spark.read.parquet(f"{base}/schema").schema
        for y, path in folder.items():
            up, keep = path.rsplit("/", 1)
            for n in list_dir(self.spark, up):
                if n.startswith("mark=") and n != keep:
                    delete_path(self.spark, f"{up}/{n}")
        if not folder:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*folder.values()).select(*schema.fieldNames())

    def remove(self, name: str) -> bool:
        """Drop one table (memory and storage), its parts too."""
        cached = self._memory.pop(name, None)
        if cached is not None:
            cached.unpersist()
        gone = False
        for path in (self.path(name), f"{self.path(name)}.parts"):
            if path_exists(self.spark, path):
                gone |= delete_path(self.spark, path)
        return gone

    def remove_all(self) -> int:
        """Drop every table, and what broken writers have left."""
        names = self.list()
        for n in list(self._memory):
            self._memory.pop(n).unpersist()
        self.clean()
        return sum(self.remove(n) for n in names)

    def clean(self, age: float = 24 * 3600) -> int:
        """Remove folders that a writer began (``.making-``) or set aside
        (``.old-``) more than ``age`` seconds ago; younger ones may be in use."""
        gone = 0
        for n in list_dir(self.spark, self.root):
            if n.startswith(".making-") or ".old-" in n:
                path = f"{self.root}/{n}"
                if time.time() - modified(self.spark, path) > age:
                    gone += delete_path(self.spark, path)
        return gone

    def list(self) -> list[str]:
        """Names of the stored tables."""
        names = {n.removesuffix(".parts") for n in list_dir(self.spark, self.root)
                 if not n.startswith(("_", ".")) and ".old-" not in n}
        return sorted(names)
