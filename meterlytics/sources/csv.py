"""CSV sources in the reference's layout (S1-S4) and their Parquet compaction.

Files are read by column name: the header gives the columns of a read, the
package's schema their types; further columns are read as text and left out,
columns may stand in any order, and a needed column that is absent raises.
Files of one folder may have headers of their own order: files are grouped by
their header, and each group is one scan. ``FAILFAST`` makes a malformed value
raise, like the reference's strict parse; as Spark reads lazily, it raises at
the action that reads the value, while a missing path, an empty folder or an
absent column raises here.
"""

from __future__ import annotations

import csv as _csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.calendar import PARTITION_YEAR, year_from_text
from ..session import files_under, first_line, path_exists
from .ledger import Ledger

# Relative locations of the six sources under the dataset root (fixed layout).
LAYOUT = {
    "half_hourly": "hhblock_dataset/hhblock_dataset",
    "daily": "daily_dataset/daily_dataset",
    "holidays": "uk_bank_holidays.csv",
    "households": "informations_households.csv",
    "weather_daily": "weather_daily_darksky.csv",
    "weather_hourly": "weather_hourly_darksky.csv",
}


def _headers(spark: SparkSession, paths: Sequence[str], glob: str | None = None) -> dict[str, list[str]]:
    """Header line -> the files (or folders' part files) that start with it.

    Only the first line of each file is read, before the one scan of the rows;
    names and headers are on the driver, as the file listing itself is."""
    files = [f for p in paths for f in files_under(spark, p, glob)]
    with ThreadPoolExecutor(max_workers=16) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    out: dict[str, list[str]] = {}
    for f, line in zip(files, lines):
        if line is not None:
            out.setdefault(line.lstrip("\ufeff"), []).append(f)
    return out


def _scan(spark: SparkSession, header: str, files: Sequence[str], schema: T.StructType, with_file: bool) -> DataFrame:
    names = next(_csv.reader([header]), [])
    known = {f.name: f.dataType for f in schema.fields}
    absent = [n for n in known if n not in names]
    if absent:
        raise ValueError(f"{files[0]}: column(s) {', '.join(absent)} not in the header {header!r}")
    # a name that stands twice is read where it stands first
    full = T.StructType([T.StructField(n if names.index(n) == i else f"_{i}", known.get(n, T.StringType())
                                       if names.index(n) == i else T.StringType(), True) for i, n in enumerate(names)])
    df = (spark.read.schema(full).option("header", True).option("enforceSchema", len(set(names)) < len(names))
          .option("mode", "FAILFAST").csv(list(files)))
    cols = [F.col(f"`{n}`") for n in known]
    if with_file:
        cols.append(F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("file"))
    return df.select(*cols)


def _read(spark: SparkSession, paths: Sequence[str], schema: T.StructType, glob: str | None = None,
          with_file: bool = False) -> DataFrame | None:
    headers = _headers(spark, paths, glob)
    if not headers:
        return None
    parts = [_scan(spark, h, sorted(files), schema, with_file) for h, files in sorted(headers.items())]
    return reduce(DataFrame.unionByName, parts)


def read_csv_dir(spark: SparkSession, directory: str, schema: T.StructType,
                 glob: str = "*.csv", with_file: bool = False) -> DataFrame:
    """Every ``*.csv`` directly in ``directory`` as one table;
    ``with_file`` adds the file's name without ``.csv`` as ``file``."""
    df = _read(spark, [directory], schema, glob, with_file)
    if df is None:
        raise ValueError(f"No CSV files found in {directory}")
    return df


def read_csv_file(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One CSV file. A missing or empty file and an absent column raise
    ``ValueError`` here; a malformed value raises at the action."""
    try:
        df = _read(spark, [path], schema)
    except ValueError:
        raise
    except Exception as exc:  # noqa: BLE001 - re-raised with the path
        raise ValueError(f"Error loading {path}: {exc}") from exc
    if df is None:
        raise ValueError(f"Error loading {path}: it is empty")
    return df


def read_block_files(spark: SparkSession, directory: str, files: Sequence[str],
                     schema: T.StructType = S.HALF_HOURLY) -> DataFrame:
    """S3: the named block files (``file`` values without ``.csv``); a missing
    file raises ``PATH_NOT_FOUND``. Adds ``file`` from the file metadata."""
    df = _read(spark, [f"{directory.rstrip('/')}/{f}.csv" for f in files], schema, with_file=True)
    if df is None:
        raise ValueError(f"No rows in the files {', '.join(files)} of {directory}")
    return df


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Holiday file; the ``Bank holidays`` header becomes ``holiday``."""
    return read_csv_file(spark, path, S.HOLIDAYS_CSV).withColumnRenamed("Bank holidays", "holiday")


def read_sources(spark: SparkSession, root: str, with_file: bool = False) -> dict[str, DataFrame]:
    """The six sources from a dataset root in the reference's layout;
    ``with_file`` adds the block file to the two fact tables."""
    r = root.rstrip("/")
    return {
        "half_hourly": read_csv_dir(spark, f"{r}/{LAYOUT['half_hourly']}", S.HALF_HOURLY, with_file=with_file),
        "daily": read_csv_dir(spark, f"{r}/{LAYOUT['daily']}", S.DAILY, with_file=with_file),
        "holidays": read_holidays(spark, f"{r}/{LAYOUT['holidays']}"),
        "households": read_csv_file(spark, f"{r}/{LAYOUT['households']}", S.HOUSEHOLDS),
        "weather_daily": read_csv_file(spark, f"{r}/{LAYOUT['weather_daily']}", S.WEATHER_DAILY),
        "weather_hourly": read_csv_file(spark, f"{r}/{LAYOUT['weather_hourly']}", S.WEATHER_HOURLY),
    }


def compact_to_parquet(spark: SparkSession, root: str, out: str) -> dict[str, str]:
    """One-time compaction of the CSV blocks to Parquet (S5 for sources).

    The two fact tables are written partitioned by ``year`` so that year
    filters prune whole directories, with the block file each row came from
    (the group selection of the feature job is by file, Q18); dimensions are
    written as they are.
    """
    written = {}
    for name, df in read_sources(spark, root, with_file=True).items():
        path = f"{out.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        if name in ("half_hourly", "daily"):
            w = df.withColumn(PARTITION_YEAR, year_from_text("day")).write.mode("overwrite").partitionBy(PARTITION_YEAR)
        w.parquet(path)
        written[name] = path
    return written


def load_sources_csv(spark: SparkSession, root: str, compact: str | None = None):
    """``catalog.Sources`` over a dataset root in the reference's layout, with
    the row counts of the dimensions (the proven sizes that decide broadcasts):
    what the pattern getters and the profiles take. With ``compact`` the facts
    are read from the Parquet compaction in that folder, which is made where it
    does not stand yet."""
    from .catalog import Sources, measured
    if compact:
        names = list(LAYOUT)
        if not all(path_exists(spark, f"{compact.rstrip('/')}/{n}/_SUCCESS") for n in names):
            compact_to_parquet(spark, root, compact)
        tables = {n: spark.read.parquet(f"{compact.rstrip('/')}/{n}") for n in names}
    else:
        tables = read_sources(spark, root, with_file=True)
    size = {n: measured(tables[n]) for n in ("households", "holidays", "weather_daily", "weather_hourly")}
    return Sources(tables, {n: x[0] for n, x in size.items()}, compact, bytes={n: x[1] for n, x in size.items()})


def load_sources_ledger(spark: SparkSession, root: str, out: str, strict: bool = False):
    """``catalog.Sources`` over a dataset root whose block files come and go:
    the facts are kept by a ledger each under ``out`` and brought up to date
    (files that are new or differ are read, nothing else); the dimensions, files
    of their own, are read as they are. ``changes`` says what was done and
    ``marks`` has a fingerprint per fact table and year, which
    ``store.ResultStore.materialize_parts`` follows."""
    from .catalog import Sources, measured
    r, tables, changes, marks = root.rstrip("/"), {}, {}, {}
    for name in ("half_hourly", "daily"):
        ledger = Ledger(spark, f"{out.rstrip('/')}/{name}", f"{r}/{LAYOUT[name]}", S.SOURCE_SCHEMAS[name])
        changes[name] = ledger.refresh(strict)
        tables[name], marks[name] = ledger.table(), ledger.marks()
    tables["holidays"] = read_holidays(spark, f"{r}/{LAYOUT['holidays']}")
    for name in ("households", "weather_daily", "weather_hourly"):
        tables[name] = read_csv_file(spark, f"{r}/{LAYOUT[name]}", S.SOURCE_SCHEMAS[name])
    size = {n: measured(tables[n]) for n in ("households", "holidays", "weather_daily", "weather_hourly")}
    return Sources(tables, {n: x[0] for n, x in size.items()}, out.rstrip("/"), marks, changes, {n: x[1] for n, x in size.items()})


def write_sources_csv(tables: dict[str, DataFrame], root: str) -> None:
    """Write tables in the reference's CSV layout (used to test the readers
    and the streaming job). Spark writes each "file" as a folder of part
    files, which the readers above accept unchanged."""
    r = root.rstrip("/")
    for name, df in tables.items():
        if name == "holidays":
            df = df.withColumnRenamed("holiday", "Bank holidays")
        df.write.mode("overwrite").option("header", True).csv(f"{r}/{LAYOUT[name]}")
