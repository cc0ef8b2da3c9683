"""Fact tables kept from CSV block files by an append-only ledger.

A fact table is a folder of Parquet written ``year=Y/batch=B/file_slice=S``,
where the slice follows from a hash of the block file's name, so that a group's
files (J7) prune folders by a dynamic partition filter; a *version* says
which batches of which years are live, and what each block file gave. Versions
are only added, each by one rename, so readers see a whole version or none, and
an older one can be read until it is retired.

``refresh`` compares the folder's listing with the last version and works on
the difference alone:

* a **new** file is read and its rows are written under its years;
* a **changed** or **removed** file costs a rewrite, from Parquet, of the
  (year, batch) folders that hold rows of it, without them;
* everything else stays as it lies.

Every file is read once. One scan of all new files takes values as text by the
first readable file's header, casts them, and sets header lines and faulty lines apart
in the same write; from those few rows it is decided afterwards which files
were whole. A file with another order of columns is read again by its own
header (one scan per distinct header); a file that is empty, lacks a needed
column or has a faulty line is *quarantined*: none of its rows is served,
``report`` says why, and the others go on. ``strict=True`` raises instead.

The listing is a Spark scan that reads no file's content (files of no bytes are
not listed); the driver holds the names of the files that differ, as the reader
of those needs them.
"""

from __future__ import annotations

import csv as _csv
import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import FILE_SLICE, PARTITION_YEAR, file_slice, year_from_text
from ..session import delete_path, first_line, list_dir, path_exists, publish

FILES = "file string, path string, length long, modified timestamp, status string, reason string"
PLACES = f"file string, {PARTITION_YEAR} int, batch string, rows long"
NULL_YEAR = "__HIVE_DEFAULT_PARTITION__"
#: year of the folder with header lines and faulty lines of a batch
ASIDE = -1
BOM = "﻿"


@dataclass(frozen=True)
class Change:
    """What a refresh found and wrote."""

    version: int
    added: list[str]
    changed: list[str]
    removed: list[str]
    quarantined: list[str]
    written: list[tuple[int | None, str]]     # (year, batch) folders written

    @property
    def any(self) -> bool:
        return bool(self.added or self.changed or self.removed)


class Ledger:
    """The block files of ``directory`` as one table of ``schema`` (the ``day``
    column gives the year) with the columns ``file`` and ``year`` added."""

    def __init__(self, spark: SparkSession, root: str, directory: str, schema: T.StructType, glob: str = "*.csv"):
        self.spark, self.root, self.directory = spark, root.rstrip("/"), directory.rstrip("/")
        self.schema, self.glob = schema, glob
        self.data = f"{self.root}/data"

    # ---- versions ------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n) for n in list_dir(self.spark, f"{self.root}/versions") if n.isdigit()]

    def _version(self, n: int) -> str:
        return f"{self.root}/versions/{n:09d}"

    def _last(self, version: int | None = None) -> int | None:
        have = self.versions()
        if version is not None and version not in have:
            raise ValueError(f"no version {version} of {self.root}")
        return version if version is not None else (have[-1] if have else None)

    def _table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        n = self._last(version)
        if n is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self._version(n)}/{name}")

    def files(self, version: int | None = None) -> DataFrame:
        """The block files of a version: ``status`` is loaded or quarantined."""
        return self._table("files", FILES, version)

    def report(self, version: int | None = None) -> DataFrame:
        """Files that are not served, with the reason."""
        return self.files(version).where("status = 'quarantined'").select("file", "reason")

    def places(self, version: int | None = None) -> DataFrame:
        """Rows of each file in each (year, batch)."""
        return self._table("places", PLACES, version)

    def _live(self, version: int | None = None) -> list[tuple[int | None, str]]:
        """(year, batch) folders of a version: years times batches, not files."""
        rows = self.places(version).select(PARTITION_YEAR, "batch").distinct().collect()
        return sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x))

    def _folder(self, year: int | None, batch: str) -> str:
        return f"{self.data}/{PARTITION_YEAR}={NULL_YEAR if year is None else year}/batch={batch}"

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("file", T.StringType()),
                             T.StructField(PARTITION_YEAR, T.IntegerType()), T.StructField("batch", T.StringType()),
                             T.StructField(FILE_SLICE, T.IntegerType())])

    def _read(self, folders: Sequence[tuple[int | None, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._stored())
        return (self.spark.read.schema(self._stored()).option("basePath", self.data)
                .parquet(*[self._folder(y, b) for y, b in folders]))

    def table(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one by default), with ``file``,
        ``year`` and ``file_slice``."""
        return self._read(self._live(version)).drop("batch")

    def marks(self, version: int | None = None) -> dict[int | None, str]:
        """A fingerprint per year: it changes if and only if the year's folders do."""
        out: dict[int | None, list[str]] = {}
        for year, batch in self._live(version):
            out.setdefault(year, []).append(batch)
        return {y: hashlib.sha1("\n".join(sorted(b)).encode()).hexdigest()[:16] for y, b in out.items()}

    # ---- refresh ---------------------------------------------------------------

    def _listing(self) -> DataFrame:
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", self.glob).load(self.directory)
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        return found.select(F.regexp_replace(name, r"\.csv$", "").alias("file"), "path",
                            F.col("length"), F.col("modificationTime").alias("modified"))

    def refresh(self, strict: bool = False) -> Change:
        """Bring the table up to the folder; a new version if anything differs."""
        last = self._last()
        old, new = self.files().alias("o"), self._listing().alias("n")
        same = (F.col("o.length") == F.col("n.length")) & (F.col("o.modified") == F.col("n.modified"))
        rows = old.join(new, F.col("o.path") == F.col("n.path"), "full").where(~F.coalesce(same, F.lit(False))).select(
            F.coalesce("n.file", "o.file").alias("file"), F.col("n.path").alias("path"), F.col("n.length").alias("length"),
            F.col("n.modified").alias("modified"), F.col("o.path").isNotNull().alias("known")).collect()
        added = sorted(r["file"] for r in rows if not r["known"])
        changed = sorted(r["file"] for r in rows if r["known"] and r["path"] is not None)
        removed = sorted(r["file"] for r in rows if r["path"] is None)
        if not rows and last is not None:
            return Change(last, [], [], [], [], [])
        if last is None and not added:
            raise ValueError(f"No files {self.glob} in {self.directory}")
        fresh = [r for r in rows if r["path"] is not None]
        good, bad, places = self._load([(r["file"], r["path"]) for r in fresh])
        if bad and strict:
            raise ValueError("; ".join(f"{f}: {why}" for f, why in sorted(bad.items())))
        kept, moved = self._without(changed + removed)
        places = moved.unionByName(places) if places is not None else moved
        gone = self.spark.createDataFrame([(f,) for f in changed + removed], "file string")
        files = self.files().join(gone, "file", "left_anti").unionByName(self.spark.createDataFrame(
            [(r["file"], r["path"], r["length"], r["modified"], "quarantined" if r["file"] in bad else "loaded",
              bad.get(r["file"])) for r in fresh], FILES))
        version = self._publish(last, files, kept.unionByName(places))
        before = set(self._live(last)) if last is not None else set()
        return Change(version, added, changed, removed, sorted(bad), [x for x in self._live(version) if x not in before])

    def _publish(self, last: int | None, files: DataFrame, places: DataFrame) -> int:
        version = 0 if last is None else last + 1
        made = f"{self.root}/versions/.making-{uuid.uuid4().hex}"
        files.write.parquet(f"{made}/files")
        places.coalesce(1).write.parquet(f"{made}/places")
        if not publish(self.spark, made, self._version(version)):
            raise RuntimeError(f"another writer published version {version} of {self.root}; refresh again")
        return version

    def _placed(self, batch: str) -> DataFrame:
        """What a batch just written holds (reads its column ``file`` only)."""
        years = [n.split("=", 1)[1] for n in list_dir(self.spark, self.data) if n.startswith(f"{PARTITION_YEAR}=")]
        folders = [(None if y == NULL_YEAR else int(y), batch) for y in years
                   if y != str(ASIDE) and path_exists(self.spark, f"{self.data}/{PARTITION_YEAR}={y}/batch={batch}")]
        return self._read(folders).groupBy("file", PARTITION_YEAR, "batch").agg(F.count("*").alias("rows"))

    def _without(self, gone: list[str]) -> tuple[DataFrame, DataFrame]:
        """Places that stay, and those of the folders rewritten without the
        files ``gone``."""
        places = self.places()
        none = self.spark.createDataFrame([], PLACES)
        if not gone:
            return places, none
        names = self.spark.createDataFrame([(f,) for f in gone], "file string")
        hit = [(r[0], r[1]) for r in places.join(names, "file", "left_semi")
               .select(PARTITION_YEAR, "batch").distinct().collect()]
        if not hit:
            return places, none
        batch = uuid.uuid4().hex
        self._write(self._read(hit).drop("batch").join(F.broadcast(names) if len(gone) < 10_000 else names, "file", "left_anti")
                    .select(*self.schema.fieldNames(), "file", PARTITION_YEAR), batch)
        touched = self.spark.createDataFrame(hit, f"{PARTITION_YEAR} int, batch string").alias("t")
        stay = places.alias("p").join(touched, (F.col("p.batch") == F.col("t.batch"))
                                      & F.col(f"p.{PARTITION_YEAR}").eqNullSafe(F.col(f"t.{PARTITION_YEAR}")), "left_anti")
        return stay, self._placed(batch)

    def _write(self, df: DataFrame, batch: str) -> None:
        (df.withColumn("batch", F.lit(batch)).withColumn(FILE_SLICE, file_slice("file"))
         .write.mode("append").partitionBy(PARTITION_YEAR, "batch", FILE_SLICE).parquet(self.data))

    # ---- reading block files ------------------------------------------------------

    def _load(self, files: list[tuple[str, str]]):
        """Reads the files once each; returns the good ones, the reasons of the
        others, and the places of the rows written."""
        good: list[str] = []
        bad: dict[str, str] = {}
        places: DataFrame | None = None
        todo = {path: name for name, path in files}
        known: str | None = None
        while todo:
            # the first file's header stands for a scan, or that of the files left over
            while todo and known is None:
                path = sorted(todo)[0]
                line = (first_line(self.spark, path) or "").lstrip(BOM)
                reason = self._unreadable(line)
                if reason is None:
                    known = line
                else:
                    bad[todo.pop(path)] = reason
            if not todo:
                break
            names, batch = next(_csv.reader([known])), uuid.uuid4().hex
            self._scan(sorted(todo), names, batch)
            whole, other, why = self._judged(batch, names, set(todo.values()))
            if why or other:
                # rows of files that are not whole leave the batch, by a rewrite from Parquet
                batch = self._only(whole, batch)
            if whole:
                part = self._placed(batch)
                places = part if places is None else places.unionByName(part)
            good += whole
            bad.update(why)
            todo = {p: n for p, n in todo.items() if n in other}
            known = min(other.values(), default=None)
        return good, bad, places

    def _unreadable(self, line: str) -> str | None:
        """Why a file that starts with ``line`` cannot be read, if so."""
        if not line.strip():
            return "empty"
        names = next(_csv.reader([line]), [])
        if self.schema.fieldNames()[0] not in names:
            return "no header"
        absent = [c for c in self.schema.fieldNames() if c not in names]
        return f"no column {', '.join(absent)}" if absent else None

    def _scan(self, paths: list[str], names: list[str], batch: str) -> None:
        """One pass over the files: typed rows by year; header and faulty lines aside."""
        cells = [f"_c{i}" for i in range(len(names))]
        raw = (self.spark.read.schema(", ".join(f"{c} string" for c in cells) + ", _line string")
               .option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(paths))
        text = {f.name: F.col(cells[names.index(f.name)]) for f in self.schema.fields}
        typed = {f.name: text[f.name].try_cast(f.dataType) for f in self.schema.fields}
        line = F.coalesce(F.col("_line"), F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in cells]))
        first = self.schema.fieldNames()[0]
        # the line that names the columns, in this or another order
        is_header = F.array_contains(F.split(F.trim(F.regexp_replace(line, f'["{BOM}]', "")), ","), first)
        fault = F.when(F.col("_line").isNotNull(), F.lit("number of values"))
        for f in self.schema.fields:
            if not isinstance(f.dataType, T.StringType):
                fault = fault.when(text[f.name].isNotNull() & typed[f.name].isNull(), F.lit(f"value of {f.name}"))
        kind = F.when(is_header, F.lit("header")).otherwise(fault)
        rows = raw.select(*[typed[f.name].alias(f.name) for f in self.schema.fields],
                          F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "").alias("file"),
                          kind.alias("_kind"), F.when(is_header, F.regexp_replace(line, BOM, "")).alias("_head"))
        rows = rows.withColumn(PARTITION_YEAR, F.when(F.col("_kind").isNotNull(), F.lit(ASIDE))
                               .otherwise(year_from_text("day").cast("int")))
        self._write(rows, batch)

    def _judged(self, batch: str, names: list[str], files: set[str]):
        """By the lines set aside: whole files, headers of files in another
        order, reasons of the others."""
        aside = f"{self.data}/{PARTITION_YEAR}={ASIDE}/batch={batch}"
        seen: dict[str, tuple] = {}
        if path_exists(self.spark, aside):
            rows = (self.spark.read.schema("file string, _kind string, _head string").parquet(aside).groupBy("file").agg(
                F.min("_head").alias("head"), F.count("_head").alias("heads"),
                F.min(F.when(F.col("_kind") != "header", F.col("_kind"))).alias("fault"),
                F.count(F.when(F.col("_kind") != "header", 1)).alias("faults")))
            seen = {r["file"]: r for r in rows.collect()}
            delete_path(self.spark, aside)
        whole, other, why = [], {}, {}
        for f in sorted(files):
            r = seen.get(f)
            if r is None or not r["heads"]:
                why[f] = "empty" if r is None else "no header"
                continue
            reason = self._unreadable(r["head"])
            if r["heads"] > 1:
                why[f] = "more than one header"
            elif reason:
                why[f] = reason
            elif next(_csv.reader([r["head"]])) != names:
                other[f] = r["head"]
            elif r["faults"]:
                why[f] = f"{r['fault']} ({r['faults']} lines)"
            else:
                whole.append(f)
        return whole, other, why

    def _only(self, files: list[str], batch: str) -> str:
        years = [n.split("=", 1)[1] for n in list_dir(self.spark, self.data) if n.startswith(f"{PARTITION_YEAR}=")]
        folders = [(None if y == NULL_YEAR else int(y), batch) for y in years
                   if path_exists(self.spark, f"{self.data}/{PARTITION_YEAR}={y}/batch={batch}")]
        new = uuid.uuid4().hex
        if files and folders:
            names = self.spark.createDataFrame([(f,) for f in files], "file string")
            self._write(self._read(folders).drop("batch").join(names, "file", "left_semi")
                        .select(*self.schema.fieldNames(), "file", PARTITION_YEAR), new)
        for y, b in folders:
            delete_path(self.spark, self._folder(y, b))
        return new

    # ---- upkeep -----------------------------------------------------------------

    def compact(self, batches: int = 8) -> Change | None:
        """Years that lie in more than ``batches`` batches become one each."""
        last = self._last()
        by: dict[int | None, list[str]] = {}
        for y, b in self._live():
            by.setdefault(y, []).append(b)
        many = [(y, b) for y, bs in by.items() if len(bs) > batches for b in bs]
        if not many:
            return None
        batch = uuid.uuid4().hex
        # rows of a file lie together, so that a file's statistics are narrow
        self._write(self._read(many).drop("batch").repartition(PARTITION_YEAR, F.pmod(F.xxhash64("file"), F.lit(64)))
                    .sortWithinPartitions(PARTITION_YEAR, "file").select(*self.schema.fieldNames(), "file", PARTITION_YEAR), batch)
        touched = self.spark.createDataFrame(many, f"{PARTITION_YEAR} int, batch string").alias("t")
        stay = self.places().alias("p").join(touched, (F.col("p.batch") == F.col("t.batch"))
                                             & F.col(f"p.{PARTITION_YEAR}").eqNullSafe(F.col(f"t.{PARTITION_YEAR}")), "left_anti")
        version = self._publish(last, self.files(), stay.unionByName(self._placed(batch)))
        return Change(version, [], [], [], [], [x for x in self._live(version) if x[1] == batch])

    def vacuum(self, keep: int = 1) -> int:
        """Retire all but the last ``keep`` versions and remove the folders that
        none of the others needs; returns how many folders went. Not to be run
        beside a ``refresh``, whose folders no version names yet."""
        have = self.versions()
        for n in have[:-keep] if keep else have:
            delete_path(self.spark, self._version(n))
        needed = {self._folder(y, b) for n in have[-keep:] for y, b in self._live(n)} if keep else set()
        removed = 0
        for year in list_dir(self.spark, self.data):
            if not year.startswith(f"{PARTITION_YEAR}="):
                continue
            inside = list_dir(self.spark, f"{self.data}/{year}")
            for b in inside:
                if f"{self.data}/{year}/{b}" not in needed:
                    removed += delete_path(self.spark, f"{self.data}/{year}/{b}")
        for n in list_dir(self.spark, f"{self.root}/versions"):
            if n.startswith(".making-"):
                delete_path(self.spark, f"{self.root}/versions/{n}")
        return removed

    def remove_all(self) -> bool:
        """Everything: all versions and all rows."""
        return path_exists(self.spark, self.root) and delete_path(self.spark, self.root)
