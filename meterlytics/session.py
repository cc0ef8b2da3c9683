"""Spark session and shared-folder helpers.

Scratch tables (normalised sources, trained model parameters, cut lineage)
live under the folder the cluster names in ``spark.checkpoint.dir``. We only
invent a folder when the setting is missing *and* Spark runs in local mode
(tests, laptops); on a cluster a missing setting is an error, because a
machine-local folder would not survive an executor loss.
"""

from __future__ import annotations

import fnmatch
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # COUNT(*) / MIN / MAX on Parquet answered from footers (row counts of
    # the normalised sources for the broadcast bounds)
    "spark.sql.parquet.aggregatePushdown": "true",
    # a generated method that HotSpot would only interpret (over 8,000 bytes; 48
    # readings make one) is not used: the plan node compiles split expressions
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # streaming state on disk with incremental snapshots, not in the executors' heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Broadcast decisions are made explicitly by ``operators.joins`` from
    # exact row counts; the optimizer's file-size estimate stays as a fallback.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def build_session(master: str | None = None, app_name: str = "meterlytics",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings the package relies on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compile_methods(spark: SparkSession) -> None:
    """The ``hugeMethodLimit`` of ``build_session`` for a session made elsewhere,
    unless it has one of its own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, _DEFAULTS[key])


def disk_state(spark: SparkSession) -> None:
    """The streaming state of ``build_session``, on disk, for a session made
    elsewhere, unless it has one of its own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, _DEFAULTS[key])
    # a commit uploads its changes; whole snapshots are made in the background
    key = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "true")


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """Folder for tables the package writes (sources, models, checkpoints).

    Order: the session's checkpoint directory, then ``spark.checkpoint.dir``
    from the configuration; only in local mode a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return (sc.getCheckpointDir() or configured).rstrip("/")
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so that written tables survive executor loss")
    folder = tempfile.mkdtemp(prefix="meterlytics-ckpt-")
    sc.setCheckpointDir(folder)
    return (sc.getCheckpointDir() or folder).rstrip("/")


def store_root(spark: SparkSession) -> str:
    """Durable folder for normalised sources and results, the same for every
    application: ``spark.meterlytics.store``, else ``meterlytics-store`` in the
    configured ``spark.checkpoint.dir`` (beside, not inside, the folder that
    Spark adds per application). Without either, in local mode only, a folder
    of this application."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.meterlytics.store", None) or conf.get("spark.meterlytics.store", None)
    if named:
        return named.rstrip("/")
    configured = conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/meterlytics-store"
    return f"{shared_root(spark)}/meterlytics-store"


# Paths without a scheme mean the default file system, as for Spark's readers;
# all of these go through the Hadoop file system.

def _hadoop(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test that works for any Hadoop file system."""
    fs, hpath = _hadoop(spark, path)
    return bool(fs.exists(hpath))


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursive delete through the Hadoop file system API."""
    fs, hpath = _hadoop(spark, path)
    return bool(fs.delete(hpath, True))


def make_dir(spark: SparkSession, path: str) -> None:
    """A folder with its parents; one that stands stays as it is."""
    fs, hpath = _hadoop(spark, path)
    fs.mkdirs(hpath)


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; empty when it does not exist."""
    fs, hpath = _hadoop(spark, path)
    if not fs.exists(hpath):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(hpath))


def file_stamps(spark: SparkSession, path: str) -> list[str]:
    """``name:size:modification time`` of a file, or of every file of a folder."""
    fs, hpath = _hadoop(spark, path)
    found = fs.listFiles(hpath, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath().toUri().getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return sorted(out)


def files_under(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """A file itself, or the files directly in a folder (no hidden ones) whose
    names match ``pattern``; raises ``FileNotFoundError`` for a missing path."""
    fs, hpath = _hadoop(spark, path)
    if not fs.exists(hpath):
        raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
    out = []
    for s in fs.listStatus(hpath):
        name = str(s.getPath().getName())
        if s.isFile() and not name.startswith(("_", ".")) and (pattern is None or fnmatch.fnmatch(name, pattern)):
            out.append(str(s.getPath().toString()))
    return sorted(out)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file (compressed ones too), reading no more of
    it than a buffer; None for an empty file."""
    fs, hpath = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration()).getCodec(hpath)
    stream = fs.open(hpath)
    try:
        plain = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def modified(spark: SparkSession, path: str) -> float:
    """Modification time in seconds."""
    fs, hpath = _hadoop(spark, path)
    return fs.getFileStatus(hpath).getModificationTime() / 1000


def publish(spark: SparkSession, made: str, path: str, replace: bool = False) -> bool:
    """Give a finished folder its name by one rename. If the name stands and
    ``replace`` is false, the folder that stands wins and ours goes; with
    ``replace``, the old folder steps aside first and goes afterwards."""
    fs, src = _hadoop(spark, made)
    _, dst = _hadoop(spark, path)
    fs.mkdirs(dst.getParent())
    old = None
    if fs.exists(dst) and replace:
        old = _hadoop(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
        fs.rename(dst, old)
    if fs.exists(dst) or not fs.rename(src, dst):
        fs.delete(src, True)
        return False
    # a rename onto a folder that another writer published meanwhile puts ours inside it
    inner = _hadoop(spark, f"{path}/{made.rstrip('/').rsplit('/', 1)[-1]}")[1]
    if fs.exists(inner):
        fs.delete(inner, True)
    if old is not None:
        fs.delete(old, True)
    return True


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``meterlytics`` importable in the Python workers (pandas UDFs and
    ``mapInPandas`` unpickle its functions by reference): zip the package once
    per SparkContext and ``addPyFile`` it, which distributes it like
    ``--py-files``. A no-op when already shipped."""
    sc = spark.sparkContext
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="meterlytics-pkg-"), "meterlytics.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
            for root, dirs, files in os.walk(pkg_dir):
                dirs[:] = [d for d in dirs if d != "__pycache__"]
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(root, name)
                        zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
        sc.addPyFile(out)
        _SHIPPED.add(sc.applicationId)
