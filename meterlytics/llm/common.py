"""Helpers shared by the operators: written tables, Arrow text access, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, shared_root, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: lower-cases A-Z only, byte by byte
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: white space of the word rule ``[^\x20\x09-\x0D]+``
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: rows of an Arrow batch, where the session keeps Spark's default: texts and
#: sets are long, and a batch stands in the JVM and in the worker at once
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers, set the checkpoint folder, and
    bound the Arrow batches unless the session sets its own bound."""
    ship_package(spark)
    shared_root(spark)
    key, default, ours = BATCH_ROWS
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, ours)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    is cut, and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that no later step reads."""
    for t in tables:
        path = t.__dict__.pop("_written", None)
        if path:
            delete_path(t.sparkSession, path)


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def remainder(col, m: int):
    """crc32 of the id as text, modulo ``m`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; nulls become empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_null(arr.type):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    base = offsets[0]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[base:offsets[-1]], offsets - base


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices whose text is about ``limit`` bytes (a longer text stands
    alone), so that working memory does not follow the batch size."""
    _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs): rows ``(id, comp)``
    with ``comp`` the smallest id reachable, for every id of an edge.

    Alternating large-star and small-star rounds: each is a ``groupBy().min``
    (combined before the shuffle) and an equi-join on the node, so a hub costs
    one row per edge and no group is gathered in a task. Depth shrinks
    geometrically; every round is cut by a written table."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct(), f"{name}-edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node hang below the node's minimum
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        # small star: lower neighbours (and the node) hang below the minimum
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(m.select("u", F.col("m").alias("v"))))
        last, e = e, cut(small.where("u <> v").distinct(), name)
        forget(last)
        sign = e.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
        if sign == seen:
            break
        seen = sign
    comp = e.groupBy("u").agg(F.min("v").alias("comp"))
    roots = comp.select(F.col("comp").alias("id"), "comp").distinct()
    return comp.select(F.col("u").alias("id"), "comp").union(roots)


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its columns called like one of ``names`` (the operator
    derives those itself; a clashing input column gives way)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
