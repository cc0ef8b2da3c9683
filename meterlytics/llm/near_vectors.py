"""Embedding near-duplicates: spherical k-means cells, blocked cosine products.

1. Equal vectors of a label become one vector with a count.
2. Every label with more than ``CELL`` distinct vectors gets cells by spherical
   k-means, fitted on a bounded sample of the label (``SAMPLE`` vectors at the
   most, chosen by hash; at most ``MAX_CELLS`` cells). Every vector is assigned.
3. A pair within the threshold may lie across a border. A vector ``y`` of cell
   ``b`` can have a partner in cell ``c`` only if ``y . (b - c) / |b - c|`` is at
   most the sine of the threshold's angle; it then visits ``c`` (of two cells
   the one with the smaller number). So no pair is lost: the cells save work,
   they do not decide.
4. The vectors of a cell are dealt to blocks of ``BLOCK``; pairs of blocks are
   multiplied in double precision. A pair of blocks returns one link count per
   vector and a spanning forest of its links, never all pairs.
5. Components over the forests; the smallest id of each is kept.

Defined results: rows with a null label or a vector that is null, empty, zero
or holds null or non-finite components link with nothing and are kept; vectors
of different lengths do not link; repeated rows are vectors of their own; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, prepare

THRESHOLD = 0.98
CELL, MAX_CELLS, SAMPLE, BLOCK, DEAL = 1024, 2048, 32_768, 1024, 8192
ROUNDS = 12


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key of label and vector (128 bits), and its number, for the rows that
    can link."""
    for b in batches:
        keys = []
        for label, vec in zip(b.column(1).to_pylist(), b.column(2)):
            v = vec.as_py()
            key = None
            if label is not None and v and None not in v:
                a = np.asarray(v, np.float64) + 0.0
                if np.isfinite(a).all() and a.any():
                    key = hashlib.blake2b(f"{label}|{len(a)}|".encode() + a.tobytes(), digest_size=16).digest()
            keys.append(key)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(keys, pa.binary()),
             pa.array([k and int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64())],
            names=["vec_id", "label", "embedding", "key", "rep"])


def matrix(rows) -> np.ndarray:
    """Lists of one length (no nulls) as the rows of a matrix."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1)


def distances(c: np.ndarray, of: np.ndarray, part: int = 16) -> np.ndarray:
    """Distances of the centres ``of`` to all, by differences (no cancellation),
    some rows at a time; other rows are left at zero."""
    out = np.zeros((len(c), len(c)))
    for i in range(0, len(of), part):
        rows = of[i:i + part]
        out[rows] = np.linalg.norm(c[rows][:, None, :] - c[None, :, :], axis=2)
    return out


def unit(rows) -> np.ndarray:
    m = matrix(rows)
    m /= np.abs(m).max(axis=1, keepdims=True)          # no overflow in the norm
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Unit centres; empty cells restart at the worst served vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        sim = x @ c.T
        best = sim.argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, best, x)
        norm = np.linalg.norm(new, axis=1)
        lost = np.flatnonzero(norm < 1e-9)
        if len(lost):
            new[lost] = x[np.argsort(sim.max(axis=1), kind="stable")[:len(lost)]]
            norm = np.linalg.norm(new, axis=1)
        c = new / norm[:, None]
    return c


def _fit(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("rep").to_numpy())           # no dependence on row order
    x = unit(table.column("vector").take(pa.array(order)))
    c = spherical_kmeans(x, int(table.column("k")[0].as_py()))
    n = len(c)
    return pa.table({"label": pa.array([table.column("label")[0].as_py()] * n, table.schema.field("label").type),
                     "dim": pa.array([table.column("dim")[0].as_py()] * n, pa.int32()),
                     "cell": pa.array(range(n), pa.int32()), "centre": pa.array(c.tolist(), pa.list_(pa.float64()))})


def _assign(threshold: float):
    sine = float(np.sqrt(1 - threshold * threshold)) + 1e-9

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A row per vector in its cell and in each cell that it visits."""
        x = unit(left.column("vector"))
        if right.num_rows:
            right = right.sort_by("cell")
            c = matrix(right.column("centre"))
            sim = x @ c.T
            best = sim.argmax(axis=1)
            gap = distances(c, np.unique(best))
            near = sim[np.arange(len(x)), best][:, None] - sim <= sine * gap[best] + 1e-12
            near &= np.arange(len(c))[None, :] < best[:, None]
            row, cell = np.nonzero(near)
        else:
            best, row, cell = np.zeros(len(x), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pick = np.concatenate([np.arange(len(x)), row])
        t = left.select(["label", "dim", "rep", "count", "vector"]).take(pa.array(pick))
        return t.append_column("cell", pa.array(np.concatenate([best, cell]).astype(np.int32))).append_column(
            "home", pa.array(np.arange(len(pick)) < len(x)))
    return run


def _forest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each vector to the least id reachable within the block pair."""
    la, lb = a.copy(), b.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(hit, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(hit, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    ids, low = np.concatenate([a, b]), np.concatenate([la, lb])
    live = ids != low
    return list(zip(ids[live].tolist(), low[live].tolist()))


def _multiply(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sorted_ = np.argsort(table.column("rep").to_numpy(), kind="stable")
        table, side = table.take(pa.array(sorted_)), side[sorted_]
        own = np.flatnonzero(side != 1)                           # 0: one block with itself, 2: left of two
        other = np.flatnonzero(side == 1)
        rep, count = table.column("rep").to_numpy(), table.column("count").to_numpy()
        out: list[tuple] = []
        x = unit(table.column("vector")) if table.num_rows else np.zeros((0, 1))
        same = len(own) > 0 and side[own[0]] == 0
        if same or len(other) and len(own):
            cols = own if same else other
            hit = (x[own] @ x[cols].T) >= threshold
            if same:
                np.fill_diagonal(hit, False)
            links = hit @ count[cols]
            out += [(int(rep[i]), int(n), None) for i, n in zip(own, links) if n]
            if not same:
                back = count[own] @ hit
                out += [(int(rep[i]), int(n), None) for i, n in zip(cols, back) if n]
            out += [(u, 0, v) for u, v in _forest(hit, rep[own], rep[cols])]
        return pa.table({"rep": pa.array([o[0] for o in out], pa.int64()), "links": pa.array([o[1] for o in out], pa.int64()),
                         "low": pa.array([o[2] for o in out], pa.int64())})
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of
    ``vectors(vec_id, embedding, label)``."""
    prepare(vectors.sparkSession)
    src = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    label = src.schema["label"].dataType.simpleString()
    keyed = src.mapInArrow(_keys, f"vec_id long, label {label}, embedding array<double>, key binary, rep long")
    distinct = cut(keyed.where("key IS NOT NULL").groupBy("key").agg(
        F.any_value("label").alias("label"), F.any_value("embedding").alias("vector"), F.any_value("rep").alias("rep"),
        F.min("vec_id").alias("least"), F.count("*").alias("count"))
        .withColumn("dim", F.size("vector")), "vec-distinct")
    stats = (distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
             .withColumn("k", F.least(F.lit(MAX_CELLS), F.ceil(F.col("n") / CELL)).cast("int"))
             .withColumn("deal", F.ceil(F.col("n") / DEAL).cast("int")))
    rows = distinct.join(stats, ["label", "dim"])
    chance = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where((F.col("k") > 1) & (chance < F.least(F.lit(SAMPLE), F.col("k") * 48) / F.col("n")))
    centres = cut(sample.select("label", "dim", "rep", "k", "vector").groupBy("label", "dim")
                  .applyInArrow(_fit, f"label {label}, dim int, cell int, centre array<double>"), "vec-centres")
    dealt = rows.select("label", "dim", "rep", "count", "vector", F.pmod(F.xxhash64("key", F.lit(3)), F.col("deal")).cast("int").alias("part"))
    given = centres.join(stats, ["label", "dim"]).select(
        "label", "dim", "cell", "centre", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("part"))
    placed = cut(dealt.groupBy("label", "dim", "part").cogroup(given.groupBy("label", "dim", "part")).applyInArrow(
        _assign(threshold), f"label {label}, dim int, rep long, count long, vector array<double>, cell int, home boolean"), "vec-cells")
    # blocks of a cell: home blocks 0..h-1, visitors' blocks h..h+v-1
    size = placed.groupBy("label", "dim", "cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("h"),
        F.ceil(F.sum((~F.col("home")).cast("long")) / BLOCK).cast("int").alias("v")).where("h > 0")
    salt = F.pmod(F.xxhash64("rep", F.lit(5)), F.when(F.col("home"), F.col("h")).otherwise(F.col("v"))).cast("int")
    blocks = placed.join(size, ["label", "dim", "cell"]).withColumn("i", F.when(F.col("home"), salt).otherwise(F.col("h") + salt))
    # the pairs of blocks that a block takes part in: with itself, as left, as right
    last = F.col("h") + F.col("v") - 1
    left = F.when(F.col("home"), F.transform(F.sequence(F.col("i"), last), lambda j: F.struct(
        F.col("i").alias("a"), j.alias("b"), F.when(j == F.col("i"), 0).otherwise(2).alias("side"))))
    right = F.transform(F.sequence(F.lit(0), F.least(F.col("i"), F.col("h")) - 1), lambda j: F.struct(
        j.alias("a"), F.col("i").alias("b"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<a:int,b:int,side:int>>")
    pairs = blocks.select("label", "dim", "cell", "rep", "count", "vector", F.explode(F.concat(
        F.coalesce(left, none), F.when(F.col("i") > 0, right).otherwise(none))).alias("p"))
    found = cut(pairs.select("label", "dim", "cell", "p.a", "p.b", "p.side", "rep", "count", "vector")
                .groupBy("label", "dim", "cell", "a", "b")
                .applyInArrow(_multiply(threshold), "rep long, links long, low long"), "vec-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("low IS NOT NULL").select(F.col("rep").alias("u"), F.col("low").alias("v")), "vec-cc")
    own = (distinct.select("key", "rep", "least", "count").join(links, "rep", "left")
           .join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
    top = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = cut(own.join(top, "comp").select("key", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"),
                                             "component_id"), "vec-named")
    return (keyed.select("vec_id", "key").join(named, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op5_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(u, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT p.v, r.c FROM r JOIN p ON p.u = r.u WHERE r.c < p.v),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT e.vec_id, coalesce(max(n.n), 0) AS n_links, min(r.c) AS component_id, e.vec_id = min(r.c) AS kept
FROM embeddings e JOIN r ON r.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id GROUP BY e.vec_id"""
