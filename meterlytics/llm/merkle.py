"""Merkle manifest of a dataset, with a version of the tree per tampered leaf.

Every row is a leaf, the sha256 of its fields. Leaves of a language ascend by
id; every 8 neighbours (the last run may hold fewer, even one) become the hash
of their hashes until one, the subroot, is left; subroots, by language, become
the root in the same way.

The tree is built in aligned blocks of ``8 ** SPAN`` nodes: a block is folded
in one task and hands its top to the next round, so the number of rounds is the
logarithm of the largest language to the base 4,096 and no task holds more than
a block. On the way back every block is given the siblings of its top, level by
level up to the root (``left`` and ``right``: hashes before and after it).

A tampered leaf creates a version of the tree (``Persistent``): it shares all
untouched nodes and owns only copies of the leaf's ancestors. Within the block
those are copied from the block's levels; above it, the version goes on in the
same task with the siblings handed down, so upper versions are computed where
their leaf is and never meet in one task.

Defined results. Null fields hash as ``-``, empty texts as ``0:``; a null
language is a tree of its own and the first subroot. A null id comes first in
its language and is never tampered with. Ties and repeated rows: rows of one id
are ordered by leaf; rows equal in all fields are leaves of their own with
neighbouring places and equal leaves, and may differ in their proofs. Long
texts are hashed natively, whole. A lone leaf is its own subroot, a lone subroot
the root, the proof of neither has siblings (hash of no bytes). An empty table
gives no rows. Further columns are left out of leaf and result. Recovery:
leaves, places and every round are written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, prepare
from .ranks import Scratch, places
from .sharding import CRC32_SQL, crc32_sql

ARITY = 8
#: levels folded in one task
SPAN = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: a digest stands as 64 lower-case hex digits
HEX = 64


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def depth(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    out = 0
    while n > 1:
        n = -(-n // ARITY)
        out += 1
    return out


class Persistent:
    """A tree over neighbouring nodes and its versions.

    ``levels[k]`` holds the digests of level ``k`` side by side. A version is
    the list of the nodes it copied, bottom up; every other node is read from
    the base, which no version changes."""

    def __init__(self, leaves: bytes, height: int):
        self.levels = [leaves]
        run = ARITY * HEX
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append(b"".join(sha(below[i:i + run]) for i in range(0, len(below), run)))

    @property
    def top(self) -> bytes:
        return self.levels[-1]

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """Digests left and right of the ancestors of leaf ``i`` in their runs."""
        out = []
        for level in self.levels[:-1]:
            at, i = i * HEX, i // ARITY
            run = level[i * ARITY * HEX:(i + 1) * ARITY * HEX]
            at -= i * ARITY * HEX
            out.append((run[:at], run[at + HEX:]))
        return out


def copies(leaf: bytes, siblings: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The nodes a version copies when its leaf becomes ``leaf``: the leaf and
    its ancestors, bottom up."""
    out = [leaf]
    for left, right in siblings:
        out.append(sha(left + out[-1] + right))
    return out


def _field(c: str) -> Column:
    text = F.col(f"`{c}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """Leaf of a row; ``text`` replaces its text (null where the row's is)."""
    parts = [_field(c) for c in FIELDS[:-1]]
    if text is None:
        parts.append(_field("text"))
    else:
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Tops of the aligned blocks of ``nodes(grp, pos, n, digest)``."""
    span = ARITY ** SPAN

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        grp, block = (k.as_py() for k in key)
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        tree = Persistent("".join(table.column("digest").to_pylist()).encode(), min(SPAN, depth(n)))
        return pa.table({"grp": [grp], "pos": [block], "n": pa.array([-(-n // span)], pa.int64()),
                         "digest": [tree.top.decode()]})

    return (nodes.select("grp", "pos", "n", "digest", F.floor(F.col("pos") / span).alias("block"))
            .groupBy("grp", "block").applyInArrow(fold, "grp string, pos long, n long, digest string"))


_PATH = "left array<string>, right array<string>"


def _down(nodes: DataFrame, upper: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """``rows(table, tree, left, right, first row of upper)`` per block of
    ``nodes``, where ``upper(grp, block, left, right, ..)`` has the siblings
    above the block's top."""
    span = ARITY ** SPAN

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree = Persistent("".join(table.column("digest").to_pylist()).encode(),
                          min(SPAN, depth(table.column("n")[0].as_py())))
        top = above.slice(0, 1).to_pylist()[0]
        path = [(a.encode(), b.encode()) for a, b in zip(top["left"], top["right"])]
        return rows(table, tree, path, top)

    return (nodes.withColumn("block", F.floor(F.col("pos") / span)).groupBy("grp", "block")
            .cogroup(upper.groupBy("grp", "block")).applyInArrow(run, schema))


def _paths(table: pa.Table, tree: Persistent, path: list, top: dict) -> pa.Table:
    found = [tree.siblings(i) + path for i in range(table.num_rows)]
    return pa.table({
        "grp": table.column("grp"), "block": table.column("pos"),
        "left": pa.array([[a.decode() for a, _ in p] for p in found], pa.list_(pa.string())),
        "right": pa.array([[b.decode() for _, b in p] for p in found], pa.list_(pa.string())),
        "top": pa.array([top["top"]] * table.num_rows, pa.string())})


def _rounds(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """``nodes`` and the tops of each round, up to one node per group."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(scratch.put(f"{name}-{len(out)}", _blocks(out[-1])))
    return out


def _handed_down(rounds: list[DataFrame], top: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Siblings above the tops of the first round's blocks; ``top(grp, left,
    right, top)`` has those above the groups' last nodes and the nodes themselves."""
    path = top.select("grp", F.lit(0).cast("long").alias("block"), "left", "right", "top")
    for k in range(len(rounds) - 1, 0, -1):
        path = scratch.put(f"{name}-down-{k}", _down(rounds[k], path, _paths, f"grp string, block long, {_PATH}, top string"))
    return path


RESULT = ("doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean, tampered boolean, copied array<string>")


def _answers(with_copies: bool):
    def rows(table: pa.Table, tree: Persistent, path: list, top: dict) -> pa.Table:
        root, proofs, folded, copied = top["root"].encode(), [], [], []
        changed = table.column("changed").to_pylist()
        for i, (leaf, new) in enumerate(zip(table.column("digest").to_pylist(), changed)):
            siblings = tree.siblings(i) + path
            proofs.append(sha(b"".join(a + b for a, b in siblings)).decode())
            version = copies((new or leaf).encode(), siblings)
            folded.append(version[-1])
            copied.append([v.decode() for v in version] if with_copies and new is not None else None)
        n = table.num_rows
        return pa.table({
            "doc_id": table.column("doc_id"), "lang": table.column("lang"), "leaf": table.column("digest"),
            "subroot": pa.array([top["top"]] * n, pa.string()), "root": pa.array([top["root"]] * n, pa.string()),
            "proof_sha256": proofs, "folded_root": [f.decode() for f in folded],
            "verified": [f == root for f in folded], "tampered": [c is not None for c in changed],
            "copied": pa.array(copied, pa.list_(pa.string()))})
    return rows


def manifest(docs: DataFrame, tampered: Column | None = None, with_copies: bool = False) -> DataFrame:
    """One row per row of ``docs``: its leaf, subroot and root, its proof, and
    the root of its version. ``tampered`` marks the leaves that change (their
    text is lower-cased, A-Z only); ``copied`` lists the nodes their versions
    own, leaf first, if asked for."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "merkle")
    mark = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"),
        # a name per language, null included
        F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("grp"),
        leaf_of().alias("digest"), F.when(mark, leaf_of(lowered)).alias("changed"))
    leaves = scratch.put("leaves", places(leaves, ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()],
                                          scratch, "leaf", "pos", "n"))
    scratch.drop("leaf-laid", "leaf-runs")
    rounds = _rounds(leaves.select("grp", "pos", "n", "digest"), scratch, "lang")
    # the name of the null language sorts before the others', theirs as the languages do
    subroots = rounds[-1].select("grp", "digest", F.lit("").alias("all"))
    subroots = scratch.put("subroots", places(subroots, ["all"], [F.col("grp").asc()], scratch, "subroot", "pos", "n")
                           .select(F.col("grp").alias("tree"), F.col("all").alias("grp"), "pos", "n", "digest"))
    upper = _rounds(subroots.select("grp", "pos", "n", "digest"), scratch, "root")
    none = F.array().cast("array<string>")
    root = upper[-1].select("grp", none.alias("left"), none.alias("right"), F.col("digest").alias("top"))
    above = _handed_down(upper, root, scratch, "root")
    above = scratch.put("above", _down(subroots, above, _subroots, f"grp string, {_PATH}, top string, root string"))
    path = _handed_down(rounds, above, scratch, "lang")
    path = path.join(above.select("grp", "root"), "grp")
    return _down(leaves, path, _answers(with_copies), RESULT)


def _subroots(table: pa.Table, tree: Persistent, path: list, top: dict) -> pa.Table:
    found = [tree.siblings(i) + path for i in range(table.num_rows)]
    return pa.table({
        "grp": table.column("tree"),
        "left": pa.array([[a.decode() for a, _ in p] for p in found], pa.list_(pa.string())),
        "right": pa.array([[b.decode() for _, b in p] for p in found], pa.list_(pa.string())),
        "top": table.column("digest"), "root": pa.array([top["top"]] * table.num_rows, pa.string())})


def third(doc_id: Column) -> Column:
    """Whether 3 divides the crc32 of the id in decimal."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, third(F.col("doc_id"))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


_LEAF_SQL = " || ".join(_field_sql(c) for c in FIELDS[:-1])

#: nodes of the trees level by level, then every leaf's path, folded level by level
SQL = f"""
WITH RECURSIVE {CRC32_SQL},
marked AS (
  SELECT *, translate(text, '{UPPER}', '{LOWER}') AS lowered, {crc32_sql("doc_id::VARCHAR")} % 3 = 0 AS hit
  FROM (SELECT *, (SELECT t FROM table_) AS t FROM documents)),
leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '-') AS grp, sha256({_LEAF_SQL} || {_field_sql("text")}) AS leaf,
         CASE WHEN hit THEN sha256({_LEAF_SQL} || {_field_sql("lowered")}) END AS changed
  FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT grp, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT grp, any_value(level) + 1, pos // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {ARITY - 1}) // {ARITY}
  FROM nodes WHERE n > 1 GROUP BY grp, pos // {ARITY}),
subroots AS (
  SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos FROM nodes WHERE n = 1),
upper_ AS (
  SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {ARITY - 1}) // {ARITY}
  FROM upper_ WHERE n > 1 GROUP BY pos // {ARITY}),
runs AS (
  SELECT grp, level, pos // {ARITY} AS run, list(digest ORDER BY pos) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (
  SELECT level, pos // {ARITY} AS run, list(digest ORDER BY pos) AS digests FROM upper_ WHERE n > 1 GROUP BY ALL),
paths AS (
  SELECT p.id, p.grp, p.doc_id, p.leaf, 0 AS level, p.pos, coalesce(p.changed, p.leaf) AS cur, '' AS proof FROM placed p
  UNION ALL
  SELECT p.id, p.grp, p.doc_id, p.leaf, p.level + 1, p.pos // {ARITY},
         sha256(array_to_string(list_concat(list_concat(r.digests[:p.pos % {ARITY}], [p.cur]), r.digests[p.pos % {ARITY} + 2:]), '')),
         p.proof || array_to_string(list_concat(r.digests[:p.pos % {ARITY}], r.digests[p.pos % {ARITY} + 2:]), '')
  FROM paths p JOIN runs r ON p.grp = r.grp AND p.level = r.level AND p.pos // {ARITY} = r.run),
tops AS (
  SELECT id, grp, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, arg_max(cur, level) AS cur, arg_max(proof, level) AS proof
  FROM paths GROUP BY id, grp),
above AS (
  SELECT t.id, t.doc_id, t.leaf, s.digest AS subroot, 0 AS level, s.pos, t.cur, t.proof FROM tops t JOIN subroots s ON t.grp = s.grp
  UNION ALL
  SELECT p.id, p.doc_id, p.leaf, p.subroot, p.level + 1, p.pos // {ARITY},
         sha256(array_to_string(list_concat(list_concat(r.digests[:p.pos % {ARITY}], [p.cur]), r.digests[p.pos % {ARITY} + 2:]), '')),
         p.proof || array_to_string(list_concat(r.digests[:p.pos % {ARITY}], r.digests[p.pos % {ARITY} + 2:]), '')
  FROM above p JOIN upper_runs r ON p.level = r.level AND p.pos // {ARITY} = r.run),
ends AS (
  SELECT id, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf, any_value(subroot) AS subroot,
         (SELECT digest FROM upper_ WHERE n = 1) AS root, sha256(arg_max(proof, level)) AS proof_sha256,
         arg_max(cur, level) AS folded_root
  FROM above GROUP BY id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM ends
"""
