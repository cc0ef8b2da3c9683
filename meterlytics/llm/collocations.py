"""Phrase collocations by direct-address tiles over frequency-ranked ids.

1. **Ids.** Texts are cut into slices of ``SLICE`` bytes; a slice numbers its
   own words. Words of all slices are added up by (language, word); those met
   ``LEAST`` times get ranks by frequency (``ranks.places``), and every slice is
   told the ranks of its words by a join on (language, word). No word list is
   held by one task.
2. **Pairs.** Neighbours in a slice are cells of a (left, right) plane cut into
   tiles of ``TILE`` x ``TILE`` ranks. As ranks follow frequency, the first
   tiles are crowded: those are counted by ``numpy.bincount`` on a dense tile;
   the sparse rest is sorted as (cell, count) coordinates. Tiles are dealt to
   buckets by a hash of the tile; counts of a bucket are merged in groups of at
   most ``GROUP`` bytes, again dense or sorted, over as many rounds as the
   volume needs: a crowded tile has at most ``TILE ** 2`` cells, so it shrinks
   with every round. Pairs met ``LEAST`` times stay.
3. **Recursion.** Frequent pairs are ranked by frequency like words; slices
   learn the ranks of their pairs (bucket by bucket, hot buckets salted), and
   the sequence of pair ranks is counted in the same way: neighbouring pairs
   are triples, neighbouring triples quadruples. A phrase can be frequent only
   if its parts are, so nothing is lost.

Scores, cuts and the rule on longer phrases are joins of the frequent phrases;
products are decimals, as they may pass 64 bits.

Limits: ranks have 32 bits; more than 4 billion frequent phrases of one length
in one language raise ``OverflowError``.

Defined results. Null language: ``und``, together with texts marked ``und``.
Null and empty texts hold no words. Repeated rows count each time. Ties in rank
order are broken by phrase bytes in the result and by any fixed order inside.
Very long texts are a slice of their own. An empty table gives no rows. Further
columns are not read. Recovery: slices, counts and ranks are written tables;
those no longer read are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, LOWER, UPPER, prepare, slices, text_buffers
from .ranks import Scratch, places

#: a phrase counts as frequent from here on
LEAST = 30
LONGEST = 4
#: reported phrases per language
TOP = 2000
#: a candidate inside a longer one met this share (%) of its times goes
COVER = 80
#: bytes of text in a slice
SLICE = 32 << 20
#: ranks along a tile's side (a power of two)
TILE_BITS = 10
#: tiles along each axis that may be dense, and the occurrences that make one dense
CROWDED, DENSE = 8, 1 << 16
#: bytes of counts merged at once (a full tile takes at most 14 MB)
GROUP = 32 << 20
#: words counted per bucket of tiles; buckets at first at most
PER_BUCKET, FIRST_BUCKETS = 2 << 20, 4096

PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD_BYTE = ~PIECE_END
WORD_BYTE[[32, 9]] = False


# ---- packed arrays -----------------------------------------------------------

def planes(x: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, lowest first; high zero planes are
    left out, others compress well."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    k = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(k, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :k] = raw.T
    return out.view(np.uint64).reshape(-1)


def pack_cells(cells: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending cells as differences, and their counts."""
    return planes(np.diff(cells, prepend=np.uint64(0))), planes(counts)


def unpack_cells(cells: bytes) -> np.ndarray:
    return np.cumsum(from_planes(cells), dtype=np.uint64)


# ---- slices: local word numbers -----------------------------------------------

def word_sequence(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all pieces of ``texts``, lower-cased, and for each whether a
    piece starts with it."""
    raw, off = text_buffers(texts)
    raw = ASCII_LOWER[raw]
    inside = WORD_BYTE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < len(raw)]
    first[at] = inside[at]                    # a text starts anew beside another's last word
    start = np.flatnonzero(first)
    end = np.flatnonzero(inside)
    # lengths: word bytes up to the next word's start
    before = np.searchsorted(end, start)
    offsets = np.append(before, len(end)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    stops = np.union1d(np.flatnonzero(PIECE_END[raw]), at)
    piece = np.searchsorted(stops, start, side="right")
    return words.dictionary_encode(), np.diff(piece, prepend=-1) != 0


class _Slice:
    """Words of one language in one slice, numbered from 1; 0 ends a piece."""

    def __init__(self):
        self.chunks: list[pa.DictionaryArray] = []
        self.starts: list[np.ndarray] = []

    def add(self, texts: pa.Array) -> None:
        words, starts = word_sequence(texts)
        if len(words):
            self.chunks.append(words)
            self.starts.append(starts)

    def row(self) -> tuple[bytes, pa.Array, np.ndarray] | None:
        if not self.chunks:
            return None
        one = pa.chunked_array(self.chunks).unify_dictionaries()
        words = one.chunk(0).dictionary
        local = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in one.chunks])
        starts = np.concatenate(self.starts)
        ids = np.zeros(len(local) + int(starts.sum()), np.uint64)
        ids[np.arange(len(local)) + np.cumsum(starts)] = local + 1
        return planes(ids), words, np.bincount(local, minlength=len(words))


SLICES = "slice long, lang string, ids binary, words array<string>, counts array<long>"


def _cut_slices(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held, size = TaskContext.get().partitionId() << 32, 0, {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                row = held[lang].row()
                if row is not None:
                    ids, words, counts = row
                    yield pa.RecordBatch.from_arrays([
                        pa.array([base + made], pa.int64()), pa.array([lang], pa.string()), pa.array([ids], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.large_string()).cast(pa.string())),
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64()))],
                        names=["slice", "lang", "ids", "words", "counts"])

        for batch in batches:
            for part in slices(batch, "text"):
                langs = pc.fill_null(part.column(0), "und")
                for lang in pc.unique(langs).to_pylist():
                    texts = part.column(1).filter(pc.equal(langs, lang))
                    held.setdefault(lang, _Slice()).add(texts)
                size += part.column(1).nbytes
                if size >= limit:
                    yield from rows()
                    made, held, size = made + 1, {}, 0
        yield from rows()
    return run


def _rename(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
    """A slice's own word numbers replaced by the ranks it was told."""
    if not table.num_rows:
        return table.select(["slice", "lang", "ids"])
    ids = from_planes(table.column("ids")[0].as_py())
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint64)
    rank[told.column("local").to_numpy()] = told.column("id").to_numpy()
    return _sequence(table, rank[ids])


def _sequence(table: pa.Table, ids: np.ndarray) -> pa.Table:
    """The slice's row with other ids; several zeros in a row say no more than one."""
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return pa.table({"slice": table.column("slice"), "lang": table.column("lang"),
                     "ids": pa.array([planes(ids[keep])], pa.binary())})


SEQUENCE = "slice long, lang string, ids binary"


# ---- counting pairs by tiles ----------------------------------------------------

def _halves(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cells >> np.uint64(32), cells & np.uint64(0xFFFFFFFF)


def count_cells(cells: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, with their (weighted) counts: crowded tiles
    by ``bincount`` over the whole tile, the others as sorted coordinates."""
    side, mask = np.uint64(TILE_BITS), np.uint64((1 << TILE_BITS) - 1)
    a, b = _halves(cells)
    low = np.uint64(CROWDED << TILE_BITS)
    near = (a < low) & (b < low)
    tile = np.where(near, (a >> side) * np.uint64(CROWDED) + (b >> side), np.uint64(CROWDED * CROWDED)).astype(np.int64)
    crowd = np.bincount(tile, minlength=CROWDED * CROWDED + 1)[:-1]
    found, sums = [], []
    for t in np.flatnonzero(crowd >= DENSE):
        here = tile == t
        grid = np.bincount((((a[here] & mask) << side) | (b[here] & mask)).astype(np.int64),
                           weights=None if weights is None else weights[here], minlength=1 << 2 * TILE_BITS)
        hit = np.flatnonzero(grid)
        x = (hit >> TILE_BITS) + ((int(t) // CROWDED) << TILE_BITS)
        y = (hit & int(mask)) + ((int(t) % CROWDED) << TILE_BITS)
        found.append((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
        sums.append(grid[hit].astype(np.uint64))
        tile[here] = -1
    rest = tile >= 0
    c = cells[rest]
    if weights is None:
        c = np.sort(c)
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(c)))
    else:
        order = np.argsort(c, kind="stable")
        c, w = c[order], weights[rest][order]
        head = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        n = np.add.reduceat(w, head) if len(c) else w
    found.append(c[head])
    sums.append(n.astype(np.uint64))
    cells, counts = np.concatenate(found), np.concatenate(sums)
    order = np.argsort(cells, kind="stable")
    return cells[order], counts[order]


def bucket_of(cells: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (of a power of two many) of each cell's tile; with more buckets,
    the lower bits stay as they were."""
    a, b = _halves(cells)
    side = np.uint64(TILE_BITS)
    h = (a >> side) * np.uint64(0x9E3779B97F4A7C15) + (b >> side) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h & np.uint64(buckets - 1)).astype(np.int64)


def neighbours(ids: np.ndarray) -> np.ndarray:
    """Cell of each neighbouring pair in a sequence of ranks from 1 (0: none)."""
    a, b = ids[:-1], ids[1:]
    both = (a != 0) & (b != 0)
    return ((a[both] - np.uint64(1)) << np.uint64(32)) | (b[both] - np.uint64(1))


COUNTS = "slice long, lang string, bucket long, size long, cells binary, counts binary"


def _in_buckets(at: int, lang: str, cells: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = bucket_of(cells, buckets)
    order = np.argsort(bucket, kind="stable")          # cells stay ascending within a bucket
    bucket, cells, counts = bucket[order], cells[order], counts[order]
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    packed = [pack_cells(cells[i:j], counts[i:j]) for i, j in zip(edge, np.append(edge[1:], len(bucket)))]
    n = len(packed)
    return pa.RecordBatch.from_arrays([
        pa.array([at] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array(bucket[edge], pa.int64()),
        pa.array([len(x) + len(y) for x, y in packed], pa.int64()),
        pa.array([x for x, _ in packed], pa.binary()), pa.array([y for _, y in packed], pa.binary())],
        names=["slice", "lang", "bucket", "size", "cells", "counts"])


def _count_slices(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, lang, blob in zip(*(batch.column(i) for i in range(3))):
                cells, counts = count_cells(neighbours(from_planes(blob.as_py())))
                yield _in_buckets(at.as_py(), lang.as_py(), cells, counts, buckets)
    return run


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    cells = np.concatenate([unpack_cells(x) for x in table.column("cells").to_pylist()])
    counts = np.concatenate([from_planes(x) for x in table.column("counts").to_pylist()])
    return count_cells(cells, counts)


def _merge(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, salt = (k.as_py() for k in key)
        return pa.Table.from_batches([_in_buckets(salt, lang, *_added(table), buckets)])
    return run


def _frequent(least: int, first: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cells, counts = _added(table)
        keep = counts >= least
        a, b = _halves(cells[keep])
        n = int(keep.sum())
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()),
                         "bucket": bucket_of(cells[keep], first), "left": (a + np.uint64(1)).astype(np.int64),
                         "right": (b + np.uint64(1)).astype(np.int64), "f": counts[keep].astype(np.int64)})
    return run


def _salted(counts: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``counts`` with a ``salt`` that cuts every (language, bucket) into groups
    of about ``GROUP`` bytes, and the number of salts of each."""
    salts = scratch.put(name, counts.groupBy("lang", "bucket").agg(
        F.ceil(F.sum("size") / GROUP).cast("long").alias("salts")))
    return counts.join(salts, ["lang", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("slice"), "salts")), salts


def _frequent_pairs(counts: DataFrame, first: int, target: int, least: int, scratch: Scratch, name: str) -> DataFrame:
    """Pairs met ``least`` times: ``(lang, bucket, left, right, f)``."""
    buckets, k, before, done = first, 0, None, []
    while True:
        salted, salts = _salted(counts, scratch, f"{name}-salts-{k}")
        groups = salts.where("salts > 1").agg(F.sum("salts")).first()[0] or 0
        if buckets == target:
            if not groups or groups == before:
                done.append(counts)
                break
            # what fits one group waits for the last step
            done.append(salted.where("salts = 1").select(*counts.columns))
            salted, before = salted.where("salts > 1"), groups
        buckets = min(target, buckets * 64)
        counts = scratch.put(f"{name}-merged-{k}", salted.groupBy("lang", "bucket", "salt")
                             .applyInArrow(_merge(buckets), COUNTS))
        k += 1
    return reduce(DataFrame.union, done).groupBy("lang", "bucket").applyInArrow(
        _frequent(least, first), "lang string, bucket long, left long, right long, f long")


# ---- telling slices the ranks of their pairs ----------------------------------------

TOLD = "slice long, lang string, cells binary, ids binary"


def _tell(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of the cells each slice asks for in a bucket, the frequent ones' ranks."""
    out: dict[str, list] = {"slice": [], "cells": [], "ids": []}
    if asked.num_rows and known.num_rows:
        left, right = known.column("left").to_numpy(), known.column("right").to_numpy()
        cell = ((left - 1).astype(np.uint64) << np.uint64(32)) | (right - 1).astype(np.uint64)
        order = np.argsort(cell)
        cell, rank = cell[order], known.column("id").to_numpy()[order].astype(np.uint64)
        for at, blob in zip(asked.column("slice").to_pylist(), asked.column("cells").to_pylist()):
            mine = unpack_cells(blob)
            pos = np.minimum(np.searchsorted(cell, mine), len(cell) - 1)
            hit = cell[pos] == mine
            if hit.any():
                out["slice"].append(at)
                out["cells"].append(planes(np.diff(mine[hit], prepend=np.uint64(0))))
                out["ids"].append(planes(rank[pos[hit]]))
    n = len(out["slice"])
    return pa.table({"slice": pa.array(out["slice"], pa.int64()), "lang": pa.array([key[0].as_py()] * n, pa.string()),
                     "cells": pa.array(out["cells"], pa.binary()), "ids": pa.array(out["ids"], pa.binary())})


def _pairs_renamed(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
    """The sequence of the ranks of neighbouring pairs (0: not frequent)."""
    if not table.num_rows:
        return table.select(["slice", "lang", "ids"])
    ids = from_planes(table.column("ids")[0].as_py())
    out = np.zeros(max(0, len(ids) - 1), np.uint64)
    if told.num_rows and len(out):
        cell = np.concatenate([unpack_cells(x) for x in told.column("cells").to_pylist()])
        rank = np.concatenate([from_planes(x) for x in told.column("ids").to_pylist()])
        order = np.argsort(cell)
        cell, rank = cell[order], rank[order]
        both = (ids[:-1] != 0) & (ids[1:] != 0)
        mine = neighbours(ids)
        pos = np.minimum(np.searchsorted(cell, mine), len(cell) - 1)
        out[both] = np.where(cell[pos] == mine, rank[pos], np.uint64(0))
    return _sequence(table, out)


# ---- the operator -----------------------------------------------------------------

def _ranked(found: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    placed = places(found, ["lang"], order, scratch, name)
    out = scratch.put(name, placed.withColumn("id", F.col("pos") + 1).drop("pos"))
    scratch.drop(f"{name}-laid", f"{name}-runs")
    if (out.agg(F.max("id")).first()[0] or 0) >= 1 << 32:
        raise OverflowError(f"{name}: more frequent phrases of a language than ranks of 32 bits")
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST,
                  scratch: Scratch | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, ``(lang, id, left, right, f)`` from length 2
    and ``(lang, id, word, f)`` of length 1, and ``(lang, n)`` words in all.
    ``left`` and ``right`` are the ids of the phrase without its last and
    without its first word."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = scratch or Scratch(spark, "phrases")
    cut = scratch.put("slices", docs.select(F.col("lang").cast("string").alias("lang"), "text")
                      .mapInArrow(_cut_slices(SLICE), SLICES))
    local = cut.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(
        "slice", "lang", (F.col("at") + 1).cast("long").alias("local"), F.col("w.words").alias("word"),
        F.col("w.counts").alias("count"))
    total = scratch.put("total", local.groupBy("lang").agg(F.sum("count").alias("n")))
    words = local.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    words = _ranked(words, [F.col("f").desc(), F.col("word").asc()], scratch, "ranks-1")
    told = local.select("slice", "lang", "local", "word").join(words.select("lang", "word", "id"), ["lang", "word"])
    seq = (scratch.get("slices").select("slice", "lang", "ids").groupBy("slice", "lang")
           .cogroup(told.select("slice", "lang", "local", "id").groupBy("slice", "lang")).applyInArrow(_rename, SEQUENCE))
    seq = scratch.put("sequence-1", seq)
    scratch.drop("slices")
    tokens = total.agg(F.sum("n")).first()[0] or 0
    target = 1 << max(0, -(-tokens // PER_BUCKET) - 1).bit_length()
    first = min(target, FIRST_BUCKETS)
    levels = [words]
    for size in range(2, longest + 1):
        counts = scratch.put(f"counts-{size}", seq.mapInArrow(_count_slices(first), COUNTS))
        pairs = _frequent_pairs(counts, first, target, least, scratch, f"counts-{size}")
        pairs = _ranked(pairs, [F.col("f").desc(), F.col("left").asc(), F.col("right").asc()], scratch, f"ranks-{size}")
        levels.append(pairs.drop("bucket"))
        if size < longest:
            asked, _ = _salted(counts.select("slice", "lang", "bucket", "size", "cells"), scratch, f"asked-{size}")
            known = pairs.join(scratch.get(f"asked-{size}"), ["lang", "bucket"]).withColumn(
                "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
            told = (asked.groupBy("lang", "bucket", "salt").cogroup(known.groupBy("lang", "bucket", "salt"))
                    .applyInArrow(_tell, TOLD))
            seq = scratch.put(f"sequence-{size}", seq.groupBy("slice", "lang").cogroup(told.groupBy("slice", "lang"))
                              .applyInArrow(_pairs_renamed, SEQUENCE))
        scratch.drop(f"counts-{size}", f"sequence-{size - 1}")
    scratch.drop(f"sequence-{longest - 1}")
    return levels, total


def _spelled(levels: list[DataFrame], scratch: Scratch) -> list[DataFrame]:
    """Phrases with their words; ``pre[k]`` and ``suf[k]`` are the counts of
    their first and last k + 1 words."""
    one = F.array(F.col("f"))
    out = [levels[0].select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"),
                            one.alias("pre"), one.alias("suf"), "f")]
    for k, level in enumerate(levels[1:], 2):
        left = out[-1].select("lang", F.col("id").alias("left"), F.col("phrase").alias("_phrase"), F.col("pre").alias("_pre"))
        right = out[-1].select("lang", F.col("id").alias("right"), "last", F.col("suf").alias("_suf"))
        spelled = level.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        out.append(scratch.put(f"spelled-{k}", spelled.select(
            "lang", "id", "left", "right", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last",
            F.concat("_pre", one).alias("pre"), F.concat("_suf", one).alias("suf"), "f")))
    return out


def _whole(name: str) -> str:
    """Beyond 64 bits: SQL text of a count as a decimal."""
    return f"cast({name} as decimal(20,0))"


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """Each language's best ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    scratch = Scratch(docs.sparkSession, "phrases")
    levels, total = phrase_counts(docs, least, longest, scratch)
    spelled = _spelled(levels, scratch)
    scored = []
    for m in range(2, longest + 1):
        rows = spelled[m - 1]
        if m < longest:
            longer = spelled[m]
            inside = (longer.select("lang", F.col("left").alias("id"), F.col("f").alias("_f"))
                      .union(longer.select("lang", F.col("right").alias("id"), F.col("f").alias("_f")))
                      .groupBy("lang", "id").agg(F.max("_f").alias("_f")))
            rows = rows.join(inside, ["lang", "id"], "left").where(
                f"_f is null or 100 * {_whole('_f')} < {COVER} * {_whole('f')}")
        cut = F.array_min(F.array(*[F.struct(
            F.expr(f"(2000000 * {_whole('f')}) div ({_whole(f'pre[{k - 1}]')} + {_whole(f'suf[{m - k - 1}]')})").alias("score"),
            F.lit(k).alias("k"), F.col("pre")[k - 1].alias("l"), F.col("suf")[m - k - 1].alias("r")) for k in range(1, m)]))
        scored.append(rows.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut")))
    best = scored[0]
    for s in scored[1:]:
        best = best.union(s)
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # laid out by range, as one language may hold most candidates
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = places(best, ["lang"], order, scratch, "best").where(F.col("pos") < top).withColumn("rank", F.col("pos") + 1)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: words of pieces; then phrases, counts, cuts and the rule on longer ones as stated
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS g FROM words, range(1, {LONGEST + 1}) r(m)),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
candidates AS (SELECT lang, g, f AS a FROM f WHERE len(g) >= 2 AND f >= {LEAST}),
parts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidates),
cuts AS (
  SELECT p.lang, p.g, p.a, p.k, x.f AS l, y.f AS r, (2000000::HUGEINT * p.a) // (x.f::HUGEINT + y.f) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.g = p.g[:p.k] JOIN f y ON y.lang = p.lang AND y.g = p.g[p.k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, a, len(g) AS m, unnest(range(2, len(g))) AS size, g FROM candidates),
parts_of AS (
  SELECT lang, a AS f, unnest(list_transform(range(1, m - size + 2), lambda i: g[i:i + size - 1])) AS g FROM inside),
covered AS (SELECT DISTINCT c.lang, c.g FROM candidates c JOIN parts_of p ON c.lang = p.lang AND c.g = p.g
            WHERE 100::HUGEINT * p.f >= {COVER}::HUGEINT * c.a),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM lowest ANTI JOIN covered USING (lang, g)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
