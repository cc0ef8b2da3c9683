"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct 5-word shingles; documents link when the
Jaccard similarity of their sets is 0.75 or more. The steps, all distributed:

1. **Equal sets.** Every document gets the key of its set; copies share it and
   are one set from here on, so copies cost one row each.
2. **Index.** Shingles are dealt by value to buckets (packed, deduplicated by
   set key on the way); a bucket finds the shingles of two or more sets and
   their frequency. Shingles of one set only can meet nobody: they count in
   the size of the set and are dropped. The others go back to their sets,
   rarest first.
3. **Lists.** The first ``n - ceil(0.75 n) + 1`` shingles of a set (rarest
   first; lone ones use up places) are its prefix; two linked sets share one.
   Index lists are cut into blocks by set size; entries carry their position,
   and blocks or entries are skipped where the sizes or the shingles left
   after both positions cannot reach the needed overlap.
4. **Pivots.** Every block's least set is its pivot, and each entry is compared
   with the pivot only: rows grow with the lists, not with their squares. Long
   blocks that still hold several components get ``PIVOTS`` further pivots.
5. **Derived answers.** Sets that a pivot links are one component, so the pairs
   among them need no answer. For pairs across components, when both sets
   have been compared with the same pivot ``P``, the counted overlaps give
   ``o(x,P) + o(y,P) - |P| <= |x & y| <= min(o(x,P), o(y,P)) + min(|x| -
   o(x,P), |y| - o(y,P))``, which decides many pairs without reading the sets.
   The rest is compared exactly. In a list, the entries of its most frequent
   component never meet each other.

Nothing is sampled or capped; every pair of sets that could link is either
inside one component, decided by the bounds, or compared. Shingles are 48-bit
hashes and set keys 64-bit hashes (a false match of two given sets of 500 has
a chance below 1e-9).

Defined results: null, empty and blank texts have no shingles and link with
nothing; fewer than five words make one shingle; repeated rows stay, each with
the component of its id; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .common import ASCII_LOWER, IS_SPACE, components, cut, forget, lower_ascii, prepare, slices, text_buffers

WORDS = 5
PERCENT = 75
#: packed shingles of about this many make a bucket
BUCKET_ROWS = 2_000_000
PIVOTS, LONG = 8, 16         # further pivots, and the entries from which a block is long
BUCKETS, GROUPS = 64, 128            # at least so many
SLICE = 4 << 20
TOKEN_BITS = 48
_MASK = np.uint64((1 << TOKEN_BITS) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, off: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word, a run of bytes that are not in
    ``apart`` (by default ``[^\\x20\\x09-\\x0D]+``)."""
    inside = ~apart[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


#: bytes hashed at once
WINDOW = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for usual windows."""
    kept = _POWERS.get("up")
    if kept is None or len(kept) < n:
        arrays = []
        for x in (_BASE, _BASE_INV):
            a = np.full(max(n, WINDOW + 1), x, np.uint64)
            a[0] = 1
            arrays.append(np.cumprod(a, dtype=np.uint64))
        if n > WINDOW + 1:                      # a very long word
            return arrays[0], arrays[1]
        _POWERS["up"], _POWERS["down"] = arrays
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ascending byte ranges: a rolling polynomial, then
    mixed. Done in windows, as the hash does not depend on where a word stands."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        lo = int(start[a])
        b = max(a + 1, int(np.searchsorted(end, lo + WINDOW, side="right")))
        part, n = data[lo:int(end[b - 1])], int(end[b - 1]) - lo
        power, back = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[:n], dtype=np.uint64, out=total[1:])
        first, last = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64))
        a = b
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as ``text << 48 | shingle``, sorted, and
    the offsets of the texts in it (at most 65,536 texts)."""
    raw, off = text_buffers(texts)
    docs = len(off) - 1
    data = ASCII_LOWER[raw]
    start, end, doc = word_bounds(data, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    h = word_hashes(data, start, end)
    count = np.bincount(doc, minlength=docs)
    with np.errstate(over="ignore"):
        multiplier = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        acc = np.zeros(len(h), np.uint64)
        for k in range(words):
            acc[:len(h) - k] += h[k:] * multiplier[k]
        first = np.cumsum(count) - count
        place = np.arange(len(h)) - first[doc]
        full = place + words <= count[doc]
        # the one shingle of a text with fewer words
        few = np.flatnonzero((count > 0) & (count < words))
        short = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            has = count[few] > k
            short[has] += h[first[few[has]] + k] * multiplier[k]
        short += count[few].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        owner = np.concatenate([doc[full], few]).astype(np.uint64)
        value = mix(np.concatenate([acc[full], short]))
    packed = np.sort(owner << np.uint64(TOKEN_BITS) | (value & _MASK))
    packed = packed[np.append(True, packed[1:] != packed[:-1])]
    return packed, np.searchsorted(packed >> np.uint64(TOKEN_BITS), np.arange(docs + 1))


def set_keys(packed: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, the same for equal sets."""
    if not len(packed):
        return np.zeros(len(off) - 1, np.int64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(packed & _MASK), dtype=np.uint64)])
        return mix(total[off[1:]] - total[off[:-1]] + (off[1:] - off[:-1]).astype(np.uint64)).view(np.int64)


def _doc_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for lo in range(0, part.num_rows, 65_536):
                yield part.slice(lo, 65_536)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _doc_slices(batches):
        packed, off = shingle_sets(part.column(1))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(np.diff(off)), pa.array(set_keys(packed, off))], names=["doc_id", "n", "key"])


# A blob holds shingles by set: number of sets, their keys, sizes and counts
# here, then the low and high parts of the 48-bit shingles.
def _pack(keys, sizes, counts, tokens, extra=None) -> bytes:
    parts = [np.array([len(keys)], np.uint32), keys.astype(np.uint64), sizes.astype(np.uint32),
             counts.astype(np.uint32), tokens.astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint16)]
    if extra is not None:                               # frequencies only order: beyond 65,535 the shingle does
        parts.append(np.minimum(extra, 65_535).astype(np.uint16))
    return b"".join(p.tobytes() for p in parts)


def _unpack(blob: bytes, extra: bool = False):
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    at = 4
    keys = np.frombuffer(blob, np.uint64, n, at)
    sizes = np.frombuffer(blob, np.uint32, n, at + 8 * n)
    counts = np.frombuffer(blob, np.uint32, n, at + 12 * n)
    at += 16 * n
    m = int(counts.sum())
    low = np.frombuffer(blob, np.uint32, m, at)
    high = np.frombuffer(blob, np.uint16, m, at + 4 * m)
    tokens = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    more = np.frombuffer(blob, np.uint16, m, at + 6 * m) if extra else None
    return keys, sizes, counts, tokens, more


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _grouped_blobs(where: np.ndarray, key: np.ndarray, size: np.ndarray, token: np.ndarray, extra=None):
    """One blob per value of ``where``; rows sorted by (where, key)."""
    for a, b in zip(s := _runs(where), np.append(s[1:], len(where))):
        k = key[a:b]
        r = _runs(k)
        yield int(where[a]), _pack(k[r], size[a:b][r], np.diff(np.append(r, b - a)), token[a:b],
                                   None if extra is None else extra[a:b])


def _scatter(buckets: int):
    """Shingles of a slice of texts, one blob per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _doc_slices(batches):
            packed, off = shingle_sets(part.column(0))
            n, keys = np.diff(off), set_keys(packed, off).view(np.uint64)
            kept = np.zeros(len(n), bool)
            kept[np.unique(keys, return_index=True)[1]] = True       # copies in this slice go
            owner = (packed >> np.uint64(TOKEN_BITS)).astype(np.int64)
            packed, owner = packed[kept[owner]], owner[kept[owner]]
            token = packed & _MASK
            bucket = ((token >> np.uint64(TOKEN_BITS - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.uint32)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 65_536 else bucket, kind="stable")
            rows = list(_grouped_blobs(bucket[order], keys[owner[order]], n[owner[order]], token[order]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["bucket", "blob"])
    return run


def _shared(groups: int):
    """Of a bucket: shingles of two or more sets with their frequency, one
    blob per group of set keys."""
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in table.column("blob").to_pylist()]
        count = np.concatenate([p[2] for p in parts])
        key = np.repeat(np.concatenate([p[0] for p in parts]), count)
        size = np.repeat(np.concatenate([p[1] for p in parts]), count)
        token = np.concatenate([p[3] for p in parts])
        del parts
        order = np.argsort(token, kind="stable")
        t = token[order]
        same = t[1:] == t[:-1]
        again = np.append(False, same) | np.append(same, False)
        pick = order[again]
        key, size, token = key[pick], size[pick], token[pick]
        order = np.lexsort((key, token))
        key, size, token = key[order], size[order], token[order]
        new = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])) if len(token) else np.zeros(0, bool)
        key, size, token = key[new], size[new], token[new]
        starts = _runs(token)
        df = np.repeat(np.diff(np.append(starts, len(token))), np.diff(np.append(starts, len(token))))
        live = df > 1
        key, size, token, df = key[live], size[live], token[live], df[live]
        where = ((key >> np.uint64(40)) * np.uint64(groups) >> np.uint64(24)).astype(np.int64)
        order = np.lexsort((key, where))
        rows = list(_grouped_blobs(where[order], key[order], size[order], token[order], df[order]))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()),
                         "blob": pa.array([r[1] for r in rows], pa.binary())})
    return run


def _assemble(table: pa.Table) -> pa.Table:
    """Sets whose prefix reaches a shared shingle: key, size, length of the
    shared prefix, lone shingles, shared shingles from rare to frequent."""
    parts = [_unpack(b, True) for b in table.column("blob").to_pylist()]
    count = np.concatenate([p[2] for p in parts])
    key = np.repeat(np.concatenate([p[0] for p in parts]), count)
    size = np.repeat(np.concatenate([p[1] for p in parts]), count).astype(np.int64)
    token = np.concatenate([p[3] for p in parts])
    df = np.concatenate([p[4] for p in parts])
    order = np.lexsort((token, df, key))
    key, size, token = key[order], size[order], token[order]
    starts = _runs(key)
    ends = np.append(starts[1:], len(key))
    out = ([], [], [], [], [])
    for a, b in zip(starts.tolist(), ends.tolist()):
        n = int(size[a])
        lone = n - (b - a)
        prefix = n - -(-PERCENT * n // 100) + 1 - lone
        if prefix > 0:
            for col, v in zip(out, (int(key[a].astype(np.int64)), n, min(prefix, b - a), lone, token[a:b].tobytes())):
                col.append(v)
    return pa.table({"key": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()),
                     "prefix": pa.array(out[2], pa.int32()), "lone": pa.array(out[3], pa.int32()),
                     "tokens": pa.array(out[4], pa.binary())})


def _list_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of the prefixes: shingle, size block, set, size, position."""
    for b in batches:
        key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        prefix, lone = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()
        if not len(key):
            continue
        tokens = np.concatenate([np.frombuffer(t.as_buffer(), np.int64, int(p)) for t, p in zip(b.column(4), prefix)])
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens), pa.array(np.repeat(size_block(n), prefix)), pa.array(np.repeat(key, prefix)),
             pa.array(np.repeat(n, prefix)), pa.array((place + np.repeat(lone, prefix)).astype(np.int64))],
            names=["token", "block", "key", "n", "pos"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared shingles of every prefix, in order."""
    for b in batches:
        heads = [np.frombuffer(t.as_buffer(), np.int64, int(p)) for t, p in zip(b.column(4), b.column(2).to_numpy())]
        off = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
        values = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.ListArray.from_arrays(pa.array(off), pa.array(values))],
                                         names=["key", "lone", "head"])


def size_block(n: np.ndarray) -> np.ndarray:
    """Blocks of sizes by powers of 4/3; linked sets are at most one apart."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int32)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact overlap of the sets of each row."""
    for b in batches:
        out = np.empty(b.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)])
            both.sort()
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), b.column(5), pa.array(out)],
                                         names=["u", "v", "nu", "nv", "overlap"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v, nu, nv, overlap`` of the pairs."""
    a = sets.select(F.col("key").alias("u"), F.col("tokens").alias("tu"), F.col("n").alias("nu"))
    b = sets.select(F.col("key").alias("v"), F.col("tokens").alias("tv"), F.col("n").alias("nv"))
    rows = pairs.join(a, "u").join(b, "v").select("u", "v", "tu", "tv", "nu", "nv")
    return rows.mapInArrow(_overlaps, "u long, v long, nu long, nv long, overlap long")


def _links(overlap, nu, nv):
    """100 * intersection >= 75 * union."""
    return 100 * overlap >= PERCENT * (nu + nv - overlap)


def _reachable(na, pa_, nb, pb):
    """Can sets of these sizes link, given that the shingles before these
    positions are not shared? (size and position filter)"""
    most = 1 + F.least(na - pa_, nb - pb) - 1
    return (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na) & ((100 + PERCENT) * most >= PERCENT * (na + nb))


def _mixed(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of the lists that hold several components, with ``main``, the
    most frequent component of the list; and (token, main)."""
    parts = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = (parts.groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("c", "comp")).alias("m"))
            .where("k > 1").select("token", F.col("m.comp").alias("main")))
    return placed.join(main, "token"), main


def _more_pivots(mixed: DataFrame) -> DataFrame:
    """Pairs of the sets of long mixed blocks with ``PIVOTS`` pivots each (the
    least by other hashes, so that lists agree on them) of another component."""
    pivots = (mixed.groupBy("token", "block").agg(F.count("*").alias("c"), F.array(*[
        F.min_by(F.struct("key", "n", "comp"), F.xxhash64("key", F.lit(seed))) for seed in range(1, PIVOTS + 1)]).alias("p"))
        .where(F.col("c") >= LONG).drop("c"))
    sets = mixed.join(pivots, ["token", "block"]).select("key", "n", "comp", "p").distinct()
    near = F.filter("p", lambda x: (x["comp"] != F.col("comp")) & (100 * x["n"] >= PERCENT * F.col("n"))
                    & (PERCENT * x["n"] <= 100 * F.col("n")))
    return sets.select(F.col("key").alias("u"), F.explode(F.array_distinct(near)).alias("x")).select("u", F.col("x.key").alias("v")).distinct()


def ngram_classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs(doc_id, text)``."""
    if words != WORDS:
        raise ValueError(f"shingles of {WORDS} words are supported")
    spark = docs.sparkSession
    prepare(spark)
    keyed = cut(docs.select("doc_id", "text").mapInArrow(_keys_of, "doc_id long, n long, key long"), "ngram-keys")
    total = keyed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, total // BUCKET_ROWS)
    groups = max(GROUPS, buckets)

    blobs = docs.select("text").mapInArrow(_scatter(buckets), "bucket int, blob binary")
    shared = blobs.groupBy("bucket").applyInArrow(_shared(groups), "part int, blob binary")
    sets = cut(shared.groupBy("part").applyInArrow(
        _assemble, "key long, n long, prefix int, lone int, tokens binary"), "ngram-sets")

    entries = cut(sets.mapInArrow(_list_entries, "token long, block int, key long, n long, pos long"), "ngram-lists")
    # pivots: the least key of every block of a list
    pivots = entries.groupBy("token", "block").agg(F.min(F.struct("key", "n", "pos")).alias("p"), F.count("*").alias("c"))
    pairs = (entries.join(pivots.where("c > 1"), ["token", "block"])
             .where(F.col("key") != F.col("p.key"))
             .where(_reachable(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
             .select(F.col("key").alias("u"), F.col("p.key").alias("v")).distinct())
    seen = cut(_compare(pairs, sets), "ngram-pivots")
    first = seen.where(_links(F.col("overlap"), F.col("nu"), F.col("nv"))).select("u", "v")
    comp = components(first, "ngram-cc")

    # long lists that hold several components still: more pivots, other hashes
    held = comp.withColumnRenamed("id", "key")
    placed = entries.join(held, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    pairs = _more_pivots(_mixed(placed)[0])
    second = cut(_compare(pairs.join(seen.select("u", "v"), ["u", "v"], "left_anti"), sets), "ngram-pivots")
    links = second.where(_links(F.col("overlap"), F.col("nu"), F.col("nv"))).select("u", "v")
    joined = components(comp.select(F.col("id").alias("u"), F.col("comp").alias("v")).union(links), "ngram-cc")
    comp, seen = joined, seen.union(second)

    # what is left: pairs of a list from different components
    best = (seen.groupBy(F.col("u").alias("key"))
            .agg(F.max_by(F.struct("v", "nv", "overlap"), F.struct(F.col("overlap") / F.col("nv"), "v")).alias("base")))
    placed = (entries.join(comp.withColumnRenamed("id", "key"), "key", "left").join(best, "key", "left")
              .select("token", "block", "key", "n", "pos", F.coalesce("comp", "key").alias("comp"),
                      F.coalesce("base.v", "key").alias("pivot"), F.coalesce("base.nv", "n").alias("np"),
                      F.coalesce("base.overlap", "n").alias("op")))
    # with the shingles of the prefix that stand before each entry: a pair is
    # met in the first list that both sets share, and nowhere else
    heads = sets.mapInArrow(_heads, "key long, lone int, head array<long>")
    placed = (_mixed(placed)[0].join(heads, "key")
              .withColumn("before", F.slice("head", F.lit(1), (F.col("pos") - F.col("lone")).cast("int"))).drop("head", "lone"))
    placed = cut(placed, "ngram-mixed")
    forget(entries)
    # only sets of neighbouring size blocks can link: a list is joined block by block
    left = placed.where("comp <> main").select(*[F.col(c).alias(f"{c}_l") if c != "token" else F.col(c)
                                                 for c in placed.columns if c != "main"])
    left = left.withColumn("block", F.explode(F.array(F.col("block_l") - 1, F.col("block_l"), F.col("block_l") + 1)))
    cand = (left.join(placed, ["token", "block"])
            .where("comp_l <> comp AND (comp = main OR key_l < key)")
            .where(_reachable(F.col("n_l"), F.col("pos_l"), F.col("n"), F.col("pos")))
            .where(~F.arrays_overlap("before_l", "before"))
            .select(F.least("key_l", "key").alias("u"), F.greatest("key_l", "key").alias("v"),
                    F.when(F.col("pivot_l") == F.col("pivot"),
                           F.least("op_l", "op") + F.least(F.col("n_l") - F.col("op_l"), F.col("n") - F.col("op"))).alias("high"),
                    F.when(F.col("pivot_l") == F.col("pivot"), F.col("op_l") + F.col("op") - F.col("np")).alias("low"),
                    (F.col("n_l") + F.col("n")).alias("sum"), F.least("comp_l", "comp").alias("cu"), F.greatest("comp_l", "comp").alias("cv"))
            .where(F.coalesce((100 + PERCENT) * F.col("high") >= PERCENT * F.col("sum"), F.lit(True)))
            .groupBy("u", "v").agg(F.any_value("cu").alias("cu"), F.any_value("cv").alias("cv"), F.max((100 + PERCENT) * F.coalesce("low", F.lit(0)) >= PERCENT * F.col("sum")).alias("sure")))
    known = seen.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    cand = cut(cand.join(known, ["u", "v"], "left_anti"), "ngram-open")
    forget(placed)
    more = _compare(cand.where("NOT sure").select("u", "v"), sets)
    more = more.where(_links(F.col("overlap"), F.col("nu"), F.col("nv"))).select("u", "v")
    # links between components; their members need not be told apart any more
    across = (more.join(cand.select("u", "v", "cu", "cv"), ["u", "v"]).select("cu", "cv")
              .union(cand.where("sure").select("cu", "cv")).distinct())
    merged = components(across.toDF("u", "v"), "ngram-cc2")

    # least document of every set, then of every component
    least = keyed.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    least = least.join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = (least.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left")
             .select("key", "first", F.coalesce("top", "comp").alias("comp")))
    top = least.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = cut(least.join(top, "comp").select("key", "component_id"), "ngram-named")
    empty = keyed.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                        F.col("doc_id").alias("component_id"))
    return (keyed.where("n > 0").join(named, "key")
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id. Rows
    of one id and the same words are one document; rows of one id with other
    words all stay, and so do rows without an id.

    The ids to look at (copies that go, and ids of several rows) are few beside
    the texts: they are broadcast up to ``joins.DEFAULT_MAX_BROADCAST_ROWS``, so
    that the texts stay where they are read. Beyond that, the texts are shuffled."""
    classes = cut(ngram_classes(docs), "ngram-classes")
    ids = (classes.where("doc_id IS NOT NULL").groupBy("doc_id")
           .agg(F.count("*").alias("__rows"), F.count_if(F.col("doc_id") == F.col("component_id")).alias("__own")))
    ids = cut(ids.where("__own = 0 OR __rows > 1"), "ngram-ids")
    again, rows = ids.agg(F.coalesce(F.max("__own"), F.lit(0)) > 1, F.count("*")).first()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    if not again:
        gone = ids.where("__own = 0").select("doc_id")
        return docs.join(bounded_broadcast(gone, rows), "doc_id", "left_anti").select(*cols)
    marked = docs.join(bounded_broadcast(ids.select("doc_id", (F.col("__own") == 0).alias("__gone")), rows), "doc_id", "left")
    words = F.sha2(F.array_join(F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), ""), " "), 256)
    several = marked.where("NOT __gone").withColumn("__words", words).dropDuplicates(["doc_id", "__words"])
    return marked.where("__gone IS NULL").select(*cols).union(several.select(*cols))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r(u, c) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT e.v, r.c FROM r JOIN e ON e.u = r.u WHERE r.c < e.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.u = w.doc_id
GROUP BY w.doc_id, n.n"""
