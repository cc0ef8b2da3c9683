"""Language-model scores by prediction by partial matching (PPM, escape D).

The model is a trie of byte contexts up to ``ORDER`` symbols, counted over all
training texts (A-Z lower-cased, UTF-8 bytes, with start and end marks). A
symbol is sought in the longest context first. A context with total ``T`` and
``D`` distinct symbols gives a seen symbol ``(count - 1/2) / T`` and the escape
``(D / 2) / T``; in the next shorter context the symbols of the longer one are
excluded, down to a uniform order -1. An unseen context passes on without cost.
As the symbols of a context are among those of every shorter one, what
exclusion leaves depends on the context alone; it is worked out once per model.
The trie is kept as sorted arrays by order, dealt to parts by the last symbols
of the context. A slice of texts looks up each of its distinct (context,
symbol) cells once, and the code length of a document accumulates over its
bytes and its end mark.

Symbols are 6 bits: 0 marks start and end, 1 to 62 are the most frequent bytes
of the training texts, 63 stands for any other byte, which is then coded by its
own frequency. All counts are exact, and no cell is left out: the most frequent
cells, at most ``MODEL_CELLS``, are broadcast with their code lengths; tokens of
all other cells go to the part that holds their contexts, where the code length
is worked out from all counts, and come back as sums per document. What is
broadcast changes the way, not the score.

The base score needs counts of words, whose number grows with the corpus: word
counts are dealt by hash to buckets. Words of at least ``N / FREQUENT`` tokens,
thus at most ``FREQUENT`` of them, are broadcast; tokens of all other words go
to their bucket and come back as sums per document, so a word in every document
is never shuffled per document. Words are told apart by 64-bit hashes.

Defined results: null text counts as empty (its end is the one token); repeated
rows are scored each; without training rows all counts are zero; a null id
counts as empty text in the fold; other columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, prepare, remainder, slices, text_buffers
from .ngram_join import word_bounds, word_hashes

ORDER = 5
SHORT = 2                    # contexts up to here are known to all parts (64 ** 3 cells)
SYMBOLS = 64
MODEL_CELLS = 2_000_000
FREQUENT = 1_000_000
SLICE = 4 << 20
PARTS, BUCKETS = 64, 128
RARE = SYMBOLS - 1


# ---- the model ------------------------------------------------------------

def symbol_map(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte to symbol, and log10 probability of a byte within symbol 63."""
    h = np.bincount(ASCII_LOWER, weights=histogram, minlength=256).astype(np.int64)
    order = np.lexsort((np.arange(256), -h))
    symbol = np.full(256, RARE, np.uint64)
    symbol[order[:SYMBOLS - 2]] = np.arange(1, SYMBOLS - 1)
    rest = symbol == RARE
    inner = np.zeros(256)
    inner[rest] = np.log10((h[rest] + 1) / (h[rest].sum() + rest.sum()))
    return symbol[ASCII_LOWER], inner[ASCII_LOWER]


def gram_index(raw: np.ndarray, off: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell (context and symbol) of every byte and end mark of all texts, in
    order, and the offsets of the texts in it."""
    docs = len(off) - 1
    pad = ORDER + 1
    line = np.zeros(len(raw) + pad * docs, np.uint64)
    at = np.arange(len(raw)) + np.repeat(np.arange(docs) * pad + ORDER, np.diff(off))
    line[at] = symbol[raw]
    cell = line[ORDER:].copy()
    for k in range(1, ORDER + 1):
        cell += line[ORDER - k:len(line) - k] << np.uint64(6 * k)
    length = np.diff(off) + 1
    out = off + np.arange(docs + 1)
    keep = np.arange(int(out[-1])) + np.repeat(np.arange(docs) * ORDER, length)
    return cell[keep], out


def shorter(cells: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the cells of contexts of ``order`` symbols, from longer ones."""
    u, inv = np.unique(cells & np.uint64((1 << 6 * (order + 1)) - 1), return_inverse=True)
    return u, np.bincount(inv, counts, len(u)).astype(np.int64)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class Trie:
    """Cells by order, and per context: total, kinds, and what the next
    shorter context holds besides the symbols of this one."""

    def __init__(self, cells: list[np.ndarray], counts: list[np.ndarray]):
        self.cells, self.counts = cells, counts
        self.contexts, self.total, self.kinds, self.rest, self.rest_kinds = [], [], [], [], []
        for k, (u, n) in enumerate(zip(cells, counts)):
            ctx, inv = np.unique(u >> np.uint64(6), return_inverse=True)
            total = np.bincount(inv, n, len(ctx))
            kinds = np.bincount(inv, minlength=len(ctx))
            if k:
                tail = np.uint64((1 << 6 * k) - 1)
                at, _ = _find(cells[k - 1], u & tail)          # the same symbol one order down
                inside = np.bincount(inv, counts[k - 1][at], len(ctx))
                up, _ = _find(self.contexts[k - 1], ctx & (tail >> np.uint64(6)))
                self.rest.append(self.total[k - 1][up] - inside)
                self.rest_kinds.append(self.kinds[k - 1][up] - kinds)
            else:
                self.rest.append(np.zeros(len(ctx)))
                self.rest_kinds.append(SYMBOLS - kinds)        # order -1: the symbols not met
            self.contexts.append(ctx)
            self.total.append(total)
            self.kinds.append(kinds)

    def logs(self, cells: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of distinct cells of the longest order."""
        out = np.zeros(len(cells))
        live = np.arange(len(cells))                           # not coded yet
        size = np.full(len(cells), -1.0)                       # of what exclusion left here; -1: not begun
        kinds = np.zeros(len(cells))
        for k in range(len(self.cells) - 1, -1, -1):
            x = cells[live] & np.uint64((1 << 6 * (k + 1)) - 1)
            at, known = _find(self.contexts[k], x >> np.uint64(6))
            cell, hit = _find(self.cells[k], x)
            begun = size[live] >= 0
            total = np.where(begun, size[live], self.total[k][at] if len(self.total[k]) else 0)
            left = np.where(begun, kinds[live], self.kinds[k][at] if len(self.kinds[k]) else 0)
            here = known & (left > 0)
            hit &= here
            out[live[hit]] += np.log10((self.counts[k][cell[hit]] - 0.5) / total[hit])
            miss = here & ~hit
            out[live[miss]] += np.log10(0.5 * left[miss] / total[miss])
            # the next order excludes the symbols of this context
            size[live[known]] = self.rest[k][at[known]]
            kinds[live[known]] = self.rest_kinds[k][at[known]]
            live = live[~hit]
        met = self.kinds[0][0] if len(self.kinds[0]) else 0
        out[live] -= np.log10(max(1, SYMBOLS - met))
        return out


# ---- counting and scoring -------------------------------------------------

def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for b in batches:
        for part in slices(b, "text", SLICE):
            total += np.bincount(text_buffers(part.column(0))[0], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["byte", "n"])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _pairs(values: np.ndarray, counts: np.ndarray) -> bytes:
    # counts in as many bytes as the largest needs
    wide = np.uint64 if len(counts) and int(counts.max()) >> 32 else np.uint32
    return np.array([len(values), np.dtype(wide).itemsize], np.uint32).tobytes() + values.tobytes() + counts.astype(wide).tobytes()


def _read_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = np.frombuffer(blob, np.uint32, 2).tolist()
    return np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.uint64 if size == 8 else np.uint32, n, 8 + 8 * n)


def _words(part: pa.Array):
    """Hashes and texts of all words."""
    raw, off = text_buffers(part)
    data = ASCII_LOWER[raw]
    start, end, doc = word_bounds(data, off)
    return raw, off, (word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)), doc


def _cell_part(u: np.ndarray, parts: int) -> np.ndarray:
    """Part of a cell by the last symbols of its context, so that a part holds
    all cells of its contexts of more than ``SHORT`` symbols."""
    h = (u >> np.uint64(6) & np.uint64((1 << 6 * (SHORT + 1)) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _count(symbol: np.ndarray, buckets: int, parts: int):
    """Word (kind 0) and cell (kind 1) counts of a partition, as blobs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            for part in slices(b, "text", SLICE):
                raw, off, h, _ = _words(part.column(0))
                held.append(np.unique(gram_index(raw, off, symbol)[0], return_counts=True))
                if len(held) > 8:
                    held = [_sum(held)]
                u, c = np.unique(h, return_counts=True)
                yield _blobs(0, u, c, np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1)))
        if held:
            u, c = _sum(held)
            where = _cell_part(u, parts)
            order = np.argsort(where, kind="stable")
            yield _blobs(1, u[order], c[order], np.searchsorted(where[order], np.arange(parts + 1)))
    return run


def _sum(parts: list) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)


def _blobs(kind: int, values, counts, cut_at) -> pa.RecordBatch:
    rows = [(k, _pairs(values[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(cut_at[:-1], cut_at[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
                                       pa.array([r[1] for r in rows], pa.binary())], names=["kind", "part", "blob"])


def _merge(table: pa.Table) -> pa.Table:
    u, c = _sum([_read_pairs(b) for b in table.column("blob").to_pylist()])
    return pa.table({"kind": table.column("kind").slice(0, 1), "part": table.column("part").slice(0, 1),
                     "blob": pa.array([_pairs(u, c)], pa.binary()), "total": pa.array([int(c.sum())]),
                     "kinds": pa.array([len(u)]),
                     "often": pa.array([np.bincount(np.minimum(c, STEPS), minlength=STEPS + 1).tolist()], pa.list_(pa.int64()))})


#: counts up to this are told apart when the model's size is set
STEPS = 4096


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the contexts of ``SHORT`` symbols in a partition's parts."""
    u, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches:
        for blob in b.column(0).to_pylist():
            u, c = _sum([(u, c), shorter(*_read_pairs(blob), SHORT)])
    yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c)], names=["cell", "n"])


def _part_trie(low: list, u: np.ndarray, c: np.ndarray) -> Trie:
    """The trie for the cells of a part, from its counts and the short contexts."""
    levels = {ORDER: (u, c.astype(np.int64))}
    for k in range(ORDER - 1, SHORT, -1):
        levels[k] = shorter(*levels[k + 1], k)
    both = list(low) + [levels[k] for k in range(SHORT + 1, ORDER + 1)]
    return Trie([x[0] for x in both], [x[1] for x in both])


def _frequent(low, least: int):
    """Cells of at least ``least`` occurrences and their log10 probabilities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                u, c = _read_pairs(blob)
                big = u[c >= least]
                if len(big):
                    value = _part_trie(low.value, u, c).logs(big)
                    yield pa.RecordBatch.from_arrays([pa.array([big.tobytes()], pa.binary()), pa.array([value.tobytes()], pa.binary())],
                                                     names=["cells", "logs"])
    return run


def _most(least: int):
    """The words of at least so many tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blob in b.column(0).to_pylist():
                u, c = _read_pairs(blob)
                big = c >= least
                out.append(_pairs(u[big], c[big]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["blob"])
    return run


_MODEL: dict = {}


class _Model:
    """Tables of a worker process, built once from the broadcast counts."""

    def __init__(self, shared):
        self.symbol, self.inner, self.words, self.counts, self.cells, self.logs, size = shared
        self.value = np.log10((self.counts + 1.0) / size)
        self.unknown = np.log10(1.0 / size)

    @classmethod
    def of(cls, broadcast):
        if _MODEL.get("id") != broadcast.value[0]:
            _MODEL.clear()
            _MODEL["model"] = cls(broadcast.value[1:])
            _MODEL["id"] = broadcast.value[0]
        return _MODEL["model"]

    def scores(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text by the frequent cells; the other
        cells, a row each, and their texts."""
        cell, at = gram_index(raw, off, self.symbol)
        u, inv = np.unique(cell, return_inverse=True)
        where, often = _find(self.cells, u)
        value = np.zeros(len(u))
        value[often] = self.logs[where[often]]
        out = np.add.reduceat(value[inv], at[:-1]) if len(at) > 1 else np.zeros(0)
        rare = np.flatnonzero(self.symbol[raw] == RARE)
        if len(rare):
            doc = np.searchsorted(off, rare, side="right") - 1
            out += np.bincount(doc, self.inner[raw[rare]], len(out))
        rest = np.flatnonzero(~often[inv])
        return out, cell[rest], np.searchsorted(at, rest, side="right") - 1


def _tokens(base: int, doc: np.ndarray, value: np.ndarray, where: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Blobs by part: base of the row numbers, then row and value per token."""
    order = np.argsort(where.astype(np.uint32), kind="stable")
    cut_at = np.searchsorted(where[order], np.arange(parts + 1))
    return [(k, np.array([base], np.uint64).tobytes() + doc[order[x:y]].astype(np.uint16).tobytes() + value[order[x:y]].tobytes())
            for k, (x, y) in enumerate(zip(cut_at[:-1], cut_at[1:])) if y > x]


def _score(shared, buckets: int, parts: int):
    """A row per document (part -1) and the tokens of infrequent words, and
    after these of infrequent cells, as blobs by bucket and part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _Model.of(shared)
        base = TaskContext.get().partitionId() << 40
        names = ["part", "blob", "row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score"]
        for b in batches:
            for part in slices(b, "text", SLICE):
                for lo in range(0, part.num_rows, 65_536):
                    p = part.slice(lo, 65_536)
                    n = p.num_rows
                    raw, off, h, doc = _words(p.column(2))
                    u, inv = np.unique(h, return_inverse=True)
                    at = np.minimum(np.searchsorted(m.words, u), max(len(m.words) - 1, 0))
                    often = m.words[at] == u if len(m.words) else np.zeros(len(u), bool)
                    value = np.where(often, m.value[at], m.unknown) if len(m.words) else np.full(len(u), m.unknown)
                    logs = np.bincount(doc, value[inv], n).astype(np.float64)
                    known = np.bincount(doc, often[inv].astype(np.int64), n).astype(np.int64)
                    score, cells, of = m.scores(raw, off)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(base + np.arange(n)), p.column(0),
                         p.column(1), pa.array(np.bincount(doc, minlength=n) + 1), pa.array(known), pa.array(logs),
                         pa.array(score)], names=names)
                    rest = np.flatnonzero(~often[inv])
                    rows = _tokens(base, doc[rest], h[rest], _bucket(h[rest], buckets), buckets)
                    rows += [(buckets + k, x) for k, x in _tokens(base, of, cells, _cell_part(cells, parts), parts)]
                    k = len(rows)
                    if k:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                             pa.nulls(k, pa.int64()), pa.nulls(k, p.column(0).type), pa.nulls(k, pa.bool_()),
                             pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()),
                             pa.nulls(k, pa.float64())], names=names)
                    base += n
    return run


def _read_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of the tokens of all blobs."""
    row, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for blob in table.column("blob").to_pylist():
        n = (len(blob) - 8) // 10
        row.append(np.frombuffer(blob, np.uint64, 1)[0].astype(np.int64) + np.frombuffer(blob, np.uint16, n, 8).astype(np.int64))
        value.append(np.frombuffer(blob, np.uint64, n, 8 + 2 * n))
    return np.concatenate(row), np.concatenate(value)


def _per_row(row: np.ndarray, value: np.ndarray, groups: int) -> pa.Table:
    """Sums and numbers of values per row, as blobs by group of rows."""
    r, inv = np.unique(row, return_inverse=True)
    logs, known = np.bincount(inv, value, len(r)), np.bincount(inv, minlength=len(r))
    group = (r // 4096) % groups
    order = np.argsort(group, kind="stable")
    r, logs, known, group = r[order], logs[order], known[order], group[order]
    cut_at = np.searchsorted(group, np.arange(groups + 1))
    out = [(g, r[a:b].tobytes() + logs[a:b].tobytes() + known[a:b].astype(np.int64).tobytes())
           for g, (a, b) in enumerate(zip(cut_at[:-1], cut_at[1:])) if b > a]
    return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})


def _rare(groups: int):
    """Sums per document over the tokens of a bucket, as blobs by group of rows."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, h = _read_tokens(left)
        if not right.num_rows:
            row, h = row[:0], h[:0]
        u, c = _read_pairs(right.column("blob")[0].as_py()) if right.num_rows else (h, h)
        at, hit = _find(u, h)
        return _per_row(row[hit], np.log10(c[at[hit]] + 1.0), groups)
    return run


def _rare_cells(low, groups: int):
    """Sums per document over the cells of a part, as blobs by group of rows."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, cell = _read_tokens(left)
        if not len(row):
            return _per_row(row, np.zeros(0), groups)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        u, c = _read_pairs(right.column("blob")[0].as_py()) if right.num_rows else none
        x, inv = np.unique(cell, return_inverse=True)
        return _per_row(row, _part_trie(low.value, u, c).logs(x)[inv], groups)
    return run


def _add_up(table: pa.Table) -> pa.Table:
    rows, logs, known = [], [], []
    for blob in table.column("blob").to_pylist():
        n = len(blob) // 24
        rows.append(np.frombuffer(blob, np.int64, n))
        logs.append(np.frombuffer(blob, np.float64, n, 8 * n))
        known.append(np.frombuffer(blob, np.int64, n, 16 * n))
    u, inv = np.unique(np.concatenate(rows), return_inverse=True)
    return pa.table({"row": pa.array(u), "more_logs": pa.array(np.bincount(inv, np.concatenate(logs), len(u))),
                     "more_known": pa.array(np.bincount(inv, np.concatenate(known), len(u)).astype(np.int64))})


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    per row; rows whose id remainder is ``held`` are not learned from."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    train = src.where("NOT held_out").select("text")
    counted = train.mapInArrow(_histogram, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(256, np.int64)
    for r in counted:
        histogram[r["byte"]] = r["n"]
    symbol, inner = symbol_map(histogram)
    buckets = max(BUCKETS, int(histogram.sum() >> 24))
    parts = min(SYMBOLS ** 2, max(PARTS, buckets))
    texts = train.count()

    blobs = train.mapInArrow(_count(symbol, buckets, parts), "kind int, part int, blob binary")
    counts = cut(blobs.groupBy("kind", "part").applyInArrow(
        _merge, "kind int, part int, blob binary, total long, kinds long, often array<long>"), "ppm-counts")
    words = counts.where("kind = 0")
    tokens, kinds = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    total, distinct = tokens + texts, kinds + (1 if texts else 0)          # with the end of every text
    often = words.select("blob").mapInArrow(_most(max(1, -(-tokens // FREQUENT))), "blob binary").collect()
    u, c = _join([_read_pairs(bytes(r["blob"])) for r in often])
    cells = counts.where("kind = 1")
    # broadcast: at most MODEL_CELLS cells of the longest order
    sizes = np.zeros(STEPS + 1, np.int64)
    for r in cells.select(F.posexplode("often").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        sizes[r["k"]] = r["n"]
    above = np.cumsum(sizes[::-1])[::-1]
    least = next((k for k in range(1, STEPS + 1) if above[k] <= MODEL_CELLS), STEPS)
    if above[STEPS] > MODEL_CELLS:                        # a corpus beyond the steps: by the share that bounds them
        least = max(STEPS, -(-int(cells.agg(F.sum("total")).first()[0]) // MODEL_CELLS))
    short = cells.select("blob").mapInArrow(_low, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    levels = [(short.column("cell").to_numpy().astype(np.uint64), short.column("n").to_numpy())]
    for k in range(SHORT - 1, -1, -1):
        levels.insert(0, shorter(*levels[0], k))
    low = spark.sparkContext.broadcast(levels)
    top = cells.select("blob").mapInArrow(_frequent(low, least), "cells binary, logs binary").collect()
    known, logs = _join([(np.frombuffer(r["cells"], np.uint64), np.frombuffer(r["logs"], np.float64)) for r in top])
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, symbol, inner, u, c.astype(np.int64), known, logs, total + distinct + 1.0))
    del top, often

    scored = cut(src.mapInArrow(_score(shared, buckets, parts), f"part int, blob binary, row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, "
                                "held_out boolean, n_tokens long, n_known long, logs double, score double"), "ppm-scored")
    groups = max(BUCKETS, buckets)
    rest = scored.where(f"part >= 0 AND part < {buckets}").select("part", "blob")
    rare = (rest.groupBy("part").cogroup(words.select("part", "blob").groupBy("part"))
            .applyInArrow(_rare(groups), "part int, blob binary"))
    added = rare.groupBy("part").applyInArrow(_add_up, "row long, more_logs double, more_known long")
    rest = scored.where(f"part >= {buckets}").select((F.col("part") - buckets).alias("part"), "blob")
    rare = (rest.groupBy("part").cogroup(cells.select("part", "blob").groupBy("part"))
            .applyInArrow(_rare_cells(low, groups), "part int, blob binary"))
    scores = rare.groupBy("part").applyInArrow(_add_up, "row long, more_logs double, more_known long").select("row", F.col("more_logs").alias("more_score"))
    end = float(np.log10((texts + 1.0) / (total + distinct + 1.0)))
    return (scored.where("part = -1").join(added, "row", "left").join(scores, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if texts else 0)).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end).alias("base_score"),
                    (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")))


def _join(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and their counts or logs of all blobs (no value is in two of them)."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    u, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(u, kind="stable")
    return u[order], c[order]


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
