"""Benchmark decontamination by latent semantic retrieval.

1. Words (runs of letters and digits, A-Z lower-cased) of all documents are
   numbered by the vocabulary of the benchmark items; other words keep only
   their place. This compact table is written once and read by all passes.
2. Document passages (``PASSAGE`` words) give the document frequencies of the
   vocabulary, over all documents. The smooth idf of a word in every passage
   is 1, so items of common words keep a vector, whatever the table's size.
3. A randomised SVD of the TF-IDF matrix ``A`` of all passages finds the latent
   space in one pass: ``Y = A'(A W)`` for a random ``W`` is summed over
   partitions (a few numbers per word, whatever the number of documents), and
   the singular vectors of ``Y L'^-1`` with ``L L' = W'Y`` (the Nystroem form)
   are the leading right singular vectors of ``A``.
4. Windows of ``SIZES`` words with half overlaps are folded in and compared with
   the items of their size; pairs of cosine ``NEAR`` or more are candidates (low:
   false candidates cost little, paraphrases below it would be lost). Only pairs
   that can pass step 5 are compared: an item that needs ``m`` of its ``n`` words
   around a window must have ``SEVERAL`` of its ``n - m + SEVERAL`` rarest there
   (``Items.index``), so windows are visited from the places of those words.
   Candidates with too few of the item's words around the window go (the words
   in common bound the subsequence from above).
5. A candidate is confirmed by the longest common subsequence of the item and
   the words around the window: a share of ``SAME`` of the item's words, or of
   ``PARAPHRASE`` when the answer (the item's last sentence, at most its last
   ``ANSWER`` words) is found in order too. Items of under ``FEW`` words must be
   found whole.

Items are taken in blocks of ``ITEMS``, each block's vocabulary and vectors are
broadcast (their size is bounded by the block); documents are never collected.
Items of more than 64 words are compared by pieces of 64 words at the most; a
document holds the item if it holds a piece.

Defined results: null and empty texts and items match nothing; repeated rows
are compared each; an item repeated under several ids is reported under each;
without items nothing matches; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut, prepare, slices, text_buffers
from .ngram_join import word_bounds, word_hashes

RANK, OVERSAMPLE = 64, 8
PASSAGE, UNIT = 32, 8
SIZES = (16, 24, 32, 48, 64)
NEAR, SAME, PARAPHRASE = 0.2, 0.75, 0.55
ANSWER, FEW = 6, 8
COMMON = 1.0             # no word is left out, however many passages hold it: the smooth idf stays above 0
ITEMS = 512
SLICE = 2 << 20
PAIRS, CANDIDATES = 1 << 16, 4096        # compared at a time
SEVERAL = 3              # rare words of an item that a window must hold

#: bytes that part words: all of ASCII but letters and digits
_PART = np.zeros(256, bool)
_PART[:128] = True
_PART[48:58] = _PART[65:91] = _PART[97:123] = False


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and offsets of the texts."""
    raw, off = text_buffers(texts)
    data = ASCII_LOWER[raw]
    start, end, doc = word_bounds(data, off, _PART)
    h = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    return h, np.searchsorted(doc, np.arange(len(off)))


class Items:
    """Pieces of a block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]]):
        h, off = words_of(pa.array([t for _, t in rows], pa.string()))
        self.vocab = np.unique(h)
        ids = np.searchsorted(self.vocab, h).astype(np.int32)
        self.item, self.words, self.answer = [], [], []
        for k, (item, text) in enumerate(rows):
            own = ids[off[k]:off[k + 1]]
            pieces = -(-len(own) // SIZES[-1])
            for p in np.array_split(own, pieces) if pieces else []:
                self.item.append(item)
                self.words.append(p)
                self.answer.append(p[-ANSWER:])
            if pieces:
                last = [s for s in re.split(r"[.!?:]\s", text.strip()) if s.strip()][-1:]
                n = int(words_of(pa.array(last, pa.string()))[1][-1])
                self.answer[-1] = self.words[-1][-max(1, min(n, ANSWER)):]
        n = np.array([len(w) for w in self.words])
        self.size = np.array([next(s for s in SIZES if s >= x) for x in n], np.int64) if len(n) else n
        self.masks = [_masks(w) for w in self.words]
        # words that must be there: see _confirm
        self.need = np.where(n >= FEW, np.ceil(PARAPHRASE * n - 1e-9), n).astype(np.int64) if len(n) else n
        self.times = np.zeros((len(n), max(1, len(self.vocab))), np.uint8)      # how often a piece has a word
        for k, w in enumerate(self.words):
            np.add.at(self.times[k], w, 1)

    def index(self, idf: np.ndarray) -> None:
        """For each word, the pieces that have it among their rarest words: of
        ``n`` words, ``n - m + several`` (``m`` needed), so that any place with
        ``m`` of them has ``several`` of these."""
        self.several = np.minimum(SEVERAL, self.need)
        word, piece = [], []
        for k, own in enumerate(self.words):
            u, c = np.unique(own, return_counts=True)
            order = np.argsort(-idf[u], kind="stable")
            enough = len(own) - self.need[k] + self.several[k]
            rare = u[order[:int(np.searchsorted(np.cumsum(c[order]), enough)) + 1]]
            word.append(rare)
            piece.append(np.full(len(rare), k))
        word, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, piece))
        order = np.argsort(word, kind="stable")
        self.listed = piece[order].astype(np.int64)
        self.list_at = np.searchsorted(word[order], np.arange(len(self.vocab) + 1))

    def vectors(self, weighted: np.ndarray) -> np.ndarray:
        """Unit latent vectors of the pieces."""
        v = np.array([weighted[w].sum(axis=0) for w in self.words]) if self.words else np.zeros((0, weighted.shape[1]))
        return _unit(v)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel) of ``n`` words,
    given as masks of their places, and ``words``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = (v + u | v - u) & full
    return n - v.bit_count()


def _number(shared):
    """Words of every text as numbers of the vocabulary; -1 for others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for b in batches:
            for part in slices(b, "text", SLICE):
                h, off = words_of(part.column(1))
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                ids = np.where(vocab[at] == h, at, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([ids[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())],
                    names=["doc_id", "words"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20):
    """Rows and their numbered words in a row, some ``limit`` words at a time."""
    for b in batches:
        length = np.array([len(x.as_buffer()) // 4 if x.is_valid else 0 for x in b.column(column)], np.int64)
        total = np.concatenate([[0], np.cumsum(length)])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, side="right")) - 1)
            parts = [np.frombuffer(x.as_buffer(), np.int32) for x in b.column(column).slice(lo, hi - lo) if x.is_valid]
            yield b.slice(lo, hi - lo), np.concatenate(parts) if parts else np.zeros(0, np.int32), total[lo:hi + 1] - total[lo]
            lo = hi


def _passages(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, int]:
    """Passage of every word, and the number of passages."""
    count = -(-np.diff(off) // PASSAGE)
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return first[doc] + (np.arange(len(words)) - off[:-1][doc]) // PASSAGE, int(count.sum())


def _frequencies(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(n, np.int64), 0
        for _, words, off in _groups(batches, 0, 1 << 18):
            passage, count = _passages(words, off)
            live = words >= 0
            pairs = np.unique(passage[live] * n + words[live])
            df += np.bincount(pairs % n, minlength=n)
            total += count
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([df.tolist()], pa.list_(pa.int64()))], names=["n", "df"])
    return run


def _sums(shared):
    """A'(A W) of a partition's passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, w = shared.value
        n, width = w.shape
        total = np.zeros((n, width))
        weighted = (idf[:, None] * w).astype(np.float32)
        for _, words, off in _groups(batches, 0, 1 << 18):
            passage, _ = _passages(words, off)
            live = np.flatnonzero(words >= 0)
            if not len(live):
                continue
            ids, passage = words[live], passage[live]
            starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            low = np.add.reduceat(weighted[ids], starts, axis=0)          # A W, a row per passage
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            order = np.argsort(ids.astype(np.uint32), kind="stable")
            s = ids[order]
            cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            total[s[cuts]] += np.add.reduceat(low[row[order]], cuts, axis=0)
        total *= idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["i", "row"])
    return run


def _add(table: DataFrame, rows: int, width: int) -> np.ndarray:
    """Sum of the partitions' matrices, row by row (combined on the way)."""
    cols = [F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(width)]
    out = np.zeros((rows, width))
    for r in table.groupBy("i").agg(*cols).collect():
        out[r[0]] = r[1:]
    return out


def latent_space(numbered: DataFrame, n: int, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(idf, right singular vectors) of the TF-IDF passages."""
    sc = numbered.sparkSession.sparkContext
    words = numbered.select("words")
    stats = words.mapInArrow(_frequencies(n), "n long, df array<long>")
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = np.zeros(n)
    for r in stats.select(F.posexplode("df").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect():
        df[r["i"]] = r["c"]
    idf = np.log((total + 1) / (df + 1)) + 1
    width = min(rank + OVERSAMPLE, n)
    w = np.random.default_rng(seed).standard_normal((n, width))
    y = _add(words.mapInArrow(_sums(sc.broadcast((idf, w))), "i int, row array<double>"), n, width)
    core = w.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-300)
    f = y @ (vectors[:, good] / np.sqrt(values[good]))
    u, sing, _ = np.linalg.svd(f, full_matrices=False)
    return idf, u[:, :rank][:, sing[:rank] > 1e-6 * max(sing.max(initial=0), 1e-300)]


def _windows(off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last unit (in all units) of the windows."""
    units = -(-np.diff(off) // UNIT)
    base = np.cumsum(units) - units
    m, stride = size // UNIT, max(1, size // UNIT // 2)
    count = np.where(units > 0, np.maximum(0, -(-(units - m) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(units)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = base[doc] + k * stride
    return doc, start, np.minimum(start + m, base[doc] + units[doc])


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weighted, vectors = shared.value
        weighted, vectors = weighted.astype(np.float32), vectors.astype(np.float32)
        useful = np.abs(weighted).sum(axis=1) > 0
        for b, words, off in _groups(batches, 1, 1 << 17):
            best: dict[tuple[int, int], tuple] = {}
            units = -(-np.diff(off) // UNIT)
            base = np.cumsum(units) - units
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            unit = base[doc] + (np.arange(len(words)) - off[:-1][doc]) // UNIT
            at = np.flatnonzero(words >= 0)
            known = words[at].astype(np.int64)
            before = np.zeros(len(words) + 1, np.int64)          # known words before each place
            np.cumsum(words >= 0, out=before[1:])
            place, piece = _rare_places(items, at, known)
            visits, wanted = [], np.zeros(int(units.sum()) + 1, np.int32)
            for size in SIZES:
                mine = items.size[piece] == size
                if not mine.any():
                    continue
                d, s, e = _windows(off, size)
                margin = size // 4 + UNIT
                first = np.maximum(off[d], off[d] + (s - base[d]) * UNIT - margin)
                last = np.minimum(off[d + 1], off[d] + (e - base[d]) * UNIT + margin)
                row, which = _visited(items, place[mine], piece[mine], doc, off, d, size, margin)
                seen = np.unique(row)
                np.add.at(wanted, s[seen], 1)
                np.add.at(wanted, e[seen], -1)
                visits.append((d, s, e, first, last, row, which))
            # latent sums of the units in visited windows
            sums = np.zeros((len(wanted), weighted.shape[1]), np.float64)
            live = useful[known] & (np.cumsum(wanted) > 0)[unit[at]]
            if live.any():
                u, words_of_units = unit[at[live]], known[live]
                cuts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                sums[u[cuts] + 1] = np.add.reduceat(weighted[words_of_units], cuts, axis=0)
            np.cumsum(sums, axis=0, out=sums)
            for d, s, e, first, last, row, which in visits:
                for lo in range(0, len(row), PAIRS):
                    r, c = row[lo:lo + PAIRS], which[lo:lo + PAIRS]
                    w = _unit((sums[e[r]] - sums[s[r]]).astype(np.float32))
                    cos = np.einsum("ij,ij->i", w, vectors[c])
                    near = np.flatnonzero(cos >= NEAR)
                    kept = near[_enough(items, c[near], known, before[first[r[near]]], before[last[r[near]]])]
                    for x, r, c in zip(cos[kept].tolist(), r[kept].tolist(), c[kept].tolist()):
                        k, x0, x1 = int(d[r]), int(first[r]), int(last[r])
                        found = _confirm(items, c, words[x0:x1])
                        if found and ((k, c) not in best or found[0] > best[k, c][0]):
                            best[k, c] = (*found, x, x0 - int(off[k]), x1 - int(off[k]))
            rows: dict[tuple[int, int], tuple] = {}
            for (k, c), v in best.items():
                key = (k, items.item[c])
                rows[key] = max(rows.get(key, v), v)
            docs = b.column(0)
            keys = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array([k for k, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.int64()),
                 pa.array([rows[x][2] for x in keys], pa.float64()), pa.array([rows[x][0] for x in keys], pa.float64()),
                 pa.array([rows[x][1] for x in keys], pa.bool_()), pa.array([rows[x][3] for x in keys], pa.int64()),
                 pa.array([rows[x][4] for x in keys], pa.int64())],
                names=["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "last_word"])
    return run


def _rare_places(items: Items, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are among a piece's rarest, and the piece, by piece
    and place."""
    count = items.list_at[known + 1] - items.list_at[known]
    place = np.repeat(at, count)
    step = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    piece = items.listed[np.repeat(items.list_at[known], count) + step]
    order = np.lexsort((place, piece))
    return place[order], piece[order]


def _visited(items: Items, place: np.ndarray, piece: np.ndarray, doc: np.ndarray, off: np.ndarray, windows: np.ndarray,
             size: int, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (rows of ``windows``, the document of each) and pieces such that
    the words around the window hold enough rare words of the piece."""
    j = np.arange(len(place))
    end = j + items.several[piece] - 1
    j, end = j[end < len(place)], end[end < len(place)]
    same = (piece[j] == piece[end]) & (doc[place[j]] == doc[place[end]])
    j, end = j[same], end[same]
    k = doc[place[j]]
    x0, x1 = place[j] - off[k], place[end] - off[k]
    # windows that begin, with their margin, at or before x0 and end after x1
    m, stride = size // UNIT, max(1, size // UNIT // 2)
    total = np.bincount(windows, minlength=len(off) - 1)
    base = np.cumsum(total) - total
    most = np.minimum((x0 + margin) // UNIT // stride, total[k] - 1)
    least = np.maximum(0, -(-((x1 - margin - m * UNIT) // UNIT + 1) // stride))
    some = most >= least
    k, least, count, own = k[some], least[some], (most - least + 1)[some], piece[j][some]
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    pairs = np.unique(np.repeat(own, count) * np.int64(len(windows) + 1) + np.repeat(base[k] + least, count) + step)
    return pairs % (len(windows) + 1), pairs // (len(windows) + 1)


def _enough(items: Items, piece: np.ndarray, known: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Candidates whose range ``lo:hi`` of ``known`` words has as many words of
    the piece (each counted as often as in the piece) as it needs."""
    kept = np.flatnonzero(hi - lo >= items.need[piece])
    n = items.times.shape[1]
    out = []
    for a in range(0, len(kept), CANDIDATES):
        c = kept[a:a + CANDIDATES]
        length = (hi - lo)[c]
        owner = np.repeat(np.arange(len(c)), length)
        word = known[np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(lo[c], length)]
        inside = items.times[piece[c][owner], word] > 0
        several = np.bincount(owner[inside], minlength=len(c)) >= items.need[piece[c]]
        inside &= several[owner]
        key, times = np.unique(owner[inside] * n + word[inside], return_counts=True)
        own, word = key // n, key % n
        common = np.bincount(own, np.minimum(times, items.times[piece[c][own], word]), len(c))
        out.append(c[common >= items.need[piece[c]]])
    return np.concatenate(out) if out else kept


def _confirm(items: Items, c: int, around: np.ndarray) -> tuple[float, bool] | None:
    """Share of the item in order around a window, and whether its answer is."""
    n = len(items.words[c])
    need = PARAPHRASE if n >= FEW else 1.0
    around = around[around >= 0]
    listed = around.tolist()
    share = lcs(items.masks[c], n, listed) / n
    if share < need:
        return None
    tail = items.answer[c]
    answer = lcs(_masks(tail), len(tail), listed) == len(tail)
    return (share, answer) if share >= SAME or answer else None


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, answer, first_word, last_word``: a row
    per document and item found in it (the best place)."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, lcs double, answer boolean, first_word long, last_word long"
    src = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = src.count()
    blocks = max(1, -(-n // ITEMS))
    found = None
    for k in range(blocks):
        rows = src.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()      # a block of the query set
        items = Items(sorted((r["item_id"], r["text"]) for r in rows))
        if not len(items.vocab):
            continue
        numbered = cut(docs.select("doc_id", "text").mapInArrow(
            _number(spark.sparkContext.broadcast(items.vocab)), f"doc_id {kind}, words binary"), "leak-words")
        idf, basis = latent_space(numbered, len(items.vocab))
        items.index(idf)
        weighted = idf[:, None] * basis
        shared = spark.sparkContext.broadcast((items, weighted, items.vectors(weighted)))
        hits = cut(numbered.mapInArrow(_search(shared), schema), "leak-hits")
        found = hits if found is None else found.union(hits)
    return found if found is not None else spark.createDataFrame([], schema)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    hits = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
