"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised where they are read and packed in the same task, so
neither texts nor ids are shuffled. Within a task, documents form packing
groups of a fixed size. In a group every document

1. gives off its full windows of the longest size;
2. its rest is routed to the smallest context tier that holds it;
3. from the longest tier down, each rest opens a window of its tier and the
   gap is filled from shorter rests (largest that fits first, then one cut to
   the exact gap).

What stays open at the end of a group (less than one window) goes on into the
next group; at the end of the task it is cut into windows of powers of two, so
no sequence needs padding. Sequences of a group are dealt to steps in snake
order by length, which balances the tokens of the steps.

Recovery: a task's result depends only on its input rows and their order; over
a file scan a retried task repeats it. Over a shuffled input, write the input
first (the pipeline does).

Defined results: null text counts as empty (one end id); repeated rows are
packed each; a null ``doc_id`` is kept; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ASCII_LOWER, prepare, slices, text_buffers

TIERS = (256, 512, 1024, 2048)
END_ID = 1
VOCAB = "word_bpe_49k.json"
GROUP_DOCS = 512
STEP_SEQUENCES = 8
SLICE = 4 << 20
CACHE_WORDS = 400_000
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"


def vocab_path(name: str = VOCAB) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Ids:
    """An array of small numbers that grows at its end."""

    def __init__(self, *first: int):
        self.data, self.size = np.zeros(1 << 16, np.uint32), 0
        self.add(np.array(first, np.uint32))

    def add(self, ids: np.ndarray) -> None:
        end = self.size + len(ids)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(end - len(self.data), len(self.data) // 2), np.uint32)])
        self.data[self.size:end] = ids
        self.size = end

    def array(self) -> np.ndarray:
        return self.data[:self.size]


class WordTokenizer:
    """Ids of whole texts by way of their distinct words.

    The vocabulary drops white space and marks the end of every word, so the
    ids of a text are those of its chunks between blanks and line feeds, in
    order. Arrow splits a slice of texts and numbers its distinct chunks; only
    chunks not met before are tokenised. Plain letter words go through the
    tokenizer many at a time, and the end marks part their ids again."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path or vocab_path())
        size = max(self.tok.get_vocab().values()) + 1
        self.ends = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.first, self.count, self.flat = _Ids(0), _Ids(1), _Ids(END_ID)      # word 0: the end

    def _store(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        at = self.first.size
        self.index.update(zip(words, range(at, at + len(words))))
        self.first.add(self.flat.size + np.cumsum(counts) - counts)
        self.count.add(counts)
        self.flat.add(ids)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        for lo in range(0, len(plain), 4000):
            part = plain[lo:lo + 4000]
            ids = self._encode(" ".join(part))
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                self._store(part, ids, np.diff(cut, prepend=0))
            else:                                     # a word of several pieces is among them
                other += part
        for lo in range(0, len(other), 4000):
            part = other[lo:lo + 4000]
            ids = [x.ids for x in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            self._store(part, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (each with its end) and their offsets."""
        raw, off = text_buffers(texts)
        data = raw.copy()
        if b"<|" not in data.tobytes():               # special tokens are told by case
            data = ASCII_LOWER[data]
        data[data == 10] = 32
        # a mark after a letter and before a blank is a word of its own
        after = np.append(data[1:], 32)
        after[off[1:][off[1:] > 0] - 1] = 32
        mark = ((data == 46) | (data == 44)) & (after == 32)
        letter = (data >= 97) & (data <= 122) | (data >= 65) & (data <= 90)
        mark[1:] &= letter[:-1]
        mark[off[:-1][off[:-1] < len(mark)]] = False
        at = np.flatnonzero(mark)
        data = np.insert(data, at, 32)
        off = off + np.searchsorted(at, off)
        arr = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes()))
        parts = pc.split_pattern(arr, " ")
        chunks = parts.flatten().dictionary_encode()
        words = chunks.dictionary.to_pylist()
        if len(self.index) + len(words) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self.index]
        if new:
            self._learn(new)
        first, count, flat = self.first.array(), self.count.array(), self.flat.array()
        here = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        of_doc = parts.offsets.to_numpy()
        seq = here[chunks.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        seq = np.insert(seq, of_doc[1:], 0)
        n = count[seq].astype(np.int64)
        stop = np.cumsum(n)
        ids = flat[np.repeat(first[seq] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        last = of_doc[1:] + np.arange(len(off) - 1)
        return ids, np.concatenate([[0], stop[last]])


class Packer:
    """Packs (document, start, ids) rests into windows; yields sequences as
    lists of pieces, each with its tier."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.window = self.tiers[-1]
        self.rest: list[tuple[int, tuple]] = []   # (length, (doc, start, ids)) carried over

    def _fill(self, room: int, pool: list, seq: list) -> int:
        """Fill ``room`` from ``pool`` (ascending by length); the free room."""
        while room and pool:
            at = bisect.bisect_right(pool, room, key=lambda x: x[0]) - 1
            if at >= 0:
                n, piece = pool.pop(at)
                seq.append((piece, n))
                room -= n
                continue
            n, (doc, start, ids) = pool.pop(0)       # the shortest is cut
            seq.append(((doc, start, ids), room))
            bisect.insort(pool, (n - room, (doc, start + room, ids[room:])), key=lambda x: x[0])
            room = 0
        return room

    def pack(self, docs: list[tuple[int, np.ndarray]], last: bool = False):
        out = []
        pool = self.rest
        self.rest = []
        for doc, ids in docs:
            whole = len(ids) // self.window * self.window
            for s in range(0, whole, self.window):
                out.append((self.window, [((doc, s, ids[s:s + self.window]), self.window)]))
            if len(ids) > whole:
                pool.append((len(ids) - whole, (doc, whole, ids[whole:])))
        pool.sort(key=lambda x: x[0])
        left = sum(x[0] for x in pool)
        while pool:
            n = pool[-1][0]
            tier = next(t for t in self.tiers if t >= n)
            if left < tier:
                break                                   # too little left for a window of this tier
            left -= tier
            n, piece = pool.pop()
            seq = [(piece, n)]
            self._fill(tier - n, pool, seq)
            out.append((tier, seq))
        if not last:
            self.rest = pool
            return out
        while left:
            size = 1 << (min(left, self.window).bit_length() - 1)
            seq: list = []
            self._fill(size, pool, seq)
            out.append((size, seq))
            left -= size
        return out


def _steps(seqs: list) -> list[int]:
    """Step of each sequence: snake order by length, equal counts."""
    n = -(-len(seqs) // STEP_SEQUENCES)
    order = sorted(range(len(seqs)), key=lambda i: -sum(x[1] for x in seqs[i][1]))
    step = [0] * len(seqs)
    for k, i in enumerate(order):
        r, c = divmod(k, n)
        step[i] = c if r % 2 == 0 else n - 1 - c
    return step


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None,
                   tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece of the ``docs(doc_id, text)`` sequences."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = WordTokenizer(tokenizer_path), Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        made, steps, names, group = 0, 0, {}, []
        row = 0

        def rows(last: bool):
            nonlocal made, steps, group
            seqs = packer.pack(group, last)
            group = []
            step = _steps(seqs)
            out = []
            for (tier, seq), st in zip(seqs, step):
                offset = 0
                for (doc, start, ids), n in seq:
                    name, total = names[doc]
                    out.append((name, start, n, zlib.crc32(ids[:n].tobytes()), total, base + made, offset, tier,
                                base + steps + st))
                    offset += n
                made += 1
            steps += max(step, default=-1) + 1
            live = {p[1][0] for p in packer.rest}
            for k in [k for k in names if k not in live]:
                del names[k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=COLUMNS)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, off = tok.encode(part.column(1))
                for doc, a, b in zip(part.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    names[row] = (doc, b - a)
                    group.append((row, ids[a:b]))
                    row += 1
                    if len(group) >= GROUP_DOCS or b - a > 1 << 20:
                        yield from rows(False)
        yield from rows(True)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
