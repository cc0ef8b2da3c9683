"""Secret scans with one combined deterministic automaton.

All rules are compiled into one minimised automaton (``automaton``) that reads
every byte of every text once. It reports where which rules accept; the text
between the reset bytes around such a place is then matched by the rule's own
expression, which gives the exact leftmost, non-overlapping spans. A reset
byte is part of no rule, so those spans are the ones of the whole text.

Defined results: null or empty text has no spans (the digest of an empty
list); repeated rows are scanned each; a null ``doc_id`` is kept; very long
texts are cut into lanes that run side by side, also where no reset byte stands
(letters and blanks for megabytes), and give the same spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules, scan
from .common import prepare, slices, text_buffers


@dataclass(frozen=True)
class SecretRule:
    kind: str
    regex: str            # the span, leftmost and greedy
    screen: str           # what the automaton looks for: every kept span has it
    #                       (long counts only where they sift; subset
    #                       construction multiplies the counts of all rules)
    fold: bool = False    # letters in either case
    group: int = 0        # the group whose length counts
    least: int = 1        # its least length


_NAMES = "(password|passwd|secret|token|api_?key)"
BASE_RULES = (
    SecretRule("assign", _NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               _NAMES + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", True, 2, 12),
    SecretRule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", least=18),
    SecretRule("hex", "[0-9a-f]+", "[0-9a-f]{16,}", least=16),
)
MORE_RULES = (
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", least=40),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]", least=25),
)
RULES = BASE_RULES + MORE_RULES
SCHEMA = "kind array<int>, start array<long>, `end` array<long>"


def automaton(rules: tuple[SecretRule, ...]) -> Automaton:
    return compile_rules([(r.screen, r.fold) for r in rules], [(r.regex, r.fold) for r in rules])


def _spans(rule: re.Pattern, r: SecretRule, text: str) -> Iterator[tuple[int, int]]:
    for m in rule.finditer(text):
        if m.end(r.group) - m.start(r.group) >= r.least:
            yield m.span()


def find_spans(texts: pa.Array, rules: tuple[SecretRule, ...], auto, exprs) -> list[list[tuple[int, int, int]]]:
    """(start, end, rule) in code points per text, by start, then rule."""
    raw, off = text_buffers(texts)
    n = len(off) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    # one reset byte after every text keeps the texts apart
    data = np.full(len(raw) + n, 10, np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(off))] = raw
    begin = off[:-1] + np.arange(n)
    at, mask = scan(auto, data)
    if not len(at):
        return out
    reset = np.flatnonzero(auto.resets[data])
    right = np.searchsorted(reset, at)
    seg, inv = np.unique(right, return_inverse=True)
    masks = np.zeros(len(seg), np.int64)
    np.bitwise_or.at(masks, inv, mask)
    ends = reset[seg]
    starts = np.where(seg > 0, reset[np.maximum(seg - 1, 0)] + 1, 0)
    docs = np.searchsorted(begin, ends, side="right") - 1
    lead = (data & 0xC0) != 0x80
    last, before = -1, 0
    done = 0
    for d, a, b, m in zip(docs.tolist(), starts.tolist(), ends.tolist(), masks.tolist()):
        if d != last:
            last, before, done = d, 0, int(begin[d])
        before += int(np.count_nonzero(lead[done:a]))
        done = a
        part = data[a:b].tobytes().decode("utf-8", "replace")
        for k, r in enumerate(rules):
            if m >> k & 1:
                out[d].extend((before + s, before + e, k) for s, e in _spans(exprs[k], r, part))
    for x in out:
        x.sort(key=lambda y: (y[0], y[2]))
    return out


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row and its spans as parallel arrays
    ``kind`` (index of the rule), ``start``, ``end`` (code points)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(automaton(rules))      # its size is fixed by the rule list
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        exprs = [re.compile(r.regex, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        for batch in batches:
            for part in slices(batch, "__text"):
                spans = find_spans(part.column(part.num_columns - 1), rules, a, exprs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(part.num_columns - 1)]
                    + [pa.array([[x[2] for x in s] for s in spans], pa.list_(pa.int32())),
                       pa.array([[x[0] for x in s] for s in spans], pa.list_(pa.int64())),
                       pa.array([[x[1] for x in s] for s in spans], pa.list_(pa.int64()))],
                    names=[*keep, "kind", "start", "end"])

    return src.mapInArrow(run, f"{schema}, {SCHEMA}" if schema else SCHEMA)


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]`` (overlapping
    spans become one, named by its first) and ``n_chars`` set anew; other
    columns and all rows stay."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(automaton(rules))
    names, cols = docs.columns, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        exprs = [re.compile(r.regex, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        for batch in batches:
            for part in slices(batch, "text"):
                i = names.index("text")
                texts = part.column(i)
                spans = find_spans(texts, rules, a, exprs)
                arrays = list(part.columns)
                if any(spans):
                    new = texts.to_pylist()
                    for j, s in enumerate(spans):
                        if s:
                            new[j] = _mask(new[j], s, rules)
                    arrays[i] = pa.array(new, texts.type)
                    if "n_chars" in names:
                        k = names.index("n_chars")
                        old = part.column(k).to_pylist()
                        arrays[k] = pa.array([len(new[j]) if s else old[j] for j, s in enumerate(spans)],
                                             part.column(k).type)
                yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return docs.mapInArrow(run, docs.schema)


def _mask(text: str, spans: list[tuple[int, int, int]], rules) -> str:
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{rules[k].kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def digests(found: DataFrame, rules: tuple[SecretRule, ...] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """The digest columns of the query, derived from the spans."""
    names = F.array(*[F.lit(r.kind) for r in rules])

    def listed(limit: int):
        all_ = F.arrays_zip("kind", "start", "end")
        kept = F.filter(all_, lambda x: x["kind"] < limit)
        return F.array_join(F.transform(kept, lambda x: F.concat_ws(
            ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(k: int):
        return F.size(F.filter("kind", lambda x: x == k)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(len(rules)).alias("spans"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return digests(scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def brute_force(text: str | None, rules: tuple[SecretRule, ...] = BASE_RULES) -> tuple[dict[str, int], str]:
    """Counts and digest by plain expressions over the whole text (tests)."""
    spans = []
    for k, r in enumerate(rules):
        expr = re.compile(r.regex, re.ASCII | (re.IGNORECASE if r.fold else 0))
        spans += [(s, k, e) for s, e in _spans(expr, r, text or "")]
    spans.sort()
    said = ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)
    return {r.kind: sum(k == i for _, k, _ in spans) for i, r in enumerate(rules)}, hashlib.sha256(said.encode()).hexdigest()
