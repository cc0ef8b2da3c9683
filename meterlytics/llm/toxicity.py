"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the words of a text and the beginnings and ends of
words (which carry over to inflected words never seen) are trained from
confirmed toxic documents (P) and unlabelled text (U) with the risk

    pi * R_P(+)  +  max(0, R_U(-) - pi * R_P(-))

where ``pi``, the share of toxic documents, is counted over all labels that
may be learned from. When the bracket of a batch falls below zero, its
gradient is turned round, as the method asks. Several classifiers (other
seeds, other batches) are averaged.

Fitting uses a bounded sample: about ``max_positive`` confirmed documents and
``max_unlabelled`` unlabelled ones, chosen by a hash of the id, whatever the
size of the tables. Prior, candidate ids and scores cover all rows. Texts of
the sample are reduced to words on the executors; one task fits on them and
returns at most ``max_words`` weights of features.

Defined results: null and empty texts have no words and get the bias alone;
without any toxic label, or if no labelled toxic document or no unlabelled one
is in the table, every score is the same and below the threshold (0.047, the
logistic of ``NOTHING``); repeated rows are scored
each; a document with several labels counts as toxic if one says so; other
columns are never inputs.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, remainder

WORD = re.compile(r"[^\W\d_]+")
MAX_POSITIVE, MAX_UNLABELLED, MAX_WORDS = 3000, 9000, 4096
THRESHOLD = 0.3
CACHE_WORDS = 300_000
SURE = 5.0     # above chance among all the words tried


BEGIN, END = (4, 5, 6, 7), (4, 5, 6)


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word, its beginnings (``lose-``) and its ends (``-oser``)."""
    n = len(word)
    return [word, *[word[:k] + "-" for k in BEGIN if k < n], *["-" + word[-k:] for k in END if k < n]]


def doc_features(words) -> set[str]:
    return {f for w in words for f in features_of(w)}


def fit(pos: list[list[str]], unl: list[list[str]], prior: float, max_words: int = MAX_WORDS,
        models: int = 3, epochs: int = 40, batch: int = 512, rate: float = 0.1,
        decay: float = 2e-4, seed: int = 7) -> dict[str, float]:
    """Mean weights per word of ``models`` classifiers; ``""`` is the bias."""
    least = max(4, len(pos) // 100)
    in_pos, in_unl = Counter(), Counter()
    for d in pos:
        in_pos.update(doc_features(d))
    for w in [w for w, c in in_pos.items() if c < least]:
        del in_pos[w]
    for d in unl:
        in_unl.update(doc_features(d) & in_pos.keys())
    # words whose share among P differs from that in U by SURE standard errors
    score = {}
    for w, c in in_pos.items():
        p, u = c / len(pos), in_unl[w] / max(1, len(unl))
        z = abs(p - u) / np.sqrt((u * (1 - u) + 1 / len(pos)) / len(pos))
        if z >= SURE:
            score[w] = z
    vocab = {w: i for i, w in enumerate(sorted(score, key=lambda w: (-score[w], w))[:max_words])}
    n = len(vocab)

    def rows(docs):
        ids = [np.fromiter((vocab[f] for f in doc_features(d) & vocab.keys()), np.int64) for d in docs]
        return [np.sort(x) for x in ids]

    P, U = rows(pos), rows(unl)
    total = np.zeros(n + 1)
    for m in range(models):
        rng = np.random.default_rng(seed + m)
        w, bias = np.zeros(n), float(np.log(prior / (1 - prior)))
        gm, gv, t = np.zeros(n + 1), np.zeros(n + 1), 0
        steps = max(1, len(U) // batch)
        for _ in range(epochs):
            up, pp = rng.permutation(len(U)), rng.permutation(len(P))
            for s in range(steps):
                u = [U[i] for i in up[s * batch:(s + 1) * batch]]
                k = max(1, min(len(P), len(u)))
                p = [P[i] for i in np.take(pp, range(s * k, s * k + k), mode="wrap")]
                fp, cp, lp = _forward(p, w, bias)
                fu, cu, lu = _forward(u, w, bias)
                sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
                # logistic losses: l(f,+) = log(1+e^-f), l(f,-) = log(1+e^f)
                left = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                gp_minus, gu_minus = prior * sp / len(p), su / len(u)
                if left >= 0:
                    gp, gu = prior * (sp - 1) / len(p) - gp_minus, gu_minus
                else:                                     # step back out of the negative part
                    gp, gu = gp_minus, -gu_minus
                g = (np.bincount(cp, np.repeat(gp, lp), n) + np.bincount(cu, np.repeat(gu, lu), n)) + decay * w
                g = np.append(g, gp.sum() + gu.sum())
                t += 1
                gm = 0.9 * gm + 0.1 * g
                gv = 0.999 * gv + 0.001 * g * g
                d = rate * (gm / (1 - 0.9 ** t)) / (np.sqrt(gv / (1 - 0.999 ** t)) + 1e-8)
                w, bias = w - d[:n], bias - d[n]
        total += np.append(w, bias)
    total /= models
    out = {w: float(total[i]) for w, i in vocab.items()}
    out[""] = float(total[n])
    return out


def _forward(rows, w, bias):
    length = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    cols = cols.astype(np.int64)
    at = np.repeat(np.arange(len(rows)), length)
    return np.bincount(at, w[cols], len(rows)) + bias, cols, length


#: bias of the model that has nothing to learn from
NOTHING = -3.0


def sample_share(limit: int, count: int) -> int:
    """Places out of 10^12 that are in a sample of about ``limit`` of ``count`` rows."""
    return int(min(1.0, limit / max(1, count)) * 10 ** 12)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2,
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict[str, float]:
    """Weights from the rows whose id remainder is not ``held``."""
    prepare(spark)
    own = (labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
           .where(remainder(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n, toxic = own.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return {"": NOTHING}
    prior = min(max(toxic / n, 1e-3), 0.9)

    def part(limit: int, count: int, seed: int):
        # places in 10^12, so that the sample does not thin out before 10^15 rows
        h = F.xxhash64(F.col("doc_id"), F.lit(seed))
        place = F.pmod(h, F.lit(1_000_000)) * 1_000_000 + F.pmod(F.xxhash64(h), F.lit(1_000_000))
        return place < sample_share(limit, count)

    # ids of the sample: limit rows at the most reach the broadcast
    pos = own.where("toxic = 1").where(part(max_positive, toxic, 1)).select("doc_id").limit(2 * max_positive)
    open_ = docs.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    total = open_.select(F.count("*")).first()[0]
    sample = (open_.select("doc_id", "text").join(F.broadcast(pos.withColumn("p", F.lit(True))), "doc_id", "left")
              .withColumn("u", part(max_unlabelled, total, 2))
              .where(F.col("p") | F.col("u")).select("text", F.coalesce("p", F.lit(False)).alias("p"), "u"))

    def reduce_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"g": 0, "p": b["p"], "u": b["u"], "words": [sorted(words_of(t)) for t in b["text"]]})

    def learn(b: pd.DataFrame) -> pd.DataFrame:
        order = [w for _, w in sorted(zip(map(" ".join, b["words"]), b.index))]    # no dependence on row order
        b = b.loc[order]
        if not b["p"].any() or not b["u"].any():
            return pd.DataFrame({"word": [""], "weight": [NOTHING]})
        w = fit(list(b["words"][b["p"]]), list(b["words"][b["u"]]), prior)
        return pd.DataFrame({"word": list(w), "weight": list(w.values())})

    reduced = sample.mapInPandas(reduce_, "g int, p boolean, u boolean, words array<string>")
    fitted = reduced.groupBy("g").applyInPandas(learn, "word string, weight double").collect()
    return {r["word"]: r["weight"] for r in fitted} or {"": NOTHING}


def score(docs: DataFrame, weights: dict[str, float], keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score, called ``name``, of every row, from its whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(weights)       # at most max_words + 1 entries
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dict(shared.value)
        bias = w.pop("", 0.0)
        hits: dict[str, tuple[str, ...]] = {}         # word -> its features with a weight
        for b in batches:
            out = np.empty(b.num_rows)
            texts = b.column(b.num_columns - 1)
            for i in range(b.num_rows):
                words = words_of(texts[i].as_py())
                if len(hits) > CACHE_WORDS:
                    hits.clear()
                for x in words.difference(hits):
                    hits[x] = tuple(f for f in features_of(x) if f in w)
                own = set(itertools.chain.from_iterable(map(hits.__getitem__, words)))
                out[i] = bias + sum([w[x] for x in sorted(own)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-out)))],
                                             names=[*keep, name])

    return src.mapInArrow(run, f"{schema}`{name}` double")


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights = train(spark, docs, labels)
    return (score(docs, weights)
            .select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored at or above the threshold."""
    weights = train(spark, docs, labels)
    cols = tuple(docs.columns)
    scored = score(docs, weights, cols, "__toxicity")
    return scored.where(F.col("__toxicity") < THRESHOLD).select(*[F.col(f"`{c}`") for c in cols])
