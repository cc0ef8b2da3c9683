"""Exact quantiles by selection; synchronous training; the schedule as a fold."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlytics.operators import model as M
from meterlytics.operators import patterns as P
from meterlytics.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def values(kind, rng):
    return {"continuous": lambda: rng.gauss(0, 1), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
            "tiny": lambda: 1.0 + rng.random() * 1e-14, "few": lambda: rng.choice([0.0, 1.0, 2.5]),
            "odd": lambda: rng.choice([math.inf, -math.inf, math.nan, 0.0, -0.0, 5e-324, None, rng.random()])}[kind]()


@pytest.mark.parametrize("kind", ["continuous", "wide", "tiny", "few", "odd"])
def test_quantiles_equal_percentile(spark, kind):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), values(kind, rng)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4).cache()
    want = {r["g"]: r for r in df.where("v is not null").groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q"), F.count("v").alias("n")).collect()}
    got = {r["g"]: r for r in Q.exact_quantiles(df, "v", PROBS, ["g"], total="n").collect()}
    assert set(got) == set(want)
    for g in got:
        assert got[g]["n"] == want[g]["n"]
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[g]["quantiles"], want[g]["q"])), (kind, g)
    whole = Q.exact_quantiles(df, "v", PROBS).collect()
    every = df.where("v is not null").agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS]))).first()[0]
    assert len(whole) == 1 and all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(whole[0][0], every))


def test_state_of_a_pass_is_bounded(spark, monkeypatch):
    """All values distinct and few buckets: no histogram is larger than them."""
    monkeypatch.setattr(Q, "BUCKETS", 64)
    sizes = []
    located = Q._located
    monkeypatch.setattr(Q, "_located", lambda hist, ranks, by: (sizes.append(hist.groupBy(*by).count().agg(F.max("count")).first()[0]),
                                                                located(hist, ranks, by))[1])
    df = spark.range(20000).select((F.rand(3) * 1000).alias("v"))
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS]))).first()[0]
    assert Q.exact_quantiles(df, "v", PROBS).first()[0] == want
    assert len(sizes) >= 3 and max(sizes) <= 2 * 64 + 3
    assert Q.exact_quantiles(df.where("v < 0"), "v", PROBS).collect() == []


def test_hourly_patterns_continuous_and_from_cells(spark, sources):
    hh = sources.half_hourly
    want = P.hourly_patterns(hh)
    cols = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    base = want.select(*cols)
    assert base.exceptAll(P.hourly_patterns(hh, continuous=True).select(*cols)).count() == 0
    day = hh.agg(F.max("day")).first()[0]
    old, new = hh.where(F.col("day") == day), hh.where(F.col("day") == day).withColumn("hh_3", F.lit(99.0))
    cells = P.merge_cells(P.hourly_cells(hh), P.hourly_cells(new), P.hourly_cells(old))
    full = P.hourly_patterns(hh.where(F.col("day") != day).unionByName(new))
    assert full.select(*cols).exceptAll(P.hourly_patterns(cells).select(*cols)).count() == 0
    assert P.merge_cells(P.hourly_cells(old), retracted=P.hourly_cells(old)).count() == 0
    year = int(day[:4])
    assert P.hourly_patterns(cells, [year]).select("year").distinct().collect()[0][0] == year


# ---- training in step ----------------------------------------------------------

def feats(spark, n=600, parts=3):
    rng = np.random.default_rng(1)
    rows = [(f"H{i % 40}", f"2012-{1 + i % 12:02d}-{1 + i // 40:02d}", [float(x) for x in rng.random(6)], [float(i % 2), 1.0, 0.0])
            for i in range(n)]
    return spark.createDataFrame(rows, "LCLid string, day string, reading array<double>, cond array<double>").repartition(parts)


def test_sync_training_is_independent_of_partitions(spark):
    runs = []
    for parts, shards in ((1, 1), (4, 4), (16, 3)):
        cfg = M.AEConfig(hidden_dim=4, epochs=2, batch_size=180, shards=shards, learning_rate=0.05)
        vec, used, hist = M.train(feats(spark, parts=parts), cfg, checkpoint=False)
        assert used.mode == "sync" and used.max_rounds == 3 and used.shards == shards
        runs.append((vec, [h["val_loss"] for h in hist], [h["train_loss"] for h in hist]))
    for vec, val, tr in runs[1:]:
        assert np.allclose(vec, runs[0][0], rtol=1e-9, atol=1e-12) and np.allclose(val, runs[0][1]) and np.allclose(tr, runs[0][2])
    assert runs[0][1][-1] < runs[0][1][0]


def test_sync_rounds_equal_steps_on_the_driver(spark):
    f = feats(spark)
    cfg = M.infer_dims(f, M.AEConfig(hidden_dim=4, max_rounds=3, batch_size=64, shards=4, learning_rate=0.01))
    table, cfg = M.prepare_training_table(f, cfg, checkpoint=False)
    start = M.init_params(cfg)
    opt = M.Adam(start.size)
    vec, n, sse = M.sync_epoch(table.where("not is_val"), start, opt, cfg, 0.01)
    rows = table.where("not is_val").toPandas()
    want, own, errors = start.copy(), M.Adam(start.size), 0.0
    for r in range(3):
        part = rows[rows["round"] == r]
        x, c = np.stack(part.reading), np.stack(part.cond)
        e, g = M.sse_and_grad(want, cfg, x, c)
        errors += e
        want = own.step(want, g / (len(x) * 6), 0.01)
    assert n == len(rows) and opt.t == 3 and np.isclose(sse, errors) and np.allclose(vec, want, rtol=1e-10, atol=1e-12)


def test_shards_follow_the_rows(spark):
    f, cfg = feats(spark, 10), M.AEConfig(shard_rows=100)
    slots = spark.sparkContext.defaultParallelism
    assert M.train_shards(f, cfg, 50) == 1 and M.train_shards(f, cfg, 10 ** 9) == slots     # barrier tasks need slots
    assert M.train_shards(f, M.AEConfig(mode="local", shard_rows=100), 1050) == 11


# ---- schedule --------------------------------------------------------------------

def test_schedule_fold_equals_the_schedule(spark):
    rng = random.Random(6)
    series = {k: [rng.choice([1.0, 0.9, 0.8, 0.79999, rng.random(), None]) for _ in range(40)] for k in "abc"}
    cfg = M.AEConfig(lr_patience=2, patience=9)
    df = spark.createDataFrame([(k, i, x) for k, s in series.items() for i, x in enumerate(s)], "k string, i int, x double").repartition(4)
    got = {}
    for r in M.schedule_trace(df, "i", "x", cfg, ["k"]).orderBy("k", "epoch").collect():
        got.setdefault(r["k"], []).append((r["epoch"], r["loss"], r["lr"], r["next_lr"], r["stop"]))
    for k, s in series.items():
        plan, want = M.Schedule(cfg), []
        for i, x in enumerate(s, 1):
            lr = plan.lr
            stop = plan.update(math.inf if x is None else x)
            want.append((i, x, lr, plan.lr, stop))
            if stop:
                break
        assert got[k] == want
    assert any(r[3] < 1e-3 for s in got.values() for r in s) and any(r[4] for s in got.values() for r in s)
    assert M.schedule_trace(df.where("false"), "i", "x", cfg, ["k"]).collect() == []
