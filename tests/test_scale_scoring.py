"""Scoring without per-row Python objects, and the contract's rounding."""

import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from meterlytics.operators import model as M
from meterlytics.plans import registry as R


def test_scores_come_as_arrow_lists(spark):
    rng = np.random.default_rng(3)
    rows = [(f"H{i}", "2012-01-01", [float(x) for x in rng.random(6)], [float(i % 2), None if i == 4 else 1.0]) for i in range(50)]
    f = spark.createDataFrame(rows, "LCLid string, day string, reading array<double>, cond array<double>")
    cfg = M.AEConfig(input_dim=6, cond_dim=2, hidden_dim=4)
    vec = M.rule_params(cfg)
    x, c = np.array([r[2] for r in rows]), np.array([[np.nan if v is None else v for v in r[3]] for r in rows])
    got = {r["LCLid"]: r for r in M.encode_column(M.reconstruct(f, vec, cfg), vec, cfg).collect()}
    want, code = M.forward(vec, cfg, x, c), M.encode(vec, cfg, x, c)
    for i in range(50):
        assert np.allclose(got[f"H{i}"]["recon"], want[i], equal_nan=True) and np.allclose(got[f"H{i}"]["code"], code[i], equal_nan=True)
    bare = M.without_conditions(f)
    cfg = M.AEConfig(input_dim=6, cond_dim=0, hidden_dim=4)
    assert M.reconstruct(bare, M.rule_params(cfg), cfg).where(F.size("recon") == 6).count() == 50


def test_scored_rows_are_not_stored(spark, monkeypatch):
    f = spark.createDataFrame([("H", "2012-01-01", [1.0, 2.0], [1.0])], "LCLid string, day string, reading array<double>, cond array<double>")
    monkeypatch.setattr(R, "feature_table", lambda spark, sf_dir: f)
    monkeypatch.setattr(R, "store", lambda *a: 1 / 0)
    assert R.reconstruction_fixed(spark, "x").count() == 1


def test_contract_rounds_as_round_does(spark):
    rng = random.Random(5)
    xs = [0.0, -0.0, -1e-12, 1e-12, 5e-10, -5e-10, 0.5, 1.0000000005, -2.0000000015, 1e300, -1e18, 5e-324, 1099.511627776,
          math.inf, -math.inf, math.nan, None, 1e-9 * 2 ** 40]
    xs += [rng.choice([-1, 1]) * rng.randrange(10 ** 12) / 10 ** rng.choice([9, 10, 11]) for _ in range(4000)]
    xs += [rng.gauss(0, 10 ** rng.randint(-12, 12)) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.round("x", 9).alias("want"))
    bits = lambda v: v if v is None else "nan" if math.isnan(v) else struct.pack("d", v)
    for r in df.withColumn("got", R.rounded(F.col("x"), 9)).collect():
        assert bits(r["got"]) == bits(r["want"]), r
    plan = R.contract(df.select("x"))
    assert plan.columns == ["x"] and plan.count() == len(xs)


def test_slot_labels_are_looked_up(spark):
    from meterlytics.functions.calendar import slot_label
    df = spark.range(48).select(F.col("id").cast("int").alias("slot"))
    old = F.format_string("%02d:%02d", F.floor(F.col("slot") / 2).cast("int"), (F.col("slot") % 2) * 30)
    assert df.where(slot_label("slot") != old).count() == 0
    assert df.select(F.concat(slot_label("slot")).alias("x")).distinct().count() == 48
    plan = df.select(slot_label("slot").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[00:00,00:30,01:00" in plan.replace(", ", ",")          # one literal


def test_stream_writes_few_files(spark, scratch):
    """No file of keys per state partition and year."""
    import glob
    import os

    from meterlytics.schemas import HALF_HOURLY
    from meterlytics.streaming import scoring as ST
    inbox, sink = os.path.join(scratch, "inbox"), os.path.join(scratch, "out")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "b.csv"), "w") as fh:
        fh.write(",".join(HALF_HOURLY.fieldNames()) + "\n"
                 + "".join(f"H{i},{1995 + i % 3}-01-01," + ",".join(["0.5"] * 48) + "\n" for i in range(120)))

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "24")
    try:
        q = ST.start(ST.block_stream(spark, inbox), lambda rows: rows.select("LCLid", "day"), sink, os.path.join(scratch, "ckpt"))
        q.awaitTermination(300)
        assert q.exception() is None
    finally:
        spark.conf.set(key, before)
    assert len(glob.glob(f"{sink}/keys/batch=0/year=*/*.parquet")) <= 3 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{sink}/keys").count() == ST.read_scores(spark, sink).count() == 120


def test_state_is_on_disk_unless_the_session_says_so():
    """A session made elsewhere gets the state provider, one of its own stays."""
    from meterlytics.session import _DEFAULTS, disk_state
    key = "spark.sql.streaming.stateStore.providerClass"

    class Session:
        def __init__(self, **kept):
            self.kept, self.conf = kept, self
            self.get, self.set = self.kept.get, self.kept.__setitem__
    bare, own = Session(), Session(**{key: "other"})
    disk_state(bare)
    disk_state(own)
    assert bare.kept[key] == _DEFAULTS[key] and own.kept[key] == "other"
