"""Streaming scoring equals batch scoring on the same files; re-sent
household-days are dropped once."""
import os

from pyspark.sql import functions as F

from meterlytics.operators import features as FE
from meterlytics.operators import model as M
from meterlytics.operators import profiles as PR
from meterlytics.streaming import scoring as ST


def test_stream_matches_batch(spark, sources, scratch):
    s = sources
    from meterlytics.schemas import HALF_HOURLY
    hh = s.half_hourly.where(F.col("day") < "1997-01-01").select(*HALF_HOURLY.fieldNames())
    inbox = os.path.join(scratch, "inbox")
    parity = F.pmod(F.xxhash64("LCLid"), F.lit(2))
    for i, part in enumerate([hh.where(parity == 0), hh.where(parity == 1), hh.where(parity == 0).limit(20)]):
        part.toPandas().to_csv(os.path.join(scratch, f"b{i}.csv"), index=False)
    os.makedirs(inbox)
    for i in range(3):   # atomic arrival: move whole files into the folder
        os.rename(os.path.join(scratch, f"b{i}.csv"), os.path.join(inbox, f"block_{i}.csv"))

    bounds = dict(households_rows=s.row_count("households"), holiday_rows=s.row_count("holidays"),
                  weather_rows=s.row_count("weather_daily"))
    years = (1995, 1996)
    batch_prof = PR.daily_profiles(hh, s.households, s.holidays, s.weather_daily, "Comfortable", years, **bounds)
    spec = FE.fit_spec(batch_prof)
    batch_feat = FE.apply_spec(batch_prof, spec)
    cfg = M.infer_dims(batch_feat, M.AEConfig())
    vec = M.init_params(cfg, 11)
    batch = M.anomaly_slots(M.reconstruct(batch_feat, vec, cfg), 0.1)

    score = ST.batch_scorer(s.households, s.holidays, s.weather_daily, "Comfortable", years, spec, vec, cfg, 0.1, **bounds)
    sink, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")

    def run():
        q = ST.start(ST.block_stream(spark, inbox, max_files_per_trigger=1), score, sink, ckpt)
        q.awaitTermination(300)
        assert q.exception() is None
        return ST.read_scores(spark, sink)
    got = run()
    # the keys: every household-day once, whatever its year and trigger
    assert spark.read.parquet(f"{sink}/keys").count() == hh.count()
    # NumPy matmul may differ in the last bits between batch compositions
    cols = ["LCLid", "day", "slot", "label", "actual",
            F.round("recon", 9).alias("recon"), F.round("diff", 9).alias("diff")]
    assert got.count() == batch.count() > 0
    assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    # a block that is sent again, with one household-day more, adds that one
    again = hh.where(parity == 1).limit(5).toPandas()
    more = again.head(1).copy()
    more["LCLid"] = "MAC1234567"
    import pandas as pd
    pd.concat([again, more]).to_csv(os.path.join(scratch, "late.csv"), index=False)
    os.rename(os.path.join(scratch, "late.csv"), os.path.join(inbox, "late.csv"))
    run()
    assert spark.read.parquet(f"{sink}/keys").count() == hh.count() + 1


def test_batch_run_again_writes_once(spark, scratch):
    """A batch id that runs twice sees the keys of earlier batches only."""
    rows = [("MAC000001", "1996-01-01"), ("MAC000001", "1996-01-01"), ("MAC000002", "1997-02-02")]
    batch = spark.createDataFrame(rows, "LCLid string, day string")
    assert ST.unseen(batch, None).count() == 2
    seen = spark.createDataFrame([("MAC000001", "1996-01-01", 0, 1996)], ST.KEY_SCHEMA)
    assert [r.LCLid for r in ST.unseen(batch, seen).collect()] == ["MAC000002"]


def test_stream_key_equals_batch_key(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    q = E.queries()
    cols = ["LCLid", "day", "slot", "label", "actual", F.round("recon", 8).alias("recon")]
    a = q["anomaly_slots"](spark, sf).select(*cols)
    b = q["stream_anomaly_slots"](spark, sf).select(*cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_entry_importable_by_path_from_another_folder(tmp_path):
    """The driver may load __spark_entry__.py by path from any folder."""
    import subprocess
    import sys
    code = ("import importlib.util as u; s = u.spec_from_file_location('e', '/root/repo/__spark_entry__.py'); "
            "m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), len(m.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=300)
    assert out.returncode == 0, out.stderr[-500:]
    n_q, n_sql = map(int, out.stdout.split()[-2:])
    assert n_q >= n_sql > 0


def test_triggers_read_their_own_rows_only(spark, scratch):
    """Keyed state: nothing of earlier batches is read, re-sent files add nothing."""
    import shutil

    import pytest
    from meterlytics.schemas import HALF_HOURLY
    inbox, sink = os.path.join(scratch, "inbox"), os.path.join(scratch, "out")
    os.makedirs(inbox)
    head = ",".join(HALF_HOURLY.fieldNames())
    batches = []

    def score(rows):
        batches.append(sorted(r["LCLid"] for r in rows.select("LCLid").collect()))
        return rows.select("LCLid", "day")

    def run(**more):
        q = ST.start(ST.block_stream(spark, inbox, max_files_per_trigger=1), score, sink, os.path.join(scratch, "ckpt"), **more)
        q.awaitTermination(300)
        assert q.exception() is None
        return q
    for k in range(6):
        with open(os.path.join(inbox, f"b{k}.csv"), "w") as fh:
            fh.write(head + "\n" + "".join(f"H{k % 3},199{y}-01-01," + ",".join(["0.5"] * 48) + "\n" for y in range(1, 4)))
        q = run()
        # the history may go: a trigger does not look at it
        shutil.rmtree(os.path.join(sink, "keys"), ignore_errors=True)
    assert [len(b) for b in batches] == [3, 3, 3, 0, 0, 0]
    state = q.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 9 and state["numRowsUpdated"] == 0
    assert ST.read_scores(spark, sink).count() == 9
    with pytest.raises(ValueError):
        ST.start(None, score, sink, sink, keys="neither")
