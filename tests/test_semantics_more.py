"""Remaining Q-numbers: Q5, Q17, Q31, Q36, Q37 and the S9 getters."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlytics.operators import model as M
from meterlytics.operators import patterns as P
from meterlytics.operators import segments as SG
from meterlytics.operators import weather as WX
from meterlytics.plans.storage import PatternStorage
from meterlytics.schemas import DAILY
from meterlytics.sources.store import ResultStore


def test_row_count_vs_non_null_count(spark):                          # Q5
    df = spark.createDataFrame([("A", "2013-01-07", None, None, None, None, None, None, None),
                                ("B", "2013-01-07", 1.0, 1.0, 1.0, None, None, 1.0, 1.0)], DAILY)
    r = P.weekly_patterns(df).first()
    assert r.weeks_count == 2 and r.energy_count == 0 and r.energy_mean == 1.0


def test_empty_filters_mean_no_filter(spark, sources):              # Q31
    hh = P.household_patterns(sources.daily, sources.households)
    assert SG.filter_segments(hh, [], None).count() == hh.count()
    te = P.temperature_energy(sources.daily, sources.weather_daily)
    assert WX.filter_weather(te, [], []).count() == te.count()
    assert P.finish(te, [], None).count() == te.count()
    assert {r.year for r in P.finish(te, [1996], ["year"]).collect()} <= {1996}


def test_year_filter_equals_result_filter(spark, sources):           # F1 pushdown == reference's post-filter
    pushed = P.daily_patterns(sources.daily, years=[1996, 1998])
    after = P.daily_patterns(sources.daily).where(F.col("year").isin(1996, 1998))
    assert pushed.exceptAll(after).count() == 0 and after.exceptAll(pushed).count() == 0


def test_anomaly_threshold_is_strict(spark):                          # Q36
    f = spark.createDataFrame([("A", "d", [0.0, 0.0], [0.1, 0.1000001])],
                              "LCLid string, day string, reading array<double>, recon array<double>")
    got = M.anomaly_slots(f, 0.1).collect()
    assert [r.slot for r in got] == [1]


def test_last_weights_kept_unless_restore_best(spark):               # Q37
    rng = np.random.default_rng(4)
    rows = [(f"H{i}", "2013-01-01", rng.random(4).tolist(), [1.0]) for i in range(200)]
    f = spark.createDataFrame(rows, "LCLid string, day string, reading array<double>, cond array<double>")
    cfg = M.AEConfig(hidden_dim=3, epochs=4, patience=1, learning_rate=0.5, mode="full")
    last, _, hist = M.train(f, cfg, checkpoint=False)
    best, _, hist_b = M.train(f, M.AEConfig(**{**cfg.__dict__, "restore_best": True}), checkpoint=False)
    assert [h["val_loss"] for h in hist] == pytest.approx([h["val_loss"] for h in hist_b])
    if min(h["val_loss"] for h in hist) < hist[-1]["val_loss"]:
        assert not np.allclose(last, best)


def test_named_getters_read_through(spark, sources, scratch):        # S9
    st = PatternStorage(sources, ResultStore(spark, os.path.join(scratch, "store")))
    a = st.get_daily_patterns(years=[1996], cols=["year", "weekday", "days_count"])
    assert a.columns == ["year", "weekday", "days_count"] and {r.year for r in a.collect()} <= {1996}
    assert "daily_patterns" in st.get_cached_files()
    assert st.get_household_patterns().count() > 0
    assert st.remove_cache("daily_patterns") and "daily_patterns" not in st.get_cached_files()
    assert st.remove_all_caches() >= 1
