"""Profiles, features and the autoencoder: Q20-Q25, M1-M7 against NumPy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlytics.operators import features as FE
from meterlytics.operators import model as M

PROF = ("LCLid string, day string, day_of_week int, is_weekend boolean, avg_temperature double, "
        "avg_humidity double, season int, hh_consumption array<double>")


def _prof(spark, rows):
    return spark.createDataFrame(rows, PROF)


def test_modal_length_smallest_on_tie_pad_and_cut(spark):     # Q21, V3
    rows = [("A", "d1", 1, False, 1.0, 0.5, 0, [1.0, 2.0]), ("B", "d2", 2, False, 2.0, 0.5, 1, [1.0, 2.0, 3.0]),
            ("C", "d3", 7, True, 3.0, 0.5, 3, [1.0])]
    f = {r.LCLid: r for r in FE.build_features(_prof(spark, rows)).collect()}
    assert f["A"].reading == [1.0] and f["C"].reading == [1.0]        # tie 1/2/3 -> 1
    rows.append(("D", "d4", 3, False, 4.0, 0.5, 2, [5.0, 6.0]))
    f = {r.LCLid: r for r in FE.build_features(_prof(spark, rows)).collect()}
    assert f["C"].reading == [1.0, 0.0] and f["B"].reading == [1.0, 2.0]


def test_condition_vector(spark):                               # Q22-Q25, V4-V6
    rows = [("A", "d1", 1, False, 10.0, None, 0, [1.0]), ("B", "d2", 7, True, 20.0, 0.5, 9, [1.0]),
            ("C", "d3", 4, True, None, 0.5, 2, [1.0])]
    f = {r.LCLid: r.cond for r in FE.build_features(_prof(spark, rows)).collect()}
    assert len(f["A"]) == FE.COND_DIM == 15
    assert f["A"][:7] == [1.0, 0, 0, 0, 0, 0, 0] and f["B"][:7] == [0, 0, 0, 0, 0, 0, 1.0]   # rebased 1-7
    assert f["A"][7:9] == [1.0, 0.0] and f["B"][7:9] == [0.0, 1.0]
    assert f["B"][9:13] == [0, 0, 0, 1.0]                                                   # clamped season
    temps = np.array([10.0, 20.0, 15.0])                                                    # NULL -> mean
    z = (temps - temps.mean()) / temps.std()
    assert [f[k][13] for k in "ABC"] == pytest.approx(list(z))
    assert [f[k][14] for k in "ABC"] == pytest.approx([0.0, 0.0, 0.0])                      # constant: centred


def test_list_codec_roundtrip(spark):                           # V1, V2
    df = spark.createDataFrame([([1.5, None, 2.0],)], "a array<double>")
    r = df.select(FE.encode_list("a").alias("t")).select("t", FE.decode_list("t").alias("b")).first()
    assert r.t == "1.5|None|2.0" and r.b == [1.5, 2.0]


def _cfg():
    return M.AEConfig(input_dim=6, cond_dim=3, hidden_dim=4, encoding_dim=2)


def test_forward_matches_brute_force():
    cfg = _cfg()
    vec = M.init_params(cfg, 3)
    rng = np.random.default_rng(0)
    x, c = rng.random((5, 6)), rng.random((5, 3))
    W1, b1, W2, b2, W3, b3, W4, b4 = M.unflatten(vec, cfg)
    out = []
    for i in range(5):
        h = [max(0.0, sum(np.r_[x[i], c[i]][k] * W1[k, j] for k in range(9)) + b1[j]) for j in range(4)]
        z = [sum(h[k] * W2[k, j] for k in range(4)) + b2[j] for j in range(2)]
        h2 = [max(0.0, sum(np.r_[z, c[i]][k] * W3[k, j] for k in range(5)) + b3[j]) for j in range(4)]
        out.append([sum(h2[k] * W4[k, j] for k in range(4)) + b4[j] for j in range(6)])
    assert M.forward(vec, cfg, x, c) == pytest.approx(np.array(out))
    assert M.n_params(M.AEConfig()) == 1106


def test_gradient_matches_finite_differences():
    cfg = _cfg()
    vec = M.init_params(cfg, 5)
    rng = np.random.default_rng(1)
    x, c = rng.random((7, 6)), rng.random((7, 3))
    _, g = M.sse_and_grad(vec, cfg, x, c)
    eps = 1e-6
    for i in rng.choice(vec.size, 25, replace=False):
        d = np.zeros_like(vec)
        d[i] = eps
        num = (M.sse_and_grad(vec + d, cfg, x, c)[0] - M.sse_and_grad(vec - d, cfg, x, c)[0]) / (2 * eps)
        assert g[i] == pytest.approx(num, rel=1e-4, abs=1e-6)


def _train_frame(spark, n=400, parts=4):
    rng = np.random.default_rng(2)
    base = np.sin(np.linspace(0, 3, 6))
    rows = [(f"H{i}", f"2013-01-{1 + i % 28:02d}", (base * (1 + 0.1 * rng.standard_normal())).tolist(),
             [float(i % 2), float(1 - i % 2), rng.random()]) for i in range(n)]
    return spark.createDataFrame(rows, "LCLid string, day string, reading array<double>, cond array<double>") \
        .repartition(parts)


def test_training_decreases_loss_and_full_mode_is_partition_independent(spark):
    f4 = _train_frame(spark, parts=4)
    cfg = M.AEConfig(hidden_dim=4, encoding_dim=2, epochs=6, mode="local", batch_size=32, learning_rate=0.01)
    _, _, hist = M.train(f4, cfg, checkpoint=False)
    assert hist[-1]["train_loss"] < hist[0]["train_loss"]
    full = M.AEConfig(hidden_dim=4, encoding_dim=2, epochs=3, mode="full", learning_rate=0.01)
    v4, _, h4 = M.train(f4, full, checkpoint=False)
    v1, _, h1 = M.train(f4.repartition(1), full, checkpoint=False)
    assert v4 == pytest.approx(v1, rel=1e-9, abs=1e-12)


def test_scoring_and_anomalies(spark, tmp_path):
    f = _train_frame(spark, n=20, parts=2)
    cfg = M.infer_dims(f, M.AEConfig(hidden_dim=4))
    vec = M.init_params(cfg, 9)
    scored = M.reconstruct(f, vec, cfg).cache()
    pdf = scored.toPandas()
    expect = M.forward(vec, cfg, np.stack(pdf.reading), np.stack(pdf.cond))
    assert np.stack(pdf.recon) == pytest.approx(expect)
    diffs = np.abs(np.stack(pdf.recon) - np.stack(pdf.reading))
    assert M.anomaly_slots(scored, 0.1).count() == int((diffs > 0.1).sum())
    mse = M.reconstruction_error(scored).first().mse
    assert mse == pytest.approx(float((diffs ** 2).mean()))
    M.save_model(spark, str(tmp_path / "m"), vec, cfg, {"acorn_group": "Comfortable"})
    back = M.load_model(spark, str(tmp_path / "m"), cfg, {"acorn_group": "Comfortable"})
    assert back is not None and back[0] == pytest.approx(vec)
    assert M.load_model(spark, str(tmp_path / "m"), cfg, {"acorn_group": "Affluent"}) is None


def test_train_or_load_reuses_stored_model(spark, tmp_path):
    f = _train_frame(spark, n=120, parts=2)
    cfg = M.AEConfig(hidden_dim=4, epochs=2, batch_size=32)
    path = str(tmp_path / "model")
    vec, used, hist, _, mse = M.train_or_load(spark, f, path, cfg, {"acorn_group": "G"})
    assert len(hist) >= 1 and mse > 0
    vec2, _, hist2, _, mse2 = M.train_or_load(spark, f, path, cfg, {"acorn_group": "G"})
    assert hist2 == [] and vec2 == pytest.approx(vec) and mse2 == pytest.approx(mse)
    errs = M.train_groups(spark, {"A": f, "B": f.limit(60)}, str(tmp_path / "groups"), cfg)
    assert set(errs) == {"A", "B"}


def test_text_weekend_and_year_label(spark):                     # C19, C22
    from meterlytics.operators.views import year_label
    rows = [("A", "d1", 1, "true", 1.0, 0.5, 0, [1.0]), ("B", "d2", 2, "False", 2.0, 0.5, 1, [1.0])]
    df = spark.createDataFrame(rows, PROF.replace("is_weekend boolean", "is_weekend string"))
    f = {r.LCLid: r.cond[7:9] for r in FE.build_features(df).collect()}
    assert f == {"A": [0.0, 1.0], "B": [1.0, 0.0]}
    assert year_label([2011, 2012]) == "2011, 2012" and year_label([]) == "All"


def test_training_does_not_depend_on_partitioning(spark, sources):
    """Equal weights for 1, 4 and 16 input partitions, in both modes; the
    schedule's rate of an epoch is set before that epoch."""
    rng = np.random.default_rng(3)
    rows = [(f"MAC{i % 40:06d}", f"2012-{1 + i % 12:02d}-{1 + i % 28:02d}", rng.random(6).tolist(), rng.random(3).tolist()) for i in range(700)]
    f = spark.createDataFrame(rows, "LCLid string, day string, reading array<double>, cond array<double>")
    for mode in ("local", "full"):
        cfg = M.AEConfig(hidden_dim=4, encoding_dim=2, epochs=3, mode=mode, batch_size=16, shards=5, learning_rate=0.01)
        runs = [M.train(f.repartition(n), cfg, checkpoint=False) for n in (1, 4, 16)]
        for vec, _, hist in runs[1:]:
            assert np.allclose(vec, runs[0][0], rtol=0, atol=1e-12)
            assert [h["epoch"] for h in hist] == [1, 2, 3]
        assert runs[0][2][-1]["val_loss"] < runs[0][2][0]["val_loss"]
    flat = M.AEConfig(hidden_dim=4, epochs=6, mode="full", learning_rate=1e-9, lr_patience=1, patience=9)
    rates = [h["lr"] for h in M.train(f, flat, checkpoint=False)[2]]
    assert rates == [1e-9] * 3 + [5e-10] * 2 + [2.5e-10]


def test_model_path_tells_group_years_and_code():
    paths = {M.model_path("/m/", g, y, M.AEConfig(encoding_dim=e)) for g in ("A", "B") for y in (None, (2011, 2012), (2011, 2013)) for e in (2, 3)}
    assert len(paths) == 12 and "/m/A_2011_2012_code2" in paths


def test_run_pipeline_for_group_and_years(spark, sources, scratch):
    from meterlytics.plans import pipeline as PL
    from meterlytics.sources.store import ResultStore
    store = ResultStore(spark, scratch + "/store")
    cfg = M.AEConfig(epochs=2, shards=4)
    a = PL.run_pipeline(spark, sources, store, "Affluent", (1996, 1997), cfg)
    assert len(a.history) == 2 and a.mse > 0 and a.model.endswith("Affluent_1996_1997_code2")
    b = PL.run_pipeline(spark, sources, store, "Affluent", (1996, 1997), cfg)
    assert b.history == [] and np.array_equal(a.params, b.params)
    c = PL.run_pipeline(spark, sources, store, "Affluent", (1996, 1998), cfg)
    assert c.model != a.model and c.scored.count() > a.scored.count()
    again = PL.run_pipeline(spark, sources, store, "Affluent", (1996, 1997), cfg, force_retrain=True)
    assert len(again.history) == 2
    names = store.list()
    assert {"profiles_Affluent_1996_1997", "features_Affluent_1996_1998", "models"} <= set(names)
    p = PL.acorn_profiles(sources, store, "Affluent", (1996, 1997), strict=True)
    assert 0 < p.count() < PL.acorn_profiles(sources, store, "Affluent", (1996, 1997)).count()
