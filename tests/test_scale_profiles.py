"""Profiles of more households than may be broadcast: nothing that grows with them goes through the driver."""

import re

import pytest
from pyspark.sql import functions as F

from meterlytics.operators import profiles as PR
from meterlytics.operators.joins import salted_semi_join
from meterlytics.schemas import N_SLOTS


def tables(spark):
    """Rows with a hot household, repeated and null keys, households twice or unknown, a group that shares its files."""
    files = {"H0": ("Affluent", "b0"), "H1": ("Adversity", "b0"), "H2": ("Adversity", "b1"), "H3": ("Affluent", "b2"),
             "H4": ("Comfortable", None), "H5": ("Affluent", None), None: ("Affluent", "b3")}
    homes = [(k, g, f) for k, (g, f) in files.items()] + [("H3", "Affluent", "b2"), ("H1", "Adversity", "b0")]
    days = [(k, f"2012-{1 + i % 12:02d}-{1 + i % 28:02d}") for i in range(30) for k in ("H0", "H1", "H2", "H4", "H9", None)]
    days += [("H3", f"2012-05-{1 + i % 28:02d}") for i in range(200)] + [("H0", "2011-12-31"), ("H0", "2014-01-01"), ("H5", "2013-02-03")]
    rows = [(k, d, *[None if (n + s) % 13 == 0 else (n * 31 + s * 17) % 64 / 64 for s in range(N_SLOTS)]) for n, (k, d) in enumerate(days)]
    return (spark.createDataFrame(rows, "LCLid string, day string, " + ", ".join(f"hh_{s} double" for s in range(N_SLOTS))),
            spark.createDataFrame(homes, "LCLid string, Acorn_grouped string, file string"),
            spark.createDataFrame([("2012-05-01",), ("2012-05-01",)], "holiday string"),
            spark.createDataFrame([("2012-05-02 00:00:00", 7.0, 0.5), ("2012-05-02 12:00:00", 9.0, 0.25)],
                                  "time string, temperatureMax double, humidity double"))


def run_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b):
    assert a.columns == b.columns and a.count() > 0
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("align", [False, True])
def test_many_households_are_not_broadcast(spark, strict, align):
    hh, homes, holidays, weather = tables(spark)
    args = (hh, homes, holidays, weather, "Affluent", (2012, 2013), strict, align)
    small = dict(holiday_rows=2, weather_rows=2)
    many = PR.daily_profiles(*args, households_rows=3_000_000, **small)
    same_rows(many, PR.daily_profiles(*args, households_rows=9, **small))
    plan = run_plan(many)
    # whatever the planner's estimate (these tables are tiny): holidays and weather alone are broadcast
    assert not re.search(r"BroadcastHashJoin \[(LCLid|file)#", plan) and re.search(r"SortMergeJoin.*\[LCLid#\d+, _salt#\d+\], LeftSemi", plan)
    assert "BroadcastHashJoin [LCLid" in run_plan(PR.daily_profiles(*args, households_rows=9, **small))


def test_many_files_are_not_broadcast(spark):
    hh, homes, holidays, weather = tables(spark)
    rows = hh.join(homes.distinct().hint("merge"), "LCLid").drop("Acorn_grouped")        # the CSV layout: rows carry their file
    args = (rows, homes, holidays, weather, "Affluent", (2012, 2013))
    many = PR.daily_profiles(*args, households_rows=3_000_000, holiday_rows=2, weather_rows=2)
    same_rows(many, PR.daily_profiles(*args, households_rows=9, holiday_rows=2, weather_rows=2))
    plan = run_plan(many)
    assert not re.search(r"BroadcastHashJoin \[(LCLid|file)#", plan) and re.search(r"SortMergeJoin.*\[file#\d+, _salt#\d+\], LeftSemi", plan)


def test_rows_are_shuffled_as_one_list(spark):
    hh, homes, holidays, weather = tables(spark)
    many = PR.daily_profiles(hh, homes, holidays, weather, "Affluent", (2012, 2013), households_rows=3_000_000)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    sides = plan[plan.index("LeftSemi"):]
    assert re.search(r"Project \[LCLid#\d+, day#\d+, .*AS hh_consumption#\d+, .*_salt#\d+\]", sides)


def test_salted_keys_are_not_broadcast(spark):
    fact = spark.range(400).select((F.col("id") % 7).alias("k"), F.col("id").cast("string").alias("day"))
    keys = spark.range(3).select(F.col("id").alias("k"))
    got = salted_semi_join(fact, keys, "k", spread_by="day")
    assert got.columns == ["k", "day"] and got.count() == fact.where("k < 3").count()
    assert "Broadcast" not in run_plan(got)


class Direct:
    """A store that keeps nothing: the plan of a table stays visible."""

    def materialize(self, name, build, **kw):
        return build()


@pytest.mark.parametrize("query", ["features", "anomalies", "error", "unconditional"])
def test_what_builds_on_profiles_broadcasts_no_households(spark, query):
    from meterlytics.operators import model as M
    from meterlytics.plans import pipeline as PL
    from meterlytics.sources.catalog import Sources
    names = ("half_hourly", "households", "holidays", "weather_daily")

    def built(rows):
        s = Sources(dict(zip(names, tables(spark))), {"households": rows, "holidays": 2, "weather_daily": 2})
        f = PL.feature_table(s, Direct(), "Affluent", (2012, 2013))
        if query == "unconditional":
            f = M.without_conditions(f)
        if query in ("features", "unconditional"):
            return f
        cfg = M.infer_dims(f, M.AEConfig(hidden_dim=4))
        scored = M.reconstruct(f, M.rule_params(cfg), cfg)
        out = M.anomaly_slots(scored) if query == "anomalies" else M.reconstruction_error(scored)
        return out.select([F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    many = built(3_000_000)
    same_rows(many, built(9))
    assert not re.search(r"BroadcastHashJoin \[(LCLid|file)#", run_plan(many))


def test_a_trigger_of_the_stream_broadcasts_no_households(spark):
    from meterlytics.operators import features as FE
    from meterlytics.operators import model as M
    from meterlytics.streaming import scoring as ST
    hh, homes, holidays, weather = tables(spark)
    spec = FE.fit_spec(PR.daily_profiles(hh, homes, holidays, weather, "Affluent", (2012, 2013), households_rows=9))
    cfg = M.AEConfig(input_dim=spec.length, cond_dim=FE.COND_DIM, hidden_dim=4)

    def scored(rows):
        return ST.batch_scorer(homes, holidays, weather, "Affluent", (2012, 2013), spec, M.rule_params(cfg), cfg,
                               households_rows=rows, holiday_rows=2, weather_rows=2)(hh)
    same_rows(scored(3_000_000), scored(9))
    assert not re.search(r"BroadcastHashJoin \[(LCLid|file)#", run_plan(scored(3_000_000)))
