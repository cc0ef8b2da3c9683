"""Sources and sinks: S1-S8, Q18, Q20, the fixture derivation."""
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlytics import schemas as S
from meterlytics.operators import profiles as PR
from meterlytics.sources import csv as C
from meterlytics.sources.catalog import derived_sources
from meterlytics.sources.store import ResultStore


def test_catalog_matches_derivation(spark, sources):
    raw = derived_sources(spark, "/root/testdata/sf0.001")
    for name in ("households", "holidays", "weather_daily"):
        assert sources.tables[name].exceptAll(raw.tables[name]).count() == 0
        assert sources.row_count(name) == raw.tables[name].count()


def test_csv_round_trip_and_strictness(spark, sources, scratch):
    tables = {k: sources.tables[k].select(*S.SOURCE_SCHEMAS[k].fieldNames()).limit(50) for k in C.LAYOUT}
    C.write_sources_csv(tables, scratch)
    back = C.read_sources(spark, scratch)
    assert [(f.name, f.dataType) for f in back["half_hourly"].schema] == \
        [(f.name, f.dataType) for f in S.HALF_HOURLY]
    assert back["holidays"].columns == ["holiday"]
    assert back["daily"].count() == 50
    # a needed column that is absent raises
    bad = os.path.join(scratch, "bad")
    sources.households.limit(5).select("stdorToU", "Acorn", "Acorn_grouped", "file").write.option("header", True).csv(bad)
    with pytest.raises(ValueError, match="LCLid"):
        C.read_csv_dir(spark, bad, S.HOUSEHOLDS)
    # a malformed value raises at the action, a missing file at once
    with open(os.path.join(scratch, "bad.csv"), "w") as fh:
        fh.write("time,temperature,humidity\n2012-01-01 00:00:00,warm,0.5\n")
    with pytest.raises(Exception):
        C.read_csv_file(spark, os.path.join(scratch, "bad.csv"), S.WEATHER_HOURLY).collect()
    with pytest.raises(ValueError):
        C.read_csv_file(spark, os.path.join(scratch, "nowhere.csv"), S.WEATHER_HOURLY)
    # empty directory raises
    empty = os.path.join(scratch, "empty")
    os.makedirs(empty)
    with pytest.raises(ValueError):
        C.read_csv_dir(spark, empty, S.HOUSEHOLDS)


def test_block_file_scan_adds_file(spark, sources, scratch):
    d = os.path.join(scratch, "blocks")
    os.makedirs(d)
    rows = sources.half_hourly.select(*S.HALF_HOURLY.fieldNames()).limit(3).toPandas()
    rows.to_csv(os.path.join(d, "block_7.csv"), index=False)
    df = C.read_block_files(spark, d, ["block_7"])
    assert df.select("file").distinct().first().file == "block_7" and df.count() == 3
    with pytest.raises(Exception):
        C.read_block_files(spark, d, ["block_8"]).collect()


def test_store_read_through_and_invalidate(spark, scratch):
    store = ResultStore(spark, os.path.join(scratch, "results"))
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("arr", F.array("id"))

    a = store.materialize("t", build)
    b = store.materialize("t", build)
    assert a.count() == 5 and b is a and len(calls) == 1
    assert store.load("t").schema["arr"].dataType.simpleString() == "array<bigint>"
    assert store.list() == ["t"]
    assert store.remove("t") and store.load("t") is None
    store.materialize("t", build, refresh=True)
    assert len(calls) == 2 and store.remove_all() == 1


def test_group_file_semijoin_default_and_strict(spark):     # Q18
    h = spark.createDataFrame([("A", "Std", "x", "Comfortable", "b1"), ("B", "Std", "y", "Affluent", "b1"),
                               ("C", "Std", "z", "Affluent", "b2")], S.HOUSEHOLDS)
    assert sorted(r.LCLid for r in PR.group_households(h, "Comfortable").collect()) == ["A", "B"]
    assert sorted(r.LCLid for r in PR.group_households(h, "Comfortable", strict=True).collect()) == ["A"]
    with pytest.raises(ValueError):
        PR.require_group(h, "Nobody")


def test_profiles_drop_or_align_nulls(spark):              # Q20, Q10, Q11
    vals = [0.5, None, 0.25] + [1.0] * 45
    hh = spark.createDataFrame([("A", "2013-12-27", *vals)], S.HALF_HOURLY)
    h = spark.createDataFrame([("A", "Std", "x", "Comfortable", "b1")], S.HOUSEHOLDS)
    hol = spark.createDataFrame([("2013-12-27",), ("2013-12-27",)], S.HOLIDAYS)
    w = spark.createDataFrame([("2013-12-27 00:00:00", 1.0, 5.0, 0.5), ("2013-12-27 12:00:00", 1.0, 7.0, 0.7)],
                              S.WEATHER_DAILY)
    p = PR.daily_profiles(hh, h, hol, w, "Comfortable", (2013, 2013)).collect()
    assert len(p) == 2                                   # duplicated holiday duplicates the day
    r = p[0]
    assert r.hh_consumption[:3] == [0.5, 0.25, 1.0] and len(r.hh_consumption) == 47
    assert r.is_weekend and r.day_of_week == 5 and r.season == 0
    assert r.avg_temperature == 6.0 and r.avg_humidity == pytest.approx(0.6)
    a = PR.daily_profiles(hh, h, hol.limit(1), w, "Comfortable", (2013, 2013), align=True).first()
    assert a.hh_consumption[:3] == [0.5, 0.0, 0.25] and len(a.hh_consumption) == 48
    assert PR.daily_profiles(hh, h, hol, w, "Comfortable", (2014, 2015)).count() == 0


def test_profiles_select_by_block_file_when_known(spark):     # Q18 with the CSV layout
    vals = [1.0] * 48
    hh = spark.createDataFrame([("A", "2013-01-02", *vals, "b1"), ("B", "2013-01-02", *vals, "b1"),
                                ("C", "2013-01-02", *vals, "b2"), ("X", "2013-01-02", *vals, "b1")],
                               T.StructType(S.HALF_HOURLY.fields + [T.StructField("file", T.StringType())]))
    h = spark.createDataFrame([("A", "Std", "x", "Comfortable", "b1"), ("B", "Std", "y", "Affluent", "b1"),
                               ("C", "Std", "z", "Affluent", "b2")], S.HOUSEHOLDS)
    hol = spark.createDataFrame([], S.HOLIDAYS)
    w = spark.createDataFrame([("2013-01-02 00:00:00", 1.0, 5.0, 0.5)], S.WEATHER_DAILY)
    got = sorted(r.LCLid for r in PR.daily_profiles(hh, h, hol, w, "Comfortable", (2013, 2013)).collect())
    assert got == ["A", "B", "X"]          # every row of block b1, even a household missing from the table
    strict = sorted(r.LCLid for r in PR.daily_profiles(hh, h, hol, w, "Comfortable", (2013, 2013),
                                                        strict=True).collect())
    assert strict == ["A"]


def test_compaction_keeps_block_file_and_year(spark, sources, scratch):
    from meterlytics.sources.csv import compact_to_parquet
    root = os.path.join(scratch, "csvroot")
    tables = {k: sources.tables[k].select(*S.SOURCE_SCHEMAS[k].fieldNames()).limit(40) for k in C.LAYOUT}
    C.write_sources_csv(tables, root)
    out = compact_to_parquet(spark, root, os.path.join(scratch, "pq"))
    hh = spark.read.parquet(out["half_hourly"])
    assert {"file", "year"} <= set(hh.columns) and hh.count() == 40
    assert hh.select("file").first().file.startswith("part-")


def test_queries_on_compacted_csv_layout_match_catalog(spark, sources, scratch):
    """Production path: CSV layout -> compaction -> the same query results."""
    from meterlytics.operators import patterns as P
    from meterlytics.sources.csv import compact_to_parquet
    root = os.path.join(scratch, "dataset")
    C.write_sources_csv({k: sources.tables[k].select(*S.SOURCE_SCHEMAS[k].fieldNames())
                         for k in C.LAYOUT if k != "half_hourly"}, root)
    # half-hourly rows as one block_N.csv per block, named like households.file
    blocks = os.path.join(root, C.LAYOUT["half_hourly"])
    os.makedirs(blocks)
    pdf = (sources.half_hourly.select(*S.HALF_HOURLY.fieldNames())
           .join(sources.households.select("LCLid", "file"), "LCLid").toPandas())
    for block, part in pdf.groupby("file"):
        part.drop(columns=["file"]).to_csv(os.path.join(blocks, f"{block}.csv"), index=False)
    out = compact_to_parquet(spark, root, os.path.join(scratch, "compact"))
    t = {k: spark.read.parquet(v) for k, v in out.items()}
    pairs = [
        (P.hourly_patterns(t["half_hourly"], years=[1996]), P.hourly_patterns(sources.half_hourly, years=[1996])),
        (P.weekday_vs_weekend(t["daily"], t["holidays"]), P.weekday_vs_weekend(sources.daily, sources.holidays)),
        (P.temperature_hourly(t["half_hourly"], t["weather_hourly"]),
         P.temperature_hourly(sources.half_hourly, sources.weather_hourly)),
    ]
    for a, b in pairs:
        ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.collect())
        rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect())
        assert ra == rb and len(ra) > 0
    # rows carry their block file after compaction: profiles select by file
    by_file = PR.daily_profiles(t["half_hourly"], t["households"], t["holidays"], t["weather_daily"],
                                "Comfortable", (1995, 2001))
    by_member = PR.daily_profiles(sources.half_hourly, sources.households, sources.holidays,
                                  sources.weather_daily, "Comfortable", (1995, 2001))
    cols = ["LCLid", "day", "is_weekend", F.size("hh_consumption").alias("n")]
    assert by_file.count() == by_member.count() > 0
    assert by_file.select(*cols).exceptAll(by_member.select(*cols)).count() == 0


def test_long_household_keys_stay_apart(spark):
    """Keys of 6, 7 and 12 digits: none is cut, in Spark and in DuckDB."""
    import duckdb

    from meterlytics.plans import sqltext
    from meterlytics.sources import fixtures
    keys = [1, 123456, 999999, 1000000, 1234560, 1234567, 123456000001]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(fixtures._lclid(F.col("k"))).collect()]
    assert got == ["MAC000001", "MAC123456", "MAC999999", "MAC1000000", "MAC1234560", "MAC1234567", "MAC123456000001"]
    con = duckdb.connect()
    con.sql("CREATE TABLE customer AS SELECT unnest(%s)::BIGINT AS c_custkey, 3 AS c_nationkey" % keys)
    want = con.sql(f"SELECT LCLid FROM ({sqltext.FIXTURE_CTES['households']})").fetchall()
    assert sorted(r[0] for r in want) == sorted(got)


def test_real_headers(spark, sources, scratch):
    """Further columns, another order and files of one folder that differ in
    it: all six sources read by name and equal the tables written."""
    want = {n: sources.tables[n].select(*S.SOURCE_SCHEMAS[n].fieldNames()).limit(40).toPandas() for n in C.LAYOUT}
    for name, df in want.items():
        path = os.path.join(scratch, C.LAYOUT[name])
        df = df.rename(columns={"holiday": "Bank holidays"})
        more = df.assign(windBearing=1.5, icon="a, \"b\"")
        mixed = more[["icon", *reversed(df.columns), "windBearing"]]
        if name in ("half_hourly", "daily"):
            os.makedirs(path)
            mixed.head(20).to_csv(os.path.join(path, "block_0.csv"), index=False)
            df.tail(20).to_csv(os.path.join(path, "block_1.csv"), index=False)
        else:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            mixed.to_csv(path, index=False)
    for src in (C.load_sources_csv(spark, scratch), C.load_sources_csv(spark, scratch, os.path.join(scratch, "parquet"))):
        for name, df in want.items():
            cols = S.SOURCE_SCHEMAS[name].fieldNames()
            got = src.tables[name].select(*cols)
            assert got.schema.simpleString() == S.SOURCE_SCHEMAS[name].simpleString()
            back = spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(), got.schema)
            assert got.exceptAll(back).count() == back.exceptAll(got).count() == 0, name
        assert src.row_count("households") == 40 and src.row_count("half_hourly") is None
        assert {r.file for r in src.half_hourly.select("file").distinct().collect()} == {"block_0", "block_1"}


def test_getters_on_the_csv_layout_equal_the_catalog(spark, sources, scratch):
    from meterlytics.plans.storage import PatternStorage
    C.write_sources_csv({k: sources.tables[k].select(*S.SOURCE_SCHEMAS[k].fieldNames()) for k in C.LAYOUT}, scratch)
    a = PatternStorage(sources, ResultStore(spark, os.path.join(scratch, "a")))
    b = PatternStorage(C.load_sources_csv(spark, scratch), ResultStore(spark, os.path.join(scratch, "b")))
    for get in ("get_hourly_patterns", "get_seasonal_patterns", "get_weekday_vs_weekend_patterns", "get_household_patterns"):
        x, y = getattr(a, get)(), getattr(b, get)()
        cols = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes]
        assert x.count() == y.count() > 0 and x.select(*cols).exceptAll(y.select(*cols)).count() == 0


def test_store_is_durable_and_follows_the_inputs(spark, scratch):
    """A second application writes nothing; a changed input is rebuilt, in the
    same session too; two builders of one name leave one whole table."""
    import shutil
    import subprocess
    import sys

    from meterlytics.sources import catalog
    sf = os.path.join(scratch, "sf")
    os.makedirs(sf)
    for t in ("customer", "orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", os.path.join(sf, f"{t}.parquet"))
    code = ("import sys, os; sys.path.insert(0, '/root/repo'); from meterlytics.session import build_session; "
            "from meterlytics.sources.catalog import load_sources; "
            f"s = build_session('local[2]', extra={{'spark.checkpoint.dir': {scratch + '/ckpt'!r}}}, shuffle_partitions=2); "
            f"r = load_sources(s, {sf!r}); print('ROOT', r.root, r.row_count('households'), r.row_count('daily')); "
            "print('MADE', max(os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(r.root) for f in fs))")
    runs = [subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300) for _ in range(2)]
    said = [[x for x in r.stdout.splitlines() if x.startswith(("ROOT", "MADE"))] for r in runs]
    assert said[0] == said[1] and len(said[0]) == 2 and " 150 None" in said[0][0], runs[0].stderr[-400:]
    spark.conf.set("spark.meterlytics.store", os.path.join(scratch, "own"))
    try:
        a = catalog.load_sources(spark, sf)
        assert catalog.load_sources(spark, sf) is a and a.root.startswith(os.path.join(scratch, "own"))
        os.utime(os.path.join(sf, "customer.parquet"), (1, 1))
        b = catalog.load_sources(spark, sf)
        assert b.root != a.root and b.households.count() == a.households.count()
    finally:
        spark.conf.unset("spark.meterlytics.store")
    one, two = ResultStore(spark, scratch + "/r"), ResultStore(spark, scratch + "/r")
    def late():
        one.materialize("x", lambda: spark.range(3), memory=False)
        return spark.range(5)
    assert two.materialize("x", late, memory=False).count() == 3 and two.list() == ["x"]
    two.save("x", spark.range(7))
    assert one.load("x").count() == 7 and one.list() == ["x"]
