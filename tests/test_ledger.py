"""S1, S3, S5-S8 by a ledger: files that come, change and go; broken files;
results that follow by year; retention."""
import os

import pytest
from pyspark.sql import functions as F

from meterlytics import schemas as S
from meterlytics.operators import patterns as P
from meterlytics.plans.storage import PatternStorage
from meterlytics.session import first_line, files_under
from meterlytics.sources import csv as C
from meterlytics.sources.ledger import Ledger
from meterlytics.sources.store import ResultStore

HEAD = ["LCLid", "day", *[f"hh_{i}" for i in range(48)]]


def block(folder, name, rows, head=HEAD, text=None):
    """A block file of (household, day, first reading) rows; the others are 0.5."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.csv")
    with open(path, "w") as fh:
        if text is not None:
            fh.write(text)
            return path
        fh.write(",".join(head) + "\n")
        for lcl, day, x in rows:
            cells = {"LCLid": lcl, "day": day, **{f"hh_{i}": "0.5" for i in range(48)}, "hh_0": "" if x is None else x, "extra": "more"}
            fh.write(",".join(str(cells[c]) for c in head) + "\n")
    return path


def ledger(spark, scratch):
    return Ledger(spark, scratch + "/ledger", scratch + "/blocks", S.HALF_HOURLY)


def rows(df):
    return sorted((r["LCLid"], r["day"], r["hh_0"], r["hh_47"], r["file"], r["year"]) for r in df.collect())


def written(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root + "/ledger/data") for f in fs if f.endswith(".parquet")}


def test_files_come_change_and_go(spark, scratch):
    d = scratch + "/blocks"
    block(d, "a", [("A", "2012-01-01", 1), ("A", "2013-05-01", None)])
    block(d, "b", [("B", "2012-01-02", 2), ("B", "2014-01-01", 3)])
    led = ledger(spark, scratch)
    one = led.refresh()
    assert one.added == ["a", "b"] and not one.changed and {y for y, _ in one.written} == {2012, 2013, 2014}
    first = rows(led.table())
    assert first == [("A", "2012-01-01", 1.0, .5, "a", 2012), ("A", "2013-05-01", None, .5, "a", 2013),
                     ("B", "2012-01-02", 2.0, .5, "b", 2012), ("B", "2014-01-01", 3.0, .5, "b", 2014)]
    before, marks = written(scratch), led.marks()
    # nothing new: no version, no file
    assert not led.refresh().any and written(scratch) == before and led.versions() == [0]
    # a new file writes its years only
    block(d, "c", [("C", "2013-01-01", 4)])
    two = led.refresh()
    assert two.added == ["c"] and [y for y, _ in two.written] == [2013]
    assert {p.split("year=")[1][:4] for p in written(scratch) - before} == {"2013"} and before <= written(scratch)
    assert {y for y, m in led.marks().items() if marks.get(y) != m} == {2013}
    assert rows(led.table()) == sorted(first + [("C", "2013-01-01", 4.0, .5, "c", 2013)])
    # a changed file and a removed one: the folders that held their rows are rewritten
    block(d, "a", [("A", "2012-01-01", 9)])
    os.remove(d + "/c.csv")
    three = led.refresh()
    assert (three.added, three.changed, three.removed) == ([], ["a"], ["c"])
    assert rows(led.table()) == [("A", "2012-01-01", 9.0, .5, "a", 2012), ("B", "2012-01-02", 2.0, .5, "b", 2012),
                                 ("B", "2014-01-01", 3.0, .5, "b", 2014)]
    # older versions can still be read, until they are retired
    assert rows(led.table(0)) == first and led.versions() == [0, 1, 2]
    with pytest.raises(ValueError):
        led.table(7)
    assert led.vacuum(keep=1) > 0 and led.versions() == [2] and len(rows(led.table())) == 3
    live = written(scratch)
    assert led.vacuum(keep=1) == 0 and written(scratch) == live
    # years of many batches become one
    for k in range(3):
        block(d, f"n{k}", [(f"N{k}", "2012-02-01", k)])
        led.refresh()
    want = rows(led.table())
    change = led.compact(batches=2)
    assert len(change.written) == 1 and rows(led.table()) == want and led.compact(batches=2) is None
    assert led.remove_all() and led.versions() == []


def test_broken_files_are_named_and_the_others_served(spark, scratch):
    d = scratch + "/blocks"
    block(d, "good", [("G", "2012-01-01", 1)])
    other = HEAD[::-1]
    block(d, "order", [("O", "2012-01-02", 2), ("O", "2013-01-02", None)], other)
    block(d, "wider", [("W", "2012-01-03", 3)], ["extra", *HEAD])
    block(d, "value", [("V", "2012-01-04", 1), ("V", "2012-01-05", "warm")])
    block(d, "short", [], text=",".join(HEAD) + "\nS,2012-01-01,0.5\n")
    block(d, "lacks", [("L", "2012-01-06", 1)], [c for c in HEAD if c != "day"])
    block(d, "empty", [], text="\n")
    block(d, "no_bytes", [], text="")                      # not even listed
    block(d, "bare", [], text="B,2012-01-07," + ",".join(["0.5"] * 48) + "\n")
    block(d, "only_head", [])
    led = ledger(spark, scratch)
    change = led.refresh()
    assert rows(led.table()) == [("G", "2012-01-01", 1.0, .5, "good", 2012), ("O", "2012-01-02", 2.0, .5, "order", 2012),
                                 ("O", "2013-01-02", None, .5, "order", 2013), ("W", "2012-01-03", 3.0, .5, "wider", 2012)]
    why = {r["file"]: r["reason"] for r in led.report().collect()}
    assert sorted(why) == change.quarantined == ["bare", "empty", "lacks", "short", "value"]
    assert why["value"] == "value of hh_0 (1 lines)" and why["short"] == "number of values (1 lines)"
    assert why["lacks"] == "no column day" and why["empty"] == "empty" and why["bare"] == "no header"
    # nothing of a broken file is left behind, and a mended one comes back
    assert not led.refresh().any
    block(d, "value", [("V", "2012-01-04", 1)])
    assert led.refresh().changed == ["value"] and ("V", "2012-01-04", 1.0, .5, "value", 2012) in rows(led.table())
    with pytest.raises(ValueError, match="no column day"):
        Ledger(spark, scratch + "/strict", d, S.HALF_HOURLY).refresh(strict=True)
    with pytest.raises(ValueError, match="No files"):
        os.makedirs(scratch + "/none")
        Ledger(spark, scratch + "/l2", scratch + "/none", S.HALF_HOURLY).refresh()


def test_the_first_file_may_be_the_broken_one(spark, scratch):
    d = scratch + "/blocks"
    block(d, "a", [], text="\n\n")
    block(d, "b", [("L", "2012-01-06", 1)], ["LCLid", "hh_0"])
    block(d, "c", [("G", "", 1), ("G", "2012-01-01", 2)])
    led = ledger(spark, scratch)
    assert led.refresh().quarantined == ["a", "b"]
    got = led.table().select("day", "hh_0", "year").collect()
    assert sorted(map(tuple, got), key=repr) == [("2012-01-01", 2.0, 2012), (None, 1.0, None)]
    assert set(led.marks()) == {None, 2012}


def test_each_file_is_scanned_once(spark, scratch):
    """The write of the rows is the only scan; headers cost a line."""
    d = scratch + "/blocks"
    block(d, "a", [("A", "2012-01-01", 1)])
    block(d, "b", [("B", "2012-01-01", 1)])
    led, scans = ledger(spark, scratch), []
    scan = led._scan
    led._scan = lambda paths, names, batch: (scans.append(len(paths)), scan(paths, names, batch))
    led.refresh()
    assert scans == [2]
    assert first_line(spark, d + "/a.csv") == ",".join(HEAD) and first_line(spark, block(d, "e", [], text="")) is None
    assert [os.path.basename(f) for f in files_under(spark, d, "[ab].csv")] == ["a.csv", "b.csv"]
    with pytest.raises(FileNotFoundError):
        files_under(spark, d + "/nowhere")


def test_results_follow_the_files_by_year(spark, sources, scratch, monkeypatch):
    tables = {n: sources.tables[n].select(*S.SOURCE_SCHEMAS[n].fieldNames()) for n in C.LAYOUT}
    root = scratch + "/root"
    C.write_sources_csv(tables, root)
    src = C.load_sources_ledger(spark, root, scratch + "/ledger")
    store = ResultStore(spark, scratch + "/results")
    a, b = PatternStorage(sources, ResultStore(spark, scratch + "/plain")), PatternStorage(src, store)

    def same(x, y):
        cols = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes]
        assert x.count() == y.count() > 0 and x.select(*cols).exceptAll(y.select(*cols)).count() == 0
    getters = ("get_hourly_patterns", "get_daily_patterns", "get_seasonal_patterns", "get_temperature_energy_patterns")
    for get in getters:
        same(getattr(a, get)(), getattr(b, get)())
    # one household-day more, in a file of its own: only its year is computed again
    seen = []
    cells = P.hourly_cells
    monkeypatch.setattr(P, "hourly_cells", lambda df: (seen.append(sorted(r[0] for r in df.select("year").distinct().collect())), cells(df))[1])
    folder = f"{root}/{C.LAYOUT['half_hourly']}"
    block(folder, "zz", [("NEW", "1995-03-04", 7)])
    src = C.load_sources_ledger(spark, root, scratch + "/ledger")
    assert src.changes["half_hourly"].added == ["zz"] and not src.changes["daily"].any
    got = PatternStorage(src, store).get_hourly_patterns()
    same(P.hourly_patterns(src.half_hourly), got)
    assert seen == [[1995]]
    assert [n for n in store.list() if n.startswith("hourly_patterns@")] == [n for n in store.list() if "hourly_patterns" in n][-1:]


def test_parts_and_leftovers_of_the_store(spark, scratch):
    store, calls = ResultStore(spark, scratch + "/r"), []

    def build(years):
        calls.append(years)
        return spark.createDataFrame([(y, v) for y in years for v in (1, 2) if y != 2013], "year int, v int")
    t = store.materialize_parts("t", {2012: "a", 2013: "a", None: "a"}, build)
    assert sorted(map(tuple, t.collect()), key=repr) == sorted([(2012, 1), (2012, 2), (None, 1), (None, 2)], key=repr)
    store.materialize_parts("t", {2012: "b", 2013: "a", None: "a"}, build)
    assert calls == [[None, 2012, 2013], [2012]] and store.list() == ["t"]
    assert sorted(os.listdir(scratch + "/r/t.parts/year=2012")) == ["mark=b"]
    os.makedirs(scratch + "/r/.making-x-1")
    os.makedirs(scratch + "/r/y.old-1")
    assert store.clean() == 0 and store.list() == ["t"]       # young: a writer may be at work
    assert store.clean(age=-1) == 2
    assert store.remove_all() == 1 and store.list() == []


def test_older_roots_of_an_input_are_removed(spark, scratch):
    import shutil

    from meterlytics.sources import catalog
    sf = scratch + "/sf"
    os.makedirs(sf)
    for t in ("customer", "orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", f"{sf}/{t}.parquet")
    spark.conf.set("spark.meterlytics.store", scratch + "/own")
    try:
        a = catalog.load_sources(spark, sf)
        os.utime(f"{sf}/customer.parquet", (1, 1))
        b = catalog.load_sources(spark, sf)
        assert catalog.older_roots(spark, sf) == [a.root] and os.path.isdir(a.root)
        assert catalog.remove_older(spark, sf) == 1 and not os.path.isdir(a.root) and b.households.count() > 0
        assert catalog.load_sources(spark, sf) is b
    finally:
        spark.conf.unset("spark.meterlytics.store")


def test_a_group_reads_the_slices_of_its_files(spark, scratch):
    """The files of a group prune folders while the query runs."""
    from meterlytics.operators import profiles as PR
    d = scratch + "/blocks"
    for k in range(6):
        block(d, f"block_{k}", [(f"H{k}", "2012-01-01", k)])
    led = ledger(spark, scratch)
    led.refresh()
    households = spark.createDataFrame([(f"H{k}", "Std", "x", "Comfortable" if k == 4 else "Affluent", f"block_{k}") for k in range(6)], S.HOUSEHOLDS)
    path = scratch + "/h"
    households.write.parquet(path)
    households = spark.read.parquet(path)
    none = spark.createDataFrame([], "holiday string")
    wx = spark.createDataFrame([], S.SOURCE_SCHEMAS["weather_daily"])
    got = PR.daily_profiles(led.table(), households, none, wx, "Comfortable", (2011, 2013), households_rows=6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "file_slice" in plan.split("PartitionFilters")[1]
    assert [r["LCLid"] for r in got.collect()] == ["H4"]
