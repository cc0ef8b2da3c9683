"""Query keys -> Spark builders ``(spark, sf_dir) -> DataFrame``.

Every builder reads the driver's tables (through the normalised source
catalog) and runs the package operators over the whole tables.

Like the reference's storage layer (S7), the eight pattern results and the
profile / feature tables are materialised once per source fingerprint
(``ResultStore`` under the shared folder) and the second-stage keys run over
the stored results; the stored feature table is also what training and
scoring read, so no key re-runs the profile join. ``filtered_projection``
deliberately recomputes from the sources to exercise the year pushdown.

``contract`` rounds doubles to 9 places, as the oracle SQL does (summation
order differs between engines), so that results compare by value hash.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import distinct as DI
from ..operators import features as FE
from ..schemas import HALF_HOURLY, SOURCE_SCHEMAS
from ..operators import model as M
from ..operators import patterns as P
from ..operators import profiles as PR
from ..operators import segments as SG
from ..operators import views as V
from ..operators import weather as WX
from ..operators.quantiles import exact_quantiles
from ..sources import csv as C
from ..sources.catalog import Sources, load_sources
from ..session import compile_methods, disk_state, path_exists, ship_package
from ..sources.ledger import Ledger
from ..sources.store import ResultStore
from ..streaming import scoring as ST
from . import oracle as O
from . import pipeline as PL

Builder = Callable[[SparkSession, str], DataFrame]

_STORES: dict[str, ResultStore] = {}
_LOCK = threading.Lock()


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of a double, the same value for less: it goes through decimal
    text, which is needed only near a tie (within 0.001 of a half, where the
    product may err) and for large values, null, NaN and infinity."""
    t = F.abs(x) * F.lit(float(10 ** digits))
    whole = F.rint(t)
    near = whole / F.lit(float(10 ** digits))
    return (F.when((t < F.lit(float(1 << 40))) & (F.abs(t - whole) < F.lit(0.499)), F.when(x < 0, F.lit(0.0) - near).otherwise(near))
            .otherwise(F.round(x, digits)))


def contract(df: DataFrame, digits: int = 9) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(rounded(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def src(spark: SparkSession, sf_dir: str) -> Sources:
    ship_package(spark)            # Python workers import the package (UDFs)
    compile_methods(spark)
    return load_sources(spark, sf_dir)


def store(spark: SparkSession, sf_dir: str) -> ResultStore:
    root = src(spark, sf_dir).root
    with _LOCK:
        if root not in _STORES:
            _STORES[root] = ResultStore(spark, f"{root}/results")
        return _STORES[root]


def stored(name: str, build: Builder, memory: bool = False) -> Builder:
    """A builder whose result is materialised once (S7) and read back.

    ``memory=True`` adds the memory level (``cache()`` of the read-back
    table) for results bounded by their key domain, i.e. the pattern
    results; data-sized tables (profiles, features) stay Parquet reads.
    A lost cached block is re-read from the stored Parquet."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return store(spark, sf_dir).materialize(name, lambda: build(spark, sf_dir), memory=memory)
    run.__name__ = name
    return run


# ---------------------------------------------------------------- patterns

def _hourly(spark, sf_dir):
    return P.hourly_patterns(src(spark, sf_dir).half_hourly)


# the one scan of ``daily`` that A2-A5 and A7 share: partial sums per date
date_partials = stored("date_partials", lambda spark, sf_dir: P.date_partials(src(spark, sf_dir).daily))


def _daily(spark, sf_dir):
    return P.daily_patterns(date_partials(spark, sf_dir))


def _weekly(spark, sf_dir):
    return P.weekly_patterns(date_partials(spark, sf_dir))


def _seasonal(spark, sf_dir):
    return P.seasonal_patterns(date_partials(spark, sf_dir))


def _weekend(spark, sf_dir):
    s = src(spark, sf_dir)
    return P.weekday_vs_weekend(date_partials(spark, sf_dir), s.holidays, holiday_rows=s.bound("holidays"))


def _household(spark, sf_dir):
    s = src(spark, sf_dir).ready("daily", "households")
    return P.household_patterns(s.daily, s.households, households_rows=s.bound("households"))


def _temperature(spark, sf_dir):
    s = src(spark, sf_dir)
    return P.temperature_energy(date_partials(spark, sf_dir), s.weather_daily, weather_rows=s.bound("weather_daily"))


def _temperature_hourly(spark, sf_dir):
    s = src(spark, sf_dir).ready("half_hourly", "weather_hourly")
    return P.temperature_hourly(s.half_hourly, s.weather_hourly,
                                weather_rows=s.bound("weather_hourly"))


hourly = stored("hourly_patterns", _hourly, memory=True)
daily = stored("daily_patterns", _daily, memory=True)
weekly = stored("weekly_patterns", _weekly, memory=True)
seasonal = stored("seasonal_patterns", _seasonal, memory=True)
weekend = stored("weekday_vs_weekend", _weekend, memory=True)
household = stored("household_patterns", _household, memory=True)
temperature = stored("temperature_energy", _temperature, memory=True)
temperature_hourly = stored("temperature_hourly", _temperature_hourly, memory=True)


# ---------------------------------------------------------------- second stage

def filtered_projection(spark, sf_dir):
    """F1 pushed to the scan + F4/F5 + P1, recomputed from the sources."""
    s = src(spark, sf_dir)
    te = P.temperature_energy(s.daily, s.weather_daily, years=O.FILTER_YEARS,
                              weather_rows=s.bound("weather_daily"))
    return P.finish(WX.filter_weather(te, O.FILTER_MONTHS, O.FILTER_BINS), None,
                    ["year", "month", "month_name", "temp_bin", "energy_mean", "days_count"])


def segment_points(spark, sf_dir):
    return SG.segment_points(SG.filter_segments(household(spark, sf_dir),
                                                O.FILTER_TARIFFS, O.FILTER_ACORNS))


def second(fn, base):
    def run(spark, sf_dir):
        return fn(base(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "second")
    return run


def distinct_filters(spark, sf_dir):
    return (V.distinct_values(household(spark, sf_dir), "Acorn", "acorn")
            .unionByName(V.distinct_values(temperature(spark, sf_dir), "temp_bin", "temp_bin")))


# ---------------------------------------------------------------- profiles / features

_TAG = PL.profile_tag(O.PROFILE_GROUP, O.PROFILE_YEARS)


def profile_table(group: str, years: tuple[int, int], strict: bool = False, align: bool = False) -> Builder:
    def run(spark, sf_dir):
        return PL.acorn_profiles(src(spark, sf_dir), store(spark, sf_dir), group, years, strict, align)
    return run


profiles = profile_table(O.PROFILE_GROUP, O.PROFILE_YEARS)


def feature_table(spark, sf_dir, group: str = O.PROFILE_GROUP, years: tuple[int, int] = O.PROFILE_YEARS):
    return PL.feature_table(src(spark, sf_dir), store(spark, sf_dir), group, years)


def _profile_rows(p: DataFrame) -> DataFrame:
    return p.select("LCLid", "day", "day_of_week", "is_weekend", "avg_temperature",
                    "avg_humidity", "season", F.size("hh_consumption").alias("n_readings"),
                    FE.micro_text("hh_consumption").alias("hh_consumption"))


def group_files(spark, sf_dir):
    return PR.group_files(src(spark, sf_dir).households, O.PROFILE_GROUP)


def placed(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of a sorted one-partition result with their place (from 1): makes
    the order of a result part of its rows."""
    return df.coalesce(1).select((F.monotonically_increasing_id() + 1).alias("place"), *cols)


def features(spark, sf_dir):
    f = feature_table(spark, sf_dir)
    return f.select("LCLid", "day", F.size("reading").alias("reading_len"),
                    FE.micro_text("reading").alias("reading"),
                    FE.micro_text("cond").alias("cond"))


# ---------------------------------------------------------------- model

FIXED_WEIGHT_SEED = 7          # rule weights for the scoring keys (model.rule_params)
ANOMALY_THRESHOLD = 0.1


def scored_table(spark, sf_dir):
    """M6 output (reading + reconstruction per household-day): one pass over the
    stored features, not stored itself, which would write every reconstructed double."""
    f = feature_table(spark, sf_dir)
    cfg = M.infer_dims(f, M.AEConfig())
    return M.reconstruct(f, M.rule_params(cfg, FIXED_WEIGHT_SEED), cfg)


def reconstruction_fixed(spark, sf_dir):
    return M.row_errors(scored_table(spark, sf_dir))


def anomaly_slots(spark, sf_dir):
    return M.anomaly_slots(scored_table(spark, sf_dir), ANOMALY_THRESHOLD)


def reconstruction_error(spark, sf_dir):
    return M.reconstruction_error(scored_table(spark, sf_dir))


def reconstruction_by_group(spark, sf_dir):
    """M8: the error of every group's rows under the rule weights."""
    parts = []
    for group in O.GROUPS:
        f = feature_table(spark, sf_dir, group)
        cfg = M.infer_dims(f, M.AEConfig())
        scored = M.reconstruct(f, M.rule_params(cfg, FIXED_WEIGHT_SEED), cfg)
        parts.append(M.reconstruction_error(scored).select(F.lit(group).alias("acorn_group"), "mse"))
    return parts[0].union(parts[1]).union(parts[2])


def list_codec(spark, sf_dir):
    """V1, V2: the 48 readings as text and back, over all half-hourly rows."""
    raw = F.array(*[F.col(f"hh_{i}") for i in range(48)])
    back = FE.decode_list("text")
    return (src(spark, sf_dir).half_hourly.select("LCLid", "day", FE.encode_list(raw).alias("text"))
            .select("LCLid", "day", "text", F.size(back).cast("long").alias("n"),
                    F.aggregate(back, F.lit(0.0), lambda a, x: a + x).alias("total")))


def weekend_text(spark, sf_dir):
    """The weekend index from a flag that arrives as text."""
    p = profiles(spark, sf_dir).select("LCLid", "day", F.initcap(F.col("is_weekend").cast("string")).alias("is_weekend"))
    return p.select("LCLid", "day", "is_weekend", FE.weekend_index(p).alias("weekend"))


STEP_RATE = 0.01


def train_step_fixed(spark, sf_dir):
    """One full training step (M4) from the rule weights: gradient and new
    weight of every parameter."""
    f = feature_table(spark, sf_dir)
    cfg = M.infer_dims(f, M.AEConfig(learning_rate=STEP_RATE))
    vec = M.rule_params(cfg, FIXED_WEIGHT_SEED)
    grad, new = M.full_step(f, vec, cfg)
    return spark.createDataFrame([(i, float(g), float(w)) for i, (g, w) in enumerate(zip(grad, new))],
                                 "param long, gradient double, weight double")


def train_step_unconditional(spark, sf_dir):
    """M9: the same step without conditions."""
    f = M.without_conditions(feature_table(spark, sf_dir))
    cfg = M.infer_dims(f, M.AEConfig(learning_rate=STEP_RATE))
    vec = M.rule_params(cfg, FIXED_WEIGHT_SEED)
    grad, new = M.full_step(f, vec, cfg)
    return spark.createDataFrame([(i, float(g), float(w)) for i, (g, w) in enumerate(zip(grad, new))],
                                 "param long, gradient double, weight double")


def train_rounds_fixed(spark, sf_dir):
    """M4: two synchronous minibatch steps (one epoch of two rounds) from the rule
    weights; the weights after them."""
    f = feature_table(spark, sf_dir)
    cfg = M.infer_dims(f, M.AEConfig(learning_rate=STEP_RATE, max_rounds=2, shard_rows=512))
    table, cfg = M.prepare_training_table(f, cfg, checkpoint=False)
    try:
        vec, _, _ = M.sync_epoch(table.where(~F.col("is_val")), M.rule_params(cfg, FIXED_WEIGHT_SEED),
                                 M.Adam(M.n_params(cfg)), cfg, cfg.learning_rate)
    finally:
        table.unpersist()
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(vec)], "param long, weight double")


def schedule_trace(spark, sf_dir):
    """M5 over the monthly mean of the daily maximum temperature, as if it were
    the loss of an epoch per month."""
    cfg = M.AEConfig(lr_patience=O.TRACE_LR_PATIENCE, patience=O.TRACE_PATIENCE)
    month = F.substring("time", 1, 7).alias("month")
    losses = src(spark, sf_dir).weather_daily.groupBy(month).agg(F.avg(F.col("temperatureMax") + 50).alias("loss"))
    return M.schedule_trace(losses, "month", "loss", cfg)


def hourly_quantiles(spark, sf_dir):
    """Exact quantiles of the hourly energy by (year, hour), by selection."""
    long = P.hourly_long(src(spark, sf_dir).half_hourly).where(F.col("energy").isNotNull())
    out = exact_quantiles(long, "energy", O.QUANTILES, ["year", "hour"], total="n")
    return out.select("year", "hour", "n", *[F.col("quantiles")[i].alias(f"q{round(p * 100):02d}") for i, p in enumerate(O.QUANTILES)])


def hourly_patterns_refreshed(spark, sf_dir):
    """A1 from stored cells of an older state, in which the first household had
    other readings: its old rows are retracted, its new ones added."""
    now = src(spark, sf_dir).half_hourly
    first = F.col("LCLid") == now.select(F.min("LCLid")).scalar()
    was = now.withColumns({f"hh_{i}": F.when(first, F.col(f"hh_{i}") * 2 + 1).otherwise(F.col(f"hh_{i}")) for i in range(48)})
    cells = store(spark, sf_dir).materialize("hourly_cells_before", lambda: P.hourly_cells(was), memory=False)
    return P.hourly_patterns(P.merge_cells(cells, P.hourly_cells(now.where(first)), P.hourly_cells(was.where(first))))


household_numbers = stored("household_numbers", lambda spark, sf_dir: DI.numbered(src(spark, sf_dir).households, ["Acorn_grouped"]))
household_bitmaps = stored("household_bitmaps", lambda spark, sf_dir: DI.household_bitmaps(
    src(spark, sf_dir).daily, household_numbers(spark, sf_dir), ["Acorn_grouped"], src(spark, sf_dir).bound("households")))


def households_by_year(spark, sf_dir):
    """Distinct households per year and group, from stored bitmaps."""
    return DI.distinct_households(household_bitmaps(spark, sf_dir), F.year("_d").alias("year"), "Acorn_grouped")


def _csv_copy(spark, sf_dir, *names: str) -> str:
    """The named sources (all by default) in the CSV layout, each written once per
    source state."""
    s = src(spark, sf_dir)
    root = f"{store(spark, sf_dir).root}/csv"
    todo = [n for n in names or C.LAYOUT if not path_exists(spark, f"{root}/made/{n}/_SUCCESS")]
    if todo:
        s.ready(*todo)
        tables = {n: s.tables[n].select(*SOURCE_SCHEMAS[n].fieldNames()) for n in todo}
        if "half_hourly" in tables:
            tables["half_hourly"] = tables["half_hourly"].repartition(8, "LCLid")    # a household's history in one file
        C.write_sources_csv(tables, root)
        for n in todo:
            spark.range(1).write.mode("overwrite").parquet(f"{root}/made/{n}")
    return root


def _slot_totals(slots: list[Column]) -> list[Column]:
    """Readings that are there, and their sum from the first to the last, as plain
    expressions (lambdas over an array are interpreted per reading)."""
    n = reduce(lambda a, x: a + x.isNotNull().cast("int"), slots, F.lit(0))
    return [n.alias("n"), reduce(lambda a, x: a + F.coalesce(x, F.lit(0.0)), slots, F.lit(0.0)).alias("total")]


def ledger_rows(spark, sf_dir):
    """The half-hourly rows from block files kept by a ledger, which
    first sees half of the files and then all of them."""
    root = _csv_copy(spark, sf_dir, "half_hourly")
    where, home = f"{root}/{C.LAYOUT['half_hourly']}", f"{store(spark, sf_dir).root}/ledger"
    if not path_exists(spark, home):
        Ledger(spark, home, where, HALF_HOURLY, "part-0000[0-3]*.csv").refresh(strict=True)
    ledger = Ledger(spark, home, where, HALF_HOURLY)
    ledger.refresh(strict=True)
    return ledger.table().select("LCLid", "day", "year", *_slot_totals([F.col(f"hh_{i}") for i in range(48)]))


def csv_households(spark, sf_dir):
    """The households read from their CSV file."""
    return C.read_sources(spark, _csv_copy(spark, sf_dir))["households"]


def split_counts(spark, sf_dir):
    """M1: rows and days of the training and the validation part."""
    cfg = M.AEConfig()
    return (feature_table(spark, sf_dir).groupBy(M.split_flag(cfg.seed, cfg.val_fraction).alias("is_val"))
            .agg(F.count("*").alias("rows"), F.count_distinct("day").alias("days")))


def latent_codes(spark, sf_dir):
    """M3: the latent code of every household-day under the rule weights."""
    f = feature_table(spark, sf_dir)
    cfg = M.infer_dims(f, M.AEConfig())
    z = M.encode_column(f, M.rule_params(cfg, FIXED_WEIGHT_SEED), cfg)
    return z.select("LCLid", "day", F.col("code")[0].alias("z0"), F.col("code")[1].alias("z1"))


def _train(spark, sf_dir, unconditional: bool):
    f = feature_table(spark, sf_dir)          # stored Parquet: lineage already cut
    if unconditional:
        f = M.without_conditions(f)
    _, _, history = M.train(f, M.AEConfig(), checkpoint=False)
    return M.history_frame(spark, history)


def train_autoencoder(spark, sf_dir):
    return _train(spark, sf_dir, False)


def train_autoencoder_unconditional(spark, sf_dir):
    return _train(spark, sf_dir, True)


#: rows of an inbox file: with the files of a trigger, they bound the rows that
#: a trigger holds (400 bytes each), whatever the input
INBOX_ROWS = 1_000_000


def stream_anomaly_slots(spark, sf_dir):
    """The streaming form of ``anomaly_slots``: all half-hourly rows arrive as
    CSV block files in an inbox, are read by ``readStream`` (several files a
    trigger), checked against the household-days already scored, selected by
    group and years, joined, encoded with the spec frozen from the stored
    profiles and scored; the sink's rows are returned."""
    s = src(spark, sf_dir).ready("half_hourly", "households", "holidays", "weather_daily")
    base = f"{store(spark, sf_dir).root}/stream_{_TAG}"
    inbox = f"{base}/inbox"                    # deterministic per source fingerprint
    if not path_exists(spark, f"{inbox}/_SUCCESS"):
        (s.half_hourly.select(*HALF_HOURLY.fieldNames())
         .write.mode("overwrite").option("header", True).option("maxRecordsPerFile", INBOX_ROWS).csv(inbox))
    disk_state(spark)
    sink = f"{base}/runs/{uuid.uuid4().hex}"    # fresh checkpoint and sink per run
    spec = FE.fit_spec(profiles(spark, sf_dir))
    cfg = M.AEConfig(input_dim=spec.length, cond_dim=FE.COND_DIM)
    score = ST.batch_scorer(s.households, s.holidays, s.weather_daily, O.PROFILE_GROUP, O.PROFILE_YEARS, spec,
                            M.rule_params(cfg, FIXED_WEIGHT_SEED), cfg, ANOMALY_THRESHOLD,
                            households_rows=s.bound("households"), holiday_rows=s.bound("holidays"),
                            weather_rows=s.bound("weather_daily"))
    query = ST.start(ST.block_stream(spark, inbox, max_files_per_trigger=16), score, f"{sink}/out", f"{sink}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"streaming query failed: {query.exception()}")
    return ST.read_scores(spark, f"{sink}/out")


RAW: dict[str, Builder] = {
    "hourly_patterns": hourly,
    "daily_patterns": daily,
    "weekly_patterns": weekly,
    "seasonal_patterns": seasonal,
    "weekday_vs_weekend": weekend,
    "household_patterns": household,
    "temperature_energy": temperature,
    "temperature_hourly": temperature_hourly,
    "filtered_projection": filtered_projection,
    "segment_points": segment_points,
    "segment_points_one_tariff": second(lambda d: SG.segment_points(SG.filter_segments(
        d, [O.ONE_TARIFF], O.FILTER_ACORNS)), household),
    "ordered_hourly": second(lambda d: placed(P.sorted_result(d, "year", "hour"), "year", "hour"), hourly),
    "ordered_ranking": second(lambda d: placed(SG.acorn_ranking(d), "Acorn_grouped"), household),
    "yearly_view": second(lambda d: V.yearly_view(d, "hour", "energy_mean", sort_by=["year", "hour"]), hourly),
    "aggregated_view_hourly": second(lambda d: V.aggregated_view(d, "hour", "energy_mean", sort_by="hour"), hourly),
    "aggregated_view_daily": second(lambda d: V.aggregated_view(
        d, "weekday", "energy_mean", ["weekday", "weekday_name"], "weekday"), daily),
    "aggregated_view_weekly": second(lambda d: V.aggregated_view(d, "week", "energy_mean", sort_by="week"), weekly),
    "aggregated_view_seasonal": second(lambda d: V.aggregated_view(
        d, "week", "energy_mean", ["season", "week"], ["season", "week"]), seasonal),
    "bar_view_seasonal": second(lambda d: V.bar_view(d, "energy_mean", ["year", "season"]), seasonal),
    "bar_view_weekend": second(lambda d: V.bar_view(d, "energy_mean", ["year", "is_weekend"]), weekend),
    "tariff_overall": second(SG.tariff_overall, household),
    "acorn_ranking": second(SG.acorn_ranking, household),
    "segment_kpis": second(SG.segment_kpis, household),
    "consumer_groups_2": second(lambda d: SG.consumer_groups(d, "energy_mean", 2), household),
    "consumer_groups_3": second(lambda d: SG.consumer_groups(d, "energy_mean", 3), household),
    "consumer_groups_4": second(lambda d: SG.consumer_groups(d, "energy_mean", 4), household),
    "consumer_groups_5": second(lambda d: SG.consumer_groups(d, "energy_mean", 5), household),
    "metrics_long": second(lambda d: SG.metrics_long(SG.consumer_groups(d, "energy_mean", 3)), household),
    "consumer_group_mix": second(lambda d: SG.consumer_group_mix(d, "energy_mean", 3), household),
    "segment_hierarchy": second(SG.segment_hierarchy, household),
    "temp_bin_summary": second(WX.temp_bin_summary, temperature),
    "temp_box": second(WX.temp_box, temperature),
    "temp_histogram": second(WX.temp_histogram, temperature),
    "hour_temp_pivot": second(WX.hour_temp_pivot, temperature_hourly),
    "peak_hour": second(WX.peak_hour, temperature_hourly),
    "humidity_corr": second(WX.humidity_corr, temperature_hourly),
    "weather_kpis": second(WX.weather_kpis, temperature_hourly),
    "distinct_filters": distinct_filters,
    "acorn_profiles": second(_profile_rows, profiles),
    "acorn_profiles_strict": second(_profile_rows, profile_table(O.PROFILE_GROUP, O.PROFILE_YEARS, strict=True)),
    "acorn_profiles_aligned": second(_profile_rows, profile_table(O.PROFILE_GROUP, O.PROFILE_YEARS, align=True)),
    "acorn_profiles_inner": second(_profile_rows, profile_table(O.INNER_GROUP, O.INNER_YEARS)),
    "group_files": group_files,
    "features": features,
    "reconstruction_fixed": reconstruction_fixed,
    "anomaly_slots": anomaly_slots,
    "reconstruction_error": reconstruction_error,
    "stream_anomaly_slots": stream_anomaly_slots,
    "reconstruction_by_group": reconstruction_by_group,
    "hourly_quantiles": hourly_quantiles,
    "hourly_patterns_continuous": lambda spark, sf_dir: P.hourly_patterns(src(spark, sf_dir).half_hourly, continuous=True),
    "hourly_patterns_refreshed": hourly_patterns_refreshed,
    "consumer_groups_3_continuous": second(lambda d: SG.consumer_groups(d, "energy_mean", 3, continuous=True), household),
    "temp_box_continuous": second(lambda d: WX.temp_box(d, continuous=True), temperature),
    "ordered_mix": second(lambda d: placed(SG.consumer_group_mix(d, "energy_mean", 3), "quantile_group", "Acorn_grouped"), household),
    "ordered_bins": second(lambda d: placed(WX.temp_bin_summary(d), "temp_bin"), temperature),
    "temp_bin_known": second(lambda d: WX.temp_bin_summary(d.withColumn(
        "temp_bin", F.when(F.col("month") % 3 == 0, "unheard of").otherwise(F.col("temp_bin")))), temperature),
    "households_by_year": households_by_year,
    "ledger_rows": ledger_rows,
    "csv_households": csv_households,
    "list_codec": list_codec,
    "weekend_text": weekend_text,
    "train_step_fixed": train_step_fixed,
    "train_step_unconditional": train_step_unconditional,
    "train_rounds_fixed": train_rounds_fixed,
    "schedule_trace": schedule_trace,
    "split_counts": split_counts,
    "latent_codes": latent_codes,
    "train_autoencoder": train_autoencoder,
    "train_autoencoder_unconditional": train_autoencoder_unconditional,
}


def queries() -> dict[str, Builder]:
    def wrap(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return contract(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        return run
    return {k: wrap(v) for k, v in RAW.items()}
