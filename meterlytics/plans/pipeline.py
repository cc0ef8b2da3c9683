"""Read-through getters and the training pipeline for a group and a year range
(S10-S12, M8) over any ``Sources`` (catalog or CSV layout) and ``ResultStore``.

The store's root should carry the fingerprint of the sources; every argument
that changes a table is part of its stored name, so a table is built once per
source state and read from the store afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators import features as FE
from ..operators import model as M
from ..operators import profiles as PR
from ..session import ship_package
from ..sources.catalog import Sources
from ..sources.store import ResultStore


def profile_tag(group: str, years: tuple[int, int], strict: bool = False, align: bool = False) -> str:
    """Stored name of a profile table: every argument that changes its rows."""
    return f"{group}_{years[0]}_{years[1]}{'_strict' if strict else ''}{'_aligned' if align else ''}"


def acorn_profiles(sources: Sources, store: ResultStore, group: str, years: tuple[int, int],
                   strict: bool = False, align: bool = False, refresh: bool = False) -> DataFrame:
    """The profile rows of a group and year range."""
    def build() -> DataFrame:
        sources.ready("half_hourly", "households", "holidays", "weather_daily")
        return PR.daily_profiles(
            sources.half_hourly, sources.households, sources.holidays, sources.weather_daily, group, years,
            strict=strict, align=align, households_rows=sources.bound("households"),
            holiday_rows=sources.bound("holidays"), weather_rows=sources.bound("weather_daily"))
    return store.materialize(f"profiles_{profile_tag(group, years, strict, align)}", build, refresh=refresh, memory=False)


def feature_table(sources: Sources, store: ResultStore, group: str, years: tuple[int, int],
                  strict: bool = False, align: bool = False, refresh: bool = False) -> DataFrame:
    """Reading and condition vectors of a group and year range, built from
    the stored profiles (its global statistics scan Parquet)."""
    def build() -> DataFrame:
        return FE.build_features(acorn_profiles(sources, store, group, years, strict, align, refresh))
    return store.materialize(f"features_{profile_tag(group, years, strict, align)}", build, refresh=refresh, memory=False)


@dataclass
class PipelineResult:
    params: np.ndarray
    config: M.AEConfig
    history: list[dict]        # empty when a stored model was used
    scored: DataFrame          # readings and reconstructions
    mse: float
    model: str                 # where the model is stored


def run_pipeline(spark: SparkSession, sources: Sources, store: ResultStore, group: str, years: tuple[int, int],
                 cfg: M.AEConfig = M.AEConfig(), force_retrain: bool = False) -> PipelineResult:
    """Load data, load or train the model of (group, years, code size), score."""
    ship_package(spark)
    features = feature_table(sources, store, group, years)
    path = M.model_path(f"{store.root}/models", group, years, cfg)
    meta = {"acorn_group": group, "selected_years": str(years)}
    params, used, history, scored, mse = M.train_or_load(spark, features, path, cfg, meta, force_retrain)
    return PipelineResult(params, used, history, scored, float(mse), path)
