"""Named getters with ``years`` / ``cols`` (S9) over materialised results.

The Spark form of the reference's storage object: each pattern result is
built once over all years (S7 read-through), then filtered by year (F1) and
projected (P1) per call. Callers that want the filter pushed to the scan
instead call ``operators.patterns`` with ``years=`` directly.

Over sources kept by a ledger (``Sources.marks``) results follow the files by
part: the scans of A1-A5 and A7 are kept as mergeable state per year
(``materialize_parts``), of which only the years whose files changed are
computed again, and a result's stored name carries the state it came from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import PARTITION_YEAR
from ..operators import patterns as P
from ..sources.catalog import Sources
from ..sources.store import ResultStore


class PatternStorage:
    def __init__(self, sources: Sources, store: ResultStore):
        self.s = sources
        self.store = store

    def _get(self, name: str, build, years, cols, refresh: bool = False) -> DataFrame:
        if self.s.marks:
            state = hashlib.sha1(repr(sorted((t, sorted(m.items(), key=repr)) for t, m in self.s.marks.items())).encode()).hexdigest()[:16]
            kept, name = name, f"{name}@{state}"
            for old in self.store.list():
                if old.startswith(f"{kept}@") and old != name:
                    self.store.remove(old)
        df = self.store.materialize(name, build, refresh=refresh)
        return P.finish(df, years, cols)

    def _by_year(self, table: str, name: str, state) -> DataFrame:
        """Mergeable state of a fact table, kept per year; ``state`` computes
        it, with a ``year`` column, for rows of some years."""
        rows = self.s.tables[table]

        def build(years: list[int | None]) -> DataFrame:
            known = [y for y in years if y is not None]
            some = F.col(PARTITION_YEAR).isin(known) if known else F.lit(False)
            if None in years:
                some = some | F.col(PARTITION_YEAR).isNull()
            return state(rows.where(some))
        return self.store.materialize_parts(name, self.s.marks[table], build, PARTITION_YEAR)

    def _half_hourly(self) -> DataFrame:
        """What A1 reads: the table, or its cells where a ledger keeps it."""
        if not self.s.marks:
            return self.s.half_hourly
        return self._by_year("half_hourly", "hourly_cells", P.hourly_cells)

    def _daily(self) -> DataFrame:
        """What A2-A5 and A7 read: the table, or its partial sums per date."""
        if not self.s.marks:
            return self.s.daily
        return self._by_year("daily", "date_partials",
                             lambda d: P.date_partials(d).withColumn(PARTITION_YEAR, F.year("_d")))

    def get_hourly_patterns(self, years: Sequence[int] | None = None, cols=None, refresh=False):
        return self._get("hourly_patterns", lambda: P.hourly_patterns(self._half_hourly()), years, cols, refresh)

    def get_daily_patterns(self, years=None, cols=None, refresh=False):
        return self._get("daily_patterns", lambda: P.daily_patterns(self._daily()), years, cols, refresh)

    def get_weekly_patterns(self, years=None, cols=None, refresh=False):
        return self._get("weekly_patterns", lambda: P.weekly_patterns(self._daily()), years, cols, refresh)

    def get_seasonal_patterns(self, years=None, cols=None, refresh=False):
        return self._get("seasonal_patterns", lambda: P.seasonal_patterns(self._daily()), years, cols, refresh)

    def get_weekday_vs_weekend_patterns(self, years=None, cols=None, refresh=False):
        return self._get("weekday_vs_weekend", lambda: P.weekday_vs_weekend(
            self._daily(), self.s.holidays, holiday_rows=self.s.bound("holidays")), years, cols, refresh)

    def get_temperature_energy_patterns(self, years=None, cols=None, refresh=False):
        return self._get("temperature_energy", lambda: P.temperature_energy(
            self._daily(), self.s.weather_daily, weather_rows=self.s.bound("weather_daily")),
            years, cols, refresh)

    def get_household_patterns(self, cols=None, refresh=False):
        return self._get("household_patterns", lambda: P.household_patterns(
            self.s.daily, self.s.households, households_rows=self.s.bound("households")),
            None, cols, refresh)

    def get_temperature_hourly_patterns(self, cols=None, refresh=False):
        return self._get("temperature_hourly", lambda: P.temperature_hourly(
            self.s.half_hourly, self.s.weather_hourly, weather_rows=self.s.bound("weather_hourly")),
            None, cols, refresh)

    def remove_cache(self, name: str) -> bool:
        return self.store.remove(name)

    def remove_all_caches(self) -> int:
        return self.store.remove_all()

    def get_cached_files(self) -> list[str]:
        return self.store.list()
