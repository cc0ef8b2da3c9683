"""SQL text shared by the DuckDB oracle: fixture CTEs and small generators.

The CTEs are the derivations of FIXTURES.md §3, run by DuckDB over the
driver's pre-registered ``customer`` / ``orders`` / ``lineitem`` views. The
Spark side builds the same tables with the DataFrame API
(``sources.fixtures``).
"""

from __future__ import annotations

from ..schemas import MONTH_NAMES, N_HOURS, N_SLOTS, TEMP_BIN_UPPER, TEMP_BINS, WEEKDAY_NAMES


def _hh_column(i: int) -> str:
    evening = " + 48" if 34 <= i <= 41 else ""
    return (f"CASE WHEN (k + {3 * i}) % 29 = 0 THEN NULL "
            f"ELSE CAST((k * 31 + {17 * i}) % 64{evening} AS DOUBLE) / CAST(64 AS DOUBLE) END AS hh_{i}")


FIXTURE_CTES = {
    "households": """
SELECT 'MAC' || CASE WHEN c_custkey > 999999 THEN CAST(c_custkey AS STRING) ELSE lpad(CAST(c_custkey AS STRING), 6, '0') END AS LCLid,
       CASE WHEN c_custkey % 5 = 0 THEN 'ToU' ELSE 'Std' END AS stdorToU,
       'ACORN-' || chr(CAST(65 + c_nationkey % 17 AS INT)) AS Acorn,
       CASE WHEN c_nationkey % 17 < 5 THEN 'Affluent'
            WHEN c_nationkey % 17 < 10 THEN 'Comfortable' ELSE 'Adversity' END AS Acorn_grouped,
       'block_' || CAST(CAST(floor(c_custkey / 50) AS BIGINT) AS STRING) ||
       CASE WHEN c_nationkey % 17 >= 10 AND CAST(floor(c_custkey / 50) AS BIGINT) % 3 = 0 THEN 'a' ELSE '' END AS file
FROM customer""",
    "hd": """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS k
FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    "half_hourly": (
        "\nSELECT 'MAC' || CASE WHEN o_custkey > 999999 THEN CAST(o_custkey AS STRING) ELSE lpad(CAST(o_custkey AS STRING), 6, '0') END AS LCLid, CAST(d AS STRING) AS day,\n       "
        + ",\n       ".join(_hh_column(i) for i in range(N_SLOTS))
        + "\nFROM hd"),
    "daily": """
SELECT 'MAC' || CASE WHEN o_custkey > 999999 THEN CAST(o_custkey AS STRING) ELSE lpad(CAST(o_custkey AS STRING), 6, '0') END AS LCLid,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS day,
       median(l_quantity) AS energy_median, avg(l_quantity) AS energy_mean, max(l_quantity) AS energy_max,
       count(l_quantity) AS energy_count, round(stddev_samp(l_quantity), 6) AS energy_std,
       sum(l_quantity) AS energy_sum, min(l_quantity) AS energy_min
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    "dates": """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders""",
    "weather_daily": """
SELECT CAST(d AS STRING) || ' 00:00:00' AS time,
       CASE WHEN dayofyear(d) % 50 = 0 THEN NULL ELSE CAST((dayofyear(d) * 7 + year(d)) % 34 - 6 AS DOUBLE) END AS temperatureMin,
       CAST((dayofyear(d) * 7 + year(d)) % 34 - 6 + dayofyear(d) % 9 AS DOUBLE) AS temperatureMax,
       CAST((dayofyear(d) * 13) % 60 + 40 AS DOUBLE) / CAST(128 AS DOUBLE) AS humidity
FROM dates
UNION ALL
SELECT CAST(d AS STRING) || ' 12:00:00', CAST(10 AS DOUBLE), CAST(14 AS DOUBLE), CAST(0.5 AS DOUBLE)
FROM dates WHERE dayofyear(d) % 97 = 0""",
    "hours": """
SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16),(17),(18),(19),(20),(21),(22),(23)) AS v(h)""",
    "weather_hourly": """
SELECT CAST(d AS STRING) || ' ' || lpad(CAST(h AS STRING), 2, '0') || ':00:00' AS time,
       CASE WHEN (dayofyear(d) + h) % 41 = 0 THEN NULL ELSE CAST((dayofyear(d) * 7 + year(d)) % 34 - 6 + h % 12 AS DOUBLE) END AS temperature,
       CAST((dayofyear(d) * 13 + h * 5) % 60 + 40 AS DOUBLE) / CAST(128 AS DOUBLE) AS humidity
FROM dates CROSS JOIN hours""",
    "holidays": """
SELECT CAST(d AS STRING) AS holiday FROM dates
WHERE (month(d) = 1 AND day(d) = 1) OR (month(d) = 12 AND day(d) IN (25, 26)) OR (month(d) = 5 AND day(d) = 1)""",
}


def with_ctes(extra: list[tuple[str, str]], final: str) -> str:
    """``WITH <fixtures>, <extra> <final>``; DuckDB drops unreferenced CTEs."""
    parts = [f"{name} AS ({body}\n)" for name, body in FIXTURE_CTES.items()]
    parts += [f"{name} AS (\n{body}\n)" for name, body in extra]
    return "WITH " + ",\n".join(parts) + "\n" + final


def case_list(expr: str, values: list[str], base: int = 1) -> str:
    """``CASE expr WHEN base THEN values[0] ... END``."""
    whens = " ".join(f"WHEN {base + i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def weekday_name_sql(expr: str) -> str:
    return case_list(expr, WEEKDAY_NAMES)


def month_name_sql(expr: str) -> str:
    return case_list(expr, MONTH_NAMES)


def temp_bin_sql(expr: str) -> str:
    whens = " ".join(f"WHEN {expr} < {u} THEN '{lab}'" for u, lab in zip(TEMP_BIN_UPPER, TEMP_BINS))
    return f"CASE {whens} ELSE '{TEMP_BINS[-1]}' END"


def hourly_long_sql(source: str = "half_hourly", key_sql: str = "day") -> str:
    """The 24-way unpivot of hourly energy, as UNION ALL."""
    return "\nUNION ALL\n".join(
        f"SELECT {key_sql} AS k, {h} AS hour, coalesce(hh_{2 * h}, 0) + coalesce(hh_{2 * h + 1}, 0) AS energy FROM {source}"
        for h in range(N_HOURS))


S7_ROLLUP = """avg(energy_median) AS energy_median, avg(energy_mean) AS energy_mean,
       max(energy_max) AS energy_max, CAST(coalesce(sum(energy_count), 0) AS BIGINT) AS energy_count,
       avg(energy_std) AS energy_std, CAST(coalesce(sum(energy_sum), 0) AS DOUBLE) AS energy_sum,
       min(energy_min) AS energy_min"""


def rounded(inner: str, columns: list[tuple[str, str]]) -> str:
    """Outer projection fixing types: ``d`` double rounded to 9 places,
    ``i`` INTEGER, ``l`` BIGINT, anything else as is."""
    sel = []
    for name, kind in columns:
        q = f'"{name}"'
        if kind == "d":
            sel.append(f"round(CAST({q} AS DOUBLE), 9) AS {q}")
        elif kind == "i":
            sel.append(f"CAST({q} AS INTEGER) AS {q}")
        elif kind == "l":
            sel.append(f"CAST({q} AS BIGINT) AS {q}")
        else:
            sel.append(q)
    return f"SELECT {', '.join(sel)} FROM (\n{inner}\n) AS q"
