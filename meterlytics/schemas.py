"""Source schemas, result column lists and the fixed label values.

Every source is read with an explicit schema (never ``inferSchema``: it would
turn ``day`` into a DATE and make the schema depend on the file).
"""

from __future__ import annotations

from pyspark.sql import types as T

N_SLOTS = 48          # half-hour readings per household-day
N_HOURS = 24

HALF_HOURLY = T.StructType(
    [T.StructField("LCLid", T.StringType(), False),
     T.StructField("day", T.StringType(), False)]
    + [T.StructField(f"hh_{i}", T.DoubleType(), True) for i in range(N_SLOTS)]
)

DAILY = T.StructType([
    T.StructField("LCLid", T.StringType(), False),
    T.StructField("day", T.StringType(), False),
    T.StructField("energy_median", T.DoubleType(), True),
    T.StructField("energy_mean", T.DoubleType(), True),
    T.StructField("energy_max", T.DoubleType(), True),
    T.StructField("energy_count", T.LongType(), True),
    T.StructField("energy_std", T.DoubleType(), True),
    T.StructField("energy_sum", T.DoubleType(), True),
    T.StructField("energy_min", T.DoubleType(), True),
])

HOUSEHOLDS = T.StructType([
    T.StructField("LCLid", T.StringType(), False),
    T.StructField("stdorToU", T.StringType(), True),
    T.StructField("Acorn", T.StringType(), True),
    T.StructField("Acorn_grouped", T.StringType(), True),
    T.StructField("file", T.StringType(), True),
])

# The CSV header of the holiday file is "Bank holidays"; the package renames
# it to ``holiday`` on read.
HOLIDAYS_CSV = T.StructType([T.StructField("Bank holidays", T.StringType(), False)])
HOLIDAYS = T.StructType([T.StructField("holiday", T.StringType(), False)])

WEATHER_DAILY = T.StructType([
    T.StructField("time", T.StringType(), False),
    T.StructField("temperatureMin", T.DoubleType(), True),
    T.StructField("temperatureMax", T.DoubleType(), True),
    T.StructField("humidity", T.DoubleType(), True),
])

WEATHER_HOURLY = T.StructType([
    T.StructField("time", T.StringType(), False),
    T.StructField("temperature", T.DoubleType(), True),
    T.StructField("humidity", T.DoubleType(), True),
])

SOURCE_SCHEMAS = {
    "half_hourly": HALF_HOURLY,
    "daily": DAILY,
    "households": HOUSEHOLDS,
    "holidays": HOLIDAYS,
    "weather_daily": WEATHER_DAILY,
    "weather_hourly": WEATHER_HOURLY,
}

# Seven daily statistics, in result order.
S7 = ["energy_median", "energy_mean", "energy_max", "energy_count",
      "energy_std", "energy_sum", "energy_min"]

# --- fixed values: these labels must equal the reference's output text ---
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                 "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
# Temperature bins in display order; upper bounds (left-closed bins) 0..25.
TEMP_BINS = ["Below 0°C", "0-5°C", "5-10°C", "10-15°C", "15-20°C", "20-25°C",
             "Above 25°C"]
TEMP_BIN_UPPER = [0, 5, 10, 15, 20, 25]
QUANTILE_SCHEMES = {
    2: ([0, 0.5, 1.0], ["Low Consumers", "High Consumers"]),
    3: ([0, 0.33, 0.67, 1.0],
        ["Low Consumers", "Medium Consumers", "High Consumers"]),
    4: ([0, 0.25, 0.5, 0.75, 1.0],
        ["Low Consumers", "Medium-Low Consumers", "Medium-High Consumers",
         "High Consumers"]),
    5: ([0, 0.2, 0.4, 0.6, 0.8, 1.0],
        ["Very Low Consumers", "Low Consumers", "Medium Consumers",
         "High Consumers", "Very High Consumers"]),
}
# --- end of fixed values ---
