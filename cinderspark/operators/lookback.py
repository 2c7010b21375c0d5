"""Look-back windows over daily series.

A series is a table ``(key, day, values...)`` with at most one row per key and day.

Windows. Every day that counts has at least ``daily_min``, so at most ``ceil(cum_min / daily_min)`` wet
days are ever added up, and they are the newest ones before the date. So each distinct (key, date) is
put between the wet days of its key and looks at that many of them: one shuffle by key, one sort. A key
has at most one row per wet day and one per distinct date, however many points share it.

Values. A series is packed into one row per key and block of ``max_days`` days: a dense array over the
days of the block and of the block before it. A window that ends in a block and is at most ``max_days``
long is a slice of that array, so it takes one equi-join on (key, block) whatever its length, and no row
is multiplied by days.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderspark.functions.calendar import day_number
from cinderspark.operators.skew import lookup
from cinderspark.params import Lookback

RAIN = Lookback()

# Longest run of wet days that is looked at through lags; above it, windows are cut from packed arrays.
MAX_LAGS = 32


def block_of(day: Column, max_days: int) -> Column:
    return F.floor(day_number(day) / F.lit(max_days)).cast("int")


def pack_series(series: DataFrame, key: list[str], day: str, values: list[str], max_days: int, name: str = "obs") -> DataFrame:
    """(key, _block, name): ``name`` holds a struct of the values, or NULL, for each of the 2 * max_days
    days that end with the last day of the block."""
    own = block_of(F.col(day), max_days)
    listed = (
        series.select(*key, F.col(day), F.struct(*values).alias("_v"))
        .withColumn("_block", F.explode(F.array(own, own + 1)))
        .groupBy(*key, "_block")
        .agg(F.map_from_entries(F.collect_list(F.struct(day_number(F.col(day)).alias("d"), "_v"))).alias("_by_day"))
    )
    days = F.sequence((F.col("_block") - 1) * max_days, (F.col("_block") + 1) * max_days - 1)
    # The one-element array binds the map to a variable, so that it is built once and not once per day.
    dense = F.transform(F.array("_by_day"), lambda by_day: F.transform(days, lambda d: F.element_at(by_day, d)))
    return listed.select(*key, "_block", dense[0].alias(name))


def _checked(windows: DataFrame, start: Column, end: Column, max_days: int) -> DataFrame:
    """Fail loudly on a window longer than a packed row can serve."""
    too_long = F.datediff(end, start) > max_days
    stop = F.raise_error(F.lit("window longer than max_days")).cast("int")
    return windows.withColumn("_block", F.when(too_long, stop).otherwise(block_of(end, max_days)))


def attach_observations(
    windows: DataFrame,
    series: DataFrame,
    key: list[str],
    day: str,
    values: list[str],
    name: str,
    max_days: int = RAIN.max_days,
    start: Column | str = "dtw_start",
    end: Column | str = "dtw_end",
) -> DataFrame:
    """Add array ``name``: a struct of the values, or NULL, for each day from start to end."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    packed = pack_series(series, key, day, values, max_days, name)
    first = day_number(start) - (F.col("_block") - 1) * max_days + 1
    length = F.datediff(end, start) + 1
    nothing = F.array_repeat(F.lit(None).cast(packed.schema[name].dataType.elementType), length)
    return (
        _checked(windows, start, end, max_days)
        .join(packed, [*key, "_block"], "left")
        .withColumn(name, F.coalesce(F.slice(name, first, length), nothing))
        .drop("_block")
    )


def _window_columns(df: DataFrame, hit: Column, date: str, p: Lookback) -> DataFrame:
    return (
        df.withColumn("dtw_start", F.coalesce(F.date_add(hit, 1), F.date_sub(F.col(date), p.max_days)))
        .withColumn("dtw_end", F.col(date))
        .withColumn("dtw_length", F.datediff("dtw_end", "dtw_start"))
    )


def _hit_by_lags(todo: DataFrame, wet: DataFrame, key: list[str], date: str, steps: int, p: Lookback) -> DataFrame:
    """Place each date between the wet days of its key and add up the newest ``steps`` of them."""
    of_dates = todo.select(*key, F.col(date).alias("_day"), F.lit(0).alias("_kind"), F.lit(None).cast("struct<day:date,mm:double>").alias("_wet"))
    of_rain = wet.select(*key, F.col("day").alias("_day"), F.lit(1).alias("_kind"), F.struct("day", "mm").alias("_wet"))
    order = f"PARTITION BY {', '.join(f'`{k}`' for k in key)} ORDER BY _day, _kind"
    seen = [F.expr(f"lag(_wet, {i}) IGNORE NULLS OVER ({order})").alias(f"_w{i}") for i in range(1, steps + 1)]
    placed = of_dates.unionByName(of_rain).select("*", *seen).where("_kind = 0")
    total, cases = F.lit(0.0), []
    for i in range(1, steps + 1):
        total = total + F.col(f"_w{i}.mm")
        reached = (total >= p.cum_min) & (F.col(f"_w{i}.day") >= F.date_sub("_day", p.max_days))
        cases.append(F.when(reached, F.col(f"_w{i}.day")))
    return placed.select(*key, F.col("_day").alias(date), F.coalesce(*cases).alias("_hit"))


def _hit_by_walk(todo: DataFrame, wet: DataFrame, key: list[str], date: str, p: Lookback) -> DataFrame:
    """Fold each window's days newest first; for daily thresholds so low that any day may count."""
    last = F.date_sub(F.col(date), 1)
    seen = attach_observations(todo, wet, key, "day", ["day", "mm"], "_obs", p.max_days, F.date_sub(F.col(date), p.max_days), last)
    begin = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("date").alias("hit"))

    def step(acc: Column, o: Column) -> Column:
        total = acc["total"] + F.coalesce(o["mm"], F.lit(0.0))
        reached = o["mm"].isNotNull() & (total >= p.cum_min)
        return F.struct(total.alias("total"), F.coalesce(acc["hit"], F.when(reached, o["day"])).alias("hit"))

    return seen.select(*key, date, F.aggregate(F.reverse("_obs"), begin, step, lambda acc: acc["hit"]).alias("_hit"))


def window_per_key(
    dates: DataFrame, series: DataFrame, key: list[str], date: str, day: str, value: str, p: Lookback = RAIN
) -> DataFrame:
    """Look-back window of each distinct (key, date). Days below the daily threshold add nothing to the
    walk, so they are filtered at the scan."""
    wet = series.where(F.col(value) >= p.daily_min).select(*key, F.col(day).alias("day"), F.col(value).cast("double").alias("mm"))
    todo = dates.select(*key, date).where(F.col(date).isNotNull()).distinct()
    # One day more than divides out, as sums of decimal fractions may stay just below the threshold.
    steps = max(1, math.ceil(p.cum_min / p.daily_min)) + 1 if p.daily_min > 0 else MAX_LAGS + 1
    if steps <= MAX_LAGS:
        hits = _hit_by_lags(todo, wet, key, date, steps, p)
    else:
        hits = _hit_by_walk(todo, wet, key, date, p)
    return _window_columns(hits, F.col("_hit"), date, p).drop("_hit")


def backward_threshold_window(
    anchors: DataFrame,
    series: DataFrame,
    key: str | list[str],
    day: str,
    value: str,
    daily_min: float = RAIN.daily_min,
    cum_min: float = RAIN.cum_min,
    max_days: int = RAIN.max_days,
    date: str = "date",
) -> DataFrame:
    """Add dtw_start, dtw_end and dtw_length to anchors; anchors without a date are dropped."""
    keys = [key] if isinstance(key, str) else key
    p = Lookback(daily_min=daily_min, cum_min=cum_min, max_days=max_days)
    dated = anchors.where(F.col(date).isNotNull())
    return lookup(dated, window_per_key(dated, series, keys, date, day, value, p), [*keys, date])


def with_fallback(
    anchors: DataFrame, windows: DataFrame, key: list[str], date: str = "date", days: int | Column = RAIN.fallback_days
) -> DataFrame:
    """Attach windows; anchors that have none get a window of ``days`` before their date."""
    joined = lookup(anchors, windows.select(*key, date, "dtw_start"), [*key, date])
    start = F.coalesce(F.col("dtw_start"), F.date_sub(F.col(date), days if isinstance(days, Column) else F.lit(days)))
    return (
        joined.withColumn("dtw_start", start)
        .withColumn("dtw_end", F.col(date))
        .withColumn("dtw_length", F.datediff(F.col("dtw_end"), F.col("dtw_start")))
    )


def daily_arrays(
    windows: DataFrame,
    series: DataFrame,
    key: list[str],
    day: str,
    values: list[str],
    step_days: int = 1,
    fill: float | None = None,
    max_days: int = RAIN.max_days,
    start: str = "dtw_start",
    end: str = "dtw_end",
) -> DataFrame:
    """Add ``days``: one (day, values...) struct per day of the window, every ``step_days`` from its
    start; gaps are NULL or ``fill``."""
    seen = attach_observations(windows, series, key, day, values, "_obs", max_days, start, end)
    calendar = F.sequence(F.col(start), F.col(end), F.make_interval(days=F.lit(step_days)))
    kept = F.col("_obs") if step_days == 1 else F.filter("_obs", lambda _, i: i % step_days == 0)
    columns = [F.col("_kept")[v] for v in values]
    if fill is not None:
        columns = [F.transform(c, lambda x: F.coalesce(x, F.lit(fill))) for c in columns]
    zipped = F.arrays_zip(calendar.alias(day), *[c.alias(v) for c, v in zip(columns, values)])
    element = ", ".join([f"`{day}`: date", *[f"`{v}`: double" for v in values]])
    return (
        seen.withColumn("_kept", kept)
        .withColumn("days", zipped.cast(f"array<struct<{element}>>"))
        .drop("_obs", "_kept")
    )


def daily_values(points: DataFrame, arrays: DataFrame, on: list[str]) -> DataFrame:
    """One row per point and day. ``arrays`` comes from ``daily_arrays`` on the windows of the distinct
    ``on`` values; points meet it last, so a hot cell is read and joined once."""
    return lookup(points, arrays.select(*on, "days"), on).select(*points.columns, F.inline("days"))


def window_report(windows: DataFrame, series: DataFrame, key: list[str], day: str, value: str, p: Lookback = RAIN) -> DataFrame:
    """Totals, wettest day, wet days, length, thresholds and the dense daily series of each window."""
    dense = daily_arrays(windows, series, key, day, [value], fill=0.0, max_days=p.max_days)
    return dense.withColumn("_mm", F.col("days")[value]).select(
        *windows.columns,
        F.datediff("dtw_end", "dtw_start").alias("window_length_days"),
        F.aggregate("_mm", F.lit(0.0), lambda a, x: a + x).alias("total_mm"),
        F.array_max("_mm").alias("max_daily_mm"),
        F.size(F.filter("_mm", lambda x: x >= p.daily_min)).alias("wet_days"),
        F.lit(p.cum_min).alias("cum_min"),
        F.lit(p.daily_min).alias("daily_min"),
        F.lit(p.max_days).alias("max_days"),
        F.map_from_entries("days").alias("series"),
    )
