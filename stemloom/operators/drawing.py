"""What is done to series before they are drawn: down-sampling to pixels, stacking, ranges, scales and ticks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemloom.operators import series as S


def finite(c: Column) -> Column:
    """A value that counts for ranges: neither null nor NaN nor infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def points_per_pixel(pixels: int, min_step: float = 1.0) -> Column:
    """How many points of a series share a place where there are fewer places than points; else 1."""
    n = (F.col("end") - F.col("start")) / F.col("step")
    return F.when(F.lit(float(pixels)) / n < min_step, F.ceil(F.floor(n) / int(pixels / min_step))).otherwise(1).cast("long")


def to_pixels(df: DataFrame, pixels: int, min_step: float = 1.0) -> DataFrame:
    """Each series consolidated by its own function to at most a point a place."""
    return S.consolidated(df, points_per_pixel(pixels, min_step))


def null_as_zero(df: DataFrame) -> DataFrame:
    return S.with_value(df, F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(0.0)))


def _marked(name: str) -> Column:
    return F.coalesce(F.map_contains_key("options", name), F.lit(False))


def sort_stacked(df: DataFrame) -> DataFrame:
    """Stacked series first, each kind in its order."""
    return S.reorder(df, S.per_series(df, x=F.first(_marked("stacked"))), F.desc("x"))


def stacked_area(df: DataFrame) -> DataFrame:
    """Running totals across all series but those that are drawn to infinity; null points stay null and add nothing."""
    adds = ~_marked("drawAsInfinite")
    w = Window.partitionBy("ts").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(adds, F.col("value"))).over(w)
    d = df.withColumn("_t", F.when(adds & F.col("value").isNotNull(), total).otherwise(F.col("value")))
    more = F.map_concat(F.map_filter("options", lambda k, _: k != "stacked"), F.create_map(F.lit("stacked"), F.lit("true")).cast(S.OPTIONS))
    return S.with_value(d, F.col("_t")).withColumn("options", F.when(adds, more).otherwise(F.col("options"))).select(*S.COLUMNS)


def y_range(df: DataFrame, stacked: bool = False, nulls_as_zero: bool = False, low: float | None = None, high: float | None = None, limit: float | None = None, drawn: bool = True) -> DataFrame:
    """(low, high), one row: of finite values, 0 and 1 where there are none; of a stack up to the largest sum.

    low, high: given ends; limit: no higher than that. The top lies above the bottom by 1 at least where it would not.
    drawn=False gives the ends as they are found: null where there are none, and a top at or below the bottom as it is."""
    seen = df.where(~_marked("drawAsInfinite")).withColumn("value", finite(F.col("value")))
    least = F.min("value")
    if nulls_as_zero:
        least = F.when(F.max(F.col("value").isNull()), F.lit(0.0)).otherwise(least)
    if stacked:
        at = seen.groupBy("ts").agg((F.coalesce(F.sum("value"), F.lit(0.0)) if drawn else F.sum("value")).alias("s"), F.min("value").alias("m"), F.max(F.col("value").isNull()).alias("gap"))
        bottom = F.when(F.max("gap"), F.lit(0.0)).otherwise(F.min("m")) if nulls_as_zero else F.min("m")
        ends = at.agg(bottom.alias("low"), F.max("s").alias("high"))
    else:
        ends = seen.agg(least.alias("low"), F.max("value").alias("high"))
    bottom, top = (F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0))) if drawn else (F.col("low"), F.col("high"))
    top = F.lit(float(high)) if high is not None else top
    top = F.least(top, F.lit(float(limit))) if limit is not None else top
    bottom = F.lit(float(low)) if low is not None else bottom
    if not drawn:
        return ends.select(bottom.alias("low"), top.alias("high"))
    return ends.select(bottom.alias("low"), F.when(top <= bottom, bottom + 1).otherwise(top).alias("high"))


def log_scale(df: DataFrame, base: float) -> DataFrame:
    """Logarithms; null for what is not above zero."""
    return S.with_value(df, F.when(F.col("value") > 0, F.ln("value") / math.log(base)))


UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def x_ticks(spark: SparkSession, start: int, end: int, unit: str, step: int) -> DataFrame:
    """``ts`` of the marks from ``start`` on and before ``end``: multiples of ``step`` units of the minute, hour or day, or midnights."""
    size = UNITS[unit]
    upper = {"second": 60, "minute": 3600, "hour": 86400, "day": 86400}[unit]
    first = start - start % upper + (start % upper // (size * step)) * size * step if unit != "day" else start - start % size
    while first < start:
        first += size * step
    return spark.range(first, max(first, end), size * step).select(F.col("id").alias("ts"))


def jsonp(rows: DataFrame, callback: str) -> DataFrame:
    """One row, ``body``: the list of the rows' json in order, handed to a function. rows: (ord, json), a page of them."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), ", ")
    return rows.agg(F.concat(F.lit(f"{callback}(["), listed, F.lit("])")).alias("body"))
