"""Display units: conversion from the stored unit of a channel to the chosen one."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.session import constant_table

# Source unit, family, chosen unit, and the value as
# "linear": v * factor / divisor + offset after adding pre, or "inverse": factor / v for v > 0.
CONVERSIONS = (
    # source, family, target, kind, pre, factor, divisor, offset
    ("K", "temperature", "K", "linear", 0.0, 1.0, 1.0, 0.0),
    ("K", "temperature", "°C", "linear", -273.15, 1.0, 1.0, 0.0),
    ("K", "temperature", "°F", "linear", -273.15, 9.0, 5.0, 32.0),
    ("kPa", "pressure", "kPa", "linear", 0.0, 1.0, 1.0, 0.0),
    ("kPa", "pressure", "PSI", "linear", 0.0, 0.145038, 1.0, 0.0),
    ("kPa", "pressure", "bar", "linear", 0.0, 0.01, 1.0, 0.0),
    ("km/h", "speed", "km/h", "linear", 0.0, 1.0, 1.0, 0.0),
    ("km/h", "speed", "mph", "linear", 0.0, 0.621371, 1.0, 0.0),
    ("km", "distance", "km", "linear", 0.0, 1.0, 1.0, 0.0),
    ("km", "distance", "mi", "linear", 0.0, 0.621371, 1.0, 0.0),
    ("L/100km", "fuel_economy", "L/100km", "linear", 0.0, 1.0, 1.0, 0.0),
    ("L/100km", "fuel_economy", "mpg", "inverse", 0.0, 235.215, 1.0, 0.0),
    ("L/100km", "fuel_economy", "km/L", "inverse", 0.0, 100.0, 1.0, 0.0),
    ("L", "volume", "L", "linear", 0.0, 1.0, 1.0, 0.0),
    ("L", "volume", "gal", "linear", 0.0, 0.264172, 1.0, 0.0),
    ("cc/min", "flow", "cc/min", "linear", 0.0, 1.0, 1.0, 0.0),
    ("cc/min", "flow", "lb/hr", "linear", 0.0, 0.75 * 60.0, 453.592, 0.0),
    ("m/s²", "acceleration", "m/s²", "linear", 0.0, 1.0, 1.0, 0.0),
    ("m/s²", "acceleration", "g", "linear", 0.0, 1.0, 9.80665, 0.0),
)
DEFAULT_UNITS = {
    "temperature": "°C",
    "pressure": "kPa",
    "speed": "km/h",
    "distance": "km",
    "fuel_economy": "L/100km",
    "volume": "L",
    "flow": "cc/min",
    "acceleration": "m/s²",
}


def conversion_table(spark: SparkSession, choice: Mapping[str, str] | None = None) -> DataFrame:
    """One row per source unit for the chosen target of its family (eight rows)."""
    wanted = {**DEFAULT_UNITS, **(choice or {})}
    rows = [r for r in CONVERSIONS if wanted[r[1]] == r[2]]
    missing = set(wanted) - {r[1] for r in rows}
    if missing:
        raise ValueError(f"unknown unit for {', '.join(sorted(missing))}")
    text, number = pa.string(), pa.float64()
    return constant_table(
        spark, rows, source=text, family=text, target=text, kind=text, pre=number,
        factor=number, divisor=number, offset=number,
    )


def convert(
    df: DataFrame,
    value: str = "value",
    unit: str = "unit",
    choice: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add display_value and display_unit; units without a family pass through.

    The table has one row per family, so the join always broadcasts.
    """
    table = conversion_table(df.sparkSession, choice).drop("family")
    v = F.col(value)
    inverse = F.when(v > 0, F.try_divide(F.col("factor"), v)).otherwise(F.lit(0.0))
    linear = (v + F.col("pre")) * F.col("factor") / F.col("divisor") + F.col("offset")
    shown = (
        F.when(F.col("kind").isNull(), v)
        .when(F.col("kind") == "inverse", inverse)
        .otherwise(linear)
    )
    return (
        df.join(F.broadcast(table), df[unit] == table["source"], "left")
        .withColumn("display_value", shown)
        .withColumn("display_unit", F.coalesce("target", unit))
        .drop("source", "target", "kind", "pre", "factor", "divisor", "offset")
    )


def convert_column(value: Column, source: str, target: str) -> Column:
    """One channel whose unit is known when the query is written."""
    for src, _, tgt, kind, pre, factor, divisor, offset in CONVERSIONS:
        if (src, tgt) == (source, target):
            if kind == "inverse":
                return F.when(value > 0, F.try_divide(F.lit(factor), value)).otherwise(F.lit(0.0))
            return (value + F.lit(pre)) * F.lit(factor) / F.lit(divisor) + F.lit(offset)
    return value


def fixed_text(value: Column, places: int, width: int = 1) -> Column:
    """Fixed-point text of the exact binary value, ties to even, with ``width`` whole digits.

    ``format_string`` would round the shortest decimal form instead.
    """
    return F.call_function("format_number", value, F.lit("0" * width + "." + "0" * places))


def legend(df: DataFrame, name: str = "name") -> DataFrame:
    """Legend text ``name: value unit`` with two decimals, from converted rows."""
    number = fixed_text(F.col("display_value"), 2)
    suffix = F.when(F.col("display_unit") == "", F.lit("")).otherwise(
        F.concat(F.lit(" "), F.col("display_unit"))
    )
    return df.withColumn("legend", F.concat(F.col(name), F.lit(": "), number, suffix))


def format_time(seconds: Column) -> Column:
    """``h:mm:ss.xxx``, ``m:ss.xxx`` or ``s.xxxs``, with the sign kept."""
    total = F.abs(seconds)
    hours = F.floor(total / 3600.0)
    minutes = F.floor((total % 3600.0) / 60.0)
    secs = total % 60.0
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    padded = fixed_text(secs, 3, 2)
    return (
        F.when(hours > 0, F.format_string("%s%d:%02d:%s", sign, hours, minutes, padded))
        .when(minutes > 0, F.format_string("%s%d:%s", sign, minutes, padded))
        .otherwise(F.concat(sign, fixed_text(secs, 3), F.lit("s")))
    )
