"""Raw logger values to engineering values, and units from channel names."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T, finite_or_zero
from telemetra.operators.layout import CHUNK_ROWS, with_record_index
from telemetra.session import constant_table

# Key-value log types as (type, unit, divisor, offset after dividing).
KEYVALUE_TYPES = (
    ("AFR", "λ", 1000.0, 0.0),
    ("AbsPressure", "kPa", 10.0, 0.0),
    ("Acceleration", "m/s²", 10.0, 0.0),
    ("Angle", "°", 10.0, 0.0),
    ("AngularVelocity", "°/s", 10.0, 0.0),
    ("BatteryVoltage", "V", 1000.0, 0.0),
    ("BoostToFuelFlowRate", "", 1.0, 0.0),
    ("ByteCount", "", 1.0, 0.0),
    ("Current", "A", 1000.0, 0.0),
    ("Current_mA_as_A", "A", 1000.0, 0.0),
    ("Current_uA_as_mA", "mA", 1000.0, 0.0),
    ("Decibel", "dB", 100.0, 0.0),
    ("Density", "g/m³", 10.0, 0.0),
    ("DrivenDistance", "km", 1.0, 0.0),
    ("EngineSpeed", "RPM", 1.0, 0.0),
    ("EngineVolume", "cc", 1.0, 0.0),
    ("Flow", "cc/min", 1.0, 0.0),
    ("Frequency", "Hz", 1.0, 0.0),
    ("FuelEcomony", "L/100km", 10.0, 0.0),
    ("FuelVolume", "L", 10.0, 0.0),
    ("Gear", "", 1.0, 0.0),
    ("GearRatio", "", 100.0, 0.0),
    ("InjFuelVolume", "cc", 1.0, 0.0),
    ("MassOverTime", "g/s", 1.0, 0.0),
    ("MassPerCyl", "mg", 1.0, 0.0),
    ("Mileage", "km", 1.0, 0.0),
    ("PercentPerEngineCycle", "%", 10.0, 0.0),
    ("PercentPerLambda", "%", 10.0, 0.0),
    ("PercentPerRpm", "%", 10.0, 0.0),
    ("Percentage", "%", 10.0, 0.0),
    ("Pressure", "kPa", 10.0, -101.3),
    ("PulsesPerLongDistance", "", 1.0, 0.0),
    ("Ratio", "", 100.0, 0.0),
    ("Raw", "", 1.0, 0.0),
    ("Resistance", "Ω", 1.0, 0.0),
    ("Speed", "km/h", 10.0, 0.0),
    ("Stoichiometry", "", 100.0, 0.0),
    ("Temperature", "K", 10.0, 0.0),
    ("TimeUsAsUs", "μs", 1.0, 0.0),
    ("Time_ms", "ms", 1.0, 0.0),
    ("Time_ms_as_s", "s", 1000.0, 0.0),
    ("Time_s", "s", 1.0, 0.0),
    ("Time_us", "ms", 1000.0, 0.0),
)

# Fixed-record channel ids as (id, name, unit, scale).
SLOT_CHANNELS = (
    (1, "TPS", "%", 0.1),
    (2, "Air Temp", "°C", 1.0),
    (3, "MAP", "kPa", 0.1),
    (4, "Lambda", "λ", 0.001),
    (5, "Fuel Pressure", "bar", 0.01),
    (6, "Oil Pressure", "bar", 0.01),
    (7, "Oil Temp", "°C", 1.0),
    (8, "Fuel Temp", "°C", 1.0),
    (9, "Exhaust Temp", "°C", 1.0),
    (10, "Boost Target", "kPa", 0.1),
    (11, "Boost Duty", "%", 0.1),
    (12, "Load", "%", 0.1),
    (13, "Fuel Cut", "", 1.0),
    (14, "Spark Cut", "", 1.0),
    (15, "Gear", "", 1.0),
    (16, "Speed", "km/h", 0.1),
    (17, "Battery", "V", 0.01),
    (18, "AFR Target", "AFR", 0.1),
    (19, "Coolant Temp", "°C", 1.0),
    (20, "RPM", "RPM", 1.0),
    (21, "Ignition Advance", "°", 0.1),
    (22, "Inj Pulse Width", "ms", 0.01),
    (23, "Inj Duty Cycle", "%", 0.1),
    (24, "Fuel Pressure", "kPa", 0.1),
    (25, "Coolant Temp Corr", "%", 0.1),
    (26, "Air Temp Corr", "%", 0.1),
    (27, "Acceleration Enrich", "%", 0.1),
    (28, "Warmup Enrich", "%", 0.1),
    (29, "Ignition Timing", "°BTDC", 0.1),
    (30, "Idle Valve", "%", 0.1),
    (31, "Inj Duty", "%", 0.1),
    (32, "MAP", "kPa", 0.1),
    (33, "Barometric Pressure", "kPa", 0.1),
    (34, "Aux Input 34", "", 1.0),
    (35, "Aux Input 35", "", 1.0),
    (45, "AFR", "AFR", 0.1),
    (46, "AFR", "AFR", 0.1),
    (47, "Lambda", "λ", 0.01),
)

# Units by name.  A rule is a unit and the ways to it; a way is tests that must
# all hold.  The first rule with such a way wins.
HOLDFILL_UNITS = (
    ("°C", (
        (("path", "contains", "temp"),),
    )),
    ("kPa", (
        (("path", "contains", "pressure"),),
        (("name", "equals", "map"),),
        (("path", "contains", "/map"),),
        (("path", "contains", "baro"),),
        (("path", "contains", "boost"),),
    )),
    ("RPM", (
        (("name", "ends with", "rpm"),),
        (("name", "contains", "rpmtarget"),),
        (("name", "contains", "rpmmatch"),),
    )),
    ("%", (
        (("name", "contains", "tps"),),
        (("name", "contains", "throttle"),),
        (("path", "contains", "throttle"),),
        (("path", "contains", "dbw"), ("name", "equals", "target")),
    )),
    ("%", (
        (("name", "contains", "percent"),),
        (("name", "contains", "duty"),),
        (("path", "contains", "percent"),),
        (("name", "contains", "correction"),),
        (("path", "contains", "torqueestimation"), ("name", "lacks", "torque")),
    )),
    ("°", (
        (("name", "equals", "angle"),),
        (("path", "contains", "ignition"), ("name", "contains", "angle")),
    )),
    ("°", (
        (("path", "contains", "vvt"), ("name", "contains", "angle")),
        (("path", "contains", "vvt"), ("name", "contains", "position")),
        (("path", "contains", "cam"), ("name", "contains", "angle")),
        (("path", "contains", "cam"), ("name", "contains", "position")),
    )),
    ("V", (
        (("name", "contains", "volt"),),
        (("name", "equals", "battery"),),
        (("name", "contains", "vbat"),),
    )),
    ("λ", (
        (("name", "contains", "lambda"),),
        (("name", "contains", "afr"),),
        (("name", "equals", "o2"),),
    )),
    ("km/h", (
        (("name", "contains", "speed"), ("name", "lacks", "rpm")),
    )),
    ("", (
        (("name", "contains", "gear"), ("name", "lacks", "ratio")),
    )),
    ("%", (
        (("name", "contains", "torque"), ("path", "contains", "reduction")),
    )),
    ("Nm", (
        (("name", "contains", "torque"),),
    )),
    ("s", (
        (("name", "contains", "timer"),),
    )),
    ("cc/min", (
        (("name", "contains", "flow"),),
    )),
)
MSCLOCK_UNITS = (
    ("°C", (
        (("name", "contains", "temp"),),
        (("name", "contains", "iat"),),
        (("name", "contains", "ect"),),
    )),
    ("psi", (
        (("name", "contains", "pressure"),),
        (("name", "contains", "map"),),
        (("name", "contains", "baro"),),
        (("name", "contains", "boost"),),
    )),
    ("rpm", (
        (("name", "contains", "rpm"),),
        (("name", "contains", "engine speed"),),
    )),
    ("%", (
        (("name", "contains", "tps"),),
        (("name", "contains", "throttle"),),
    )),
    ("%", (
        (("name", "contains", "duty"),),
        (("name", "contains", "correction"),),
        (("name", "contains", "learning"),),
        (("name", "contains", "load"),),
    )),
    ("°", (
        (("name", "contains", "timing"),),
        (("name", "contains", "angle"),),
        (("name", "contains", "knock"),),
        (("name", "contains", "degrees"),),
    )),
    ("V", (
        (("name", "contains", "voltage"),),
        (("name", "contains", "battery"),),
    )),
    ("AFR", (
        (("name", "contains", "afr"),),
        (("name", "contains", "a/f"),),
    )),
    ("mph", (
        (("name", "contains", "speed"),),
    )),
    ("g/s", (
        (("name", "contains", "maf"),),
        (("name", "contains", "mass airflow"),),
    )),
)
FRAME_UNITS = (
    ("rpm", (
        (("name", "contains", "rpm"),),
        (("name", "equals", "engine speed"),),
    )),
    ("°C", (
        (("name", "contains", "temp"),),
        (("name", "contains", "egt"),),
        (("name", "equals", "iat"),),
        (("name", "equals", "ect"),),
        (("name", "equals", "h2o"),),
        (("name", "equals", "ambient"),),
    )),
    ("λ", (
        (("name", "contains", "lambda"),),
        (("name", "starts with", "lm"),),
    )),
    ("AFR", (
        (("name", "contains", "afr"),),
        (("name", "contains", "a/f"),),
        (("name", "contains", "air fuel"),),
    )),
    ("g", (
        (("name", "contains", " g"),),
        (("name", "starts with", "g "),),
        (("name", "starts with", "accel"),),
    )),
    ("°/s", (
        (("name", "contains", "yaw"),),
        (("name", "contains", "pitch"),),
        (("name", "contains", "roll"),),
        (("name", "starts with", "gyro"),),
    )),
    ("°", (
        (("name", "contains", "latitude"),),
        (("name", "contains", "longitude"),),
        (("name", "contains", "gps"), ("name", "contains", "lat")),
        (("name", "contains", "gps"), ("name", "contains", "long")),
        (("name", "equals", "lat"),),
        (("name", "equals", "lon"),),
    )),
    ("m", (
        (("name", "contains", "altitude"),),
        (("name", "contains", "distance"),),
        (("name", "contains", "odometer"),),
        (("name", "equals", "alt"),),
    )),
    ("°", (
        (("name", "contains", "heading"),),
        (("name", "contains", "course"),),
        (("name", "contains", "steer"),),
    )),
    ("km/h", (
        (("name", "contains", "speed"),),
        (("name", "contains", "veh spd"),),
    )),
    ("bar", (
        (("name", "contains", "brake"),),
    )),
    ("bar", (
        (("name", "contains", "press"),),
        (("name", "contains", "boost"),),
        (("name", "equals", "map"),),
    )),
    ("%", (
        (("name", "contains", "tps"),),
        (("name", "contains", "throttle"),),
        (("name", "contains", "duty"),),
        (("name", "contains", "%"),),
    )),
    ("V", (
        (("name", "contains", "voltage"),),
        (("name", "contains", "batt"),),
    )),
    ("mm", (
        (("name", "contains", "susp"),),
        (("name", "contains", "damper"),),
    )),
    ("s", (
        (("name", "contains", "lap time"),),
        (("name", "contains", "laptime"),),
    )),
    ("L/h", (
        (("name", "contains", "fuel flow"),),
        (("name", "contains", "fuel consumption"),),
    )),
)


Way = tuple[tuple[str, str, str], ...]
_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "contains": F.contains,
    "equals": lambda c, word: c == word,
    "starts with": F.startswith,
    "ends with": F.endswith,
    "lacks": lambda c, word: ~F.contains(c, word),
}


def unit_by_rules(
    rules: Sequence[tuple[str, tuple[Way, ...]]], name: Column, path: Column | None = None
) -> Column:
    """One CASE over the lower-cased name (and path); no match gives ''."""
    fields = {"name": F.lower(name), "path": F.lower(path if path is not None else name)}

    def holds(way: Way) -> Column:
        tests = [_TESTS[how](fields[field], F.lit(word)) for field, how, word in way]
        return functools.reduce(operator.and_, tests)

    chain = F
    for unit, ways in rules:
        chain = chain.when(functools.reduce(operator.or_, [holds(w) for w in ways]), unit)
    return chain.otherwise("")


def name_and_unit(header: Column) -> tuple[Column, Column]:
    """Split ``Name (unit)`` at the last bracket; without one, infer the unit."""
    text = F.trim(header)
    pattern = r"^(.*)\(([^(]*)\)[^()]*$"
    has = F.rlike(text, F.lit(pattern))
    name = F.when(has, F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text)
    unit = F.when(has, F.trim(F.regexp_extract(text, pattern, 2))).otherwise(
        unit_by_rules(MSCLOCK_UNITS, text)
    )
    return name, unit


def path_name(path: Column) -> Column:
    """Last segment of a channel path."""
    return F.element_at(F.split(F.trim(path), "/"), -1)


def keyvalue_type_table(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, KEYVALUE_TYPES, type=pa.string(), unit=pa.string(), divisor=pa.float64(),
        addend=pa.float64(),
    )


def slot_channel_table(spark: SparkSession) -> DataFrame:
    return constant_table(
        spark, SLOT_CHANNELS, channel_id=pa.int32(), slot_name=pa.string(), unit=pa.string(),
        scale=pa.float64(),
    )


def decode_types(df: DataFrame, raw: str, type_column: str, out: str = "value") -> DataFrame:
    """Raw cells by type; an unknown type counts as Raw.  The table has 43 rows."""
    table = keyvalue_type_table(df.sparkSession)
    return (
        df.join(F.broadcast(table), df[type_column] == table["type"], "left")
        .withColumn(
            out,
            F.col(raw) / F.coalesce("divisor", F.lit(1.0)) + F.coalesce("addend", F.lit(0.0)),
        )
        .withColumn("unit", F.coalesce("unit", F.lit("")))
        .drop(table["type"])
        .drop("divisor", "addend")
    )


def decode_fields(raw: DataFrame, fields: DataFrame, out: str = "value") -> DataFrame:
    """(raw + transform) * scale by the log's field dictionary; bit fields give 0.

    The dictionary has one row per log and field.
    """
    value = F.when(F.col("field_type") >= 10, F.lit(0.0)).otherwise(
        (F.col("raw") + F.col("transform")) * F.col("scale")
    )
    return raw.join(fields, [LOG, "field_idx"]).withColumn(out, value)


def live_frames(
    frames: DataFrame,
    channels: int,
    rate: float = 100.0,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Frames (log, seq, values) that carry anything, on an even clock.

    Non-finite numbers become 0; a frame whose numbers are all within 1e-4 of 0
    is dropped; ``t`` counts the kept frames; cells are padded with 0.
    """
    clean = frames.withColumn(
        "cells", F.transform("values", lambda v: finite_or_zero(v.cast("double")))
    )
    live = clean.filter(F.exists("cells", lambda v: F.abs(v) > 1e-4))
    numbered = with_record_index(live, ["seq"], keys, rows)
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(channels - 1)),
        lambda i: F.coalesce(F.get("cells", i), F.lit(0.0)),
    )
    return numbered.select(
        *keys, IDX, (F.col(IDX) / F.lit(rate)).alias(T), padded.alias("cells")
    )
