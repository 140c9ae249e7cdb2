"""Channel names: normalisation, spec dictionaries, channel lists."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.frame import CHANNEL, LOG
from telemetra.session import constant_table

# Standard names and the names loggers use for them.  "Speed" is
# listed under RPM and Vehicle Speed; the later entry, Vehicle Speed, wins.
STANDARD_NAMES = {
    "AFR": [
        "Act_AFR", "R_EGO", "Aft", "Act AFR", "AFR", "Air Fuel Ratio", "AFR_R_BANK",
        "Wideband O2 Overall", "Wideband O2", "WB O2", "O2 Wideband", "Wideband Overall",
    ],
    "AFR Target": ["AFR Targ", "Target AFR", "afrtgt", "R_AFR_TARGET", "AFR_Target"],
    "AFR Channel 1": [
        "AFR_1", "AFR 1", "AFR1", "WB2 AFR 1", "Wideband O2 1", "WB O2 1", "Wideband 1",
    ],
    "AFR Channel 2": [
        "Aft2", "AFR 2", "AFR_2", "AFR2", "WB2 AFR 2", "Wideband O2 2", "WB O2 2", "Wideband 2",
    ],
    "AFR 1 Error": ["AFR_Error", "AFR_1_Error", "AFR 1 Error", "KO2_AFR_CORR"],
    "Battery V": [
        "VBat", "Bat V", "Batt", "Volts", "Voltage", "Bat Volts ECU", "Battery Voltage",
        "ECU Battery Voltage", "Ecu power", "BATTERY_VOLTAGE", "Bat_V",
    ],
    "Coolant Temp": [
        "Coolant", "CLT", "Temp_Coolant", "Temp Engine", "Engine Temperature",
        "Coolant Temperature", "CoolantTemp", "Coolant Temp",
    ],
    "Duty Cycle": [
        "DutyCycle1", "DutyCycle", "Duty Cycle", "PCS Fuel Duty Cyl 1", "DUTY CYCLE AVE",
        "Duty_Cycle",
    ],
    "EGO Cor 1": ["EGO Correction", "ID2 Cor", "EGO_Cor_1", "EGO Cor 1"],
    "EGO Cor 2": ["L_O2_Cor", "ID2_Cor", "O2_COR_L_BANK", "EGO_cor_2", "EGO Cor 2"],
    "IAT": [
        "IAT", "IAT - Inlet Air Temp", "IAT Intake Air Temp", "Intake Air Temp",
        "Intake Air Temperature",
    ],
    "Lambda 1": [
        "Lambda Right", "LambdaR", "Lambda 1", "Exhaust Lambda", "LAMBDA", "LAM8",
        "LAMBDA_R_BANK", "Lambda1",
    ],
    "MAF": ["Mass Air Flow", "Mass Air Flow Rate", "MAF"],
    "MAP": ["MAP", "Manifold Pressure", "Inlet Manifold Pressure"],
    "MAT": ["Air Temp Int", "Inlet Manifold Temperature", "TAIR", "MAT"],
    "O2": ["O2", "O2 Sensor"],
    "Pulse Width": [
        "pulsewidth1", "Injector PW Rear", "injector", "Fuel Actual PW", "PW1", "NJ_GPW_AVE", "PW",
    ],
    "RPM": ["RPM", "Speed", "PCS RPM4", "Engine RPM4", "RPM_INC_RPM", "engine/rpm"],
    "TPS": [
        "TPS_Pct", "Tps", "Throttle Pos", "TP", "Throttle Position", "PedalPos", "PCS TPS", "tps1",
    ],
    "Time": ["Time_s", "Device Time", "Timestamp", "TIME", "Offset"],
    "Ignition Adv": ["Ignition Advance", "Timing", "Spark Advance", "IgnAdv", "ignition/angle"],
    "Knock": ["Knock", "Knock Retard", "KnockRetard", "Knock Count"],
    "Boost": ["Boost", "Boost Pressure", "BoostPressure"],
    "Oil Pressure": ["Oil Pressure", "OilPressure", "Oil Press"],
    "Oil Temp": ["Oil Temp", "OilTemp", "Oil Temperature"],
    "Fuel Pressure": ["Fuel Pressure", "FuelPressure", "Fuel Press"],
    "EGT": ["EGT", "Exhaust Gas Temp", "Exhaust Temperature"],
    "Vehicle Speed": ["Vehicle Speed", "VSS", "Speed", "vehicleSpeed"],
    "Gear": ["Gear", "Current Gear", "GearPosition"],
}


def standard_table(spark: SparkSession) -> DataFrame:
    """The built-in dictionary as (key, target); about 150 rows."""
    known = {s.lower(): target for target, sources in STANDARD_NAMES.items() for s in sources}
    return constant_table(spark, sorted(known.items()), key=pa.string(), target=pa.string())


def custom_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """A caller's name map as (key, target), keys lower-cased as they are added."""
    rows = [(k.lower(), v) for k, v in mapping.items()]
    return constant_table(spark, rows, key=pa.string(), target=pa.string())


def spec_names(dictionary: DataFrame) -> DataFrame:
    """(key, target) of a spec dictionary."""
    return dictionary.select("key", F.col("spec.name").alias("target"))


def normalise_names(
    names: DataFrame,
    column: str = "name",
    custom: DataFrame | None = None,
    specs: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct name: its standard form and whether one was found.

    The first match wins: custom map by lower-cased name, as written, by last
    path segment; built-in by name, by segment; spec by name, by segment.
    Names are few (a channel dictionary, not samples); callers join the result
    to whatever carries the name.
    """
    spark = names.sparkSession
    parts = [standard_table(spark).withColumn("kind", F.lit("standard"))]
    if custom is not None:
        parts.append(custom.select("key", "target").withColumn("kind", F.lit("custom")))
    if specs is not None:
        parts.append(specs.select("key", "target").withColumn("kind", F.lit("spec")))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)

    name = F.col(column)
    lower = F.lower(name)
    segment = F.lower(F.element_at(F.split(name, "/"), -1))
    ways = [
        ("custom", lower), ("custom", name), ("custom", segment),
        ("standard", lower), ("standard", segment),
        ("spec", lower), ("spec", segment),
    ]
    tries = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))
            for i, (kind, key) in enumerate(ways)
        ]
    )
    asked = names.select(column).distinct().withColumn("_try", F.explode(tries))
    found = (
        asked.select(column, "_try.*")
        .join(table, ["kind", "key"], "left")
        .groupBy(column)
        .agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("rank"))).alias("_hit"))
    )
    return found.select(
        column,
        F.coalesce("_hit", column).alias("normal_name"),
        F.col("_hit").isNotNull().alias("is_normalized"),
    )


def display_name(name: Column, normal: Column, show_original: bool = False) -> Column:
    """``Normal (original)`` where the two differ, if asked for."""
    if not show_original:
        return normal
    return F.when(normal != name, F.concat(normal, F.lit(" ("), name, F.lit(")"))).otherwise(normal)


def sorted_channels(
    channels: DataFrame, lookup: DataFrame, normalise: bool = True, keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """Channel list with ``place``: normalised ones first, then by display name."""
    both = channels.join(lookup, "name")
    shown = F.col("normal_name") if normalise else F.col("name")
    both = both.withColumn("display", shown)
    order = Window.partitionBy(*keys).orderBy(
        F.col("is_normalized").desc(), F.lower("display"), "channel_idx"
    )
    return both.withColumn("place", F.row_number().over(order) - 1).drop("normal_name")


def search_channels(channels: DataFrame, text: str) -> DataFrame:
    """Channels whose original or display name contains the text, in any case."""
    q = F.lower(F.lit(text))
    return channels.filter(
        F.contains(F.lower("name"), q) | F.contains(F.lower("display"), q)
    )


def channel_list(samples: DataFrame, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """Channels seen in a long frame: log, channel_idx, name (numbered by name)."""
    seen = samples.select(*keys, F.col(CHANNEL).alias("name")).distinct()
    order = Window.partitionBy(*keys).orderBy("name")
    return seen.withColumn("channel_idx", F.row_number().over(order) - 1)


def resolve_channel(
    channels: DataFrame, name: str, keys: Sequence[str] = (LOG,), exact: bool = False
) -> DataFrame:
    """The first channel of each log with that name, in any case unless ``exact``."""
    same = F.col("name") == name if exact else F.lower("name") == name.lower()
    return (
        channels.filter(same)
        .groupBy(*keys)
        .agg(F.min_by("name", "channel_idx").alias("name"), F.min("channel_idx").alias("channel_idx"))
    )


def has_channel(
    channels: DataFrame, name: str, keys: Sequence[str] = (LOG,), exact: bool = False
) -> DataFrame:
    """Whether each log has a channel of that name."""
    same = F.col("name") == name if exact else F.lower("name") == name.lower()
    return channels.groupBy(*keys).agg(F.coalesce(F.max(same), F.lit(False)).alias("has_channel"))


def channel_by_index(
    samples: DataFrame,
    channels: DataFrame,
    index: int,
    computed: DataFrame | None = None,
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Samples of the channel at a list position.

    Positions past a log's own channels count into ``computed`` (log,
    computed_idx, name), whose samples are part of ``samples``.
    """
    wanted = channels.filter(F.col("channel_idx") == index).select(*keys, "name")
    if computed is not None:
        counts = channels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        virtual = (
            computed.join(counts, list(keys))
            .filter(F.col("computed_idx") == F.lit(index) - F.col("_n"))
            .select(*keys, "name")
        )
        wanted = wanted.unionByName(virtual)
    return samples.join(wanted.withColumnRenamed("name", CHANNEL), [*keys, CHANNEL])


def spec_dictionary(specs: DataFrame) -> DataFrame:
    """(key, spec) per lower-cased source name; a later spec or channel wins.

    ``specs`` are documents (load_order, id, vendor, the channels array) or rows of
    ``spec_channels``.
    """
    flat = spec_channels(specs).select("*", F.posexplode("source_names").alias("_s", "source"))
    spec = F.struct("id", "name", "category", "unit", "min", "max", "precision", "vendor")
    return flat.groupBy(F.lower("source").alias("key")).agg(
        F.max_by(spec, F.struct("load_order", "place", "_s")).alias("spec")
    )


def with_spec_metadata(channels: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """Attach ``spec`` (NULL where unknown) by channel name, in any case."""
    return channels.join(dictionary, F.lower(channels[name]) == dictionary["key"], "left").drop("key")


def display_attributes(channels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """show_min, show_max, precision and category: the log's own, else the spec's."""
    both = with_spec_metadata(channels, dictionary)
    return both.select(
        *channels.columns,
        F.coalesce("display_min", "spec.min").alias("show_min"),
        F.coalesce("display_max", "spec.max").alias("show_max"),
        F.col("spec.precision").alias("precision"),
        F.col("spec.category").alias("category"),
    )


def specs_by_id(specs: DataFrame, spec_id: str) -> DataFrame:
    """Spec or protocol documents with that id."""
    return specs.filter(F.col("id") == spec_id)


def specs_by_vendor(specs: DataFrame, vendor: str) -> DataFrame:
    """Spec or protocol documents of a vendor, in any case."""
    return specs.filter(F.lower("vendor") == vendor.lower())


def specs_by_extension(specs: DataFrame, extension: str) -> DataFrame:
    """With or without the leading dot, in any case."""
    ext = extension.lower()
    ext = ext if ext.startswith(".") else f".{ext}"
    return specs.filter(
        F.array_contains(F.transform("file_format.extensions", lambda e: F.lower(e)), ext)
    )


def spec_channels(specs: DataFrame) -> DataFrame:
    """One row per channel: load_order, spec_id, vendor, place and the channel's fields.

    Frames that are rows already are returned as they are.
    """
    if "channels" not in specs.columns:
        return specs
    return specs.select(
        "load_order", F.col("id").alias("spec_id"), "vendor",
        F.posexplode("channels").alias("place", "ch"),
    ).select("load_order", "spec_id", "vendor", "place", "ch.*")


def spec_normalisations(specs: DataFrame, spec_id: str) -> DataFrame:
    """(key, target) of one spec: its source names, lower-cased, and what they become."""
    rows = spec_channels(specs)
    return spec_names(spec_dictionary(rows.filter(F.col("spec_id") == spec_id)))


def protocol_messages(protocols: DataFrame) -> DataFrame:
    """One row per message: load_order, protocol_id, vendor and the message's fields."""
    if "messages" not in protocols.columns:
        return protocols
    return protocols.select(
        "load_order", F.col("id").alias("protocol_id"), "vendor", F.explode("messages").alias("m")
    ).select("load_order", "protocol_id", "vendor", "m.*")


def protocol_signals(protocols: DataFrame) -> DataFrame:
    """One row per signal, with the message (message_id, message) that carries it."""
    return protocol_messages(protocols).select(
        "load_order", "protocol_id", "vendor", F.col("id").alias("message_id"),
        F.col("name").alias("message"), F.explode("signals").alias("s"),
    ).select("load_order", "protocol_id", "vendor", "message_id", "message", "s.*")


def channels_by_category(specs: DataFrame, category: str) -> DataFrame:
    return spec_channels(specs).filter(F.lower("category") == category.lower())


def categories(specs: DataFrame) -> DataFrame:
    """Distinct channel categories in order."""
    return spec_channels(specs).select("category").distinct().orderBy("category")
