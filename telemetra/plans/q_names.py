"""Channel-name, spec and channel-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T, VALUE
from telemetra.functions import decode
from telemetra.operators import names, stats
from telemetra.plans.catalog import EVENTS_CTE, query
from telemetra.sources import tables

# Logger spellings dealt out over the parts, and what each must become.
SPELLINGS = (
    ("engine/rpm", "RPM"), ("Act_AFR", "AFR"), ("sensors/CLT", "Coolant Temp"),
    ("Speed", "Vehicle Speed"), ("my/Boost Sensor", "Boost X"), ("WIDEBAND 1", "AFR Channel 1"),
    ("Nothing Known", "Nothing Known"), ("red widget", "ECONOMY"), ("dash/Lap Beacon", "Lap"),
    ("tps1", "TPS"), ("ignition/angle", "Ignition Adv"), ("Frame", "FRAME!"),
)
_CASE = "CASE CAST(p_partkey % 12 AS INTEGER) " + " ".join(
    f"WHEN {i} THEN '{{}}'" for i in range(12)
) + " END"
_NAME = _CASE.format(*[s for s, _ in SPELLINGS])
_TARGET = _CASE.format(*[t for _, t in SPELLINGS])


def part_names(spark, sf):
    spelled = F.array(*[F.lit(s) for s, _ in SPELLINGS])
    return tables.read_table(spark, sf, "part").select(
        "p_partkey", F.element_at(spelled, (F.col("p_partkey") % 12 + 1).cast("int")).alias("name")
    )


def _custom(spark):
    return names.custom_table(
        spark, {"Boost Sensor": "Boost X", "FRAME": "FRAME!", "Lap Beacon": "Lap"}
    )


def _spec(spark):
    return names.custom_table(spark, {"red widget": "ECONOMY", "tps1": "not used"})


@query(
    "normalise_channel_names",
    f"""WITH s AS (SELECT p_partkey, {_NAME} AS name, {_TARGET} AS display FROM part)
SELECT p_partkey, name, display AS normal_name, name <> 'Nothing Known' AS is_normalized,
  CASE WHEN display <> name THEN display || ' (' || name || ')' ELSE display END AS label FROM s""",
)
def normalise_channel_names(spark, sf):
    parts = part_names(spark, sf)
    lookup = names.normalise_names(parts, custom=_custom(spark), specs=_spec(spark))
    return parts.join(lookup, "name").select(
        "p_partkey", "name", "normal_name", "is_normalized",
        names.display_name(F.col("name"), F.col("normal_name"), True).alias("label"),
    )


@query(
    "sorted_channel_list",
    f"""WITH s AS (SELECT p_size AS log_id, p_partkey AS channel_idx, {_NAME} AS name, {_TARGET} AS display FROM part)
SELECT log_id, channel_idx, name, display, name <> 'Nothing Known' AS is_normalized,
  row_number() OVER (PARTITION BY log_id ORDER BY name = 'Nothing Known', lower(display), channel_idx) - 1 AS place FROM s""",
)
def sorted_channel_list(spark, sf):
    parts = part_names(spark, sf)
    sizes = tables.read_table(spark, sf, "part").select("p_partkey", F.col("p_size").alias(LOG))
    channels = parts.join(sizes, "p_partkey").withColumnRenamed("p_partkey", "channel_idx")
    lookup = names.normalise_names(parts, custom=_custom(spark), specs=_spec(spark))
    return names.sorted_channels(channels, lookup)


@query(
    "search_channels",
    f"""WITH s AS (SELECT p_partkey AS channel_idx, {_NAME} AS name, {_TARGET} AS display, p_size % 2 = 0 AS has_data FROM part)
SELECT has_data, channel_idx, name, display FROM s WHERE lower(name) LIKE '%afr%' OR lower(display) LIKE '%afr%'""",
)
def search_channels(spark, sf):
    """Search by original or display name, in the with-data and without-data groups."""
    part = tables.read_table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("has_data"))
    parts = part_names(spark, sf)
    lookup = names.normalise_names(parts, custom=_custom(spark), specs=_spec(spark))
    listed = parts.join(lookup, "name").join(part, "p_partkey").select(
        "has_data", F.col("p_partkey").alias("channel_idx"), "name", F.col("normal_name").alias("display")
    )
    return names.search_channels(listed, "AFR")


def _brand_number():
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")


def part_channels(spark, sf):
    """The channels of one spec per brand, a row each: its parts."""
    return tables.read_table(spark, sf, "part").select(
        _brand_number().alias("load_order"), F.lower("p_brand").alias("spec_id"),
        F.col("p_brand").alias("vendor"), F.col("p_partkey").alias("place"),
        F.col("p_partkey").cast("string").alias("id"), F.concat("p_type", F.lit(" "), "p_name").alias("name"),
        F.initcap(F.element_at(F.split("p_name", " "), 1)).alias("category"), F.lit("mm").alias("unit"),
        F.lit(0.0).alias("min"), F.col("p_retailprice").alias("max"), (F.col("p_size") % 4).alias("precision"),
        F.array("p_name", F.concat(F.lit("P"), F.col("p_partkey"))).alias("source_names"),
    )


def part_specs(spark, sf):
    """One spec document per brand, without its channels."""
    brands = tables.read_table(spark, sf, "part").select("p_brand").distinct()
    extensions = F.array(F.lit(".CSV"), F.concat(F.lit(".b"), _brand_number()))
    return brands.select(
        _brand_number().alias("load_order"), F.lower("p_brand").alias("id"),
        F.col("p_brand").alias("vendor"),
        F.struct(extensions.alias("extensions")).alias("file_format"),
    )


_SPEC = """d AS (SELECT lower(p_name) AS key, arg_max(p_partkey, struct_pack(b := CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER), p := p_partkey)) AS pk
  FROM part GROUP BY lower(p_name))"""


@query(
    "spec_dictionary",
    f"""WITH {_SPEC}, a AS (SELECT key, pk FROM d UNION ALL SELECT 'p' || p_partkey, p_partkey FROM part)
SELECT a.key, p_type || ' ' || p_name AS name, p_brand AS vendor, p_retailprice AS max, p_size % 4 AS precision FROM a JOIN part ON p_partkey = pk""",
)
def spec_dictionary(spark, sf):
    """The later spec wins a shared source name."""
    d = names.spec_dictionary(part_channels(spark, sf))
    return d.select("key", "spec.name", "spec.vendor", "spec.max", "spec.precision")


@query(
    "spec_channel_attributes",
    f"""WITH {_SPEC}, c AS (SELECT p_size AS log_id, p_partkey AS channel_idx, upper(p_name) AS name,
   CASE WHEN p_partkey % 3 = 0 THEN 5.0::DOUBLE END AS display_max FROM part WHERE p_partkey % 2 = 0
   UNION ALL SELECT p_size, p_partkey, 'unknown ' || p_partkey, NULL FROM part WHERE p_partkey % 2 = 1)
SELECT log_id, channel_idx, c.name, CASE WHEN pk IS NOT NULL THEN 0.0::DOUBLE END AS show_min, coalesce(display_max, p_retailprice) AS show_max,
  p_size % 4 AS precision, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS category
FROM c LEFT JOIN d ON d.key = lower(c.name) LEFT JOIN part ON p_partkey = pk""",
)
def spec_channel_attributes(spark, sf):
    """The log's own bounds where it has them, else the spec's."""
    known = F.col("p_partkey") % 2 == 0
    part = tables.read_table(spark, sf, "part").select(
        F.col("p_size").alias(LOG), F.col("p_partkey").alias("channel_idx"),
        F.when(known, F.upper("p_name")).otherwise(F.concat(F.lit("unknown "), "p_partkey")).alias("name"),
        F.lit(None).cast("double").alias("display_min"),
        F.when(known & (F.col("p_partkey") % 3 == 0), F.lit(5.0)).alias("display_max"),
    )
    out = names.display_attributes(part, names.spec_dictionary(part_channels(spark, sf)))
    return out.drop("display_min", "display_max")


@query(
    "spec_lookups",
    """WITH b AS (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS o FROM part)
SELECT 'id' AS lookup, lower(p_brand) AS found FROM b WHERE o = 7
UNION ALL SELECT 'vendor', lower(p_brand) FROM b WHERE o = 11
UNION ALL SELECT 'extension', lower(p_brand) FROM b
UNION ALL SELECT 'category', CAST(p_partkey AS VARCHAR) FROM part WHERE p_name LIKE 'red %'
UNION ALL SELECT DISTINCT 'categories', upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) FROM part""",
)
def spec_lookups(spark, sf):
    """Specs by id, vendor, extension; channels by category; all categories."""
    specs, channels = part_specs(spark, sf), part_channels(spark, sf)

    def rows(kind, df, column):
        return df.select(F.lit(kind).alias("lookup"), F.col(column).alias("found"))

    out = rows("id", names.specs_by_id(specs, "brand#7"), "id")
    for part in (
        rows("vendor", names.specs_by_vendor(specs, "BRAND#11"), "id"),
        rows("extension", names.specs_by_extension(specs, "csv"), "id"),
        rows("category", names.channels_by_category(channels, "red"), "id"),
        rows("categories", names.categories(channels), "category"),
    ):
        out = out.unionByName(part)
    return out


_POINTS = """c AS (SELECT DISTINCT user_id AS log_id, event_type AS name FROM events),
i AS (SELECT log_id, name, row_number() OVER (PARTITION BY log_id ORDER BY name) - 1 AS channel_idx FROM c)"""


@query(
    "channel_by_name",
    f"WITH {_POINTS} SELECT log_id, name, channel_idx FROM i WHERE lower(name) = 'purchase'",
)
def channel_by_name(spark, sf):
    channels = names.channel_list(tables.event_rate_points(spark, sf))
    return names.resolve_channel(channels, "PURCHASE")


@query(
    "channel_exact_name",
    """WITH c AS (SELECT user_id AS log_id, bool_or(event_type = 'purchase') AS any_case FROM events GROUP BY user_id)
SELECT log_id, any_case, any_case AND log_id % 2 = 1 AS exact_case,
  CASE WHEN any_case AND log_id % 2 = 1 THEN 'PURCHASE' END AS name FROM c""",
)
def channel_exact_name(spark, sf):
    """Odd logs spell their channels in capitals; has_channel and lookup in both ways."""
    name = F.when(F.col(LOG) % 2 == 1, F.upper("name")).otherwise(F.col("name"))
    channels = names.channel_list(tables.event_rate_points(spark, sf)).withColumn("name", name)
    loose = names.has_channel(channels, "Purchase").withColumnRenamed("has_channel", "any_case")
    exact = names.has_channel(channels, "PURCHASE", exact=True).withColumnRenamed("has_channel", "exact_case")
    found = names.resolve_channel(channels, "PURCHASE", exact=True).select(LOG, "name")
    return loose.join(exact, LOG).join(found, LOG, "left")


def supplier_protocols(spark, sf):
    """(documents, messages): a bus protocol per nation, its suppliers as messages of two signals."""
    supplier = tables.read_table(spark, sf, "supplier")
    shown = F.concat(F.lit("bus-"), "s_nationkey")
    vendor = F.concat(F.lit("Region "), F.col("s_nationkey") % 5)
    documents = supplier.select("s_nationkey").distinct().select(
        F.col("s_nationkey").alias("load_order"), shown.alias("id"), vendor.alias("vendor")
    )

    def signal(name, start, length):
        return F.struct(
            F.lit(name).alias("name"), F.lit(start).alias("start_bit"), F.lit(length).alias("length")
        )

    messages = supplier.select(
        F.col("s_nationkey").alias("load_order"), shown.alias("protocol_id"), vendor.alias("vendor"),
        F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"),
        F.array(signal("balance", 0, 32), signal("phone", 32, 16)).alias("signals"),
    )
    return documents, messages


@query(
    "protocol_lookups",
    """WITH d AS (SELECT DISTINCT 'bus-' || s_nationkey AS id, s_nationkey % 5 AS r FROM supplier)
SELECT 'id' AS lookup, id AS found FROM d WHERE id = 'bus-7'
UNION ALL SELECT 'vendor', id FROM d WHERE r = 3
UNION ALL SELECT 'message', s_name FROM supplier WHERE s_nationkey = 7
UNION ALL SELECT 'signal', s_name || '.' || v.name || '@' || v.first_bit FROM supplier, (VALUES ('balance', 0), ('phone', 32)) v(name, first_bit)
UNION ALL SELECT 'names', key || '=' || arg_max(target, p_partkey) FROM (
   SELECT lower(p_name) AS key, p_type || ' ' || p_name AS target, p_partkey FROM part WHERE p_brand = 'Brand#13'
   UNION ALL SELECT 'p' || p_partkey, p_type || ' ' || p_name, p_partkey FROM part WHERE p_brand = 'Brand#13') GROUP BY key""",
)
def protocol_lookups(spark, sf):
    """Protocols by id and vendor, their messages and signals, and one spec's name map."""
    documents, messages = supplier_protocols(spark, sf)
    signals = names.protocol_signals(messages)
    named = names.spec_normalisations(part_channels(spark, sf), "brand#13")
    out = None
    for kind, df, found in (
        ("id", names.specs_by_id(documents, "bus-7"), F.col("id")),
        ("vendor", names.specs_by_vendor(documents, "REGION 3"), F.col("id")),
        ("message", names.protocol_messages(messages).filter("protocol_id = 'bus-7'"), F.col("name")),
        ("signal", signals, F.concat("message", F.lit("."), "name", F.lit("@"), "start_bit")),
        ("names", named, F.concat("key", F.lit("="), "target")),
    ):
        part = df.select(F.lit(kind).alias("lookup"), found.alias("found"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "channel_by_index",
    f"""WITH {_POINTS} SELECT e.user_id AS log_id, e.event_id AS seq, e.event_type AS channel, value
FROM events e JOIN i ON i.log_id = user_id AND i.name = event_type WHERE channel_idx = 1""",
)
def channel_by_index(spark, sf):
    points = tables.event_rate_points(spark, sf)
    out = names.channel_by_index(points, names.channel_list(points), 1)
    return out.select(LOG, "seq", "channel", VALUE)


@query(
    "value_at_record",
    f"WITH {EVENTS_CTE} SELECT log_id, idx, value, k FROM e WHERE idx = 60",
)
def value_at_record(spark, sf):
    """Record 60 of every log that has one."""
    return tables.event_records(spark, sf).filter(F.col(IDX) == 60).select(LOG, IDX, "value", "k")


@query(
    "units_by_name",
    """SELECT p_partkey, CASE CAST(p_partkey % 8 AS INTEGER) WHEN 0 THEN '°C' WHEN 1 THEN 'kPa' WHEN 2 THEN 'RPM' WHEN 3 THEN '%' WHEN 4 THEN '°'
  WHEN 5 THEN '%' WHEN 6 THEN 'Nm' ELSE '' END AS hold_unit,
 CASE CAST(p_partkey % 8 AS INTEGER) WHEN 0 THEN '°C' WHEN 1 THEN 'psi' WHEN 2 THEN 'rpm' WHEN 3 THEN '' WHEN 4 THEN '°' WHEN 5 THEN '' WHEN 6 THEN '' ELSE '' END AS ms_unit,
 CASE CAST(p_partkey % 8 AS INTEGER) WHEN 0 THEN '°C' WHEN 1 THEN 'bar' WHEN 2 THEN 'rpm' WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN '' ELSE '' END AS frame_unit,
 CASE CAST(p_partkey % 8 AS INTEGER) WHEN 7 THEN 'Gear (x)' WHEN 0 THEN 'oilTemp' WHEN 1 THEN 'boost' WHEN 2 THEN 'idleRpm' WHEN 3 THEN 'target' WHEN 4 THEN 'angle' WHEN 5 THEN 'torque' ELSE 'torque' END AS short_name,
 CASE CAST(p_partkey % 8 AS INTEGER) WHEN 7 THEN 'Gear (x)' ELSE NULL END AS full_header
FROM part""",
)
def units_by_name(spark, sf):
    paths = ["engine/oilTemp", "intake/boost", "idle/idleRpm", "dbw/target", "ignition/angle",
             "reduction/torque", "engine/torque", "Gear (x) (pos)"]
    part = tables.read_table(spark, sf, "part").select(
        "p_partkey",
        F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("p_partkey") % 8 + 1).cast("int")).alias("path"),
    )
    short = decode.path_name(F.col("path"))
    header, _ = decode.name_and_unit(F.col("path"))
    return part.select(
        "p_partkey",
        decode.unit_by_rules(decode.HOLDFILL_UNITS, short, F.col("path")).alias("hold_unit"),
        decode.unit_by_rules(decode.MSCLOCK_UNITS, short).alias("ms_unit"),
        decode.unit_by_rules(decode.FRAME_UNITS, short).alias("frame_unit"),
        F.when(F.col("p_partkey") % 8 == 7, header).otherwise(short).alias("short_name"),
        F.when(F.col("p_partkey") % 8 == 7, header).alias("full_header"),
    )
