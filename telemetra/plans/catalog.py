"""Named queries over the shared tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; ``sql`` is the equivalent statement for a SQL engine."""

    def register(build: Builder) -> Builder:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} is registered twice")
        ENTRIES[name] = Entry(name, build, sql)
        return build

    return register


# The table views of telemetra.sources.tables, as SQL.
EVENTS_CTE = """e AS (
  SELECT user_id AS log_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         count(*) OVER (PARTITION BY user_id) AS n,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t,
         value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k
  FROM events)"""

STREAM_CTE = """e AS (
  SELECT CAST(0 AS BIGINT) AS log_id,
         row_number() OVER (ORDER BY ts, event_id) - 1 AS idx,
         count(*) OVER () AS n,
         (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 AS t,
         value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k
  FROM events)"""

LINES_CTE = """l AS (
  SELECT l_suppkey AS log_id,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1 AS idx,
         count(*) OVER (PARTITION BY l_suppkey) AS n,
         l_quantity AS quantity, l_extendedprice AS extendedprice,
         l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

ORDERS_CTE = """o AS (
  SELECT o_custkey AS log_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
         epoch_us(o_orderdate) / 1e6 AS t, o_totalprice AS totalprice
  FROM orders)"""


def r6(expr: str, places: int = 6) -> str:
    """SQL twin of telemetra.frame.rounded."""
    return f"(round(({expr}) + {0.003 * 10.0**-places!r}, {places}) + 0.0)"
