"""Lookup-table queries: parsing, resampling, table arithmetic, TSV text."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.frame import LOG, rounded
from telemetra.operators import binning, lookup
from telemetra.plans.catalog import LINES_CTE, query, r6
from telemetra.plans.q_stats import _hist_sql
from telemetra.sources import files, tables

TABLE = "table_id"


def flag_table_lines(spark, sf):
    """One text table per return flag: line number by tax percent, cells are counts."""
    lines = tables.read_table(spark, sf, "lineitem")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    counts = lines.groupBy(F.col("l_returnflag").alias(TABLE), F.col("l_linenumber").alias("y"), tax.alias("x")).agg(
        F.count(F.lit(1)).alias("n")
    )
    row = F.transform(
        F.sequence(F.lit(0), F.lit(8)), lambda i: F.format_number(F.coalesce(F.try_element_at("_m", i), F.lit(0)) * 1000, 0)
    )
    body = (
        counts.groupBy(TABLE, "y")
        .agg(F.map_from_entries(F.collect_list(F.struct("x", "n"))).alias("_m"))
        .select(TABLE, F.col("y").cast("long").alias("line_no"), F.concat_ws("\t", F.col("y").cast("string"), F.array_join(row, "\t")).alias("line"))
    )
    head = counts.select(TABLE).distinct().select(
        TABLE, F.lit(0).cast("long").alias("line_no"),
        F.lit("\t" + "\t".join(f"{i / 100:.2f}" for i in range(9))).alias("line"),
    )
    return body.unionByName(head)


_TABLE = """g AS (SELECT DISTINCT l_returnflag AS table_id FROM lineitem),
n AS (SELECT l_returnflag AS table_id, l_linenumber AS y, CAST(round(l_tax * 100) AS INTEGER) AS x, count(*) * 1000.0::DOUBLE AS v FROM lineitem GROUP BY ALL),
ys AS (SELECT table_id, y, row_number() OVER (PARTITION BY table_id ORDER BY y) - 1 AS r, count(*) OVER (PARTITION BY table_id) AS nr FROM (SELECT DISTINCT table_id, y FROM n)),
c AS (SELECT ys.table_id, ys.y, r, nr, CAST(i.x AS INTEGER) AS col, coalesce(n.v, 0) AS v FROM ys CROSS JOIN range(0, 9) i(x)
      LEFT JOIN n ON n.table_id = ys.table_id AND n.y = ys.y AND n.x = i.x)"""


@query(
    "lookup_table_parse",
    f"WITH {_TABLE} SELECT table_id, r AS row, col, v AS value, CAST(y AS DOUBLE) AS y_break, {r6('col / 100.0')} AS x_break FROM c",
)
def lookup_table_parse(spark, sf):
    t = files.parse_lookup_tables(flag_table_lines(spark, sf))
    long = t.select(
        TABLE, F.posexplode("data").alias("row", "_cells"), "x_breaks", "y_breaks"
    ).select(TABLE, "row", F.posexplode("_cells").alias("col", "value"), "x_breaks", "y_breaks")
    return long.select(
        TABLE, "row", "col", "value", F.get("y_breaks", F.col("row")).alias("y_break"),
        rounded(F.get("x_breaks", F.col("col"))).alias("x_break"),
    )


def _resample_sql(cols, rows):
    return f"""q AS (SELECT table_id, nr, CAST(tx AS INTEGER) AS x_bin, CAST(ty AS INTEGER) AS y_bin, tx * 8.0 / {cols - 1} AS sx, ty * (nr - 1.0) / {rows - 1} AS sy
  FROM (SELECT DISTINCT table_id, nr FROM ys), range(0, {cols}) a(tx), range(0, {rows}) b(ty)),
p AS (SELECT *, floor(sx) AS x0, least(floor(sx) + 1, 8) AS x1, floor(sy) AS y0, least(floor(sy) + 1, nr - 1) AS y1, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM q),
z AS (SELECT p.table_id, x_bin, y_bin, c00.v * (1 - fx) * (1 - fy) + c10.v * fx * (1 - fy) + c01.v * (1 - fx) * fy + c11.v * fx * fy AS v FROM p
  JOIN c c00 ON c00.table_id = p.table_id AND c00.col = x0 AND c00.r = p.nr - 1 - y0
  JOIN c c10 ON c10.table_id = p.table_id AND c10.col = x1 AND c10.r = p.nr - 1 - y0
  JOIN c c01 ON c01.table_id = p.table_id AND c01.col = x0 AND c01.r = p.nr - 1 - y1
  JOIN c c11 ON c11.table_id = p.table_id AND c11.col = x1 AND c11.r = p.nr - 1 - y1)"""


@query(
    "table_resample",
    f"WITH {_TABLE}, {_resample_sql(12, 10)} SELECT table_id, y_bin, x_bin, {r6('v')} AS value FROM z",
)
def table_resample(spark, sf):
    grid = lookup.resample(files.parse_lookup_tables(flag_table_lines(spark, sf)), 12, 10)
    return grid.withColumn("value", rounded(F.col("value")))


def _assignment(lines):
    """Suppliers use the tables A, N, R in turn."""
    flag = F.element_at(F.array(*[F.lit(f) for f in "ANR"]), (F.col(LOG) % 3 + 1).cast("int"))
    return lines.select(LOG).distinct().withColumn(TABLE, flag)


def _operation_sql(cols, rows):
    hist = _hist_sql(
        LINES_CTE, "l", "quantity", "discount", cols, rows, z="extendedprice",
        extra=f""", h AS (SELECT log_id, y_bin, x_bin, avg(z) AS v FROM d GROUP BY log_id, y_bin, x_bin),
{_TABLE}, {_resample_sql(cols, rows)},
a AS (SELECT DISTINCT l_suppkey AS log_id, substr('ANR', CAST(l_suppkey % 3 AS INTEGER) + 1, 1) AS table_id FROM lineitem),
o AS (SELECT a.log_id, z.y_bin, z.x_bin, z.v AS tv, h.v AS hv,
  CASE WHEN abs(z.v) < 2.220446049250313e-16 AND h.v IS NULL THEN NULL
       WHEN abs(z.v) > 2.220446049250313e-16 THEN coalesce(h.v, 0) / z.v ELSE 0 END AS v
  FROM a JOIN z ON z.table_id = a.table_id LEFT JOIN h ON h.log_id = a.log_id AND h.y_bin = z.y_bin AND h.x_bin = z.x_bin)
""",
    )
    return hist


@query(
    "table_operation",
    _operation_sql(8, 6)
    + f" SELECT log_id, y_bin, x_bin, {r6('tv')} AS table_value, {r6('hv')} AS hist_value, {r6('v', 9)} AS value FROM o",
)
def table_operation(spark, sf):
    """Mean price by quantity and discount, divided by each supplier's table."""
    lines = tables.line_values(spark, sf)
    t = files.parse_lookup_tables(flag_table_lines(spark, sf))
    cells = binning.hist2d(lines, "quantity", "discount", "extendedprice", 8, 6)
    out = lookup.combine(cells, lookup.resample(t, 8, 6), "divide", _assignment(lines))
    return out.select(
        LOG, "y_bin", "x_bin",
        *[rounded(F.col(c)).alias(c) for c in ("table_value", "hist_value")],
        rounded(F.col("value"), 9).alias("value"),
    )


def _tsv_sql(cells, cols, rows, xs, ys):
    """Lines of a grid given cell values v(log_id, y_bin, x_bin, v) and axes."""
    return f"""SELECT log_id, 0 AS line_no, chr(9) || string_agg(printf('%.1f', {xs}), chr(9) ORDER BY x) AS line
  FROM r, range(0, {cols}) i(x) GROUP BY log_id
UNION ALL SELECT r.log_id, CAST({rows} - y AS INTEGER), printf('%.1f', any_value({ys})) || chr(9) || string_agg(printf('%.2f', coalesce(v, 0)), chr(9) ORDER BY x)
  FROM r CROSS JOIN range(0, {cols}) i(x) CROSS JOIN range(0, {rows}) j(y)
  LEFT JOIN {cells} c ON c.log_id = r.log_id AND c.x_bin = x AND c.y_bin = y GROUP BY r.log_id, y"""


@query(
    "histogram_tsv",
    _hist_sql(
        LINES_CTE, "l", "quantity", "discount", 16, 16,
        extra=", w AS (SELECT log_id, y_bin, x_bin, count(*)::DOUBLE AS v FROM d GROUP BY log_id, y_bin, x_bin) "
        + _tsv_sql("w", 16, 16, "x_min + (x + 0.5) * (x_range / 16.0)", "y_min + (y + 0.5) * (y_range / 16.0)"),
    ),
)
def histogram_tsv(spark, sf):
    return lookup.histogram_lines(
        tables.line_values(spark, sf), "quantity", "discount", None, 16, 16
    )


@query(
    "table_result_tsv",
    _operation_sql(9, 7)
    + _tsv_sql("o", 9, 7, "x / 100.0", "(7 - y)::DOUBLE"),
)
def table_result_tsv(spark, sf):
    """A 9 by 7 grid matches the tables, so their breakpoints label it."""
    lines = tables.line_values(spark, sf)
    return lookup.operation_lines(
        lines, "quantity", "discount", "extendedprice", 9, 7,
        files.parse_lookup_tables(flag_table_lines(spark, sf)), "divide", _assignment(lines),
    )
