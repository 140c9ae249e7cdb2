"""Lookup tables against binned grids: resampling, cell arithmetic, TSV text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.frame import EPSILON, LOG
from telemetra.functions.units import fixed_text
from telemetra.operators.binning import axis_bounds, hist2d

TABLE = "table_id"
OPERATIONS = ("add", "subtract", "multiply", "divide")


def resample(tables: DataFrame, columns: int, rows: int) -> DataFrame:
    """Bilinear resample of each table to a grid: table_id, y_bin, x_bin, value.

    ``tables`` has one row per table with the ``data`` row arrays, top row
    first; grid row 0 is the bottom.  Corners meet corners; a cell a short row
    lacks counts as 0.
    """
    source_rows = F.size("data")
    source_columns = F.size(F.get("data", 0))
    grid = (
        tables.filter((source_rows > 0) & (source_columns > 0))
        .withColumn("y_bin", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        .withColumn("x_bin", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    )

    def along(bin_name: str, count: Column, target: int) -> tuple[Column, Column, Column]:
        at = F.col(bin_name).cast("double") * (count - 1) / F.lit(float(max(target - 1, 1)))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, count - 1), at - low

    x0, x1, fx = along("x_bin", source_columns, columns)
    y0, y1, fy = along("y_bin", source_rows, rows)

    def cell(y: Column, x: Column) -> Column:
        return F.coalesce(F.get(F.get("data", source_rows - 1 - y), x), F.lit(0.0))

    top = cell(y0, x0) * (1.0 - fx) * (1.0 - fy) + cell(y0, x1) * fx * (1.0 - fy)
    value = top + cell(y1, x0) * (1.0 - fx) * fy + cell(y1, x1) * fx * fy
    return grid.select(TABLE, "y_bin", "x_bin", value.alias("value"))


def apply_operation(hist: Column, table: Column, operation: str) -> Column:
    """Cell arithmetic; an empty histogram cell counts as 0 unless both are empty."""
    if operation not in OPERATIONS:
        raise ValueError(f"operation must be one of {OPERATIONS}")
    h = F.coalesce(hist, F.lit(0.0))
    result = {
        "add": h + table,
        "subtract": h - table,
        "multiply": h * table,
        "divide": F.when(F.abs(table) > EPSILON, F.try_divide(h, table)).otherwise(F.lit(0.0)),
    }[operation]
    return F.when((F.abs(table) >= EPSILON) | hist.isNotNull(), result)


def combine(
    cells: DataFrame,
    grid: DataFrame,
    operation: str,
    assignment: DataFrame,
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Every grid cell of each log's table with the histogram cell under it.

    ``assignment`` says which table belongs to which log (log_id, table_id).
    """
    keys = list(keys)
    full = assignment.join(grid.withColumnRenamed("value", "table_value"), TABLE)
    hist = cells.select(*keys, "y_bin", "x_bin", F.col("value").alias("hist_value"))
    both = full.join(hist, [*keys, "y_bin", "x_bin"], "left")
    return both.withColumn(
        "value", apply_operation(F.col("hist_value"), F.col("table_value"), operation)
    )


def _tab_line(label: Column, numbers: Column, places: int) -> Column:
    """Label and numbers as one tab line."""
    shown = F.transform(numbers, lambda v: fixed_text(v, places))
    return F.array_join(F.concat(F.array(label), shown), "\t")


def grid_lines(
    cells: DataFrame,
    bounds: DataFrame,
    columns: int,
    rows: int,
    breaks: DataFrame | None = None,
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Text lines of each log's grid: keys, line_no, line.

    Line 0 lists the column centres, then come the rows from top to bottom,
    each led by its centre; empty cells print 0.  ``breaks`` (keys, x_breaks,
    y_breaks) replaces the centres of an axis whose length it matches.
    """
    keys = list(keys)

    def centres(axis: str, bins: int) -> Column:
        low, step = F.col(f"{axis}_min"), F.col(f"{axis}_range") / F.lit(float(bins))
        return F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: low + (i + F.lit(0.5)) * step
        )

    axes = bounds.withColumns({"_xs": centres("x", columns), "_ys": centres("y", rows)})
    if breaks is not None:
        axes = axes.join(breaks, keys, "left").withColumns(
            {
                "_xs": F.when(F.size("x_breaks") == columns, F.col("x_breaks")).otherwise(
                    F.col("_xs")
                ),
                "_ys": F.when(F.size("y_breaks") == rows, F.reverse("y_breaks")).otherwise(
                    F.col("_ys")
                ),
            }
        )
    axes = axes.select(*keys, "_xs", "_ys")
    head = axes.select(
        *keys, F.lit(0).alias("line_no"), _tab_line(F.lit(""), F.col("_xs"), 1).alias("line")
    )
    filled = cells.groupBy(*keys, "y_bin").agg(
        F.map_from_entries(F.collect_list(F.struct("x_bin", "value"))).alias("_cells")
    )
    body = (
        axes.select(*keys, F.posexplode("_ys").alias("y_bin", "_y"))
        .join(filled, [*keys, "y_bin"], "left")
    )
    row = F.transform(
        F.sequence(F.lit(0), F.lit(columns - 1)),
        lambda i: F.coalesce(F.try_element_at("_cells", i), F.lit(0.0)),
    )
    body = body.select(
        *keys,
        (F.lit(rows) - F.col("y_bin")).alias("line_no"),
        _tab_line(fixed_text(F.col("_y"), 1), row, 2).alias("line"),
    )
    return head.unionByName(body)


def histogram_lines(
    df: DataFrame,
    x: str,
    y: str,
    z: str | None,
    columns: int,
    rows: int,
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Text grid of a histogram: no sample filters, outside samples in edge cells."""
    cells = hist2d(df, x, y, z, columns, rows, x_limits, y_limits, clamp_outside=True, keys=keys)
    bounds = axis_bounds(df, x, y, x_limits, y_limits, keys)
    return grid_lines(cells, bounds, columns, rows, keys=keys)


def operation_lines(
    df: DataFrame,
    x: str,
    y: str,
    z: str | None,
    columns: int,
    rows: int,
    tables: DataFrame,
    operation: str,
    assignment: DataFrame,
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Text grid of histogram <operation> table, with the table's own breakpoints."""
    cells = hist2d(df, x, y, z, columns, rows, x_limits, y_limits, clamp_outside=True, keys=keys)
    bounds = axis_bounds(df, x, y, x_limits, y_limits, keys)
    result = combine(cells, resample(tables, columns, rows), operation, assignment, keys)
    breaks = assignment.join(tables.select(TABLE, "x_breaks", "y_breaks"), TABLE).drop(TABLE)
    shown = result.filter(F.col("value").isNotNull())
    return grid_lines(shown, bounds, columns, rows, breaks, keys)


def write_lines(lines: DataFrame, path: str, key: str = LOG) -> None:
    """One text folder per log, its lines in order."""
    (
        lines.repartition(key)
        .sortWithinPartitions(key, "line_no")
        .select(key, "line")
        .write.partitionBy(key)
        .text(path)
    )
