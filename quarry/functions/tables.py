"""Tables of cells as Markdown, by array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import native_cell


def width(rows: Column) -> Column:
    """The largest number of cells in a row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def grid_rows(grid: Column) -> Column:
    """Rows of text from a grid of (text, start_row, start_col) cells: a merged cell shows once, where it starts."""
    shown = F.transform(grid, lambda row, r: F.transform(row, lambda cell, c: F.when((cell.start_row == r) & (cell.start_col == c), native_cell(F.coalesce(cell.text, F.lit("")))).otherwise("")))
    return F.filter(shown, lambda row: F.exists(row, lambda x: x != ""))


def markdown(rows: Column) -> Column:
    """Rows of text as a Markdown table: padded to one width, the first the header. '' without rows."""
    wide = width(rows)
    line = F.transform(rows, lambda row: F.concat(F.lit("| "), F.array_join(F.concat(row, F.array_repeat(F.lit(""), wide - F.size(row))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), wide))
    body = F.concat(F.slice(line, 1, 1), F.array(rule), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))))
    return F.when(F.size(rows) <= 0, "").otherwise(F.array_join(body, "\n"))


def captioned(caption: Column, table: Column) -> Column:
    """Caption and table with a blank line between, of what there is."""
    return F.concat_ws("\n\n", F.nullif(caption, F.lit("")), F.nullif(table, F.lit("")))
