"""Tables as long cells and back, and the profile of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.values import kind


def unpivot(df: DataFrame, row: Column, columns: list[str] | None = None) -> DataFrame:
    """row_index, column_index (from 0), header and decoded (text, null kept) of every cell: one pass, no shuffle."""
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("header"), df[c].cast("string").alias("decoded")) for i, c in enumerate(columns)])
    return df.select(row.alias("row_index"), F.explode(cells).alias("c")).select("row_index", "c.column_index", "c.header", "c.decoded")


def typed_cells(cells: DataFrame) -> DataFrame:
    """Cells with their kind and the hash of their text."""
    text = F.coalesce("decoded", F.lit(""))
    return cells.select("*", kind(text).alias("kind"), F.sha2(text, 256).alias("text_sha256"))


def pivot(cells: DataFrame, headers: list[str], row: str = "row_index") -> DataFrame:
    """Rows again: one conditional aggregate for each header, absent cells null."""
    return cells.where(F.col("header").isin(headers)).groupBy(row).agg(*[F.min(F.when(F.col("header") == h, F.col("decoded"))).alias(h) for h in headers])


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """non_empty, empty and null counts of each column: one aggregate over the rows, then as many rows as columns."""
    columns = columns or df.columns
    counts = []
    for c in columns:
        text = df[c].cast("string")
        counts += [F.count_if(text != "").alias(f"{c}.n"), F.count_if(text == "").alias(f"{c}.e"), F.count_if(text.isNull()).alias(f"{c}.0")]
    row = df.agg(*counts)
    each = F.array(*[F.struct(F.lit(c).alias("header"), F.col(f"`{c}.n`").alias("non_empty"), F.col(f"`{c}.e`").alias("empty"), F.col(f"`{c}.0`").alias("nulls")) for c in columns])
    return row.select(F.explode(each).alias("p")).select("p.*")


def preview_with_flag(cells: DataFrame, rows: int = 20, columns: int = 20) -> DataFrame:
    """The bounded preview, and whether it leaves anything out: one row of bounds, not a second look at the cells."""
    beyond = cells.agg(F.coalesce(F.max((F.col("row_index") >= rows) | (F.col("column_index") >= columns)), F.lit(False)).alias("truncated"))
    return bounded_preview(cells, rows, columns).join(F.broadcast(beyond))


def bounded_preview(cells: DataFrame, rows: int = 20, columns: int = 20) -> DataFrame:
    """The cells of the first rows and columns by their index."""
    return cells.where((F.col("row_index") < rows) & (F.col("column_index") < columns))
