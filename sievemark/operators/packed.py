"""Packed cells to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.cells import cell_values
from sievemark.operators.records import first_delivery


def record_cells(df: DataFrame, table_name: str, key: str, fields: list[str], time: str = "imported_at") -> DataFrame:
    """``(table_name, record_id, field_name, cell)``: the packed cells of each record, once per record.

    The first delivery counts. Records without a key and cells that are null are left out. Other columns
    of ``df``, whatever their names, are not read.
    """
    first = first_delivery(df.select(key, time, *fields), key, time, *fields)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields]))
    return (
        first.select(F.lit(table_name).alias("table_name"), F.col(key).alias("record_id"), pairs.alias("p"))
        .select("table_name", "record_id", "p.field_name", "p.cell")
        .where(F.col("cell").isNotNull())
    )


def unpack(cells: DataFrame) -> DataFrame:
    """One row per value of ``cells.cell``: the other columns, ``pos`` (from 1) and ``item_value``.

    Cells are read by the tokenizer of ``functions.cells``. A cell without values has no row; equal
    values of a cell each have theirs.
    """
    rest = [c for c in cells.columns if c != "cell"]
    return cells.select(*rest, F.posexplode(cell_values(F.col("cell"))).alias("p", "item_value")).select(
        *rest, (F.col("p") + 1).cast("bigint").alias("pos"), "item_value"
    )
