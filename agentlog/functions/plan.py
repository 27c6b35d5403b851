"""Plan shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BROADCAST_BYTES = 64 << 20


def broadcast_up_to(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, marked for broadcast if its counted rows of this size are within the limit."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def computed_once(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same rows, with filters kept above the computed columns.

    A filter on a computed column is otherwise rewritten down to the scan with all the expressions it rests on copied
    into it, which multiplies with every layer of columns. Rows of a generator are not rewritten that way.
    """
    return df.select(F.inline(F.array(F.struct(*(columns or df.columns)))))
