"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def class_lines(df: DataFrame, oid: str = "oid", cls: str = "pd_class") -> DataFrame:
    """``(oid,class)`` text per row, the tuple form of the overlay output; a NULL class prints as ``null``."""
    return df.selectExpr(f"concat('(', {oid}, ',', coalesce({cls}, 'null'), ')') AS value")


def write_class_text(df: DataFrame, path: str, oid: str = "oid", cls: str = "pd_class") -> None:
    class_lines(df, oid, cls).write.mode("overwrite").text(path)
