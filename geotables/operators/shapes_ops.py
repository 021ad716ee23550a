"""Table jobs over the geometry column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_vertices(df: DataFrame) -> DataFrame:
    """One row per vertex: the input columns (minus rings) plus part, ring, pos (0-based), x, y."""
    keep = [c for c in df.columns if c != "rings"]
    r = df.select(*keep, F.explode("rings").alias("_r"))
    v = r.select(*keep, F.col("_r.part").alias("part"), F.col("_r.ring").alias("ring"),
                 F.posexplode("_r.pts").alias("pos", "_p"))
    return v.select(*keep, "part", "ring", "pos", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
