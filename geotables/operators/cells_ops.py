"""Table jobs on geohash cells: point hashes, grid counts, precision from distance, covers, common prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.functions import cells


def with_point_geohash(df: DataFrame, lon: str = "lon", lat: str = "lat", chars: int = cells.MAX_CHARS,
                       out: str = "geohash") -> DataFrame:
    return df.selectExpr("*", f"{cells.geohash_sql(lon, lat, chars)} AS {out}")


def grid_count(df: DataFrame, chars: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Number of points per geohash cell of ``chars`` characters (partial aggregation before the shuffle)."""
    return df.selectExpr(f"{cells.geohash_sql(lon, lat, chars)} AS cell").groupBy("cell").agg(F.count("*").alias("n"))


def with_precision(df: DataFrame, distance: str = "distance", out: str = "precision") -> DataFrame:
    return df.selectExpr("*", f"{cells.precision_sql(distance)} AS {out}")


def cover(df: DataFrame, chars: int, cols: list[str] | None = None) -> DataFrame:
    """One row per geohash cell the envelope touches: ``cols`` + pos (row-major from the SW) + cell. The rows of the cover are
    exploded before its columns, so no row holds more than one line of cells."""
    cols = cols or ["oid"]
    ix = lambda v: cells.cell_ix_sql(v, chars)
    iy = lambda v: cells.cell_iy_sql(v, chars)
    c = df.where("xmin IS NOT NULL").selectExpr(
        *cols, f"{ix('xmin')} AS _x0", f"{ix('xmax')} AS _x1", f"{iy('ymin')} AS _y0", f"{iy('ymax')} AS _y1")
    c = c.selectExpr(*cols, "_x0", "_x1", "_y0", "explode(sequence(_y0, _y1)) AS _cy")
    c = c.selectExpr(*cols, "_x0", "_x1", "_y0", "_cy", "explode(sequence(_x0, _x1)) AS _cx")
    return c.selectExpr(*cols, "CAST((_cy - _y0) * (_x1 - _x0 + 1) + _cx - _x0 AS INT) AS pos",
                        f"{cells.geohash_of_cell_sql('_cx', '_cy', chars)} AS cell")


def cover_compat(df: DataFrame, chars: int, cols: list[str] | None = None,
                 target: tuple[str, str] = ("(xmin + xmax) / 2D", "(ymin + ymax) / 2D")) -> DataFrame:
    """Literal neighbour-case cover around the cell of a target point, given as two expressions over the row (by default the
    envelope's centre): 1, 2, 4 or 0 cells."""
    cols = cols or ["oid"]
    ix = lambda v: cells.cell_ix_sql(v, chars)
    iy = lambda v: cells.cell_iy_sql(v, chars)
    base = df.where("xmin IS NOT NULL").selectExpr(
        *cols, f"{ix(target[0])} AS tx", f"{iy(target[1])} AS ty",
        f"{ix('xmin')} AS x0", f"{iy('ymin')} AS y0", f"{ix('xmax')} AS x1", f"{iy('ymax')} AS y1")
    corners = {"LD": ("x0", "y0"), "LU": ("x0", "y1"), "RU": ("x1", "y1"), "RD": ("x1", "y0")}
    arr = cells.cover_compat_sql("tx", "ty", corners, chars)
    return base.selectExpr(*cols, f"posexplode({arr}) AS (pos, cell)")


def common_prefix(df: DataFrame, group_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Longest common prefix of each string column per group. The prefix of a set is the prefix of its smallest
    and largest member, so this is a min/max aggregate (partial aggregation, no collected lists) plus one scalar
    expression. NULLs are skipped; an all-NULL group gives NULL."""
    aggs = []
    for c in value_cols:
        aggs += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}")]
    g = df.groupBy(*group_cols).agg(*aggs)
    return g.selectExpr(*group_cols, *[f"{cells.common_prefix2_sql(f'_min_{c}', f'_max_{c}')} AS lcp_{c}"
                                       for c in value_cols])
