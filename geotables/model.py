"""The canonical feature table.

    key     STRING   cell || '_' || oid
    oid     STRING
    tags    STRING   JSON object text
    gtype   STRING   POINT | LINESTRING | POLYGON | MULTIPOINT | MULTILINESTRING | MULTIPOLYGON
    rings   ARRAY<STRUCT<part INT, ring INT, pts ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>
    xmin, ymin, xmax, ymax DOUBLE   envelope, NULL when empty
    cell    STRING   common geohash prefix of the envelope corners ('' allowed)
    region  STRING   first 6 characters of the part of oid before the first '_'
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from geotables.functions import cells, shapes

FEATURE_COLUMNS = ["key", "oid", "tags", "gtype", "rings", "xmin", "ymin", "xmax", "ymax", "cell", "region"]
ENVELOPE = ["xmin", "ymin", "xmax", "ymax"]


def region_sql(oid: str = "oid") -> str:
    return f"substring(split_part({oid}, '_', 1), 1, 6)"


def finish_features(df: DataFrame) -> DataFrame:
    """From (oid, tags, gtype, rings, ...) add envelope, cell, region and key; keeps extra columns at the end.
    An envelope already present (xmin, ymin, xmax, ymax) is kept instead of being derived from the rings."""
    base = ("oid", "tags", "gtype", "rings", *ENVELOPE)
    extra = [c for c in df.columns if c not in base]
    if "xmin" not in df.columns:
        df = df.selectExpr("*", f"{shapes.envelope_struct_sql('rings')} AS _env") \
            .selectExpr("*", "_env.xmin AS xmin", "_env.ymin AS ymin", "_env.xmax AS xmax", "_env.ymax AS ymax")
    df = df.selectExpr("oid", "tags", "gtype", "rings", *ENVELOPE, *extra)
    df = df.selectExpr("*", f"{cells.envelope_cell_sql()} AS cell", f"{region_sql()} AS region")
    return df.selectExpr("concat_ws('_', cell, oid) AS key", *FEATURE_COLUMNS[1:], *extra)
