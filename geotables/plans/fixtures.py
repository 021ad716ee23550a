"""Feature tables generated from the driver tables.

Coordinates sit on a 1/64-degree grid (exact in binary) and are computed from integer keys, so the same recipe
can be written in SQL for the oracle. Every fixture grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotables.functions.shapes import point_sql as P
from geotables.functions.shapes import ring_sql
from geotables.model import finish_features
from geotables.session import table_path


# Columns of the driver tables the fixtures use. Reading with a given schema skips footer inference and prunes
# the scan to these columns.
SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "supplier": "s_suppkey BIGINT",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE",
    "nation": "n_nationkey INT",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def generator_keys(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The key column a fixture is generated from, spread round-robin over the cluster's task slots (as
    ``spark.range(n, numPartitions)`` would): the driver tables are single small files, and the features
    generated from them are much wider than the keys."""
    return read(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def _grid(k: str, mul: int, mod: int) -> str:
    return f"(({k} * {mul} % {mod}) % 256) / 64D"


def _pad(k: str, n: int) -> str:
    """The key in at least ``n`` digits; longer keys stay whole."""
    return f"lpad(CAST({k} AS STRING), greatest({n}, length(CAST({k} AS STRING))), '0')"


def _place(block: str) -> dict[str, str]:
    """Where the block of a key lies: blocks are laid out ten by ten, six degrees apart, and a hundred of them share a
    region code, so the features of a place do not grow in number with the table."""
    return {"x": f"({block} % 10) * 6D", "y": f"(({block} div 10) % 10) * 6D", "region": f"CAST(11000 + {block} div 100 AS STRING)"}


PARCEL_BLOCK, ZONE_BLOCK = _place("((k - 1) div 20000)"), _place("((k - 1) div 1000)")


RECT = [P("x", "y"), P("x + w", "y"), P("x + w", "y + h"), P("x", "y + h"), P("x", "y")]
TRIANGLE = [P("x", "y"), P("x + w", "y"), P("x", "y + h"), P("x", "y")]
L_SHAPE = [P("x", "y"), P("x + w", "y"), P("x + w", "y + h / 2D"), P("x + w / 2D", "y + h / 2D"),
           P("x + w / 2D", "y + h"), P("x", "y + h"), P("x", "y")]
HOLE = [P("x + w / 4D", "y + h / 4D"), P("x + w / 4D", "y + 3 * h / 4D"), P("x + 3 * w / 4D", "y + 3 * h / 4D"),
        P("x + 3 * w / 4D", "y + h / 4D"), P("x + w / 4D", "y + h / 4D")]

PARCEL_RINGS = (f"CASE kind WHEN 0 THEN array({ring_sql(0, 0, RECT)}) "
                f"WHEN 1 THEN array({ring_sql(0, 0, TRIANGLE)}) "
                f"WHEN 2 THEN array({ring_sql(0, 0, L_SHAPE)}) "
                f"ELSE array({ring_sql(0, 0, RECT)}, {ring_sql(0, 1, HOLE)}) END")
ZONE_RINGS = f"CASE kind WHEN 0 THEN array({ring_sql(0, 0, RECT)}) ELSE array({ring_sql(0, 0, TRIANGLE)}) END"
BOX_ENVELOPE = ["x AS xmin", "y AS ymin", "x + w AS xmax", "y + h AS ymax"]  # every shape spans its whole box


def parcel_parts(part: DataFrame) -> DataFrame:
    """(k, oid, tags, kind, x, y, w, h) for parcels, one per ``part`` row."""
    return part.selectExpr("CAST(p_partkey AS BIGINT) AS k").selectExpr(
        "k",
        f"concat({PARCEL_BLOCK['region']}, CAST(k % 3 AS STRING), {_pad('k', 7)}) AS oid",
        "concat('{\"DLBM\":\"', CAST(k % 9 AS STRING), '\"}') AS tags",
        "CAST(k % 4 AS INT) AS kind",
        f"110D + {PARCEL_BLOCK['x']} + {_grid('k', 7919, 10007)} AS x",
        f"30D + {PARCEL_BLOCK['y']} + {_grid('k', 10473, 10009)} AS y",
        "(k % 7 + 4) / 64D AS w",
        "(k % 5 + 4) / 64D AS h")


def parcels(spark: SparkSession, sf_dir: str, shrink: int = 0) -> DataFrame:
    """Land parcels from ``part``: rectangles, right triangles, L-shapes and rectangles with a hole. ``shrink`` divides
    their sides by a power of two (12 makes them a few metres wide)."""
    p = parcel_parts(generator_keys(spark, sf_dir, "part"))
    if shrink:
        p = p.withColumns({c: F.col(c) / float(1 << shrink) for c in ("w", "h")})
    df = p.selectExpr("oid", "tags", "'POLYGON' AS gtype", f"{PARCEL_RINGS} AS rings", *BOX_ENVELOPE)
    return finish_features(df)


def zone_parts(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr("CAST(s_suppkey AS BIGINT) AS k").selectExpr(
        "k",
        f"concat({ZONE_BLOCK['region']}, CAST(k % 3 AS STRING), 'Z', {_pad('k', 5)}) AS oid",
        "CASE WHEN k % 11 = 10 THEN '{\"other\":\"x\"}' "
        "ELSE concat('{\"PDJB\":\"', CAST(k % 5 + 1 AS STRING), '\"}') END AS tags",
        "CAST((k div 3) % 2 AS INT) AS kind",
        f"110D + {ZONE_BLOCK['x']} + {_grid('k', 6271, 10007)} AS x",
        f"30D + {ZONE_BLOCK['y']} + {_grid('k', 3571, 10009)} AS y",
        "(k % 5 * 8 + 16) / 64D AS w",
        "(k % 4 * 8 + 16) / 64D AS h")


def zones(spark: SparkSession, sf_dir: str, widen: int = 0) -> DataFrame:
    """Slope zones from ``supplier``: rectangles and right triangles; every 11th has no PDJB tag. ``widen`` adds
    (key % 1024) / 2^widen degrees to the width."""
    z = zone_parts(read(spark, sf_dir, "supplier"))
    if widen:
        z = z.withColumn("w", F.expr(f"w + (k % 1024) / {float(1 << widen)!r}D"))
    return finish_features(z.selectExpr("oid", "tags", "'POLYGON' AS gtype", f"{ZONE_RINGS} AS rings", *BOX_ENVELOPE))


def point_parts(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "CAST(c_custkey AS BIGINT) AS k",
        "concat('22000', CAST(c_custkey % 4 AS STRING), CAST(c_custkey AS STRING)) AS oid",
        "(CAST(c_custkey AS BIGINT) * 7919) % 36000 / 100D - 180D AS lon",
        "(CAST(c_custkey AS BIGINT) * 10473) % 18000 / 100D - 90D AS lat",
        "c_nationkey AS nationkey", "c_acctbal AS distance")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features from ``customer`` spread over the whole globe; keeps nationkey and distance columns."""
    p = point_parts(generator_keys(spark, sf_dir, "customer"))
    df = p.selectExpr("oid", "'{}' AS tags", "'POINT' AS gtype", f"array({ring_sql(0, 0, [P('lon', 'lat')])}) AS rings",
                      "lon AS xmin", "lat AS ymin", "lon AS xmax", "lat AS ymax", "lon", "lat", "nationkey", "distance")
    return finish_features(df)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query windows from ``nation``: 0.5-degree squares on a 0.75-degree lattice over the parcel area."""
    return read(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS INT) AS window_id",
        "110D + (n_nationkey % 5) * 0.75D AS xmin", "30D + (n_nationkey div 5) * 0.75D AS ymin",
        "110D + (n_nationkey % 5) * 0.75D + 0.5D AS xmax", "30D + (n_nationkey div 5) * 0.75D + 0.5D AS ymax")


def straddling_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from ``nation`` across longitude 0: their corners share no geohash character."""
    b = read(spark, sf_dir, "nation").selectExpr(
        "concat('B', CAST(n_nationkey AS STRING)) AS oid", "'{}' AS tags", "'POLYGON' AS gtype",
        "-(n_nationkey + 1) / 64D AS x", "n_nationkey / 64D - 1D AS y", "(n_nationkey + 1) / 32D AS w", "0.25D AS h")
    return finish_features(b.selectExpr("oid", "tags", "gtype", f"array({ring_sql(0, 0, RECT)}) AS rings", *BOX_ENVELOPE))
