"""Query catalog: every registered query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or data
Spark derives from them), with an equivalent DuckDB SQL text where the semantics are expressible in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from geotables.model import FEATURE_COLUMNS
from geotables.operators import range_query as rq
from geotables.plans import catalog_rings  # noqa: F401  (registers its queries)
from geotables.plans import fixtures as fx
from geotables.plans import oracle_sql as O
from geotables.plans.registry import ORACLE, QUERIES, register

# The headline window: FIXTURES.md counts parcels with a vertex in it.
WINDOW = (111.0, 31.0, 112.0, 32.0)
WINDOW_TEXT = "111,31,112,32"


# ------------------------------------------------------------------ range queries

@register("range_query", O.with_ctes(O.PARCELS) + f"""
SELECT DISTINCT v.oid FROM ({O.vertices('parcel_rings')}) v
WHERE v.x BETWEEN 111{O.D} AND 112{O.D} AND v.y BETWEEN 31{O.D} AND 32{O.D}""")
def q_range_query(spark, sf_dir):
    return rq.range_query(fx.parcels(spark, sf_dir), *WINDOW).select("oid")


@register("range_query_csv_compat", O.with_ctes(O.PARCELS) + f"""
SELECT DISTINCT v.oid FROM ({O.vertices('parcel_rings')}) v
WHERE v.x BETWEEN 31{O.D} AND 111{O.D} AND v.y BETWEEN 32{O.D} AND 112{O.D}""")
def q_range_query_csv_compat(spark, sf_dir):
    # the literal job reads "x1,y1,x2,y2" into an envelope ordered (x1, x2, y1, y2)
    return rq.range_query(fx.parcels(spark, sf_dir), *rq.parse_window(WINDOW_TEXT, compat=True)).select("oid")


@register("range_query_many", O.with_ctes(O.PARCELS, O.WINDOWS) + f"""
SELECT DISTINCT w.window_id, v.oid FROM ({O.vertices('parcel_rings')}) v JOIN windows w
  ON v.x BETWEEN w.xmin AND w.xmax AND v.y BETWEEN w.ymin AND w.ymax""")
def q_range_query_many(spark, sf_dir):
    return rq.range_query_many(fx.parcels(spark, sf_dir), fx.windows(spark, sf_dir))


# ------------------------------------------------------------------ shapes, tags

@register("area", O.with_ctes(O.PARCELS) + f"""
SELECT a.oid, round(a.area, 9) AS area FROM ({O.ring_area_sql('parcel_rings')}) a""")
def q_area(spark, sf_dir):
    from geotables.functions.shapes import area_sql
    return fx.parcels(spark, sf_dir).selectExpr("oid", f"round({area_sql()}, 9) AS area")


@register("envelope", O.with_ctes(O.PARCELS) + """
SELECT v.oid, min(v.x) AS xmin, min(v.y) AS ymin, max(v.x) AS xmax, max(v.y) AS ymax
FROM (""" + O.vertices('parcel_rings') + """) v GROUP BY v.oid""")
def q_envelope(spark, sf_dir):
    from geotables.functions.shapes import envelope_sql
    # derived from the vertices, not from the generator's box
    return fx.parcels(spark, sf_dir).selectExpr("oid", *envelope_sql("rings"))


@register("vertices", O.with_ctes(O.PARCELS) + f"""
SELECT v.oid, v.ring::INTEGER AS ring, (v.pos - 1)::INTEGER AS pos, v.x, v.y FROM ({O.vertices('parcel_rings')}) v""")
def q_vertices(spark, sf_dir):
    from geotables.operators.shapes_ops import explode_vertices
    return explode_vertices(fx.parcels(spark, sf_dir)).select("oid", "ring", "pos", "x", "y")


@register("tag_extract", O.with_ctes(O.ZONES) + """
SELECT oid, pd_class FROM zones""")
def q_tag_extract(spark, sf_dir):
    from geotables.functions.tags import tag_sql
    return fx.zones(spark, sf_dir).selectExpr("oid", f"{tag_sql('tags', 'PDJB')} AS pd_class")


# ------------------------------------------------------------------ overlay

def _overlay(spark, sf_dir):
    return fx.parcels(spark, sf_dir), fx.zones(spark, sf_dir)


# Fixture areas are dyadic: many end in a 5 just behind the places told. A fixed fraction of the last place is added on
# both sides, so that the order in which terms were summed can't decide how they are rounded.
AREA = "round(overlap_area + 1.2345e-10D, 9) AS overlap_area"
_PAIRS_SQL = f"SELECT p_oid, z_oid, round(overlap_area + 1.2345e-10, 9) AS overlap_area FROM scored"


@register("overlay_pairs", O.overlay_all() + f"""
SELECT p_oid, z_oid, z_class, round(overlap_area + 1.2345e-10, 9) AS overlap_area FROM scored""")
def q_overlay_pairs(spark, sf_dir):
    from geotables.operators.overlay import overlay_pairs
    return overlay_pairs(*_overlay(spark, sf_dir)).selectExpr("p_oid", "z_oid", "z_class", AREA)


@register("overlay_pairs_grid", O.overlay_all() + _PAIRS_SQL)
def q_overlay_pairs_grid(spark, sf_dir):
    from geotables.operators.overlay import overlay_pairs
    return overlay_pairs(*_overlay(spark, sf_dir), strategy="grid").selectExpr("p_oid", "z_oid", AREA)


@register("prefix_join", O.overlay_all() + """
SELECT p_oid, z_oid FROM cand WHERE starts_with(p_cell, z_cell) OR starts_with(z_cell, p_cell)""")
def q_prefix_join(spark, sf_dir):
    from geotables.operators.overlay import candidate_pairs, overlay_inputs
    p, z = overlay_inputs(*_overlay(spark, sf_dir), "PDJB", edges=False)
    return candidate_pairs(p, z, "prefix").select("p_oid", "z_oid")


@register("overlap_area", O.overlay_all() + _PAIRS_SQL + " WHERE hit")
def q_overlap_area(spark, sf_dir):
    from geotables.operators.overlay import OVERLAPS, overlay_pairs
    return overlay_pairs(*_overlay(spark, sf_dir)).where(OVERLAPS).selectExpr("p_oid", "z_oid", AREA)


@register("overlay_classes", O.overlay_all() + O.best_of("scored"))
def q_overlay_classes(spark, sf_dir):
    from geotables.operators.overlay import overlay_classes
    return overlay_classes(*_overlay(spark, sf_dir)).selectExpr("oid", "pd_class", AREA)


# areas of parcels a few metres wide are told in units of 1e-12 square degrees
SMALL = 12


@register("overlay_classes_small", O.overlay_all(O.shrunk_parcels(SMALL), share=O.SMALL_SHARE) + O.best_of(
    "scored", digits="round(coalesce(b.{a}, 0::DOUBLE) * 1e12 + 0.0012345, 2)", share=O.SMALL_SHARE))
def q_overlay_classes_small(spark, sf_dir):
    """Parcels whose sides are divided by 4096: overlaps far below 1e-9 square degrees decide."""
    from geotables.operators.overlay import overlay_classes
    out = overlay_classes(fx.parcels(spark, sf_dir, shrink=SMALL), fx.zones(spark, sf_dir))
    return out.selectExpr("oid", "pd_class", "round(overlap_area * 1e12D + 0.0012345D, 2) AS overlap_area")


@register("overlay_classes_near_ties", O.overlay_all(zones=O.shifted_zones(30)) + O.best_of("scored"))
def q_overlay_classes_near_ties(spark, sf_dir):
    """Zones widened by key * 2^-30 degrees: equal overlaps become differences that rounding to nine places hides."""
    from geotables.operators.overlay import overlay_classes
    return overlay_classes(fx.parcels(spark, sf_dir), fx.zones(spark, sf_dir, widen=30)).selectExpr("oid", "pd_class", AREA)


@register("overlay_classes_compat", O.with_ctes(
    O.PARCELS, O.ZONES, O.CANDIDATES, f"za AS ({O.ring_area_sql('zone_rings')})",
    """scored AS (SELECT c.*, za.area AS own_area, 0 AS p_area, true AS hit FROM cand c JOIN za ON za.k = c.zk
                  WHERE contains(c.p_cell, c.z_cell) OR contains(c.z_cell, c.p_cell))""")
    + O.best_of("scored", "own_area"))
def q_overlay_classes_compat(spark, sf_dir):
    from geotables.operators.overlay import overlay_classes
    return overlay_classes(*_overlay(spark, sf_dir), compat=True).selectExpr("oid", "pd_class", AREA)


@register("merge_best", O.overlay_all() + O.best_of("scored"))
def q_merge_best(spark, sf_dir):
    # two zone batches (even / odd supplier key) overlaid separately, then merged
    from geotables.operators.overlay import merge_best, overlay_classes
    parcels, zones = _overlay(spark, sf_dir)
    odd = "CAST(substring(oid, -1, 1) AS INT) % 2 = 1"
    a = overlay_classes(parcels, zones.where(f"NOT ({odd})"), keep_zone_key=True)
    b = overlay_classes(parcels, zones.where(odd), keep_zone_key=True)
    return merge_best(a, b).selectExpr("oid", "pd_class", AREA)


@register("overlay_stats", O.overlay_all() + f"""
SELECT (SELECT count(*) FROM parcels) AS n_parcels, (SELECT count(*) FROM zones) AS n_zones,
       (SELECT count(*) FROM zones WHERE pd_class IS NULL) AS n_zones_no_tag,
       (SELECT count(*) FROM scored) AS n_pairs,
       (SELECT count(*) FROM scored WHERE hit) AS n_pairs_positive,
       (SELECT count(DISTINCT pk) FROM scored WHERE hit) AS n_parcels_matched,
       ceil((SELECT count(*) FROM zones) / 4{O.D})::BIGINT AS batch_size""")
def q_overlay_stats(spark, sf_dir):
    from geotables.operators.overlay import overlay_stats
    return overlay_stats(*_overlay(spark, sf_dir), batches=4)


@register("overlay_counts", ORACLE["overlay_stats"].replace("ceil((SELECT count(*) FROM zones) / 4::DOUBLE)::BIGINT AS batch_size",
                                                            "(SELECT count(*) FROM parcels) AS n_classes"))
def q_overlay_counts(spark, sf_dir):
    """The same counts, gathered while the classes are computed and written; and the classes written."""
    from geotables.operators.counts import overlay_with_counts
    from geotables.session import scratch_path
    path = scratch_path(spark, "classes")
    classes, counts = overlay_with_counts(*_overlay(spark, sf_dir))
    classes.write.parquet(path)
    found = ", ".join(f"{n}L AS {c}" for c, n in counts.get().items())
    return spark.read.schema(classes.schema).parquet(path).selectExpr("count(*) AS n_classes").selectExpr(*found.split(", "), "n_classes")


@register("ingest_counts", O.with_ctes(O.PARCELS) + """
SELECT count(*) AS n_lines, count(*) FILTER (WHERE k % 50 = 7) AS n_skipped, count(*) FILTER (WHERE k % 50 <> 7) AS n_rows,
       count(*) FILTER (WHERE k % 50 IN (13, 21, 33)) AS n_rejected FROM parcels""")
def q_ingest_counts(spark, sf_dir):
    """Lines, skipped and rejected ones, counted while the parsed rows are written."""
    from geotables.operators.counts import ingest_with_counts
    from geotables.session import scratch_path
    path = scratch_path(spark, "parsed")
    rows, counts = ingest_with_counts(parcel_lines(spark, sf_dir))
    rows = rows.select("oid", "gtype", "rings", "why")
    rows.write.parquet(path)
    found = [f"{n}L AS {c}" for c, n in counts.get().items() if c != "n_rows"]
    return spark.read.schema(rows.schema).parquet(path).selectExpr("count(*) AS n_rows").selectExpr("n_rows", *found)


# ------------------------------------------------------------------ geohash cells

GRID_CHARS = 2
COVER_CHARS = 5


@register("geohash_points", O.with_ctes(O.POINTS) + f"""
SELECT oid, {O.geohash_of_morton('m')} AS geohash FROM points""")
def q_geohash_points(spark, sf_dir):
    from geotables.operators.cells_ops import with_point_geohash
    return with_point_geohash(fx.points(spark, sf_dir)).select("oid", "geohash")


@register("grid_count", O.with_ctes(O.POINTS) + f"""
SELECT {O.geohash_of_morton('m', GRID_CHARS)} AS cell, count(*) AS n FROM points GROUP BY 1""")
def q_grid_count(spark, sf_dir):
    from geotables.operators.cells_ops import grid_count
    return grid_count(fx.points(spark, sf_dir), GRID_CHARS)


@register("grid_precision", O.with_ctes(O.POINTS) + f"""
SELECT oid, {O.precision('distance')} AS precision FROM points""")
def q_grid_precision(spark, sf_dir):
    from geotables.operators.cells_ops import with_precision
    return with_precision(fx.points(spark, sf_dir)).select("oid", "precision")


@register("geometry_cell", O.with_ctes(O.ZONES) + """
SELECT oid, cell FROM zones""")
def q_geometry_cell(spark, sf_dir):
    return fx.zones(spark, sf_dir).select("oid", "cell")


@register("feature_key", O.with_ctes(O.PARCELS) + """
SELECT oid, cell || '_' || oid AS key, cell, region FROM parcels""")
def q_feature_key(spark, sf_dir):
    return fx.parcels(spark, sf_dir).select("oid", "key", "cell", "region")


@register("cover", O.with_ctes(O.PARCELS) + f"""
SELECT oid, ((cy - {O.cell_iy('ymin', COVER_CHARS)}) * ({O.cell_ix('xmax', COVER_CHARS)} - {O.cell_ix('xmin', COVER_CHARS)} + 1)
             + (cx - {O.cell_ix('xmin', COVER_CHARS)}))::INTEGER AS pos,
       {O.geohash_of_cell('cx', 'cy', COVER_CHARS)} AS cell
FROM (SELECT *, unnest(range({O.cell_ix('xmin', COVER_CHARS)}, {O.cell_ix('xmax', COVER_CHARS)} + 1)) AS cx FROM parcels) a,
     LATERAL (SELECT unnest(range({O.cell_iy('a.ymin', COVER_CHARS)}, {O.cell_iy('a.ymax', COVER_CHARS)} + 1)) AS cy)""")
def q_cover(spark, sf_dir):
    from geotables.operators.cells_ops import cover
    return cover(fx.parcels(spark, sf_dir), COVER_CHARS)


@register("cover_compat", O.with_ctes(O.PARCELS, f"""
b AS (SELECT oid, {O.cell_ix('(xmin + xmax) / 2::DOUBLE', COVER_CHARS)} AS tx, {O.cell_iy('(ymin + ymax) / 2::DOUBLE', COVER_CHARS)} AS ty,
             {O.cell_ix('xmin', COVER_CHARS)} AS x0, {O.cell_iy('ymin', COVER_CHARS)} AS y0,
             {O.cell_ix('xmax', COVER_CHARS)} AS x1, {O.cell_iy('ymax', COVER_CHARS)} AS y1 FROM parcels)""",
    f"bn AS (SELECT *, {O.neighbour_hashes(COVER_CHARS)} FROM b)",
    f"c AS (SELECT oid, {O.cover_compat_sql(COVER_CHARS)} AS arr FROM bn)") + """
SELECT oid, (i - 1)::INTEGER AS pos, arr[i] AS cell FROM (SELECT oid, arr, unnest(range(1, len(arr) + 1)) AS i FROM c)""")
def q_cover_compat(spark, sf_dir):
    from geotables.operators.cells_ops import cover_compat
    return cover_compat(fx.parcels(spark, sf_dir), COVER_CHARS)


@register("common_prefix", f"""
SELECT p_brand, {O.lcp2('min(p_type)', 'max(p_type)')} AS lcp_p_type, {O.lcp2('min(p_name)', 'max(p_name)')} AS lcp_p_name
FROM part GROUP BY p_brand""")
def q_common_prefix(spark, sf_dir):
    from geotables.operators.cells_ops import common_prefix
    return common_prefix(fx.read(spark, sf_dir, "part"), ["p_brand"], ["p_type", "p_name"])


@register("common_prefix_cells", O.with_ctes(O.POINTS, f"g AS (SELECT nationkey, {O.geohash_of_morton('m')} AS gh FROM points)") + f"""
SELECT nationkey, {O.lcp2('min(gh)', 'max(gh)')} AS lcp_geohash FROM g GROUP BY nationkey""")
def q_common_prefix_cells(spark, sf_dir):
    from geotables.operators.cells_ops import common_prefix, with_point_geohash
    return common_prefix(with_point_geohash(fx.points(spark, sf_dir)), ["nationkey"], ["geohash"])


# ------------------------------------------------------------------ WKT text

def parcel_lines(spark, sf_dir):
    """``wkt \\t oid \\t tags`` lines for the parcels; keys k % 50 in (7, 13, 21, 33) give a lower-case line, broken
    WKT, a missing field and an out-of-range point."""
    from geotables.sources.wkt_text import fmt_num_sql, wkt_sql
    p = fx.parcels(spark, sf_dir).selectExpr("*", "CAST(substring(oid, 7) AS BIGINT) % 50 AS j", f"{wkt_sql()} AS wkt")
    from geotables.functions.shapes import let_sql
    return p.selectExpr(let_sql("wkt", "w", f"""CASE j
      WHEN 7 THEN concat_ws('\\t', lower(w), oid, tags)
      WHEN 13 THEN concat_ws('\\t', 'POLYGON ((bad', oid, tags)
      WHEN 21 THEN concat_ws('\\t', w, oid)
      WHEN 33 THEN concat_ws('\\t', concat('POINT (181 ', {fmt_num_sql('ymin')}, ')'), oid, tags)
      ELSE concat_ws('\\t', w, oid, tags) END""") + " AS value")


@register("wkt_export", O.with_ctes(O.PARCELS, O.PARCEL_WKT) + """
SELECT oid, wkt FROM pw""")
def q_wkt_export(spark, sf_dir):
    from geotables.sources.wkt_text import export_wkt
    return export_wkt(fx.parcels(spark, sf_dir))


@register("wkt_ingest", O.with_ctes(O.PARCELS, f"a AS ({O.ring_area_sql('parcel_rings')})",
                                    "np AS (SELECT k, sum(len(pts))::INTEGER AS n_points FROM parcel_rings GROUP BY k)") + """
SELECT p.oid, 'POLYGON' AS gtype, np.n_points, round(a.area, 9) AS area, p.xmin, p.ymin, p.xmax, p.ymax, p.cell
FROM parcels p JOIN a ON a.k = p.k JOIN np ON np.k = p.k WHERE p.k % 50 NOT IN (7, 13, 21, 33)""")
def q_wkt_ingest(spark, sf_dir):
    from geotables.functions.shapes import area_sql
    from geotables.sources.wkt_text import ingest_lines
    features, _ = ingest_lines(parcel_lines(spark, sf_dir))
    return features.selectExpr("oid", "gtype", "size(flatten(transform(rings, r -> r.pts))) AS n_points",
                               f"round({area_sql()}, 9) AS area", "xmin", "ymin", "xmax", "ymax", "cell")


@register("wkt_rejects", O.with_ctes(O.PARCELS) + """
SELECT oid, CASE k % 50 WHEN 13 THEN 'malformed WKT' WHEN 21 THEN 'missing fields'
                        ELSE 'coordinates out of range' END AS reason
FROM parcels WHERE k % 50 IN (13, 21, 33)""")
def q_wkt_rejects(spark, sf_dir):
    from geotables.sources.wkt_text import ingest_lines
    _, rejects = ingest_lines(parcel_lines(spark, sf_dir))
    return rejects.select("oid", "reason")


@register("wkt_collections", O.with_ctes(O.PARCELS, f"a AS ({O.ring_area_sql('parcel_rings')})") + f"""
SELECT p.oid || '#1' AS oid, 'POLYGON' AS gtype, round(a.area, 9) AS area, p.xmin, p.ymax FROM parcels p JOIN a USING (k)
UNION ALL SELECT oid || '#2', 'POINT', 0{O.D}, xmin, ymin FROM parcels
UNION ALL SELECT oid || '#3', 'LINESTRING', 0{O.D}, xmin, ymax FROM parcels WHERE k % 3 = 0""")
def q_wkt_collections(spark, sf_dir):
    """Lines of collections: a parcel, its corner, and for every third parcel a diagonal in a collection of its own."""
    from geotables.functions.shapes import area_sql
    from geotables.sources.wkt_text import ingest_lines, wkt_sql
    corner = lambda x, y: f"concat({x}, ' ', {y})"
    p = fx.parcels(spark, sf_dir).selectExpr("oid", "tags", "CAST(substring(oid, 7) AS BIGINT) % 3 AS j", f"{wkt_sql()} AS w",
                                             f"{corner('xmin', 'ymin')} AS lo", f"{corner('xmax', 'ymax')} AS hi")
    lines = p.selectExpr("concat_ws('\t', concat('GEOMETRYCOLLECTION (', w, ', POINT (', lo, ')', IF(j = 0, concat("
                         "', GEOMETRYCOLLECTION (LINESTRING (', lo, ', ', hi, '))'), ''), ')'), oid, tags) AS value")
    features, _ = ingest_lines(lines)
    return features.selectExpr("oid", "gtype", f"round({area_sql()}, 9) AS area", "xmin", "ymax")


@register("check_rings", O.with_ctes(O.PARCELS) + """
SELECT oid, NOT (kind = 0 AND k % 10 = 7) AS valid,
       CASE WHEN kind = 0 AND k % 10 = 7 THEN 'self-crossing' END AS reason
FROM parcels""")
def q_check_rings(spark, sf_dir):
    # rectangles with key % 10 = 7 get their 2nd and 3rd vertices swapped: a bow-tie
    from geotables.operators.rings import check_rings
    p = fx.parcels(spark, sf_dir).selectExpr(
        "oid", "gtype", "CAST(substring(oid, 7) AS BIGINT) AS k", "rings")
    bow = ("transform(rings, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', "
           "array(r.pts[0], r.pts[2], r.pts[1], r.pts[3], r.pts[4])))")
    p = p.selectExpr("oid", "gtype", f"CASE WHEN k % 10 = 7 AND k % 4 = 0 THEN {bow} ELSE rings END AS rings")
    return check_rings(p)


# ------------------------------------------------------------------ key table, prefix scans, sinks

def written_parcels(spark, sf_dir):
    """Parcels written as the key table under the shared folder and read back."""
    from geotables.session import scratch_path
    from geotables.sources.geo_table import read_geo_table, write_geo_table
    path = scratch_path(spark, "parcels")
    write_geo_table(fx.parcels(spark, sf_dir), path)
    return read_geo_table(spark, path)


def window_prefixes(spark, sf_dir):
    """Geohash prefixes of 3 and 4 characters at the windows' south-west corners (nested, with repeats)."""
    from geotables.functions.cells import geohash_sql
    w = fx.windows(spark, sf_dir)
    return w.selectExpr(f"{geohash_sql('xmin', 'ymin', 3)} AS prefix").unionByName(
        w.selectExpr(f"{geohash_sql('xmin', 'ymin', 4)} AS prefix"))


_PREFIXES_SQL = (f"wm AS (SELECT *, {O.morton_of('xmin', 'ymin')} AS m FROM windows)",
                 f"""tp AS (SELECT DISTINCT prefix FROM (SELECT {O.geohash_of_morton('m', 3)} AS prefix FROM wm
                       UNION ALL SELECT {O.geohash_of_morton('m', 4)} FROM wm))""")


@register("geo_table_roundtrip", O.with_ctes(O.PARCELS, f"a AS ({O.ring_area_sql('parcel_rings')})") + """
SELECT p.cell || '_' || p.oid AS key, p.oid, p.tags, round(a.area, 9) AS area, substr(p.cell, 1, 2) AS cell_prefix
FROM parcels p JOIN a ON a.k = p.k""")
def q_geo_table_roundtrip(spark, sf_dir):
    from geotables.functions.shapes import area_sql
    return written_parcels(spark, sf_dir).selectExpr("key", "oid", "tags", f"round({area_sql()}, 9) AS area",
                                                     "cell_prefix")


@register("prefix_scan", O.with_ctes(O.PARCELS, O.WINDOWS, *_PREFIXES_SQL) + """
SELECT p.oid, p.cell || '_' || p.oid AS key FROM parcels p
WHERE EXISTS (SELECT 1 FROM tp WHERE starts_with(p.cell || '_' || p.oid, tp.prefix))""")
def q_prefix_scan(spark, sf_dir):
    from geotables.sources.geo_table import scan_by_cell_prefix
    return scan_by_cell_prefix(written_parcels(spark, sf_dir), window_prefixes(spark, sf_dir)).select("oid", "key")


@register("prefix_scan_overlaps", O.with_ctes(O.PARCELS, O.WINDOWS, *_PREFIXES_SQL) + """
SELECT tp.prefix, p.oid FROM parcels p JOIN tp ON starts_with(p.cell || '_' || p.oid, tp.prefix)""")
def q_prefix_scan_overlaps(spark, sf_dir):
    from geotables.sources.geo_table import scan_by_cell_prefix
    return scan_by_cell_prefix(written_parcels(spark, sf_dir), window_prefixes(spark, sf_dir),
                               keep_overlaps=True).select("prefix", "oid")


@register("upsert_geo_table", O.with_ctes(O.PARCELS, O.ZONES) + """
SELECT cell || '_' || oid AS key, oid, CASE WHEN k % 5 = 0 THEN '{"DLBM":"X"}' ELSE tags END AS tags FROM parcels
UNION ALL SELECT cell || '_' || oid, oid, tags FROM zones""")
def q_upsert_geo_table(spark, sf_dir):
    # incoming: parcels with key % 5 = 0 re-tagged (same row keys: overwrite) plus the zones (new row keys)
    from geotables.sources.geo_table import upsert
    existing = written_parcels(spark, sf_dir).select(*FEATURE_COLUMNS)
    retag = fx.parcels(spark, sf_dir).where("CAST(substring(oid, 7) AS BIGINT) % 5 = 0") \
        .withColumn("tags", F.lit('{"DLBM":"X"}'))
    incoming = retag.unionByName(fx.zones(spark, sf_dir))
    return upsert(existing, incoming).select("key", "oid", "tags")


@register("put_geo_table", O.with_ctes(O.PARCELS, O.ZONES) + """
SELECT cell || '_' || oid AS key, oid, CASE WHEN k % 5 = 0 THEN '{"DLBM":"X"}' ELSE tags END AS tags FROM parcels
UNION ALL SELECT cell || '_' || oid, oid, tags FROM zones""")
def q_put_geo_table(spark, sf_dir):
    """The same put, written into the stored table and read back; the incoming rows come twice."""
    from geotables.session import scratch_path
    from geotables.sources.geo_table import put_geo_table, read_geo_table, write_geo_table
    path = scratch_path(spark, "parcels")
    parcels = fx.parcels(spark, sf_dir)
    write_geo_table(parcels, path)
    retag = parcels.where("CAST(substring(oid, 7) AS BIGINT) % 5 = 0").withColumn("tags", F.lit('{"DLBM":"X"}'))
    incoming = retag.unionByName(fx.zones(spark, sf_dir))
    put_geo_table(spark, path, incoming.unionByName(incoming))
    return read_geo_table(spark, path).select("key", "oid", "tags")


def written_world(spark, sf_dir, prefix_len=2):
    """Points all over the globe, whose cells begin with digits and letters, and boxes across longitude 0, which have no
    cell, as a stored key table."""
    from geotables.session import scratch_path
    from geotables.sources.geo_table import read_geo_table, write_geo_table
    path = scratch_path(spark, "world")
    world = fx.points(spark, sf_dir).select(*FEATURE_COLUMNS).unionByName(fx.straddling_boxes(spark, sf_dir))
    write_geo_table(world, path, prefix_len)
    return read_geo_table(spark, path)


_WORLD = f"""
world AS (SELECT oid, {O.geohash_of_morton('m')} || '_' || oid AS key FROM points
          UNION ALL SELECT 'B' || n_nationkey::VARCHAR, '_B' || n_nationkey::VARCHAR FROM nation)"""
LITERAL_PREFIXES = ["00", "0", "s1", "_", "_B1", "zz", "7", "it's"]


@register("prefix_scan_literal", O.with_ctes(O.POINTS, _WORLD) + "SELECT oid, key FROM world WHERE " + " OR ".join(
    "starts_with(key, '{}')".format(p.replace("'", "''")) for p in LITERAL_PREFIXES))
def q_prefix_scan_literal(spark, sf_dir):
    from geotables.sources.geo_table import scan_prefixes
    return scan_prefixes(written_world(spark, sf_dir, prefix_len=1), LITERAL_PREFIXES, num_partitions=4).select("oid", "key")


_WORLD_TARGETS = "tp AS (SELECT DISTINCT substr(key, 1, (length(oid) % 4)::INTEGER) AS prefix FROM world WHERE oid LIKE '%7')"


def _world_targets(world):
    """Prefixes of zero to three characters of some of the table's own keys: '' , '_', digits only, nested ones."""
    return world.where("oid LIKE '%7'").selectExpr("substring(key, 1, length(oid) % 4) AS prefix")


@register("prefix_scan_world", O.with_ctes(O.POINTS, _WORLD, _WORLD_TARGETS) + """
SELECT w.oid, w.key FROM world w WHERE EXISTS (SELECT 1 FROM tp WHERE starts_with(w.key, tp.prefix) AND tp.prefix <> '')""")
def q_prefix_scan_world(spark, sf_dir):
    from geotables.sources.geo_table import scan_by_cell_prefix
    world = written_world(spark, sf_dir)
    return scan_by_cell_prefix(world, _world_targets(world).where("prefix <> ''"), num_partitions=3).select("oid", "key")


@register("prefix_scan_world_overlaps", O.with_ctes(O.POINTS, _WORLD, _WORLD_TARGETS) + """
SELECT tp.prefix, w.oid FROM world w JOIN tp ON starts_with(w.key, tp.prefix)""")
def q_prefix_scan_world_overlaps(spark, sf_dir):
    from geotables.sources.geo_table import scan_by_cell_prefix
    world = written_world(spark, sf_dir, prefix_len=1)
    return scan_by_cell_prefix(world, _world_targets(world), keep_overlaps=True).select("prefix", "oid")


# ------------------------------------------------------------------ jobs from stored data

@register("range_query_stored", ORACLE["range_query"])
def q_range_query_stored(spark, sf_dir):
    return rq.range_query(written_parcels(spark, sf_dir), *WINDOW).select("oid")


@register("range_scan_windows", ORACLE["range_query_many"])
def q_range_scan_windows(spark, sf_dir):
    """The windows of range_query_many on the stored table, by the cells that cover them."""
    from geotables.operators.window_scan import scan_windows
    return scan_windows(written_parcels(spark, sf_dir), fx.windows(spark, sf_dir))


_WORLD_WINDOWS = f"""
boxes AS (SELECT n_nationkey::INTEGER AS window_id, -180{O.D} + n_nationkey * 14{O.D} AS xmin, -90{O.D} + n_nationkey * 6{O.D} AS ymin,
                 -175{O.D} + n_nationkey * 14{O.D} + n_nationkey AS xmax, -80{O.D} + n_nationkey * 6{O.D} AS ymax FROM nation),
spots AS (SELECT oid, lon AS x, lat AS y FROM points
          UNION ALL SELECT 'B' || n_nationkey::VARCHAR, -(n_nationkey + 1) / 64{O.D} + i * (n_nationkey + 1) / 32{O.D},
                           n_nationkey / 64{O.D} - 1{O.D} + j * 0.25{O.D} FROM nation, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"""


@register("range_scan_world", O.with_ctes(O.POINTS, _WORLD_WINDOWS) + """
SELECT DISTINCT window_id, oid FROM spots JOIN boxes ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax""")
def q_range_scan_world(spark, sf_dir):
    """Wide windows over the globe on points of all cells and on boxes without a cell."""
    from geotables.operators.window_scan import scan_windows
    boxes = fx.read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS window_id", "-180D + n_nationkey * 14D AS xmin", "-90D + n_nationkey * 6D AS ymin",
        "-175D + n_nationkey * 14D + n_nationkey AS xmax", "-80D + n_nationkey * 6D AS ymax")
    return scan_windows(written_world(spark, sf_dir), boxes)


_CUT = "substr({c}, 1, ({k} % 13)::INTEGER)"


@register("nested_cells", O.with_ctes(O.POINTS, O.ZONES) + f"""
SELECT p.oid AS p_oid, z.oid AS z_oid
FROM (SELECT oid, {_CUT.format(c=O.geohash_of_morton('m'), k='k')} AS cell FROM points) p
JOIN (SELECT oid, {_CUT.format(c='cell', k='k')} AS cell FROM zones) z
  ON starts_with(p.cell, z.cell) OR starts_with(z.cell, p.cell)""")
def q_nested_cells(spark, sf_dir):
    """Points and zones by cells of 0 to 12 characters; the empty cell meets everything."""
    from geotables.functions.cells import geohash_sql
    from geotables.operators.nested_cells import nested_cell_join
    p = fx.points(spark, sf_dir).selectExpr(
        "oid AS p_oid", f"substring({geohash_sql('lon', 'lat')}, 1, CAST(CAST(substring(oid, 7) AS BIGINT) % 13 AS INT)) AS p_cell")
    z = fx.zones(spark, sf_dir).selectExpr(
        "oid AS z_oid", "substring(cell, 1, CAST(CAST(split_part(oid, 'Z', 2) AS BIGINT) % 13 AS INT)) AS z_cell")
    return nested_cell_join(p, z, "p_cell", "z_cell").select("p_oid", "z_oid")


@register("overlay_stored", O.overlay_all() + O.best_of("scored"))
def q_overlay_stored(spark, sf_dir):
    """Both key tables written, read back (the parcels dealt out anew) and overlaid."""
    from geotables.operators.overlay import overlay_classes
    from geotables.session import scratch_path
    from geotables.sources.geo_table import read_geo_table, write_geo_table
    paths = []
    for name, df in zip(("parcels", "zones"), _overlay(spark, sf_dir), strict=True):
        paths.append(scratch_path(spark, name))
        write_geo_table(df, paths[-1])
    out = overlay_classes(read_geo_table(spark, paths[0], num_partitions=8), read_geo_table(spark, paths[1]))
    return out.selectExpr("oid", "pd_class", AREA)


@register("overlay_text", O.overlay_all() + O.best_of("scored"))
def q_overlay_text(spark, sf_dir):
    """Both layers written as text lines, read back (dealt out anew, repaired) and overlaid."""
    from geotables.operators.overlay import overlay_classes
    from geotables.session import scratch_path
    from geotables.sources.wkt_text import read_wkt_table, write_wkt_table
    layers = []
    for name, df in zip(("parcels", "zones"), _overlay(spark, sf_dir), strict=True):
        path = scratch_path(spark, f"{name}-text")
        write_wkt_table(df, path)
        layers.append(read_wkt_table(spark, path, num_partitions=8, repair=name == "zones")[0])
    return overlay_classes(*layers).selectExpr("oid", "pd_class", AREA)


@register("wkt_repair", O.with_ctes(O.PARCELS, f"a AS ({O.ring_area_sql('parcel_rings')})") + f"""
SELECT p.oid, CASE WHEN p.k % 50 = 19 AND kind <> 3 THEN 'self-crossing' END AS reason,
       CASE WHEN NOT (p.k % 50 = 19 AND kind <> 3) THEN round(a.area, 9) END AS area
FROM parcels p JOIN a ON a.k = p.k""")
def q_wkt_repair(spark, sf_dir):
    """Lines with open rings (key % 50 = 11), repeated points (17) and crossed shells (19, without a hole) read with
    repair: the first two become whole, the last are rejected."""
    from geotables.functions.shapes import area_sql
    from geotables.sources.wkt_text import ingest_lines, wkt_sql
    p = fx.parcels(spark, sf_dir).selectExpr("*", "CAST(substring(oid, 7) AS BIGINT) AS k")
    ring = "named_struct('part', r.part, 'ring', r.ring, 'pts', {})".format
    spoiled = (f"CASE WHEN k % 50 = 11 THEN transform(rings, r -> {ring('slice(r.pts, 1, size(r.pts) - 1)')}) "
               f"WHEN k % 50 = 17 THEN transform(rings, r -> {ring('flatten(transform(r.pts, p -> array(p, p)))')}) "
               "WHEN k % 50 = 19 AND k % 4 <> 3 THEN transform(rings, r -> "
               + ring("concat(r.pts, slice(r.pts, 3, size(r.pts) - 3), array(r.pts[1], r.pts[0]))") + ") ELSE rings END")
    lines = p.selectExpr(f"concat_ws('\t', {wkt_sql(rings=spoiled)}, oid, tags) AS value")
    features, rejects = ingest_lines(lines, repair=True)
    good = features.selectExpr("oid", "CAST(NULL AS STRING) AS reason", f"round({area_sql()}, 9) AS area")
    return good.unionByName(rejects.selectExpr("oid", "reason", "CAST(NULL AS DOUBLE) AS area"))


@register("class_text", O.overlay_all() + """
SELECT '(' || oid || ',' || coalesce(pd_class, 'null') || ')' AS value FROM (""" + O.best_of("scored") + ")")
def q_class_text(spark, sf_dir):
    from geotables.operators.overlay import overlay_classes
    from geotables.session import scratch_path
    from geotables.sources.sinks import write_class_text
    path = scratch_path(spark, "classes")
    write_class_text(overlay_classes(*_overlay(spark, sf_dir)), path)
    return spark.read.text(path)


@register("wkb_transcode", O.with_ctes(O.PARCELS, f"a AS ({O.ring_area_sql('parcel_rings')})",
                                       "np AS (SELECT k, count(*) AS nr, sum(len(pts)) AS n FROM parcel_rings GROUP BY k)") + """
SELECT p.oid, (9 + 4 * np.nr + 16 * np.n)::INTEGER AS wkb_len, round(a.area, 9) AS area, 'POLYGON' AS gtype
FROM parcels p JOIN a ON a.k = p.k JOIN np ON np.k = p.k""")
def q_wkb_transcode(spark, sf_dir):
    # parcels -> WKB -> parcels: byte length and the area of the decoded geometry
    from geotables.functions.shapes import area_sql
    from geotables.sources.wkb import from_wkb, to_wkb
    enc = to_wkb(fx.parcels(spark, sf_dir))
    dec = from_wkb(enc.selectExpr("oid", "wkb", "length(wkb) AS wkb_len"), keep=["oid", "wkb_len"])
    return dec.selectExpr("oid", "wkb_len", f"round({area_sql()}, 9) AS area", "gtype")


def _wkb_table(spark, sf_dir):
    """Parcels stored as (key, wkb, oid, tags); every 50th loses its last byte, every 51st its bytes."""
    from geotables.session import scratch_path
    from geotables.sources.wkb import read_wkb_table, to_wkb
    path = scratch_path(spark, "wkb")
    rows = to_wkb(fx.parcels(spark, sf_dir), ["key", "oid", "tags"]).selectExpr("*", "CAST(substring(oid, 7) AS BIGINT) AS k")
    rows.selectExpr("key", "CASE WHEN k % 51 = 0 THEN NULL WHEN k % 50 = 0 THEN substring(wkb, 1, length(wkb) - 1) ELSE wkb END"
                           " AS wkb", "oid", "tags").write.parquet(path)
    return read_wkb_table(spark, path, num_partitions=8)


@register("wkb_table", O.with_ctes(O.PARCELS, f"a AS ({O.ring_area_sql('parcel_rings')})") + """
SELECT p.oid, p.cell || '_' || p.oid AS key, p.region, p.xmin, p.ymax, round(a.area, 9) AS area
FROM parcels p JOIN a ON a.k = p.k WHERE p.k % 51 <> 0 AND p.k % 50 <> 0""")
def q_wkb_table(spark, sf_dir):
    from geotables.functions.shapes import area_sql
    return _wkb_table(spark, sf_dir)[0].selectExpr("oid", "key", "region", "xmin", "ymax", f"round({area_sql()}, 9) AS area")


@register("wkb_rejects", O.with_ctes(O.PARCELS) + """
SELECT oid, CASE WHEN k % 51 = 0 THEN 'missing WKB' ELSE 'malformed WKB' END AS reason FROM parcels
WHERE k % 51 = 0 OR k % 50 = 0""")
def q_wkb_rejects(spark, sf_dir):
    return _wkb_table(spark, sf_dir)[1].select("oid", "reason")


@register("cover_compat_at_corner", O.with_ctes(O.PARCELS, f"""
b AS (SELECT oid, {O.cell_ix('xmin', COVER_CHARS)} AS tx, {O.cell_iy('ymax', COVER_CHARS)} AS ty,
             {O.cell_ix('xmin', COVER_CHARS)} AS x0, {O.cell_iy('ymin', COVER_CHARS)} AS y0,
             {O.cell_ix('xmax', COVER_CHARS)} AS x1, {O.cell_iy('ymax', COVER_CHARS)} AS y1 FROM parcels)""",
    f"bn AS (SELECT *, {O.neighbour_hashes(COVER_CHARS)} FROM b)",
    f"c AS (SELECT oid, {O.cover_compat_sql(COVER_CHARS)} AS arr FROM bn)") + """
SELECT oid, (i - 1)::INTEGER AS pos, arr[i] AS cell FROM (SELECT oid, arr, unnest(range(1, len(arr) + 1)) AS i FROM c)""")
def q_cover_compat_at_corner(spark, sf_dir):
    from geotables.operators.cells_ops import cover_compat
    return cover_compat(fx.parcels(spark, sf_dir), COVER_CHARS, target=("xmin", "ymax"))


# ------------------------------------------------------------------ streaming

@register("stream_overlay_classes", O.overlay_all() + O.best_of("scored"))
def q_stream_overlay_classes(spark, sf_dir):
    """Parcels written to the key table, read back as a file stream (one file per trigger) and overlaid per
    micro-batch; the result is the union of the epochs."""
    from geotables.session import scratch_path
    from geotables.streaming.overlay_stream import start_overlay_stream
    src = scratch_path(spark, "parcel-stream")
    fx.parcels(spark, sf_dir).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    sink, ckpt = scratch_path(spark, "classes-stream"), scratch_path(spark, "checkpoint")
    q = start_overlay_stream(stream, fx.zones(spark, sf_dir), sink, ckpt)
    q.awaitTermination()
    return spark.read.parquet(sink).selectExpr("oid", "pd_class", AREA)


@register("stream_zone_classes", O.overlay_all() + O.best_of("scored"))
def q_stream_zone_classes(spark, sf_dir):
    """Zones as a file stream, some files per trigger, the first epoch replayed and the epochs compacted: the running best per
    parcel is that of all zones."""
    from geotables.operators.overlay import contenders, parcel_side, zone_side
    from geotables.session import scratch_path
    from geotables.streaming.overlay_stream import compact_epochs, running_classes, start_zone_stream
    parcels, zones = _overlay(spark, sf_dir)
    src, sink, whole = (scratch_path(spark, n) for n in ("zone-stream", "contenders", "contenders-compact"))
    zones.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 2).parquet(src)
    start_zone_stream(stream, parcels, sink, scratch_path(spark, "checkpoint")).awaitTermination()
    compact_epochs(spark, sink, whole)
    # zones that come once more, in an epoch of their own
    again = contenders(parcel_side(parcels), zone_side(zones.where("oid LIKE '%7'"), "PDJB"))
    again.write.parquet(f"{whole}/epoch=1000")
    return running_classes(spark, whole, parcels).selectExpr("oid", "pd_class", AREA)


@register("stream_range_query", O.with_ctes(O.PARCELS) + f"""
SELECT DISTINCT v.oid FROM ({O.vertices('parcel_rings')}) v
WHERE v.x BETWEEN 111{O.D} AND 112{O.D} AND v.y BETWEEN 31{O.D} AND 32{O.D}""")
def q_stream_range_query(spark, sf_dir):
    from geotables.session import scratch_path
    from geotables.streaming.overlay_stream import stream_range_query
    src = scratch_path(spark, "parcel-stream")
    fx.parcels(spark, sf_dir).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    sink, ckpt = scratch_path(spark, "range-stream"), scratch_path(spark, "checkpoint")
    q = stream_range_query(stream, *WINDOW).select("oid").writeStream.format("parquet") \
        .option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)
