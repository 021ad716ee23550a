"""Hand-written edge rows (FIXTURES.md section 3)."""

from features import features_from_wkt
from pyspark.sql import functions as F

from geotables.functions.cells import common_prefix2_sql, envelope_cell_sql, geohash_sql
from geotables.functions.shapes import area_sql
from geotables.functions.tags import tag_sql
from geotables.model import region_sql
from geotables.operators.cells_ops import common_prefix, cover, cover_compat
from geotables.operators.overlay import overlay_classes, overlay_pairs
from geotables.operators.range_query import parse_window, range_query
from geotables.operators.rings import check_rings
from geotables.sources.geo_table import scan_prefixes


def test_range_query_needs_a_vertex_inside(spark):
    f, _ = features_from_wkt(spark, [
        ("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", "poly", "{}"),
        ("LINESTRING (0 5, 10 5)", "line", "{}"),
        ("POINT (6 6)", "pt", "{}"),
    ])
    got = {r.oid for r in range_query(f, 4, 4, 6, 6).collect()}
    assert got == {"pt"}  # closed window: the corner counts; covering polygon and crossing line do not


def test_window_text_orders():
    assert parse_window("1,2,3,4") == (1, 2, 3, 4)
    assert parse_window("1,2,3,4", compat=True) == (1, 3, 2, 4)   # (x1, x2, y1, y2)
    assert parse_window("3,4,1,2") == (1, 2, 3, 4)


def test_multipolygon_area_and_hole(spark):
    f, _ = features_from_wkt(spark, [
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "mp", "{}"),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))", "holed", "{}"),
        ("POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))", "cw", "{}"),   # clockwise shell: oriented on ingest
    ])
    got = {r.oid: r.a for r in f.selectExpr("oid", f"{area_sql()} AS a").collect()}
    assert got == {"mp": 1.0, "holed": 12.0, "cw": 16.0}


def _zones(spark):
    z, _ = features_from_wkt(spark, [
        ("POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", "110000Z1", '{"PDJB":"4"}'),
    ])
    return z


def test_overlaps_square_hole_touch(spark):
    p, _ = features_from_wkt(spark, [
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "110000A", "{}"),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))", "110000B", "{}"),
        ("POLYGON ((6 0, 7 0, 7 2, 6 2, 6 0))", "110000C", "{}"),   # touches the zone's envelope at x = 6
    ])
    z = _zones(spark)
    for strategy in ("grid", "plain", "prefix"):
        pairs = {r.p_oid: r.overlap_area for r in overlay_pairs(p, z, strategy=strategy).collect()}
        assert pairs == {"110000A": 4.0, "110000B": 3.0, "110000C": 0.0}, strategy
    classes = {r.oid: (r.pd_class, r.overlap_area) for r in overlay_classes(p, z).collect()}
    assert classes == {"110000A": ("4", 4.0), "110000B": ("4", 3.0), "110000C": ("0", 0.0)}


def test_tie_missing_tag_and_region(spark):
    p, _ = features_from_wkt(spark, [("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "110001_7", "{}")])
    z, _ = features_from_wkt(spark, [
        ("POLYGON ((0 0, 2 0, 2 4, 0 4, 0 0))", "110001Z2", '{"PDJB":"2"}'),
        ("POLYGON ((2 0, 4 0, 4 4, 2 4, 2 0))", "110001Z1", '{"PDJB":"1"}'),
        ("POLYGON ((0 0, 4 0, 4 1, 0 1, 0 0))", "110002Z9", '{"PDJB":"9"}'),   # other region
    ])
    r = overlay_classes(p, z, keep_zone_key=True).collect()[0]
    assert (r.pd_class, r.overlap_area) == ("1", 8.0)   # tie on area: smallest zone key wins
    z2, _ = features_from_wkt(spark, [("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "110001Z3", '{"other":"x"}')])
    r2 = overlay_classes(p, z2).collect()[0]
    assert r2.pd_class is None and r2.overlap_area == 16.0   # missing tag: NULL class, row kept


def test_bow_tie_is_flagged(spark):
    f, _ = features_from_wkt(spark, [
        ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "bow", "{}"),
        ("POLYGON ((0 0, 4 0, 4 2, 2 2, 2 4, 0 4, 0 0))", "ell", "{}"),
    ])
    got = {r.oid: (r.valid, r.reason) for r in check_rings(f).collect()}
    assert got == {"bow": (False, "self-crossing"), "ell": (True, None)}


def test_empty_point_and_rejects(spark):
    f, rej = features_from_wkt(spark, [
        ("POINT EMPTY", "empty", "{}"),
        ("polygon ((0 0,1 0,1 1,0 0))", "lower", "{}"),
        ("POLYGON ((bad", "bad", "{}"),
        ("POINT (181 0)", "far", "{}"),
        ("POLYGON ((0 0, 1 0, 1 1))", "open", "{}"),
    ])
    lines = spark.createDataFrame([("POINT (1 1)\ttwo",)], "value string")
    from geotables.sources.wkt_text import ingest_lines
    _, rej2 = ingest_lines(lines)
    e = f.collect()
    assert [(r.oid, r.xmin, r.cell) for r in e] == [("empty", None, "")]
    reasons = {r.oid: r.reason for r in rej.collect()}
    assert reasons == {"bad": "malformed WKT", "far": "coordinates out of range", "open": "ring too short"}
    assert [r.reason for r in rej2.collect()] == ["missing fields"]


def test_cells(spark):
    df = spark.createDataFrame([(180.0, 90.0, -0.5, 10.0, 0.5, 10.5)], "lon double, lat double, a double, b double, c double, d double")
    r = df.selectExpr(f"{geohash_sql('lon', 'lat')} AS g", f"{envelope_cell_sql('a', 'b', 'c', 'd')} AS cell").collect()[0]
    assert r.g == "zzzzzzzzzzzz"       # clamped to the last cell
    assert r.cell == ""                # box across lon 0: no common prefix
    s = spark.createDataFrame([("110001_7",), ("1100",)], "oid string").selectExpr(f"{region_sql()} AS r")
    assert [x.r for x in s.collect()] == ["110001", "1100"]


def test_tags(spark):
    df = spark.createDataFrame([('{PDJB:"3"}',), ("{}",), ('{"PDJB":2.0}',), ("not json",)], "tags string")
    assert [r.c for r in df.selectExpr(f"{tag_sql('tags', 'PDJB')} AS c").collect()] == ["3", None, "2.0", None]


def test_common_prefix(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (2, "abd"), (3, "a"), (3, "")], "g int, s string")
    got = {r.g: r.lcp_s for r in common_prefix(df, ["g"], ["s"]).collect()}
    assert got == {1: "abc", 2: "ab", 3: ""}
    r = spark.range(1).selectExpr(f"{common_prefix2_sql(chr(39) + chr(39), chr(39) + 'x' + chr(39))} AS p").collect()[0]
    assert r.p == ""


def test_prefix_lists(spark):
    df = spark.createDataFrame([("wx4e_1",), ("wx4f_2",), ("wx5a_3",), ("wy0_4",)], "key string")
    assert sorted(r.key for r in scan_prefixes(df, ["wx4", "wx4", "wx5"]).collect()) == ["wx4e_1", "wx4f_2", "wx5a_3"]
    got = sorted((r.prefix, r.key) for r in scan_prefixes(df, ["wx4", "wx4e"], keep_overlaps=True).collect())
    assert got == [("wx4", "wx4e_1"), ("wx4", "wx4f_2"), ("wx4e", "wx4e_1")]
    assert scan_prefixes(df, []).count() == 0


def test_cover_cases(spark):
    # precision 1: cells are 45 x 45 degrees; target = cell of the box centre
    boxes = [("inside", 10.0, 10.0, 20.0, 20.0), ("east", 30.0, 10.0, 50.0, 20.0),
             ("sw", -5.0, -5.0, 5.0, 5.0), ("3x3", -10.0, -10.0, 50.0, 50.0)]
    df = spark.createDataFrame(boxes, "oid string, xmin double, ymin double, xmax double, ymax double")
    full = {r.oid: r.n for r in cover(df, 1).groupBy("oid").agg(F.count("*").alias("n")).collect()}
    compat = {r.oid: r.n for r in cover_compat(df, 1).groupBy("oid").agg(F.count("*").alias("n")).collect()}
    assert full == {"inside": 1, "east": 2, "sw": 4, "3x3": 9}
    assert compat == {"inside": 1, "east": 2, "sw": 4, "3x3": 4}


def test_empty_window_table(spark):
    from geotables.operators.range_query import range_query_many
    f, _ = features_from_wkt(spark, [("POINT (6 6)", "pt", "{}")])
    w = spark.createDataFrame([], "window_id int, xmin double, ymin double, xmax double, ymax double")
    out = range_query_many(f, w)
    assert out.columns == ["window_id", "oid"] and out.count() == 0


def test_small_overlaps_and_near_ties(spark):
    p, _ = features_from_wkt(spark, [
        ("POLYGON ((1 1, 1.00002 1, 1.00002 1.00002, 1 1.00002, 1 1))", "110000A", "{}"),
        ("POLYGON ((10 10, 11 10, 11 11, 10 11, 10 10))", "110000B", "{}")])
    z, _ = features_from_wkt(spark, [
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "110000Z1", '{"PDJB":"1"}'),
        ("POLYGON ((9 9, 10.0005 9, 10.0005 10.001, 9 10.001, 9 9))", "110000Z2", '{"PDJB":"2"}'),
        ("POLYGON ((9 9, 10.0005002 9, 10.0005002 10.001, 9 10.001, 9 9))", "110000Z3", '{"PDJB":"3"}')])
    got = {r.oid: (r.pd_class, r.overlap_area) for r in overlay_classes(p, z).collect()}
    assert got["110000A"][0] == "1" and abs(got["110000A"][1] - 4e-10) < 1e-15
    assert got["110000B"][0] == "3" and abs(got["110000B"][1] - 5.002e-7) < 1e-13


def test_merge_keeps_parcels_that_share_an_oid(spark):
    from geotables.operators.overlay import merge_best
    p, _ = features_from_wkt(spark, [("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "110000A", "{}"),
                                     ("POLYGON ((20 20, 24 20, 24 24, 20 24, 20 20))", "110000A", "{}")])
    r = overlay_classes(p, _zones(spark), keep_zone_key=True)
    assert sorted(x.pd_class for x in merge_best(r, r).collect()) == ["0", "4"]


def test_fixture_ids_stay_unique_for_long_keys(spark):
    from geotables.plans.fixtures import parcel_parts, zone_parts
    keys = [1, 9_999_999, 10_000_000, 10_000_003, 100_000_000, 999, 10_000, 100_000, 1_000_000]
    k = spark.createDataFrame([(x,) for x in keys], "p_partkey bigint")
    ids = [r.oid for r in parcel_parts(k).collect()] + [r.oid for r in zone_parts(k.toDF("s_suppkey")).collect()]
    assert len(set(ids)) == 2 * len(keys)


def test_rings_repeated_points_and_holes(spark):
    square, jvm = "(0 0, 4 0, 4 4, 0 4, 0 0)", spark.sparkContext._jvm
    cases = {
        "repeat": "POLYGON ((0 0, 4 0, 4 0, 4 4, 0 4, 0 4, 0 0))",
        "out": f"POLYGON ({square}, (5 5, 5 6, 6 6, 6 5, 5 5))",
        "equal": f"POLYGON ({square}, (0 0, 0 4, 4 4, 4 0, 0 0))",
        "cross": f"POLYGON ({square}, (3 3, 3 5, 5 5, 5 3, 3 3))",
        "inside": f"POLYGON ({square}, (1 1, 1 2, 2 2, 2 1, 1 1))",
        "touch": f"POLYGON ({square}, (0 2, 1 3, 2 2, 1 1, 0 2))",
        "bow": "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"}
    f, _ = features_from_wkt(spark, [(w, k, "{}") for k, w in cases.items()])
    got = {r.key.split("_")[-1]: r.valid for r in check_rings(f, "key").collect()}
    reader = jvm.org.locationtech.jts.io.WKTReader()
    assert got == {k: reader.read(w).isValid() for k, w in cases.items()}


def test_repair_on_ingest(spark):
    from geotables.sources.wkt_text import ingest_lines
    rows = [("POLYGON ((0 0, 0 4, 4 4, 4 4, 4 0))", "open", "{}"), ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "bow", "{}"),
            ("POINT (1 1)", "pt", "{}"), ("POLYGON ((0 0, 1 1, 1 1))", "flat", "{}")]
    lines = spark.createDataFrame([("\t".join(r),) for r in rows], "value string")
    good, bad = ingest_lines(lines, repair=True)
    assert {r.oid: r.a for r in good.selectExpr("oid", f"{area_sql()} AS a").collect()} == {"open": 16.0, "pt": 0.0}
    assert {r.oid: r.reason for r in bad.collect()} == {"bow": "self-crossing", "flat": "ring too short"}


def test_key_table_files_are_sorted_and_prefixes_find_their_rows(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from geotables.sources.geo_table import read_geo_table, scan_by_cell_prefix, write_geo_table
    rows = [(f"POINT ({x / 7} {y / 3})", f"p{x}_{y}", "{}") for x in range(-60, 60, 7) for y in range(-60, 60, 7)]
    rows.append(("POLYGON ((-1 1, 1 1, 1 2, -1 2, -1 1))", "wide", "{}"))
    f, _ = features_from_wkt(spark, rows)
    keys = [r.key for r in f.select("key").collect()]
    for n in (1, 3):
        path = str(tmp_path / f"t{n}")
        write_geo_table(f, path, prefix_len=n)
        for file in glob.glob(f"{path}/cell_prefix=*/*.parquet"):
            own = pq.ParquetFile(file).read(columns=["key"]).column("key").to_pylist()
            assert own == sorted(own)
        t = read_geo_table(spark, path)
        for p in ("", "_", "_wide", "s", "s0", "s00", "7", keys[5], keys[5][:4], "it's"):
            want = sorted(k for k in keys if k.startswith(p))
            assert sorted(r.key for r in scan_prefixes(t, [p]).collect()) == want, p
            table = spark.createDataFrame([(p,)], "prefix string")
            scan = scan_by_cell_prefix(t, table)
            assert sorted(r.key for r in scan.collect()) == want, p
        assert scan_by_cell_prefix(t, spark.createDataFrame([("s",), ("kp",), ("s0",)], "prefix string")) \
            ._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        assert scan_prefixes(t, ["s"], num_partitions=3).rdd.getNumPartitions() == 3


def test_one_zone_over_all_parcels_is_dealt_over_many_keys(spark):
    from geotables.operators.overlay import candidate_pairs, overlay_inputs
    p, _ = features_from_wkt(spark, [(f"POINT ({x / 50 + 1} {y / 50 + 1})", f"110000P{x}_{y}", "{}")
                                     for x in range(40) for y in range(40)])
    z, _ = features_from_wkt(spark, [("POLYGON ((0 0, 30 0, 30 30, 0 30, 0 0))", "110000Z", '{"PDJB":"1"}')])
    pairs = candidate_pairs(*overlay_inputs(p, z, "PDJB", edges=False), "grid")
    assert pairs.count() == 1600
    sizes = pairs.groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert candidate_pairs(*overlay_inputs(p, z, "PDJB", edges=False), "grid").groupBy(
            F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 800
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes.count() >= 1


def test_stream_prepares_the_zones_once(spark, tmp_path, monkeypatch):
    import geotables.operators.overlay as overlay
    from geotables.streaming.overlay_stream import start_overlay_stream
    f, _ = features_from_wkt(spark, [(f"POLYGON (({i} 0, {i + 1} 0, {i + 1} 1, {i} 1, {i} 0))", f"110000P{i}", "{}")
                                     for i in range(6)])
    f.repartition(3).write.parquet(str(tmp_path / "in"))
    made = []
    real = overlay.materialize
    monkeypatch.setattr(overlay, "materialize", lambda df: made.append(df.columns[0]) or real(df))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_overlay_stream(stream, _zones(spark), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert made.count("z_key") == 1 and made.count("p_key") == 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_wkb_forms_and_bad_bytes(spark):
    import struct

    from geotables.sources.wkb import decode_wkb
    line = struct.pack("<dddddd", 1, 2, 3, 4, 5, 6)
    rows = [
        ("iso_z", b"\x01" + struct.pack("<II", 1002, 2) + line),
        ("ewkb_z", b"\x01" + struct.pack("<II", 0x80000002, 2) + line),
        ("ewkb_srid", b"\x00" + struct.pack(">IIdd", 0x20000001, 4326, 7, 8)),
        ("iso_zm", b"\x00" + struct.pack(">Idddd", 3001, 7, 8, 9, 10)),
        ("short", b"\x01" + struct.pack("<II", 2, 2) + line[:-17]), ("kind", b"\x01" + struct.pack("<I", 99)),
        ("order", b"\x07" + struct.pack("<I", 1)), ("none", b""), ("null", None),
        ("empty", b"\x01" + struct.pack("<Idd", 1, float("nan"), float("nan")))]
    df = spark.createDataFrame([(o, bytearray(w) if w is not None else None) for o, w in rows], "oid string, wkb binary")
    got = {r.oid: (r.gtype, r.reason, [tuple(p) for g in r.rings or [] for p in g.pts]) for r in decode_wkb(df).collect()}
    z = ("LINESTRING", None, [(1.0, 2.0), (4.0, 5.0)])
    assert got["iso_z"] == got["ewkb_z"] == z
    assert got["ewkb_srid"] == got["iso_zm"] == ("POINT", None, [(7.0, 8.0)])
    assert got["empty"] == ("POINT", None, [])
    assert {k: v[1] for k, v in got.items() if v[1]} == {
        "short": "malformed WKB", "kind": "malformed WKB", "order": "malformed WKB", "none": "malformed WKB",
        "null": "missing WKB"}
