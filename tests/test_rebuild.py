"""Rebuilt polygons: areas against faces and winding numbers from JTS, validity, and the readers' options."""

import random

from features import features_from_wkt
from test_rings import box, random_multipolygon, ring

from geotables.functions.shapes import area_sql
from geotables.operators.rebuild import rebuild_rings, repair_features
from geotables.sources.geo_table import read_repaired, write_geo_table
from geotables.sources.wkt_text import ingest_lines, wkt_sql


def winding(points, x, y):
    n = 0
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        if (ay <= y) != (by <= y):
            side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
            n += (side > 0) - (side < 0) if (by > ay) == (side > 0) else 0
    return n


def expected_area(spark, wkt):
    """Faces of all lines by JTS, those whose inner point the area rule takes."""
    jvm = spark.sparkContext._jvm
    geom = jvm.org.locationtech.jts.io.WKTReader().read(wkt)
    polygonizer = jvm.org.locationtech.jts.operation.polygonize.Polygonizer()
    polygonizer.add(geom.getBoundary().union())
    rings = lambda p: [[(c.getX(), c.getY()) for c in r.getCoordinates()] for r in
                       [p.getExteriorRing(), *[p.getInteriorRingN(i) for i in range(p.getNumInteriorRing())]]]
    parts = [rings(geom.getGeometryN(i)) for i in range(geom.getNumGeometries())]
    total = 0.0
    for face in polygonizer.getPolygons():
        p = face.getInteriorPoint()
        if any(winding(part[0], p.getX(), p.getY()) and not any(winding(h, p.getX(), p.getY()) for h in part[1:]) for part in parts):
            total += face.getArea()
    return total


def random_loop(rng):
    pts = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(4, 9))]
    pts = [p for i, p in enumerate(pts) if p != pts[i - 1]]
    return f"POLYGON ({ring(pts)})" if len(pts) > 2 else f"POLYGON ({ring(box(0, 0, 1, 1))})"


def test_areas_and_validity(spark):
    rng = random.Random(9)
    texts = [random_loop(rng) for _ in range(80)] + [random_multipolygon(rng) for _ in range(80)]
    texts += ["POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON ((5 0, 8 9, 0 3, 10 3, 2 9, 5 0))",
              f"MULTIPOLYGON (({ring(box(0, 0, 4, 4))}), ({ring(box(0, 0, 4, 4))}))"]
    f, _ = features_from_wkt(spark, [(w, f"m{i}", "{}") for i, w in enumerate(texts)])
    got = {r.oid: r for r in rebuild_rings(f, "oid").selectExpr("oid", f"{area_sql()} AS area", f"{wkt_sql()} AS wkt").collect()}
    reader = spark.sparkContext._jvm.org.locationtech.jts.io.WKTReader()
    for i, w in enumerate(texts):
        want, r = expected_area(spark, w), got.get(f"m{i}")
        assert abs((r.area if r else 0.0) - want) < 1e-9, (w, want, r)
        assert r is None or reader.read(r.wkt).isValid(), (w, r.wkt)
    assert abs(got["m160"].area - 2.0) < 1e-12 and got["m162"].area == 16.0


def test_repair_options(spark, tmp_path):
    rows = [("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "bow", "{}"), (f"POLYGON ({ring(box(0, 0, 4, 4))})", "square", "{}"),
            ("POLYGON ((0 0, 3 0, 0 0, 0 0))", "flat", "{}"), ("POINT (1 1)", "point", "{}")]
    lines = spark.createDataFrame([("\t".join(r),) for r in rows], "value string")
    good, bad = ingest_lines(lines, repair="rebuild")
    kept = {r.oid: r for r in good.collect()}
    assert set(kept) == {"bow", "square", "point"} and [r.oid for r in bad.collect()] == ["flat"]
    assert kept["bow"].gtype == "MULTIPOLYGON" and (kept["bow"].xmin, kept["bow"].xmax) == (0.0, 2.0)
    stored, _ = features_from_wkt(spark, rows)
    write_geo_table(stored, str(tmp_path / "t"))
    good, bad = read_repaired(spark, str(tmp_path / "t"))
    assert {r.oid for r in good.collect()} == {"square", "point"} and {r.oid for r in bad.collect()} == {"bow", "flat"}
    good, bad = read_repaired(spark, str(tmp_path / "t"), num_partitions=3, rebuild=True)
    assert {r.oid: r.a for r in good.selectExpr("oid", f"{area_sql()} AS a").collect()} == {"square": 16.0, "point": 0.0, "bow": 2.0}
    assert [(r.oid, r.reason) for r in bad.collect()] == [("flat", "overlapping edges")]
    assert repair_features(stored.where("oid = 'square'"), rebuild=True)[0].count() == 1


def test_rebuilding_takes_many_features_a_task(spark):
    """Border pieces are chained feature by feature, but not by a call of Spark for each of them; runs of a feature's pieces may go
    over several batches."""
    rng = random.Random(3)
    texts = [random_loop(rng) for _ in range(40)] + [random_multipolygon(rng) for _ in range(40)]
    f, _ = features_from_wkt(spark, [(w, f"m{i}", "{}") for i, w in enumerate(texts)])
    told = lambda df: sorted((r.oid, r.gtype, str(r.rings)) for r in df.collect())
    rebuilt = rebuild_rings(f, "oid")
    plan = rebuilt._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    want = told(rebuilt)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert told(rebuild_rings(f, "oid")) == want and len(want) > 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
