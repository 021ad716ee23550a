"""Geometry collections in WKT lines become rows of their members."""

from geotables.sources.wkt_text import export_wkt, ingest_lines


def test_members_nesting_and_rejects(spark):
    deep = "GEOMETRYCOLLECTION (" * 3000 + "POINT (7 8)" + ")" * 3000
    rows = [("plain", "POINT (1 2)"), ("two", "GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)), LINESTRING (0 0, 1 1))"),
            ("nested", "GEOMETRYCOLLECTION(MULTIPOINT ((1 2), (3 4)),GEOMETRYCOLLECTION (POINT (5 6), GEOMETRYCOLLECTION EMPTY), POINT (9 9))"),
            ("deep", deep), ("open", "GEOMETRYCOLLECTION (POINT (1 2)"), ("early", "GEOMETRYCOLLECTION (POINT (1 2)), POINT (3 4)"),
            ("member", "GEOMETRYCOLLECTION (POINT (1 2), CIRCLE (3 4))"), ("bad", "GEOMETRYCOLLECTION (POINT (1 2), POLYGON ((0 0, 1 0)))"),
            ("empty", "GEOMETRYCOLLECTION EMPTY, POINT EMPTY")]
    lines = spark.createDataFrame([(f"{w}\t{o}\t{{}}",) for o, w in rows], "value string")
    good, rejects = ingest_lines(lines)
    assert {r.oid: r.wkt for r in export_wkt(good).collect()} == {
        "plain": "POINT (1 2)", "two#1": "POLYGON ((0 0, 1 0, 1 1, 0 0))", "two#2": "LINESTRING (0 0, 1 1)",
        "nested#1": "MULTIPOINT ((1 2), (3 4))", "nested#2": "POINT (5 6)", "nested#3": "POINT (9 9)", "deep#1": "POINT (7 8)",
        "member#1": "POINT (1 2)", "bad#1": "POINT (1 2)"}
    assert {r.oid: r.reason for r in rejects.collect()} == {
        "open": "malformed WKT", "early": "malformed WKT", "member#2": "unsupported geometry type", "bad#2": "ring too short",
        "empty": "malformed WKT"}
