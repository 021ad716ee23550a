"""Windows and joins by cells of different lengths, zone streams, and nested or mixed WKB."""

import itertools
import random
import struct

import pytest
from features import features_from_wkt

from geotables.operators.nested_cells import nested_cell_join
from geotables.operators.overlay import best_of_contenders, contenders, overlay_classes, parcel_side, zone_side
from geotables.operators.range_query import range_query_many
from geotables.operators.window_scan import scan_windows, window_cover
from geotables.sources.geo_table import read_geo_table, write_geo_table
from geotables.sources.wkb import decode_wkb

WINDOWS = "window_id int, xmin double, ymin double, xmax double, ymax double"


def features(spark, n=250):
    rng = random.Random(8)
    rows = [(f"POINT ({rng.uniform(-180, 180):.3f} {rng.uniform(-90, 90):.3f})", f"p{i}", "{}") for i in range(n)]
    for i in range(60):
        x, y, d = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([1e-4, 0.1, 1.5])
        rows.append((f"LINESTRING ({x} {y}, {x + d} {y + d})", f"l{i}", "{}"))
    return features_from_wkt(spark, rows)[0]


def windows(spark):
    rng = random.Random(2)
    rows = [(0, -180.0, -90.0, 180.0, 90.0), (1, -1.0, -1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0, 0.0)]
    for i in range(3, 25):
        x, y, d = rng.uniform(-170, 170), rng.uniform(-80, 80), rng.choice([0.01, 3.0, 40.0])
        rows.append((i, x, y, min(x + d, 180.0), min(y + d / 2, 90.0)))
    return spark.createDataFrame(rows, WINDOWS)


@pytest.mark.parametrize("prefix_len", [1, 2])
def test_window_scan_equals_the_join(spark, tmp_path, prefix_len):
    f, w = features(spark), windows(spark)
    write_geo_table(f, str(tmp_path / "t"), prefix_len)
    table = read_geo_table(spark, str(tmp_path / "t"))
    want = sorted((r.window_id, r.oid) for r in range_query_many(f, w).collect())
    got = scan_windows(table, w)
    assert sorted((r.window_id, r.oid) for r in got.collect()) == want and len(want) > 300
    few = scan_windows(table, w.where("window_id = 2"))
    assert "dynamicpruning" in few._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((r.window_id, r.oid) for r in scan_windows(f, w).collect()) == want  # no stored layout: nothing pruned
    assert scan_windows(table, w.where("false")).count() == 0


def test_cover_is_free_of_nesting(spark):
    cells = {}
    for r in window_cover(windows(spark)).collect():
        cells.setdefault(r.window_id, []).append(r.cell)
    for found in cells.values():
        assert len(found) == len(set(found))
        assert not any(a != b and a.startswith(b) for a, b in itertools.product(found, found))
    assert len({len(c) for found in cells.values() for c in found}) > 3


def test_a_table_without_layout_is_read(spark, tmp_path):
    f = features(spark, 20)
    f.selectExpr("*", "coalesce(nullif(substring(cell, 1, 1), ''), '_') AS cell_prefix").write.partitionBy("cell_prefix").parquet(
        str(tmp_path / "t"))
    assert read_geo_table(spark, str(tmp_path / "t")).count() == f.count()


@pytest.mark.parametrize("full_block", [20_000, 5])
def test_nested_cells(spark, full_block):
    rng = random.Random(3)
    cell = lambda: "".join(rng.choice("0s") for _ in range(rng.randrange(0, 7)))
    left = [(i, cell()) for i in range(120)] + [(500 + i, "") for i in range(15)] + [(900, None)]
    right = [(i, cell()) for i in range(50)] + [(500 + i, "s0") for i in range(15)] + [(7, "s0s")] * 2 + [(900, None)]
    got = nested_cell_join(spark.createDataFrame(left, "a int, ca string"), spark.createDataFrame(right, "b int, cb string"),
                           "ca", "cb", full_block)
    want = sorted((a, b) for a, x in left for b, y in right
                  if x is not None and y is not None and (x.startswith(y) or y.startswith(x)))
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_contenders_of_any_split(spark):
    rng = random.Random(4)
    box = lambda x, y, w, h: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"
    parcels, _ = features_from_wkt(spark, [(box(i % 6, i // 6, 1, 1), f"110000P{i:02d}", "{}") for i in range(24)])
    zones, _ = features_from_wkt(spark, [(box(rng.randrange(6), rng.randrange(4), rng.choice([1, 2]), 1), f"110000Z{i:02d}",
                                          '{"PDJB":"%d"}' % (i % 5)) for i in range(16)])
    told = lambda df: sorted((r.oid, r.pd_class, round(r.overlap_area, 9)) for r in df.collect())
    want = told(overlay_classes(parcels, zones))
    p = parcel_side(parcels)
    parts = [contenders(p, zone_side(zones.where(f"substring(oid, -1, 1) IN ({s})"), "PDJB"))
             for s in ("'1','2','3'", "'0','4','9'", "'5','6','7','8','0'")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert told(best_of_contenders(rows, p.select("p_key", "p_oid"))) == want


def test_nested_and_mixed_wkb_are_rejects(spark):
    head = lambda code, n: struct.pack(">bII", 0, code, n)
    point = struct.pack(">bIdd", 0, 1, 1.0, 2.0)
    polygon = head(3, 1) + struct.pack(">I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    rows = [("deep", head(4, 1) * 3000 + point), ("polygon_in_points", head(4, 1) + polygon), ("point_in_lines", head(5, 1) + point),
            ("points", head(4, 2) + point * 2), ("polygons", head(6, 1) + polygon), ("huge_count", head(4, 2 ** 32 - 1) + point)]
    got = {r.oid: (r.gtype, r.reason) for r in decode_wkb(spark.createDataFrame(
        [(o, bytearray(w)) for o, w in rows], "oid string, wkb binary")).collect()}
    bad = (None, "malformed WKB")
    assert got == {"deep": bad, "polygon_in_points": bad, "point_in_lines": bad, "huge_count": bad,
                   "points": ("MULTIPOINT", None), "polygons": ("MULTIPOLYGON", None)}


@pytest.mark.parametrize("max_heads", [2000, 3])
def test_many_prefixes(spark, tmp_path, monkeypatch, max_heads):
    from geotables.sources import geo_table
    monkeypatch.setattr(geo_table, "MAX_HEADS", max_heads)
    f = features(spark)
    write_geo_table(f, str(tmp_path / "t"))
    table = read_geo_table(spark, str(tmp_path / "t"))
    chars = "0123456789bcdefghjkmnpqrstuvwxyz"
    prefixes = [a + b for a in chars for b in chars if b not in "58"] + [a + b + "7" for a in chars for b in "58"] + \
        ["_", "s_", "_l1", "k", "A", "it's", "7zz_p"]
    keys = [r.key for r in f.collect()]
    want = sorted(k for k in keys if any(k.startswith(p) for p in prefixes))
    got = geo_table.scan_by_cell_prefix(table, spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    assert sorted(r.key for r in got.collect()) == want and 0 < len(want) < len(keys)
    few = geo_table.scan_by_cell_prefix(table, spark.createDataFrame([("s",), ("_",), ("7z_",)], "prefix string"))
    assert sorted(r.key for r in few.collect()) == sorted(k for k in keys if k.startswith(("s", "_", "7z_")))


def test_nested_cells_spread_their_pairs(spark, monkeypatch):
    """Few rows that give many pairs are no work for one task."""
    from geotables.operators import nested_cells
    monkeypatch.setattr(nested_cells, "FULL_KEY", 2000, raising=False)
    left = spark.createDataFrame([(i, "" if i % 2 else "s") for i in range(400)], "a int, ca string")
    right = spark.createDataFrame([(i, "s00"[:i % 4]) for i in range(100)], "b int, cb string")
    got = nested_cells.nested_cell_join(left, right, "ca", "cb")
    sizes = got.selectExpr("spark_partition_id() AS task").groupBy("task").count().collect()
    assert sum(r["count"] for r in sizes) == 400 * 100
    assert max(r["count"] for r in sizes) < 400 * 100 / 4


def test_nested_cells_ship_rows_not_pairs(spark, monkeypatch):
    """What travels grows with the tables: a row at the top is not sent to every cell below it."""
    from geotables.operators import nested_cells
    monkeypatch.setattr(nested_cells, "FULL_KEY", 10_000)
    chars = "0123456789bcdefghjkmnpqrstuvwxyz"
    lower = [(1000 + i, a + b) for i, (a, b) in enumerate(itertools.product(chars, chars))]
    top = [(i, "") for i in range(300)]
    kind, sent = type(spark.range(0)), []
    deal = kind.repartition

    def dealt(df, *a):
        sent.append(df.selectExpr("size(_rows) AS n" if "_rows" in df.columns else "size(_right) AS n" if "_right" in df.columns else "1 AS n")
                    .groupBy().sum("n").first()[0])
        return deal(df, *a)
    frames = [spark.createDataFrame(rows, f"{c} int, c{c} string") for rows, c in ((top + lower, "a"), (top + lower, "b"))]
    monkeypatch.setattr(kind, "repartition", dealt)
    got = nested_cells.nested_cell_join(*frames, "ca", "cb")
    n = len(top) + len(lower)
    assert got.count() == len(top) ** 2 + 2 * len(top) * len(lower) + len(lower)
    assert len(sent) == 2 and sum(sent) < 10 * 2 * n  # the pairs are 265 times as many as the rows


def test_nested_cells_keep_columns_and_repeats(spark):
    """Rows that are equal stay as often as they come, nulls in other columns stay, and columns keep names and order."""
    left = spark.createDataFrame([(1, "", None), (1, "", None), (2, "s", "x"), (None, "s0", "y")], "`a 1` int, ca string, t string")
    right = spark.createDataFrame([("s", 5.0), ("s", 5.0), ("", None), ("u", 1.0)], "cb string, v double")
    got = nested_cell_join(left, right, "ca", "cb")
    assert got.columns == ["a 1", "ca", "t", "cb", "v"] and [t for _, t in got.dtypes] == ["int", "string", "string", "string", "double"]
    want = [(*x, *y) for x in left.collect() for y in right.collect() if x.ca.startswith(y.cb) or y.cb.startswith(x.ca)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) == 2 * 4 + 3 + 3


def test_stream_batches_use_all_cores(spark, tmp_path, monkeypatch):
    """A micro-batch of one file is not the work of one task."""
    from geotables.streaming import overlay_stream
    box = lambda x, y: f"POLYGON (({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))"
    parcels, _ = features_from_wkt(spark, [(box(i % 6, i // 6), f"110000P{i:02d}", "{}") for i in range(24)])
    zones, _ = features_from_wkt(spark, [(box(i, 1.5), f"110000Z{i:02d}", '{"PDJB":"%d"}' % (i % 5)) for i in range(4)])
    parcels.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, side = [], overlay_stream.parcel_side
    monkeypatch.setattr(overlay_stream, "parcel_side", lambda df: seen.append(df.rdd.getNumPartitions()) or side(df))
    stream = spark.readStream.schema(parcels.schema).parquet(str(tmp_path / "in"))
    overlay_stream.start_overlay_stream(stream, zones, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert seen == [spark.sparkContext.defaultParallelism]
    told = lambda df: sorted((r.oid, r.pd_class) for r in df.collect())
    assert told(spark.read.parquet(str(tmp_path / "out"))) == told(overlay_classes(parcels, zones))
