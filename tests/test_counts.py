"""Counts that ride along with a running job."""

from features import features_from_wkt

from geotables.operators.counts import ingest_with_counts, overlay_with_counts
from geotables.operators.overlay import overlay_classes


def test_overlay_counts_and_classes(spark, tmp_path):
    box = lambda x, y, w, h: f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))"
    parcels, _ = features_from_wkt(spark, [(box(i % 5, i // 5, 1, 1), f"110000P{i:02d}", "{}") for i in range(15)])
    zones, _ = features_from_wkt(spark, [(box(0.5, 0.5, 1, 1), "110000Z1", '{"PDJB":"1"}'), (box(2, 0, 1, 1), "110000Z2", "{}"),
                                         (box(20, 20, 1, 1), "110000Z3", '{"PDJB":"2"}')])
    classes, counts = overlay_with_counts(parcels, zones)
    classes.write.parquet(str(tmp_path / "classes"))
    # the first zone overlaps four parcels, the second one and touches five of its neighbours
    assert counts.get() == {"n_parcels": 15, "n_zones": 3, "n_zones_no_tag": 1, "n_pairs": 10, "n_pairs_positive": 5,
                            "n_parcels_matched": 5}
    told = lambda df: sorted((r.oid, r.pd_class or "", r.overlap_area) for r in df.collect())
    assert told(spark.read.parquet(str(tmp_path / "classes"))) == told(overlay_classes(parcels, zones))


def test_ingest_counts(spark, tmp_path):
    lines = ["POINT (1 2)\ta\t{}", "point (1 2)\tb\t{}", "", "POINT (200 2)\tc\t{}", "POINT (1 2)\td",
             "GEOMETRYCOLLECTION (POINT (1 2), POINT (3 4))\te\t{}"]
    rows, counts = ingest_with_counts(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string"))
    rows.write.parquet(str(tmp_path / "rows"))
    assert counts.get() == {"n_lines": 7, "n_skipped": 3, "n_rows": 5, "n_rejected": 2}
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 5
