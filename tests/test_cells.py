"""Geohash cells against a plain bit-by-bit version."""

import random

from geotables.functions import cells


def plain(lon, lat, chars=12):
    (x0, x1), (y0, y1), bits = (-180.0, 180.0), (-90.0, 90.0), []
    for i in range(chars * 5):
        if i % 2 == 0:
            mid = (x0 + x1) / 2
            bits.append(lon >= mid)
            x0, x1 = (mid, x1) if lon >= mid else (x0, mid)
        else:
            mid = (y0 + y1) / 2
            bits.append(lat >= mid)
            y0, y1 = (mid, y1) if lat >= mid else (y0, mid)
    return "".join(cells.GEOHASH_ALPHABET[int("".join("01"[b] for b in bits[i:i + 5]), 2)] for i in range(0, len(bits), 5))


def points(n=400):
    rng = random.Random(5)
    out = [(0.0, 0.0), (-180.0, -90.0), (180.0, 90.0), (-180.0, 90.0), (10.40744, 57.64911), (179.9999999, -89.9999999)]
    return out + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(n)] + [
        (rng.randrange(-180 * 64, 180 * 64) / 64, rng.randrange(-90 * 64, 90 * 64) / 64) for _ in range(n)]


def test_geohash_of_every_length(spark):
    pts = points()
    df = spark.createDataFrame(pts, "lon double, lat double")
    assert plain(10.40744, 57.64911) == "u4pruydqqvj8"
    for chars in (1, 2, 5, 7, 11, 12):
        got = [r[0] for r in df.selectExpr(cells.geohash_sql("lon", "lat", chars)).collect()]
        assert got == [plain(x, y, chars) for x, y in pts]
        back = df.selectExpr(cells.geohash_of_cell_sql(cells.cell_ix_sql("lon", chars), cells.cell_iy_sql("lat", chars), chars))
        assert [r[0] for r in back.collect()] == got


def test_common_cell_of_a_box(spark):
    rng = random.Random(6)
    boxes = [(x, y, min(x + d, 180.0), min(y + d * rng.random(), 90.0)) for x, y in points() for d in (0.0, 1e-7, 1e-3, 0.5, 20.0)]
    df = spark.createDataFrame([*boxes, (None, None, None, None)], "xmin double, ymin double, xmax double, ymax double")
    want = []
    for x0, y0, x1, y1 in boxes:
        a, b = plain(x0, y0), plain(x1, y1)
        n = next((i for i in range(12) if a[i] != b[i]), 12)
        want.append(a[:n])
    assert [r[0] for r in df.selectExpr(cells.envelope_cell_sql()).collect()] == [*want, ""]


def test_no_bit_strings_in_the_plan(spark):
    df = spark.range(1).selectExpr(cells.geohash_sql("1D * id", "2D * id"), cells.envelope_cell_sql("1D * id", "0D", "2D", "1D"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f in plan for f in ("conv(", "bin(", "regexp_replace"))
