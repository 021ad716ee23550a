"""The grid join by measured density: results against the plain pairs, copies a feature and rows a key."""

import random

import pytest
from pyspark.sql import functions as F

from geotables.operators.spatial_join import grid_join, join_inputs

ENV_L, ENV_R = ("lx0", "ly0", "lx1", "ly1"), ("rx0", "ry0", "rx1", "ry1")


def boxes(spark, rows, p):
    return spark.createDataFrame(rows, f"{p}id int, {p}g string, {p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double")


def random_boxes(rng, n, sizes, groups="ab"):
    out = []
    for i in range(n):
        x, y, w, h = 100 + rng.random() * 8, 30 + rng.random() * 8, rng.choice(sizes), rng.choice(sizes)
        out.append((i, rng.choice(groups), x, y, x + w, y + h))
    return out


def pairs(left, right):
    return sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] is not None and b[2] is not None
                  and a[2] <= b[4] and a[4] >= b[2] and a[3] <= b[5] and a[5] >= b[3])


def sizes_of(inputs):
    """Rows of both sides over all joins, and the most rows of a side on one key."""
    n_l = n_r = most = 0
    for a, b, _ in inputs:
        n_l, n_r = n_l + a.count(), n_r + b.count()
        for side, p in ((a, "_gl_"), (b, "_gr_")):
            key = [c for c in side.columns if c in (f"{p}lvl", f"{p}ix", f"{p}iy", f"{p}run", f"{p}other", "lg", "rg")]
            most = max(most, side.groupBy(*key).count().agg(F.max("count")).first()[0] or 0)
    return n_l, n_r, most


@pytest.mark.parametrize("full_cell", [20_000, 7, 1])
def test_pairs_at_any_density(spark, full_cell):
    rng = random.Random(full_cell)
    left = random_boxes(rng, 150, [0.0, 0.01, 0.3]) + [(900, "a", None, None, None, None), (901, "a", 99.0, 29.0, 110.0, 40.0)]
    right = random_boxes(rng, 60, [0.0, 0.02, 0.5, 2.0]) + [(800 + i, "a", 104.0, 34.0, 104.0, 34.0) for i in range(20)] + [
        (700, "b", 90.0, 20.0, 120.0, 50.0)]
    left += [(500 + i, "a", 104.0, 34.0, 104.0, 34.0) for i in range(12)]
    got = grid_join(boxes(spark, left, "l"), boxes(spark, right, "r"), ENV_L, ENV_R, [("lg", "rg")], full_cell)
    assert sorted((r.lid, r.rid) for r in got.collect()) == pairs(left, right)


def test_one_point_copies_nothing(spark):
    rng = random.Random(3)
    left, zones = random_boxes(rng, 400, [0.05]), random_boxes(rng, 30, [0.4])
    before = sizes_of(join_inputs(boxes(spark, left, "l"), boxes(spark, zones, "r"), ENV_L, ENV_R, [("lg", "rg")], 100))
    point = [(99, "a", 103.0, 33.0, 103.0, 33.0)]
    after = sizes_of(join_inputs(boxes(spark, left, "l"), boxes(spark, zones + point, "r"), ENV_L, ENV_R, [("lg", "rg")], 100))
    assert after[0] == before[0] and after[1] - before[1] <= 4 and after[2] <= 100


def test_one_zone_over_everything(spark):
    rng = random.Random(4)
    left, zones = random_boxes(rng, 2000, [0.01], "a"), random_boxes(rng, 20, [0.1], "a")
    country = [(99, "a", 100.0, 30.0, 109.0, 39.0)]
    full = 50
    before = sizes_of(join_inputs(boxes(spark, left, "l"), boxes(spark, zones, "r"), ENV_L, ENV_R, [("lg", "rg")], full))
    inputs = join_inputs(boxes(spark, left, "l"), boxes(spark, zones + country, "r"), ENV_L, ENV_R, [("lg", "rg")], full)
    n_l, n_r, most = sizes_of(inputs)
    assert most <= full
    # a parcel meets the country in the cells it touches at that level, the country goes to every run of parcels once
    assert n_l - before[0] <= 4 * len(left) and n_r - before[1] <= len(left) / full + 8
    got = grid_join(boxes(spark, left, "l"), boxes(spark, zones + country, "r"), ENV_L, ENV_R, [("lg", "rg")], full)
    assert sorted((r.lid, r.rid) for r in got.collect()) == pairs(left, zones + country)


def test_far_levels_are_not_visited(spark):
    left = boxes(spark, [(i, "a", 100 + i / 100, 30.0, 100 + i / 100, 30.0) for i in range(50)], "l")
    right = boxes(spark, [(1, "a", 100.0, 30.0, 100.2, 30.2), (2, "a", -60.0, -30.0, -50.0, -20.0)], "r")
    n_l, _, _ = sizes_of(join_inputs(left, right, ENV_L, ENV_R, [("lg", "rg")]))
    assert n_l <= 21 + 50  # points of the small zone, and each at its own level
    assert grid_join(left, right, ENV_L, ENV_R).count() == 21
