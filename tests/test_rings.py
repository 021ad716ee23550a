"""Ring validity against JTS and exact signs against rational arithmetic."""

import random
from fractions import Fraction

from features import features_from_wkt

from geotables.functions.exact import orient_sign_sql, sum_sign_sql
from geotables.operators.rings import check_rings


def test_orientation_is_exact(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(1500):
        ax, ay, bx, by = (round(rng.uniform(100, 120), rng.choice([1, 3, 6, 12])) for _ in range(4))
        t = rng.choice([0.1, 0.25, 0.3, 0.5, 2.0, -1.0])
        cx, cy = ax + t * (bx - ax), ay + t * (by - ay)
        for _ in range(rng.randrange(3)):
            cx = cx * (1 + rng.choice([-1, 0, 1]) * 2.0 ** -52)
        rows.append((ax, ay, bx, by, cx, cy))
    rows += [(0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (1e-3, 1e-3, 1e5 + 0.1, 1e5 + 0.1, 7.7, 7.7), (0.0, 0.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double")
    got = [r[0] for r in df.selectExpr(orient_sign_sql("ax", "ay", "bx", "by", "cx", "cy")).collect()]
    want = []
    for ax, ay, bx, by, cx, cy in (tuple(map(Fraction, r)) for r in rows):
        d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        want.append((d > 0) - (d < 0))
    assert got == want and {-1, 0, 1} <= set(got[:1500])
    rounded = [(a - x) * (d - y) - (b - y) * (c - x) for a, b, c, d, x, y in rows]
    assert any((r > 0) - (r < 0) != w for r, w in zip(rounded, want))  # plain doubles get some of them wrong


def test_sum_sign(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        v = [rng.uniform(-1, 1) * 2.0 ** rng.randrange(-60, 60) for _ in range(6)]
        v += [-x for x in v] + [rng.choice([0.0, 2.0 ** -80, -2.0 ** -70])]
        rng.shuffle(v)
        rows.append((v,))
    got = [r[0] for r in spark.createDataFrame(rows, "t array<double>").selectExpr(sum_sign_sql("t")).collect()]
    assert got == [(s > 0) - (s < 0) for s in (sum(map(Fraction, v)) for v, in rows)]


def ring(pts):
    return "(" + ", ".join(f"{x} {y}" for x, y in [*pts, pts[0]]) + ")"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def random_ring(rng, size):
    x, y, w, h = rng.randrange(size), rng.randrange(size), rng.randrange(1, size // 2 + 2), rng.randrange(1, size // 2 + 2)
    kind = rng.randrange(4)
    if kind == 0:
        return [(x, y), (x + w, y), (x, y + h)]
    if kind == 1:
        return [(x, y + h), (x + w, y), (x + 2 * w, y + h), (x + w, y + 2 * h)]
    return box(x, y, w, h)


def random_multipolygon(rng):
    parts = []
    for _ in range(rng.randrange(1, 4)):
        big = rng.random() < 0.5
        shell = box(0, 0, 10, 10) if big else random_ring(rng, 8)
        holes = [random_ring(rng, 6) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]) if big else rng.choice([0, 0, 0, 1]))]
        if rng.random() < 0.3:
            dx = rng.choice([0, 10, 20])
            shell, holes = [(x + dx, y) for x, y in shell], [[(x + dx, y) for x, y in h] for h in holes]
        parts.append("(" + ", ".join(map(ring, [shell, *holes])) + ")")
    return "MULTIPOLYGON (" + ", ".join(parts) + ")"


def test_random_multipolygons_agree_with_jts(spark):
    rng = random.Random(5)
    texts = [random_multipolygon(rng) for _ in range(700)]
    f, rejects = features_from_wkt(spark, [(w, f"m{i}", "{}") for i, w in enumerate(texts)])
    got = {r.oid: (r.valid, r.reason) for r in check_rings(f).collect()}
    reader = spark.sparkContext._jvm.org.locationtech.jts.io.WKTReader()
    valid = [reader.read(w).isValid() for w in texts]
    wrong = [(w, v, got[f"m{i}"]) for i, (w, v) in enumerate(zip(texts, valid)) if got[f"m{i}"][0] != v]
    assert not wrong, (len(wrong), wrong[:3])
    assert 50 < sum(valid) < 650 and len({r for _, r in got.values()}) >= 6


def test_reasons(spark):
    square = ring(box(0, 0, 4, 4))
    cases = {
        "equal": (f"MULTIPOLYGON (({square}), ({square}))", "overlapping edges"),
        "shell_in_shell": (f"MULTIPOLYGON (({square}), ({ring(box(1, 1, 1, 1))}))", "nested shells"),
        "shell_in_hole": (f"MULTIPOLYGON (({square}, {ring(box(1, 1, 2, 2))}), ({ring(box(1.5, 1.5, 1, 1))}))", None),
        "shell_touching_in_hole": (f"MULTIPOLYGON (({square}, {ring(box(1, 1, 2, 2))}), ({ring([(1, 2), (2, 1.5), (2, 2.5)])}))", None),
        "shared_border": (f"MULTIPOLYGON (({square}), ({ring(box(4, 1, 2, 2))}))", "overlapping edges"),
        "corner": (f"MULTIPOLYGON (({square}), ({ring(box(4, 4, 2, 2))}))", None),
        "hole_in_hole": (f"POLYGON ({square}, {ring(box(1, 1, 2, 2))}, {ring(box(1.5, 1.5, 1, 1))})", "nested holes"),
        "hole_out": (f"POLYGON ({square}, {ring(box(5, 5, 1, 1))})", "hole outside shell"),
        "hole_touching_out": (f"POLYGON ({square}, {ring(box(4, 4, 1, 1))})", "hole outside shell"),
        "hole_fills": (f"POLYGON ({square}, {square})", "hole fills shell"),
        "spike": ("POLYGON ((0 0, 4 0, 4 6, 4 4, 0 4, 0 0))", "self-crossing"),
        "through_a_vertex": (f"MULTIPOLYGON (({square}), ({ring([(2, 2), (4, 4), (6, 3), (5, 1)])}))", "self-crossing"),
        "bow": ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "self-crossing"),
        "cut_by_hole": (f"POLYGON ({square}, {ring([(0, 2), (2, 1), (4, 2), (2, 3)])})", "disconnected interior"),
        "cut_by_two_holes": (f"POLYGON ({square}, {ring([(0, 2), (1, 1), (2, 2), (1, 3)])}, {ring([(2, 2), (3, 1), (4, 2), (3, 3)])})",
                             "disconnected interior"),
        "two_holes_touching": (f"POLYGON ({square}, {ring([(0, 2), (1, 1), (2, 2), (1, 3)])}, "
                               f"{ring([(2, 2), (3, 1), (3.5, 2), (3, 3)])})", None)}
    f, _ = features_from_wkt(spark, [(w, k, "{}") for k, (w, _) in cases.items()])
    assert {r.oid: r.reason for r in check_rings(f).collect()} == {k: r for k, (_, r) in cases.items()}
    reader = spark.sparkContext._jvm.org.locationtech.jts.io.WKTReader()
    assert {k: reader.read(w).isValid() for k, (w, _) in cases.items()} == {k: r is None for k, (_, r) in cases.items()}


def test_growing_sides_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Edges and what is found of them grow with the table, however small Spark takes them to be."""
    from geotables.operators import rings, spatial_join
    from geotables.operators.rebuild import repair_features
    monkeypatch.setattr(spatial_join, "SMALL_SIDE", 0)
    square = ring(box(0, 0, 4, 4))
    f, _ = features_from_wkt(spark, [(f"MULTIPOLYGON (({square}), ({ring(box(1, 1, 1, 1))}))", "a", "{}"),
                                     (f"POLYGON ({square}, {ring(box(4, 1, 1, 1))})", "b", "{}"), (f"POLYGON ({square})", "c", "{}")])
    f.write.parquet(str(tmp_path / "f"))
    f = spark.read.schema(f.schema).parquet(str(tmp_path / "f"))  # a small file, as Spark sees it
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    edges = rings.materialize(rings.edges_of(f, "oid"))
    meetings = rings.meetings_of(edges)
    touching = rings._touching(meetings)
    good, bad = repair_features(f)
    for df in (meetings, rings._rings_inside(edges, None), rings._rings_inside(edges, touching), rings.check_rings(f), good, bad,
               *repair_features(f, rebuild=True)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_signs_as_columns(spark):
    """Signs of several lines at once, of points on a grid, off it and on no grid at all, and with nulls."""
    from geotables.functions.exact import with_orient_signs
    rng = random.Random(4)
    rows = []
    for i in range(400):
        ax, ay, dx, dy = (rng.randrange(-500, 500) / 64 for _ in range(4))
        k = rng.choice([0.5, 2.0, 3.0, 0.1])
        cx, cy = ax + k * dx, ay + k * dy
        if i % 3:
            ax, cx = ax + rng.choice([0.0, 0.1, 1e-13]), cx * (1 + rng.choice([0, 2.0 ** -52]))
        rows.append((ax, ay, ax + dx, ay + dy, cx, cy))
    rows += [(1e17, 1.0, 0.1, 0.1, 1e-17, 0.3), (0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (None, 0.0, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double")
    names = ("ax", "ay", "bx", "by", "cx", "cy")
    got = with_orient_signs(df, {"abc": names, "bca": (*names[2:], *names[:2]), "bac": (*names[2:4], *names[:2], *names[4:])}).collect()
    for r, row in zip(got, rows):
        if None in row:
            want = 0
        else:
            ax, ay, bx, by, cx, cy = map(Fraction, row)
            d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
            want = (d > 0) - (d < 0)
        assert (r.abc, r.bca, r.bac) == (want, want, -want), row
    assert {r.abc for r in got} == {-1, 0, 1} and got[0].asDict().keys() == {*names, "abc", "bca", "bac"}


def test_features_with_many_edges(spark, monkeypatch):
    """The grid of features with many edges and the plain pairs of others find the same."""
    from geotables.operators import rings
    rng = random.Random(6)
    texts = [random_multipolygon(rng) for _ in range(150)]
    f, _ = features_from_wkt(spark, [(w, f"m{i}", "{}") for i, w in enumerate(texts)])
    found = []
    for few in (64, 9, 0):
        monkeypatch.setattr(rings, "FEW_EDGES", few, raising=False)
        found.append(sorted((r.oid, str(r.reason)) for r in check_rings(f).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 150


def test_an_exact_sign_is_planned_once(spark):
    """A task spends seconds on a plan that has the exact expression for every sign, however few its rows are."""
    from geotables.operators import rings
    square = ring(box(0, 0, 4, 4))
    f, _ = features_from_wkt(spark, [(f"MULTIPOLYGON (({square}), ({ring(box(4, 4, 1, 1))}))", "a", "{}")])
    edges = rings.materialize(rings.edges_of(f, "oid"))
    meetings = rings.materialize(rings.meetings_of(edges))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    try:
        assert 0 < size(rings._touching(meetings)) < 40_000 and 0 < size(rings.meetings_of(edges)) < 40_000
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
