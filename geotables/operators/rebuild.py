"""Polygons rebuilt from rings that cross, overlap or lie in the wrong rings.

Area rule: a place belongs to a feature if the shell of some part winds around it (its winding number is not zero) and no hole
of that part does. So both lobes of a bow-tie stay, places that a ring covers twice are covered once, and equal or overlapping
shells are united. (Buffering by zero keeps only what is wound around in the main direction and may lose a lobe.)

1. Noding: edges are cut where they meet other edges of their feature (the grid self-join of ``rings``). Crossing points are
   rounded to a grid of 2^-40 degrees, so crossings of several edges at a place become one node.
2. Winding: for every piece the edges above its middle are counted by ring, with their direction, by an equi-join on slabs (of
   the x-axis, or of the y-axis for vertical pieces, which are turned over). That says for both sides of the piece whether they
   belong to the feature; pieces with one side inside and one outside are the border.
3. Rings: the border pieces of a feature are chained with the inside to their left, rings that touch themselves are cut into
   simple ones, and holes go to the smallest shell around them. This last step sees the border of one feature at a time, as the
   pieces come sorted by feature, in batches that know nothing of features.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.functions.shapes import RINGS_T
from geotables.model import finish_features
from geotables.operators.rings import edges_of, close_rings_sql, meetings_of, orient_rings_sql, split_valid
from geotables.session import as_large, materialize

GRID = float(1 << 40)
MAX_SLABS = 4096


def _cut_points(meetings: DataFrame) -> DataFrame:
    """Where edges have to be cut: k, part, ring, i, x, y."""
    snap = lambda v: f"round(({v}) * {GRID!r}D) / {GRID!r}D"
    # the crossing point along a, from the signed distances of b's line
    t = ("try_divide((b_x1 - a_x1) * (b_y2 - b_y1) - (b_y1 - a_y1) * (b_x2 - b_x1), "
         "(a_x2 - a_x1) * (b_y2 - b_y1) - (a_y2 - a_y1) * (b_x2 - b_x1))")
    crossed = meetings.where("what = 'cross'").selectExpr("*", f"{t} AS t").selectExpr(
        "*", f"array(named_struct('x', {snap('a_x1 + t * (a_x2 - a_x1)')}, 'y', {snap('a_y1 + t * (a_y2 - a_y1)')})) AS ps").drop("t")
    ends = ", ".join(f"named_struct('x', {p}_x{j}, 'y', {p}_y{j})" for p in "ab" for j in (1, 2))
    inside = "p.x BETWEEN {0}_xmin AND {0}_xmax AND p.y BETWEEN {0}_ymin AND {0}_ymax"
    overlap = meetings.where("what = 'overlap'").selectExpr(
        "*", f"filter(array({ends}), p -> {inside.format('a')} AND {inside.format('b')}) AS ps")
    touch = meetings.where("what = 'touch'").selectExpr("*", "array(at) AS ps")
    cuts = crossed.unionByName(overlap).unionByName(touch)
    sides = [cuts.selectExpr("a_k AS k", f"{p}_part AS part", f"{p}_ring AS ring", f"{p}_i AS i", "explode(ps) AS p") for p in "ab"]
    return sides[0].unionByName(sides[1])


def _pieces(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """The edges in pieces between their cuts: k, part, ring, x1, y1, x2, y2."""
    ids = ["k", "part", "ring", "i"]
    met = cuts.groupBy(*ids).agg(F.collect_set("p").alias("ps"))
    along = ("abs(p.x - x1) + abs(p.y - y1)")
    rows = edges.join(as_large(met), ids, "left").selectExpr(
        "k", "part", "ring", "x1", "y1", "x2", "y2",
        "concat(array(named_struct('x', x1, 'y', y1)), transform(array_sort(transform(coalesce(ps, array()), "
        f"p -> named_struct('d', {along}, 'x', p.x, 'y', p.y))), p -> named_struct('x', p.x, 'y', p.y)), "
        "array(named_struct('x', x2, 'y', y2))) AS ps")
    rows = rows.selectExpr("k", "part", "ring", "inline(zip_with(slice(ps, 1, size(ps) - 1), slice(ps, 2, size(ps) - 1), "
                           "(p, q) -> named_struct('x1', p.x, 'y1', p.y, 'x2', q.x, 'y2', q.y)))")
    return rows.where("x1 <> x2 OR y1 <> y2")


def _sides(pieces: DataFrame) -> DataFrame:
    """One row per place of a piece (k, x1, y1, x2, y2 with (x1, y1) the smaller end) that lies on the border, and whether the
    feature is to its left."""
    spans = pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"{f}({g}({c}1, {c}2)) AS {c}{f}")
                                                                    for c in "xy" for f, g in (("min", "least"), ("max", "greatest"))])
    # turned: x and y exchanged, for pieces that are vertical; a turn changes the sign of all windings alike
    both = pieces.join(as_large(spans), "k").selectExpr(
        "k", "part", "ring", "n", "inline(array(named_struct('turned', false, 'x1', x1, 'y1', y1, 'x2', x2, 'y2', y2, 'lo', xmin, "
        "'hi', xmax), named_struct('turned', true, 'x1', y1, 'y1', x1, 'x2', y2, 'y2', x2, 'lo', ymin, 'hi', ymax)))")
    slabs = f"least(CAST(ceil(sqrt(n)) AS INT), {MAX_SLABS})"
    slab = lambda x: f"CAST(least(floor(({x} - lo) / greatest(hi - lo, 1e-300D) * {slabs}), {slabs} - 1) AS INT)"
    flat = both.where("x1 <> x2").selectExpr("*", "least(x1, x2) AS xl", "greatest(x1, x2) AS xr", "IF(x1 < x2, y1, y2) AS yl",
                                             "IF(x1 < x2, y2, y1) AS yr", "IF(x1 < x2, 1, -1) AS dir")
    # a place is asked about as it is, or turned if it is vertical
    places = flat.where("NOT turned OR yl = yr").selectExpr(
        "k", "turned", "xl", "yl", "xr", "yr", "(xl + xr) / 2D AS mx", "(yl + yr) / 2D AS my",
        f"{slab('(xl + xr) / 2D')} AS slab").distinct()
    above = flat.selectExpr("k", "turned", "part", "ring", "dir", "xl AS el", "xr AS er", "yl AS fl", "yr AS fr",
                            f"explode(sequence({slab('xl')}, {slab('xr')})) AS slab")
    met = places.join(as_large(above), ["k", "turned", "slab"]).where("mx >= el AND mx < er")
    same = "el = xl AND er = xr AND fl = yl AND fr = yr"
    met = met.selectExpr("k", "turned", "xl", "yl", "xr", "yr", "part", "ring", f"IF({same}, dir, 0) AS own",
                         f"IF(NOT ({same}) AND fl + (fr - fl) * ((mx - el) / (er - el)) > my, dir, 0) AS up")
    place = ["k", "turned", "xl", "yl", "xr", "yr"]
    # dealt out once, for all three steps
    wind = met.repartition(*place).groupBy(*place, "part", "ring").agg(F.sum("up").alias("over"), F.expr("sum(up) + sum(own)").alias("under"))
    parts = wind.groupBy(*place, "part").agg(*[F.expr(
        f"max(IF(ring = 0, {s} <> 0, false)) AND NOT max(IF(ring > 0, {s} <> 0, false)) AS {s}") for s in ("over", "under")])
    inside = parts.groupBy(*place).agg(F.max("over").alias("over"), F.max("under").alias("under")).where("over <> under")
    # the upper side of a piece that is not turned is its left one from its smaller end; of a turned one, its right one
    return inside.selectExpr("k", "IF(turned, yl, xl) AS x1", "IF(turned, xl, yl) AS y1", "IF(turned, yr, xr) AS x2",
                             "IF(turned, xr, yr) AS y2", "over <> turned AS left")


def _area(ring: list[tuple]) -> float:
    x0, y0 = ring[0]
    return math.fsum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:])) / 2


def _simple(ring: list[tuple]) -> list[list[tuple]]:
    """A closed ring cut where it comes back to a point it has visited."""
    out, path, at = [], [], {}
    for p in ring:
        if p in at:
            loop = path[at[p]:]
            out.append([*loop, p])
            for q in loop:
                del at[q]
            del path[len(path) - len(loop):]
        at[p] = len(path)
        path.append(p)
    return out


def _contains(ring: list[tuple], p: tuple) -> int:
    """1 inside, 0 on the ring, -1 outside."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > p[1]) != (by > p[1]):
            cross = (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
            if cross == 0:
                return 0
            odd ^= (cross > 0) == (by > ay)
        elif p in ((ax, ay), (bx, by)) or (ay == by == p[1] and min(ax, bx) <= p[0] <= max(ax, bx)):
            return 0
    return 1 if odd else -1


def _chained(pieces: list[tuple]) -> list[list[list[tuple]]]:
    """The parts of one feature, each its shell and then its holes, from its border pieces (x1, y1, x2, y2, left)."""
    out_of = {}
    for x1, y1, x2, y2, left in pieces:
        a, b = ((x1, y1), (x2, y2)) if left else ((x2, y2), (x1, y1))
        out_of.setdefault(a, []).append(b)
    shells, holes = [], []
    starts = sorted(out_of, reverse=True)
    while out_of:
        while starts[-1] not in out_of:
            starts.pop()
        start = starts[-1]
        ring, at, before = [start], start, None
        while True:
            options = out_of[at]
            if len(options) == 1:
                follow = options[0]
                del out_of[at]
            else:
                # the first way on, clockwise from the way back, bounds the same inside
                back = math.atan2(before[1] - at[1], before[0] - at[0]) if before else math.pi
                follow = min(options, key=lambda q: ((back - math.atan2(q[1] - at[1], q[0] - at[0])) % (2 * math.pi)) or 2 * math.pi)
                options.remove(follow)
            ring.append(follow)
            before, at = at, follow
            if at not in out_of:
                break
        for loop in _simple(ring):
            if len(loop) > 3:
                (shells if _area(loop) > 0 else holes).append(loop)
    shells.sort(key=_area)
    parts = [[s] for s in shells]
    for hole in holes:
        for part in parts:
            sides = [s for s in (_contains(part[0], p) for p in hole) if s]
            if _area(part[0]) > -_area(hole) and (not sides or sides[0] > 0):
                part.append(hole)
                break
    return parts


def _ring_rows(features: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    """Rows (k, rings) of chained features (k, parts)."""
    rings = [(i, j, ring) for _, parts in features for i, part in enumerate(parts) for j, ring in enumerate(part)]
    points = [p for *_, ring in rings for p in ring]
    ends = lambda sizes: pa.array([0, *itertools.accumulate(sizes)], pa.int32())
    xy = pa.StructArray.from_arrays([pa.array([p[c] for p in points], pa.float64()) for c in (0, 1)], ["x", "y"])
    pts = pa.ListArray.from_arrays(ends(len(ring) for *_, ring in rings), xy)
    numbers = [pa.array([r[c] for r in rings], pa.int32()) for c in (0, 1)]
    every = pa.ListArray.from_arrays(ends(sum(map(len, parts)) for _, parts in features),
                                     pa.StructArray.from_arrays([*numbers, pts], ["part", "ring", "pts"]))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in features], key_type), every], ["k", "rings"])


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features one by one from border pieces that come sorted by ``k``, whose runs may go over several batches."""
    known, pieces, key_type = None, [], None
    for batch in batches:
        keys, *columns = (c.to_pylist() for c in batch.columns)
        key_type, done = batch.schema.field(0).type, []
        for k, run in itertools.groupby(zip(keys, zip(*columns)), key=lambda row: row[0]):
            if pieces and k != known:
                done.append((known, _chained(pieces)))
                pieces = []
            known = k
            pieces += [row[1] for row in run]
        if done:
            yield _ring_rows(done, key_type)
    if pieces:
        yield _ring_rows([(known, _chained(pieces))], key_type)


def rebuild_rings(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, gtype, rings) of the polygonal features of ``df``, rebuilt by the area rule: shells counter-clockwise, holes
    clockwise; features that cover nothing have no row. ``key`` must tell features apart."""
    polys = df.where("gtype LIKE '%POLYGON%'").selectExpr(f"`{key}`", f"{close_rings_sql('rings')} AS rings")
    edges = materialize(edges_of(polys, key))
    pieces = materialize(_pieces(edges, _cut_points(materialize(meetings_of(edges)))))
    border = _sides(pieces)
    named = f"k {edges.schema['k'].dataType.simpleString()}, rings {RINGS_T}"
    pieces = border.select("k", "x1", "y1", "x2", "y2", "left").repartition("k").sortWithinPartitions("k")
    rings = pieces.mapInArrow(_chain_batches, named)
    return rings.where("size(rings) > 0").selectExpr(
        f"k AS `{key}`", "IF(exists(rings, r -> r.part > 0), 'MULTIPOLYGON', 'POLYGON') AS gtype", "rings")


def rebuilt_features(invalid: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of polygonal features that are not valid (with their ``reason``): rebuilt by the area rule, with new
    envelope, cell and key; those that cover nothing, or stay invalid all the same, keep their reason."""
    invalid = materialize(invalid)
    new = rebuild_rings(invalid, key).selectExpr(f"`{key}` AS _k", "gtype AS _gtype", "rings AS _rings")
    made = invalid.join(as_large(new), F.expr(f"`{key}` = _k")).selectExpr(
        f"`{key}` AS _old", *["_gtype AS gtype" if c == "gtype" else "_rings AS rings" if c == "rings" else f"`{c}`"
                              for c in invalid.columns if c not in ("key", "cell", "region", "xmin", "ymin", "xmax", "ymax", "reason")])
    good, _ = split_valid(finish_features(made), "_old")
    rejects = invalid.join(as_large(good.select(F.col("_old").alias("_k"))), F.expr(f"`{key}` = _k"), "left_anti")
    return good.select(*[c for c in invalid.columns if c != "reason"]), rejects


def repair_features(df: DataFrame, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) of a feature table: repeated points dropped, rings closed and turned the right way. Polygons that are
    still invalid (``check_rings``) are rejected with a reason, or with ``rebuild`` rebuilt by the area rule."""
    fixed = orient_rings_sql(close_rings_sql("rings"))
    rings = f"CASE WHEN gtype LIKE '%POLYGON%' THEN {fixed} ELSE rings END AS rings"
    good, bad = split_valid(df.selectExpr(*[rings if c == "rings" else f"`{c}`" for c in df.columns]))
    if not rebuild:
        return good, bad
    made, rejects = rebuilt_features(bad)
    return good.unionByName(made.select(*good.columns)), rejects
