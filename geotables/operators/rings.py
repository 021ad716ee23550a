"""Ring checks: orientation, crossings, touches and nesting.

Orientation is column arithmetic per ring. The edges of a feature are small boxes, of which only those that meet are compared: a
feature of ``FEW_EDGES`` at most is joined with itself as it is, others by ``grid_join`` (equi on the feature), without a
comparison of all pairs. The signs that decide are exact (``functions.exact``). How rings lie in each other follows from the edges where they touch, and for rings that don't touch from
one point of a ring and the edges above it, an equi-join on slabs of the x-axis.

A polygonal feature is invalid when

    self-crossing           edges cross, a ring touches itself, or two rings cross at a point they touch
    hole fills shell        a hole is no smaller than its shell
    overlapping edges       two edges have a piece in common (equal rings, spikes, shells with a common border)
    hole outside shell      a hole does not lie in its shell
    nested holes            a hole lies in a hole of the same shell
    nested shells           a shell lies in another shell, and in none of its holes
    disconnected interior   rings of a part touch in a circle, so that its interior falls apart
    ring too short          a ring has fewer than three different points

and the first of these that applies is its reason. Rings may touch in single points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.functions.exact import orient_sign_sql, with_orient_signs
from geotables.functions.shapes import let_sql, ring_signed_area_sql
from geotables.operators.spatial_join import bbox_overlaps_sql, grid_join
from geotables.session import as_large, materialize

REASONS = ["self-crossing", "hole fills shell", "overlapping edges", "hole outside shell", "nested holes", "nested shells",
           "disconnected interior", "ring too short"]
MAX_SLABS = 4096
FEW_EDGES = 64   # up to so many edges of a feature are all held against each other


def orient_rings_sql(rings: str = "rings") -> str:
    """Shells counter-clockwise, holes clockwise (reversing rings that are the other way round)."""
    return (f"transform({rings}, r -> CASE WHEN ({ring_signed_area_sql('r.pts')} < 0D) = (r.ring = 0) "
            f"THEN named_struct('part', r.part, 'ring', r.ring, 'pts', reverse(r.pts)) ELSE r END)")


def close_rings_sql(rings: str = "rings") -> str:
    """Append the first point to rings whose last point differs, and drop consecutive repeated points."""
    dedup = "filter(r.pts, (p, i) -> CASE WHEN i = 0 THEN true ELSE p != r.pts[i - 1] END)"
    closed = let_sql(dedup, "d", "CASE WHEN size(d) > 0 AND element_at(d, 1) != element_at(d, -1) "
                                 "THEN concat(d, array(element_at(d, 1))) ELSE d END")
    return f"transform({rings}, r -> named_struct('part', r.part, 'ring', r.ring, 'pts', {closed}))"


def edges_of(polys: DataFrame, key: str) -> DataFrame:
    """One row per edge: key, part, ring, i (position), n (edges in ring), endpoints and box; and of its ring whether the enclosed
    side is the left one (ccw), area and box; and of its feature the numbers of rings and edges and the x-range."""
    r = polys.selectExpr(f"`{key}` AS k", "size(rings) AS n_rings", "explode(transform(rings, r -> named_struct("
                         f"'part', r.part, 'ring', r.ring, 'pts', r.pts, 'area', {ring_signed_area_sql('r.pts')}, "
                         "'x0', array_min(transform(r.pts, p -> p.x)), 'y0', array_min(transform(r.pts, p -> p.y)), "
                         "'x1', array_max(transform(r.pts, p -> p.x)), 'y1', array_max(transform(r.pts, p -> p.y))))) AS r",
                         "array_min(transform(rings, r -> array_min(transform(r.pts, p -> p.x)))) AS fx0",
                         "array_max(transform(rings, r -> array_max(transform(r.pts, p -> p.x)))) AS fx1",
                         "aggregate(rings, 0, (s, r) -> s + greatest(size(r.pts) - 1, 0)) AS n_edges")
    e = r.selectExpr("k", "n_rings", "n_edges", "fx0", "fx1", "r.part AS part", "r.ring AS ring", "r.area > 0D AS ccw", "abs(r.area) AS area",
                     "r.x0 AS rx0", "r.y0 AS ry0", "r.x1 AS rx1", "r.y1 AS ry1", "size(r.pts) - 1 AS n",
                     "posexplode(zip_with(slice(r.pts, 1, greatest(size(r.pts) - 1, 0)), "
                     "slice(r.pts, 2, greatest(size(r.pts) - 1, 0)), (p, q) -> named_struct('p', p, 'q', q))) AS (i, s)")
    return e.selectExpr("k", "part", "ring", "n", "i", "s.p.x AS x1", "s.p.y AS y1", "s.q.x AS x2", "s.q.y AS y2",
                        "least(s.p.x, s.q.x) AS xmin", "least(s.p.y, s.q.y) AS ymin",
                        "greatest(s.p.x, s.q.x) AS xmax", "greatest(s.p.y, s.q.y) AS ymax",
                        "n_rings", "n_edges", "fx0", "fx1", "ccw", "area", "rx0", "ry0", "rx1", "ry1")


def split_valid(df: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(valid features, the others with ``reason``) of features whose rings are closed and without repeated points.
    Features that are no polygons are valid."""
    df = materialize(df)
    bad = materialize(check_rings(df, key).where("NOT valid").select(key, "reason"))  # read for both results
    return (df.join(as_large(bad.select(key)), key, "left_anti").select(*df.columns),
            df.join(as_large(bad), key).select(*df.columns, "reason"))


SAME_RING = "(a_part = b_part AND a_ring = b_ring)"
FIRST = "(a_part < b_part OR (a_part = b_part AND (a_ring < b_ring OR (a_ring = b_ring AND a_i < b_i))))"


def meetings_of(edges: DataFrame) -> DataFrame:
    """Pairs of edges of a feature that cross, overlap or touch, each pair once in either order: the columns of both, and ``what``:
    'cross', 'overlap' or 'touch'. Edges that follow each other in a ring touch by nature and are not told unless they overlap."""
    narrow = ["k", "part", "ring", "n", "i", "x1", "y1", "x2", "y2", "xmin", "ymin", "xmax", "ymax", "ccw"]
    few, many = (edges.where(f"n_edges {op} {FEW_EDGES}") for op in ("<=", ">"))
    sides = lambda df: [df.selectExpr(*[f"{c} AS {p}_{c}" for c in narrow]) for p in "ab"]
    box = lambda p: (f"{p}_xmin", f"{p}_ymin", f"{p}_xmax", f"{p}_ymax")
    # the edges of most features are fewer than the cells of a grid they would be copied to
    a, b = sides(few)
    pairs = a.join(as_large(b), F.expr(f"a_k = b_k AND {FIRST} AND {bbox_overlaps_sql(box('a'), box('b'))}"))
    # a key holds edges of one feature, which came in one row: no cell of them has to be cut
    pairs = pairs.unionByName(grid_join(*sides(many), box("a"), box("b"), on=[("a_k", "b_k")], full_cell=1 << 62, each_once=FIRST))
    # edges i and j of one ring are adjacent when they follow each other, including last -> first
    adjacent = f"({SAME_RING} AND (abs(a_i - b_i) = 1 OR (a_i = 0 AND b_i = a_n - 1) OR (b_i = 0 AND a_i = b_n - 1)))"
    # edges that follow each other can have a piece in common only if the second one turns back
    back = "(a_x2 - a_x1) * (b_x2 - b_x1) + (a_y2 - a_y1) * (b_y2 - b_y1) < 0D"
    pairs = pairs.where(f"NOT {adjacent} OR {back}")
    line = lambda p: (f"{p}_x1", f"{p}_y1", f"{p}_x2", f"{p}_y2")
    pairs = with_orient_signs(pairs.selectExpr("*", f"{adjacent} AS adjacent"), {d: (*line(p), x, y) for d, p, x, y in (
        ("d1", "b", "a_x1", "a_y1"), ("d2", "b", "a_x2", "a_y2"), ("d3", "a", "b_x1", "b_y1"), ("d4", "a", "b_x2", "b_y2"))})
    shared = ("(least(a_xmax, b_xmax) > greatest(a_xmin, b_xmin) OR least(a_ymax, b_ymax) > greatest(a_ymin, b_ymin))")
    # a vertex of one edge lying on the other: collinear and inside its box
    on = lambda p, d, x, y: f"({d} = 0 AND {x} BETWEEN {p}_xmin AND {p}_xmax AND {y} BETWEEN {p}_ymin AND {p}_ymax)"
    at = " ".join(f"WHEN {on(p, d, x, y)} THEN named_struct('x', {x}, 'y', {y})" for p, d, x, y in (
        ("b", "d1", "a_x1", "a_y1"), ("b", "d2", "a_x2", "a_y2"), ("a", "d3", "b_x1", "b_y1"), ("a", "d4", "b_x2", "b_y2")))
    pairs = pairs.selectExpr("*", f"CASE {at} END AS at", f"""CASE
        WHEN d1 * d2 < 0 AND d3 * d4 < 0 THEN 'cross'
        WHEN d1 = 0 AND d2 = 0 AND {shared} THEN 'overlap' END AS hard""")
    return pairs.selectExpr("*", "coalesce(hard, CASE WHEN NOT adjacent AND at IS NOT NULL THEN 'touch' END) AS what").where(
        "what IS NOT NULL")


def _in_sector(d: str, u: str, v: str, ccw: str, turn: str) -> str:
    """True if the direction from P (columns px, py) to the point ``d`` lies on the enclosed side of a ring that comes from
    ``u`` through P to ``v``. The signs are columns (``_sector_signs``)."""
    past_out, past_in = f"{d}_past_{v}", f"{d}_past_{u}"
    left = f"CASE WHEN {turn} > 0 THEN {past_out} > 0 AND {past_in} > 0 ELSE {past_out} > 0 OR {past_in} > 0 END"
    return f"(({left}) = {ccw})"


def _sector_signs() -> dict[str, tuple]:
    """The turn of both rings at P, and the sides of each one's lines on which the other's neighbours of P lie."""
    at = lambda *ps: tuple(f"{p}.{c}" for p in ps for c in "xy")
    signs = {f"{p}_turn": at(f"{p}_u", "p", f"{p}_v") for p in "ab"}
    for p, q in ("ab", "ba"):
        for d in (f"{p}_u", f"{p}_v"):
            signs |= {f"{d}_past_{q}_v": at("p", f"{q}_v", d), f"{d}_past_{q}_u": at(f"{q}_u", "p", d)}
    return signs


def _touching(meetings: DataFrame) -> DataFrame:
    """One row per two rings and point where they touch: k, a_part, a_ring, b_part, b_ring, p, and on which side of the other
    ring each of them comes and goes: a_from, a_to (inside b), b_from, b_to (inside a)."""
    # the ring that comes first is a
    columns = ["part", "ring", "ccw", "x1", "y1", "x2", "y2"]
    meetings = meetings.where(f"what = 'touch' AND NOT {SAME_RING}").selectExpr(
        "a_k", "at", *[f"IF({FIRST}, {p}_{c}, {q}_{c}) AS {p}_{c}" for p, q in ("ab", "ba") for c in columns])
    ends = []
    for p in "ab":
        first, last = f"named_struct('x', {p}_x1, 'y', {p}_y1)", f"named_struct('x', {p}_x2, 'y', {p}_y2)"
        ends += [f"CASE WHEN at <> {first} THEN {first} END AS {p}_u", f"CASE WHEN at <> {last} THEN {last} END AS {p}_v"]
    rows = meetings.selectExpr(
        "a_k AS k", "a_part", "a_ring", "b_part", "b_ring", "at AS p", "a_ccw", "b_ccw", *ends)
    keys = ["k", "a_part", "a_ring", "b_part", "b_ring", "p", "a_ccw", "b_ccw"]
    rows = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("a_u", "a_v", "b_u", "b_v")])
    rows = with_orient_signs(rows, _sector_signs())
    sides = [(f"{p}_{name}", _in_sector(f"{p}_{end}", f"{q}_u", f"{q}_v", f"{q}_ccw", f"{q}_turn"))
             for p, q in ("ab", "ba") for name, end in (("from", "u"), ("to", "v"))]
    return rows.selectExpr(*keys[:6], *[f"{inside} AS {name}" for name, inside in sides])


def _rings_inside(edges: DataFrame, touching: DataFrame | None) -> DataFrame:
    """(k, part, ring, in_part, in_ring): the first ring lies in the second one. For rings that touch it follows from the sides
    they come from; for others a point of the ring is inside if the number of edges above it is odd."""
    slabs = f"least(n_rings, {MAX_SLABS})"
    slab = lambda x: f"CAST(least(floor(({x} - fx0) / greatest(fx1 - fx0, 1e-300D) * {slabs}), {slabs} - 1) AS INT)"
    points = edges.where("n_rings > 1 AND i = 0").selectExpr(
        "k", "part", "ring", "x1 AS x", "y1 AS y", "rx0 AS px0", "ry0 AS py0", "rx1 AS px1", "ry1 AS py1", f"{slab('x1')} AS slab")
    above = edges.where("n_rings > 1 AND xmin < xmax").selectExpr(
        "k", "part AS in_part", "ring AS in_ring", "rx0", "ry0", "rx1", "ry1", "xmin", "xmax", "ymin", "ymax",
        "IF(x1 < x2, y1, y2) AS yl", "IF(x1 < x2, y2, y1) AS yr", f"explode(sequence({slab('xmin')}, {slab('xmax')})) AS slab")
    met = points.join(as_large(above), ["k", "slab"]).where(
        "NOT (part = in_part AND ring = in_ring) AND px0 >= rx0 AND py0 >= ry0 AND px1 <= rx1 AND py1 <= ry1 "
        "AND x >= xmin AND x < xmax AND ymax >= y")
    met = met.where(f"ymin > y OR ({orient_sign_sql('xmin', 'yl', 'xmax', 'yr', 'x', 'y')}) < 0")
    odd = met.groupBy("k", "part", "ring", "in_part", "in_ring").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")
    if touching is None:
        return odd
    known = touching.selectExpr("k", "a_part AS part", "a_ring AS ring", "b_part AS in_part", "b_ring AS in_ring", "a_from AS inside") \
        .unionByName(touching.selectExpr("k", "b_part AS part", "b_ring AS ring", "a_part AS in_part", "a_ring AS in_ring",
                                         "b_from AS inside"))
    known = known.groupBy("k", "part", "ring", "in_part", "in_ring").agg(F.max("inside").alias("inside"))
    pair = ["k", "part", "ring", "in_part", "in_ring"]
    return odd.join(as_large(known.select(*pair)), pair, "left_anti").unionByName(known.where("inside").select(*pair))


def _circles(touching: DataFrame) -> DataFrame:
    """k of the features that have a part whose rings touch in a circle: adding the touches one by one, some touch connects a
    ring and a point that were connected before. Works on one part's touches, a list no longer than its rings and points."""
    same = touching.where("a_part = b_part")
    ends = same.selectExpr("k", "a_part AS part", "a_ring AS ring", "p").unionByName(
        same.selectExpr("k", "a_part AS part", "b_ring AS ring", "p")).distinct()
    parts = ends.groupBy("k", "part").agg(F.collect_list(F.struct("ring", "p")).alias("ts")).where("size(ts) > 2")
    parts = parts.selectExpr("k", "ts", "array_distinct(transform(ts, t -> t.ring)) AS rs",
                             "array_distinct(transform(ts, t -> t.p)) AS ps")
    joined = ("aggregate(transform(ts, t -> named_struct('u', array_position(rs, t.ring), 'v', size(rs) + array_position(ps, t.p))), "
              "named_struct('label', sequence(1L, CAST(size(rs) + size(ps) AS BIGINT)), 'circle', false), (s, t) -> named_struct("
              "'label', transform(s.label, x -> IF(x = element_at(s.label, CAST(t.v AS INT)), element_at(s.label, CAST(t.u AS INT)), x)), "
              "'circle', s.circle OR element_at(s.label, CAST(t.u AS INT)) = element_at(s.label, CAST(t.v AS INT))), s -> s.circle)")
    return parts.where(joined).select("k")


def _nesting(edges: DataFrame, inside: DataFrame, told) -> list[DataFrame]:
    """Features whose holes and shells lie in the wrong rings."""
    ids = ["k", "part", "ring"]
    rings = edges.where("n_rings > 1 AND i = 0").select(*ids, "area")
    holes, own = rings.where("ring > 0"), inside.where("ring > 0 AND in_part = part")
    shells = inside.where("ring = 0 AND in_ring = 0 AND in_part <> part")
    saved = inside.where("ring = 0 AND in_ring > 0 AND in_part <> part").select("k", "part", "in_part")
    fills = holes.join(as_large(rings.where("ring = 0").selectExpr("k", "part", "area AS shell")), ["k", "part"])
    return [told(fills.where("area >= shell"), "hole fills shell"),
            told(holes.join(as_large(own.where("in_ring = 0").select(*ids)), ids, "left_anti"), "hole outside shell"),
            told(own.where("in_ring > 0"), "nested holes"),
            told(shells.join(as_large(saved), ["k", "part", "in_part"], "left_anti"), "nested shells")]


def check_rings(df: DataFrame, key: str = "oid") -> DataFrame:
    """(key, valid, reason) for every polygonal feature, with the first of ``REASONS`` that applies. Repeated points are no
    crossings. Every input feature is reported; ``key`` must tell features apart."""
    polys = df.where("gtype LIKE '%POLYGON%'").selectExpr(f"`{key}`", f"{close_rings_sql('rings')} AS rings")
    # the edges feed the join from both sides, and the meetings several reasons
    edges = materialize(edges_of(polys, key))
    meetings = materialize(meetings_of(edges))
    kinds = {(r[0], r[1]) for r in meetings.selectExpr("what", f"{SAME_RING} AS same").distinct().collect()}  # six at most
    told = lambda rows, reason: rows.selectExpr("k", f"{REASONS.index(reason)} AS rank")
    overlaps = meetings.where("what = 'overlap'").withColumnRenamed("a_k", "k")
    found = [told(meetings.where(f"what = 'cross' OR (what = 'touch' AND {SAME_RING})").withColumnRenamed("a_k", "k"),
                  "self-crossing"), told(overlaps, "overlapping edges")]
    touching = None
    if ("touch", False) in kinds:
        touching = materialize(_touching(meetings))
        # sides mean something only where the rings have no piece in common
        through = touching.where("a_from <> a_to OR b_from <> b_to").join(as_large(overlaps), "k", "left_anti")
        found += [told(through, "self-crossing"), told(_circles(touching), "disconnected interior")]
    if not edges.where("n_rings > 1").isEmpty():
        found += _nesting(edges, materialize(_rings_inside(edges, touching)), told)
    short = f"IF(exists(rings, r -> size(r.pts) < 4), {REASONS.index('ring too short')}, {len(REASONS)}) AS rank"
    out = polys.selectExpr(f"`{key}` AS k", short)
    for rows in found:
        out = out.unionByName(rows)
    names = "array(" + ", ".join(f"'{r}'" for r in REASONS) + ")"
    out = out.groupBy("k").agg(F.min("rank").alias("rank"))
    return out.selectExpr(f"k AS `{key}`", f"rank = {len(REASONS)} AS valid", f"get({names}, rank) AS reason")
