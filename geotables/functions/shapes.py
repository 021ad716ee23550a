"""Geometry arithmetic on the canonical nested column, as Spark SQL expression text.

``rings`` is ``ARRAY<STRUCT<part INT, ring INT, pts ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>``; ring 0 of a part is its
shell, rings >= 1 are holes. Polygon rings are closed (first point = last point) and oriented shell
counter-clockwise, holes clockwise (``geotables.operators.rings.check_rings`` makes them so).
"""

from __future__ import annotations

POINT_T = "struct<x:double,y:double>"
RING_T = f"struct<part:int,ring:int,pts:array<{POINT_T}>>"
RINGS_T = f"array<{RING_T}>"
EDGE_T = "struct<s:double,xl:double,yl:double,xr:double,yr:double,m:double>"


def point_sql(x: str, y: str) -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def ring_sql(part: int, ring_no: int, pts: list[str]) -> str:
    return f"named_struct('part', {part}, 'ring', {ring_no}, 'pts', array({', '.join(pts)}))"


def all_points_sql(rings: str = "rings") -> str:
    return f"flatten(transform({rings}, r -> r.pts))"


def let_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``. The value appears once in the expression tree however often the
    body uses it, so Catalyst cannot multiply it when it inlines a column into a pushed-down filter."""
    return f"transform(array({value}), {name} -> {body})[0]"


def envelope_struct_sql(rings: str = "rings") -> str:
    """struct(xmin, ymin, xmax, ymax) of a geometry; fields NULL for an empty geometry."""
    return let_sql(all_points_sql(rings), "pts",
                   "named_struct('xmin', array_min(transform(pts, p -> p.x)), 'ymin', array_min(transform(pts, p -> p.y)), "
                   "'xmax', array_max(transform(pts, p -> p.x)), 'ymax', array_max(transform(pts, p -> p.y)))")


def envelope_sql(rings: str = "rings") -> list[str]:
    """xmin, ymin, xmax, ymax expressions; NULL for an empty geometry."""
    pts = all_points_sql(rings)
    return [f"array_min(transform({pts}, p -> p.x)) AS xmin", f"array_min(transform({pts}, p -> p.y)) AS ymin",
            f"array_max(transform({pts}, p -> p.x)) AS xmax", f"array_max(transform({pts}, p -> p.y)) AS ymax"]


def _segments_sql(pts: str, p: str, q: str, body: str) -> str:
    """``body`` (over lambda variables p, q) for consecutive point pairs of one ring."""
    n = f"greatest(size({pts}) - 1, 0)"
    return f"zip_with(slice({pts}, 1, {n}), slice({pts}, 2, {n}), ({p}, {q}) -> {body})"


def ring_signed_area_sql(pts: str) -> str:
    """Shoelace area of a closed ring, positive when counter-clockwise, relative to the first point (keeps digits
    for rings far from the origin)."""
    o = f"{pts}[0]"
    cross = _segments_sql(pts, "p", "q", f"(p.x - {o}.x) * (q.y - {o}.y) - (q.x - {o}.x) * (p.y - {o}.y)")
    return f"CASE WHEN size({pts}) < 2 THEN 0D ELSE aggregate({cross}, 0D, (acc, v) -> acc + v) / 2D END"


def is_areal_sql(gtype: str = "gtype") -> str:
    return f"({gtype} LIKE '%POLYGON%')"


def area_sql(rings: str = "rings", gtype: str = "gtype") -> str:
    """Planar area: shells minus holes; 0 for points and lines."""
    per_ring = f"abs({ring_signed_area_sql('rr.pts')}) * CASE WHEN rr.ring = 0 THEN 1D ELSE -1D END"
    return (f"CASE WHEN {is_areal_sql(gtype)} THEN aggregate({rings}, 0D, (acc, rr) -> acc + {per_ring}) "
            f"ELSE 0D END")


def edges_sql(rings: str = "rings", gtype: str = "gtype") -> str:
    """Non-vertical boundary edges of a polygonal geometry, left to right, with the direction sign ``s`` of the
    original edge and the slope ``m``. Empty for points and lines (their overlap area is 0)."""
    body = ("named_struct('s', CASE WHEN p.x < q.x THEN 1D ELSE -1D END, 'xl', least(p.x, q.x), "
            "'yl', CASE WHEN p.x < q.x THEN p.y ELSE q.y END, 'xr', greatest(p.x, q.x), "
            "'yr', CASE WHEN p.x < q.x THEN q.y ELSE p.y END, "
            "'m', CASE WHEN p.x = q.x THEN 0D ELSE (q.y - p.y) / (q.x - p.x) END)")
    all_edges = f"flatten(transform({rings}, r -> {_segments_sql('r.pts', 'p', 'q', body)}))"
    return (f"CASE WHEN {is_areal_sql(gtype)} THEN filter({all_edges}, e -> e.xl < e.xr) "
            f"ELSE CAST(array() AS array<{EDGE_T}>) END")


def vertex_in_box_sql(rings: str, xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    """True when any vertex lies in the closed box."""
    return (f"exists({all_points_sql(rings)}, p -> p.x >= {xmin} AND p.x <= {xmax} "
            f"AND p.y >= {ymin} AND p.y <= {ymax})")
