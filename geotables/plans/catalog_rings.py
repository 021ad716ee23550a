"""Registered queries on ring validity, repair and exact signs."""

from __future__ import annotations

from geotables.functions.shapes import point_sql as P
from geotables.functions.shapes import ring_sql
from geotables.model import finish_features
from geotables.plans import fixtures as fx
from geotables.plans import oracle_sql as O
from geotables.plans.registry import register


def _box(part: int, ring: int, x0: float, y0: float, x1: float, y1: float) -> str:
    """A ring around a box, whose sides are given in widths and heights of the parcel."""
    at = lambda fx_, fy: P(f"x + {fx_!r}D * w", f"y + {fy!r}D * h")
    pts = [at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0)]
    return ring_sql(part, ring, pts if ring == 0 else pts[::-1])


SHELL = _box(0, 0, 0.0, 0.0, 1.0, 1.0)
BOW = ring_sql(0, 0, [P("x", "y"), P("x + w", "y + h"), P("x + w", "y"), P("x", "y + h"), P("x", "y")])
#: The rings of a feature by key % 9; the reason why it is invalid; its area in parcels and its parts after rebuilding.
CASES = [
    ([SHELL, _box(1, 0, 2.0, 0.0, 3.0, 1.0)], None, 2.0, 2),
    ([SHELL, _box(1, 0, 0.0, 0.0, 1.0, 1.0)], "overlapping edges", 1.0, 1),
    ([SHELL, _box(1, 0, 0.25, 0.25, 0.5, 0.5)], "nested shells", 1.0, 1),
    ([SHELL, _box(0, 1, 0.25, 0.25, 0.75, 0.75), _box(1, 0, 0.375, 0.375, 0.625, 0.625)], None, 0.8125, 2),
    ([SHELL, _box(0, 1, 0.25, 0.25, 0.75, 0.75), _box(0, 2, 0.375, 0.375, 0.625, 0.625)], "nested holes", 0.75, 1),
    ([SHELL, _box(0, 1, 2.0, 0.0, 3.0, 0.5)], "hole outside shell", 1.0, 1),
    ([SHELL, _box(1, 0, 1.0, 0.25, 2.0, 0.75)], "overlapping edges", 1.5, 1),
    ([SHELL, _box(1, 0, 1.0, 1.0, 1.5, 2.0)], None, 1.5, 2),
    ([BOW], "self-crossing", 0.5, 2)]


def nested_features(spark, sf_dir):
    """Features of one or two parts from ``part``, some with rings in the wrong place (``CASES``)."""
    p = fx.parcel_parts(fx.generator_keys(spark, sf_dir, "part"))
    rings = " ".join(f"WHEN {i} THEN array({', '.join(r)})" for i, (r, *_) in enumerate(CASES))
    return finish_features(p.selectExpr("oid", "tags", "'MULTIPOLYGON' AS gtype", f"CASE CAST(k % 9 AS INT) {rings} END AS rings"))


def _by_case(values: list[str]) -> str:
    return "CASE k % 9 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_REASON = _by_case([f"'{c[1]}'" if c[1] else "NULL" for c in CASES])


@register("ring_nesting", O.with_ctes(O.PARCELS) + f"""
SELECT oid, {_REASON} IS NULL AS valid, {_REASON} AS reason FROM parcels""")
def q_ring_nesting(spark, sf_dir):
    from geotables.operators.rings import check_rings
    return check_rings(nested_features(spark, sf_dir))


@register("rebuild_stored", O.with_ctes(O.PARCELS) + f"""
SELECT oid, {_REASON} AS repaired, round({_by_case([f'{c[2]}{O.D}' for c in CASES])} * w * h, 9) AS area,
       {_by_case([str(c[3]) for c in CASES])}::INTEGER AS n_parts FROM parcels""")
def q_rebuild_stored(spark, sf_dir):
    """The features written as a key table and read with repair: what was invalid is rebuilt, with its reason told."""
    from geotables.functions.shapes import area_sql
    from geotables.operators.rings import check_rings
    from geotables.session import as_large, scratch_path
    from geotables.sources.geo_table import read_repaired, write_geo_table
    path = scratch_path(spark, "nested")
    features = nested_features(spark, sf_dir)
    write_geo_table(features, path)
    good, _ = read_repaired(spark, path, num_partitions=8, rebuild=True)
    told = check_rings(features).selectExpr("oid", "reason AS repaired")
    return good.selectExpr("oid", f"round({area_sql()}, 9) AS area",
                           "array_max(transform(rings, r -> r.part)) + 1 AS n_parts").join(as_large(told), "oid")


_LINE = {"ax": "k * 7919 % 1000003", "ay": "k * 10473 % 1000003", "dx": "1 + k * 6271 % 1048576",
         "dy": "2251799813685248 + k * 3571 % 1048576", "e": "k % 3 - 1"}


@register("orientation_exact", f"""
WITH d AS (SELECT k, {', '.join(f'({v})::HUGEINT AS {n}' for n, v in _LINE.items())} FROM (SELECT p_partkey::BIGINT AS k FROM part))
SELECT k, sign((ax - (ax + dx)) * (ay + 3 * dy - (ay + dy + e)) - (ay - (ay + dy + e)) * (ax + 3 * dx - (ax + dx)))::INTEGER AS side
FROM d""")
def q_orientation_exact(spark, sf_dir):
    """Points a unit beside, or on, lines that are 10^16 units long: plain doubles can't tell which."""
    from geotables.functions.exact import orient_sign_sql
    d = fx.read(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS BIGINT) AS k").selectExpr(
        "k", *[f"CAST({v} AS DOUBLE) AS {n}" for n, v in _LINE.items()])
    d = d.selectExpr("k", "ax", "ay", "ax + 3D * dx AS bx", "ay + 3D * dy AS by", "ax + dx AS cx", "ay + dy + e AS cy")
    return d.selectExpr("k", f"{orient_sign_sql('ax', 'ay', 'bx', 'by', 'cx', 'cy')} AS side")
