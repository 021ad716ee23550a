"""Polygon overlay: for every parcel, the class of the zone it overlaps most.

Plan: candidates (same region, closed envelope intersection) -> overlap area per candidate pair (column arithmetic over
edge pairs, no UDF) -> the largest area per parcel, over the overlapping pairs *unioned with one default row per parcel*
(class '0', area 0), and among the zones that reach it the smallest zone key. Areas are ranked as they are; ``ZERO`` of the
smaller feature's area is what counts as no overlap and as a tie, so the answer does not depend on the order in which
the terms of a sum were added, nor on batching or partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.functions import shapes
from geotables.functions.tags import tag_sql
from geotables.session import materialize
from geotables.operators.spatial_join import grid_join, plain_join

ZERO = 1e-12
PAIR_COLUMNS = ["p_key", "p_oid", "z_key", "z_oid", "z_class", "overlap_area", "tolerance"]
ENV = ["xmin", "ymin", "xmax", "ymax"]


def _side(df: DataFrame, p: str, *extra: str) -> DataFrame:
    return df.selectExpr(*[f"{c} AS {p}{c}" for c in ["key", "oid", "region", "cell", *ENV]], *extra)


def overlay_sides(parcels: DataFrame, zones: DataFrame, tag_name: str, edges: bool = True) -> tuple[DataFrame, DataFrame]:
    """What the overlay needs of both layers: keys, region, cell and envelope; of the zones the class, read out of the JSON tags
    once per zone, not once per pair, and the own area; and for overlap areas the parcels' own area and both edge arrays."""
    edge_array = f"{shapes.edges_sql('rings', 'gtype')} AS {{}}_edges"
    area = f"{shapes.area_sql('rings', 'gtype')} AS {{}}_area"
    p = _side(parcels, "p_", *([area.format("p"), edge_array.format("p")] if edges else []))
    z = _side(zones, "z_", f"{tag_sql('tags', tag_name)} AS z_class", area.format("z"), *([edge_array.format("z")] if edges else []))
    return p, z


def parcel_side(parcels: DataFrame, edges: bool = True) -> DataFrame:
    """The parcels' side. It feeds the level collect, both grid-join branches and the default rows: it is computed once."""
    return materialize(overlay_sides(parcels, parcels, "", edges)[0])


def zone_side(zones: DataFrame, tag_name: str, edges: bool = True) -> DataFrame:
    """The zones' side, computed once."""
    return materialize(overlay_sides(zones, zones, tag_name, edges)[1])


def overlay_inputs(parcels: DataFrame, zones: DataFrame, tag_name: str, edges: bool = True) -> tuple[DataFrame, DataFrame]:
    return parcel_side(parcels, edges), zone_side(zones, tag_name, edges)


P_ENV = ("p_xmin", "p_ymin", "p_xmax", "p_ymax")
Z_ENV = ("z_xmin", "z_ymin", "z_xmax", "z_ymax")


def candidate_pairs(p: DataFrame, z: DataFrame, strategy: str = "grid") -> DataFrame:
    """Parcel/zone pairs in the same region whose envelopes intersect.

    grid   equi-join on (region, grid cell) -- see ``spatial_join.grid_join``; the default
    plain  equi-join on region with the box test as residual: a nested loop within each region, for checks only
    prefix the pairs of ``grid`` whose geohash cells are one a prefix of the other (the key relation of stored tables)
    """
    on = [("p_region", "z_region")]
    if strategy == "grid":
        return grid_join(p, z, P_ENV, Z_ENV, on=on)
    if strategy == "plain":
        return plain_join(p, z, P_ENV, Z_ENV, on=on)
    if strategy == "prefix":
        return grid_join(p, z, P_ENV, Z_ENV, on=on).where("startswith(p_cell, z_cell) OR startswith(z_cell, p_cell)")
    raise ValueError(f"unknown strategy {strategy!r}")


PAIR_KEYS = ["p_key", "p_oid", "z_key", "z_oid", "z_class"]

# A piece of an edge inside the common strip 0 <= y <= h of a pair: x from l to r, y from fl to fr, sign s.
_PIECE_T = "array<struct<s:double,l:double,r:double,fl:double,fr:double>>"


def _pieces_sql(edges: str) -> str:
    """The edges of a feature cut to the common envelope of a pair (columns _x0, _x1, _oy, _h): parts below it vanish
    (what lies under them is empty), parts above run along its upper side, the rest stays. All y are relative to _oy, so
    sums run over numbers no larger than the common envelope."""
    cut = ("transform(filter({e}, e -> e.xr > _x0 AND e.xl < _x1), e -> named_struct('s', e.s, "
           "'l', greatest(e.xl, _x0), 'r', least(e.xr, _x1), "
           "'fl', e.yl - _oy + (greatest(e.xl, _x0) - e.xl) * e.m, 'fr', e.yl - _oy + (least(e.xr, _x1) - e.xl) * e.m))")
    # x where the line meets y = v, between l and r
    at = lambda v: f"(c.l + ({v} - c.fl) / (c.fr - c.fl) * (c.r - c.l))"
    rising = ("array(named_struct('s', c.s, 'l', IF(c.fl < 0, {a0}, c.l), 'r', IF(c.fr > _h, {ah}, c.r), "
              "'fl', greatest(c.fl, 0D), 'fr', least(c.fr, _h)), "
              "named_struct('s', c.s, 'l', IF(c.fr > _h, {ah}, c.r), 'r', c.r, 'fl', _h, 'fr', _h))")
    falling = ("array(named_struct('s', c.s, 'l', c.l, 'r', IF(c.fl > _h, {ah}, c.l), 'fl', _h, 'fr', _h), "
               "named_struct('s', c.s, 'l', IF(c.fl > _h, {ah}, c.l), 'r', IF(c.fr < 0, {a0}, c.r), "
               "'fl', least(c.fl, _h), 'fr', greatest(c.fr, 0D)))")
    a0, ah = at("0D"), at("_h")
    pieces = (f"CASE WHEN c.fl <= 0 AND c.fr <= 0 THEN CAST(array() AS {_PIECE_T}) "
              "WHEN c.fl >= _h AND c.fr >= _h THEN array(named_struct('s', c.s, 'l', c.l, 'r', c.r, 'fl', _h, 'fr', _h)) "
              "WHEN c.fl >= 0 AND c.fr >= 0 AND c.fl <= _h AND c.fr <= _h THEN array(c) "
              f"WHEN c.fl < c.fr THEN {rising.format(a0=a0, ah=ah)} ELSE {falling.format(a0=a0, ah=ah)} END")
    return f"filter(flatten(transform({cut.format(e=edges)}, c -> {pieces})), c -> c.l < c.r)"


def with_overlap_area(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Intersection area of each candidate pair: (keys..., overlap_area, tolerance), tolerance being the area that still
    counts as none.

    For rings oriented shell-CCW / hole-CW a polygon is the signed sum of the regions under its edges, so the area of an
    intersection is the signed sum over edge pairs of the integral of the lower of the two lines over their common
    x-range. Edges are first cut to the common envelope (``_pieces_sql``); a piece then meets only the pieces of the other
    feature that share some of its x-range, so a pair gives about as many rows as its pieces overlap. The rows of one pair
    are adjacent, so the partial (map-side) sum collapses them to one row per pair before the shuffle. ``explode_outer``
    keeps pairs without pieces (area 0).
    """
    keys = keys or PAIR_KEYS
    x0, x1, oy = "greatest(p_xmin, z_xmin)", "least(p_xmax, z_xmax)", "greatest(p_ymin, z_ymin)"
    a = pairs.selectExpr(*keys, f"{x0} AS _x0", f"{x1} AS _x1", f"{oy} AS _oy", f"least(p_ymax, z_ymax) - {oy} AS _h",
                         f"{ZERO!r}D * least(p_area, z_area) AS _t", "p_edges", "z_edges")
    a = a.selectExpr(*keys, "_t", f"inline(array(named_struct('_pp', {_pieces_sql('p_edges')}, '_zp', {_pieces_sql('z_edges')})))")
    a = a.selectExpr(*keys, "_t", "_zp", "explode_outer(_pp) AS _e")
    a = a.selectExpr(*keys, "_t", "_e", "explode_outer(filter(_zp, g -> g.l < _e.r AND g.r > _e.l)) AS _g")
    # the term in small steps: each projection stays a compact generated method
    t = a.selectExpr(*keys, "_t", "_e", "_g", "greatest(_e.l, _g.l) AS _l", "least(_e.r, _g.r) AS _r")
    line = lambda v, x: f"IF({x} = {v}.l, {v}.fl, IF({x} = {v}.r, {v}.fr, {v}.fl + ({x} - {v}.l) / ({v}.r - {v}.l) * ({v}.fr - {v}.fl)))"
    t = t.selectExpr(*keys, "_t", "CASE WHEN _e IS NOT NULL AND _g IS NOT NULL AND _l < _r THEN _e.s * _g.s * (_r - _l) ELSE 0D END"
                                  " AS _w",
                     f"{line('_e', '_l')} AS _fl", f"{line('_e', '_r')} AS _fr", f"{line('_g', '_l')} AS _gl",
                     f"{line('_g', '_r')} AS _gr")
    t = t.selectExpr(*keys, "_t", "_w", "_fl", "_fr", "_gl", "_gr", "_fl - _gl AS _dl", "_fr - _gr AS _dr")
    # where the lines cross, at the share _c of the range, the lower line changes there
    t = t.selectExpr(*keys, "_t", "_w", "_fl", "_fr", "least(_fl, _gl) AS _ml", "least(_fr, _gr) AS _mr",
                     "IF(_dl * _dr < 0, abs(_dl) / (abs(_dl) + abs(_dr)), 0D) AS _c")
    t = t.selectExpr(*keys, "_t", "CASE WHEN _w = 0D THEN 0D ELSE _w * (_c * (_ml + _fl + (_fr - _fl) * _c) + "
                                  "(1D - _c) * (IF(_c = 0D, _ml, _fl + (_fr - _fl) * _c) + _mr)) / 2D END AS _v")
    return t.groupBy(*keys).agg(F.expr("sum(_v) + 0D").alias("overlap_area"), F.max("_t").alias("tolerance"))


def overlay_pairs(parcels: DataFrame, zones: DataFrame, tag_name: str = "PDJB", strategy: str = "grid") -> DataFrame:
    """All candidate pairs with their overlap area (zero-area pairs included)."""
    p, z = overlay_inputs(parcels, zones, tag_name)
    return with_overlap_area(candidate_pairs(p, z, strategy)).select(*PAIR_COLUMNS)


OVERLAPS = "overlap_area > tolerance"
CLASS_COLUMNS = ["key", "oid", "pd_class", "overlap_area", "zone_key", "tolerance"]


def _best(rows: DataFrame) -> DataFrame:
    """One row per key of CLASS_COLUMNS rows: the smallest zone key among those that reach the largest area but for their
    tolerance. The largest area is a plain hash aggregate; both passes over ``rows`` share one shuffle."""
    rows = rows.repartition("key")
    top = rows.groupBy("key").agg(F.max("overlap_area").alias("_top"))
    reach = rows.join(top, "key").where("overlap_area >= _top - tolerance")
    best = reach.groupBy("key", "oid").agg(F.expr(
        "min_by(named_struct('c', pd_class, 'a', overlap_area, 'k', zone_key, 't', tolerance), zone_key)").alias("b"),
        F.expr("first(named_struct('c', pd_class, 'a', overlap_area, 'k', zone_key, 't', tolerance))").alias("d"))
    # min_by skips a null zone key, which is the default row alone
    return best.selectExpr("key", "oid", "coalesce(b, d) AS b").selectExpr(
        "key", "oid", "b.c AS pd_class", "b.a AS overlap_area", "b.k AS zone_key", "b.t AS tolerance")


def best_class(scored: DataFrame, parcel_keys: DataFrame) -> DataFrame:
    """CLASS_COLUMNS per parcel from overlapping pairs (p_key, p_oid, z_key, z_class, overlap_area, tolerance).

    ``parcel_keys`` (p_key, p_oid) supplies the default ('0', 0.0) row for every parcel; its zone_key is NULL. Keep
    zone_key and tolerance to merge later batches (``merge_best``)."""
    default = parcel_keys.selectExpr("p_key AS key", "p_oid AS oid", "'0' AS pd_class", "0D AS overlap_area",
                                     "CAST(NULL AS STRING) AS zone_key", "0D AS tolerance")
    rows = scored.selectExpr("p_key AS key", "p_oid AS oid", "z_class AS pd_class", "overlap_area", "z_key AS zone_key",
                             "tolerance").unionByName(default)
    return _best(rows)


def contenders(p: DataFrame, z: DataFrame) -> DataFrame:
    """CLASS_COLUMNS of every overlapping pair of a parcel whose area reaches the parcel's largest one among these zones but for
    its tolerance. Pairs left out can't win against any further zones either, so the contenders of any batches of zones together
    decide as all zones do (``best_of_contenders``)."""
    pairs = with_overlap_area(candidate_pairs(p, z)).where(OVERLAPS).selectExpr(
        "p_key AS key", "p_oid AS oid", "z_class AS pd_class", "overlap_area", "z_key AS zone_key", "tolerance").repartition("key")
    top = pairs.groupBy("key").agg(F.max("overlap_area").alias("_top"))
    return pairs.join(top, "key").where("overlap_area >= _top - tolerance").select(*CLASS_COLUMNS)


def best_of_contenders(rows: DataFrame, parcel_keys: DataFrame) -> DataFrame:
    """CLASS_COLUMNS per parcel from the contenders of all batches; repeated rows change nothing."""
    return best_class(rows.selectExpr("key AS p_key", "oid AS p_oid", "zone_key AS z_key", "pd_class AS z_class", "overlap_area",
                                      "tolerance"), parcel_keys)


def overlay_classes(parcels: DataFrame, zones: DataFrame, tag_name: str = "PDJB", strategy: str = "grid",
                    compat: bool = False, keep_zone_key: bool = False) -> DataFrame:
    """(oid, pd_class, overlap_area) for every parcel: class '0' and area 0 when no zone overlaps it. keep_zone_key=True
    returns CLASS_COLUMNS.

    compat=True reproduces the literal job: the value ranked is the zone's *own* area (it intersects the zone with
    itself), candidates additionally need one geohash cell to contain the other as a substring.
    """
    p, z = overlay_inputs(parcels, zones, tag_name, edges=not compat)
    return classes_of(p, z, strategy, compat, keep_zone_key)


def classes_of(p: DataFrame, z: DataFrame, strategy: str = "grid", compat: bool = False,
               keep_zone_key: bool = False) -> DataFrame:
    """``overlay_classes`` of prepared inputs (``overlay_inputs``)."""
    pairs = candidate_pairs(p, z, strategy)
    if compat:
        scored = pairs.where("contains(p_cell, z_cell) OR contains(z_cell, p_cell)") \
            .selectExpr("*", "z_area AS overlap_area", f"{ZERO!r}D * z_area AS tolerance")
    else:
        scored = with_overlap_area(pairs)
    out = best_class(scored.where(OVERLAPS), p.select("p_key", "p_oid"))
    return out if keep_zone_key else out.select("oid", "pd_class", "overlap_area")


def merge_best(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Combine two results (CLASS_COLUMNS), e.g. from two zone batches: again one row per parcel key."""
    return _best(previous.select(*CLASS_COLUMNS).unionByName(new.select(*CLASS_COLUMNS)))


def overlay_stats(parcels: DataFrame, zones: DataFrame, tag_name: str = "PDJB", batches: int = 1) -> DataFrame:
    """One row of counts describing an overlay run."""
    p, z = overlay_inputs(parcels, zones, tag_name)
    scored = with_overlap_area(candidate_pairs(p, z, "grid"), ["p_key", "z_key"])
    pair_stats = scored.selectExpr(
        "count(*) AS n_pairs", "count(CASE WHEN overlap_area > tolerance THEN 1 END) AS n_pairs_positive",
        "count(DISTINCT CASE WHEN overlap_area > tolerance THEN p_key END) AS n_parcels_matched")
    zone_stats = z.selectExpr("count(*) AS n_zones", "count(CASE WHEN z_class IS NULL THEN 1 END) AS n_zones_no_tag")
    parcel_stats = p.selectExpr("count(*) AS n_parcels")
    # three one-row aggregates side by side: union them and take the one non-NULL value per column
    parts = parcel_stats.unionByName(zone_stats, allowMissingColumns=True) \
        .unionByName(pair_stats, allowMissingColumns=True)
    cols = ["n_parcels", "n_zones", "n_zones_no_tag", "n_pairs", "n_pairs_positive", "n_parcels_matched"]
    return parts.selectExpr(*[f"max({c}) AS {c}" for c in cols],
                            f"CAST(ceil(max(n_zones) / {float(batches)!r}D) AS BIGINT) AS batch_size")
