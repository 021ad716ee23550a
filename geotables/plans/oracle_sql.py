"""DuckDB SQL for the oracle check: the same fixture recipe and the same semantics, written as plain SQL over the
driver tables (no spatial extension). Doubles are written ``64::DOUBLE``; areas are rounded to 9 places."""

from __future__ import annotations

D = "::DOUBLE"

# Fixed values, written out again so that a slip in the engine's own tables shows: the geohash alphabet and the upper
# distance limits for lengths 12 down to 2.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
MAX_CHARS = 12
PRECISION_THRESHOLDS = [(0.0186, 12), (0.1492, 11), (0.5971, 10), (4.78, 9), (19.11, 8), (76, 7), (610, 6), (2400, 5),
                        (20000, 4), (78000, 3), (630000, 2)]


# ---------------------------------------------------------------- geohash in SQL

def lon_index(e: str) -> str:
    return f"least(greatest(floor(({e} + 180{D}) / 360{D} * 1073741824{D}), 0), 1073741823)::BIGINT"


def lat_index(e: str) -> str:
    return f"least(greatest(floor(({e} + 90{D}) / 180{D} * 1073741824{D}), 0), 1073741823)::BIGINT"


def _spread(v: str) -> str:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = f"((({v}) << {shift}) | ({v})) & {mask}::BIGINT"
    return v


def morton(ix: str, iy: str) -> str:
    return f"((({_spread(ix)}) << 1) | ({_spread(iy)}))"


def geohash_of_morton(m: str, chars: int | str = MAX_CHARS) -> str:
    parts = [f"substr('{GEOHASH_ALPHABET}', ((({m}) >> {5 * (MAX_CHARS - 1 - c)}) & 31)::INTEGER + 1, 1)"
             for c in range(MAX_CHARS)]
    full = " || ".join(parts)
    if chars == MAX_CHARS:
        return f"({full})"
    return f"substr({full}, 1, {chars})"


def geohash(lon: str, lat: str, chars: int | str = MAX_CHARS) -> str:
    return geohash_of_morton(morton(lon_index(lon), lat_index(lat)), chars)


def morton_of(lon: str, lat: str) -> str:
    return morton(lon_index(lon), lat_index(lat))


def envelope_cell(xmin: str, sw: str, ne: str) -> str:
    """Cell from the Morton codes (columns) of the SW and NE envelope corners."""
    n = " + ".join(f"(CASE WHEN (({sw}) >> {5 * (MAX_CHARS - i)}) = (({ne}) >> {5 * (MAX_CHARS - i)}) THEN 1 ELSE 0 END)"
                   for i in range(1, MAX_CHARS + 1))
    return f"(CASE WHEN {xmin} IS NULL THEN '' ELSE {geohash_of_morton(sw, '(' + n + ')')} END)"


def axis_bits(chars: int) -> tuple[int, int]:
    return (5 * chars + 1) // 2, (5 * chars) // 2


def cell_ix(lon: str, chars: int) -> str:
    return f"({lon_index(lon)} >> {30 - axis_bits(chars)[0]})"


def cell_iy(lat: str, chars: int) -> str:
    return f"({lat_index(lat)} >> {30 - axis_bits(chars)[1]})"


def geohash_of_cell(ix: str, iy: str, chars: int) -> str:
    bx, by = axis_bits(chars)
    return geohash_of_morton(morton(f"(({ix}) << {30 - bx})", f"(({iy}) << {30 - by})"), chars)


def precision(d: str) -> str:
    whens = " ".join(f"WHEN {d} <= {float(limit)}{D} THEN {chars}" for limit, chars in PRECISION_THRESHOLDS)
    return f"(CASE WHEN {d} IS NULL THEN NULL {whens} ELSE 1 END)::INTEGER"


# ---------------------------------------------------------------- fixtures in SQL

def _grid(k: str, mul: int, mod: int) -> str:
    return f"(({k} * {mul} % {mod}) % 256) / 64{D}"


def _pad(k: str, n: int) -> str:
    return f"lpad({k}::VARCHAR, greatest({n}, length({k}::VARCHAR))::INTEGER, '0')"


PB, ZB = "((p_partkey::BIGINT - 1) // 20000)", "((s_suppkey::BIGINT - 1) // 1000)"

PARCEL_BASE = f"""
parcel_base AS (
  SELECT p_partkey::BIGINT AS k,
         (11000 + {PB} // 100)::VARCHAR || (p_partkey % 3)::VARCHAR || {_pad('p_partkey', 7)} AS oid,
         '{{"DLBM":"' || (p_partkey % 9)::VARCHAR || '"}}' AS tags,
         p_partkey % 4 AS kind,
         110{D} + ({PB} % 10) * 6{D} + {_grid('p_partkey::BIGINT', 7919, 10007)} AS x,
         30{D} + (({PB} // 10) % 10) * 6{D} + {_grid('p_partkey::BIGINT', 10473, 10009)} AS y,
         (4 + p_partkey % 7) / 64{D} AS w,
         (4 + p_partkey % 5) / 64{D} AS h
  FROM part
)"""

ZONE_BASE = f"""
zone_base AS (
  SELECT s_suppkey::BIGINT AS k,
         (11000 + {ZB} // 100)::VARCHAR || (s_suppkey % 3)::VARCHAR || 'Z' || {_pad('s_suppkey', 5)} AS oid,
         CASE WHEN s_suppkey % 11 = 10 THEN '{{"other":"x"}}'
              ELSE '{{"PDJB":"' || (1 + s_suppkey % 5)::VARCHAR || '"}}' END AS tags,
         (s_suppkey // 3) % 2 AS kind,
         110{D} + ({ZB} % 10) * 6{D} + {_grid('s_suppkey::BIGINT', 6271, 10007)} AS x,
         30{D} + (({ZB} // 10) % 10) * 6{D} + {_grid('s_suppkey::BIGINT', 3571, 10009)} AS y,
         (16 + 8 * (s_suppkey % 5)) / 64{D} AS w,
         (16 + 8 * (s_suppkey % 4)) / 64{D} AS h
  FROM supplier
)"""


def _p(x: str, y: str) -> str:
    return f"{{'x': {x}, 'y': {y}}}"


RECT = f"[{_p('x', 'y')}, {_p('x + w', 'y')}, {_p('x + w', 'y + h')}, {_p('x', 'y + h')}, {_p('x', 'y')}]"
TRI = f"[{_p('x', 'y')}, {_p('x + w', 'y')}, {_p('x', 'y + h')}, {_p('x', 'y')}]"
LSHAPE = (f"[{_p('x', 'y')}, {_p('x + w', 'y')}, {_p('x + w', 'y + h / 2')}, {_p('x + w / 2', 'y + h / 2')}, "
          f"{_p('x + w / 2', 'y + h')}, {_p('x', 'y + h')}, {_p('x', 'y')}]")
HOLE = (f"[{_p('x + w / 4', 'y + h / 4')}, {_p('x + w / 4', 'y + 3 * h / 4')}, {_p('x + 3 * w / 4', 'y + 3 * h / 4')}, "
        f"{_p('x + 3 * w / 4', 'y + h / 4')}, {_p('x + w / 4', 'y + h / 4')}]")

# features: (k, oid, tags, kind, x, y, w, h, xmin, ymin, xmax, ymax, region, cell, key)
PARCELS = PARCEL_BASE + f""",
parcel_m AS (
  SELECT *, {morton_of('x', 'y')} AS sw, {morton_of('(x + w)', '(y + h)')} AS ne FROM parcel_base
),
parcels AS (
  SELECT k, oid, tags, kind, x, y, w, h, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax,
         substr(split_part(oid, '_', 1), 1, 6) AS region, {envelope_cell('x', 'sw', 'ne')} AS cell
  FROM parcel_m
),
parcel_rings AS (
  SELECT k, oid, 0 AS ring, CASE kind WHEN 0 THEN {RECT} WHEN 1 THEN {TRI} WHEN 2 THEN {LSHAPE} ELSE {RECT} END AS pts
  FROM parcel_base
  UNION ALL
  SELECT k, oid, 1 AS ring, {HOLE} AS pts FROM parcel_base WHERE kind = 3
)"""

ZONES = ZONE_BASE + f""",
zone_m AS (
  SELECT *, {morton_of('x', 'y')} AS sw, {morton_of('(x + w)', '(y + h)')} AS ne FROM zone_base
),
zones AS (
  SELECT k, oid, tags, kind, x, y, w, h, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax,
         substr(split_part(oid, '_', 1), 1, 6) AS region, {envelope_cell('x', 'sw', 'ne')} AS cell,
         json_extract_string(tags, '$.PDJB') AS pd_class
  FROM zone_m
),
zone_rings AS (
  SELECT k, oid, 0 AS ring, CASE kind WHEN 0 THEN {RECT} ELSE {TRI} END AS pts FROM zone_base
)"""

POINTS = f"""
point_base AS (
  SELECT c_custkey::BIGINT AS k,
         '22000' || (c_custkey % 4)::VARCHAR || c_custkey::VARCHAR AS oid,
         ((c_custkey::BIGINT * 7919) % 36000) / 100{D} - 180{D} AS lon,
         ((c_custkey::BIGINT * 10473) % 18000) / 100{D} - 90{D} AS lat,
         c_nationkey AS nationkey, c_acctbal AS distance
  FROM customer
),
points AS (
  SELECT *, {morton_of('lon', 'lat')} AS m FROM point_base
)"""

WINDOWS = f"""
windows AS (
  SELECT n_nationkey::INTEGER AS window_id,
         110{D} + (n_nationkey % 5) * 0.75{D} AS xmin, 30{D} + (n_nationkey // 5) * 0.75{D} AS ymin,
         110{D} + (n_nationkey % 5) * 0.75{D} + 0.5{D} AS xmax, 30{D} + (n_nationkey // 5) * 0.75{D} + 0.5{D} AS ymax
  FROM nation
)"""


def vertices(rings_cte: str) -> str:
    return f"""
SELECT k, oid, ring, i AS pos, pts[i].x AS x, pts[i].y AS y
FROM (SELECT k, oid, ring, pts, unnest(range(1, len(pts) + 1)) AS i FROM {rings_cte})"""


def edges(rings_cte: str) -> str:
    """Non-vertical edges, left to right, with the sign of the original direction."""
    return f"""
SELECT k, oid, s, xl, yl, xr, yr, (yr - yl) / (xr - xl) AS m FROM (
SELECT k, oid, CASE WHEN x1 < x2 THEN 1{D} ELSE -1{D} END AS s,
       least(x1, x2) AS xl, CASE WHEN x1 < x2 THEN y1 ELSE y2 END AS yl,
       greatest(x1, x2) AS xr, CASE WHEN x1 < x2 THEN y2 ELSE y1 END AS yr
FROM (SELECT k, oid, pts[i].x AS x1, pts[i].y AS y1, pts[i + 1].x AS x2, pts[i + 1].y AS y2
      FROM (SELECT k, oid, pts, unnest(range(1, len(pts))) AS i FROM {rings_cte}))
WHERE x1 <> x2)"""


def ring_area_sql(rings_cte: str) -> str:
    """Per-feature polygon area: |shoelace| of the shell minus holes."""
    return f"""
SELECT k, oid, sum(CASE WHEN ring = 0 THEN abs(a) ELSE -abs(a) END) AS area
FROM (SELECT k, oid, ring, sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2{D} AS a
      FROM (SELECT k, oid, ring, pts[1].x AS x0, pts[1].y AS y0, pts[i].x AS x1, pts[i].y AS y1,
                   pts[i + 1].x AS x2, pts[i + 1].y AS y2
            FROM (SELECT k, oid, ring, pts, unnest(range(1, len(pts))) AS i FROM {rings_cte}))
      GROUP BY k, oid, ring)
GROUP BY k, oid"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"



def overlap_ctes(cand: str, a_edges: str, b_edges: str, name: str = "areas") -> str:
    """CTEs computing ``name``(pk, zk, overlap_area) for candidate pairs ``cand`` (pk, zk, x0, x1, oy): the signed
    sum over edge pairs of the integral of the lower edge line over the common x-range."""
    return f"""
ep1 AS (
  SELECT c.pk, c.zk, e.s * g.s AS ss, greatest(e.xl, g.xl) AS l, least(e.xr, g.xr) AS r,
         e.xl AS exl, e.yl - c.oy AS eyl, e.m AS em, g.xl AS gxl, g.yl - c.oy AS gyl, g.m AS gm
  FROM {cand} c JOIN {a_edges} e ON e.k = c.pk JOIN {b_edges} g ON g.k = c.zk
  WHERE e.xr > c.x0 AND e.xl < c.x1 AND g.xr > c.x0 AND g.xl < c.x1
),
ep2 AS (
  SELECT pk, zk, ss, l, r, eyl + (l - exl) * em AS fl, eyl + (r - exl) * em AS fr,
         gyl + (l - gxl) * gm AS gl, gyl + (r - gxl) * gm AS gr
  FROM ep1 WHERE l < r
),
ep3 AS (
  SELECT pk, zk, ss * (r - l) * ((fl + fr + gl + gr) -
         CASE WHEN (fl - gl) * (fr - gr) >= 0 THEN abs(fl - gl) + abs(fr - gr)
              ELSE ((fl - gl) * (fl - gl) + (fr - gr) * (fr - gr)) / (abs(fl - gl) + abs(fr - gr)) END) / 4{D} AS v
  FROM ep2
),
{name} AS (
  SELECT c.pk, c.zk, coalesce(t.a, 0{D}) AS overlap_area
  FROM {cand} c LEFT JOIN (SELECT pk, zk, sum(v) AS a FROM ep3 GROUP BY pk, zk) t ON t.pk = c.pk AND t.zk = c.zk
)"""


CANDIDATES = """
cand AS (
  SELECT p.k AS pk, z.k AS zk, p.oid AS p_oid, z.oid AS z_oid, p.cell AS p_cell, z.cell AS z_cell,
         p.cell || '_' || p.oid AS p_key, z.cell || '_' || z.oid AS z_key, z.pd_class AS z_class,
         greatest(p.xmin, z.xmin) AS x0, least(p.xmax, z.xmax) AS x1, greatest(p.ymin, z.ymin) AS oy
  FROM parcels p JOIN zones z ON p.region = z.region
   AND p.xmin <= z.xmax AND p.xmax >= z.xmin AND p.ymin <= z.ymax AND p.ymax >= z.ymin
)"""


#: Fixture coordinates are dyadic, so overlaps and differences between them are above this share of an area, or zero. The
#: sums below are taken from further away than a small parcel is wide, so small parcels need a larger share.
SHARE, SMALL_SHARE = "1e-11", "1e-7"


def shrunk_parcels(bits: int) -> str:
    """The parcel CTEs with sides divided by 2^bits."""
    return PARCELS.replace("/ 64::DOUBLE AS w", f"/ 64::DOUBLE / {1 << bits}::DOUBLE AS w").replace(
        "/ 64::DOUBLE AS h", f"/ 64::DOUBLE / {1 << bits}::DOUBLE AS h")


def shifted_zones(bits: int) -> str:
    """The zone CTEs with (key % 1024) / 2^bits added to the width."""
    return ZONES.replace("/ 64::DOUBLE AS w", f"/ 64::DOUBLE + (s_suppkey % 1024) / {1 << bits}::DOUBLE AS w")


def overlay_all(parcels: str | None = None, zones: str | None = None, share: str = SHARE) -> str:
    """CTEs up to ``scored`` (pairs with their area; ``hit``: they overlap) for the fixture parcels and zones."""
    return with_ctes(parcels or PARCELS, zones or ZONES, CANDIDATES,
                     f"pe AS ({edges('parcel_rings')})", f"ze AS ({edges('zone_rings')})",
                     f"pa AS ({ring_area_sql('parcel_rings')})", f"za AS ({ring_area_sql('zone_rings')})",
                     overlap_ctes("cand", "pe", "ze"),
                     f"""scored AS (SELECT c.*, a.overlap_area, pa.area AS p_area,
                            a.overlap_area > {share} * least(pa.area, za.area) AS hit
                          FROM cand c JOIN areas a ON a.pk = c.pk AND a.zk = c.zk
                          JOIN pa ON pa.k = c.pk JOIN za ON za.k = c.zk)""")


def best_of(scored: str, area_col: str = "overlap_area", digits: str = "round(coalesce(b.{a}, 0::DOUBLE) + 1.2345e-10, 9)",
            share: str = SHARE) -> str:
    """Arg-max per parcel on the area as it is; zones that reach the largest but for ``share`` of the parcel's area are a
    tie, which the smallest zone key wins. Parcels without any get ('0', 0)."""
    area = digits.replace("{a}", area_col)
    return f"""
SELECT p.oid, CASE WHEN b.pk IS NULL THEN '0' ELSE b.z_class END AS pd_class, {area} AS overlap_area
FROM parcels p LEFT JOIN (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY pk ORDER BY z_key) AS rn FROM (
      SELECT *, max({area_col}) OVER (PARTITION BY pk) AS top FROM {scored} WHERE hit)
    WHERE {area_col} >= top - {share} * p_area) WHERE rn = 1
) b ON b.pk = p.k"""


# Neighbour numbering 0=N 1=NE 2=E 3=SE 4=S 5=SW 6=W 7=NW as (dx, dy) offsets.
NEIGHBOURS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def cover_compat_sql(chars: int) -> str:
    """Neighbour-case cover of each parcel envelope around the cell of its centre, as a list per parcel."""
    offs = NEIGHBOURS

    def at(cx, cy, n):
        ox, oy = offs[n]
        return f"({cx} = tx + ({ox}) AND {cy} = ty + ({oy}))"

    def cells(*ns):
        return "[" + ", ".join(["gt"] + [f"g{n}" for n in ns]) + "]"

    here = "x0 = tx AND y0 = ty AND x0 = tx AND y1 = ty AND x1 = tx AND y1 = ty AND x1 = tx AND y0 = ty"
    return f"""CASE WHEN {here} THEN {cells()}
  WHEN {at('x0', 'y0', 5)} THEN {cells(4, 5, 6)}
  WHEN {at('x0', 'y0', 6)} AND {at('x0', 'y1', 6)} THEN {cells(6)}
  WHEN {at('x0', 'y1', 7)} THEN {cells(0, 6, 7)}
  WHEN {at('x0', 'y1', 0)} AND {at('x1', 'y1', 0)} THEN {cells(0)}
  WHEN {at('x1', 'y1', 1)} THEN {cells(0, 1, 2)}
  WHEN {at('x1', 'y1', 2)} AND {at('x1', 'y0', 2)} THEN {cells(2)}
  WHEN {at('x1', 'y0', 3)} THEN {cells(2, 3, 4)}
  WHEN {at('x1', 'y0', 4)} AND {at('x0', 'y0', 4)} THEN {cells(4)}
  ELSE []::VARCHAR[] END"""


def neighbour_hashes(chars: int) -> str:
    """Select-list of the target cell hash ``gt`` and its 8 neighbours ``g0``..``g7`` (N, NE, E, SE, S, SW, W, NW)."""
    offs = NEIGHBOURS
    cols = [f"{geohash_of_cell('tx', 'ty', chars)} AS gt"]
    cols += [f"{geohash_of_cell(f'tx + ({ox})', f'ty + ({oy})', chars)} AS g{n}" for n, (ox, oy) in enumerate(offs)]
    return ", ".join(cols)


def lcp2(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    diff = f"list_min(list_filter(range(1, {n} + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)))"
    return f"substr({a}, 1, CASE WHEN {n} = 0 THEN 0 ELSE coalesce({diff} - 1, {n}) END)"


def fmt_num(v: str) -> str:
    return f"(CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN {v}::BIGINT::VARCHAR ELSE {v}::VARCHAR END)"


PARCEL_WKT = f"""
rt AS (
  SELECT k, oid, ring, '(' || string_agg({fmt_num('x')} || ' ' || {fmt_num('y')}, ', ' ORDER BY pos) || ')' AS t
  FROM ({vertices('parcel_rings')}) GROUP BY k, oid, ring
),
pw AS (SELECT k, oid, 'POLYGON (' || string_agg(t, ', ' ORDER BY ring) || ')' AS wkt FROM rt GROUP BY k, oid)"""

# lines derived from the parcels; some are spoiled on purpose, by a rule on the key
WKT_JUNK = {7: "dropped (lower case)", 13: "malformed WKT", 21: "missing fields", 33: "coordinates out of range"}
