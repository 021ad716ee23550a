"""Geohash cells as integer arithmetic in Spark SQL expressions.

A geohash of n characters is the interleaving (longitude bit first) of the binary cell indices of the point on each
axis, written in base 32; twelve characters are 60 bits, 30 per axis. Each character takes three bits of one axis and
two of the other, so it is looked up by these five bits, and no bit string is ever built.

Functions named ``*_sql`` return SQL expression text over column names or other expressions. Building an expression as text
costs one JVM call instead of one per operator node. Expressions refer to each cell index a bounded number of times (once a
character), and the generated code computes equal subexpressions once.
"""

from __future__ import annotations

# Fixed value: the geohash base-32 alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"

AXIS_BITS = 30
MAX_CHARS = 12

# Distance thresholds for the geohash length (12 down to 1); anything larger gets length 1.
PRECISION_THRESHOLDS = [
    (0.0186, 12), (0.1492, 11), (0.5971, 10), (4.78, 9), (19.11, 8), (76, 7),
    (610, 6), (2400, 5), (20000, 4), (78000, 3), (630000, 2),
]


def lon_index_sql(lon: str, bits: int = AXIS_BITS) -> str:
    n = 1 << bits
    return f"CAST(least(greatest(floor(({lon} + 180D) / 360D * {float(n)}D), 0L), {n - 1}L) AS BIGINT)"


def lat_index_sql(lat: str, bits: int = AXIS_BITS) -> str:
    n = 1 << bits
    return f"CAST(least(greatest(floor(({lat} + 90D) / 180D * {float(n)}D), 0L), {n - 1}L) AS BIGINT)"


def axis_bits(chars: int) -> tuple[int, int]:
    """Bits on (lon, lat) for a geohash of ``chars`` characters."""
    return (5 * chars + 1) // 2, (5 * chars) // 2


def _by_axis() -> str:
    """The alphabet by the bits of the axes: at 4 * a + b the character of three bits a and two bits b, interleaved."""
    def interleaved(a: int, b: int) -> int:
        return ((a >> 2 & 1) << 4) | ((b >> 1 & 1) << 3) | ((a >> 1 & 1) << 2) | ((b & 1) << 1) | (a & 1)
    return "".join(GEOHASH_ALPHABET[interleaved(a, b)] for a in range(8) for b in range(4))


LETTERS = _by_axis()


def _characters(ix: str, iy: str, bits: tuple[int, int], chars: int) -> str:
    """The first ``chars`` characters of the cell with indices of ``bits`` bits on the two axes."""
    def character(i: int) -> str:
        bx, by = axis_bits(i + 1)
        x, y = f"shiftright({ix}, {bits[0] - bx})", f"shiftright({iy}, {bits[1] - by})"
        three, two = (x, y) if i % 2 == 0 else (y, x)  # longitude and latitude begin in turn
        return f"substring('{LETTERS}', CAST(({three} & 7) * 4 + ({two} & 3) + 1 AS INT), 1)"
    return "concat(" + ", ".join(character(i) for i in range(chars)) + ")" if chars else "''"


def geohash_sql(lon: str, lat: str, chars: int = MAX_CHARS) -> str:
    """Geohash string of a point; coordinates outside the valid range are clamped to the edge cells."""
    return _characters(lon_index_sql(lon), lat_index_sql(lat), (AXIS_BITS, AXIS_BITS), chars)


def _bit_length_sql(v: str) -> str:
    """Bits of a whole number below 2^30 (0 for 0). Half is added so that no logarithm lies near a whole number."""
    return f"(CAST(floor(log2({v} + 0.5D)) AS INT) + 1)"


def envelope_cell_sql(xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> str:
    """Longest common prefix of the 12-character geohashes of the four envelope corners.

    The corners share n characters exactly when the indices of both ends share the bits of n characters on each axis. An
    empty envelope (NULL) gives ''.
    """
    shared_x = f"({AXIS_BITS} - {_bit_length_sql(f'({lon_index_sql(xmin)} ^ {lon_index_sql(xmax)})')})"
    shared_y = f"({AXIS_BITS} - {_bit_length_sql(f'({lat_index_sql(ymin)} ^ {lat_index_sql(ymax)})')})"
    n = f"least((2 * {shared_x}) div 5, (2 * {shared_y} + 1) div 5)"
    # the hash stays outside of the condition: equal subexpressions are computed once only where they are always computed
    return f"substring({geohash_sql(xmin, ymin)}, 1, IF({xmin} IS NULL, 0, CAST({n} AS INT)))"


def cell_ix_sql(lon: str, chars: int) -> str:
    return f"shiftright({lon_index_sql(lon)}, {AXIS_BITS - axis_bits(chars)[0]})"


def cell_iy_sql(lat: str, chars: int) -> str:
    return f"shiftright({lat_index_sql(lat)}, {AXIS_BITS - axis_bits(chars)[1]})"


def geohash_of_cell_sql(ix: str, iy: str, chars: int) -> str:
    """Geohash string of a cell given by its indices at ``chars`` precision."""
    return _characters(ix, iy, axis_bits(chars), chars)


def precision_sql(d: str) -> str:
    """Geohash length for a distance precision; NULL stays NULL."""
    whens = " ".join(f"WHEN {d} <= {float(limit)}D THEN {chars}" for limit, chars in PRECISION_THRESHOLDS)
    return f"CAST(CASE WHEN {d} IS NULL THEN NULL {whens} ELSE 1 END AS INT)"


# Neighbour numbering 0=N 1=NE 2=E 3=SE 4=S 5=SW 6=W 7=NW as (dx, dy) offsets.
NEIGHBOUR_OFFSETS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def cover_compat_sql(tx: str, ty: str, corners: dict[str, tuple[str, str]], chars: int) -> str:
    """Literal neighbour-case cover of a box around the target cell (tx, ty): 1, 2 or 4 cells in a fixed order,
    or an empty array when the box reaches beyond the 3x3 block in a way no case names. The order of the cases is part of the
    result: the first that holds decides.

    ``corners`` maps LD, LU, RU, RD to (ix, iy) expressions of the corner cells at ``chars`` precision."""
    def at(c, n):
        ox, oy = NEIGHBOUR_OFFSETS[n]
        cx, cy = corners[c]
        return f"({cx} = {tx} + {ox} AND {cy} = {ty} + {oy})"

    def cells(*ns):
        items = [geohash_of_cell_sql(tx, ty, chars)]
        for n in ns:
            ox, oy = NEIGHBOUR_OFFSETS[n]
            items.append(geohash_of_cell_sql(f"({tx} + {ox})", f"({ty} + {oy})", chars))
        return "array(" + ", ".join(items) + ")"

    here = " AND ".join(f"({cx} = {tx} AND {cy} = {ty})" for cx, cy in corners.values())
    return (f"CASE WHEN {here} THEN {cells()} "
            f"WHEN {at('LD', 5)} THEN {cells(4, 5, 6)} "
            f"WHEN {at('LD', 6)} AND {at('LU', 6)} THEN {cells(6)} "
            f"WHEN {at('LU', 7)} THEN {cells(0, 6, 7)} "
            f"WHEN {at('LU', 0)} AND {at('RU', 0)} THEN {cells(0)} "
            f"WHEN {at('RU', 1)} THEN {cells(0, 1, 2)} "
            f"WHEN {at('RU', 2)} AND {at('RD', 2)} THEN {cells(2)} "
            f"WHEN {at('RD', 3)} THEN {cells(2, 3, 4)} "
            f"WHEN {at('RD', 4)} AND {at('LD', 4)} THEN {cells(4)} "
            f"ELSE CAST(array() AS array<string>) END")


def common_prefix2_sql(a: str, b: str) -> str:
    """Longest common prefix of two strings; NULL if either is NULL."""
    n = f"least(length({a}), length({b}))"
    first_diff = f"array_min(filter(sequence(1, greatest({n}, 1)), i -> substring({a}, i, 1) != substring({b}, i, 1)))"
    return f"substring({a}, 1, CASE WHEN {n} = 0 THEN 0 ELSE coalesce({first_diff} - 1, {n}) END)"
