"""Windows on a stored key table by the cells they cover.

A window is covered by geohash cells of different lengths: from the cell that holds it whole, cells on its edge are split
further, cells inside it stay as they are. A feature can only meet the window if its own cell (the common prefix of its
envelope) starts with a cell of the cover, or is an ancestor of one. Both are equalities of strings, so the scan is one equi-join
with the cover on (directory, prefix); the cover, where Spark measures it to be small enough to be broadcast, prunes the
directories of the scan at run time, and nothing of it goes through the driver but the few lengths of its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from geotables.functions import cells
from geotables.functions.shapes import vertex_in_box_sql
from geotables.session import materialize
from geotables.sources.geo_table import NO_CELL, table_layout

BITS = cells.AXIS_BITS


def window_cover(windows: DataFrame, splits: int = 2) -> DataFrame:
    """(window_id, xmin, ymin, xmax, ymax, cell): cells without common places that cover the window, those on its edge split
    ``splits`` times below the first ones (32 at most, one character longer than the window's own cell)."""
    env = ["xmin", "ymin", "xmax", "ymax"]
    w = windows.where("xmin <= xmax AND ymin <= ymax").selectExpr(
        "window_id", *env, f"length({cells.envelope_cell_sql()}) AS own", f"{cells.lon_index_sql('xmin')} AS x0",
        f"{cells.lon_index_sql('xmax')} AS x1", f"{cells.lat_index_sql('ymin')} AS y0", f"{cells.lat_index_sql('ymax')} AS y1")
    w = w.selectExpr("*", f"least(own + 1, {cells.MAX_CHARS}) AS c")
    keep = ["window_id", *env, "x0", "x1", "y0", "y1"]
    shift_x, shift_y = f"{BITS} - (5 * {{0}} + 1) div 2", f"{BITS} - (5 * {{0}}) div 2"
    at = lambda v, shift, c: f"shiftright({v}, CAST({shift.format(c)} AS INT))"
    rows = w.selectExpr(*keep, "c", f"explode(sequence({at('x0', shift_x, 'c')}, {at('x1', shift_x, 'c')})) AS cx").selectExpr(
        *keep, "c", "cx", f"explode(sequence({at('y0', shift_y, 'c')}, {at('y1', shift_y, 'c')})) AS cy")
    up = lambda v, shift, c: f"shiftleft({v}, CAST({shift.format(c)} AS INT))"
    for _ in range(splits):
        inside = (f"{up('cx', shift_x, 'c')} >= x0 AND {up('(cx + 1)', shift_x, 'c')} - 1 <= x1 AND "
                  f"{up('cy', shift_y, 'c')} >= y0 AND {up('(cy + 1)', shift_y, 'c')} - 1 <= y1")
        rows = rows.selectExpr(*keep, "cx", "cy", "c", f"IF(c = {cells.MAX_CHARS} OR ({inside}), c, c + 1) AS d")
        # the children that meet the window, or the cell itself
        lo = lambda v, e, s: f"greatest({at(up(v, s, 'c'), s, 'd')}, {at(e, s, 'd')})"
        hi = lambda v, e, s: f"least({at(up(f'({v} + 1)', s, 'c') + ' - 1', s, 'd')}, {at(e, s, 'd')})"
        rows = rows.selectExpr(*keep, "cy", "c", "d", f"explode(sequence({lo('cx', 'x0', shift_x)}, {hi('cx', 'x1', shift_x)})) AS cx")
        rows = rows.selectExpr(*keep, "d AS c", "cx", f"explode(sequence({lo('cy', 'y0', shift_y)}, {hi('cy', 'y1', shift_y)})) AS cy")
    name = cells.geohash_of_cell_sql(up("cx", shift_x, "c"), up("cy", shift_y, "c"), cells.MAX_CHARS)
    return rows.selectExpr("window_id", *env, f"substring({name}, 1, CAST(c AS INT)) AS cell")


def scan_windows(table: DataFrame, windows: DataFrame, cols: list[str] | None = None, splits: int = 2) -> DataFrame:
    """All (window_id, feature) matches, as ``range_query_many``, from a stored key table (``read_geo_table``), scanned once.
    Returns ``window_id`` and the feature columns ``cols`` (default ``oid``)."""
    cols = cols or ["oid"]
    n = table_layout(table)
    env = ["xmin", "ymin", "xmax", "ymax"]
    cover = window_cover(windows, splits)
    # features below a cell of the cover, and features whose cell is a proper ancestor of one
    below = cover.selectExpr("window_id", *env, "cell AS probe", "length(cell) AS len")
    above = cover.selectExpr("window_id", *env, "explode(transform(sequence(0, length(cell) - 1), i -> substring(cell, 1, i))) AS probe",
                             "-1 AS len").distinct()
    probes = below.unionByName(above)
    if n:
        # the directory of the probe; a short cell of the cover lies above several, which its longer names tell
        letters = "array(" + ", ".join(f"'{c}'" for c in cells.GEOHASH_ALPHABET) + ")"
        names = f"array(coalesce(nullif(substring(probe, 1, {n}), ''), '{NO_CELL}'))"
        for i in range(n - 1, -1, -1):
            deeper = f"transform({letters}, l -> concat(s, l))"
            grown = "array(probe)"
            for _ in range(n - i):
                grown = f"flatten(transform({grown}, s -> concat(array(s), {deeper})))"
            names = f"CASE WHEN len = {i} THEN transform(array_distinct({grown}), s -> IF(s = '', '{NO_CELL}', s)) ELSE {names} END"
        probes = probes.selectExpr("*", f"explode({names}) AS dir")
    probes = materialize(probes.selectExpr("window_id AS w_id", *[f"{c} AS w_{c}" for c in env], "probe AS w_probe",
                                           "len AS w_len", *(["dir AS w_dir"] if n else [])))
    lengths = sorted(r[0] for r in probes.select("w_len").distinct().collect())  # 14 at most
    tries = ", ".join(f"named_struct('probe', IF({v} < 0, cell, substring(cell, 1, {max(v, 0)})), 'len', {v})" for v in lengths)
    if not lengths:
        return table.where("false").selectExpr("CAST(NULL AS INT) AS window_id", *cols)
    need = list(dict.fromkeys([*cols, "rings", *env, "cell", *(["cell_prefix"] if n else [])]))
    rows = table.select(*need).selectExpr("*", f"inline(filter(array({tries}), t -> t.len <= length(cell)))")
    met = rows.join(probes.where("w_len >= -1"), [rows["probe"] == probes["w_probe"], rows["len"] == probes["w_len"],
                                                  *([rows["cell_prefix"] == probes["w_dir"]] if n else [])])
    met = met.where("xmax >= w_xmin AND xmin <= w_xmax AND ymax >= w_ymin AND ymin <= w_ymax").where(
        vertex_in_box_sql("rings", "w_xmin", "w_ymin", "w_xmax", "w_ymax"))
    return met.selectExpr("w_id AS window_id", *cols)
