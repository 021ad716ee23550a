"""Window (range) queries: a feature matches when *any of its vertices* lies in the closed window.

A polygon covering the window or a line crossing it without a vertex inside does not match; an empty geometry
never matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from geotables.functions.shapes import vertex_in_box_sql
from geotables.operators.spatial_join import grid_join, prefixed


def parse_window(text: str, compat: bool = False) -> tuple[float, float, float, float]:
    """Window from ``"x1,y1,x2,y2"`` text. ``compat=True`` reads the four numbers in the order the literal job
    passes them to its envelope, ``(x1, x2, y1, y2)``. Swapped ends are normalised either way."""
    a = [float(v) for v in text.split(",")]
    if len(a) != 4:
        raise ValueError(f"window needs 4 numbers, got {text!r}")
    if compat:
        x1, x2, y1, y2 = a
    else:
        x1, y1, x2, y2 = a
    return min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)


def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def range_query(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows with a vertex in [xmin, xmax] x [ymin, ymax]. The envelope test is a plain column predicate, so it is
    pushed to the Parquet scan (row-group min/max) before the exact vertex test runs."""
    xmin, xmax = min(xmin, xmax), max(xmin, xmax)
    ymin, ymax = min(ymin, ymax), max(ymin, ymax)
    x0, y0, x1, y1 = _d(xmin), _d(ymin), _d(xmax), _d(ymax)
    env = f"xmax >= {x0} AND xmin <= {x1} AND ymax >= {y0} AND ymin <= {y1}"
    return df.where(env).where(vertex_in_box_sql("rings", x0, y0, x1, y1))


def range_query_many(df: DataFrame, windows: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """All (window_id, feature) matches for a table of windows (window_id, xmin, ymin, xmax, ymax).

    Candidates come from ``grid_join`` on envelopes (no nested loop, each pair once), then the exact vertex test.
    Returns ``window_id`` plus the requested feature columns (default ``oid``).
    """
    cols = cols or ["oid"]
    need = list(dict.fromkeys(cols + ["rings", "xmin", "ymin", "xmax", "ymax"]))
    f = prefixed(df, "f_", need)
    w = prefixed(windows, "w_", ["window_id", "xmin", "ymin", "xmax", "ymax"])
    pairs = grid_join(f, w, ("f_xmin", "f_ymin", "f_xmax", "f_ymax"), ("w_xmin", "w_ymin", "w_xmax", "w_ymax"))
    hit = pairs.where(vertex_in_box_sql("f_rings", "w_xmin", "w_ymin", "w_xmax", "w_ymax"))
    return hit.selectExpr("w_window_id AS window_id", *[f"f_{c} AS {c}" for c in cols])
