"""Envelope-intersection joins expressed as equi-joins.

Spark has no spatial join strategy: a join whose only condition is box overlap plans as a nested loop or a
cartesian product. ``grid_join`` turns it into an equi-join on grid cells so Catalyst/AQE can pick a broadcast
hash join (when a side is measured small) or a shuffled sort-merge join on ``(equi keys, level, ix, iy)``.

Multi-level grid: cells at level L are squares of side 2^L degrees. Every feature gets its *own* level, the
smallest L with 2^L >= its larger envelope side, so it touches at most 2x2 cells there however big it is. A pair
(a, b) is matched at level max(level_a, level_b): the finer side is replicated to the coarser side's level, but
only to levels that occur on the other side, and there only if its envelope meets the box around the other side's
features of that level (a handful of levels and boxes, read back once). Each pair is emitted once, in
the cell holding the south-west corner of the intersection of the two envelopes, so no ``distinct`` shuffle is
needed and no cap on cells or partners is applied.

A coarse cell can hold very many features that are far finer. What is too full is measured: a histogram of both sides by
cell (a partial aggregate) names the cells with more than ``FULL_CELL`` rows of one side and some of the other. The rows of
such a cell are sorted along the Z-order of a linear quadtree and cut into runs of ``FULL_CELL`` rows, with the box of each run;
runs of the two sides whose boxes meet become join keys of their own, and a row goes to the runs of the other side whose box it
meets. So a key has no more than ``FULL_CELL`` rows of a side, however the features lie (all at one point, too), a zone over a
whole country is copied once a run, and where nothing is too full nothing is copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geotables.functions.cells import geohash_sql
from geotables.session import as_large, materialize

MIN_LEVEL = -24   # 2^-24 degrees, about 7 mm at the equator; points and tiny features share it
MAX_LEVEL = 9     # 512 degrees: one cell holds the whole lon/lat plane
FULL_CELL, FEW_ROWS = 20_000, 100   # bounds of the rows of a side that a join key may hold
SMALL_SIDE = 10_000   # features of the smaller side up to which Spark may broadcast it

Env = tuple[str, str, str, str]


def bbox_overlaps_sql(a: Env, b: Env) -> str:
    """Closed envelope intersection (touching counts)."""
    return f"({a[0]} <= {b[2]} AND {a[2]} >= {b[0]} AND {a[1]} <= {b[3]} AND {a[3]} >= {b[1]})"


def own_level_sql(env: Env) -> str:
    xmin, ymin, xmax, ymax = env
    ext = f"greatest({xmax} - {xmin}, {ymax} - {ymin})"
    return (f"CAST(CASE WHEN {ext} <= {2.0 ** MIN_LEVEL!r}D THEN {MIN_LEVEL} "
            f"ELSE least(greatest(CAST(ceil(log2({ext})) AS INT), {MIN_LEVEL}), {MAX_LEVEL}) END AS INT)")


def _cell_sql(v: str, lvl: str) -> str:
    # multiplying by a power of two is exact, so cell boundaries are exact
    return f"CAST(floor({v} * pow(2D, -{lvl})) AS BIGINT)"


def _cells_sql(env: Env, lvl: str) -> str:
    xmin, ymin, xmax, ymax = env
    return (f"flatten(transform(sequence({_cell_sql(ymin, lvl)}, {_cell_sql(ymax, lvl)}), cy -> "
            f"transform(sequence({_cell_sql(xmin, lvl)}, {_cell_sql(xmax, lvl)}), cx -> "
            f"named_struct('ix', cx, 'iy', cy))))")


def _explode_cells(df: DataFrame, env: Env, lvl: str, p: str) -> DataFrame:
    """One row per cell at level ``lvl`` that the envelope touches (at most 2x2 at the feature's own level)."""
    c = df.selectExpr("*", f"{lvl} AS {p}lvl", f"explode({_cells_sql(env, lvl)}) AS {p}c")
    return c.selectExpr("*", f"{p}c.ix AS {p}ix", f"{p}c.iy AS {p}iy").drop(f"{p}c")


class _Levels:
    """What is known of a side before the join: its number of rows, and for each own level the box around its features."""

    def __init__(self, df: DataFrame, own: str, env: Env):
        lows, highs = [F.min(c) for c in env[:2]], [F.max(c) for c in env[2:]]
        rows = df.groupBy(own).agg(F.count(F.lit(1)), *lows, *highs).collect()  # one row a level, 34 at most
        self.n_rows = sum(r[1] for r in rows)
        self.boxes = {r[0]: tuple(r[2:]) for r in sorted(rows)}

    def met_sql(self, own: str, env: Env, strict: bool) -> str:
        """The levels (above) the own one whose box an envelope meets."""
        items = ", ".join(f"named_struct('v', {v}, " + ", ".join(f"'{n}', CAST('{x!r}' AS DOUBLE)" for n, x in zip(("a", "b", "c", "d"), box)) + ")"
                          for v, box in self.boxes.items())
        met = bbox_overlaps_sql(env, ("t.a", "t.b", "t.c", "t.d"))
        return f"transform(filter(array({items}), t -> t.v {'>' if strict else '>='} {own} AND {met}), t -> t.v)"


class _Side:
    """One side of a branch of the join: its rows by cell (columns ``lvl``, ``ix``, ``iy`` with the prefix ``p``)."""

    def __init__(self, rows: DataFrame, p: str, env: Env, on: list[str]):
        self.rows, self.p, self.env = rows, p, env
        self.key = [*on, f"{p}lvl", f"{p}ix", f"{p}iy"]

    def cell_hash(self) -> str:
        return f"xxhash64({', '.join(self.key)})"

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns k0, k1, ... of cell keys renamed to this side's."""
        return df.withColumnsRenamed({f"k{i}": f"{self.p}k{i}" for i in range(len(self.key))})

    def on_cell(self, p: str | None = None) -> str:
        """The cell of a row is that of a table of cells."""
        return " AND ".join(f"{c} = {p or self.p}k{i}" for i, c in enumerate(self.key))

    def histogram(self, branch: int, mine: str, other: str) -> DataFrame:
        return self.rows.selectExpr(f"{branch} AS branch", f"{self.cell_hash()} AS cell", f"1L AS {mine}", f"0L AS {other}")

    def runs(self, cells: DataFrame, n: str, full_cell: int) -> tuple[DataFrame, DataFrame]:
        """(rows of ``cells`` with the number of their run, the runs with their boxes). Cells with more than ``full_cell`` rows
        (column ``n``) are cut along the Z-order of the south-west corners, others are one run."""
        p, cols = self.p, self.rows.columns
        rows = self.rows.join(cells.selectExpr(f"cell AS {p}cell", f"{n} AS {p}n"), F.expr(f"{self.cell_hash()} = {p}cell")).select(
            *cols, f"{p}n")
        z = geohash_sql(self.env[0], self.env[1])
        sorts = [*self.key, f"{p}z"]
        cut = rows.where(f"{p}n > {full_cell}").withColumn(f"{p}z", F.expr(z)).repartitionByRange(*sorts).sortWithinPartitions(*sorts)
        # numbers along the sorted partitions, then places inside the cell: no task holds a whole cell
        cut = materialize(cut.select(*cols, F.monotonically_increasing_id().alias(f"{p}at")))
        spans = cut.groupBy(*self.key, F.expr(f"shiftright({p}at, 33)").alias("part")).agg(
            F.min(f"{p}at").alias("low"), F.count(F.lit(1)).alias("rows"))
        before = (f"coalesce(sum(rows) over (partition by {', '.join(self.key)} order by part "
                  "rows between unbounded preceding and 1 preceding), 0L)")
        spans = self.named(spans.selectExpr(*[f"{c} AS k{i}" for i, c in enumerate(self.key)], f"part AS {p}part",
                                            f"low - {before} AS {p}low"))
        cut = cut.join(spans, F.expr(f"{self.on_cell()} AND shiftright({p}at, 33) = {p}part")).selectExpr(
            *cols, f"({p}at - {p}low) div {full_cell} AS {p}run")
        rows = rows.where(f"{p}n <= {full_cell}").selectExpr(*cols, f"0L AS {p}run").unionByName(cut)
        box = [F.min(self.env[0]).alias(f"{p}x0"), F.min(self.env[1]).alias(f"{p}y0"),
               F.max(self.env[2]).alias(f"{p}x1"), F.max(self.env[3]).alias(f"{p}y1")]
        table = self.named(rows.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(self.key)], f"{p}run").agg(*box))
        return rows, table

    def box(self) -> Env:
        return f"{self.p}x0", f"{self.p}y0", f"{self.p}x1", f"{self.p}y1"

    def with_partners(self, rows: DataFrame, pairs: DataFrame, other: "_Side") -> DataFrame:
        """Every row once for each run of the other side whose box it meets; the column ``run`` with the prefix of the other
        side says which."""
        names = {f"{other.p}run": f"{self.p}other"}
        met = rows.join(pairs.withColumnRenamed(f"{self.p}run", f"{self.p}own_run").withColumnsRenamed(names),
                        F.expr(f"{self.on_cell()} AND {self.p}run = {self.p}own_run"))
        return met.where(bbox_overlaps_sql(self.env, other.box())).select(*rows.columns, f"{self.p}other")


def join_inputs(left: DataFrame, right: DataFrame, left_env: Env, right_env: Env, on: list[tuple[str, str]] | None = None,
                full_cell: int | None = None, each_once: str | None = None) -> list[tuple[DataFrame, DataFrame, Column]]:
    """The equi-joins whose results together are ``grid_join``: (left rows, right rows, condition) each. Empty when a side is."""
    on = on or []
    left = left.where(f"{left_env[0]} IS NOT NULL").selectExpr("*", f"{own_level_sql(left_env)} AS _gl_own")
    right = right.where(f"{right_env[0]} IS NOT NULL").selectExpr("*", f"{own_level_sql(right_env)} AS _gr_own")
    known_l = _Levels(left, "_gl_own", left_env)
    known_r = known_l if each_once else _Levels(right, "_gr_own", right_env)
    if not known_l.n_rows or not known_r.n_rows:
        return []

    def replicate(df: DataFrame, own: str, other: _Levels, strict: bool, p: str, env: Env) -> DataFrame:
        levels = df.selectExpr("*", f"explode({other.met_sql(own, env, strict)}) AS _rep")
        return _explode_cells(levels, env, "_rep", p)

    lon, ron = [a for a, _ in on], [b for _, b in on]
    branches = [
        # pairs matched at the left feature's own level: level_right <= level_left
        (_Side(_explode_cells(left, left_env, "_gl_own", "_gl_"), "_gl_", left_env, lon),
         _Side(replicate(right, "_gr_own", known_l, False, "_gr_", right_env), "_gr_", right_env, ron)),
        # pairs matched at the right feature's own level: level_left < level_right
        (_Side(replicate(left, "_gl_own", known_r, True, "_gl_", left_env), "_gl_", left_env, lon),
         _Side(_explode_cells(right, right_env, "_gr_own", "_gr_"), "_gr_", right_env, ron))]
    if each_once:
        branches = branches[:1]
    same = " AND ".join([f"{a} = {b}" for a, b in zip(branches[0][0].key, branches[0][1].key)])
    # a side's estimated size knows nothing of the cells its features are copied to; its counted rows do
    sized = as_large if min(known_l.n_rows, known_r.n_rows) > SMALL_SIDE else lambda df: df
    rx, ry = f"greatest({left_env[0]}, {right_env[0]})", f"greatest({left_env[1]}, {right_env[1]})"
    ref = f"{_cell_sql(rx, '_gl_lvl')} = _gl_ix AND {_cell_sql(ry, '_gl_lvl')} = _gl_iy"
    cond = f"{same} AND {bbox_overlaps_sql(left_env, right_env)} AND {ref}"
    if each_once:
        cond += f" AND (_gl_own > _gr_own OR (_gl_own = _gr_own AND {each_once}))"

    full, n_most = None, max(known_l.n_rows, known_r.n_rows)
    if full_cell is None:
        share = n_most // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        full_cell = min(max(share, FEW_ROWS), FULL_CELL)
    # a cell holds a feature once, so a cell of a side with few rows can't be too full
    if n_most > full_cell:
        parts = [x for i, (a, b) in enumerate(branches) for x in (a.histogram(i, "nl", "nr"), b.histogram(i, "nr", "nl"))]
        rows = reduce(DataFrame.unionByName, parts)
        # cells are told apart by a hash: two that share one are both cut, which changes no result
        full = materialize(rows.groupBy("branch", "cell").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
                           .where(f"nl > 0 AND nr > 0 AND greatest(nl, nr) > {full_cell}"))
        if full.isEmpty():
            full = None
    if full is None:
        return [(a.rows, sized(b.rows), F.expr(cond)) for a, b in branches]
    out = []
    for i, (a, b) in enumerate(branches):
        cells = full.where(f"branch = {i}").drop("branch")
        rest_a, rest_b = (x.rows.join(cells.selectExpr(f"cell AS {x.p}cell"), F.expr(f"{x.cell_hash()} = {x.p}cell"), "left_anti")
                          for x in (a, b))
        out.append((rest_a, sized(rest_b), F.expr(cond)))
        rows_a, runs_a = a.runs(cells, "nl", full_cell)
        rows_b, runs_b = b.runs(cells, "nr", full_cell)
        meet = " AND ".join([f"{a.p}k{j} = {b.p}k{j}" for j in range(len(a.key))] + [bbox_overlaps_sql(a.box(), b.box())])
        pairs = materialize(runs_a.join(runs_b, F.expr(meet)))
        out.append((a.with_partners(rows_a, pairs, b), sized(b.with_partners(rows_b, pairs, a)),
                    F.expr(f"{cond} AND _gl_run = _gr_other AND _gr_run = _gl_other")))
    return out


def grid_join(left: DataFrame, right: DataFrame, left_env: Env, right_env: Env,
              on: list[tuple[str, str]] | None = None, full_cell: int | None = None, each_once: str | None = None) -> DataFrame:
    """All (left, right) row pairs whose envelopes intersect (closed) and whose ``on`` columns are equal.

    Column names of the two inputs must be distinct (prefix them first). Rows with a NULL envelope never match.
    Returns the columns of both inputs. ``full_cell`` is the number of rows of a side that a join key may hold: by default the
    larger side's share of a shuffle partition, within bounds. For a table joined with itself ``each_once``, a condition that holds
    for (a, b) or (b, a) but not both, gives every pair of different rows once, in either order.
    """
    cols = [*left.columns, *right.columns]
    parts = [a.join(b, cond).select(*cols)
             for a, b, cond in join_inputs(left, right, left_env, right_env, on, full_cell, each_once)]
    if not parts:
        # one side is empty: so is the result (an empty table of the combined schema, no join planned)
        return left.sparkSession.createDataFrame([], StructType([*left.schema.fields, *right.schema.fields]))
    return reduce(DataFrame.unionByName, parts)


def plain_join(left: DataFrame, right: DataFrame, left_env: Env, right_env: Env, on: list[tuple[str, str]],
               how: str = "inner") -> DataFrame:
    """The literal candidate join: equi columns plus the box test as a residual condition, a nested loop within each
    key. Only meant for checking ``grid_join`` on small inputs; without equi columns it is refused."""
    if not on:
        raise ValueError("plain_join needs at least one pair of equal columns")
    cond = " AND ".join([bbox_overlaps_sql(left_env, right_env)] + [f"{lc} = {rc}" for lc, rc in on])
    return left.join(right, F.expr(cond), how)


def prefixed(df: DataFrame, p: str, cols: list[str] | None = None) -> DataFrame:
    return df.selectExpr(*[f"`{c}` AS `{p}{c}`" for c in (cols or df.columns)])
