"""Signs that rounding cannot change, as Spark SQL expression text.

The side of a line on which a point lies is the sign of a difference of two products. Evaluated in doubles it is trusted
only if it is larger than a bound of its own rounding error. Else, if the differences are exact, the two products are compared with
their errors; else the sum is evaluated without error: every product is written
as the sum of two doubles, and the parts are added up as an expansion, a list of doubles that don't overlap, whose last one that
isn't zero has the sign of the whole. Products of coordinates must not leave the range of normal doubles.
"""

from __future__ import annotations

EPSILON = 2.0 ** -53
ORIENT_BOUND = (3.0 + 16.0 * EPSILON) * EPSILON
SPLITTER = float(2 ** 27 + 1)


def _in(v: str, name: str, body: str) -> str:
    return f"transform(array({v}), {name} -> {body})[0]"


def _product_parts(f: str) -> str:
    """array(error, product) of a struct of x, y and a sign s: their sum is s * x * y exactly. Each factor is split into two halves
    of 26 bits."""
    halves = lambda v: (f"transform(array({SPLITTER!r}D * {v}), c -> named_struct('h', c - (c - {v}), "  # noqa: E731
                        f"'l', {v} - (c - (c - {v}))))[0]")
    error = "(g.p.l * g.q.l - (((g.xy - g.p.h * g.q.h) - g.p.l * g.q.h) - g.p.h * g.q.l))"
    return _in(f"named_struct('xy', {f}.x * {f}.y, 'p', {halves(f'{f}.x')}, 'q', {halves(f'{f}.y')}, 's', {f}.s)", "g",
               f"array(g.s * {error}, g.s * g.xy)")


def sum_sign_sql(terms: str) -> str:
    """Sign (-1, 0 or 1) of the exact sum of an array of doubles."""
    two_sum = ("named_struct('q', s.q + x, 'h', concat(s.h, array((s.q - ((s.q + x) - ((s.q + x) - s.q))) "
               "+ (x - ((s.q + x) - s.q)))))")
    grow = (f"aggregate(e, named_struct('q', t, 'h', cast(array() as array<double>)), (s, x) -> {two_sum}, "
            "s -> concat(s.h, array(s.q)))")
    expansion = f"aggregate({terms}, cast(array() as array<double>), (e, t) -> {grow})"
    return f"cast(sign(coalesce(try_element_at(filter({expansion}, v -> v <> 0D), -1), 0D)) as int)"


def quick_orient_sign_sql(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """``orient_sign_sql`` in plain doubles; NULL where rounding might change it."""
    left, right = f"(({ax} - {cx}) * ({by} - {cy}))", f"(({ay} - {cy}) * ({bx} - {cx}))"
    return (f"CASE WHEN abs({left} - {right}) >= {ORIENT_BOUND!r}D * (abs({left}) + abs({right})) "
            f"THEN CAST(sign({left} - {right}) AS INT) END")


def _by_differences_sql(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """The sign from two products, if the differences in them are exact (as between points of one grid); else NULL. Products that
    round to different doubles lie as these do, and of others the errors tell."""
    d = {n: f"({v} - {w})" for n, v, w in (("p", ax, cx), ("q", by, cy), ("r", ay, cy), ("s", bx, cx))}
    lost = lambda v, w, x: f"(({v} - ({x} + ({v} - {x}))) + (({v} - {x}) - {w}))"
    whole = " AND ".join(f"{lost(v, w, f'd.{n}')} = 0D" for n, v, w in (("p", ax, cx), ("q", by, cy), ("r", ay, cy), ("s", bx, cx)))
    factors = ", ".join(f"named_struct('x', d.{x}, 'y', d.{y}, 's', 1D)" for x, y in ("pq", "rs"))
    signs = _in(f"transform(array({factors}), f -> {_product_parts('f')})", "m",
                "IF(m[0][1] <> m[1][1], sign(m[0][1] - m[1][1]), sign(m[0][0] - m[1][0]))")
    return _in("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in d.items()) + ")", "d", f"CASE WHEN {whole} THEN CAST({signs} AS INT) END")


def slow_orient_sign_sql(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """``orient_sign_sql`` for the few that plain doubles can't decide. 0 if a coordinate is NULL."""
    # a x b - a x c - c x b, without rounding; the expression of a product is there once, not six times
    products = [(ax, by, 1), (ax, cy, -1), (cx, by, -1), (ay, bx, -1), (ay, cx, 1), (cy, bx, 1)]
    factors = ", ".join(f"named_struct('x', {x}, 'y', {y}, 's', {float(s)!r}D)" for x, y, s in products)
    exact = sum_sign_sql(f"flatten(transform(array({factors}), f -> {_product_parts('f')}))")
    at = (ax, ay, bx, by, cx, cy)
    return f"CASE WHEN {' + '.join(at)} IS NULL THEN 0 ELSE coalesce({_by_differences_sql(*at)}, {exact}) END"


def orient_sign_sql(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    """1 if c lies to the left of the line from a to b, -1 to its right, 0 on it. Exact."""
    at = (ax, ay, bx, by, cx, cy)
    return f"coalesce({quick_orient_sign_sql(*at)}, {slow_orient_sign_sql(*at)})"


def with_orient_signs(df, signs: dict[str, tuple[str, str, str, str, str, str]]):
    """``df`` with columns of orient signs by name, each evaluated once. Plain doubles come first, in generated code; the exact
    expression is there once for all signs, and looked at only where one of them is open. (What contains such an expression
    is interpreted, and a task spends seconds on a plan that has it many times.)"""
    quick = ", ".join(f"'_q{i}', {quick_orient_sign_sql(*at)}" for i, at in enumerate(signs.values()))
    names = [f"_q{i}" for i in range(len(signs))]
    points = ", ".join(f"named_struct('q', _q{i}, " + ", ".join(f"'{n}', CAST({v} AS DOUBLE)" for n, v in zip("abcdef", at)) + ")"
                       for i, at in enumerate(signs.values()))
    slow = slow_orient_sign_sql(*[f"t.{n}" for n in "abcdef"])
    # the outputs of generators: filters stay above them
    df = df.selectExpr("*", f"inline(array(named_struct({quick})))")
    df = df.selectExpr("*", f"explode(array(IF({' + '.join(names)} IS NOT NULL, array({', '.join(names)}), "
                       f"transform(array({points}), t -> coalesce(t.q, {slow}))))) AS _signs")
    return df.selectExpr("*", *[f"_signs[{i}] AS {n}" for i, n in enumerate(signs)]).drop("_signs", *names)
