"""WKT text tables: ``wkt \\t oid \\t tags`` lines, no header.

Parsing is plain Catalyst work: each coordinate tuple becomes a JSON array of strings, parentheses become brackets,
and ``from_json`` reads a fixed four-level nesting (parts / rings / points / ordinates). Text that does not parse
yields NULL, which routes the line to the rejects table with a reason instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geotables.functions.shapes import let_sql
from geotables.model import finish_features
from geotables.operators.rebuild import rebuilt_features
from geotables.operators.rings import close_rings_sql, orient_rings_sql, split_valid

TYPES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
# lines whose geometry field names none of these (case-sensitive) are skipped, as the literal reader does
GEOMETRY_LINE = "POLYGON|LINESTRING|POINT"

_NUM = r"[^\\s,()]+"
_BODY_JSON = (f"translate(regexp_replace(body, '({_NUM})\\\\s+({_NUM})(\\\\s+{_NUM})*', '[\"$1\",\"$2\"]'), "
              f"'()', '[]')")
# depth prefix/suffix that brings every type to parts / rings / points / ordinates
_WRAP_OPEN = """CASE
  WHEN gtype IN ('POINT', 'LINESTRING') THEN '[['
  WHEN gtype IN ('POLYGON', 'MULTILINESTRING') THEN '['
  WHEN gtype = 'MULTIPOINT' AND body RLIKE '^\\\\(\\\\s*\\\\(' THEN '['
  WHEN gtype = 'MULTIPOINT' THEN '[['
  ELSE '' END"""
_PARSED_T = "array<array<array<array<string>>>>"
_RINGS = """flatten(transform(parsed, (prt, pi) -> transform(prt, (rg, ri) -> named_struct(
    'part', CAST(pi AS INT), 'ring', CAST(ri AS INT),
    'pts', transform(rg, c -> named_struct('x', try_cast(c[0] AS DOUBLE), 'y', try_cast(c[1] AS DOUBLE)))))))"""
_EMPTY_RINGS = "CAST(array() AS array<struct<part:int,ring:int,pts:array<struct<x:double,y:double>>>>)"


def split_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(line, wkt, oid, tags, n_fields) from raw text lines; keeps only geometry lines."""
    f = lines.selectExpr(f"inline(array(named_struct('line', {col}, 'f', split({col}, '\\t', -1))))")
    f = f.selectExpr("line", "f[0] AS wkt", "try_element_at(f, 2) AS oid", "try_element_at(f, 3) AS tags",
                     "size(f) AS n_fields")
    return f.where(f"wkt RLIKE '{GEOMETRY_LINE}'")


COLLECTION = "GEOMETRYCOLLECTION"
# text of a collection that doesn't close as it opens: what the parser calls malformed
BROKEN = "POINT ("


def split_collections(lines: DataFrame) -> DataFrame:
    """The rows of ``split_lines`` with each geometry collection replaced by its members, one row each, whose oid is that of the
    collection, ``#`` and the place of the member. Collections may nest to any depth: a comma followed by a letter separates
    members wherever it stands, and the number of collections open after each member says whether the text is whole. Empty
    collections have no members; a line that has none at all keeps its row."""
    count = lambda v, c: f"(length({v}) - length(replace({v}, '{c}', '')))"
    opened = f"size(split(m, '{COLLECTION}\\\\s*\\\\(')) - 1"
    body = f"regexp_replace(m, '{COLLECTION}(\\\\s*\\\\(\\\\s*|\\\\s+EMPTY)', '')"
    members = f"transform(split(wkt, ',\\\\s*(?=[A-Z])'), m -> named_struct('opened', {opened}, 'body', {body}))"
    # a member ends with the brackets it opened itself; those beyond close collections
    core = "trim(trailing ' )' from t.body)"
    own = f"({count(core, '(')} - {count(core, ')')})"
    told = (f"transform({members}, t -> named_struct('open', t.opened - ({count('t.body', ')')} - {count('t.body', '(')}), "
            f"'text', IF({own} < 0, '{BROKEN}', concat({core}, repeat(')', greatest({own}, 0))))))")
    depth = "aggregate(slice(ts, 1, i + 1), 0, (s, t) -> s + t.open)"
    whole = f"forall(transform(ts, (t, i) -> IF(i = size(ts) - 1, {depth} = 0, {depth} > 0)), ok -> ok)"
    kept = "filter(ts, t -> t.text <> '')"
    parts = (f"CASE WHEN NOT ({whole}) THEN array(named_struct('oid', oid, 'wkt', '{BROKEN}')) "
             f"WHEN size({kept}) = 0 THEN array(named_struct('oid', oid, 'wkt', wkt)) "
             f"ELSE transform({kept}, (t, i) -> named_struct('oid', concat(oid, '#', i + 1), 'wkt', t.text)) END")
    rows = f"IF(wkt RLIKE '^\\\\s*{COLLECTION}', {let_sql(told, 'ts', parts)}, array(named_struct('oid', oid, 'wkt', wkt)))"
    return lines.selectExpr("line", "tags", "n_fields", f"inline({rows}) AS (oid, wkt)").select("line", "wkt", "oid", "tags", "n_fields")


def parse_wkt(df: DataFrame, wkt: str = "wkt", repair: bool = False) -> DataFrame:
    """Add gtype, rings (oriented shell-CCW / hole-CW) and ``reason`` (NULL when the geometry is acceptable). ``repair``
    drops repeated points of polygon rings and closes them before they are judged."""
    d = df.selectExpr("*", f"regexp_extract({wkt}, '^\\\\s*([A-Z]+)', 1) AS gtype",
                      f"trim(regexp_replace({wkt}, '^\\\\s*[A-Za-z]+', '')) AS body")
    wrapped = f"concat({_WRAP_OPEN}, {_BODY_JSON}, reverse(translate({_WRAP_OPEN}, '[', ']')))"
    allowed = ", ".join(f"'{t}'" for t in TYPES)
    polygonal = "gtype LIKE '%POLYGON'"
    reason = f"""CASE
      WHEN gtype NOT IN ({allowed}) THEN 'unsupported geometry type'
      WHEN parsed IS NULL THEN 'malformed WKT'
      WHEN exists(flatten(flatten(parsed)), c -> size(c) < 2 OR try_cast(c[0] AS DOUBLE) IS NULL
                                                OR try_cast(c[1] AS DOUBLE) IS NULL) THEN 'bad coordinate'
      WHEN exists(rings0, r -> size(r.pts) = 0) THEN 'empty part'
      WHEN {polygonal} AND exists(rings0, r -> size(r.pts) < 4) THEN 'ring too short'
      WHEN {polygonal} AND exists(rings0, r -> r.pts[0] != r.pts[size(r.pts) - 1]) THEN 'ring not closed'
      WHEN exists(flatten(transform(rings0, r -> r.pts)), p -> p.x < -180D OR p.x > 180D OR p.y < -90D OR p.y > 90D)
        THEN 'coordinates out of range'
      END"""
    closing = f"WHEN {polygonal} THEN {let_sql(_RINGS, 'raw', close_rings_sql('raw'))} " if repair else ""
    result = let_sql(f"CASE WHEN upper(body) = 'EMPTY' THEN array() ELSE from_json({wrapped}, '{_PARSED_T}') END", "parsed",
                  let_sql(f"CASE WHEN parsed IS NULL THEN {_EMPTY_RINGS} {closing}ELSE {_RINGS} END", "rings0",
                       let_sql(reason, "why", "named_struct('reason', why, 'rings', CASE WHEN why IS NULL AND "
                                           f"{polygonal} THEN {orient_rings_sql('rings0')} ELSE rings0 END)")))
    # A generator output is a barrier for filter pushdown: filters on reason (rejects / features) stay above it
    # instead of being copied, with the whole parse, into the scan below.
    keep = [c for c in d.columns if c != "body"]
    return d.selectExpr(*keep, f"inline(array({result}))")


def geometry_line_sql(col: str = "value") -> str:
    """Whether a raw line is a geometry line, the others being skipped."""
    return f"coalesce(split({col}, '\\t', -1)[0] RLIKE '{GEOMETRY_LINE}', false)"


def parsed_lines(lines: DataFrame, col: str = "value", repair: bool = False) -> DataFrame:
    """One row per geometry line or member of a collection: line, oid, tags, gtype, rings, and ``why`` it is rejected, or null."""
    p = parse_wkt(split_collections(split_lines(lines, col)), repair=repair)
    return p.selectExpr("*", "CASE WHEN n_fields < 3 THEN 'missing fields' "
                             "WHEN oid IS NULL OR oid = '' THEN 'missing oid' ELSE reason END AS why")


def ingest_lines(lines: DataFrame, col: str = "value", repair: bool | str = False) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) from raw ``wkt \\t oid \\t tags`` lines.

    features: the canonical table (see ``geotables.model``), members of collections as rows of their own (``split_collections``);
    rejects: (line, oid, reason). ``repair`` mends polygon rings
    (repeated points, missing last point, direction) and rejects those that are invalid all the same; ``repair="rebuild"`` keeps
    these, too, rebuilt by the area rule of ``operators.rebuild``."""
    p = parsed_lines(lines, col, bool(repair))
    # features and rejects are two filters over one parse; a job that needs both should persist ``p`` first
    features = finish_features(p.where("why IS NULL").select("oid", "tags", "gtype", "rings"))
    rejects = p.where("why IS NOT NULL").selectExpr("line", "oid", "why AS reason")
    if repair:
        whole = finish_features(p.where("why IS NULL").select("oid", "tags", "gtype", "rings", "line"))
        good, bad = split_valid(whole)
        if repair == "rebuild":
            made, bad = rebuilt_features(bad)
            good = good.unionByName(made.select(*good.columns))
        return good.drop("line"), rejects.unionByName(bad.select("line", "oid", "reason"))
    return features, rejects


def read_wkt_table(spark: SparkSession, path: str, num_partitions: int | None = None,
                   repair: bool | str = False) -> tuple[DataFrame, DataFrame]:
    """Read WKT text files. ``num_partitions`` spreads the lines round-robin before parsing; ``repair`` as in
    ``ingest_lines``."""
    lines = spark.read.text(path)
    if num_partitions:
        lines = lines.repartition(num_partitions)
    return ingest_lines(lines, repair=repair)


def fmt_num_sql(v: str) -> str:
    """Coordinate text: whole numbers without a fraction ('111'), others as the shortest round-trip decimal."""
    return (f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15D THEN CAST(CAST({v} AS BIGINT) AS STRING) "
            f"ELSE CAST({v} AS STRING) END")


def _pts_text(pts: str) -> str:
    return f"array_join(transform({pts}, p -> concat({fmt_num_sql('p.x')}, ' ', {fmt_num_sql('p.y')})), ', ')"


def wkt_sql(gtype: str = "gtype", rings: str = "rings") -> str:
    """WKT text of a geometry column."""
    return let_sql(rings, "rs", _wkt_body(gtype, "rs"))


def _wkt_body(gtype: str, rings: str) -> str:
    ring_t = f"transform({rings}, r -> concat('(', {_pts_text('r.pts')}, ')'))"
    all_pts = f"flatten(transform({rings}, r -> r.pts))"
    parts = (f"transform(sequence(0, array_max(transform({rings}, r -> r.part))), pp -> concat('(', array_join("
             f"transform(filter({rings}, r -> r.part = pp), r -> concat('(', {_pts_text('r.pts')}, ')')), ', '), ')'))")
    return f"""CASE
      WHEN size({all_pts}) = 0 THEN concat({gtype}, ' EMPTY')
      WHEN {gtype} = 'POINT' THEN concat('POINT (', {_pts_text(all_pts)}, ')')
      WHEN {gtype} = 'LINESTRING' THEN concat('LINESTRING (', {_pts_text(all_pts)}, ')')
      WHEN {gtype} = 'MULTIPOINT' THEN concat('MULTIPOINT (', array_join(transform({all_pts},
           p -> concat('(', {fmt_num_sql('p.x')}, ' ', {fmt_num_sql('p.y')}, ')')), ', '), ')')
      WHEN {gtype} IN ('POLYGON', 'MULTILINESTRING') THEN concat({gtype}, ' (', array_join({ring_t}, ', '), ')')
      ELSE concat('MULTIPOLYGON (', array_join({parts}, ', '), ')') END"""


def export_wkt(df: DataFrame) -> DataFrame:
    """(oid, wkt) for a feature table."""
    return df.selectExpr("oid", f"{wkt_sql()} AS wkt")


def to_text_lines(df: DataFrame) -> DataFrame:
    """One ``wkt \\t oid \\t tags`` line per feature (column ``value``), the format ``read_wkt_table`` reads."""
    return df.selectExpr(f"concat_ws('\\t', {wkt_sql()}, oid, coalesce(tags, '{{}}')) AS value")


def write_wkt_table(df: DataFrame, path: str) -> None:
    to_text_lines(df).write.mode("overwrite").text(path)
