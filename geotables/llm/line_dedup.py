"""Line deduplication by a segment-partition edit join [native]: DataFrame and SQL functions only.

A line of at least ``min_chars`` characters is removed if an equal line, or one within ``threshold`` single-character
edits, first occurs earlier; occurrences are ordered by (doc_id, line number), judged on the input. Shorter lines stay.

* Distinct lines. Lines are grouped by two hashes; each keeps its first occurrence, its length, counts of 16 letters, and
  the hashes below. Text does not move here.
* Index. Lines fall into length classes of ``CLASS`` characters, which fix threshold + 1 disjoint segments: the first half
  of them counted from the start of the line, the others from its end. Two lines within the threshold agree in one segment
  whose place differs by no more edits than segments stand before it (or behind it, if counted from the end), so a line is
  stored under its own segments and probes its substrings at those few shifts, for its own length class and for the
  next one if that is within the threshold.
* Probing is an equi-join on (class, segment, hash) that Spark splits where a key is hot. Pairs whose lengths or letter
  counts already need more edits are dropped in the join condition; the earlier line of a pair is the stored one.
* Verification. The texts of the lines left are fetched, common ends are cut off, and the rest is run through a banded
  bit-parallel automaton: for each number of edits, one integer has a bit for each diagonal of the band of width
  2 * threshold + 1, and a step per character moves all diagonals at once by shifts and masks.
* Removed line numbers go back to their documents; kept lines are joined by line feeds.

Defined results: null text stays null and has no lines; empty text is one short line; null ids order as if larger than all
others; rows that repeat an id are ordered by a hash of their text, and equal rows don't remove each other's lines; extra
columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import written

NO_ID = (1 << 63) - 1
CLASS = 16
#: Letters that are counted: the space and letters common in European languages.
LETTERS = " entorashlidumcg"
LINES = r"split(text, '\n')"


def segment_sql(threshold: int, line: str, n: str, cls: str) -> list[tuple[int, int, str]]:
    """(segment, shift, substring) of a line for the length class ``cls``; shift 0 is what a line is stored under."""
    parts = threshold + 1
    size = f"cast(floor(({CLASS} * {cls} - {threshold}) / {parts}) as int)"
    out = []
    for i in range(parts):
        before, behind = i, threshold - i
        if before <= behind:
            begin = f"{i} * {size}"
        else:
            begin = f"{n} - {parts - i} * {size}"
        for shift in range(-min(before, behind), min(before, behind) + 1):
            out.append((i, shift, f"substring({line}, cast({begin} + {shift} + 1 as int), {size})"))
    return out


def keys_sql(threshold: int, cls: str) -> str:
    """Hashes of the segments for a class, in the order of segment_sql."""
    hashes = [f"xxhash64({cls}, {i}, {text})" for i, _, text in segment_sql(threshold, "line", "n", cls)]
    return f"array({', '.join(hashes)})"


def distance_at_least_sql(a: str, b: str) -> str:
    """Twice a lower bound of the edit distance from lengths (n) and letter counts (letters, four bits each)."""
    terms = []
    for i in range(len(LETTERS)):
        d = f"abs((shiftrightunsigned({a}.letters, {4 * i}) & 15) - (shiftrightunsigned({b}.letters, {4 * i}) & 15))"
        terms.append(f"least({d}, 16 - {d})")
    return f"abs({a}.n - {b}.n) + {' + '.join(terms)}"


def common_prefix_sql(a: str, b: str, limit: str) -> str:
    """Characters of the common beginning of two UTF-32 binaries, found by halving steps."""
    steps = ", ".join(str(1 << k) for k in range(29, -1, -1))
    return (f"aggregate(filter(array({steps}), s -> s <= {limit}), 0, (k, s) -> if(k + s <= {limit} and "
            f"substring({a}, 4 * k + 1, 4 * s) = substring({b}, 4 * k + 1, 4 * s), k + s, k))")


def common_suffix_sql(a: str, b: str, n_a: str, n_b: str, limit: str) -> str:
    steps = ", ".join(str(1 << k) for k in range(29, -1, -1))
    return (f"aggregate(filter(array({steps}), s -> s <= {limit}), 0, (k, s) -> if(k + s <= {limit} and "
            f"substring({a}, 4 * ({n_a} - k - s) + 1, 4 * s) = substring({b}, 4 * ({n_b} - k - s) + 1, 4 * s), k + s, k))")


def symbols_sql(text: str, n: str) -> str:
    """The characters of a UTF-32 binary as an array."""
    return f"transform(sequence(0, {n} - 1), i -> substring({text}, 4 * i + 1, 4))"


def matches_sql(threshold: int, a: str, b: str) -> str:
    """Per character of the array ``a``, an integer with bit k set if ``b`` has the same character on diagonal
    k - threshold of the band; ``b`` is padded by ``threshold`` impossible characters on both sides."""
    width = 2 * threshold + 1
    return (f"transform({a}, (x, i) -> " + " | ".join(f"if(coalesce(get({b}, i + {k}) = x, false), {1 << k}, 0)"
                                                       for k in range(width)) + ")")


def within_sql(threshold: int, matches: str, n_a: str, n_b: str) -> str:
    """Whether two texts are within the threshold, from the match integers of ``a``: the bit-parallel automaton. Its state
    is one integer with a field of 2 * threshold + 1 bits for each number of edits e; bit k of field e is set if the
    characters of a read so far and those of b up to diagonal k - threshold from there can be matched with e edits. One
    step: a match stays on its diagonal, a substitution too, a character of a left out goes one diagonal down; a character of
    b put in goes one up in the new field."""
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    field = lambda e: f"(shiftright(r, {width * e}) & {full})"
    start = sum((sum(1 << (t + k) for k in range(e + 1)) & full) << (width * e) for e in range(t + 1))
    new = [f"({field(0)} & m)"]
    for e in range(1, t + 1):
        new.append(f"((({field(e)} & m) | {field(e - 1)} | shiftright({field(e - 1)}, 1) | shiftleft({new[-1]}, 1)) & {full})")
    step = " | ".join(f"shiftleft({x}, {width * e})" for e, x in enumerate(new))
    one = "cast(1 as bigint)" if width * (t + 1) > 31 else "1"
    run = (f"aggregate({matches}, {start} * {one}, (r, m) -> {step}, "
           f"r -> (shiftright(r, {width * t} + {n_b} - {n_a} + {t}) & 1) = 1)")
    return f"if(abs({n_a} - {n_b}) > {t}, false, {run})"


def interior_sql(a: str, b: str, n_a: str, n_b: str) -> str:
    """For a threshold of two: texts without common ends that are within it need an edit at either end, so what lies between
    must agree, one character further or less at most."""
    return (f"{n_a} < 4 or {n_b} < 4 or " + " or ".join(
        f"substring({a}, {4 * x + 1}, 4 * ({n_a} - {x} - {u})) = substring({b}, {4 * y + 1}, 4 * ({n_b} - {y} - {v}))"
        for x, y in ((1, 1), (1, 0), (0, 1)) for u, v in ((1, 1), (1, 0), (0, 1))))


def verified(pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose texts ``line_a`` and ``line_b`` are within the threshold; both columns go."""
    others = [c for c in pairs.columns if c not in ("line_a", "line_b")]

    def put(df: DataFrame, keep: list[str], **columns: str) -> DataFrame:
        """Adds columns behind a generator, so that Catalyst can't copy their expressions to every place of their use."""
        fields = ", ".join(f"'{n}', {e}" for n, e in columns.items())
        return df.selectExpr(*keep, f"inline(array(named_struct({fields})))")

    p = put(pairs, others, ta="encode(line_a, 'UTF-32')", tb="encode(line_b, 'UTF-32')")
    p = put(p, ["*"], na="cast(octet_length(ta) / 4 as int)", nb="cast(octet_length(tb) / 4 as int)")
    p = put(p, ["*"], head=common_prefix_sql("ta", "tb", "least(na, nb)"))
    p = put(p, ["*"], room="least(na, nb) - head")
    p = put(p, ["*"], tail=common_suffix_sql("ta", "tb", "na", "nb", "room"))
    p = put(p, others, ta="substring(ta, 4 * head + 1, 4 * (na - head - tail))", na="na - head - tail",
            tb="substring(tb, 4 * head + 1, 4 * (nb - head - tail))", nb="nb - head - tail")
    p = p.where(f"abs(na - nb) <= {threshold}")
    if threshold <= 2:
        p = p.where(interior_sql("ta", "tb", "na", "nb"))
    pad = f"array_repeat(unhex('FFFFFFFF'), {threshold})"
    empty = "cast(array() as array<binary>)"
    p = put(p, [*others, "na", "nb"], sa=f"if(na = 0, {empty}, {symbols_sql('ta', 'na')})",
            sb=f"concat({pad}, if(nb = 0, {empty}, {symbols_sql('tb', 'nb')}), {pad})")
    p = put(p, [*others, "na", "nb"], matches=matches_sql(threshold, "sa", "sb"))
    return put(p, others, near=within_sql(threshold, "matches", "na", "nb")).where("near").select(*others)


def _with_place(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(f"coalesce(cast(doc_id as bigint), {NO_ID}) as doc", "xxhash64(text) as mark", "text")


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """doc, mark, pos, line, n, h1, h2 of the lines that take part."""
    lines = rows.selectExpr("doc", "mark", f"posexplode({LINES}) as (pos, line)")
    lines = lines.selectExpr("*", "char_length(line) as n").where(f"n >= {min_chars}")
    return lines.selectExpr("*", "xxhash64(line) as h1", "hash(line) as h2")


def distinct_lines(rows: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """h1, h2, copies, first struct<doc, pos, mark>, n, letters, keys, next_keys, cls, next_cls."""
    # the letters are single bytes: sizes in bytes are known, while characters have to be counted each time
    letters = " | ".join(f"shiftleft(cast((octet_length(line) - octet_length(replace(line, '{c}', ''))) & 15 as bigint), {4 * i})"
                         for i, c in enumerate(LETTERS))
    cls = f"cast(floor(n / {CLASS}) as int)"
    lines = _lines(rows, min_chars).selectExpr(
        "*", f"{letters} as letters", f"{cls} as cls",
        # the class beyond the nearer edge of the own class, if the threshold reaches it
        f"case when n % {CLASS} < {threshold} then {cls} - 1 when n % {CLASS} >= {CLASS - threshold} then {cls} + 1 end"
        " as next_cls")
    packed = lines.selectExpr(
        "h1", "h2", "struct(doc, pos, mark, n, letters, cls, next_cls, "
        f"{keys_sql(threshold, 'cls')} as keys, if(next_cls is null, null, {keys_sql(threshold, 'next_cls')}) as next_keys) as x")
    grouped = packed.groupBy("h1", "h2").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("copies"))
    return grouped.selectExpr("h1", "h2", "copies", "struct(x.doc, x.pos, x.mark) as first", "x.n", "x.letters", "x.keys",
                              "x.next_keys")


def candidates(distinct: DataFrame, threshold: int) -> DataFrame:
    """(a, b) structs (doc, pos, h1) of lines: pairs that share a segment and may be within the threshold; a is the earlier.
    Only what the join condition reads travels with the keys."""
    places = segment_sql(threshold, "line", "n", "cls")
    stored = ", ".join(f"keys[{j}]" for j, (_, shift, _) in enumerate(places) if shift == 0)
    line = ["first.doc", "first.pos", "h1", "n", "letters"]
    held = distinct.selectExpr(*line, f"explode(array({stored})) as key")
    asked = distinct.selectExpr(*line, "explode(if(next_keys is null, keys, concat(keys, next_keys))) as key")
    pairs = held.alias("a").join(asked.alias("b"), F.expr(
        "a.key = b.key and (a.doc < b.doc or (a.doc = b.doc and (a.pos < b.pos or (a.pos = b.pos and a.h1 < b.h1)))) and "
        f"({distance_at_least_sql('a', 'b')}) <= {2 * threshold}"))
    return pairs.selectExpr("struct(a.doc, a.pos, a.h1) as a", "struct(b.doc, b.pos, b.h1) as b").distinct()


def line_links(docs: DataFrame, threshold: int = 2, min_chars: int = 32) -> tuple[DataFrame, DataFrame]:
    """The distinct lines (h1, h2, copies, first) and the links between them (a, b: structs doc, pos, h1; a earlier)."""
    rows = _with_place(docs)
    distinct = written(distinct_lines(rows, threshold, min_chars), "distinct-lines")
    pairs = written(candidates(distinct, threshold), "line-candidates")
    ends = pairs.selectExpr("explode(array(a, b)) as line").distinct()
    wanted = ends.groupBy(F.col("line.doc").alias("doc")).agg(F.collect_list("line").alias("wanted"))
    # the same join at every size: the list of documents grows with the table and is never broadcast
    found = rows.select("doc", "text").hint("merge").join(wanted, "doc").selectExpr(
        f"explode(transform(array({LINES}), ls -> transform(wanted, w -> struct(w as line, get(ls, w.pos) as text)))[0]) as x")
    texts = found.selectExpr("x.line", "x.text").where("xxhash64(text) = line.h1").dropDuplicates(["line"])
    both = (pairs.join(texts.selectExpr("line as a", "text as line_a"), "a")
            .join(texts.selectExpr("line as b", "text as line_b"), "b"))
    # few bytes, much work: spread over all cores whatever the size of the shuffles says
    both = both.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    return distinct.select("h1", "h2", "copies", "first"), written(verified(both, threshold), "line-links")


def dedup_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 32) -> DataFrame:
    """``docs`` with text replaced by its kept lines, and n_lines, n_removed, n_near (removed for a line that is near but not
    equal), n_links (links of the document's lines to other distinct lines)."""
    distinct, links = line_links(docs, threshold, min_chars)
    rows = _with_place(docs)
    ends = links.selectExpr("explode(array(struct(b as line, a as other), struct(a as line, b as other))) as x")
    linked = ends.groupBy("x.line").agg(F.min("x.other").alias("nearest"), F.count(F.lit(1)).alias("degree"))
    info = distinct.withColumn("line", F.expr("struct(first.doc, first.pos, h1)")).join(linked, "line", "left").where(
        "copies > 1 or degree > 0").selectExpr("h1", "h2", "first", "line", "nearest", "coalesce(degree, 0) as degree")
    info = written(info, "line-info")
    held = _lines(rows, min_chars).select("doc", "mark", "pos", "h1", "h2").join(info, ["h1", "h2"])
    held = held.selectExpr("doc", "mark", "pos", "degree", "first < struct(doc, pos, mark) as copy",
                           "coalesce(nearest < struct(doc, pos, h1), false) as near")
    per_doc = held.selectExpr("doc", "mark", "pos", "if(copy or near, pos, null) as gone", "near and not copy as near",
                              "degree")
    # equal rows of the table give equal positions: they count once
    per_doc = per_doc.groupBy("doc", "mark").agg(
        F.collect_set("gone").alias("gone"), F.collect_set(F.expr("if(near, gone, null)")).alias("near"),
        F.collect_set(F.struct("pos", "degree")).alias("links"))
    per_doc = per_doc.selectExpr("doc", "mark", "gone", "near", "aggregate(links, 0L, (n, x) -> n + x.degree) as n_links")
    clash = ["n_lines", "n_removed", "n_near", "n_links", "__doc", "__mark"]
    out = docs.drop(*clash).withColumns({"__doc": F.expr(f"coalesce(cast(doc_id as bigint), {NO_ID})"),
                                         "__mark": F.xxhash64("text")})
    out = out.join(per_doc.withColumnsRenamed({"doc": "__doc", "mark": "__mark", "gone": "__gone", "near": "__near",
                                               "n_links": "__links"}), ["__doc", "__mark"], "left")
    kept = (f"if(coalesce(size(__gone), 0) = 0, text, array_join(filter({LINES}, (x, i) -> "
            "not array_contains(__gone, i)), '\\n'))")
    columns = [f"`{c}`" if c != "text" else f"{kept} as text" for c in docs.columns if c not in clash]
    return out.selectExpr(
        *columns, f"cast(coalesce(size({LINES}), 0) as bigint) as n_lines",
        "cast(coalesce(size(__gone), 0) as bigint) as n_removed", "cast(coalesce(size(__near), 0) as bigint) as n_near",
        "coalesce(__links, 0) as n_links")
