"""Repair of conversation structure: the cheapest edits that make the roles of a conversation legal.

Rows of a conversation, in order, are edited from left to right. The lattice has a node for every (rows done, state), the
states being START, SYSTEM, USER (a user turn is open) and PAIR (an assistant turn has closed it), and arcs

    D  delete the row                       cost 2   state stays
    I  insert an empty user/assistant turn  cost 5   rows done stay
    K  keep the row, if its role fits       cost 0
    R  give the row the role that fits      cost 1

A truncated row that stays costs 5 more; blank rows and duplicates have to be deleted. In every state only one of user and
assistant fits, so a string of edits says all. A legal conversation ends in START (empty) or PAIR.

**Auction shortest paths** (``auction``). Every node has a price, at first a lower bound of what is left to pay; at all times
``price(i) <= cost(i, j) + price(j)`` for every arc, with equality along a path from the origin. The last node of the path
raises its price to its best offer: if that was a raise, the path is contracted by a node, else extended along the best arc,
until the path reaches the end. Costs are integers, so are prices. Converged prices are duals: every arc of every cheapest
path is tight (equality), and the ASCII-least string of edits is traced along tight arcs that lead to the end.

**Long conversations** are cut into blocks of ``BLOCK`` rows. The auction gives the costs of crossing a block from state to
state (4 x 4, per block, in parallel); over the blocks of a conversation these small matrices give what is left to pay at
every border, and with that as the price of its exits each block is traced by itself. Only what the result itself needs in
order (the digest of the repaired text) streams a conversation through one task; nothing holds its rows.

Defined results: a null conv_id is a conversation, null roles and texts are one space; rows are ordered by turn (null first),
rows of one turn by role, then text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import written
from geotables.llm.ranks import ordered_turns

BLOCK = 256
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 40

#: states: 0 START, 1 SYSTEM, 2 USER, 3 PAIR. Role initial (0 s, 1 u, 2 a, 3 other) that fits in a state -> next state.
FITS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
#: what an insertion or a change of role makes in a state: the role and the next state.
MADE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: A row is a letter: initial * 4 + fault, faults being 0 none, 1 blank, 2 duplicate, 3 truncated.
FIRST_LETTER = 65


def _row(letter: str) -> tuple[int, int]:
    return divmod(ord(letter) - FIRST_LETTER, 4)


def arcs(rows: str, at: int, state: int, last: bool) -> list[tuple[str, int, int, int]]:
    """Arcs out of a node of the lattice of ``rows``: (edit, cost, rows done, state), in ASCII order of the edits. Insertions
    between two blocks belong to the second one."""
    if at == len(rows):
        return [("I", INSERT, at, MADE[state][1])] if last else []
    initial, fault = _row(rows[at])
    out = [("D", DELETE, at + 1, state), ("I", INSERT, at, MADE[state][1])]
    if fault in (0, 3):
        stay = TRUNCATED if fault == 3 else 0
        if initial in FITS[state]:
            out.append(("K", stay, at + 1, FITS[state][initial]))
        out.append(("R", stay + REROLE, at + 1, MADE[state][1]))
    return out


class Lattice:
    """Prices of the lattice of a block for one set of exit costs (what is left to pay in each state at the block's end)."""

    def __init__(self, rows: str, exits: tuple[int, ...], last: bool):
        self.rows, self.exits, self.last = rows, exits, last
        bound = [min(exits)] * (len(rows) + 1)
        for at in range(len(rows) - 1, -1, -1):
            # every arc past a row with a fault costs 2 at least
            bound[at] = bound[at + 1] + (DELETE if _row(rows[at])[1] else 0)
        self.price = {(at, state): bound[at] for at in range(len(rows) + 1) for state in range(4)}
        self.known = {}

    def offers(self, node: tuple) -> list[tuple[str, int, tuple | None]]:
        """(edit, cost, node) of the arcs out of ``node``; the arc without an edit leads to the end, node None."""
        if node not in self.known:
            at, state = node
            out = [(e, c, (a, s)) for e, c, a, s in arcs(self.rows, at, state, self.last)]
            if at == len(self.rows) and self.exits[state] < FAR:
                out.append(("", self.exits[state], None))
            self.known[node] = out
        return self.known[node]

    def auction(self, state: int) -> int:
        """Extend and contract a path from (0, state) until it reaches the end; the price of the origin is then the cost.
        Prices stay from one origin to the next, the end being the same. A node without arcs is priced out."""
        price = self.price
        path = [(0, state)]
        while True:
            node = path[-1]
            best, follow = FAR, None
            for _, cost, to in self.offers(node):
                offer = cost if to is None else cost + price[to]
                if offer < best:
                    best, follow = offer, to
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
                elif best >= FAR:
                    return FAR
            elif follow is None:
                return price[path[0]]
            else:
                path.append(follow)

    def trace(self, state: int) -> tuple[str, int]:
        """The ASCII-least edits from (0, state) along tight arcs that lead to the end, and the state at the block's end."""
        price, dead, edits, nodes = self.price, set(), [], [(0, state)]
        while True:
            node = nodes[-1]
            for edit, cost, follow in self.offers(node):
                if follow not in dead and price[node] == cost + (0 if follow is None else price[follow]):
                    break
            else:
                # no tight arc goes on from here to the end
                dead.add(node)
                nodes.pop()
                edits.pop()
                continue
            if follow is None:
                return "".join(edits), node[1]
            edits.append(edit)
            nodes.append(follow)


def _can_cross(rows: str, state: int, to: int) -> bool:
    """USER and PAIR can be reached from every state; START only from itself, SYSTEM from itself and by a kept system row."""
    return to in (2, 3) or state == to or (state, to) == (0, 1) and any(x in rows for x in ("A", "D"))


@lru_cache(maxsize=4096)
def crossing(rows: str, last: bool) -> tuple[int, ...]:
    """Costs of crossing a block: entry 4 * state before + state after. One lattice for each state after."""
    out = [FAR] * 16
    for to in range(4):
        lattice = Lattice(rows, tuple(0 if s == to else FAR for s in range(4)), last)
        for state in range(4):
            if _can_cross(rows, state, to):
                out[4 * state + to] = lattice.auction(state)
    return tuple(out)


END = (0, FAR, FAR, 0)


@lru_cache(maxsize=16384)
def cheapest(rows: str, exits: tuple[int, ...], last: bool, states: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """For each of ``states`` before the block: the cost of what is left, the edits of the block, and the state after it."""
    lattice = Lattice(rows, exits, last)
    return tuple((lattice.auction(s), *lattice.trace(s)) for s in states)


# --- the same over tables -------------------------------------------------------------------------------------------

BLANKS = "' \\t\\n\\u000B\\u000C\\r'"


def structure(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of all conversations (conv_id, block, letters, following: the first letter of the next block or null) and the
    number of missing turns (conv_id, gaps)."""
    rows = conversations.selectExpr("conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text")
    rows = rows.selectExpr("*", f"trim(trailing {BLANKS} from text) as _said",
                           "sha2(concat(char_length(role), ':', role, text), 256) as _d")
    keep = {
        "no": "turn", "d1": "substr(_d, 1, 32)",
        "initial": "case substr(role, 1, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end",
        "fault": "case when _said = '' then 1 when substr(_said, -1) in ('.', '!', '?') then 0 else 3 end"}
    rows = rows.selectExpr("conv_id", "turn", "role", "text", *[f"{sql} as _{c}" for c, sql in keep.items()])
    rows = written(ordered_turns(rows, {c: f"_{c}" for c in keep}, "repair-rows"), "repair-turns")
    # the first row of a text has the same (conv_id, pos) in both tables, so a text that fills a conversation is no hot key
    first = rows.groupBy("conv_id", "d1").agg(F.min("pos").alias("_pos")).selectExpr("conv_id as _id", "_pos")
    rows_known = rows.join(first, F.expr("conv_id <=> _id and pos = _pos"), "left").selectExpr(
        "conv_id", "pos", f"char({FIRST_LETTER} + 4 * initial + if(fault <> 1 and _pos is null, 2, fault)) as letter")
    blocks = rows_known.groupBy("conv_id", F.expr(f"(pos - 1) div {BLOCK} as block")).agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(pos, letter))), x -> x.letter), '') as letters"))
    blocks = blocks.selectExpr("*", "lead(left(letters, 1)) over (partition by conv_id order by block) as following")
    turns = rows.groupBy("conv_id", "no").agg(F.lit(1).alias("_")).groupBy("conv_id").agg(
        F.max("no").alias("_max"), F.min("no").alias("_min"), F.count("no").alias("_n"))
    gaps = turns.selectExpr("conv_id", "cast(least(coalesce(cast(_max as decimal(38)) - _min + 1 - _n, 0), "
                                       "9223372036854775807) as bigint) as gaps")
    return written(blocks, "repair-blocks"), gaps


def fault_counts(blocks: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated (rows by their first fault) and illegal (adjacent rows whose initials don't follow
    each other in a legal conversation)."""
    letters = "".join(chr(FIRST_LETTER + i) for i in range(16))
    of = lambda fault: f"sum(length(letters) - length(translate(letters, '{letters[fault::4]}', '')))"
    pairs = blocks.selectExpr("conv_id", "letters", "translate(concat(letters, coalesce(following, '')), "
                              f"'{letters}', '{''.join(i * 4 for i in 'suax')}') as i")
    pairs = pairs.selectExpr("conv_id", "letters", "if(length(i) < 2, 0, size(filter(sequence(1, greatest(length(i) - 1, 1)), "
                             "k -> substr(i, k, 2) not in ('su', 'ua', 'au')))) as illegal")
    return pairs.groupBy("conv_id").agg(*[F.expr(f"{of(n)} as {c}") for n, c in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
                                        F.sum("illegal").alias("illegal"))


def _with_crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the crossing costs to blocks that have one before them."""
    for batch in batches:
        rows = batch.to_pydict()
        cross = [list(crossing(x, f is None)) if b else None
                 for b, x, f in zip(rows["block"], rows["letters"], rows["following"])]
        yield batch.append_column("cross", pa.array(cross, pa.list_(pa.int64())))


def _with_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first: what is left to pay after each, in place of the crossing costs."""
    left = END
    for batch in batches:
        rows = batch.to_pydict()
        exits = []
        for following, cross in zip(rows["following"], rows["cross"]):
            now = END if following is None else left
            exits.append(list(now))
            if cross is not None:
                left = tuple(min(cross[4 * s + t] + now[t] for t in range(4)) for s in range(4))
        yield batch.drop_columns(["cross"]).append_column("exits", pa.array(exits, pa.list_(pa.int64())))


def _with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of every block for each state before it; the first block of a conversation starts in START."""
    for batch in batches:
        rows = batch.to_pydict()
        found = [cheapest(x, tuple(e), f is None, (0, 1, 2, 3) if b else (0,))
                 for b, x, f, e in zip(rows["block"], rows["letters"], rows["following"], rows["exits"])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("block"),
             pa.array([[x[0] for x in f] for f in found], pa.list_(pa.int64())),
             pa.array([[x[1] for x in f] for f in found], pa.list_(pa.string())),
             pa.array([[x[2] for x in f] for f in found], pa.list_(pa.int32()))],
            names=["conv_id", "block", "costs", "edits", "ends"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the first to the last: one row (conv_id, block, cost, edits) each, by the state in which
    the blocks before end; the cost is that of the whole conversation, in its first block."""
    state = 0
    for batch in batches:
        rows = batch.to_pydict()
        costs, edits = [], []
        for block, c, e, ends in zip(rows["block"], rows["costs"], rows["edits"], rows["ends"]):
            state = state if block else 0
            costs.append(c[state] if block == 0 else 0)
            edits.append(e[state])
            state = ends[state]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(costs, pa.int64()),
                                          pa.array(edits, pa.string())], names=["conv_id", "block", "cost", "edits"])


def block_edits(blocks: DataFrame) -> DataFrame:
    """conv_id, block, cost (of the conversation, in its first block, else 0) and edits of every block."""
    kind = blocks.select("conv_id", "block").schema
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    text = f"{named}, letters string, following string"
    crossed = blocks.select("conv_id", "block", "letters", "following").mapInArrow(_with_crossing, f"{text}, cross array<bigint>")
    order = F.col("conv_id").asc_nulls_first()
    exits = crossed.repartition("conv_id").sortWithinPartitions(order, F.col("block").desc()).mapInArrow(
        _with_exits, f"{text}, exits array<bigint>")
    traced = written(exits, "repair-exits").repartition("conv_id", "block").mapInArrow(
        _with_edits, f"{named}, costs array<bigint>, edits array<string>, ends array<int>")
    return traced.repartition("conv_id").sortWithinPartitions(order, "block").mapInArrow(
        _chosen, f"{named}, cost bigint, edits string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of a conversation, then its rows: the rows of the repaired conversation, in order."""
    conv, pieces, edits, at, state, n_out = None, [], "", 0, 0, 0
    out = []

    def emit(edit: str, turn, role: str, text: str) -> None:
        nonlocal n_out
        n_out += 1
        out.append((conv, n_out, turn, role, text, edit))

    def insertions() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            role, state = MADE[state]
            emit("I", None, role, "")
            at += 1

    def batch_of() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))],
            names=["conv_id", "place", "turn", "role", "text", "edit"])
        out.clear()
        return done

    began = False
    for batch in batches:
        for c, block, turn, role, text, piece in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if not began or c != conv:
                insertions()
                conv, edits, at, state, n_out, began = c, "", 0, 0, 0, True
            if piece is not None:
                pieces.append(piece)
                continue
            if pieces:
                edits = "".join(pieces)
                pieces.clear()
            insertions()
            edit = edits[at]
            at += 1
            if edit == "K":
                state = FITS[state]["sua".find(role[:1])]
                emit("K", turn, role, text)
            elif edit == "R":
                role, state = MADE[state]
                emit("R", turn, role, text)
        if out:
            yield batch_of()
    insertions()
    if out:
        yield batch_of()


def repaired_rows(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), turn (null for an inserted row), role, text and edit (K, R or I).
    ``edits`` are those of ``block_edits``. The rows of a conversation stream in order through one task, which holds nothing
    of it but its string of edits; they come out contiguous."""
    rows = conversations.selectExpr(
        "cast(conv_id as bigint) as conv_id", "cast(null as bigint) as block", "cast(turn as bigint) as turn",
        "coalesce(role, ' ') as role", "coalesce(text, ' ') as text", "cast(null as string) as edits")
    plans = edits.selectExpr("cast(conv_id as bigint) as conv_id", "block", "cast(null as bigint) as turn",
                             "'' as role", "'' as text", "edits")
    streams = plans.unionByName(rows).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("block").asc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "text")
    return streams.mapInArrow(_apply, "conv_id bigint, place bigint, turn bigint, role string, text string, edit string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state, began = None, None, False
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
            if not began or c != conv:
                if began:
                    out.append((conv, state.hexdigest()))
                conv, state, began = c, hashlib.sha256(), True
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()),
                                              pa.array([r[1] for r in out], pa.string())], names=["conv_id", "repaired_sha256"])
    if began:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())],
                                         names=["conv_id", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, joined by newlines, straight from ``repaired_rows`` (conversations
    without rows have none)."""
    return repaired.mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (its edits) — and the edits by block,
    for ``repaired_rows``."""
    blocks, gaps = structure(conversations)
    edits = written(block_edits(blocks), "repair-edits")
    audits = edits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.expr(
        "array_join(transform(sort_array(collect_list(struct(block, edits))), x -> x.edits), '') as audit"))
    report = gaps
    for part in (fault_counts(blocks), audits):
        names = [c for c in part.columns if c != "conv_id"]
        report = report.join(part.withColumnRenamed("conv_id", "_id"), F.expr("conv_id <=> _id")).select(*report.columns, *names)
    return report, edits
