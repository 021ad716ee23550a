"""Relational chat formatting [native]: Spark expressions only.

Rows (conv_id, turn, role, text) become one row per conversation. The turn structs are collected and sorted, adjacent
turns of one role are merged into one block by array functions, and the pieces are concatenated:

    block := ``<s>`` role ``[INST]`` text { ``[/INST][INST]`` text } ``[/INST]</s>``

so a block that merges several turns still shows where each of them began, and the original turns can be read back.
Texts and roles are escaped, so that no control string can stand inside them: ``\\`` becomes ``\\0``, ``<`` becomes
``\\1`` and ``[`` becomes ``\\2``. Every backslash of escaped text is followed by 0, 1 or 2, so unescaping is three
replacements. ``loss_spans`` is the loss mask: the places (first code point from 1, number of code points) of the
escaped assistant texts in ``formatted``.

Defined results: null text or role is empty; a null turn sorts first; equal turns are ordered by role, then text, and
all are kept; rows with a null conv_id make up one conversation with a null id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TURN_OPEN, TURN_CLOSE = "<s>", "</s>", "[INST]", "[/INST]"


def escape_sql(text: str) -> str:
    return rf"replace(replace(replace({text}, '\\', '\\0'), '<', '\\1'), '[', '\\2')"


def unescape_sql(text: str) -> str:
    return rf"replace(replace(replace({text}, '\\2', '['), '\\1', '<'), '\\0', '\\')"


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<at, n>>, n_blocks."""
    loss = loss_role.replace("\\", "\\\\").replace("'", "\\'")
    rows = conversations.selectExpr(
        "conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as body")
    rows = rows.selectExpr("conv_id", "turn", "role", "body", f"{escape_sql('role')} as e_role",
                           f"{escape_sql('body')} as e_body")
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "body", "e_role", "e_body"))).alias("turns"))
    # what stands before each text: a new block, or a further turn of the block of the same role
    lead = (f"if(i > 0 and element_at(turns, i).role = t.role, '{TURN_OPEN}', "
            f"concat(if(i > 0, '{CLOSE}', ''), '{OPEN}', t.e_role, '{TURN_OPEN}'))")
    pieces = turns.selectExpr(
        "conv_id", "turns", f"transform(turns, (t, i) -> {lead}) as leads")
    pieces = pieces.selectExpr(
        "conv_id",
        f"concat(array_join(zip_with(leads, turns, (l, t) -> concat(l, t.e_body, '{TURN_CLOSE}')), ''), '{CLOSE}')"
        " as formatted",
        f"size(filter(leads, l -> endswith(l, '{TURN_OPEN}') and l <> '{TURN_OPEN}')) as n_blocks",
        f"transform(arrays_zip(leads, turns), p -> struct(p.turns.role = '{loss}' as loss, char_length(p.leads) as skip,"
        " char_length(p.turns.e_body) as n)) as places")
    close = len(TURN_CLOSE)
    spans = ("aggregate(places, struct(cast(1 as bigint) as at, cast(array() as array<struct<at:bigint,n:bigint>>) as"
             " spans), (a, p) -> struct("
             f"a.at + p.skip + p.n + {close} as at, "
             "if(p.loss, concat(a.spans, array(struct(a.at + p.skip as at, cast(p.n as bigint) as n))), a.spans) as spans),"
             " a -> a.spans) as loss_spans")
    return pieces.selectExpr("conv_id", "formatted", spans, "cast(n_blocks as bigint) as n_blocks")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to formatted conversations what their text says: turns array<struct<role, text>> and loss_text."""
    blocks = (f"filter(split(formatted, '{CLOSE}'), b -> startswith(b, '{OPEN}'))")
    role = f"substring_index(substring(b, {len(OPEN) + 1}), '{TURN_OPEN}', 1)"
    body = f"substring(b, {len(OPEN) + 1 + len(TURN_OPEN)} + char_length({role}))"
    texts = rf"split(substring({body}, 1, char_length({body}) - {len(TURN_CLOSE)}), '\\[/INST\\]\\[INST\\]')"
    turns = (f"flatten(transform({blocks}, b -> transform({texts}, x -> struct({unescape_sql(role)} as role, "
             f"{unescape_sql('x')} as text))))")
    loss = unescape_sql(
        "array_join(transform(loss_spans, s -> substring(formatted, cast(s.at as int), cast(s.n as int))), '')")
    return formatted.selectExpr("*", f"{turns} as turns", f"{loss} as loss_text")
