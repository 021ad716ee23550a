"""Trie of conversations by their turns, with totals over subtrees by a depth-band rollup.

A node of depth d is a distinct sequence of the first d turns (role, text) of a conversation. It is keyed by the
exclusive or of the digests of its turns with their places, 128 bits, so the keys of all prefixes of a conversation are
running aggregates that can be put together from blocks; a conversation with a third of all rows is spread over many
tasks. Members of a node must agree on the digest of its last turn and, through the key, on its parent; a node whose
members don't is an error of the job, never a wrong answer.

Totals over subtrees: depths are cut into bands of ``BAND`` levels. A node hands its value to its ancestors inside its
band only (at most ``BAND`` rows a node). The first nodes of the bands then form a trie of their own, ``BAND`` times less
deep, whose totals are found in the same way, and the completed total of such a node goes to the ancestors in the band
above. So the rounds are the logarithm of the depth to the base ``BAND``.

Keys of hot nodes (the root, a first turn that a third of the conversations share) appear only where rows are aggregated
with a map-side part or where they are spread over ``SALTS`` keys.

Defined results: turns are ordered by turn (null first), then role and text; null roles and texts are empty; equal rows
are different turns; rows without conv_id belong to no conversation; an empty table has no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import written
from geotables.llm.ranks import ordered_turns

BAND = 8
BLOCK = 4096
SALTS = 64


def _long(hexadecimal: str, at: int) -> str:
    return f"cast(conv(substr({hexadecimal}, {at}, 16), 16, -10) as bigint)"


def turn_table(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1 and t2 (a digest of role and text) and n_bytes (of the text), one row per turn."""
    rows = conversations.where("conv_id is not null").selectExpr(
        "conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    rows = rows.selectExpr("*", "sha2(concat(char_length(role), ':', role, text), 256) as _d")
    rows = rows.selectExpr("conv_id", "turn", "role", "text", f"{_long('_d', 1)} as _t1", f"{_long('_d', 17)} as _t2")
    return written(ordered_turns(rows, {"t1": "_t1", "t2": "_t2", "n_bytes": "octet_length(text)"}, "trie-rows"), "trie-turns")


def with_inherited(turns: DataFrame, base: str, n_inherited: str) -> DataFrame:
    """Turns of conversations that start with the first ``n_inherited`` turns of conversation ``base`` (both SQL over
    conv_id; at most ``BLOCK`` turns) in place of as many of their own: (conv_id, n_turns, pos, t1, t2, n_bytes), a turnless
    conversation by a row with pos 0."""
    block = f"(pos - 1) div {BLOCK}"
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "conv_id", "n", f"{base} as base", f"cast({n_inherited} as bigint) as h")
    convs = written(convs.alias("c").join(convs.selectExpr("conv_id as _id", "n as _n"), F.expr("base = _id"), "left")
                    .selectExpr("conv_id", "n", "h", "base", "least(h, coalesce(_n, 0L)) as m")
                    .selectExpr("*", "m + greatest(n - h, 0L) as n_turns"), "trie-conversations")
    # own turns meet the row of their conversation by blocks, so a long conversation is no hot key
    spread = convs.selectExpr("conv_id as _id", "h", "m", "n_turns", f"explode(sequence(0L, (n - 1) div {BLOCK})) as _block")
    own = turns.withColumn("_in", F.expr(block)).join(spread, F.expr("conv_id = _id and _in = _block")).where("pos > h") \
        .selectExpr("conv_id", "n_turns", "m + pos - h as pos", "t1", "t2", "n_bytes")
    heads = turns.where(f"pos <= {BLOCK}").selectExpr("conv_id as _id", "pos", "t1", "t2", "n_bytes")
    taken = convs.where("m > 0").select("conv_id", "n_turns", "base", F.expr("explode(sequence(1L, m)) as _k")).join(
        heads, F.expr("base = _id and _k = pos")).select(*own.columns)
    root = convs.selectExpr("conv_id", "n_turns", "0L as pos", "0L as t1", "0L as t2", "0 as n_bytes")
    return own.unionByName(taken).unionByName(root)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """Adds to (conv_id, n_turns, pos, t1, t2, n_bytes) the key (k1, k2) of the prefix that ends at the row and that of its
    parent (p1, p2). Running aggregates inside blocks of a conversation, then over its blocks."""
    tagged = turns.selectExpr("*", f"if(pos = 0, 0L, (pos - 1) div {BLOCK}) as block",
                              "if(pos = 0, 0L, xxhash64(pos, t1, t2)) as h1", "if(pos = 0, 0L, xxhash64(t2, t1, pos, 1)) as h2")
    inside = "over (partition by conv_id, block order by pos rows between unbounded preceding and current row)"
    tagged = tagged.selectExpr("*", f"bit_xor(h1) {inside} as r1", f"bit_xor(h2) {inside} as r2")
    totals = tagged.where(f"n_turns > {BLOCK}").groupBy("conv_id", "block").agg(
        F.expr("bit_xor(h1) as b1"), F.expr("bit_xor(h2) as b2"))
    before = "over (partition by conv_id order by block rows between unbounded preceding and 1 preceding)"
    offsets = totals.selectExpr("conv_id as _id", "block as _block", f"bit_xor(b1) {before} as o1", f"bit_xor(b2) {before} as o2")
    keyed = tagged.join(offsets, F.expr("conv_id = _id and block = _block"), "left").selectExpr(
        "conv_id", "n_turns", "pos as depth", "t1", "t2", "n_bytes", "h1", "h2",
        "r1 ^ coalesce(o1, 0L) as k1", "r2 ^ coalesce(o2, 0L) as k2")
    return keyed.selectExpr("conv_id", "n_turns", "depth", "t1", "t2", "n_bytes", "k1", "k2", "k1 ^ h1 as p1", "k2 ^ h2 as p2")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row per node: k1, k2, depth, conv_id (smallest member), p1, p2 (its parent's key), n_convs, n_bytes."""
    nodes = paths.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("n_bytes").alias("n_bytes"), F.min("t1").alias("t1"), F.max("t1").alias("_t1"), F.min("t2").alias("t2"),
        F.max("t2").alias("_t2"))
    same = "if(t1 = _t1 and t2 = _t2, n_convs, cast(raise_error('two prefixes share a key') as bigint)) as n_convs"
    return nodes.selectExpr("k1", "k2", "depth", "conv_id", "p1", "p2", same, "n_bytes")


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], depth: int, step: int = 1) -> DataFrame:
    """k1, k2, depth, conv_id and the sums of ``values`` over the subtree of every node, by bands of depths.

    ``nodes`` (k1, k2, depth, conv_id, values) have the depths 0, step, 2 step, ...; ``paths`` (conv_id, depth, k1, k2) are the
    nodes that each conversation passes, ``depth`` is the largest one."""
    height = BAND * step
    # the keys of a conversation inside one band, from its first level down: BAND entries at most
    chains = paths.where(f"depth % {step} = 0").groupBy("conv_id", F.expr(f"depth div {height} as band")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "k1", "k2"))).alias("chain"))
    chains = chains.withColumnsRenamed({"conv_id": "_id", "band": "_band"})

    def handed_up(rows: DataFrame, band: str, upto: str) -> DataFrame:
        """Sums per ancestor: every row goes to the first ``upto`` nodes of its conversation in ``band``."""
        met = rows.withColumn("_in", F.expr(band)).join(chains, F.expr("conv_id = _id and _in = _band"))
        met = met.selectExpr(f"explode(slice(chain, 1, cast({upto} as int))) as a", *values)
        return met.groupBy("a.depth", "a.k1", "a.k2").agg(*[F.sum(v).alias(v) for v in values])

    local = handed_up(nodes, f"depth div {height}", f"depth % {height} div {step} + 1")
    if depth < height:
        return local
    local = written(local, f"trie-band-{step}")
    names = nodes.select("depth", "k1", "k2", "conv_id").where(f"depth % {height} = 0")
    heads = local.where(f"depth % {height} = 0").join(names, ["depth", "k1", "k2"])
    complete = written(subtree_totals(heads, paths, values, depth, height).join(names, ["depth", "k1", "k2"]), f"trie-heads-{step}")
    above = handed_up(complete.where("depth > 0"), f"depth div {height} - 1", f"{BAND}")
    return local.unionByName(above).groupBy("depth", "k1", "k2").agg(*[F.sum(v).alias(v) for v in values])


def _node_runs(batch: pa.RecordBatch) -> tuple[list[tuple], list[int]]:
    """The nodes of a batch sorted by (depth, k1, k2), one for each run of equal rows, and the borders of the runs."""
    key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    starts = np.concatenate([[0], cuts])
    return [tuple(x) for x in key[:, starts].T.tolist()], [*starts.tolist(), batch.num_rows]


def _table(nodes: list[tuple], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    keys = {c: pa.array([n[i] for n in nodes], pa.int64()) for i, c in enumerate(("depth", "k1", "k2"))}
    return pa.RecordBatch.from_pydict({**keys, **columns})


def _end_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) rows to the joined ids of every run of a node, with the first of them."""
    for batch in batches:
        if batch.num_rows:
            nodes, at = _node_runs(batch)
            ids = pc.cast(batch.column(3), pa.string())
            texts = [",".join(ids[a:b].to_pylist()) for a, b in zip(at, at[1:])]
            yield _table(nodes, {"first": batch.column(3).take(pa.array(at[:-1])), "ids": pa.array(texts, pa.string())})


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, first, ids) pieces to one SHA-256 per node; the state of a node is one hash object, so a node may
    have any number of pieces."""
    node, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, at = _node_runs(batch)
        done, hashes, texts = [], [], batch.column(4)
        for here, a, b in zip(nodes, at, at[1:]):
            text = ",".join(texts[a:b].to_pylist()).encode()
            if here == node:
                state.update(b"," + text)
                continue
            if state is not None:
                done.append(node)
                hashes.append(state.hexdigest())
            node, state = here, hashlib.sha256(text)
        if done:
            yield _table(done, {"ends_sha256": pa.array(hashes, pa.string())})
    if state is not None:
        yield _table([node], {"ends_sha256": pa.array([state.hexdigest()], pa.string())})


def ends_hashes(paths: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes where conversations end: SHA-256 of their ids in ascending order, joined by
    commas. Ids are sorted and joined by ranges, so a node with very many of them is spread over tasks; only the digest, which
    can be computed in order alone, passes over the joined pieces of a node in one task."""
    ends = paths.where("depth = n_turns").select("depth", "k1", "k2", "conv_id")
    order = ["depth", "k1", "k2", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _end_pieces, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    pieces = pieces.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first")
    return pieces.mapInArrow(_end_hashes, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def parent_names(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, k1, k2, parent_conv_id) of all nodes but the root, and (depth, k1, k2, n_children) of all that have children.
    The children of a node are spread over ``SALTS`` keys, so its row is copied that often at most."""
    salt = f"cast(pmod(xxhash64(k1, k2), {SALTS}) as int) as salt"
    children = nodes.where("depth > 0").selectExpr("depth", "k1", "k2", "depth - 1 as d", "p1", "p2", salt)
    shares = written(children.groupBy("d", "p1", "p2", "salt").agg(F.count(F.lit(1)).alias("n")), "trie-children")
    counts = shares.groupBy("d", "p1", "p2").agg(F.sum("n").alias("n_children")).selectExpr(
        "d as depth", "p1 as k1", "p2 as k2", "n_children")
    parents = nodes.selectExpr("depth as d", "k1 as p1", "k2 as p2", "conv_id as parent_conv_id")
    named = shares.drop("n").join(parents, ["d", "p1", "p2"])
    return children.join(named, ["d", "p1", "p2", "salt"]).select("depth", "k1", "k2", "parent_conv_id"), counts


def prefix_trie(conversations: DataFrame, base: str | None = None, n_inherited: str = "0") -> DataFrame:
    """One row per node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``base`` and ``n_inherited``: see ``with_inherited``."""
    turns = with_inherited(turn_table(conversations), base or "conv_id", n_inherited)
    paths = written(prefix_keys(turns), "trie-paths")
    found = written(trie_nodes(paths), "trie-nodes")
    parents, counts = parent_names(found)
    node = ["depth", "k1", "k2"]
    nodes = written(found.join(counts, node, "left").join(parents, node, "left").selectExpr(
        *node, "conv_id", "parent_conv_id", "n_convs", "coalesce(n_children, 0L) as n_children",
        "if(n_children is null, 1L, 0L) as n_leaves", "(n_convs - 1) * n_bytes as saved_tokens"), "trie-named")
    deepest = nodes.agg(F.max("depth")).first()[0]
    values = ["n_leaves", "saved_tokens"]
    totals = subtree_totals(nodes.select(*node, "conv_id", *values), paths, values, deepest or 0)
    out = nodes.drop(*values).join(totals, node).join(ends_hashes(paths), node, "left")
    return out.selectExpr("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                          "coalesce(ends_sha256, sha2('', 256)) as ends_sha256")
