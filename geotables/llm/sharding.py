"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for every key, an exponential clock whose rate is the weight of the shard, and the shard whose
clock runs out first gets the record. A draw depends on the key, the seed and the number of the shard only, so a further
shard takes records only into itself (its share of them), a removed last shard gives back only its own, and a changed weight
moves only records into or out of that shard. Shards are numbered 0, 1, 2, ...; a weight of zero takes nothing.

The draws are 52 bits of an MD5, exact as doubles; the smaller number of the shard wins a tie. Records with equal keys
always meet in one shard, however many there are: their shard is as full as the key is frequent, but no task of this job
holds them all (``ranks.numbered`` and ``write_shards`` cut full shards).

Defined results: a null key is a key of its own (no text spells it); null and empty texts have size 1; repeated rows are kept,
with slots of their own; an empty table gives no rows; other columns are ignored by ``place`` and kept by ``assign_shards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.ranks import numbered

SEED = "shard"


def _draw_sql(key: str, shard: int, seed: str) -> str:
    """A number in (0, 1), from 52 bits, of the key (``key``: a column of text) in a shard."""
    digits = f"substr(md5(concat('{seed}:{shard}:', {key})), 1, 13)"
    return f"(cast(conv({digits}, 16, 10) as bigint) + 0.5D) / 4503599627370496D"


def key_sql(columns: list[str]) -> str:
    """Text of a key of one or more columns: nulls and the borders between columns show."""
    return "concat(" + ", ".join(f"coalesce(concat(char_length(cast({c} as string)), ':', cast({c} as string)), '-')"
                                 for c in columns) + ")"


def shard_sql(key: str, weights: list[float], seed: str = SEED) -> str:
    """Shard of a key (a column of text): the smallest -ln(draw) / weight."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one at least positive")
    clocks = ", ".join(f"named_struct('at', -ln({_draw_sql(key, i, seed)}) / {float(w)!r}D, 'shard', {i})"
                       for i, w in enumerate(weights) if w > 0)
    return f"array_min(array({clocks})).shard" if clocks.count("named_struct") > 1 else f"({clocks}).shard"


def assign_shards(df: DataFrame, key: list[str], weights: list[float], seed: str = SEED, into: str = "shard") -> DataFrame:
    """``df`` with a column ``into``, its shard among ``len(weights)`` by the columns of ``key``, in place of a column of that
    name. No shuffle."""
    kept = [f"`{c}`" for c in df.columns if c.lower() != into.lower()]
    return df.selectExpr("*", f"{key_sql(key)} as _shard_key").selectExpr(
        *kept, f"{shard_sql('_shard_key', weights, seed)} as {into}")


def place(docs: DataFrame, weights: list[float], grown: list[float] | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, plus 1), text_crc32, shard, slot, and grown_shard, the shard under the weights
    ``grown``. Slots count the records of a shard from 0 by doc_id (null first), then checksum and size. Texts are read,
    never shuffled."""
    rows = docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 1L as size", "crc32(coalesce(text, '')) as text_crc32",
                           f"{key_sql(['doc_id'])} as _key")
    rows = rows.selectExpr("doc_id", "size", "text_crc32", f"{shard_sql('_key', weights, seed)} as shard",
                           f"{shard_sql('_key', grown or weights, seed)} as grown_shard")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    keep = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    return numbered(rows, "shard", order, order, keep, "shards").selectExpr(
        "doc_id", "size", "text_crc32", "shard", "pos - 1 as slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], key: list[str], rows_per_file: int = 1_000_000,
                 seed: str = SEED) -> None:
    """Write the records, all columns, as Parquet under ``path/shard=N``, in files of ``rows_per_file`` records at most.
    Partitions are rebalanced by their measured size: small ones are put together, a full shard is cut."""
    sharded = assign_shards(docs, key, weights, seed)
    dealt = sharded.hint("rebalance", "shard")
    dealt.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_report(placed: DataFrame) -> DataFrame:
    """Records, bytes and moves of every shard: shard, n_rows, n_bytes, n_moved (rows whose grown_shard is another one)."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"),
                                       F.sum(F.expr("if(grown_shard <> shard, 1L, 0L)")).alias("n_moved"))
