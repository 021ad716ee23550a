"""Helpers shared by the text operators: table reads, shared scratch tables, and numpy views of Arrow text columns.

The numpy helpers work on slices of a few megabytes (``slices``), so the memory of a Python worker does not depend on
the Arrow batch size or on how many long texts meet in one batch. One text is never cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from geotables.session import storage_root

SLICE_BYTES = 1 << 20


ARROW_BATCH_BYTES, ARROW_BATCH_ROWS = 8 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers of this session get (by default up to 64 MB each, held on both sides).
    A setting only: results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a derived table to the shared folder and read it back: it is computed once, survives lost executors and
    cuts the lineage."""
    spark = df.sparkSession
    path = f"{storage_root(spark)}/geotables-llm/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``max_bytes`` together (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + max_bytes, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, end to end, and the n + 1 offsets of its rows; null rows are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that stay inside one row: byte starts, byte ends, and the row of each word.
    ``in_word`` is a table of 256 booleans."""
    n = len(data)
    mask = in_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


SPACES = np.ones(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = False
"""Word bytes of ``[^\\x20\\x09-\\x0D]+``."""

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RunHash:
    """64-bit hashes of runs of a sequence from prefix sums of a polynomial over the ring of 64-bit integers. The
    multiplier is odd, so it has an inverse and a run's hash does not depend on where the run stands."""

    def __init__(self, seed: int = 1):
        self.base = int(mix(np.array([seed], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            steps = np.full(n, self.base, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = np.uint64(self.inverse)
            self.inverses = np.cumprod(steps)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[:len(values)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[starts:ends] for each pair; the length goes in, too."""
        h = (prefix[ends] - prefix[starts]) * self.inverses[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * _MULT))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


LONG_WORD = 64


def word_hashes(hashes: RunHash, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words. A polynomial over a ring whose size is a power of two confuses certain long words whatever its
    base (those that follow the Thue-Morse sequence), so words of over ``LONG_WORD`` bytes are hashed by XXH3."""
    keys = hashes.runs(hashes.prefix(BYTE_VALUES[data]), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        keys[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return keys


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def held_out(column: str = "doc_id") -> str:
    """SQL condition for rows kept out of learning: crc32 of the id as text leaves 2 modulo 4."""
    return f"coalesce(crc32(cast({column} as string)) % 4 = 2, false)"
