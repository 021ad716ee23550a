"""WKB interchange.

Spark SQL has no function from bytes to doubles, so this is the one stage of the geometry side that runs Python:
``mapInArrow`` over flat coordinate arrays. Points are never touched one by one: SQL flattens a geometry to its
coordinates and ring sizes and rebuilds it from them, and the tasks move whole rings between numpy and bytes.

Both byte orders are read, and ISO and extended codes with Z, M or an SRID, of which x and y are kept. Output is
big-endian (byte order 0), 2-D. Bytes that are no WKB are told apart by a reason instead of failing the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from geotables.functions.shapes import RINGS_T
from geotables.model import finish_features

# WKB geometry type codes, and the flag bits of the extended form.
WKB_TYPES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
WKB_NAMES = {v: k for k, v in WKB_TYPES.items()}
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000

_FLAT = ["gtype", "transform(rings, r -> r.part) AS part", "transform(rings, r -> size(r.pts)) AS n",
         "flatten(transform(rings, r -> flatten(transform(r.pts, p -> array(p.x, p.y))))) AS xy"]


def _head(kind: str) -> bytes:
    return struct.pack(">bI", 0, WKB_TYPES[kind])


def encode(kind: str, part: list[int], n: list[int], raw: bytes) -> bytes:
    """WKB of one geometry from the part of each ring, its number of points, and all coordinates (big-endian)."""
    count = lambda x: struct.pack(">I", x)
    ends = np.cumsum([16 * x for x in n]).tolist()
    rings = [count(x) + raw[e - 16 * x:e] for x, e in zip(n, ends, strict=True)]
    if kind == "POINT":
        return _head(kind) + (raw[:16] if raw else struct.pack(">dd", float("nan"), float("nan")))
    if kind == "LINESTRING":
        return _head(kind) + count(len(raw) // 16) + raw
    if kind == "POLYGON":
        return _head(kind) + count(len(rings)) + b"".join(rings)
    if kind == "MULTIPOINT":
        return _head(kind) + count(len(raw) // 16) + b"".join(_head("POINT") + raw[i:i + 16] for i in range(0, len(raw), 16))
    if kind == "MULTILINESTRING":
        return _head(kind) + count(len(rings)) + b"".join(_head("LINESTRING") + r for r in rings)
    parts: dict[int, list[bytes]] = {}
    for p, r in zip(part, rings, strict=True):
        parts.setdefault(p, []).append(r)
    return _head(kind) + count(len(parts)) + b"".join(
        _head("POLYGON") + count(len(rs)) + b"".join(rs) for _, rs in sorted(parts.items()))


class _Reader:
    """Reads one geometry; collects part, ring number, size and coordinates of its rings."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.part: list[int] = []
        self.ring: list[int] = []
        self.n: list[int] = []
        self.xy: list[np.ndarray] = []

    def number(self, order: str) -> int:
        value = struct.unpack_from(order + "I", self.data, self.at)[0]
        self.at += 4
        return value

    def head(self) -> tuple[str, int, int]:
        if self.data[self.at] > 1:
            raise ValueError("byte order")
        order = "<" if self.data[self.at] else ">"
        self.at += 1
        code = self.number(order)
        if code & HAS_SRID:
            self.at += 4
        plain = code & 0x0FFFFFFF
        dims = 2 + bool(code & HAS_Z) + bool(code & HAS_M) + (0, 1, 1, 2)[plain // 1000 % 4]
        return order, plain % 1000, dims

    def points(self, order: str, n: int, dims: int, part: int, ring: int) -> None:
        if self.at + 8 * dims * n > len(self.data):
            raise ValueError("too short")
        values = np.frombuffer(self.data, order + "f8", dims * n, self.at).reshape(n, dims)[:, :2]
        self.at += 8 * dims * n
        self.part.append(part)
        self.ring.append(ring)
        self.n.append(n)
        self.xy.append(values.astype("f8").ravel())

    def geometry(self, part: int = 0, first_ring: int = 0, only: int | None = None) -> str:
        """Reads a geometry. The members of a multi-geometry must be of its plain type (``only``), so nothing nests deeper."""
        order, code, dims = self.head()
        name = WKB_NAMES[code]
        if only is not None and code != only:
            raise ValueError("member of another type")
        if code == 1:
            self.points(order, 1, dims, part, first_ring)
            if np.isnan(self.xy[-1]).any():  # an empty point
                for column in (self.part, self.ring, self.n, self.xy):
                    column.pop()
        elif code == 2:
            n = self.number(order)
            if n:
                self.points(order, n, dims, part, first_ring)
        elif code == 3:
            for i in range(self.number(order)):
                self.points(order, self.number(order), dims, part, i)
        else:
            for i in range(self.number(order)):
                self.geometry(i, 0, 3) if code == 6 else self.geometry(0, len(self.n), code - 3)
        return name


def decode(data: bytes) -> tuple[str, _Reader] | None:
    reader = _Reader(data)
    try:
        return reader.geometry(), reader
    except (ValueError, KeyError, IndexError, struct.error):
        return None


def _schema(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)


def to_wkb(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep..., wkb BINARY) from a feature table."""
    keep = keep or ["oid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = batch.column("xy")
            raw = np.asarray(xy.flatten()).astype(">f8").tobytes()
            ends = (np.asarray(xy.offsets) - (xy.offsets[0].as_py() if len(xy) else 0)) * 8
            out = [encode(kind, part or [], n or [], raw[a:b]) for kind, part, n, a, b in zip(
                batch.column("gtype").to_pylist(), batch.column("part").to_pylist(), batch.column("n").to_pylist(),
                ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "wkb"])

    return df.select(*keep, "gtype", "rings").selectExpr(*keep, *_FLAT).mapInArrow(run, f"{_schema(df, keep)}, wkb binary")


def decode_wkb(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep..., gtype, rings, reason) from a table with a ``wkb`` column; reason is NULL where the bytes are WKB."""
    keep = keep or ["oid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if w is None else decode(w) for w in batch.column("wkb").to_pylist()]
            reason = ["missing WKB" if w is None else None if r else "malformed WKB"
                      for w, r in zip(batch.column("wkb").to_pylist(), rows, strict=True)]
            ints = pa.list_(pa.int32())
            ends = np.cumsum([0, *(sum(2 * n for n in r[1].n) if r else 0 for r in rows)]).astype(np.int32)
            xy = [x for r in rows if r for x in r[1].xy]
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *xy])))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([r and r[0] for r in rows], pa.string()),
                 pa.array(reason, pa.string()), *(pa.array([getattr(r[1], c) if r else [] for r in rows], ints)
                                                  for c in ("part", "ring", "n")), flat],
                [*keep, "gtype", "reason", "part", "ring", "n", "xy"])

    flat = df.select(*keep, "wkb").mapInArrow(
        run, f"{_schema(df, keep)}, gtype string, reason string, part array<int>, ring array<int>, n array<int>, xy array<double>")
    first = "transform(n, (x, i) -> aggregate(slice(n, 1, i), 0, (s, v) -> s + v))"
    pts = "transform(sequence(0, n[i] - 1), j -> named_struct('x', xy[2 * (f + j)], 'y', xy[2 * (f + j) + 1]))"
    rings = (f"CAST(transform({first}, (f, i) -> named_struct('part', part[i], 'ring', ring[i], 'pts', "
             f"IF(n[i] = 0, array(), {pts}))) AS {RINGS_T})")
    return flat.selectExpr(*keep, "gtype", f"IF(reason IS NULL, {rings}, NULL) AS rings", "reason")


def from_wkb(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep..., gtype, rings) of the rows whose ``wkb`` column is WKB."""
    return decode_wkb(df, keep).where("reason IS NULL").drop("reason")


def read_wkb_table(spark: SparkSession, path: str, num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, rejects) from a stored table (key, wkb, oid, tags): envelope, cell, region and key are rebuilt from the
    geometry; rejects are (key, oid, reason)."""
    df = spark.read.schema("key STRING, wkb BINARY, oid STRING, tags STRING").parquet(path)
    if num_partitions:
        df = df.repartition(num_partitions)
    rows = decode_wkb(df, ["key", "oid", "tags"])
    good = finish_features(rows.where("reason IS NULL").select("oid", "tags", "gtype", "rings"))
    return good, rows.where("reason IS NOT NULL").select("key", "oid", "reason")


def write_wkb_table(df: DataFrame, path: str) -> None:
    """Features as a (key, wkb, oid, tags) table."""
    to_wkb(df, ["key", "oid", "tags"]).select("key", "wkb", "oid", "tags").write.mode("overwrite").parquet(path)
