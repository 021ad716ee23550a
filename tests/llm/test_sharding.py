import glob
import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geotables.llm import sharding as S

SCHEMA = "doc_id bigint, text string, shard string, slot string"


def shard(key, weights, seed="shard"):
    text = "-" if key is None else f"{len(str(key))}:{key}"
    draw = lambda i: (int(hashlib.md5(f"{seed}:{i}:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return min((-math.log(draw(i)) / w, i) for i, w in enumerate(weights) if w > 0)[1]


def rows():
    out = [(i, f"text {i} é") for i in range(400)] + [(7, "text 7 é")] * 3 + [(7, "other"), (-2**63, ""), (2**63 - 1, None)]
    return out + [(None, f"n{i % 40}") for i in range(200)]


def test_places_and_slots(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows()], SCHEMA)
    weights, grown = [1.0, 2.0, 0.0, 0.5], [1.0, 2.0, 0.0, 0.5, 3.0]
    got = S.place(df, weights, grown).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard(i, weights), shard(i, grown))
            for i, t in rows()]
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == Counter(want)
    for s in {w[3] for w in want}:
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in mine]
        assert order == sorted(order)


def test_growth_moves_only_into_the_new_shard(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    placed = S.place(df, [1.0] * 8, [1.0] * 9)
    moved = placed.where("grown_shard <> shard")
    assert moved.where("grown_shard <> 8").count() == 0
    assert abs(moved.count() / 20_000 - 1 / 9) < 0.01
    report = S.shard_report(placed).collect()
    assert len(report) == 8 and all(abs(r.n_rows / 2_500 - 1) < 0.1 for r in report)
    assert sum(r.n_moved for r in report) == moved.count() and sum(r.n_bytes for r in report) == 40_000


def test_weights_are_shares_and_change_alone(spark):
    df = spark.range(20_000).selectExpr("id as doc_id")
    before = S.assign_shards(df, ["doc_id"], [1.0, 2.0, 3.0], into="a")
    both = S.assign_shards(before, ["doc_id"], [1.0, 2.0, 6.0], into="b")
    share = {r.a: r.n / 20_000 for r in both.groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share[i] - w / 6) < 0.02 for i, w in enumerate([1, 2, 3]))
    assert both.where("a <> b and b <> 2").count() == 0
    with pytest.raises(ValueError):
        S.shard_sql("k", [0.0, 0.0])


def test_keys_of_several_columns_and_empty(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("-", "c")], "x string, y string")
    keys = [r[0] for r in df.selectExpr(S.key_sql(["x", "y"]) + " as k").collect()]
    assert len(set(keys)) == 4
    assert S.place(spark.createDataFrame([], SCHEMA), [1.0] * 3).collect() == []


def test_written_shards_hold_all_records(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows()], SCHEMA)
    path = str(tmp_path / "shards")
    S.write_shards(df, path, [1.0] * 4, ["doc_id"], rows_per_file=20)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter(
        (i, t, shard(i, [1.0] * 4)) for i, t in rows())
    assert set(back.columns) == {"doc_id", "text", "slot", "shard"}
    assert len(glob.glob(path + "/shard=*/*.parquet")) > 20
