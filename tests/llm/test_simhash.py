import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from geotables.llm import simhash as sh
from geotables.llm.queries import op6_simhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(nodes, distance):
    """{fingerprint: smallest id reachable} by brute force; nodes are (id, fingerprint)."""
    f = np.array(sorted({x for _, x in nodes}), np.uint64)
    root = list(range(len(f)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= distance) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    place = {int(x): i for i, x in enumerate(f)}
    for d, x in nodes:
        if d is not None:
            t = top(place[x])
            least[t] = min(least.get(t, d), d)
    return {int(x): least.get(top(i)) for i, x in enumerate(f)}


def test_fingerprints_by_brute_force():
    rnd = random.Random(2)
    texts = [None, "", " \t\n", "One", "a B\x0bc", "x y z w", "é" * 10 + "  Ab\r\ncd  ", "w " * 70_000]
    texts += [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 60))) for _ in range(100)]
    assert sh.fingerprints(pa.array(texts), 4).tolist() == [fingerprint(t) for t in texts]


def cluster(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    f = [int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    for i in range(n):
        x = int(centres[i % 3 if i % 2 else i % 30])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        f.append(x)
    return list(dict.fromkeys(f))


@pytest.mark.parametrize("parts", [2, 3, 4, 5])
@pytest.mark.parametrize("bucket_rows", [sh.BUCKET_ROWS, 12])
def test_links_connect_like_all_pairs(spark, monkeypatch, parts, bucket_rows):
    monkeypatch.setattr(sh, "BUCKET_ROWS", bucket_rows)
    f = cluster(parts)
    signed = np.array(f, np.uint64).view(np.int64).tolist()
    groups = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "d bigint, f bigint")
    found = sh.components(sh.links(groups, 4, parts)).collect()
    got = {i: i for i in range(len(f))} | {r.node.d: r.root.d for r in found}
    want = component_ids(list(enumerate(f)), 4)
    assert got == {i: want[x] for i, x in enumerate(f)}
    assert len(set(got.values())) < len(f)


def test_components_of_a_long_chain(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(10_000), 300)
    edges = spark.createDataFrame([((a, 0), (b, 0)) for a, b in zip(ids, ids[1:], strict=False)] + [((1, 9), (1, 10))],
                                  "a struct<d:bigint,f:bigint>, b struct<d:bigint,f:bigint>")
    got = {tuple(r.node): tuple(r.root) for r in sh.components(edges).collect()}
    least = (min(ids), 0)
    assert got == {(i, 0): least for i in ids if (i, 0) != least} | {(1, 10): (1, 9)}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in docs]
    want = component_ids(prints, 4)
    got = op6_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (d, f"{x:016x}", want[x]) for d, x in prints)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, 1), (4, "", 1), (4, "", 1), (2, "a b c d e", 1), (None, "a b c d e", 1), (None, "q r s t", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
    got = sorted(((r.doc_id, r.component_id) for r in sh.simhash_components(df).collect()), key=repr)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (2, 2), (None, 2), (None, None)], key=repr)
    assert sh.simhash_components(df.limit(0)).collect() == []


def test_no_chunk_pair_gets_more_probes_than_its_bound(spark, monkeypatch):
    monkeypatch.setattr(sh, "BUCKET_ROWS", 50)
    # 13 values around one with a single stored fingerprint, 40 stored in each: none is large, but the probes in the middle are
    bits = [list(range(13))]
    rnd = np.random.default_rng(5)
    high = lambda: int(rnd.integers(0, 1 << 50)) << 13
    f = np.array(sorted({high() | (1 << b) for b in range(13) for _ in range(40)} | {high()}), np.uint64)
    groups = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64))], "f bigint, d bigint")
    histograms = [np.bincount((f & np.uint64((1 << 13) - 1)).astype(int), minlength=1 << 13)]
    probes = sh.probe_histograms(groups, spark.sparkContext.broadcast(sh.Plan(bits, 1, histograms)))
    assert probes[0][0] == len(f) and probes[0][1 << 3] == 41
    count, met = {}, set()
    for part, value, a, b, kind, x, _ in sh.bucket_rows(sh.Plan(bits, 1, histograms, probes), f, np.arange(len(f))):
        for key in zip(part.tolist(), value.tolist(), a.tolist(), b.tolist(), kind.tolist(), x.tolist(), strict=True):
            if key[:2] == (0, 0):
                count.setdefault(key[:4], [0, 0])
                count[key[:4]][0] += key[4] & 1
                count[key[:4]][1] += key[4] >> 1
                met |= {key[5]} if key[4] & 2 else set()
    assert len(met) == len(f) and all(n == 1 and m <= 100 for n, m in count.values())
