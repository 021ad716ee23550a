import hashlib
import random
import re

import numpy as np
import pytest

from geotables.llm import substring as ss
from geotables.llm.queries import op1_substring_dedup


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, window):
    least = {}
    top = float("inf")
    for d, t in docs:
        w = split(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, top), top if d is None else d)
    out = []
    for d, t in docs:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < (top if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_matching_statistics_by_brute_force():
    rng = np.random.default_rng(3)
    for window in (1, 2, 5, 8):
        seqs = [rng.integers(0, 3, rng.integers(window, 25)) for _ in range(40)]
        seqs.append(np.zeros(30, np.int64))
        owners = rng.integers(0, 50, len(seqs))
        got = ss.matching_statistics(np.concatenate(seqs).astype(np.uint64), np.array([len(s) for s in seqs]), owners, window)
        for s, g in zip(seqs, got, strict=True):
            want = [min(o for q, o in zip(seqs, owners, strict=True) for j in range(len(q) - window + 1)
                        if (q[j:j + window] == s[i:i + window]).all()) for i in range(len(s) - window + 1)]
            assert g.tolist() == want


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 37, 1000)
    m = ss.WaveletMatrix(x, 6)
    for c in range(37):
        base = m.rank(np.array([c]), np.array([0]))[0]
        at = rng.integers(0, 1001, 20)
        assert (m.rank(np.full(20, c), at) - base).tolist() == [int((x[:i] == c).sum()) for i in at]


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage, other = make(14), make(30)
    docs = []
    for i in range(60):
        w = make(rnd.randint(0, 40))
        if i % 2:
            at = rnd.randint(0, len(w))
            w[at:at] = passage
        if i % 7 == 0:
            w += other[rnd.randint(0, 10):rnd.randint(20, 30)]
        docs.append((rnd.randint(0, 500), rnd.choice([" ", "\n", " \t "]).join(w)))
    docs += [(docs[5][0] + k, docs[5][1]) for k in range(5)] + [docs[9], (docs[9][0], "x " + docs[9][1])]
    docs += [(None, docs[1][1]), (None, docs[1][1]), (3, None), (4, ""), (5, " \n"), (6, "a " * 4000), (7, "a " * 200)]
    docs += [(8, " ".join(make(20_000)))]
    docs += [(9, docs[-1][1][2000:9000]), (900, " ".join(passage)), (901, "é è " * 30), (902, "é è\t" * 9)]
    return docs


@pytest.mark.parametrize("hot", [ss.HOT_SEGMENTS, 3])
def test_documents_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ss, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(ss, "SHARD_WORDS", 3000)
    docs = corpus(hot)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, kept string, doc int")
    out = ss.remove_repeats(df.repartition(4), window=8, anchor=3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=repr) == brute(docs, 8)
    assert sum(r.n_removed for r in out) > 100
    assert all(sum(b - a for a, b in r.removed) == r.n_removed for r in out)


def test_given_table_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op1_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs, 50)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    assert ss.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_words_that_a_polynomial_hash_confuses(spark):
    a, b = thue_morse(4096)
    common = " ".join(f"c{i}" for i in range(49))
    docs = [(1, f"{common} {a}"), (2, f"{common} {b}"), (3, f"{common} {a}")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in ss.remove_repeats(df, 50).collect())
    assert got == brute(docs, 50) and [r[2] for r in got] == [0, 0, 50]


def test_rows_without_id_whose_texts_share_a_short_hash(spark):
    # two texts with equal hash(): rows without an id are told apart by more than that
    seen, pair = {}, None
    words = " ".join(f"q{i}" for i in range(59))
    for r in spark.range(200_000).selectExpr(f"concat('{words} ', id) as t").selectExpr("t", "hash(t) as h").toLocalIterator():
        if r.h in seen:
            pair = seen[r.h], r.t
            break
        seen[r.h] = r.t
    assert pair
    first = " ".join(f"z{i}" for i in range(60))
    docs = [(None, pair[0]), (None, pair[1]), (1, pair[0]), (2, first)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in ss.remove_repeats(df, 60).collect()), key=repr)
    assert got == brute(docs, 60)
