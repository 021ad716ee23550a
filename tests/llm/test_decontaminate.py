import random
import re

import pytest

from geotables.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(12)]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            v = split(t)
            if not v or item is None:
                continue
            for i in range(max(1, len(v) - size + 1)):
                p = v[i:i + size]
                for s in range(len(w) - len(p) + 1):
                    if w[s:s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def data(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(WORDS).upper() if rnd.random() < 0.2 else rnd.choice(WORDS) for _ in range(n))
    items = [(i, text(rnd.randint(1, 9))) for i in range(25)] + [(100, None), (101, ""), (102, "!?"), (None, "w1")]
    items += [(3, "w1 w1 w1"), (103, "w2 " * 20), (103, "w2 " * 20)]
    docs = [(i, text(rnd.randint(0, 120))) for i in range(60)]
    docs += [(60, None), (61, " -- "), (62, "w2, " * 300), (62, "w2, " * 300), (None, "w1 W1/w1")]
    docs += [(70 + k, items[k][1]) for k in range(4)] + [(80, "é w1 w1 w1é"), (81, " ".join(items[5][1].split() * 3000))]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, items string"),
            spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, n_words int"))


@pytest.mark.parametrize("group_bytes", [dc.GROUP_BYTES, 600])
def test_windows_against_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(dc, "GROUP_BYTES", group_bytes)
    docs, items = data(5)
    got = dc.contamination(*frames(spark, docs, items), size=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "w1 w2")], [(1, "w1")])
    assert dc.contamination(docs.limit(0), items).collect() == []
    assert [tuple(r) for r in dc.contamination(docs, items.limit(0)).collect()] == [(1, 2, 0, [])]


def test_proximity_against_brute_force(spark):
    docs = [(1, "a b x c a"), (2, "c x x b a"), (3, "a a"), (None, "b a"), (4, None), (5, "c"), (6, "a b")]
    items = [(1, "a b c"), (2, "a a"), (3, "b a")]
    index = dc.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"))
    span = 4
    want = set()
    for d, t in docs:
        w = split(t)
        for i, x in items:
            v = split(x)
            for s in range(len(w)):
                if w[s] in v and all(w[s:s + span].count(y) >= v.count(y) for y in v):
                    want.add((str(i), d, s))
    got = dc.proximity(index, spark.createDataFrame(items, "item_id bigint, text string"), span).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_words_that_a_polynomial_hash_confuses(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    docs, items = [(1, f"x {a} y"), (2, f"x {b} y"), (3, b)], [(7, b)]
    got = dc.contamination(*frames(spark, docs, items), size=13).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == brute(docs, items, 13)
