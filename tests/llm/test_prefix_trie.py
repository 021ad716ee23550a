import hashlib
import random
import zlib

import pytest

from geotables.llm import prefix_trie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, pos string, k1 string"


def brute(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
             for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = convs.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below = children.get(key, [])
        leaves[key] = sum(leaves[b] for b in below) or 1
        saved[key] = own + sum(saved[b] for b in below)
    out = set()
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        out.add((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children.get(key, [])),
                 leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return [tuple(r) for r in T.prefix_trie(df, **kw).collect()]


CONTRACT = {"base": "conv_id - conv_id % 5", "n_inherited": "crc32(cast(conv_id as string)) % 9"}


@pytest.mark.parametrize("band,block", [(8, 4096), (2, 8)])
def test_equals_brute_force(spark, monkeypatch, band, block):
    monkeypatch.setattr(T, "BAND", band)
    monkeypatch.setattr(T, "BLOCK", block)
    rng = random.Random(band)
    rows = []
    for c in [*range(-7, 30), 10**12, 10**12 + 3]:
        long = 40 if c in (3, 4, 20) else 0
        for turn in range(long or rng.randrange(1, 12)):
            text = "same" if long and turn < 35 else rng.choice(["a", "é" * 3, "", None, "x\ny"])
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None]) if not long else "user", text))
    rows += [rows[5]] * 3 + [(None, 1, "user", "lost"), (17, 2, "user", "z" * 200_000)]
    got = run(spark, rows, **CONTRACT)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_plain_trie_turnless_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c"), (5, 0, "user", "a")]
    assert set(run(spark, rows)) == brute(rows, rebuild=False)
    # conversation 1 of h turns or fewer without conversation 0 becomes turnless: the root alone
    assert zlib.crc32(b"1") % 9 > 1
    assert run(spark, rows[:2], **CONTRACT) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert run(spark, [], **CONTRACT) == []


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, "1:a", "bc")]
    assert set(run(spark, rows)) == brute(rows, rebuild=False) and len(run(spark, rows)) == 5
