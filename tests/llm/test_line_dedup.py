import hashlib
import random

import pytest
from pyspark.sql import functions as F

from geotables.llm import line_dedup as ld
from geotables.llm.queries import OP7_SQL, op7_line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, threshold, min_chars):
    first, copies = {}, {}
    for d, t in docs:
        for i, x in enumerate((t or "").split("\n") if t is not None else []):
            if len(x) >= min_chars:
                first[x] = min(first.get(x, (1 << 63, 0)), ((1 << 63) - 1 if d is None else d, i))
                copies[x] = copies.get(x, 0) + 1
    lines = list(first)
    near, degree = {}, {}
    for a in lines:
        for b in lines:
            if first[a] < first[b] and abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold:
                near[b] = min(near.get(b, first[a]), first[a])
                for x in (a, b):
                    degree[x] = degree.get(x, 0) + 1
    out = []
    for d, t in docs:
        ls = t.split("\n") if t is not None else []
        at = lambda i: ((1 << 63) - 1 if d is None else d, i)
        copy = {i for i, x in enumerate(ls) if x in first and first[x] < at(i)}
        close = {i for i, x in enumerate(ls) if x in near and near[x] < at(i)}
        kept = None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in copy | close)
        out.append((d, kept, len(ls), len(copy | close), len(close - copy), sum(degree.get(x, 0) for x in ls)))
    return sorted(out, key=repr)


def spoil(rnd, line, n):
    s = list(line)
    for _ in range(n):
        k = rnd.randrange(3) if s else 0
        i = rnd.randrange(len(s) + (k == 0))
        if k == 0:
            s.insert(i, rnd.choice("abé🙂 "))
        elif k == 1:
            del s[i]
        else:
            s[i] = rnd.choice("abcé🙂 ")
    return "".join(s)


def corpus(seed, min_chars):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("abcdeé🙂 ") for _ in range(n))
    pool = [make(rnd.randint(min_chars - 2, min_chars + 40)) for _ in range(12)]
    pool += [spoil(rnd, rnd.choice(pool), rnd.randint(0, 4)) for _ in range(60)]
    docs = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else make(rnd.randint(0, 60))
                          for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n"), (63, docs[3][1]), (64, "x" * 30_000), (65, "x" * 30_001 + "\nshort")]
    return docs


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_documents_by_brute_force(spark, threshold):
    docs = corpus(threshold, 20)
    small = [d for d in docs if d[0] not in (64, 65)]
    df = spark.createDataFrame([(d, t, "keep", 1) for d, t in small], "doc_id bigint, text string, pos string, n_lines int")
    out = ld.dedup_lines(df, threshold, 20).collect()
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.n_near, r.n_links) for r in out]
    assert sorted(got, key=repr) == brute(small, threshold, 20)
    assert sum(r.n_near for r in out) > 3 and all(r.pos == "keep" for r in out)


def test_long_lines_null_ids_repeated_rows_empty_table(spark):
    rows = [(64, "x" * 30_000), (65, "x" * 30_001 + "\nshort"), (None, "y" * 40), (7, "y" * 40), (7, "y" * 40), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in ld.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(64, "x" * 30_000), (65, "short"), (None, ""), (7, "y" * 40), (7, "y" * 40), (None, None)], key=repr)
    assert ld.dedup_lines(df.limit(0)).collect() == []


def test_bit_parallel_distance_by_brute_force(spark):
    rnd = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("ab🙂") for _ in range(rnd.randint(0, 12)))
        pairs.append((a, spoil(rnd, a, rnd.randint(0, 5)) if a else rnd.choice(["", "a", "ab", "aba"])))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, line_a string, line_b string")
    for threshold in (1, 2, 4):
        want = {i for i, (a, b) in enumerate(pairs) if edits(a, b) <= threshold}
        assert {r.i for r in ld.verified(df, threshold).collect()} == want


def test_native_plan_and_given_table(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    df = op7_line_dedup(spark, sf)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("InArrow", "InPandas", "PythonUDF"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(OP7_SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want)
    assert df.where(F.col("kept_sha256") == hashlib.sha256(b"").hexdigest()).count() >= 0


def test_letters_are_counted_without_counting_characters(spark):
    import re

    from geotables.llm import line_dedup
    texts = ["so ein schöner Tag, und übermorgen gibt es Käse 🧀", "e" * 40, "日本語の長い行です" * 5 + " tea and rice"]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, mark long, text string")
    got = line_dedup.distinct_lines(rows, 2, 16)
    want = {i: sum((t.count(c) & 15) << (4 * k) for k, c in enumerate(line_dedup.LETTERS)) for i, t in enumerate(texts)}
    assert {r.first.doc: r.letters & (2 ** 64 - 1) for r in got.collect()} == want
    assert not re.search(r"(?<!octet_)length\(replace", got._jdf.queryExecution().optimizedPlan().toString())
