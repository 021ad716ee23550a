import numpy as np

from geotables.llm.nearest import nearest
from geotables.llm.queries import op10_nearest

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank string"


def brute(ids, x, query_ids, k):
    out = {}
    for q in query_ids:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        keep = ids != q
        best = np.lexsort((ids[keep], d[keep]))[:k]
        out[int(q)] = [(int(ids[keep][i]), float(d[keep][i])) for i in best]
    return out


def run(spark, ids, x, where="vec_id % 10 = 0", **kw):
    df = spark.createDataFrame([(int(i), v if v is None else [None if c is None else float(c) for c in v], "s", "r")
                                for i, v in zip(ids, x, strict=True)], SCHEMA)
    out = {}
    for r in nearest(df, where, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    ids = rng.permutation(5000)[:1500]
    want = brute(ids, x.astype(float), ids[ids % 10 == 0], 10)
    got = run(spark, ids, x, rows_per_shard=400)
    assert got.keys() == want.keys()
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    by = dict(zip(ids.tolist(), x.astype(float), strict=True))
    for q, rows in got.items():
        assert len(rows) == 10 and all(abs(s - np.linalg.norm(by[q] - by[a])) < 1e-12 for a, s in rows)


def test_copies_and_ties_go_to_smaller_ids(spark):
    v = [0.5, -1.0, 0.25]
    ids = [*range(0, 120), 200]
    got = run(spark, ids, [v] * 120 + [[9.0, 9.0, 9.0]], rows_per_shard=50)
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[50] == [(i, 0.0) for i in range(10)]


def test_unusable_vectors_few_candidates_other_lengths(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], None, [0, 0], [nan, 1], [1, inf], [None, 1], [], [2, 0], [1, 0, 0], [2, 0]]
    ids = [10, 1, 2, 3, 4, 5, 6, 7, 8, 7]
    assert run(spark, ids, x) == {10: [(7, 1.0)]}
    assert run(spark, [20], [[1, 0]]) == {}
    assert run(spark, [], []) == {}


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, ids[ids % 100 == 0], 10)
    got = {}
    for r in op10_nearest(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
