import zlib

import numpy as np
import pyarrow as pa

from geotables.llm.quality import FEATURES, class_sums, fit_from_sums, fit_quality, score_quality, statistics, \
    with_statistics
from geotables.llm.queries import op3_quality_classifier

SF = "/root/testdata/sf0.01"


def test_statistics_are_finite_and_do_not_depend_on_neighbours():
    texts = [None, "", " \n ", "a", "A!! B!! C", "word " * 30_000, "é|è | ###", "x\ny\nx"]
    x = statistics(pa.array(texts))
    assert x.shape == (len(texts), len(FEATURES)) and np.isfinite(x).all()
    assert np.allclose(x[0], x[1])
    for i, t in enumerate(texts):
        assert np.allclose(statistics(pa.array([t], pa.string()))[0], x[i])


def test_density_difference_by_brute_force():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(FEATURES)))
    y = (rng.random(400) < 0.7).astype(int)
    x[y == 1] *= 1.5
    m = fit_from_sums({k: (n, s, p) for k, n, s, p in class_sums(x, y)}, 0.3, 0.2, 1.0, 2.0)
    z = (x - m.centre) / m.scale
    logs = []
    for k in (0, 1):
        cov = m.factors[k] @ m.factors[k].T
        d = z - m.means[k]
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 2 + 1, -40, 40))))


def test_held_out_accuracy(spark):
    rows = op3_quality_classifier(spark, SF).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([a == b for a, b in held]) >= 0.93


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x y", 0.5), (2, "", 0.5)],
                                 "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 0)], "doc_id bigint, quality int")
    stats = with_statistics(docs)
    out = score_quality(stats, fit_quality(stats, labels)).collect()
    assert len(out) == 4 and len({r.score for r in out}) == 1
    assert score_quality(stats.limit(0), fit_quality(stats.limit(0), labels)).collect() == []
