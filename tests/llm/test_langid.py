import zlib

import numpy as np
import pyarrow as pa

from geotables.llm.langid import WIDTHS, WINDOW, Network, fit_language, has_letters, predict_language, train, windows_of
from geotables.llm.queries import op4_language_id

SF = "/root/testdata/sf0.01"


def test_windows_cover_whole_texts():
    texts = [None, "", "ab C" * 200, "é" * 300, "x" * WINDOW]
    x, of = windows_of(pa.array(texts))
    assert np.bincount(of, minlength=5).tolist() == [0, 0, 4, 3, 1]
    assert (x[of == 2].ravel()[:4] == [1, 2, 0, 3]).all() and (x[of == 3] > 0).sum() == 600


def test_tables_equal_plain_convolution():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 30, (40, WINDOW)).astype(np.uint16)
    net = train(x, rng.integers(0, 2, 40), ["a", "b"], epochs=1)
    parts = []
    for w in WIDTHS:
        emb = net.embedding[x]
        n = WINDOW - w + 1
        parts.append(sum(emb[:, j:j + n] @ net.filters[w][j] for j in range(w)).max(axis=1))
    h = np.maximum(np.concatenate(parts, axis=1) + net.filter_bias, 0)
    z = h @ net.dense + net.bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.pair_tables()), z / z.sum(axis=1, keepdims=True), atol=1e-4)


def test_held_out_accuracy(spark):
    rows = op4_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]) >= 0.95


def test_nulls_empty_and_texts_without_letters(spark):
    net = train(np.ones((20, WINDOW), np.uint16), np.arange(20) % 2, ["a", "b"], epochs=1)
    assert isinstance(net, Network)
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "12 !? …", 0.1), (4, "日本", 0.1), (4, "日本", 0.1),
                                  (5, "word " * 50_000, 0.1)], "doc_id bigint, text string, score double")
    out = {r.doc_id: r for r in predict_language(docs, net).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[1].score == 0
    assert out[4].lang_pred in "ab" and out[5].lang_pred in "ab" and 0 < out[5].score <= 1
    assert {r.lang_pred for r in predict_language(docs, None).collect()} == {"und"}
    assert fit_language(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")) is None
    assert has_letters("é") and not has_letters("1 _")


def test_sample_is_exact_with_null_and_repeated_ids(spark, monkeypatch):
    import geotables.llm.langid as module
    rows = [(None, f"null row {i}", "aa") for i in range(200)] + [(7, f"same id {i}", "bb") for i in range(200)]
    rows += [(9, "equal rows", "cc")] * 200 + [(i, f"few {i}", "dd") for i in range(5)]
    seen = {}
    monkeypatch.setattr(module, "train", lambda x, y, languages: seen.update(n=np.bincount(y).tolist(), of=languages))
    module.fit_language(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), docs_per_lang=20)
    assert seen == {"n": [20, 20, 20, 5], "of": ["aa", "bb", "cc", "dd"]}
