import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from geotables.llm.common import written
from geotables.llm.quality import class_sums, fit_from_sums, statistics
from geotables.llm.quality import PRIOR_LOG_ODDS, SHRINK_CLASS, SHRINK_DIAGONAL, TEMPERATURE
from geotables.llm.queries import tokenizer_path

import test_decontaminate as by_window
import test_line_dedup as by_line
import test_simhash as by_bits

SF = "/root/testdata/sf0.001"


def test_every_stage_by_brute_force_on_its_own_input(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = written(stage(spark, docs, SF), f"test-{name}")
        seen[name] = before, [r.asDict() for r in docs.collect()]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(r) == columns for name in list(seen)[:-1] for r in seen[name][1])

    before, after = seen["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    x = statistics(pa.array([r["text"] for r in before]))
    known = [i for i, r in enumerate(before) if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    sums = class_sums(x[known], np.array([labels[before[i]["doc_id"]] for i in known]))
    scores = fit_from_sums({k: (n, s, p) for k, n, s, p in sums}, SHRINK_CLASS, SHRINK_DIAGONAL, PRIOR_LOG_ODDS,
                           TEMPERATURE).scores(x)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, s in zip(before, scores, strict=True) if s >= 0.7}

    before, after = seen["lines"]
    want = {}
    for d, text, _, removed, _, _ in by_line.brute([(r["doc_id"], r["text"]) for r in before], cp.LINE_EDITS, cp.LINE_CHARS):
        if not removed or text.split():
            want[d] = text
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)

    before, after = seen["near_copies"]
    nodes = [(r["doc_id"], by_bits.fingerprint(r["text"])) for r in before]
    of = by_bits.component_ids(nodes, 4)
    assert {r["doc_id"] for r in after} == {d for d, f in nodes if of[f] == d}

    before, after = seen["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = by_window.brute([(r["doc_id"], r["text"]) for r in before], items, 13)
    assert {r["doc_id"] for r in after} == {d for d, n, hit, _ in found if not (hit and 20 * hit >= n)}

    before, after = seen["tokens"]
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in before}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in after} == {
        d: lib.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    assert len(after) > 0.5 * spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_with_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "a b", "en", "s", 3),
            (3, "a b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert cp.line_stage(spark, docs, SF).count() == 5
    assert sorted(r.doc_id for r in cp.simhash_stage(spark, docs.where("doc_id is not null"), SF).collect()) == [1, 3]


def test_rows_with_null_or_repeated_ids_are_judged_one_by_one(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = lambda rows: spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], kind)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    passage = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 13)
    clean = [(None, "a clean text without an id"), (None, "another clean text"), (5, "clean text of an id that comes again")]
    bad = [(None, passage), (5, passage), (6, passage)]
    assert texts(cp.benchmark_stage(spark, frame(clean + bad), SF)) == sorted(clean, key=repr)

    words = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(4)]
    near = lambda t: t + " end"
    rows = [(None, words[0]), (None, near(words[0])), (None, words[1]), (4, near(words[1])), (5, words[2]), (5, near(words[2])),
            (5, words[3])]
    got = texts(cp.simhash_stage(spark, frame(rows), SF))
    assert len(got) == 4 and (4, near(words[1])) in got and (5, words[3]) in got
    assert sorted((d is None, t[:4]) for d, t in got) == [(False, "w1x0"), (False, "w2x0"), (False, "w3x0"), (True, "w0x0")]
