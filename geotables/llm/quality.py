"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per document, numpy counts over the whole text give the statistics in ``FEATURES`` (shares through a smoothed log-odds,
sizes through log). Learning is one aggregation: every partition of the labelled rows adds up, per class, the number of
rows, the sums and the products of the statistics, and Spark adds these few rows together; no row is sampled and
nothing that grows with the data reaches the driver. Class covariances are shrunk towards the pooled covariance and
that towards its diagonal, their Cholesky factors are computed once and kept in the model. The score of a document is
the logistic function of the tempered difference of the two Gaussian log densities (Mahalanobis distances by
triangular solves) plus a fixed prior log-odds. The temperature, the dimension-wise overconfidence of a Gaussian model, is a
parameter.

Defined results: null text counts as empty; an empty text has the statistics of zero words and is scored like any
other; label rows with null id or label, or whose document is absent, teach nothing; repeated document rows are scored
row by row; a class without rows, or an empty table, gives the prior score everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geotables.llm.common import BYTE_VALUES, SPACES, RunHash, mix, slices, text_bytes, word_spans

FEATURES = ["words", "word_length", "word_length_spread", "upper", "digit", "sign", "stop", "comma", "sign_words",
            "sign_ends", "repeat_next", "repeat_second", "distinct", "line_words", "line_repeats", "long_words",
            "other_bytes", "upper_words", "top_byte"]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _table("abcdefghijklmnopqrstuvwxyz")
DIGIT = _table("0123456789")
STOP = _table(".!?")
COMMA = _table(",;:")
SIGN = ~(UPPER | LOWER | DIGIT | _table(" \t\n\v\f\r.,")) & (np.arange(256) < 128)
_HASH = RunHash(11)


def _share(part: np.ndarray, whole: np.ndarray, prior: float = 0.02) -> np.ndarray:
    """Log-odds of a share, drawn towards ``prior`` by two pseudo-counts."""
    p = (part + 2 * prior) / (whole + 2)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, offsets = text_bytes(column)
    n_rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, rows = word_spans(data, offsets, SPACES)

    def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=n_rows)

    def byte_sum(mask_table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask_table[data], dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    ones = np.ones(len(rows))
    words = per_row(ones, rows)
    length = (ends - starts).astype(float)
    mean = per_row(length, rows) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(per_row(length * length, rows) / np.maximum(words, 1) - mean * mean, 0))
    upper_to = np.concatenate([[0], np.cumsum(UPPER[data], dtype=np.int64)])
    sign_to = np.concatenate([[0], np.cumsum(SIGN[data], dtype=np.int64)])
    upper_words = (upper_to[ends] - upper_to[starts]) >= 2
    sign_count = sign_to[ends] - sign_to[starts]
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    keys = _HASH.runs(_HASH.prefix(BYTE_VALUES[data]), starts, ends)
    next_same = np.zeros(len(keys), bool)
    next_same[1:] = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])
    second_same = np.zeros(len(keys), bool)
    second_same[2:] = (keys[2:] == keys[:-2]) & (rows[2:] == rows[:-2])
    own = np.unique(mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    distinct = per_row(np.ones(len(own)), rows[own])
    line_starts, line_ends, line_rows = word_spans(data, offsets, np.arange(256) != 10)
    lines = per_row(np.ones(len(line_rows)), line_rows)
    line_keys = _HASH.runs(_HASH.prefix(BYTE_VALUES[data]), line_starts, line_ends)
    line_own = np.unique(mix(line_keys ^ mix(line_rows.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    line_distinct = per_row(np.ones(len(line_own)), line_rows[line_own])
    non_space = np.maximum(size - byte_sum(~SPACES), 0)
    # the share of the commonest word-final byte among words
    ends_key = np.unique(rows * 256 + last, return_counts=True)
    top = np.zeros(n_rows)
    np.maximum.at(top, ends_key[0] // 256, ends_key[1].astype(float))
    out = np.column_stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread),
        _share(byte_sum(UPPER), non_space), _share(byte_sum(DIGIT), non_space), _share(byte_sum(SIGN), non_space),
        _share(byte_sum(STOP), words, 0.1), _share(byte_sum(COMMA), words, 0.1),
        _share(per_row((sign_count == length).astype(float), rows), words),
        _share(per_row(SIGN[last].astype(float), rows), words),
        _share(per_row(next_same.astype(float), rows), words), _share(per_row(second_same.astype(float), rows), words),
        np.log((distinct + 1) / (words + 1)) / np.log(words + 3), np.log((words + 1) / (lines + 1)),
        _share(lines - line_distinct, lines), _share(per_row((length > 20).astype(float), rows), words),
        _share(byte_sum(np.arange(256) >= 128), non_space),
        _share(per_row(upper_words.astype(float), rows), words), _share(top, words, 0.3)])
    return out


@dataclass
class Model:
    """Fitted classes: means and lower Cholesky factors of the shrunk covariances, and their log determinants."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    prior: float
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            y = np.linalg.solve(factor, (z - mean).T)
            logs.append(-0.5 * ((y * y).sum(axis=0) + log_det))
        d = np.clip((logs[1] - logs[0]) / self.temperature + self.prior, -40, 40)
        return 1 / (1 + np.exp(-d))


def class_sums(x: np.ndarray, label: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    return [(k, int((label == k).sum()), x[label == k].sum(axis=0), x[label == k].T @ x[label == k])
            for k in (0, 1) if (label == k).any()]


def fit_from_sums(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink_class: float, shrink_diagonal: float,
                  prior: float, temperature: float) -> Model:
    """Model from (rows, sum, sum of products) per class."""
    p = len(FEATURES)
    if any(sums.get(k, (0,))[0] < 2 for k in (0, 1)):
        return Model(np.zeros((0, p)), np.zeros((0, p, p)), np.zeros(0), np.zeros(p), np.ones(p), prior, temperature)
    n = sum(s[0] for s in sums.values())
    centre = sum(s[1] for s in sums.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n - centre**2, 1e-6))
    means, covs = [], []
    for k in (0, 1):
        m, total, products = sums[k]
        mu = total / m
        covs.append((products / m - np.outer(mu, mu)) / np.outer(scale, scale))
        means.append((mu - centre) / scale)
    pooled = sum(sums[k][0] * covs[k] for k in (0, 1)) / n
    factors, dets = [], []
    for cov in covs:
        mixed = (1 - shrink_class) * cov + shrink_class * pooled
        mixed = (1 - shrink_diagonal) * mixed + shrink_diagonal * np.diag(np.diag(pooled)) + 1e-4 * np.eye(p)
        factor = np.linalg.cholesky(mixed)
        factors.append(factor)
        dets.append(2 * np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(factors), np.array(dets), centre, scale, prior, temperature)


SHRINK_CLASS, SHRINK_DIAGONAL, TEMPERATURE = 0.3, 0.2, 4.0
PRIOR_LOG_ODDS = 1.7


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """Adds the transformed statistics of the whole text as array<double>."""
    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = statistics(part.column(text))
                ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, out])

    return docs.mapInArrow(run, f"{fields}, `{out}` array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(FEATURES))


def fit_quality(stats: DataFrame, labels: DataFrame, label: str = "quality", where: str = "true",
                shrink_class: float = SHRINK_CLASS, shrink_diagonal: float = SHRINK_DIAGONAL,
                prior: float = PRIOR_LOG_ODDS, temperature: float = TEMPERATURE) -> Model:
    """Model learned from all rows of ``stats`` (doc_id, statistics) that have a label and meet ``where``."""
    known = labels.where(f"{label} in (0, 1)").selectExpr("doc_id", f"cast({label} as int) as k")
    # a shuffled join at every size: the sums run in a stage, and in Python workers, of their own
    rows = stats.select("doc_id", "statistics").where(where).join(known.hint("merge"), "doc_id").select("k", "statistics")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("statistics"))
                for k, n, s, products in class_sums(x, np.asarray(batch.column("k"))):
                    total[k] = total.get(k, 0) + np.concatenate([[n], s, products.ravel()])
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()])], ["k", "sums"])

    sums = (rows.mapInArrow(add_up, "k int, sums array<double>")
            .selectExpr("k", "posexplode(sums) as (place, value)")
            .groupBy("k", "place").agg({"value": "sum"}).toDF("k", "place", "value").collect())
    p = len(FEATURES)
    size = 1 + p + p * p
    vectors: dict[int, np.ndarray] = {}
    for r in sums:  # two classes, 1 + p + p * p numbers each
        vectors.setdefault(r.k, np.zeros(size))[r.place] = r.value
    return fit_from_sums({k: (int(v[0]), v[1:1 + p], v[1 + p:].reshape(p, p)) for k, v in vectors.items()},
                         shrink_class, shrink_diagonal, prior, temperature)


def score_quality(stats: DataFrame, model: Model, statistics_column: str = "statistics", out: str = "score") -> DataFrame:
    """Replaces the statistics by ``out``, the probability of label 1."""
    kept = stats.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields
                       if f.name != statistics_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != statistics_column]
            s = model.scores(_matrix(batch.column(statistics_column))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s, pa.float64())],
                                             [*names, out])

    return kept.mapInArrow(run, f"{fields}, `{out}` double")


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1, statistics and score in one pass over the texts."""
    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                s = model.scores(statistics(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, out])

    return docs.mapInArrow(run, f"{fields}, `{out}` double")
