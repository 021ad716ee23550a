"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are folded to classes (ASCII letters without case, one class for all other ASCII bytes, every other byte its
own) and embedded; filters of widths 2, 3 and 4 run over fixed-length windows, each filter's largest response in the
window goes through a rectifier, and a dense layer with softmax gives the languages. Training is minibatch Adam over
windows of a bounded sample of labelled rows, ``docs_per_lang`` rows of each language (or all, if fewer) with the smallest
hashes of id and text, equal rows counted one by one, with ``windows_per_doc`` windows spread over the whole text; half of the windows are shortened so that short
texts are learned too. Nothing else is sampled: a prediction uses every window of the whole text, and averages their
probabilities weighted by the letters in them.

For prediction a filter is a sum of table rows, one per pair of bytes, so no products are needed per byte.

Defined results: null text, or a text without letters, is ``und`` with score 0; rows without a language teach nothing;
with no labelled row every prediction is ``und`` with score 0; other columns, repeated rows and their order stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import slices, text_bytes, written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
CLASSES = 27 + 128

FOLD = np.zeros(256, np.uint16)
FOLD[ord("a"):ord("z") + 1] = np.arange(1, 27)
FOLD[ord("A"):ord("Z") + 1] = np.arange(1, 27)
FOLD[128:] = np.arange(27, CLASSES)


def windows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts in windows of WINDOW bytes, padded with class 0, and the text of each window."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    n_windows = -(-size // WINDOW)
    first = np.cumsum(n_windows) - n_windows
    out = np.zeros(int(n_windows.sum()) * WINDOW, np.uint16)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], size)] = FOLD[data]
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(size)), n_windows)


@dataclass
class Network:
    """embedding (CLASSES, e); filters by width (w, e, f); dense (3 f, languages) and bias; language names."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    filter_bias: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width, the response of each byte class at each place of the filter."""
        return {w: [(self.embedding @ self.filters[w][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}

    def pair_tables(self) -> dict:
        t = self.tables()
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(-1, a.shape[1]))
        return {2: (pair(*t[2]),), 3: (pair(t[3][0], t[3][1]), t[3][2]), 4: (pair(t[4][0], t[4][1]), pair(t[4][2], t[4][3]))}

    def probabilities(self, x: np.ndarray, pairs: dict) -> np.ndarray:
        """Softmax per window."""
        parts = []
        two = x[:, :-1].astype(np.int32) * CLASSES + x[:, 1:]
        for w in WIDTHS:
            n = WINDOW - w + 1
            response = pairs[w][0].take(two[:, :n], axis=0)
            if w == 3:
                response += pairs[3][1].take(x[:, 2:], axis=0)
            elif w == 4:
                response += pairs[4][1].take(two[:, 2:2 + n], axis=0)
            parts.append(response.max(axis=1))
        h = np.maximum(np.concatenate(parts, axis=1) + self.filter_bias, 0)
        z = h @ self.dense + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01,
          seed: int = 7) -> Network:
    """Adam on the mean cross-entropy of the windows, languages weighted alike."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS
    p = {"e": rng.normal(0, 0.3, (CLASSES, EMBEDDING)), "d": rng.normal(0, 0.2, (len(WIDTHS) * f, k)),
         "b": np.zeros(k), "c": np.zeros(len(WIDTHS) * f)}
    p |= {w: rng.normal(0, 0.5, (w, EMBEDDING, f)) for w in WIDTHS}
    first = {n: np.zeros_like(v) for n, v in p.items()}
    second = {n: np.zeros_like(v) for n, v in p.items()}
    weight = len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            take = order[at:at + batch]
            xb, yb = x[take].copy(), y[take]
            short = rng.random(len(xb)) < 0.5
            size = np.where(short, rng.integers(8, WINDOW, len(xb)), WINDOW)
            xb[np.arange(WINDOW)[None, :] >= size[:, None]] = 0
            m = len(xb)
            tables = {w: [p["e"] @ p[w][j] for j in range(w)] for w in WIDTHS}
            tops, places = [], {}
            for w in WIDTHS:
                n = WINDOW - w + 1
                response = sum(tables[w][j].astype(np.float32).take(xb[:, j:j + n], axis=0) for j in range(w))
                places[w] = response.argmax(axis=1)
                tops.append(np.take_along_axis(response, places[w][:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(tops, axis=1) + p["c"]
            h = np.maximum(raw, 0)
            z = h @ p["d"] + p["b"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(m), yb] -= 1
            z *= (weight[yb] / m)[:, None]
            g = {"d": h.T @ z, "b": z.sum(axis=0)}
            back = (z @ p["d"].T) * (raw > 0)
            g["c"] = back.sum(axis=0)
            g["e"] = np.zeros_like(p["e"])
            for i, w in enumerate(WIDTHS):
                own = back[:, i * f:(i + 1) * f]
                g[w] = np.zeros_like(p[w])
                for j in range(w):
                    hit = xb[np.arange(m)[:, None], places[w] + j]
                    table = np.bincount((hit * f + np.arange(f)).ravel(), weights=own.ravel(),
                                        minlength=CLASSES * f).reshape(CLASSES, f)
                    g[w][j] = p["e"].T @ table
                    g["e"] += table @ p[w][j].T
            step += 1
            now = rate * (0.3 ** (epoch / max(1, epochs - 1)))
            for n in p:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                p[n] = p[n] - now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return Network(p["e"], {w: p[w] for w in WIDTHS}, p["c"].astype(np.float32), p["d"].astype(np.float32),
                   p["b"].astype(np.float32), languages)


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", where: str = "true",
                 docs_per_lang: int = 1500, windows_per_doc: int = 6) -> Network | None:
    """Network learned from a bounded sample (see the module text) of the rows with a language; None without any."""
    known = docs.where(f"{lang} is not null and {text} is not null").where(where)
    known = known.withColumn("__key", F.expr(f"xxhash64(doc_id, doc_id is null, {text}, 4)"))
    # equal rows share a key and teach the same, so a key and the number of its rows say it all
    keys = written(known.groupBy(F.col(lang).alias("lang"), F.col("__key").alias("key")).agg(F.count(F.lit(1)).alias("n")),
                   "language-keys")
    counts = {r[0]: r[1] for r in keys.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    languages = sorted(counts)
    # twice the keys that are needed, in the mean, so that hardly ever too few are left
    below = {k: min(1.0, (2 * docs_per_lang + 100) / counts[k]) for k in languages}
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, below[k])])
    low = keys.where(F.shiftrightunsigned("key", 11) <= F.element_at(share, F.col("lang")) * float(1 << 53))
    taken, room = [], dict.fromkeys(languages, docs_per_lang)
    for r in sorted(low.collect(), key=lambda r: (r.lang, r.key & (1 << 64) - 1)):  # bounded by the parameters
        times = min(r.n, room[r.lang])
        if times:
            taken.append((r.lang, r.key, times))
            room[r.lang] -= times
    wanted = docs.sparkSession.createDataFrame(taken, "__lang string, __key bigint, __times int")
    picked = known.select(F.col(text), F.col(lang), "__key").join(
        F.broadcast(wanted), (F.col(lang) == F.col("__lang")) & (known["__key"] == wanted["__key"])).select(
        text, lang, known["__key"], "__times").dropDuplicates([lang, "__key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x, of = windows_of(part.column(text))
                names, times = part.column(lang).to_pylist(), part.column("__times").to_pylist()
                for i, name in enumerate(names):
                    own = np.flatnonzero(of == i)
                    own = own[np.unique(np.linspace(0, len(own) - 1, min(len(own), windows_per_doc)).astype(int))] \
                        if len(own) else own
                    own = np.tile(own[(x[own] > 0).any(axis=1)], times[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(own), pa.string()), pa.array([x[j].tobytes() for j in own], pa.binary())],
                        ["lang", "x"])

    rows = picked.select(text, lang, "__times").mapInArrow(cut, "lang string, x binary").collect()  # bounded by the parameters
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.uint16) for r in rows])
    place = {name: i for i, name in enumerate(languages)}
    return train(x, np.array([place[r.lang] for r in rows]), languages)


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict_language(docs: DataFrame, network: Network | None, text: str = "text", out: str = "lang_pred",
                     score: str = "score") -> DataFrame:
    """Adds the predicted language and its probability, from all windows of the whole text."""
    docs = docs.drop(out, score)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    known: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if network is not None and not known:
            known["pairs"] = network.pair_tables()
        for batch in batches:
            for part in slices(batch, text):
                n = part.num_rows
                names, scores = ["und"] * n, np.zeros(n)
                if network is not None:
                    x, of = windows_of(part.column(text))
                    total = np.zeros((n, len(network.languages)))
                    for at in range(0, len(x), 512):
                        xs = x[at:at + 512]
                        prob = network.probabilities(xs, known["pairs"]) * (xs > 0).sum(axis=1)[:, None]
                        np.add.at(total, of[at:at + 512], prob)
                    # a text without any of the 26 letters may still hold others; only those are looked at one by one
                    latin = np.zeros(n, bool)
                    latin[of[((x > 0) & (x < 27)).any(axis=1)]] = True
                    texts = part.column(text)
                    for i in range(n):
                        if total[i].sum() > 0 and (latin[i] or has_letters(texts[i].as_py())):
                            best = int(total[i].argmax())
                            names[i], scores[i] = network.languages[best], total[i, best] / total[i].sum()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(np.minimum(scores, 1.0))],
                    [*part.schema.names, out, score])

    return docs.mapInArrow(run, f"{fields}, `{out}` string, `{score}` double")
