"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: A-Z lower-cased, words between white space, shingles of ``size`` words (repeats included, joined by one
space; fewer words are one shingle), XXH64 with seed 42 of each; a bit is 1 if set in over half of them. A text without
words has fingerprint zero.

Documents with equal fingerprints are grouped first, so a group of copies is one node however large it is. Links between
different fingerprints that differ in at most ``distance`` bits are found like this:

* The correlations of the 64 bits (one sum over all fingerprints) group them into ``parts`` partitions, correlated bits
  together. How many partitions there are follows from the number of fingerprints by the cost of probes and candidates.
* Two fingerprints within ``distance`` agree up to t_i bits in at least one partition i, for any thresholds that add up to
  distance - parts + 1 (t_i = -1: the partition isn't probed). Each fingerprint gets the thresholds that minimise its
  estimated candidates and probes, by dynamic programming over the partitions; the estimates are ball sums over a
  histogram of each partition's values (at most 2^16 of them, so its size has a bound).
* Every fingerprint is stored under its value in each partition and probes all values within t_i of its own. Pairs of a
  probe and a stored fingerprint that meet are verified by their full distance.

Buckets are worked on in the tasks that get them; of the links of one large bucket only a spanning forest comes out, which
has the same connected components. A bucket with more than ``BUCKET_ROWS`` stored fingerprints or probes, both counted, is split into chunks of stored and
of probing fingerprints, each pair of chunks a bucket of its own, so no task needs more than two chunks at once.
Components come from alternating large-star and small-star steps on the links, each written to the shared folder.

Defined results: rows with a null doc_id get the component of their fingerprint, and null if it has no other id; repeated
rows are kept; null text has fingerprint zero; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import SPACES, mix, slices, text_bytes, word_spans, written

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
FOLD[9:14] = 32
NO_ID = (1 << 63) - 1
BUCKET_ROWS = 8192
PAIR_COST = 0.02  # of verifying a candidate, in probe rows
HISTOGRAM_BITS = 16
PAIRS_AT_ONCE = 1 << 20
_RUN = 60_000  # shingles that four 16-bit counters in one integer can count
_SPREAD = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)


def fingerprints(column: pa.Array, size: int) -> np.ndarray:
    """One 64-bit fingerprint per text."""
    data, offsets = text_bytes(column)
    n_rows = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets, SPACES)
    if not len(starts):
        return np.zeros(n_rows, np.uint64)
    # words with one space between them: white space that does not directly follow a word goes
    word = SPACES[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.cumsum(keep) - keep
    joined = FOLD[data[keep]].tobytes()
    words = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(words) - words
    shingles = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    of = np.repeat(np.arange(n_rows), shingles)
    begin = np.cumsum(shingles) - shingles
    a = first[of] + np.arange(len(of)) - begin[of]
    b = a + np.minimum(size, words[of]) - 1
    digest = xxhash.xxh64_intdigest
    left, right = at[starts[a]].tolist(), (at[ends[b] - 1] + 1).tolist()
    hashes = np.fromiter((digest(joined[x:y], 42) for x, y in zip(left, right, strict=True)), np.uint64, len(left))
    # majority per bit: four counters at a time, over runs short enough not to overflow
    cuts = np.unique(np.concatenate([begin[shingles > 0], np.arange(0, len(of), _RUN)]))
    owner = of[cuts]
    out = np.zeros(n_rows, np.uint64)
    for nibble in range(16):
        sums = np.add.reduceat(_SPREAD[((hashes >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.intp)], cuts)
        for bit in range(4):
            count = np.bincount(owner, ((sums >> np.uint64(16 * bit)) & np.uint64(0xFFFF)).astype(float), n_rows)
            out |= (count * 2 > shingles).astype(np.uint64) << np.uint64(4 * nibble + bit)
    return out


def with_fingerprint(docs: DataFrame, size: int = 4, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """doc_id and the fingerprint of the text as bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                f = fingerprints(part.column(text), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(f)], ["doc_id", out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, `{out}` bigint")


def bit_correlations(groups: DataFrame) -> np.ndarray:
    """64 x 64 correlations of the bits over all fingerprints."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 64 + 64 * 64)
        for batch in batches:
            f = np.asarray(batch.column("f")).view(np.uint64)
            for at in range(0, len(f), 1 << 16):
                bits = ((f[at:at + (1 << 16), None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += np.concatenate([[len(bits)], bits.sum(axis=0, dtype=np.float64), (bits.T @ bits).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

    rows = (groups.select("f").mapInArrow(add_up, "sums array<double>").selectExpr("posexplode(sums) as (place, value)")
            .groupBy("place").agg(F.sum("value").alias("value")).collect())
    total = np.zeros(1 + 64 + 64 * 64)
    for r in rows:
        total[r.place] = r.value
    n = max(total[0], 1)
    mean = total[1:65] / n
    cov = total[65:].reshape(64, 64) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return cov / np.outer(sd, sd)


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of (nearly) equal width; each starts from the strongest pair left and takes the bit most correlated
    with it until it is full."""
    left = list(range(64))
    strength = np.abs(correlation)
    np.fill_diagonal(strength, 0)
    out = []
    for i in range(parts):
        width = -(-len(left) // (parts - i))
        own = [left[int(np.argmax(strength[np.ix_(left, left)].max(axis=1)))]]
        left.remove(own[0])
        while len(own) < width:
            own.append(left[int(np.argmax(strength[np.ix_(left, own)].sum(axis=1)))])
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bits of one value."""
    total, now = 0, 1
    for k in range(radius + 1):
        total += now
        now = now * (width - k) // (k + 1)
    return total


def number_of_parts(n: int, distance: int) -> int:
    """The number of partitions, 2 at least, at which equal thresholds cost least for n fingerprints."""

    def cost(parts: int) -> float:
        budget, total = distance - parts + 1, 0.0
        for i in range(parts):
            t = budget // parts + (i < budget % parts)
            if t >= 0:
                width = 64 // parts
                total += ball(width, t) * (1 + PAIR_COST * n / 2.0**width)
        return total

    return min(range(2, distance + 2), key=cost) if distance >= 1 else 1


class Plan:
    """Partitions, ball sums of their histograms, and chunk numbers of large buckets."""

    def __init__(self, bits: list[list[int]], distance: int, histograms: list[np.ndarray],
                 probes: list[np.ndarray] | None = None):
        self.bits, self.distance = bits, distance
        self.probes = histograms if probes is None else probes
        self.widths = [len(b) for b in bits]
        self.histograms = histograms
        self.sums = []
        for width, h in zip(self.widths, histograms, strict=True):
            shells = np.zeros((distance + 1, len(h)))
            shells[0] = h
            for bit in range(min(width, HISTOGRAM_BITS)):
                flipped = np.arange(len(h)) ^ (1 << bit)
                shells[1:] = shells[1:] + shells[:-1][:, flipped]
            self.sums.append(np.cumsum(shells, axis=0))

    def values(self, f: np.ndarray, part: int) -> np.ndarray:
        v = np.zeros(len(f), np.int64)
        for place, bit in enumerate(self.bits[part]):
            v |= ((f >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
        return v

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """Per fingerprint and partition, the threshold; -1 says that the partition isn't probed."""
        parts, tau = len(self.bits), self.distance
        n, room = len(values[0]), tau + 1  # thresholds plus one add up to this
        cost = np.full((parts, room + 1, n), np.inf)
        for i in range(parts):
            cost[i, 0] = 0
            for t in range(min(room, self.widths[i] + 1)):
                spread = ball(self.widths[i], t)
                short = values[i] & ((1 << min(self.widths[i], HISTOGRAM_BITS)) - 1)
                estimate = self.sums[i][min(t, tau), short]
                if self.widths[i] > HISTOGRAM_BITS:  # the histogram sees some of the bits only
                    estimate = np.maximum(estimate / 2.0 ** (self.widths[i] - HISTOGRAM_BITS), 1)
                cost[i, t + 1] = spread + PAIR_COST * estimate
        best = np.full((parts + 1, room + 1, n), np.inf)
        best[0, 0] = 0
        choice = np.zeros((parts, room + 1, n), np.int8)
        for i in range(parts):
            for b in range(room + 1):
                for s in range(b + 1):
                    c = best[i, b - s] + cost[i, s]
                    better = c < best[i + 1, b]
                    best[i + 1, b][better] = c[better]
                    choice[i, b][better] = s
        out = np.zeros((n, parts), np.int64)
        left = np.full(n, room)
        for i in range(parts - 1, -1, -1):
            s = choice[i, left, np.arange(n)]
            out[:, i] = s - 1
            left -= s
        return out

    def flips(self, part: int, threshold: int) -> np.ndarray:
        """All masks of 1 to ``threshold`` bits of a partition."""
        from itertools import combinations
        w = self.widths[part]
        return np.array([sum(1 << b for b in c) for k in range(1, threshold + 1) for c in combinations(range(w), k)], np.int64)

    def chunks(self, part: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of the stored fingerprints and of the probes of each value's bucket."""
        short = values & ((1 << min(self.widths[part], HISTOGRAM_BITS)) - 1)
        return tuple(np.maximum(-(-h[part][short] // BUCKET_ROWS), 1) for h in (self.histograms, self.probes))


STORED, PROBE = 1, 2


def probes(plan: Plan, f: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, places in f, values) of all probes of other values than a fingerprint's own."""
    values = [plan.values(f, i) for i in range(len(plan.bits))]
    t = plan.thresholds(values)
    for i, v in enumerate(values):
        for radius in np.unique(t[:, i][t[:, i] > 0]).tolist():
            who = np.flatnonzero(t[:, i] == radius)
            masks = plan.flips(i, radius)
            step = max(1, (1 << 18) // len(masks))
            for at in range(0, len(who), step):
                w = who[at:at + step]
                yield i, np.repeat(w, len(masks)), (v[w][:, None] ^ masks[None, :]).ravel()


def probe_histograms(groups: DataFrame, plan: Broadcast) -> list[np.ndarray]:
    """Like the histograms, of the probes that come to each value, its own fingerprints' included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_, sums = plan.value, [np.zeros(len(h), np.int64) for h in plan.value.histograms]
        for batch in batches:
            f = np.asarray(batch.column("f")).view(np.uint64)
            for at in range(0, len(f), 1 << 15):
                for i, _, target in probes(plan_, f[at:at + (1 << 15)]):
                    sums[i] += np.bincount(target & (len(sums[i]) - 1), minlength=len(sums[i]))
        for i, h in enumerate(sums):
            own = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(own), pa.array(h[own])],
                                             ["part", "value", "n"])

    out = [h.copy() for h in plan.value.histograms]
    counted = groups.select("f").mapInArrow(count, "part int, value bigint, n bigint").groupBy("part", "value")
    for r in counted.agg(F.sum("n").alias("n")).collect():  # at most 2^16 values of each partition
        out[r["part"]][r["value"]] += r["n"]
    return out


def bucket_rows(plan: Plan, f: np.ndarray, d: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Columns part, value, chunk of stored, chunk of probes, kind (1 stored, 2 probe, 3 both), f, d."""
    values = [plan.values(f, i) for i in range(len(plan.bits))]
    t = plan.thresholds(values)
    spread = mix(f).view(np.int64) & 0x7FFFFFFF
    for i, v in enumerate(values):
        held, asking = plan.chunks(i, v)
        small = (held == 1) & (asking == 1)
        zero = np.zeros(int(small.sum()), np.int64)
        yield [np.full(len(zero), i), v[small], zero, zero, STORED + PROBE * (t[small, i] >= 0), f[small], d[small]]
        yield from _chunked(i, v, held, asking, spread, f, d, np.flatnonzero(~small), STORED)
        yield from _chunked(i, v, held, asking, spread, f, d, np.flatnonzero(~small & (t[:, i] >= 0)), PROBE)
    for i, q, target in probes(plan, f):
        held, asking = plan.chunks(i, target)
        yield from _chunked(i, target, held, asking, spread[q], f[q], d[q], np.arange(len(q)), PROBE)


def _chunked(part: int, value: np.ndarray, held: np.ndarray, asking: np.ndarray, spread: np.ndarray, f: np.ndarray,
             d: np.ndarray, rows: np.ndarray, kind: int) -> Iterator[list[np.ndarray]]:
    """The given rows in buckets of held x asking chunk pairs, some at a time: a fingerprint is stored in one chunk, beside all
    chunks of probes, and probes from one chunk, beside all chunks of stored ones."""
    copies = (asking if kind == STORED else held)[rows]
    upto = np.cumsum(copies)
    at = 0
    while at < len(rows):
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + (1 << 18), side="right")))
        k = copies[at:to]
        r = np.repeat(rows[at:to], k)
        other = np.arange(len(r)) - np.repeat(np.cumsum(k) - k, k)
        a, b = (spread[r] % held[r], other) if kind == STORED else (other, spread[r] % asking[r])
        yield [np.full(len(r), part), value[r], a, b, np.full(len(r), kind), f[r], d[r]]
        at = to


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(f: np.ndarray, stored: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket, found block by block."""
    parent = np.arange(len(f))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    out = []
    step = max(1, PAIRS_AT_ONCE // max(1, len(stored)))
    for at in range(0, len(probes), step):
        p = probes[at:at + step]
        near = popcount(f[p][:, None] ^ f[stored][None, :]) <= distance
        x, y = np.nonzero(near)
        # only links between parts that earlier blocks left apart are looked at one by one
        top = np.array([root(i) for i in range(len(f))]) if len(x) > len(f) else None
        if top is not None:
            apart = top[p[x]] != top[stored[y]]
            x, y = x[apart], y[apart]
        for a, b in zip(p[x].tolist(), stored[y].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def bucket_links(columns: list[np.ndarray], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of linked rows in whole buckets that stand one after the other."""
    part, value, a, b, kind, f, _ = columns
    n = len(f)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    bucket = np.cumsum(new) - 1
    is_stored, is_probe = (kind & STORED) > 0, (kind & PROBE) > 0
    n_stored = np.bincount(bucket, is_stored, minlength=bucket[-1] + 1).astype(np.int64)
    n_probe = np.bincount(bucket, is_probe, minlength=bucket[-1] + 1).astype(np.int64)
    left, right = [], []
    stored_at, probe_at = np.flatnonzero(is_stored), np.flatnonzero(is_probe)
    stored_first = np.cumsum(n_stored) - n_stored
    small = n_stored * n_probe <= 4096
    # small buckets: all probes against the stored ones of their bucket, some pairs at a time
    p = probe_at[small[bucket[probe_at]]]
    sizes = n_stored[bucket[p]]
    upto = np.cumsum(sizes)
    at = 0
    while at < len(p):
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, side="right")))
        own, k = p[at:to], sizes[at:to]
        x = np.repeat(own, k)
        y = stored_at[np.arange(int(k.sum())) + np.repeat(stored_first[bucket[own]] - (np.cumsum(k) - k), k)]
        ok = (f[x] != f[y]) & (popcount(f[x] ^ f[y]) <= distance)
        left.append(x[ok])
        right.append(y[ok])
        at = to
    begins = np.append(np.flatnonzero(new), n)
    for i in np.flatnonzero(~small):
        lo, hi = begins[i], begins[i + 1]
        s, q = np.flatnonzero(is_stored[lo:hi]), np.flatnonzero(is_probe[lo:hi])
        pairs = _forest(f[lo:hi], s, q, distance)
        if pairs:
            x, y = np.array(pairs).T
            left.append(lo + x)
            right.append(lo + y)
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def links(groups: DataFrame, distance: int, parts: int | None = None) -> DataFrame:
    """(a, b) structs (d, f) of fingerprints within the distance; connected like all such pairs."""
    n = groups.count()
    bits = group_bits(bit_correlations(groups), parts or number_of_parts(n, distance))
    masks = [[(place, bit) for place, bit in enumerate(own)] for own in bits]
    value = lambda own: " | ".join(f"shiftleft(shiftrightunsigned(f, {bit}) & 1L, {place})" for place, bit in own)
    counted = groups.selectExpr(
        "f", "posexplode(array(" + ", ".join(value(own[:HISTOGRAM_BITS]) for own in masks) + ")) as (part, value)")
    histograms = [np.zeros(1 << min(len(own), HISTOGRAM_BITS), np.int64) for own in bits]
    for r in counted.groupBy("part", "value").count().collect():  # at most 2^16 values of each partition
        histograms[r["part"]][r["value"]] = r["count"]
    context = groups.sparkSession.sparkContext
    plan = context.broadcast(Plan(bits, distance, histograms))
    plan = context.broadcast(Plan(bits, distance, histograms, probe_histograms(groups, plan)))
    names = ["part", "value", "ca", "cb", "kind", "f", "d"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    schema = "part int, value bigint, ca int, cb int, kind int, f bigint, d bigint"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, d = np.asarray(batch.column("f")).view(np.uint64), np.asarray(batch.column("d"))
            for at in range(0, len(f), 1 << 15):
                for columns in bucket_rows(plan.value, f[at:at + (1 << 15)], d[at:at + (1 << 15)]):
                    columns[5] = columns[5].astype(np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in
                                                      zip(columns, types, strict=True)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            x, y = bucket_links([*columns[:5], columns[5].view(np.uint64), columns[6]], distance)
            f, d = columns[5], columns[6]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (d[x], f[x], d[y], f[y])], ["ad", "af", "bd", "bf"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(c)) for c in names]
            key = np.column_stack(columns[:4]).astype(np.int64)
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            if last:  # a bucket ended in this batch: all before the last one are whole
                yield found([np.concatenate([*(h[i] for h in held), c[:last]]) for i, c in enumerate(columns)])
                held = []
            elif held and any(held[0][i][0] != columns[i][0] for i in range(4)):
                yield found([np.concatenate([h[i] for h in held]) for i in range(7)])
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield found([np.concatenate([h[i] for h in held]) for i in range(7)])

    dealt = groups.select("f", "d").mapInArrow(deal, schema)
    met = dealt.repartition("part", "value", "ca", "cb").sortWithinPartitions("part", "value", "ca", "cb")
    return met.mapInArrow(meet, "ad bigint, af bigint, bd bigint, bf bigint").selectExpr(
        "struct(ad as d, af as f) as a", "struct(bd as d, bf as f) as b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected to each node of the edges (a, b), by alternating star steps."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.selectExpr("b as a", "a as b"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(edges.where("a <> b"), "links")
    before = None
    while True:
        # large star: each larger neighbour of a node is tied to the smallest node around it
        sides = both(edges)
        least = sides.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = (sides.join(least, "a").where("b > a").selectExpr("b as a", "m as b").where("a <> b").distinct())
        large = written(large, "large-star")
        # small star: a node and its smaller neighbours are tied to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b"))
                 .where("a <> b").distinct())
        edges = written(small, "small-star")
        now = state(edges)
        if now == before:
            return edges.selectExpr("a as node", "b as root")
        before = now


def simhash_components(docs: DataFrame, size: int = 4, distance: int = 4, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (bigint), component_id (the smallest doc_id reachable through links), one row per document."""
    prints = written(with_fingerprint(docs, size, text), "simhash")
    groups = written(prints.groupBy(F.col("fingerprint").alias("f")).agg(
        F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("d")), "simhash-groups")
    found = components(links(groups, distance)).selectExpr("node.f as f", "root.d as root")
    named = written(groups.join(found, "f", "left").selectExpr(
        "f as fingerprint", f"nullif(coalesce(root, d), {NO_ID}) as component_id"), "simhash-named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")
