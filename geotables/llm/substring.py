"""Removal of repeated passages with a compressed FM-index per shard.

A window is ``window`` consecutive words of one document; a word is removed if a window that covers it also starts in a
document with a smaller id, judged on the input.

1. Segments. The windows of a document are grouped by an anchor, the smallest hash of the ``anchor``-word runs inside the
   window. Equal windows have equal anchors, wherever they stand, so windows need to be compared within an anchor only.
   Neighbouring windows of one anchor make one segment. Anchors that occur in one document only are dropped, and equal
   segments are brought together (smallest document id first) before any text moves, so copies and passages that
   thousands of documents share are one segment.
2. Shards. The words of each distinct segment are cut from the first document that holds it and dealt to shards by anchor.
   An anchor with more than ``HOT_SEGMENTS`` distinct segments (the edges of a passage that stands in very many different
   surroundings) is dealt by single windows instead, equal windows brought together first, so no shard has to hold all of
   it.
3. FM-index. A shard is one text over an alphabet of its words. Its suffix array (by prefix doubling up to the window
   length) gives the Burrows-Wheeler transform, kept as a wavelet matrix of packed bits with block counts; C counts and
   marks of the suffixes that agree in window - 1 words complete the index.
4. Matching statistics. All segments of the shard are streamed against the index from their last word backwards, one
   backward search step for all of them at a time. The match grows up to the window length; from then on it drops its last
   word (its interval widens to the marked group) before each further step. Whenever the match is a whole window, the
   smallest document id in its interval is reported.
5. The reported runs of windows go back to every document that holds the segment; those whose document is smaller make
   the removed spans.

Ids of words and segments are 64-bit hashes, those of segments two of them together with the anchor. Defined results: a
null id counts as larger than any other, and null ids don't remove each other; null text has no words; rows that repeat
an id are judged by it (they don't remove each other); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import SPACES, RunHash, slices, text_bytes, word_hashes, word_spans, written

NO_ID = (1 << 63) - 1
HOT_SEGMENTS = 4096
SHARD_WORDS = 400_000
LONGEST_RUN = 64  # windows of one segment
_BYTES, _WORDS, _RUNS = RunHash(31), RunHash(37), RunHash(41)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_hashes(_BYTES, data, starts, ends)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of x[i:i + width] for each i with all of them."""
    now, size = x, 1
    while size < width:
        step = min(size, width - size)
        now = np.minimum(now[:-step], now[step:])
        size += step
    return now


def segments_of(column: pa.Array, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, first word, words, anchor hash and content hash of the segments of all texts."""
    data, offsets = text_bytes(column)
    starts, ends, rows = word_spans(data, offsets, SPACES)
    empty = np.zeros(0, np.int64)
    if len(starts) < window:
        return empty, empty, empty, empty, empty
    keys = word_keys(data, starts, ends)
    prefix = _WORDS.prefix(keys)
    at = np.arange(len(keys) - anchor + 1)
    least = sliding_min(_WORDS.runs(prefix, at, at + anchor), window - anchor + 1)
    whole = rows[:len(least)] == rows[window - 1:]
    first = np.flatnonzero(whole)
    if not len(first):
        return empty, empty, empty, empty, empty
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1] + 1) | (rows[first[1:]] != rows[first[:-1]]) | (least[first[1:]] != least[first[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(first)))
    if (count > LONGEST_RUN).any():  # cut long runs of periodic texts
        pieces = -(-count // LONGEST_RUN)
        inside = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, count = np.repeat(begin, pieces) + inside * LONGEST_RUN, np.repeat(count, pieces) - inside * LONGEST_RUN
        count = np.minimum(count, LONGEST_RUN)
    a = first[begin]
    size = count + window - 1
    doc_first = np.searchsorted(rows, rows[a])
    content = _RUNS.runs(_RUNS.prefix(keys), a, a + size)
    return rows[a], a - doc_first, size, least[a].view(np.int64), content.view(np.int64)


class WaveletMatrix:
    """Sequence of integers as one bit vector per bit of its symbols, packed, with a count of ones before each word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.uint8)), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum(dtype=np.int64)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place``, less the (constant per symbol) place of its first occurrence in
        the last level; two ranks of a symbol differ by the occurrences between them."""
        one = np.uint64(1)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            word = place >> 6
            mask = (one << (place & 63).astype(np.uint64)) - one
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & mask)
            place = np.where((symbol >> level) & 1, self.zeros[i] + ones, place - ones)
        return place


def _combine(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Dense ranks of the pairs (a[i], b[i + shift]); b is 0 behind its end."""
    behind = np.zeros(len(a), np.int64)
    behind[:max(0, len(a) - shift)] = b[shift:]
    return np.unique(a * (int(b.max(initial=0)) + 1) + behind, return_inverse=True)[1]


class FMIndex:
    """Index of sequences of symbols (1 and up), each ended by symbol 0, for matches of up to ``window`` symbols."""

    def __init__(self, text: np.ndarray, owners: np.ndarray, window: int):
        ranks = {1: text.astype(np.int64)}
        size = 1
        while size * 2 <= window - 1:
            ranks[size * 2] = _combine(ranks[size], ranks[size], size)
            size *= 2
        have, shorter = size, ranks[size]
        for k in sorted(ranks, reverse=True):
            while have + k <= window - 1:
                shorter = _combine(shorter, ranks[k], have)
                have += k
        full = _combine(shorter, ranks[1], window - 1) if window > 1 else ranks[1]
        order = np.argsort(full, kind="stable")
        before = text[order - 1]  # the text begins after a separator: place 0 is preceded by the last symbol, a 0
        bits = max(1, int(text.max(initial=1)).bit_length())
        self.bwt = WaveletMatrix(before.astype(np.int64), bits)
        symbols = np.arange(int(text.max(initial=0)) + 1)
        self.starts = np.searchsorted(text[order], symbols)  # C counts
        # where each symbol's occurrences begin in the last level of the matrix
        self.base = self.bwt.rank(symbols, np.zeros(len(symbols), np.int64))
        n = len(order)
        new = np.ones(n, bool)
        if window > 1:
            by = shorter[order]
            new[1:] = by[1:] != by[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.group_start, self.group_end = first[group], np.append(first[1:], n)[group]
        by = full[order]
        cut = np.ones(n, bool)
        cut[1:] = by[1:] != by[:-1]
        at = np.flatnonzero(cut)
        self.least = np.minimum.reduceat(owners[order], at)[np.cumsum(cut) - 1] if n else owners

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with ``symbol`` put in front."""
        shift = self.starts[symbol] - self.base[symbol]
        return self.bwt.rank(symbol, low) + shift, self.bwt.rank(symbol, high) + shift


def matching_statistics(words: np.ndarray, sizes: np.ndarray, owners: np.ndarray, window: int) -> list[np.ndarray]:
    """Per sequence (``sizes`` words each, keys in ``words``), the smallest owner of each of its windows' matches."""
    symbols = np.unique(words, return_inverse=True)[1] + 1
    n = len(sizes)
    ends = np.cumsum(sizes)
    text = np.insert(symbols, ends, 0)
    of = np.repeat(np.arange(n), sizes + 1)
    index = FMIndex(text, owners[of], window)
    out = [np.zeros(max(0, int(s) - window + 1), np.int64) for s in sizes]
    order = np.argsort(-sizes, kind="stable")  # the longest first: those still active are always a prefix
    sizes_by, ends_by = sizes[order], ends[order]
    found = np.full((n, max(1, int(sizes.max(initial=0)) - window + 1)), NO_ID, np.int64)
    low, high = np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    for step in range(int(sizes.max(initial=0))):
        active = int(np.searchsorted(-sizes_by, -step, side="left"))
        lo, hi = low[:active], high[:active]
        if step >= window:  # drop the last word of the match
            lo, hi = index.group_start[lo], index.group_end[lo]
        lo, hi = index.step(symbols[ends_by[:active] - 1 - step], lo, hi)
        low[:active], high[:active] = lo, hi
        if step >= window - 1:
            found[:active, step - window + 1] = index.least[lo]
    for i, which in enumerate(order.tolist()):
        k = len(out[which])
        out[which] = found[i, :k][::-1]  # found from the last window backwards
    return out


SEGMENTS = "doc bigint, mark bigint, start int, n int, anchor bigint, content bigint"


def _segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, n, key, content = segments_of(part.column("text"), window, anchor)
                doc, mark = np.asarray(part.column("doc")), np.asarray(part.column("mark"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[row]), pa.array(mark[row]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(key), pa.array(content)], [f.split()[0] for f in SEGMENTS.split(", ")])

    return docs.mapInArrow(run, SEGMENTS)


CUT = "anchor bigint, content bigint, place int, doc bigint, last bigint, text binary"


def _cut(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The text of each wanted segment, from its first document; of hot ones the text of each window, with its hash as
    anchor and the segment's own (anchor, content) beside it."""
    lists = wanted.groupBy("doc", "mark").agg(F.collect_list(
        F.struct("start", "n", "anchor", "content", "last", "hot")).alias("wanted"))
    rows = docs.join(lists, ["doc", "mark"]).dropDuplicates(["doc", "mark"]).select("doc", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, of = word_spans(data, offsets, SPACES)
                lists = part.column("wanted")
                w = lists.flatten()
                counts = np.diff(np.asarray(lists.offsets))
                row = np.repeat(np.arange(len(counts)), counts)
                start, n, key, content, last, hot = (np.asarray(w.field(i)) for i in range(6))
                a = np.searchsorted(of, row) + start
                doc = np.asarray(part.column("doc"))[row]
                place = np.full(len(a), -1, np.int32)
                if hot.any():
                    windows = np.where(hot, n - window + 1, 1)
                    k = np.repeat(np.arange(len(a)), windows)
                    inside = np.arange(len(k)) - np.repeat(np.cumsum(windows) - windows, windows)
                    a, n, key, content, last, doc, hot = a[k] + inside, n[k], key[k], content[k], last[k], doc[k], hot[k]
                    n = np.where(hot, window, n)
                    place = np.where(hot, inside, -1).astype(np.int32)
                raw = data.tobytes()
                texts = [raw[x:y] for x, y in zip(starts[a].tolist(), ends[a + n - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(content), pa.array(place), pa.array(doc), pa.array(last),
                     pa.array(texts, pa.binary())], [f.split()[0] for f in CUT.split(", ")])

    return rows.mapInArrow(run, CUT)


def _match(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """anchor, content, runs array<struct<from, to, doc>>: the smallest document of the windows from..to - 1 of each
    segment (anchor, content, doc, last, text), left out where it tells nothing."""
    dealt = (texts.withColumn("shard", F.expr(f"cast(pmod(xxhash64(anchor), {shards}) as int)"))
             .repartition(shards, "shard").sortWithinPartitions("shard")
             .select("shard", "anchor", "content", "doc", "last", "text"))

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        data, offsets = text_bytes(texts.cast(pa.large_binary()).view(pa.large_string()))
        starts, ends, of = word_spans(data, offsets, SPACES)
        doc, last = rows.column("doc").to_numpy(), rows.column("last").to_numpy()
        sizes = np.bincount(of, minlength=rows.num_rows)
        least = matching_statistics(word_keys(data, starts, ends), sizes, doc, window)
        anchor, content = rows.column("anchor").to_numpy(), rows.column("content").to_numpy()
        keep, runs = [], []
        for i, x in enumerate(least):
            if last[i] > doc[i] or (x < doc[i]).any():
                cut = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
                keep.append(i)
                runs.append([{"from": int(a), "to": int(b), "doc": int(x[a])} for a, b in zip(cut[:-1], cut[1:], strict=True)])
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("doc", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(content[keep]), pa.array(runs, kind)],
                                          ["anchor", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and held[0].column("shard")[0].as_py() != shard[a]:
                        yield found(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield found(held)

    return dealt.mapInArrow(run, "anchor bigint, content bigint, runs array<struct<from:int,to:int,doc:bigint>>")


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = 12) -> DataFrame:
    """(doc, mark, spans array<struct<from, to>>) of the documents (doc, mark, text) that hold words to remove; spans are in
    words and may overlap."""
    segments = written(_segments(docs, window, anchor), "segments")
    shared = (segments.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
              .where("least < most").select("anchor"))
    shared = written(shared, "shared-anchors")  # a plain join follows, whose hot anchors Spark can split
    held = written(segments.join(shared, "anchor", "left_semi"), "shared-segments")
    distinct = held.groupBy("anchor", "content", "n").agg(
        F.min(F.struct("doc", "mark", "start")).alias("first"), F.max("doc").alias("last")).select(
        "anchor", "content", "n", "first.*", "last")
    distinct = written(distinct, "distinct-segments")
    hot = distinct.groupBy("anchor").count().where(f"count > {HOT_SEGMENTS}").selectExpr("anchor", "true as hot")
    words = distinct.agg(F.sum("n").alias("n")).first().n or 0
    wanted = distinct.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    texts = written(_cut(docs, wanted, window), "segment-texts")
    whole = texts.where("place < 0").select("anchor", "content", "doc", "last", "text")
    single = texts.where("place >= 0").withColumn("key", F.xxhash64(F.regexp_replace(F.col("text").cast("string"), r"[\x09-\x0D\x20]+", " ")))
    equal = single.groupBy("key").agg(F.min("doc").alias("doc"), F.max("last").alias("last"), F.first("text").alias("text"))
    shards = max(1, -(-int(words) // SHARD_WORDS))
    matched = _match(whole.unionByName(equal.selectExpr("key as anchor", "key as content", "doc", f"{NO_ID} as last", "text")),
                     window, shards)
    matched = written(matched, "matched-segments")
    back = (single.select("key", "anchor", "content", "place")
            .join(matched.selectExpr("anchor as key", "content as same", "runs").where("key = same"), "key")
            .selectExpr("anchor", "content", "array(named_struct('from', place, 'to', place + 1, 'doc', runs[0].doc)) as runs"))
    results = written(matched.unionByName(back), "matched-runs")
    spans = (held.join(results, ["anchor", "content"]).selectExpr("doc", "mark", "start", "explode(runs) as run")
             .where("run.doc < doc")
             .selectExpr("doc", "mark", f"named_struct('from', start + run.from, 'to', start + run.to + {window - 1}) as span"))
    return spans.groupBy("doc", "mark").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), removed array<struct<from, to>> (maximal
    runs of removed words), one row per document row."""
    rows = docs.selectExpr(f"coalesce(cast({doc_id} as bigint), {NO_ID}) as doc", f"xxhash64({text}) as mark", f"{text} as text")
    found = repeated_spans(rows, window, anchor)
    joined = rows.join(found, ["doc", "mark"], "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, of = word_spans(data, offsets, SPACES)
                n = part.num_rows
                words = np.bincount(of, minlength=n)
                first = np.cumsum(words) - words
                lists = part.column("spans")
                counts = np.asarray(pc.list_value_length(lists).fill_null(0))
                s = lists.flatten()
                base = np.repeat(first, counts)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, base + np.asarray(s.field("from")), 1)
                np.add.at(edge, base + np.asarray(s.field("to")), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.flatnonzero(~gone)
                size = ends[kept] - starts[kept] + 1
                upto = np.concatenate([[0], np.cumsum(size)])
                out = np.full(int(upto[-1]), 0x20, np.uint8)
                inner = size - 1
                to = np.arange(int(inner.sum())) + np.repeat(upto[:-1] - (np.cumsum(inner) - inner), inner)
                out[to] = data[to + np.repeat(starts[kept] - upto[:-1], inner)]
                # texts of the kept words: the space behind the last word of a text is left out
                cut = upto[np.searchsorted(kept, np.append(first, len(starts)))]
                raw = out.tobytes()
                texts = [raw[a:max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                # maximal removed runs; a run ends with its text
                side = np.flatnonzero(gone)
                new = np.ones(len(side), bool)
                new[1:] = (side[1:] != side[:-1] + 1) | (of[side[1:]] != of[side[:-1]])
                a = side[new]
                b = side[np.append(np.flatnonzero(new)[1:], len(side)) - 1] + 1 if len(side) else side
                row = of[a]
                runs = pa.StructArray.from_arrays([pa.array(a - first[row]), pa.array(b - first[row])], ["from", "to"])
                begins = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(words), pa.array(np.bincount(of, gone, minlength=n).astype(np.int64)),
                     pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(begins), runs)],
                    ["doc_id", "n_words", "n_removed", "kept", "removed"])

    out = joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, "
                                 "removed array<struct<from:bigint,to:bigint>>")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID})"))
