"""Benchmark decontamination with a positional inverted index of the training texts.

Index. Documents are dealt into blocks (slices of the input); a block is one row that holds, sorted by term, the postings
of all its tokens: term hashes, how many postings each has, and the token positions, as well as the length of each document; a match must
begin and end in one document. The index is written to the shared folder and can be searched any number of times. Term
frequencies of the whole corpus are one sum over it.

Search. Every block intersects the offset-adjusted posting lists of a phrase from its rarest term on (by corpus
frequency): the postings of the rarest term, less its offset in the phrase, are the first candidates, and each further
term, in order of frequency, keeps those candidates that its own postings confirm. What is left after the last term is an
exact match. Distinct phrases are searched once, all phrases of a group together in numpy. A proximity search asks for all
terms of a phrase, as often as they occur in it, within a span of ``span`` tokens, in any order.

The phrases are sent to the tasks in groups of at most ``GROUP_BYTES``, one pass over the index for each, so what is
broadcast has a fixed bound however large the benchmark is.

Words: A-Z lower-cased, then runs of ASCII digits and letters and all non-ASCII bytes. Terms are 64-bit hashes of words.
Defined results: null text has no words; an item without words has no window; ids may repeat: documents are told apart by
block and place, rows of one doc_id are reported one by one, items of one item_id are one item; null item ids are left out;
empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import RunHash, slices, text_bytes, word_hashes, word_spans, written

GROUP_BYTES = 8 << 20
BLOCK_BYTES = 2 << 20
PAIRS_AT_ONCE = 1 << 20

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
TERMS = np.zeros(256, bool)
TERMS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_HASH = RunHash(23)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all words, and how many words each text has."""
    data, offsets = text_bytes(column)
    data = FOLD[data]
    starts, ends, rows = word_spans(data, offsets, TERMS)
    keys = word_hashes(_HASH, data, starts, ends)
    return keys, np.bincount(rows, minlength=len(offsets) - 1)


INDEX = ("block bigint, doc_ids binary, lengths binary, terms binary, counts binary, positions binary")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block; see the module text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                keys, lengths = tokens(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                order = np.argsort(keys, kind="stable")
                terms, counts = np.unique(keys, return_counts=True)
                columns = [ids.astype("<i8"), lengths.astype("<i4"), terms.astype("<u8"), counts.astype("<i4"),
                           order.astype("<i4")]
                block = pa.array([uuid.uuid4().int >> 65], pa.int64())
                yield pa.RecordBatch.from_arrays([block, *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
                                                 [f.split()[0] for f in INDEX.split(", ")])

    rows = docs.selectExpr(f"coalesce(cast({doc_id} as bigint), {NO_ID}) as doc_id", f"{text} as text")
    return written(rows.mapInArrow(run, INDEX), "positional-index")


NO_ID = -(1 << 63) + 1
"""Stands for a null document id inside the index."""


class Block:
    """Posting lists of one index row."""

    def __init__(self, row: dict[str, bytes]):
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.lengths = np.frombuffer(row["lengths"], "<i4")
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
        # one sorted key per posting, so that membership in any term's list is one binary search
        number = np.repeat(np.arange(len(self.terms), dtype=np.int64), self.counts)
        self.keys = number << 33 | self.positions
        self.doc_ends = np.cumsum(self.lengths.astype(np.int64))
        self.doc_begins = self.doc_ends - self.lengths

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in this block's list, or -1."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def has(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether term ``number`` stands at ``position``."""
        key = number << 33 | position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (position >= 0) & (self.keys[at] == key)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, positions, side="right")


class Phrases:
    """Distinct phrases of one group, padded to the longest; ``order`` has each phrase's places from the rarest term on."""

    def __init__(self, terms: list[np.ndarray], rarity: dict[int, int]):
        self.sizes = np.array([len(t) for t in terms], np.int64)
        width = int(self.sizes.max(initial=1))
        self.terms = np.zeros((len(terms), width), np.uint64)
        self.order = np.zeros((len(terms), width), np.int64)
        for i, t in enumerate(terms):
            self.terms[i, :len(t)] = t
            how_often = np.array([rarity.get(int(x), 0) for x in t])
            self.order[i, :len(t)] = np.argsort(how_often, kind="stable")

    def matches(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Exact matches: phrase numbers and first positions."""
        numbers = block.numbers(self.terms.ravel()).reshape(self.terms.shape)
        inside = np.arange(self.terms.shape[1])[None, :] < self.sizes[:, None]
        alive = np.flatnonzero(((numbers >= 0) | ~inside).all(axis=1))
        if not len(alive):
            return
        rarest = self.order[alive, 0]
        first = numbers[alive, rarest]
        upto = np.cumsum(block.counts[first])
        at = 0
        while at < len(alive):  # some phrases at a time, so that the candidates of a pass are bounded
            base = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, side="right")))
            who, counts = alive[at:to], block.counts[first[at:to]]
            phrase = np.repeat(who, counts)
            posting = np.arange(int(counts.sum())) + np.repeat(block.begins[first[at:to]] - (np.cumsum(counts) - counts), counts)
            start = block.positions[posting] - np.repeat(rarest[at:to], counts)
            for step in range(1, self.terms.shape[1]):
                if not len(phrase):
                    break
                more = step < self.sizes[phrase]
                place = self.order[phrase, step]
                ok = ~more
                ok[more] = block.has(numbers[phrase[more], place[more]], start[more] + place[more])
                phrase, start = phrase[ok], start[ok]
            ok = start >= 0
            phrase, start = phrase[ok], start[ok]
            ok = block.documents(start) == block.documents(start + self.sizes[phrase] - 1)
            yield phrase[ok], start[ok]
            at = to

    def near(self, block: Block, span: int) -> Iterator[tuple[int, np.ndarray]]:
        """Proximity: per phrase, the first positions of the narrowest runs of at most ``span`` tokens of one document
        that hold every term as often as the phrase does."""
        for i in range(len(self.sizes)):
            terms, need = np.unique(self.terms[i, :self.sizes[i]], return_counts=True)
            numbers = block.numbers(terms)
            if (numbers < 0).any() or (block.counts[numbers] < need).any():
                continue
            lists = [block.positions[block.begins[n]:block.begins[n] + block.counts[n]] for n in numbers]
            rare = lists[int(np.argmin([len(x) for x in lists]))]
            # a run can begin at any posting of a term that is no further than the span before one of the rarest term
            begins = np.unique(np.concatenate(lists))
            after = np.searchsorted(rare, begins)
            begins = begins[(after < len(rare)) & (rare[np.minimum(after, len(rare) - 1)] < begins + span)]
            for x, n in zip(lists, need, strict=True):
                end = np.minimum(begins + span, block.doc_ends[block.documents(begins)])
                inside = np.searchsorted(x, end) - np.searchsorted(x, begins)
                begins = begins[inside >= n]
            if len(begins):
                yield i, begins


def windows(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id string, phrase binary): the distinct windows of ``size`` consecutive words of every item; an item of
    fewer words, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                keys, lengths = tokens(part.column("text"))
                begins = np.cumsum(lengths) - lengths
                ids, phrases = [], []
                for item, a, n in zip(part.column("item_id").to_pylist(), begins.tolist(), lengths.tolist(), strict=True):
                    if n:
                        own = {keys[a + i:a + min(n, i + size)].astype("<u8").tobytes() for i in range(max(1, n - size + 1))}
                        ids += [item] * len(own)
                        phrases += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(phrases, pa.binary())],
                                                 ["item_id", "phrase"])

    rows = items.selectExpr(f"cast({item_id} as string) as item_id", f"{text} as text").where("item_id is not null")
    return rows.mapInArrow(run, "item_id string, phrase binary").distinct()


def term_frequencies(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """term bigint, n: corpus frequency of the terms of the phrases."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(terms.as_py(), "<u8").view(np.int64)),
                     pa.array(np.frombuffer(counts.as_py(), "<i4").astype(np.int64))], ["term", "n"])

    def of_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("phrase").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(own))], ["term"])

    asked = phrases.select("phrase").mapInArrow(of_phrases, "term bigint").distinct()
    return (index.select("terms", "counts").mapInArrow(of_blocks, "term bigint, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n")).join(asked, "term"))


def _groups(phrases: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    group, size = [], 0
    for row in phrases:
        if group and size + len(row[1]) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[1])
    if group:
        yield group


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items array<string> per document row: words inside an occurrence of a window of an item,
    and the sorted ids of the items that have one."""
    spark = docs.sparkSession
    index = build_index(docs, doc_id, text) if index is None else index
    found = written(windows(items, size, item_id, item_text), "benchmark-windows")
    distinct = written(found.groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
                       .withColumn("part", F.expr("cast(pmod(xxhash64(phrase), 1 << 20) as int)")), "benchmark-phrases")
    size_of = "octet_length(phrase) + 40 + aggregate(items, 0, (a, x) -> a + octet_length(x) + 8)"
    measured = distinct.agg(F.sum(F.expr(size_of)).alias("bytes")).first().bytes or 0
    n_groups = max(1, -(-int(measured) // GROUP_BYTES))
    frequencies = written(term_frequencies(index, found), "benchmark-terms")
    parts = []
    for g in range(n_groups):
        group = distinct.where(f"part % {n_groups} = {g}")
        # a group's phrases and its terms' frequencies: both bounded by GROUP_BYTES, up to the luck of the hash
        rows = [(bytes(r.phrase), r.items) for r in group.select("phrase", "items").collect()]
        own = np.unique(np.frombuffer(b"".join(p for p, _ in rows), "<i8"))
        rarity = {}
        if len(own):
            asked = spark.createDataFrame([(int(t),) for t in own], "term bigint") if n_groups > 1 else None
            kept = frequencies if asked is None else frequencies.join(asked, "term")
            rarity = {r.term & (1 << 64) - 1: r.n for r in kept.collect()}
        parts.append(_search(index, rows, rarity))
    if n_groups == 1:
        return parts[0].selectExpr(f"nullif(doc_id, {NO_ID}) as doc_id", "cast(n_words as bigint) as n_words",
                                   "cast(size(hit) as bigint) as n_hit", "items")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("block", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).selectExpr(
        f"nullif(doc_id, {NO_ID}) as doc_id", "cast(n_words as bigint) as n_words", "cast(size(hit) as bigint) as n_hit",
        "items")


def _search(index: DataFrame, rows: list[tuple[bytes, list[str]]], rarity: dict[int, int]) -> DataFrame:
    """block, place, doc_id, n_words, hit array<int> (places of hit words), items: one row per document."""
    phrases = Phrases([np.frombuffer(p, "<u8") for p, _ in rows], rarity)
    names = [items for _, items in rows]
    shared = index.sparkSession.sparkContext.broadcast((phrases, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, names = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                n = len(block.doc_ids)
                hits: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for who, start in phrases.matches(block):
                    doc = block.documents(start)
                    for p, d, s in zip(who.tolist(), doc.tolist(), (start - block.doc_begins[doc]).tolist(), strict=True):
                        items.setdefault(d, set()).update(names[p])
                        hits.setdefault(d, []).append((s, s + int(phrases.sizes[p])))
                places = [np.zeros(0, np.int32)] * n
                for d, spans in hits.items():
                    edge = np.zeros(int(block.lengths[d]) + 1, np.int64)
                    a = np.array(spans)
                    np.add.at(edge, a[:, 0], 1)
                    np.add.at(edge, a[:, 1], -1)
                    places[d] = np.flatnonzero(np.cumsum(edge)[:-1] > 0).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int64)),
                     pa.array(block.doc_ids.astype(np.int64)), pa.array(block.lengths.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *places]))),
                     pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))],
                    ["block", "place", "doc_id", "n_words", "hit", "items"])

    return index.mapInArrow(
        run, "block bigint, place bigint, doc_id bigint, n_words bigint, hit array<int>, items array<string>")


def proximity(index: DataFrame, items: DataFrame, span: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, doc_id, position: places from which at most ``span`` tokens of a document hold all words of an item, as
    often as the item does, in any order. The items are sent in groups like the windows."""
    spark = index.sparkSession
    found = written(windows(items, 1 << 30, item_id, text), "proximity-items")
    measured = found.agg(F.sum(F.octet_length("phrase") + F.octet_length("item_id") + 40).alias("bytes")).first().bytes or 0
    n_groups = max(1, -(-int(measured) // GROUP_BYTES))
    out = spark.createDataFrame([], "item_id string, doc_id bigint, position bigint")
    for g in range(n_groups):
        rows = found.where(f"pmod(xxhash64(phrase), {n_groups}) = {g}").collect()
        names = [r.item_id for r in rows]
        shared = spark.sparkContext.broadcast((Phrases([np.frombuffer(r.phrase, "<u8") for r in rows], {}), names))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases, names = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row)
                    for i, begins in phrases.near(block, span):
                        doc = block.documents(begins)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[i]] * len(begins), pa.string()), pa.array(block.doc_ids[doc].astype(np.int64)),
                             pa.array(begins - block.doc_begins[doc])], ["item_id", "doc_id", "position"])

        near = index.mapInArrow(run, "item_id string, doc_id bigint, position bigint")
        out = out.unionByName(near.selectExpr("item_id", f"nullif(doc_id, {NO_ID}) as doc_id", "position"))
    return out
