"""BPE encoding and decoding with a public tokenizer file (word-end vocabulary).

Encoding finds the merges of a word without replaying them. An Aho-Corasick automaton over all tokens gives, in one
pass over the word, the longest token starting at each place. A backtracking walk takes the longest token whose pair
with the token before it is compatible, and falls back to shorter prefixes and then to the token before; places that
turned out to be dead ends are marked, so each is left once and the walk is linear. Two neighbouring tokens are
compatible if no merge of lower rank would have joined symbols across the seam, which is read from a pair table
(pair -> rank of the token it makes) by undoing the merges of both sides from the highest rank down; results are kept
in a pair-compatibility table. Tokens that their own merges cannot make are left out of the automaton.

Texts are cut into words on whole slices of text with numpy (code point classes), words are told apart by 64-bit
hashes of their code points, and each different word is encoded once per slice, or less often through a bounded cache.
Decoding concatenates pieces of one byte string through a table of offsets; the tokenizer file names no decoder, so
tokens are joined by one space and keep their word-end marks, as its own decode() does.

``tokenizer_json`` is the path of the file on the driver. What it says is broadcast (its size doesn't depend on the
data). Defined results: null text is encoded like an empty one (no ids, empty decoded text); every text is encoded as
a whole; rows, repeated ones too, and other columns stay as they are; an output column of the same name is replaced.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import slices

CACHED_WORDS, CACHED_LENGTH, CACHED_PAIRS = 200_000, 64, 200_000
END = ""  # stands for the word-end mark inside this module
SPACE_POINTS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


CODE_POINTS = 0x110000


@lru_cache(maxsize=1)
def unicode_rules() -> tuple[list[int], list[int], dict[int, str]]:
    """Classes of code points as runs (first code point of each, class: 0 white space, 1 letter, 2 number, 3 other), and the lower
    case of the letters that Python's own tables don't know yet. Both are asked of the library whose results are to be met, once
    on the driver, because versions of Unicode differ in thousands of code points."""
    from tokenizers import Regex, normalizers, pre_tokenizers
    points = [i for i in range(CODE_POINTS) if not 0xD800 <= i < 0xE000]
    kinds = np.full(CODE_POINTS, 3, np.uint8)
    for kind, name in ((1, "L"), (2, "N")):
        others = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed")
        found = np.zeros(CODE_POINTS, bool)
        found[points] = True
        for at in range(0, len(points), 4096):
            some = points[at:at + 4096]
            for _, (a, b) in others.pre_tokenize_str("".join(map(chr, some))):
                found[some[a:b]] = False
        kinds[found] = kind
    kinds[SPACE_POINTS] = 0
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    lower = normalizers.Lowercase()
    cased = [i for i in np.flatnonzero(kinds != 0).tolist() if i > 0x7F and not 0xD800 <= i < 0xE000]
    more = {i: low for i in cased if (low := lower.normalize_str(chr(i))) != chr(i).lower()}
    return starts.tolist(), kinds[starts].tolist(), more


def load_tables(tokenizer_json: str) -> dict:
    """What the encoder needs of a tokenizer file and of Unicode, as plain lists."""
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
        raise ValueError("expects a BPE tokenizer file with word-end marks and no decoder")
    return {"unicode": unicode_rules(), "suffix": model["end_of_word_suffix"], "vocab": model["vocab"], "merges": [tuple(m) for m in model["merges"]],
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class Encoder:
    """Word encoder and tables of one tokenizer; made once per Python worker."""

    def __init__(self, tables: dict):
        import ahocorasick

        suffix, vocab = tables["suffix"], tables["vocab"]
        self.special = tables["special"]
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        inner = lambda t: t[:-len(suffix)] + END if t.endswith(suffix) else t
        # numbers inside the encoder: base symbols first, then the tokens by rank of the merge that makes them
        base = [*self.letters, *(c + END for c in self.letters)]
        number = {t: i for i, t in enumerate(base)}
        left, right = list(range(len(base))), list(range(len(base)))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in tables["merges"]:
            a, b = inner(a), inner(b)
            if a + b in number:
                raise ValueError("two merges make the same token")
            n = number[a + b] = len(number)
            left.append(number[a])
            right.append(number[b])
            self.pairs[number[a], number[b]] = n
        self.left, self.right = left, right
        out = {inner(t): i for t, i in vocab.items()}
        self.ids = [out[t] for t in number]
        self.ends_word = [t.endswith(END) for t in number]
        self.length = [len(t) - t.endswith(END) for t in number]
        self.compatible: dict[int, bool] = {}
        made = [True] * len(base)
        for n in range(len(base), len(number)):
            made.append(made[left[n]] and made[right[n]] and self._compatible(left[n], right[n], n))
        # word-end tokens are matched through the mark, which is no symbol of its own
        automaton = ahocorasick.Automaton()
        for t, n in number.items():
            if made[n]:
                automaton.add_word(t, n)
        automaton.make_automaton()
        self.automaton = automaton
        # the longest token that is a proper prefix of a token; a prefix never holds the word-end mark
        self.shorter = [-1] * len(number)
        for t, n in number.items():
            for k in range(self.length[n] - 1 if not t.endswith(END) else self.length[n], 0, -1):
                m = number.get(t[:k])
                if m is not None and made[m] and (k < self.length[n]):
                    self.shorter[n] = m
                    break
        self._decoding(vocab)

    def _decoding(self, vocab: dict[str, int]) -> None:
        pieces = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        size = max(pieces) + 1
        raw = [pieces.get(i, "").encode() + b" " for i in range(size)]
        self.piece_len = np.array([len(x) for x in raw], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """False if a merge that ranks before ``limit`` would join symbols across the seam of a and b. The merges of
        the two sides are undone from the latest to the earliest; a pair across the seam blocks if it ranks before
        every merge undone so far (the merge on the left wins a tie, being further left)."""
        pairs, left, right = self.pairs, self.left, self.right
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            a_base, b_base = left[a] == a, left[b] == b
            if a_base and b_base:
                return True
            if b_base or (not a_base and a > b):
                limit, a = min(limit, a), right[a]
            else:
                limit, b = min(limit, b + 1), left[b]

    def compatible_pair(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > CACHED_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._compatible(a, b, 1 << 60)
        return known

    def word(self, word: str) -> list[int]:
        """Vocabulary ids of one word."""
        letters, length, shorter, ends_word = self.letters, self.length, self.shorter, self.ends_word
        known, compatible = self.compatible, self.compatible_pair
        text = "".join([letters[b] for b in word.encode()])
        n = len(text)
        longest = [0] * n
        for at, token in self.automaton.iter(text + END):
            # matches come by their ends, so the last one kept for a start is the longest; one that ends on the mark
            # covers the last letter
            longest[(n if at == n else at + 1) - length[token]] = token
        closed = [False] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not closed[end] and (end < n or ends_word[token]):  # the last token must hold the mark
                ok = not out
                if out:
                    ok = known.get(out[-1] << 20 | token)
                    if ok is None:
                        ok = compatible(out[-1], token)
                if ok:
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
                continue
            closed[at] = True
            if not out:
                raise ValueError(f"no encoding of {word!r}")
            # the token before ends at a closed place now: the walk goes on with its shorter prefixes
            token = out.pop()
            at -= length[token]
        ids = self.ids
        return [ids[t] for t in out]


class Unicode:
    """Classes and lower case of code points, from ``unicode_rules``."""

    def __init__(self, rules: tuple[list[int], list[int], dict[int, str]]):
        starts, kinds, self.more = rules
        self.classes = np.repeat(np.array(kinds, np.uint8), np.diff([*starts, CODE_POINTS]))
        self.unknown = re.compile("[" + "".join(map(re.escape, map(chr, self.more))) + "]") if self.more else None

    def lowered(self, part: str) -> str:
        """NFC, then lower case letter by letter (no rule for a final sigma)."""
        if part.isascii():
            return part.lower()
        part = unicodedata.normalize("NFC", part)
        if self.unknown is not None and self.unknown.search(part):
            part = part.translate(self.more)
        return "".join([c.lower() for c in part]) if "Σ" in part else part.lower()


def word_places(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the parts that ``offsets`` bounds, by the ``classes`` of code points: English contractions after an apostrophe
    that begins a run of signs, runs of letters, single numbers, runs of other signs."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[points]
    edge = np.zeros(n + 4, bool)
    edge[offsets] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:n] | (kind == 2)
    start &= kind != 0
    quotes = np.flatnonzero((points == 39) & start)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(4, points.dtype)])
        letter = np.concatenate([kind == 1, np.zeros(4, bool)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside = ~edge[quotes + 1] & letter[quotes + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | (
            (one == ord("l")) & (two == ord("l")))
        long = inside & ~edge[quotes + 2] & is_two
        for which, size in ((short, 2), (long, 3)):
            q = quotes[which]
            start[q + 1] = False
            after = q + size
            after = after[(after < n)]
            start[after[letter[after]]] = True
    stops = np.flatnonzero(start | (kind == 0) | edge[:n])
    ends = np.append(stops[1:], n)
    keep = start[stops]
    return stops[keep], ends[keep]


class SliceEncoder:
    """Encodes lists of texts; keeps the ids of the words met, up to a bound."""

    def __init__(self, tables: dict):
        self.encoder = Encoder(tables)
        self.unicode = Unicode(tables["unicode"])
        self.cache: dict[str, bytes] = {}

    def _words(self, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the number of ids of each word."""
        cache, word = self.cache, self.encoder.word
        if len(cache) > CACHED_WORDS:
            cache.clear()
        numbers: dict[str, int] = {}
        inverse = np.array([numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        found = []
        for w in numbers:
            ids = cache.get(w)
            if ids is None:
                own = word(w)
                ids = struct.pack(f"<{len(own)}I", *own)
                if len(w) <= CACHED_LENGTH:
                    cache[w] = ids
            found.append(ids)
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<u4")
        begins = np.cumsum(sizes) - sizes
        counts = sizes[inverse]
        total = int(counts.sum())
        places = np.arange(total) + np.repeat(begins[inverse] - (np.cumsum(counts) - counts), counts)
        return flat[places], counts

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        encoder = self.encoder
        parts: list[str] = []
        layout: list[list[int]] = []  # per text: numbers of parts, or -1 - id of a special token
        for text in texts:
            row = []
            if text and encoder.special_split is not None and "<|" in text:
                pieces = encoder.special_split.split(text)
            else:
                pieces = [text or ""]
            for piece in pieces:
                if piece in encoder.special:
                    row.append(-1 - encoder.special[piece])
                else:
                    row.append(len(parts))
                    parts.append(self.unicode.lowered(piece))
            layout.append(row)
        joined = "".join(parts)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = word_places(points, offsets, self.unicode.classes)
        if len(starts):
            ids, counts = self._words(joined, starts, ends)
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        cuts = upto[np.searchsorted(starts, offsets)]
        out = []
        for row in layout:
            if len(row) == 1:
                out.append(ids[cuts[row[0]]:cuts[row[0] + 1]])
            else:
                out.append(np.concatenate([
                    ids[cuts[x]:cuts[x + 1]] if x >= 0 else np.array([-1 - x], np.uint32) for x in row]))
        return out


def decode_ids(encoder: Encoder, ids: np.ndarray) -> bytes:
    """UTF-8 of the tokens joined by one space, cut from one byte string by offsets."""
    if not len(ids):
        return b""
    sizes = encoder.piece_len[ids]
    total = int(sizes.sum())
    places = np.arange(total) + np.repeat(encoder.piece_at[ids] - (np.cumsum(sizes) - sizes), sizes)
    return encoder.piece_bytes[places].tobytes()[:-1]


_ENCODERS: dict[int, SliceEncoder] = {}


def _encoder(shared) -> SliceEncoder:
    if shared.id_ not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id_] = SliceEncoder(shared.data.value)
    return _ENCODERS[shared.id_]


class _Shared:
    """A broadcast with an id by which a Python worker knows it again."""

    def __init__(self, data, id_: str):
        self.data, self.id_ = data, id_


def _share(df: DataFrame, tokenizer_json: str) -> _Shared:
    data = df.sparkSession.sparkContext.broadcast(load_tables(tokenizer_json))
    return _Shared(data, f"{tokenizer_json}#{id(data)}")


def _with_column(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, str]:
    df = df.drop(column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df, f"{fields}, `{column}` {kind}"


def encode_bpe(docs: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "ids",
               keep_text: bool = True) -> DataFrame:
    """Adds ``ids``: the token ids of the whole text as little-endian unsigned 32-bit integers (binary). Without
    ``keep_text`` the texts don't travel back from the Python workers."""
    shared = _share(docs, tokenizer_json)
    docs = docs.drop(ids)
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = _with_column(docs.select(*kept), ids, "binary")[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in slices(batch, text):
                rows = encoder.texts(part.column(text).to_pylist())
                column = pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), column], [*kept, ids])

    return docs.mapInArrow(run, schema)


def decode_bpe(docs: DataFrame, tokenizer_json: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the text of the token ids."""
    shared = _share(docs, tokenizer_json)
    docs, schema = _with_column(docs, decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared).encoder
        for batch in batches:
            for part in slices(batch, ids):
                texts = [decode_ids(encoder, np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace")
                         for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 [*part.schema.names, decoded])

    return docs.mapInArrow(run, schema)


def n_tokens(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("bigint")
