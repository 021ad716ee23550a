import random

import numpy as np
import pytest

from geotables.llm.bpe import SliceEncoder, decode_bpe, decode_ids, encode_bpe, load_tables
from geotables.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

ODD = ["", "I'm we'll they've 's ''s 'sx 'rex 'r it's'd l'l",
       "<|startoftext|>Hello<|endoftext|> wORLD 12345 ½ ²x ΑΣ ΣΑΣ İstanbul 日本語 🙂🙂👍🏽 \x1c\x1fa b　c", "<|startoftext|",
       "a" * 5000, "!!!!....???---====" * 30, "\r\n\t x", "éé x" * 50]


def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_words_and_odd_texts_like_the_library():
    rnd = random.Random(3)
    pool = "abcdefghijklmnopqrstuvwxyz'''   ÀÉßéñü123½!?.,;:-_#$\ń̈ΣσςЖж漢字🙂 İǅ"
    texts = ODD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    encoder, lib = SliceEncoder(load_tables(tokenizer_path())), library()
    for text, got, want in zip(texts, encoder.texts(texts), lib.encode_batch(texts, add_special_tokens=False),
                               strict=True):
        assert got.tolist() == want.ids, text
        assert decode_ids(encoder.encoder, got).decode() == lib.decode(want.ids, skip_special_tokens=False)


def test_every_token_text_as_a_word():
    encoder, lib = SliceEncoder(load_tables(tokenizer_path())), library()
    words = [t.removesuffix("</w>") for t in lib.get_vocab()][::7]
    got = encoder.texts(words)
    assert [g.tolist() for g in got] == [e.ids for e in lib.encode_batch(words, add_special_tokens=False)]


def test_every_code_point_like_the_library():
    encoder, lib = SliceEncoder(load_tables(tokenizer_path())), library()
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    # as the first letter of a word, between letters, and after a number
    texts = ["".join(f"{c}ab a{c}b 1{c} " for c in points[i:i + 64]) for i in range(0, len(points), 64)]
    wrong = [t for t, got, want in zip(texts, encoder.texts(texts), lib.encode_batch(texts, add_special_tokens=False))
             if got.tolist() != want.ids]
    assert not wrong, (len(wrong), wrong[0][:40])


def test_long_words_that_a_polynomial_hash_confuses():
    a = "".join("xy"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("xy", "yx"))
    encoder, lib = SliceEncoder(load_tables(tokenizer_path())), library()
    texts = [a, b, f"{a} {b}", f"{b} {a}"]
    assert [g.tolist() for g in encoder.texts(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_columns_nulls_and_repeats(spark):
    rows = [(1, None, "i", 3), (2, "", "i", 3), (3, "Hello the world", "i", 4), (3, "Hello the world", "i", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded int")
    out = decode_bpe(encode_bpe(df, tokenizer_path()), tokenizer_path()).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["", "", "hello</w> the</w> world</w>", "hello</w> the</w> world</w>"]
    assert [len(r.ids) for r in out] == [0, 0, 12, 12]
    assert np.frombuffer(out[2].ids, "<u4").tolist() == library().encode("Hello the world", add_special_tokens=False).ids
    assert encode_bpe(df.limit(0), tokenizer_path()).collect() == []
