import os
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import rans, token_output
from causeway.llm.registry import tokenizer_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"

ODD = [
    "", " ", "Hello, world! It's o'clock; they'll don't I'M 'S 's' ,., !?", "x<|endoftext|>y <|startoftext|>, <|ENDOFTEXT|> The", "ÉCOLE Été é É, İstanbul İ ΣΑΣ straße K",
    "1234, 12.5% a1, b2: c.d.e., a.,b ...", "a b c\x1cd\x85e", "日本語。テキスト, ok", "tab\tnew\nline\x0b\x0c\rend.", "word's. word'. 'word, don't.", "🙂, 🙂. é, è.",
]


@lru_cache
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(texts, path=None):
    t = library(path or tokenizer_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids(texts):
    return [np.frombuffer(x, "<u2").tolist() for x in token_output.encode_texts([t.encode() for t in texts], tokenizer_path())]


def test_words_give_the_ids_of_whole_texts():
    assert ids(ODD) == plain(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abIKSİ'.,;<|>é́ \n\t12🙂Σß_-")), max_size=30), max_size=5))
def test_any_texts(texts):
    assert ids(texts) == plain(texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abé \u0958\u095f\u0932\u092e\u09dc\u0a33\ufb1d\ufb2a\ufb4e\u05d0\u0f43")), max_size=20), max_size=5))
def test_letters_that_nfc_takes_apart(texts):
    token_output.pieces_of(tokenizer_path(), None).forget()
    texts = ["the \u0958\u0932\u092e hello world", *texts]
    assert ids(texts) == plain(texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("JHTWYKajhtwy .,\u030c\u0331\u0308\u030a\u0301\u0323\u05b0")), max_size=20), max_size=5))
def test_capitals_with_marks(texts):
    texts = ["H\u0331a", "J\u030c T\u0308 W\u030a Y\u030a", *texts]
    assert ids(texts) == plain(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abzKİıéçßÿ×÷Āȿ'’.,;:!?-_=<>|/\\\"#@&1209\u0338\u0307\xa0\u2003\x00\x1c \n日я")), max_size=40), max_size=6))
def test_borders_of_pieces(texts):
    texts = ["don't 'tis rock'n'roll x'S 'll'd ''s", "a1b22c é1, É. İ, ×2 ÷é= ≠=\u0338a", "http://a.b/c?d=e&f#g a_b-c", "x" * 100 + "\x00" + "é" * 40, *texts]
    assert ids(texts) == plain(texts)


def test_random_code_points():
    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in np.where(rng.random(60) < 0.5, rng.integers(32, 127, 60), rng.choice([*range(0xA0, 0x590), *range(0x900, 0xA00), *range(0x1E00, 0x2100), *range(0x3040, 0x3100)], 60))) for _ in range(2000)]
    assert ids(texts) == plain(texts)


def test_capitals_are_lowered_only_where_nfc_agrees():
    import unicodedata

    joined = {m for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x11000)]) if len(unicodedata.normalize("NFC", c + m)) == 1}
    assert joined and all(m.encode()[0] in (0xCC, 0xCD) for m in joined)


def test_other_vocabularies_encode_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Hello world, This is  a Test", "", "É\n\n x<|endoftext|>"]
    got = token_output.encode_texts([t.encode() for t in texts], path)
    kind = token_output.pieces_of(path, None).kind
    assert [np.frombuffer(x, kind).tolist() for x in got] == plain(texts, path)


def test_memo_starts_afresh(monkeypatch):
    monkeypatch.setattr(token_output, "MEMO", 5)
    texts = [f"w{i} common, x{i}" for i in range(20)]
    assert [r for t in texts for r in ids([t])] == plain(texts)


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 70000, 140001])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    x = np.minimum(rng.zipf(1.3, n), 49406).astype(np.uint32)
    table = rans.Table.of(np.bincount(np.append(x, 1)))
    assert table.freq.sum() == 1 << rans.SCALE
    block = rans.encode_block(np.array([7]), np.array([n]), x, table)
    docs, sizes, back = rans.decode_block(block, table)
    assert docs.tolist() == [7] and sizes.tolist() == [n] and (back == x).all()
    for i in range(-(-n // rans.CHECKPOINT)):
        assert (rans.decode_block(block, table, range(i, i + 1))[2] == x[i * rans.CHECKPOINT :][: rans.CHECKPOINT]).all()
    if n > 2000:
        assert len(block) < 4 * n + 20000
        bad = bytearray(block)
        bad[-5] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(bad), table)


def test_one_id_only():
    x = np.ones(5000, np.uint32)
    table = rans.Table.of(np.bincount(x))
    assert (rans.decode_block(rans.encode_block(np.array([1]), np.array([5000]), x, table), table)[2] == x).all()


def test_documents(spark, tmp_path):
    rows = [(5, "Hello, world"), (3, None), (4, ""), (9, "a " * 3000), (5, "again"), (None, "no id"), (1, "Été"), (-(1 << 63), "least id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    folder = str(tmp_path / "tokens")
    token_output.write(df, tokenizer_path(), to=f"file://{folder}")
    got = sorted(token_output.read(spark, f"file://{folder}").collect(), key=lambda r: r.start)
    want = {}
    for (i, t), x in zip(rows, plain([t or "" for _, t in rows])):
        want.setdefault(i, []).append((len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())))
    assert [r.doc_id for r in got] == [None, -(1 << 63), 1, 3, 4, 5, 5, 9]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.read(*token_output.write(df, tokenizer_path())).collect() == []
