import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = byte_bpe.read_ranks(PATH)
ENCODER = byte_bpe.Encoder(RANKS, PATTERN)
THEIRS = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  \n\t x", "a\x1cb\x1f c", "x²½ Ⅷ ٣", "don't we'll I'M", "été übel ñandú", "日本語 text", "é a​b c",
       "_a__ b_", "a\x85b", "<|endoftext|>", "x" * 5000, "ab" * 3000, "  　 y", "\x00\x01\x7f", "😀😃 ok", "ªº µ × ÷"]


def ids(text):
    return np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist()


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(5000)]
    h = byte_bpe.PerfectHash(keys)
    assert h.find(keys) == list(range(5000)) and sorted(h.index.tolist()) == list(range(5000))
    assert set(h.find([b"x", b"", b"5000"])) == {-1}
    assert byte_bpe.PerfectHash([]).find([b"a"]) == [-1]


@pytest.mark.parametrize("text", ODD)
def test_like_the_library_on_odd_texts(text):
    assert ids(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_like_the_library_on_any_text(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert ENCODER.decode(ENCODER.encode([text])[0]) == text.encode()


def test_memo_overflow(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_WORDS", 8)
    enc = byte_bpe.Encoder(RANKS, PATTERN)
    text = " ".join(f"word{i} etation{i}" for i in range(40))
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == THEIRS.encode_ordinary(text)


def test_table(spark):
    docs = spark.createDataFrame([(1, t, "n") for t in ODD] + [(None, None, "x"), (1, "a", None)],
                                 "doc_id long, text string, n_tokens string")
    rows = byte_bpe.round_trip(docs, PATH, PATTERN).collect()
    want = sorted([hashlib.sha256((t or "").encode()).hexdigest() for t in [*ODD, None, "a"]])
    assert sorted(r.decoded_sha256 for r in rows) == want
    enc = byte_bpe.encode(docs, PATH, PATTERN)
    back = byte_bpe.decode(enc, PATH, PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for t in [*ODD, None, "a"])
    assert byte_bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
