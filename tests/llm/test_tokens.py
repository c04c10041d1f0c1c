"""Packing and token counts against the tokenizers library."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitrine.llm import byte_bpe, packing, queries, token_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
THEIRS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
THEIRS.encode_special_tokens = True
TEXTS = ["", None, "one line", "été\n\nübel 日本 😀\n", "a\n" * 700, " ".join(f"w{i}" for i in range(4000)),
         "same", "same", "x <|endoftext|> y"]


def ids(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (3, "twice", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def check_pieces(rows, texts, window=packing.WINDOW):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    lost = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        lost += 0 if at & (at - 1) == 0 else window - at
    for (doc_id, n), pieces in by_doc.items():
        want = next(x for x in ([*ids(t), 0] for d, t in texts if d == doc_id) if len(x) == n)
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            part = np.array(want[at:at + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == n
    return lost


def test_pack(docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    lone = docs.where("doc_id is null or doc_id not in (6, 7)")
    rows = packing.pack(lone, RANKS, PATTERN).collect()
    assert check_pieces(rows, texts) == 0
    assert sum(r.length for r in packing.pack(docs, RANKS, PATTERN).collect()) == sum(len(ids(t)) + 1 for _, t in texts)
    assert packing.pack(docs.limit(0), RANKS, PATTERN).count() == 0


def test_pack_many_partitions(spark):
    docs = spark.range(700).selectExpr("id doc_id", "repeat(concat('word', id, ' '), cast(id % 90 as int)) text")
    rows = packing.pack(docs.repartition(7), RANKS, PATTERN, open_windows=3).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_pieces(rows, texts) == 0
    assert sum(r.length for r in rows) == sum(len(ids(t)) + 1 for _, t in texts)


def test_pack_added_tokens(spark, tmp_path):
    """Ids of the query equal those of the library's default settings."""
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n\n b <|endoftext", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_packing(spark, str(tmp_path)).collect()
    for i, text in enumerate(texts):
        want = [*theirs.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert {r.doc_tokens for r in own} == {len(want)} and sum(r.length for r in own) == len(want)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start:r.start + r.length], "<u4").tobytes())


def brute(text, spans, rule):
    """Sections by the library's own offsets."""
    enc = THEIRS.encode(text or "", add_special_tokens=False)
    out = {}
    for a, b in enc.offsets:
        own = {k: min(b, e) - max(a, s) for k, (s, e) in enumerate(spans) if min(b, e) > max(a, s)}
        at = a if rule == "start" else b - 1
        if rule == "most":
            k = min(own, key=lambda k: (-own[k], k), default=-1)
        else:
            k = next((k for k, (s, e) in enumerate(spans) if s <= at < e), -1)
        out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_line_counts(docs, rule):
    rows = token_counts.count(docs.where("doc_id < 6 and text <> 'twice' or text is null"), RANKS, PATTERN,
                              rule=rule).collect()
    for i, text in enumerate(TEXTS[:6]):
        spans, at = [], 0
        for line in (text or "").split("\n"):
            spans.append((at, at + len(line) + 1))
            at += len(line) + 1
        spans[-1] = (spans[-1][0], spans[-1][1] - 1)
        own = [r for r in rows if r.doc_id == i]
        assert [(r.start, r.end) for r in sorted(own, key=lambda r: r.section)] == spans
        assert {r.section: r.n_tokens for r in own if r.n_tokens} == brute(text, spans, rule)
        assert {r.doc_tokens for r in own} == {len(ids(text))}


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_given_sections(spark, rule):
    text = "alpha beta\n\n\ngamma été delta epsilon"
    spans = [(2, 8), (9, 9), (11, 12), (12, 20)]
    df = spark.createDataFrame([(1, text, [dict(start=a, end=b) for a, b in spans]), (2, text, None)],
                               "doc_id long, text string, s array<struct<start: long, end: long>>")
    rows = token_counts.count(df, RANKS, PATTERN, sections_col="s", rule=rule).collect()
    assert {r.section: r.n_tokens for r in rows if r.doc_id == 1 and r.n_tokens} == brute(text, spans, rule)
    assert [(r.section, r.n_tokens) for r in rows if r.doc_id == 2] == [(-1, len(ids(text)))]
    assert token_counts.count(df.limit(0), RANKS, PATTERN).count() == 0


LONG = [" ", "\n", " \n\t", "　", "\r\n\x0b\x0c\x85\xa0 "]


def test_long_white_space_like_tokenizers():
    import tiktoken
    from tokenizers import Tokenizer

    from vitrine.llm.rank_tokens import added_tokens, encode
    path = public_tokenizers.path("byte_bpe_50k.json")
    added = added_tokens(path)
    ranks = {t: i for t, i in byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).items() if i not in added.values()}
    ours = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    want = Tokenizer.from_file(path)
    name = next(iter(added))
    texts = [a + blank * n + b for blank in LONG for n in (4096, 5000) for a, b in (
        ("", ""), ("word", "word"), ("a ", " b"), ("a", name + " c"), (name, ""), ("1", "!x"), ("", "\nx"))]
    texts += [" " * 1_000_000, "\n" * 1_000_000, "word" + " " * 1_000_000 + "word"]
    for t in texts:
        assert encode(ours, t, added=True).tolist() == want.encode(t, add_special_tokens=False).ids, (t[:5], len(t), t[-5:])


def test_a_million_spaces_pass_both_operators(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "word" + "\n" * 1_000_000 + "word"), (3, "x")], "doc_id long, text string")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    packed = packing.pack(docs, *vocabulary)
    totals = {r[0]: r[1] for r in packed.groupBy("doc_id").sum("length").collect()}
    counted = token_counts.count(docs, *vocabulary).collect()
    assert set(totals) == {1, 2, 3} and len(counted) >= 3
