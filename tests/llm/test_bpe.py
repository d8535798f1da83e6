"""Byte-level BPE against the tiktoken library, round trips, streaming decode."""

import hashlib
import struct

import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe, queries

FILE = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(open(FILE, "rb").read())
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(text):
    ids = ENC.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True


def test_query_matches_library(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_bpe_transducer(spark, sf).collect():
        assert tuple(r)[1:] == expected(docs[r.doc_id])


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a" * 50000, 0), (3, "a" * 50000, 0), (4, "<|endoftext|> 中文 😀 \u0085 x\n\n", 0), (5, " " * 3000 + "x", 0)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id int, text string, n_tokens int"), FILE, P.PATTERN).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *expected(t)) for i, t, _ in rows)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id int, text string"), FILE, P.PATTERN).count() == 0


def test_tokens_leave_after_bounded_lookahead(monkeypatch):
    """Byte by byte: what is settled is a prefix of the result, never taken back, and lags by no more than two longest tokens."""
    one = bpe.Transducer(RANKS, max_moves=3000)
    longest = max(map(len, RANKS))
    for text in ("a" * 2000, "internationalization" * 40, "0123456789" * 99, "нация" * 300, "zqxjk" * 300, "=" * 999):
        want, state, ended = ENC._encode_single_piece(text), 0, []
        ends = {0}
        for t in want:
            ends.add(max(ends) + len(one.token[t]))
        for byte in text.encode():
            got = one.moves.get(state << 8 | byte)
            got = one._move(state, byte) if got is None else got
            state = got >> bpe.TOKEN
            ended.append(got)
            to = one.settled(state, ended)
            assert to in ends and len(ended) - to <= 2 * longest
        assert one._back(ended, len(ended)) == want == list(one.piece(text))
        assert len(one.moves) <= 3000
        monkeypatch.setattr(bpe, "FLUSH", 300)
        assert list(one.piece(text)) == want
        monkeypatch.undo()


def test_ranks_that_are_no_merges():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 300, b"ab": 301, b"zzz": 302}
    own, enc = bpe.Transducer(ranks), tiktoken.Encoding("odd", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcabc", "xabcx", "zzz", "zzzz", "abzzzbc", "bcab"):
        assert list(own.piece(text)) == enc.encode_ordinary(text)


machine, cut = bpe.Transducer(RANKS, max_moves=500, max_pieces=50), regex.compile(P.PATTERN).findall


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_random_text(text):
    ids = machine.encode(cut(text))
    assert list(ids) == ENC.encode_ordinary(text)
    data, utf8 = b"".join(bpe.decode_stream(machine.token, ids, 3)), bpe.Utf8Machine()
    assert "".join([*(utf8.feed(data[i : i + 1]) for i in range(len(data))), utf8.end()]) == text and utf8.ok


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12))
def test_utf8_machine_knows_bad_bytes(data):
    utf8 = bpe.Utf8Machine()
    utf8.feed(data)
    utf8.end()
    try:
        data.decode()
        good = True
    except UnicodeDecodeError:
        good = False
    assert utf8.ok == good
