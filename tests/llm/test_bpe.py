import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veridelta.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(PATH, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabcdeth '\n\t  s9é日🎉=- 　\x1c\x85", max_size=80))
def test_same_as_library(ours, theirs, text):
    ids = ours.encode(text).tolist()
    assert ids == theirs.encode_ordinary(text)
    assert bpe._decoder(ours).decode(ids) == text


@pytest.mark.parametrize("text", ["", " ", "a" * 30000, "ab" * 9000, "=" * 3000, "日本" * 3000, "x  y \n z", " lead", "trail "])
def test_long_and_odd(ours, theirs, text):
    assert ours.encode(text).tolist() == theirs.encode_ordinary(text)


def test_bounded_tables(theirs):
    enc = bpe.Encoder(PATH, P.PATTERN, bound=5)
    enc.machine.max_states = 20
    for text in ["the quick brown fox jumps over lazy dogs", "zxcvbnmasdf" * 40, "qwertyuiop asdfgh zxcvb" * 9]:
        assert enc.encode(text).tolist() == theirs.encode_ordinary(text)


def test_utf8_machine_replaces_as_python_does():
    for raw in (b"\xe2\x82", b"\xff\xfea", b"\xe0\x80\x80", b"\xf0\x9f\x8e\x89!", b"\xed\xa0\x80", b"\xc3("):
        machine = bpe.Utf8Machine()
        state, out = machine.feed(b"", raw)
        assert out + ("�" if state else "") == raw.decode("utf-8", "replace")


def test_table(spark, theirs):
    rows = [(1, "Hello wörld", 5), (2, None, 6), (None, "", 7), (1, "Hello wörld", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 long")
    found = sorted(bpe.digests(docs).collect(), key=str)
    assert len(found) == 4
    want = theirs.encode_ordinary("Hello wörld")
    mine = [r for r in found if r.doc_id == 1]
    assert mine[0] == mine[1] and mine[0].n_tokens == len(want)
    assert mine[0].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
    assert mine[0].decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert {r.n_tokens for r in found if r.doc_id != 1} == {0}
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(r.text for r in back) == ["", "", "Hello wörld", "Hello wörld"]
    assert bpe.digests(docs.limit(0)).count() == 0


def test_unfinished_code_points_only_step_to_their_end():
    """Tokens after a split code point are taken whole again; chunks give the same ids as the pattern."""
    enc = bpe.Encoder(bpe.default_vocabulary(), bpe.default_pattern())
    plain = bpe.Encoder(bpe.default_vocabulary(), bpe.default_pattern() + "|(?!)")
    text = "Ĳ one two. 𐍈three four, \U0001f9ff five!\nsix abc's ÍÑ x1 ²y " + "word " * 50 + "end"
    ids = enc.encode(text).tolist()
    assert ids == plain.encode(text).tolist() and plain.chunks is None and enc.chunks
    dec = bpe.StreamDecoder(enc.machine.bytes_of)
    assert dec.decode(ids) == text
    moved, move = [], dec._move
    dec._move = lambda token: moved.append(token) or move(token)
    for cut in range(len(ids) + 1):
        assert dec.feed(ids[:cut]) + dec.feed(iter(ids[cut:])) + dec.close() == text
    moved.clear()
    assert dec.decode(ids) == text and 0 < len(moved) < 30 < len(ids)
    assert dec.decode(()) == "" and dec.decode(ids[:-1]) == text.removesuffix(enc.machine.bytes_of[ids[-1]].decode())
