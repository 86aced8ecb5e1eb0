import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import op2_byte_bpe as op

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DATA = open(PATH, "rb").read()
CODEC = op.Codec(DATA, PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return list(memoryview(CODEC.encode(text)).cast("I")) if text else []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab éßx'\n\t  .,1234<|>\U0001f600中"), max_size=60))
def test_equals_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_long_pieces_and_spaces():
    for text in ("a" * 5000, "ab" * 3000, "x  y   z ", " a\n b", "don't we'll", "the  \n\n end", "<|endoftext|>"):
        assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1. \u00a0\u2003\n\t\r\x1c\x85"), max_size=40))
def test_white_space_of_any_kind_beside_spaces(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_no_break_spaces_beside_spaces():
    for text in ("word \u00a0 \u00a0 word", "x \u00a0 \u00a0\ny", "a\u00a0 b \u00a0c", " \u00a0", "\n \n"):
        assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=40), min_size=1, max_size=30))
def test_merging_in_step_equals_merging_one_by_one(pieces):
    got = op.merge_many(pieces, CODEC.pairs)
    assert [list(memoryview(x).cast("I")) for x in got] == [op.merge(p, RANKS, whole=False) for p in pieces]


def test_many_texts_at_once():
    import random

    rng = random.Random(5)
    parts = ["the", "Straße", "undeniably", "x\u00e9x\u00e9x\u00e9", "don't", "1234567", "...", "\n", "a" * 90, "\U0001f600\U0001f600"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for _ in range(2):
        got = [list(memoryview(x).cast("I")) for x in CODEC.encode_all(texts)]
        assert got == [LIBRARY.encode_ordinary(x) for x in texts]


def test_unknown_and_cut_off_ids():
    assert CODEC.decode(b"\xff\xff\xff\xff") is None and CODEC.decode(b"\x01\x00") is None and CODEC.decode(b"") == b""


def test_memory_forgets_but_stays_right(monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 5)
    codec = op.Codec(DATA, PATTERN)
    for k in range(30):
        text = " ".join(f"word{j} forth{k}" for j in range(k))
        assert list(memoryview(codec.encode(text)).cast("I")) == LIBRARY.encode_ordinary(text)


def test_table(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "hello world"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS decoded")
    out = {(r.doc_id, r.text): r for r in op.round_trip(df, PATH, PATTERN).collect()}
    assert bytes(out[1, "hello world"].decoded) == b"hello world" and bytes(out[2, None].ids_le) == b""
    assert op.round_trip(df.limit(0), PATH, PATTERN).count() == 0
    two = op.decode(op.encode(df.drop("decoded"), PATH, PATTERN), PATH, PATTERN).collect()
    assert {bytes(r.decoded) for r in two} == {b"hello world", b"", b"x"}


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "Ein Satz."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    assert out[1].n_tokens == len(LIBRARY.encode_ordinary("Ein Satz."))
    assert out[1].decoded_sha256 == hashlib.sha256(b"Ein Satz.").hexdigest() and out[2].n_tokens == 0
