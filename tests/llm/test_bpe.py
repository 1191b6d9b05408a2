import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
OURS = bpe.tokenizer(PATH, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(OURS.encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_as_library(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode([text])[0]) == text.encode()


@pytest.mark.parametrize(
    "text",
    ["", " ", "   ", " \n\n  x", "a" * 300, "ab" * 700, "  " * 900, "don't we'll I'd", "<|endoftext|>", "Straße ÄÖÜ ñandú", "日本語のテキスト", "🙂" * 90, "1234567890" * 40, "a　b\x85c\x1cd​e"],
)
def test_odd_texts(text):
    assert ids(text) == THEIRS.encode_ordinary(text)


def test_all_white_space_and_many_letters():
    points = [c for c in range(0x110000) if chr(c).isspace()] + random.Random(1).sample(range(0x10FFFF), 4000)
    for c in points:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}{chr(c)} b"
            assert ids(text) == THEIRS.encode_ordinary(text), hex(c)


def test_matrix_and_heap_agree():
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"theinraonst") for _ in range(rng.randint(2, 64))) for _ in range(300)]
    for p, row in zip(pieces, OURS.merge_rows(pieces, 64)):
        assert row.tolist() == OURS.merge_long(p).tolist()


def test_frames(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "hello world\n" * 9000, 3), (3, "x", 4), (None, "é", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.decode_documents(bpe.encode_documents(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted((t or "") for _, t, _ in rows)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    at_once = bpe.encode_documents(df, PATH, P.PATTERN, decode=True).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    assert bpe.encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0
