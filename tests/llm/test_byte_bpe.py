import hashlib
import re
import struct

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsieve.llm import byte_bpe as B

PATH, PATTERN = public_tokenizers.path(B.RANKS), public_tokenizers.PATTERN
ENC = B.load(PATH, PATTERN)


def expected(text):
    ids = ENC.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é1 \n\t'sü.- \x1c漢"), max_size=200), st.integers(1, 12))
def test_parts_encode_as_the_whole(text, size):
    parts = list(B.safe_parts(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t\x1c\u3000\xa0's."), max_size=60), st.integers(2, 6))
def test_runs_of_white_space_are_single_matches(text, run):
    parts = list(B.pieces(text, 5, run))
    assert "".join(p for p, _ in parts) == text
    assert [i for p, single in parts for i in (ENC._encode_single_piece(p) if single else ENC.encode_ordinary(p))] == ENC.encode_ordinary(text)


def test_white_space_is_what_the_pattern_takes_for_it():
    for c in map(chr, range(0x3100)):
        own = bool(re.fullmatch(f"[{B.WHITE}]", c))
        assert own == bool(regex.fullmatch(r"\p{White_Space}", c))


def test_very_long_runs_of_white_space():
    for run in (" ", "\n", "\t", " \t", "\r\n", "\u3000"):
        for text in (run * 150_000, f"a {run * 150_000} b", f"a{run * 150_000}b\n"):
            assert B.encode_text(ENC, text).tolist() == ENC.encode_ordinary(text)
        for text in (run * 1_000_000, f"word {run * 5_000_000}end of it"):
            ids = B.encode_text(ENC, text)
            assert B.decode_ids(ENC, ids) == text.encode()


def test_query_cases(spark):
    texts = [None, "", "the cat's  \n hat", "x" * 70_000, "a b " * 40_000, " " * 150_000 + "x", "the cat's  \n hat", "naïve 漢字 🙂 <|endoftext|>"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: tuple(r)[1:] for r in B.digests(df, PATH, PATTERN).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    assert B.digests(df.limit(0), PATH, PATTERN).count() == 0
    back = B.decode(B.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in back} == {i: t or "" for i, t in enumerate(texts)}
