import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewright.llm.bpe import ByteBPE, encode_decode, read_spec
from tablewright.llm.token_counts import LongestMatch, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "   ", "\n", "\t", "'s", "é", "日本", "1", "!", "\x85", " ", "\x1c", "<|endoftext|>", "the", " The", "🎉", "\x00", "aaaa"]


@pytest.fixture(scope="module")
def coder():
    return ByteBPE(read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 16))) for _ in range(n)]


def test_ids_equal_the_library(coder, library):
    for text in [*texts(3000, 1), "a" * 20000, "x y " * 5000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_operator_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "Two words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = {(r.doc_id, tuple(r.ids), r.decoded) for r in encode_decode(df, PATH).collect()}
    assert out == {(1, (), ""), (2, (), ""), (3, (7571, 2456), "Two words")}
    assert encode_decode(df.limit(0), PATH).count() == 0


def test_longest_match_is_greedy(spark, coder):
    tokens = [raw for raw in coder.bytes_of if raw]
    known, longest, matcher = set(tokens), max(map(len, tokens)), LongestMatch(tokens)

    def plain(raw):
        n = at = 0
        while at < len(raw):
            at += next(size for size in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + size] in known)
            n += 1
        return n

    sample = texts(500, 2)
    assert [matcher.of_text(t) for t in sample] == [sum(plain(p.encode()) for p in matcher.split(t)) for t in sample]
    df = spark.createDataFrame([(None, "a"), ("", "b"), ("Two words", "c")], "text string, N_tokens string")
    assert [r.n_tokens for r in count_tokens(df, PATH).collect()] == [0, 0, 2]
