import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewright.llm import alignment
from tablewright.llm.bpe import byte_characters

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "'s", "é", "日本", "1", "23", "!", "<|endoftext|>", "<s>", "the", " The", "🎉", "ll", "internationally", "\x00", "▁", "<0x41>"]


@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(PATH_A)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    to_byte = byte_characters()

    def ranges(parts):
        at = 0
        for i, raw in parts:
            yield i, at, at + len(raw)
            at += len(raw)

    def of(text):
        """Ids, links as id pairs and groups of one text, by plain loops."""
        if not text:
            return [], [], [], []
        raw = (" " + text).encode()
        a = [(i, bytes(to_byte[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            piece = pieces.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return [], [], [], []
        a, b = list(ranges(a)), list(ranges(b))
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        groups, low = [], 0
        for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append(([i for i, s, e in a if low <= s and e <= end], [j for j, s, e in b if low <= s and e <= end]))
            low = end
        return [x[0] for x in a], [x[0] for x in b], links, groups

    return of


def expected(texts, of):
    parts = [of(t) for t in texts]
    count = Counter(pair for p in parts for pair in p[2])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, links, groups in parts:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(written.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups),
        ))
    return out


def drawn(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_counts_equal_plain_loops(spark, plain, monkeypatch):
    texts = [None, "", *drawn(400, 1), "the same text", "the same text", "x" * 3000, "word and word " * 200]
    rows = [(n // 2 if n > 4 else n, t, "own", 7) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, body string, n_a string, at int").repartition(3)
    want = Counter(zip([r[0] for r in rows], expected(texts, plain)))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]
    for limit in (None, 300):
        if limit:  # many blocks, dictionaries of several rows and products of several blocks
            for name in ("BLOCK_LINKS", "DICTIONARY_ROWS", "SLICE_BYTES", "BLOCK_NONZEROS"):
                monkeypatch.setattr(alignment, name, limit)
        got = alignment.link_counts(df, PATH_A, PATH_B, "id", "body").collect()
        assert Counter((r["id"], tuple(r[c] for c in columns)) for r in got) == want
    assert alignment.link_counts(df.limit(0), PATH_A, PATH_B, "id", "body").count() == 0


def test_links_and_groups_in_place(spark, plain):
    texts = [None, "", *drawn(60, 2)]
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, ALIGNMENT string")
    for row in alignment.token_links(df, PATH_A, PATH_B).collect():
        a, b, links, groups = plain(row["text"])
        got = row["alignment"]
        assert (list(got.a_ids), list(got.b_ids)) == (a, b)
        assert [(a[x.a], b[x.b]) for x in got.links] == links
        assert [(a[g.a_from : g.a_to], b[g.b_from : g.b_to]) for g in got.groups] == groups


def test_row_product_is_a_matrix_product(monkeypatch):
    draw = np.random.default_rng(3)
    for block in (1 << 20, 5):
        monkeypatch.setattr(alignment, "BLOCK_NONZEROS", block)
        left, right = (draw.random((9, 13)) < 0.3), (draw.random((7, 13)) < 0.3)
        a, b = [alignment.Csr(alignment.starts_of(m.sum(1)), np.nonzero(m)[1].astype(np.int32), m.shape[1]) for m in (left, right)]
        rows, columns, values = alignment.row_product(a, b.transposed())
        dense = np.zeros((9, 7), int)
        dense[rows, columns] = values
        assert (dense == left.astype(int) @ right.T.astype(int)).all()


def test_very_long_words():
    with open(PATH_B, "rb") as f:
        known = alignment.Aligner(alignment.read_spec(PATH_A), f.read())
    found = known.links(["ab" * 300_000, " " * 200_000 + "x", "é" * 100_000])
    assert (np.diff(found.link_at) > 0).any() and found.shared.sum() == known.a_sizes[found.a_ids].sum()
