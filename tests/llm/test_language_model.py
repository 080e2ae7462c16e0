import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import tablewright.llm.language_model as lm
from tablewright.llm.common import ascii_lower, words_of


class Plain:
    """The same model from plain dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words, self.history = Counter(), Counter(), Counter()
        for t in texts:
            before = ("start",)
            for w in [*words_of(ascii_lower(t or "")), ""]:
                self.pairs[before, w] += 1
                self.words[w] += 1
                self.history[before] += 1
                before = w
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.d1, self.d2 = (lm.discounts(Counter(c.values())) for c in (self.words, self.pairs))
        self.unknown = 1 - sum(c * self.d1[min(c, 6)] for c in self.words.values()) / self.n
        self.after = defaultdict(list)
        for (h, w), c in self.pairs.items():
            self.after[h].append((w, c))

    def single(self, w):
        c = self.words.get(w, 0)
        return c * self.d1[min(c, 6)] / self.n if c else self.unknown

    def pair(self, h, w):
        if h not in self.after:
            return self.single(w)
        c = self.pairs.get((h, w), 0)
        if c:
            return c * self.d2[min(c, 6)] / self.history[h]
        spare = 1 - sum(x * self.d2[min(x, 6)] for _, x in self.after[h]) / self.history[h]
        return spare / (1 - sum(self.single(x) for x, _ in self.after[h])) * self.single(w)


def corpus(seed=1):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4))) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    texts = [" ".join(draw.choices(words, weights, k=draw.randint(1, 60))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "New WORDS here"), (203, "new words\x0bHERE"), (None, texts[0]), (204, "a " * 20000), (204, "a " * 20000)]


@pytest.mark.parametrize("block,bucket", [(2_000_000, 4_000_000), (300, 500)])
def test_scores_equal_the_plain_model(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", bucket)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, Score double").repartition(3)
    if block < 1000:
        # Tasks run in other processes: small inputs per partition stand for small blocks.
        df = df.repartition(9)
    learn = F.coalesce(F.col("doc_id") % 5 != 2, F.lit(True))
    got = lm.katz_scores(df, learn).collect()
    assert len(got) == len(rows)
    plain = Plain([t for i, t in rows if i is None or i % 5 != 2])
    known = list(plain.words)
    for h in [*random.Random(2).sample(known, 30), ("start",), "never"]:
        assert abs(sum(plain.pair(h, w) for w in [*known, None]) - 1) < 1e-9
    by_text = {}
    for i, t in rows:
        tokens = [*words_of(ascii_lower(t or "")), ""]
        score = sum(math.log10(plain.pair(h, w)) for h, w in zip([("start",), *tokens], tokens))
        base = sum(math.log10((plain.words[w] + 1) / (plain.n + plain.v + 1)) for w in tokens)
        by_text[i] = (len(tokens), sum(w in plain.words for w in tokens), plain.n, base, score)
    for r in got:
        n, k, total, base, score = by_text[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, k, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9), (r, score)


def test_edges(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lm.katz_scores(df.limit(0), F.lit(True)).count() == 0
    nothing = lm.katz_scores(df, F.lit(False)).collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in nothing} == {(0.0, 0.0, 0, 0)}
    for values in (np.arange(5), np.zeros(0, np.int32), np.array([1.5, -2.0]), np.array([1 << 40])):
        assert lm.unpack(lm.pack(values)).tolist() == values.tolist()
