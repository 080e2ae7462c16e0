import math
import random
import re
from collections import Counter

import numpy as np

from tablewright.llm import ranked_search

WORDS = ["a", "b", "See", "sea", "x1", "É", "é", "日本", "long", "the", "The", "of", "rare", "odd", "zz"]


def expected(docs, items, k):
    find = re.compile(ranked_search.TERM).findall

    def terms(text):
        return find(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))

    own = [(i, terms(t)) for i, t in docs]
    own = [(i, len(t), Counter(t)) for i, t in own if t]
    n, size = len(own), sum(x[1] for x in own)
    df = Counter(t for x in own for t in x[2])
    out = []
    for item, wanted in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        scored = []
        for doc, length, tf in own:
            m = 50 + (50 * length * n) // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in wanted if tf[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


def drawn(n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=draw.randint(0, 30))) for _ in range(n)]


def test_equals_scoring_everything(spark, monkeypatch):
    docs = [*enumerate(drawn(500, 1)), (None, "sea sea"), (900, None), (901, "-- .."), (902, "sea"), (902, "sea"), *[(1000 + i, "odd one zz") for i in range(300)], (5, "the " * 50_000)]
    random.Random(3).shuffle(docs)
    items = [*enumerate(drawn(40, 2)), (7, "zz odd"), (7, "zz odd"), (8, None), (9, "nowhere"), (41, "!!")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, TF string").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    want = {k: expected(docs, items, k) for k in (1, 50)}
    for limits in ({}, {"TREE_DOCS": 40, "BLOCK_BYTES": 2000, "MERGED_PARTITIONS": 1}):
        for name, value in limits.items():
            monkeypatch.setattr(ranked_search, name, value)
        for k in want:
            got = ranked_search.search(df, asked, k)
            assert got.columns == ["item_id", "rank", "doc_id", "score"]
            assert Counter(map(tuple, got.collect())) == want[k]
    assert ranked_search.search(df.limit(0), asked).count() == 0
    assert ranked_search.search(df, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    draw = random.Random(5)
    terms = [f"t{i}" for i in range(60)]
    items = ranked_search.Items([draw.sample(terms, 4) for _ in range(12)], {t: 60 - i for i, t in enumerate(terms)}, 4000)
    vectors = []
    for doc in range(4000):
        ranks = sorted({min(int(draw.expovariate(0.1)), len(items.rank) - 1) for _ in range(8)})
        tf = [draw.randint(1, 5) for _ in ranks]
        vectors.append((np.array(ranks, ">u4").tobytes(), np.array(tf, ">u4").tobytes(), draw.randint(50, 150), doc))
    scored = [(items.scores(np.frombuffer(r, ">u4").astype(int), np.frombuffer(t, ">u4").astype(int), m), d) for r, t, m, d in vectors]
    root = ranked_search.document_tree(list(vectors), 5)
    todo, nodes = [root], 0
    while todo:
        node = todo.pop()
        nodes += 1
        bound = items.scores(node.ranks, node.tf, node.m)
        for child in node.children:
            assert (items.scores(child.ranks, child.tf, child.m) <= bound).all()
        todo += node.children
    best = ranked_search.Best(items.n_items, 5)
    assert best.search(root, items) < 0.75 * nodes
    for item in range(items.n_items):
        want = sorted(((-s[item], d) for s, d in scored if s[item] > 0))[:5]
        assert sorted((-s, -d) for s, d in best.found[item]) == want
