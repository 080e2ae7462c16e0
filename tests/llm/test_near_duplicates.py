import random

import pytest

import tablewright.llm.near_duplicates as nd
from tablewright.llm.common import ascii_lower, words_of


def brute(rows, words, percent):
    """doc_id -> (n, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words_of(ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed=1, near=40):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    texts = [" ".join(prose(draw.randint(1, 150))) for _ in range(40)]
    for _ in range(6):
        base = prose(draw.randint(30, 200))
        for _ in range(draw.randint(2, 8)):
            copy = list(base)
            for _ in range(draw.randint(0, len(base) // 12)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    base = prose(120)
    for i in range(near):  # a large group: each a few words from the base
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(120)] = word()
        texts.append(" ".join(copy))
    chain = prose(200)
    for step in range(6):  # neighbours are linked, the ends are not
        chain[step * 9 : step * 9 + 4] = prose(4)
        texts.append("  ".join(chain))
    texts += ["one", "One", "two words", "TWO\twords", None, "", " \n", texts[0].upper(), texts[0], texts[0]]
    texts.append(" ".join(prose(6)) * 3000)
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(7 * i, t) for i, t in zip(order, texts)]


@pytest.mark.parametrize("words,percent,leaf,block", [(3, 85, 256, 1000), (5, 80, 256, 1000), (3, 85, 4, 12)])
def test_components_against_all_pairs(spark, monkeypatch, words, percent, leaf, block):
    monkeypatch.setattr(nd, "LEAF", leaf)
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, KEPT string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, words=words, percent=percent).collect()}
    expected = brute(rows, words, percent)
    assert {i: g[:2] for i, g in got.items()} == expected
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_rows_that_stay(spark):
    rows = [(5, "a b c d e f g", "x"), (5, "a b c d e f g", "x"), (3, "A b c d e f g", "y"), (None, "q r s t u v", "z"), (None, "q r s t u v", "z"), (8, None, "n"), (9, "", None), (10, "only one here", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    left = nd.drop_near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(3, "A b c d e f g"), (None, "q r s t u v"), (8, None), (9, ""), (10, "only one here")], key=str)
    assert nd.drop_near_duplicates(spark.createDataFrame([(4, "a b c", "k")] * 3, df.schema)).count() == 1
    assert nd.near_duplicates(df.limit(0)).count() == 0 and nd.drop_near_duplicates(df.limit(0)).count() == 0


def test_clusters_stay_whole_when_a_join_becomes_a_broadcast(spark):
    """Spark leaves out a repartition by the key of a join below it; turned into a broadcast while it runs, that join keeps no key together."""
    draw = random.Random(4)
    rows = []
    for g in range(60):
        base = [f"g{g}w{draw.randrange(10**9)}" for _ in range(200)]
        for n in range(5):
            copy = list(base)
            copy[20 * n + 7] = f"other{n}"
            rows.append((len(rows), " ".join(copy)))
    # Too large for a broadcast by the size of its files, small enough once it is counted.
    changed = {"spark.sql.autoBroadcastJoinThreshold": "16KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n, None) for n in changed}
    try:
        for n, v in changed.items():
            spark.conf.set(n, v)
        found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=3, percent=85).collect()
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 5 for i, _ in rows}
