import math

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm.mixing import mix
from tablewright.llm.topk import top_k


def best(rows, k, modulus):
    ints = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = set()
    for q in (i for i in ints if i % modulus == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)
        out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])}
    return out


def test_top_k_against_all_pairs(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 8).round(1)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(120)]  # many equal vectors
    rows += [(5000, None), (5010, [None] * 8), (5020, [math.nan] + [0.1] * 7), (5030, [math.inf] * 8), (None, [1.0] * 8), rows[0], rows[1]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == best(rows, 5, 10)
    few = df.where("vec_id < 3").withColumn("score", F.lit(1))
    assert {tuple(r) for r in top_k(few, F.col("vec_id") == 0).collect()} == {t for t in best(rows[:3], 5, 1) if t[0] == 0}
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        found = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and found[s] > 3 * sizes[s]}
        if not over:
            return found
        capped |= over


def test_mix_meets_targets(spark):
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(draw.integers(1, 300))), ["a", "b", "B", None, "é", "a", "a"][i % 7], 1) for i in range(6000)]
    rows += [(9000, None, "a", 1), (9001, "", "b", 1), (None, "one two", "c", 1), (9002, "w " * 20000, "é", 1)] + [(9003, "x y z", "a", 1)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mix(df).collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    expected = targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * (1 + r.target)
    assert all(abs(taken[s] - expected[s]) <= 0.01 * expected[s] + 2 for s in sizes)
    again = mix(df.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in out)
    assert mix(df.limit(0)).count() == 0
    assert {r.taken for r in mix(df.where("text = ''")).collect()} == {0}
