import hashlib

import numpy as np

from tablewright.llm.fingerprints import K, S, _mixed, _windows, add_fingerprint, anchors, compare_with_edit, fingerprint_of, likeness_of


def test_anchors_are_closed_syncmers():
    text = "some words, and straße 🎉 with more words than before, and once more: words"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    inner = _mixed(_windows(codes, S)).tolist()
    chosen = []
    for i in range(len(text) - K + 1):
        own = inner[i : i + K - S + 1]
        if min(own) in (own[0], own[-1]):
            chosen.append(i)
    assert anchors(text)[0].tolist() == chosen
    # Context-free: the same passage has the same anchors elsewhere.
    moved = anchors("before it " + text)
    assert {h for h in anchors(text)[1].tolist()} <= set(moved[1].tolist())
    assert len({int(h) for h in _windows(codes, 7)}) == len({text[i : i + 7] for i in range(len(text) - 6)})


def test_edited_texts(spark):
    draw = np.random.default_rng(6)
    texts = [" ".join("".join(map(chr, draw.integers(97, 123, 6))) for _ in range(draw.integers(5, 200))) for _ in range(60)]
    rows = [(3 * i, t, "x") for i, t in enumerate(texts)] + [(500, None, "x"), (501, "", "x"), (502, "ab", "x"), (-1, "é" * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, FINGERPRINT string").repartition(6)
    out = {r.doc_id: r for r in compare_with_edit(df).collect()}
    ordered = sorted((i, t or "") for i, t, _ in rows)
    assert len(out) == len(rows)
    for n, (i, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint_of(t), fingerprint_of(edited))
        assert r.near_edited == likeness_of(r.fingerprint, r.edited_fingerprint) and r.near_next == likeness_of(r.fingerprint, fingerprint_of(following))
    long = [r for r in out.values() if r.n_chars > 400 and r.doc_id >= 0]
    assert min(r.near_edited for r in long) > 0.3 and max(r.near_next for r in long) < 0.1
    assert compare_with_edit(df.limit(0)).count() == 0
    same = compare_with_edit(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")).collect()
    assert len(same) == 3 and {r.near_next for r in same} == {1.0}
    assert add_fingerprint(df).columns == ["doc_id", "text", "fingerprint"]
