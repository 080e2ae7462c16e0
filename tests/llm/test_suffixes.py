import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tablewright.llm.suffixes as suffixes
from tablewright.llm.suffixes import Queue, narrower, remove_repeats, repeated_spans, repeats_in, runs_of, sorted_suffixes, text_key

SIZE = 200


def brute(texts, size=SIZE):
    """(removed, spans, kept) per text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        out.append((int(gone.sum()), len(edges) // 2, bytes(b for b, g in zip(r, gone) if not g)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_sorted_suffixes(limit):
    draw = random.Random(1)
    for trial in range(60):
        size = draw.choice([4, 8, 12])
        cuts = [bytes(draw.choice(b"ab\x00") for _ in range(draw.randint(1, 60))) for _ in range(draw.randint(1, 6))]
        symbols = np.array([x for c in cuts for x in [*(b + 1 for b in c), 0]], np.uint16)
        order, common = sorted_suffixes(symbols, size, limit)
        texts = [tuple(symbols[i : i + size].tolist() + [0] * size)[:size] for i in order]
        assert sorted(order.tolist()) == list(range(len(symbols))) and texts == sorted(texts)
        assert common[1:].tolist() == [next((k for k in range(size) if a[k] != b[k]), size) for a, b in zip(texts, texts[1:])]
        seen = Counter(c[i : i + size] for c in cuts for i in range(len(c) - size + 1))
        assert [r.tolist() for r in repeats_in(cuts, size)] == [[i for i in range(len(c) - size + 1) if seen[c[i : i + size]] > 1] for c in cuts]


def test_queue_spills():
    queue = Queue(100)
    for i in range(50):
        queue.push(np.array([[i, -i]]))
    assert queue.on_disk and queue.pull().tolist() == [[i, -i] for i in range(50)] and queue.pull() is None


def corpus():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefé") for _ in range(draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, edge = prose(60), prose(80).encode()[:SIZE].decode("utf-8", "ignore")
    texts = [prose(draw.randint(1, 120)) for _ in range(30)]
    texts += [f"{prose(20)} {shared} {prose(20)}" for _ in range(25)]
    texts += [prose(10) + edge + prose(5), edge + prose(5), edge[:-1] + prose(9)]
    texts += ["ab " * 300, "x" * 1000, "y" * SIZE, "y" * (SIZE + 1), "abc\x00" * 49, "\x00" * 500]
    whole = prose(90)
    texts += [whole, whole, whole, whole[3:], whole[:150] + "!" + whole[150:], "short", "short", None, "", None]
    part = prose(50)
    texts += [f"{part} {prose(3)} {part}", "🎉é" * 200]
    return texts


def test_runs_and_narrower_keys(monkeypatch):
    """Every window lies in one run and in one piece of it, and equal windows have equal keys at every level."""
    monkeypatch.setattr(suffixes, "SLICE", 700)
    monkeypatch.setattr(suffixes, "RUN", 50)
    draw = random.Random(3)
    part = bytes(draw.choice(b"abc") for _ in range(500))
    key_of, seen = [{} for _ in range(7)], 0
    for raw in [part, b"x" + part[100:] + b"yz", b"ab" * 400, b"q" * 1500, part[:199], b"", bytes(draw.choice(b"ab") for _ in range(900))]:
        values, first, last, twice = runs_of(raw, SIZE)
        assert [i for a, b in zip(first, last) for i in range(a, b + 1)] == list(range(len(raw) - SIZE + 1))
        for m, start, end in zip(values.tolist(), first.tolist(), last.tolist()):
            assert end - start < 50
            pieces = [(m, raw[start : end + SIZE], 0, 0)]
            for level in range(7):
                pieces, had = [], pieces
                for key, cut, a, b in had:
                    found = narrower(cut, key, a, b, SIZE)
                    assert sorted(i for _, p, q, _, _ in found for i in range(p, q + 1)) == list(range(len(cut) - SIZE + 1))
                    for k, p, q, x, y in found:
                        pieces.append((k, cut[p : q + SIZE], x - p, y - p))
                        assert x <= p + SIZE - 1 and q <= x and y <= p + SIZE
                        for i in range(p, q + 1):
                            assert key_of[level].setdefault(cut[i : i + SIZE], k) == k
            assert all(len(cut) == SIZE and (a, b) == (0, SIZE) for _, cut, a, b in pieces)
            seen += len(pieces)
    assert seen > 2000


def test_long_repetitive_texts(spark):
    """Megabytes of one letter, of a short period and of both: nothing but bounded runs, all of it repeated."""
    texts = ["e" * 6_000_000, "abcdefg" * 400_000 + "!", "e" * 300_000 + "abcdefg" * 50_000, "e" * 199]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert out[0].text == "" and out[1].text == "!" and out[3].text == texts[3]
    # The windows over the seam of the third text occur once, but others cover all of it.
    assert out[2].text == "" and [(s["from"], s["to"]) for s in out[2].spans] == [(0, len(texts[2]))]


def test_many_surroundings_of_one_passage(spark, monkeypatch):
    """A passage in hundreds of texts makes keys beyond a share: they are dealt further, with the same result."""
    monkeypatch.setattr(suffixes, "HEAVY_BYTES", 4000)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 20_000)
    draw = random.Random(11)
    prose = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = prose(450)
    texts = [prose(draw.randint(0, 300)) + passage + prose(draw.randint(0, 300)) for _ in range(300)] + [passage[:250] + prose(300) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    for i, (removed, spans, kept) in enumerate(brute(texts)):
        assert (got[i].text, len(got[i].spans)) == (kept.decode(), spans), i


def test_cuts_stay_where_they_are_when_heavy_keys_are_told_apart(spark, monkeypatch):
    """the cuts of a level meet the heavy keys without a shuffle, be the input large or small."""
    plans, keep = [], suffixes.written_once

    def written_once(df, *codec):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, *codec)

    monkeypatch.setattr(suffixes, "written_once", written_once)
    monkeypatch.setattr(suffixes, "HEAVY_BYTES", 4000)
    draw = random.Random(12)
    prose = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = prose(300)
    texts = [prose(200) + passage + prose(200) for _ in range(60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
        assert found.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [plan for columns, plan in plans if columns == ["parent", "at", "s"]]
    assert dealt and not any("hashpartitioning" in plan for plan in dealt)
    # One shuffle for the pieces of a level, by key and piece.
    levels = [plan for columns, plan in plans if columns == ["m", "s", "cut", "a", "b", "k"]]
    assert len(levels) > 1
    assert all(plan.count("hashpartitioning") == 1 for plan in levels[1:])


def test_tables_that_hold_bytes_are_packed_tightly(spark, monkeypatch):
    """texts and cuts are the largest tables on disk."""
    made, keep = [], suffixes.written_once
    monkeypatch.setattr(suffixes, "written_once", lambda *given: made.append(keep(*given)) or made[-1])
    passage = "".join(random.Random(13).choice("abcdefgh ") for _ in range(400))
    repeated_spans(spark.createDataFrame([(1, passage + "x"), (2, passage + "y")], "doc_id int, text string"))
    with_bytes = [t for t in made if {"t", "cut"} & set(t.columns)]
    files = [f for t in with_bytes for f in t.inputFiles()]
    assert len(with_bytes) == 2 and files and all(f.endswith(".zstd.parquet") for f in files)


@pytest.mark.parametrize("shard", [2 << 20, 3000])
def test_against_all_windows(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffixes, "HEAVY_BYTES", shard // 4)
    texts = corpus()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, H long").repartition(5)
    found = {(r.h, r.n): r for r in repeated_spans(df).collect()}
    keys = {r.doc_id: (r.h, r.n) for r in df.select("doc_id", *text_key(F.col("text"))).collect()}
    for i, (removed, spans, kept) in enumerate(brute(texts)):
        r = found.get(keys[i])
        got = (sum(s["to"] - s["from"] for s in r.spans), len(r.spans), bytes(r.kept)) if r else (0, 0, (texts[i] or "").encode())
        assert got == (removed, spans, kept), (i, (texts[i] or "")[:50])


def test_rows_and_edges(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "a", None) for i, t in enumerate(texts)], "doc_id long, text string, SPANS string, kept string")
    out = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert len(out) == len(texts)
    for i, (removed, spans, kept) in enumerate(brute(texts)):
        assert out[i].text == (kept.decode("utf-8", "ignore") if removed else texts[i]) and len(out[i].spans) == spans
    assert repeated_spans(df.limit(0)).count() == 0 and remove_repeats(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_a_shard_is_sorted_in_few_bytes_of_memory_per_byte():
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 300_000).astype(np.uint8).tobytes()
    cuts = [text[i : i + 400 + i % 700] for i in range(0, 299_000, 500)]
    tracemalloc.start()
    try:
        suffixes.repeats_in(cuts, 200)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 85 * sum(map(len, cuts))
