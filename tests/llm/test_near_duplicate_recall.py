"""Recall at the threshold inside large groups, against the links known from how the texts are made.

RECALL_PAIRS sets the pairs of texts in each group.
"""

import os
import random

from tablewright.llm.near_duplicates import near_duplicates, shingles_of

WORDS, FURTHER = 300, 8
PAIRS = int(os.environ.get("RECALL_PAIRS", "150"))


def edited(text, places, mark):
    out = list(text)
    for p in places:
        out[p] = f"{mark}x{p}"
    return out


def apart(rng, n, taken=()):
    """``n`` places no two of which share a shingle, with each other or with those taken."""
    places, near = [], set(taken)
    while len(places) < n:
        p = rng.randrange(2, WORDS - 2)
        if not any(abs(p - q) < 3 for q in near):
            places.append(p)
            near.add(p)
    return places


def test_links_at_85_percent_inside_large_groups(spark):
    """Each text has one partner at 85.1 % and lies in a group that is less alike, or nearly the same."""
    rng = random.Random(7)
    rows, partners = [], []
    for own_places, group in ((8, "a"), (2, "b")):
        base = [f"{group}{i}" for i in range(WORDS)]
        for n in range(PAIRS):
            own = apart(rng, own_places)
            first = edited(base, own, f"{group}{n}")
            second = edited(first, apart(rng, FURTHER, own), f"{group}{n}y")
            partners.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(first)), (len(rows) + 1, " ".join(second))]
    a, b = (set(shingles_of(rows[i][1], 3).tolist()) for i in partners[0])
    assert 0.85 <= len(a & b) / len(a | b) < 0.852
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=85)
    component = {r["doc_id"]: r["component_id"] for r in found.collect()}
    linked = [component[x] == component[y] for x, y in partners]
    recall = {"less alike": sum(linked[:PAIRS]) / PAIRS, "nearly the same": sum(linked[PAIRS:]) / PAIRS}
    print(recall)
    assert min(recall.values()) >= 0.99
    # Pairs of the first group are no more than pairs; those of the second meet through texts that are nearly the same.
    assert len({component[x] for x, _ in partners[:PAIRS]}) == PAIRS
    assert len({component[x] for x, _ in partners[PAIRS:]}) == 1
