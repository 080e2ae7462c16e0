"""Language identification: family first, then pairwise linear machines within it.

Texts become hashed counts of character 1- to 3-grams.  Languages whose mean
profiles are close form a family (average linkage, about the square root of
the number of languages families).  One linear support vector machine per
family picks the family; inside it one machine per pair of languages votes.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, by_slices

BITS = 10
SIZE = 1 << BITS
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def profile(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts of a whole text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = codes[:-1] * np.uint64(1_000_003) + codes[1:]
    three = two[:-1] * np.uint64(1_000_003) + codes[2:]
    counts = np.zeros(SIZE)
    for n, grams in enumerate((codes, two, three)):
        mixed = (grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Linear support vector machine (squared hinge, accelerated gradient); the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight, y = (weight / weight.sum()).astype(np.float32), y.astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (2 * float(weight @ np.einsum("ij,ij->i", x, x)) + penalty))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - rate * (np.float32(penalty) * ahead - 2 * (x.T @ (weight * y * slack)))
        ahead = after + np.float32(k / (k + 3)) * (after - w)
        w = after
    return w


def families_of(means: np.ndarray) -> list[list[int]]:
    groups = [[i] for i in range(len(means))]
    near = means @ means.T
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(itertools.combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = np.append(profile(text), np.float32(1))
        score, chosen = 1.0, 0
        if len(self.families) > 1:
            margins = self.family_weights @ x
            chosen = int(margins.argmax())
            score = float(1 / np.exp(2 * (margins - margins[chosen])).sum())
        members = self.families[chosen]
        votes = dict.fromkeys(members, 0.0)
        sure = {}
        for a, b in itertools.combinations(members, 2):
            p = float(1 / (1 + np.exp(-2 * (self.pairs[a, b] @ x))))
            sure[a, b], sure[b, a] = p, 1 - p
            votes[a] += (p >= 0.5) + p / len(members)
            votes[b] += (p < 0.5) + (1 - p) / len(members)
        best = max(members, key=lambda m: (votes[m], -m))
        others = [sure[best, m] for m in members if m != best]
        return self.languages[best], score * (min(others) if others else 1.0)


def fit(x: np.ndarray, lang: np.ndarray) -> Model:
    model = Model(sorted(set(lang.tolist())))
    if not model.languages:
        return model
    y = np.searchsorted(np.array(model.languages, object).astype(str), lang.astype(str))
    means = np.stack([x[y == i].mean(0) for i in range(len(model.languages))])
    # What all languages share says nothing about their distance.
    centred = means - means.mean(0)
    model.families = families_of(centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)) if len(means) > 1 else [[0]]
    family = np.empty(len(means), int)
    for f, members in enumerate(model.families):
        family[members] = f
    rows_of = np.bincount(y).astype(float)

    def trained(rows, positive):
        sign = np.where(positive, 1.0, -1.0)
        share = 1 / rows_of[y[rows]]
        share = np.where(positive, share / share[positive].sum(), share / share[~positive].sum())
        return machine(x[rows], sign, share)

    everyone = np.arange(len(y))
    if len(model.families) > 1:
        model.family_weights = np.stack([trained(everyone, family[y] == f) for f in range(len(model.families))])
    for members in model.families:
        for a, b in itertools.combinations(members, 2):
            rows = everyone[(y == a) | (y == b)]
            model.pairs[a, b] = trained(rows, y[rows] == a)
    return model


def identify(df: DataFrame, learn_from: Column | None = None, text: str = "text", lang: str = "lang", sample_rows: int = 3000, name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the predicted language of every whole text and a score from 0 to 1.

    The model learns from rows with a non-null language, some letter and
    ``learn_from`` true: about ``sample_rows`` in all, an equal share per
    language (at least 20), chosen by a hash of the text, so that a sample of
    repeated rows takes all or none of them (at most three times the share).
    Texts that are null or have no letter, and all texts when nothing could be
    learned, are ``und`` with score 0.  Input columns named like the results
    give way.
    """
    rows = df.select(F.col(text).cast("string").alias("_t"), F.col(lang).cast("string").alias("_l"), (F.lit(True) if learn_from is None else learn_from).alias("_u")).where("_u and _l is not null and _t is not null")
    sizes = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(20, sample_rows // max(1, len(sizes)))
    model = Model()
    if sizes:
        share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, each / n))])
        drawn = rows.where(F.pmod(F.xxhash64("_t"), F.lit(1 << 20)) < share[F.col("_l")] * (1 << 20))

        @F.arrow_udf("array<float>")
        def profiles(texts: pa.Array) -> pa.Array:
            return by_slices(lambda part: pa.array([profile(t) if _LETTER.search(t) else None for t in part], pa.list_(pa.float32())))(texts)

        # Copies share a hash: one row per text keeps a drawn group of copies from filling the sample.
        once = drawn.groupBy(F.xxhash64("_t").alias("_h"), "_l").agg(F.any_value("_t").alias("_t"))
        taught = once.select("_l", "_h", profiles("_t").alias("x")).where("x is not null").limit(3 * each * len(sizes)).toPandas().sort_values(["_l", "_h"])
        if len(taught):
            model = fit(np.stack(taught.x.to_list()), taught["_l"].to_numpy(object))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<l:string,s:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        def some(part: list) -> pa.Array:
            found = [shared.value.predict(t) for t in part]
            return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["l", "s"])

        return by_slices(some)(texts)

    both = append(df, _lang=predicted(F.col(text).cast("string")))
    return append(both, **{name: F.col("_lang.l"), score: F.col("_lang.s")}).drop("_lang")
