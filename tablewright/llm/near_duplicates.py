"""Near-duplicate detection by a chosen-path set similarity join.

Documents with one set of word shingles form a class.  Every class has minwise
values under many hash functions.  A tree branches all classes by the value of
a chosen function, and now and then of a second one, so that on average one
branch keeps each similar pair together; nodes that are still large branch
again, by functions chosen from the node's own hash.  Small nodes compare all
their classes by their minwise values, and independent trees repeat this until
the chance to miss a pair at the threshold is negligible.

What the trees find are clusters of classes that may be linked, a superset of
the answer.  Inside them links are confirmed on the full shingle sets; a pair
already in one component need not be compared.  A cluster too large for one
task is compared block by block: first inside blocks, then between
representatives, and, only if it is not yet one component, between all pairs
of blocks that hold different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import ascii_lower, in_pieces, packed, unpacked, words_of
from tablewright.llm.components import connected_components
from tablewright.llm.suffixes import text_key
from tablewright.session import written_once

FUNCTIONS = 64
TREES = 12
LEAF = 2048
DEPTH = 8
BLOCK = 3000
ALIKE = 58
BLOCK_SHINGLES = 1_500_000
MANY = 256
_rng = np.random.Generator(np.random.PCG64(20))
_A = _rng.integers(0, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, FUNCTIONS, np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_known: dict[str, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of the whole sequence if it is shorter."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(_known) > 150_000:
        _known.clear()
    codes = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh64_intdigest(ascii_lower(w))
        codes[i] = h
    span = min(words, len(found))
    n = len(found) - span + 1
    out = np.full(n, span, np.uint64)
    for j in range(span):
        out = _mixed(out) * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return np.unique(_mixed(out))


def minwise(shingles: np.ndarray) -> np.ndarray:
    out = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048, None] * _A + _B
        out = np.minimum(out, (x ^ (x >> np.uint64(31))).min(0))
    return out


class SharedCounts:
    """How many shingles one set of a group shares with others of it, counted for many at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))[:-1]
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.marked = np.zeros(len(known), bool)

    def _of(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i] + self.sizes[i]]

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` have 100 * intersection >= percent * union with set ``i``."""
        own, sizes = self._of(i), self.sizes[others]
        self.marked[own] = True
        hits = self.marked[np.concatenate([self._of(j) for j in others])]
        self.marked[own] = False
        both = np.add.reduceat(hits, np.append(0, np.cumsum(sizes))[:-1], dtype=np.int64)
        return 100 * both >= percent * (sizes + self.sizes[i] - both)


def least_agreement(percent: int) -> int:
    """Agreeing functions below which a pair at the threshold falls with a chance of about 1e-6."""
    p = percent / 100
    return max(1, int(FUNCTIONS * p - 5 * (FUNCTIONS * p * (1 - p)) ** 0.5))


def _gathered(df: DataFrame, key: str) -> DataFrame:
    """Rows with equal keys in one partition, one after the other.

    They are dealt by a hash of the key of their own: a repartition by the very
    columns that a join below deals its rows by is left out as needless, and
    adaptive execution may then make a broadcast of that join, after which its
    rows lie as their map tasks wrote them.
    """
    return df.repartition(F.xxhash64(F.lit("gathered"), key)).sortWithinPartitions(key)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Consecutive rows with equal keys, from batches sorted by them."""
    key, held = None, {}
    for batch in batches:
        columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}
        for i in range(batch.num_rows):
            now = tuple(columns[n][i] for n in keys)
            if now != key:
                if key is not None:
                    yield key, held
                key, held = now, {n: [] for n in columns}
            for n, c in columns.items():
                held[n].append(c[i])
    if key is not None:
        yield key, held


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def _compare_nodes(least: int) -> Callable:
    """Clusters inside each small node: links between classes whose minwise values agree often enough."""

    def run(batches):
        out = []
        for _, rows in _groups(batches, ["node"]):
            order = np.argsort(rows["k"], kind="stable")
            ks = [rows["k"][i] for i in order]
            sketches = np.stack([np.frombuffer(rows["sketch"][i], np.uint32) for i in order])
            label = np.arange(len(ks))
            for i in range(1, len(ks)):
                near = label[:i][(sketches[:i] == sketches[i]).sum(1) >= least]
                if len(near):
                    # One edge to each component that i touches; they become one.
                    met = np.unique(near)
                    out.extend((ks[i], ks[j]) for j in met.tolist())
                    label[: i + 1][np.isin(label[: i + 1], met)] = met[0]
                    label[i] = met[0]
            if len(out) > 5000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def _branch(level: int, percent: int) -> Callable:
    """Children of large nodes: one function chosen by the node, and with the rest of 1/threshold a second."""
    second = int((100 / percent - 1) * (1 << 20))

    def run(batches):
        for batch in batches:
            node, k = (batch.column(c).to_numpy().view(np.uint64) for c in ("node", "k"))
            sketch = np.stack([np.frombuffer(s, np.uint32) for s in batch.column("sketch").to_pylist()])
            seed = _mixed(node + np.uint64(level))
            j = (seed % np.uint64(FUNCTIONS)).astype(int)
            more = (seed >> np.uint64(40)) % np.uint64(1 << 20) < second
            other = (j + 1 + ((seed >> np.uint64(8)) % np.uint64(FUNCTIONS - 1)).astype(int)) % FUNCTIONS
            at = np.append(np.arange(len(k)), np.flatnonzero(more))
            which = np.append(j, other[more])
            child = _mixed(_mixed(node[at] + which.astype(np.uint64) + np.uint64(1)) + sketch[at, which])
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(k[at].view(np.int64))], names=["node", "k"])

    return run


def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of functions whose minwise values agree."""
    left = np.frombuffer(b"".join(a.to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
    right = np.frombuffer(b"".join(b.to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
    return pa.array((left == right).sum(1).astype(np.int32))


def _around_pivots(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """The classes of large nodes with the pivot of their node and their agreement with it."""
    chosen = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "k"), F.col("k").alias("k"))).getField("k").alias("pivot"))
    pivots = chosen.join(sketches.withColumnsRenamed({"k": "pivot", "sketch": "other"}), "pivot")
    both = large.select("node", "k").join(sketches, "k").join(pivots, "node")
    return written_once(both.select("node", "k", "pivot", F.arrow_udf(_agreement, "int")("sketch", "other").alias("agree")))


def candidate_links(classes: DataFrame, percent: int) -> DataFrame:
    """Edges whose components hold every pair of classes that the trees keep together.

    A large node is first compared with one of its classes, its pivot.  If all
    its classes are near the pivot, they are one cluster and the node is
    finished; so a group of thousands of copies does not branch to the end.
    Otherwise its classes branch again, but for those that all but equal the
    pivot: what is near them is near the pivot, or meets them in other trees.
    """
    least = least_agreement(percent)
    sketches = classes.select("k", "sketch")
    rows = classes.select(F.explode("roots").alias("node"), "k")
    found = None
    for level in range(DEPTH):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        placed = written_once(rows.join(sizes, "node"))
        small = placed.where(F.col("size") <= LEAF).join(sketches, "k").select("node", "k", "sketch")
        links = _gathered(small, "node").mapInArrow(_compare_nodes(least), "a long, b long")
        found = links if found is None else found.unionByName(links)
        large = placed.where(F.col("size") > LEAF)
        if large.isEmpty():
            return found
        judged = _around_pivots(large, sketches)
        found = found.unionByName(judged.where(F.col("agree") >= least).select(F.col("k").alias("a"), F.col("pivot").alias("b")))
        left = judged.groupBy("node").agg(F.count_if(F.col("agree") < least).alias("far")).where("far > 0")
        going = judged.where(F.col("agree") < ALIKE).join(left, "node").select("node", "k")
        if level < DEPTH - 1:
            rows = going.join(sketches, "k").mapInArrow(_branch(level, percent), "node long, k long")
    # Classes that stay together all the way down are much alike: one cluster, compared in blocks later.
    first = going.groupBy("node").agg(F.min("k").alias("b"))
    return found.unionByName(going.join(first, "node").select(F.col("k").alias("a"), "b"))


def _confirm(words: int, percent: int, whole: bool) -> Callable:
    """Links in each group of classes that join different components, on full sets; ``side`` 0 and 1 are only compared with each other.

    A group that is a ``whole`` cluster gives every class with the first of its component.
    """
    least = least_agreement(percent)

    def run(batches):
        for _, rows in _groups(batches, ["task"]):
            order = sorted(range(len(rows["k"])), key=lambda i: (rows["n"][i], rows["k"][i]))
            ks, sides, sizes = [rows["k"][i] for i in order], np.array([rows["side"][i] for i in order]), np.array([rows["n"][i] for i in order])
            shared = SharedCounts([shingles_of(rows["t"][i], words) for i in order])
            sketches = np.stack([np.frombuffer(rows["sketch"][i], np.uint32) for i in order])
            first: dict[int, int] = {}
            label = np.array([first.setdefault(rows["label"][i], n) for n, i in enumerate(order)])
            out = []
            for i in range(1, len(ks)):
                near = (sketches[:i] == sketches[i]).sum(1) >= least
                near &= (100 * sizes[:i] >= percent * sizes[i]) & ((sides[:i] != sides[i]) | (sides[i] < 0))
                open_ = np.flatnonzero(near)
                # One at first, as its component needs no other; more and more where they do not link.
                many = 1
                while len(open_ := open_[label[open_] != label[i]]):
                    now, open_ = open_[-many:], open_[:-many]
                    many = min(2 * many, MANY)
                    for j in now[shared.linked(i, now, percent)].tolist():
                        if label[i] != label[j]:
                            out.append((ks[i], ks[j]))
                            label[label == max(label[i], label[j])] = min(label[i], label[j])
            if whole:
                out = [(k, ks[label[i]]) for i, k in enumerate(ks)]
            if out:
                yield _edges(out)

    return run


def _confirmed(tasks: DataFrame, words: int, percent: int, whole: bool = False) -> DataFrame:
    dealt = _gathered(tasks.select("task", "side", "k", "n", "label", "sketch", "t"), "task")
    return dealt.mapInArrow(in_pieces(_confirm(words, percent, whole), 1000), "a long, b long")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the labels that ``links`` between labels' members add up to."""
    of = members.select("k", "label")
    ends = links.join(of.withColumnRenamed("k", "a").withColumnRenamed("label", "x"), "a").join(of.withColumnRenamed("k", "b").withColumnRenamed("label", "y"), "b")
    parts = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("k").alias("label"), F.col("label").alias("_to"))
    return members.join(parts, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to")


def _in_blocks(df: DataFrame, *order: Column | str) -> DataFrame:
    """Number blocks of bounded size inside each cluster, without gathering a cluster in one task."""
    # The hash deals a cluster's members over enough blocks for their number and their shingles.
    return df.withColumn("block", F.pmod(F.xxhash64(*order), F.col("blocks")).cast("int"))


def _large_clusters(members: DataFrame, words: int, percent: int) -> DataFrame:
    """k, label for the members of clusters that exceed one task."""
    of = F.greatest(F.ceil(2 * F.count(F.lit(1)) / BLOCK), F.ceil(2 * F.sum("n") / BLOCK_SHINGLES))
    texts = members.select("cluster", "k", "n", "sketch", "t")
    state = written_once(members.select("cluster", "k", "n", F.col("k").alias("label")))
    representatives, before = state, None
    while True:
        # Inside blocks of what is left; at first all members, then one per component.
        blocks = representatives.groupBy("cluster").agg(of.alias("blocks"))
        dealt = _in_blocks(representatives.join(blocks, "cluster"), "k").join(texts.select("k", "sketch", "t"), "k")
        tasks = dealt.select(F.xxhash64("cluster", "block").alias("task"), F.lit(-1).alias("side"), "k", "n", "label", "sketch", "t")
        state = written_once(_relabelled(state, written_once(_confirmed(tasks, words, percent))))
        representatives = state.where("k = label")
        left = representatives.count()
        if before is not None and left > 0.9 * before:
            break
        before = left
    # Clusters of several components: blocks of one component each where possible, and every pair of
    # blocks that holds more than one component.
    several = state.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cluster")
    open_ = state.join(several, "cluster")
    sizes = open_.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    big = sizes.where((F.col("c") > BLOCK // 2) | (F.col("s") > BLOCK_SHINGLES // 2)).select("label", F.greatest(F.ceil(2 * F.col("c") / BLOCK), F.ceil(2 * F.col("s") / BLOCK_SHINGLES)).alias("own"))
    rest = sizes.join(big, "label", "left_anti").groupBy("cluster").agg(F.greatest(F.ceil(2 * F.sum("c") / BLOCK), F.ceil(2 * F.sum("s") / BLOCK_SHINGLES)).alias("mixed"))
    placed = open_.join(big, "label", "left").join(rest, "cluster", "left")
    pure = F.col("own").isNotNull()
    block = F.when(pure, F.xxhash64("label", F.pmod(F.xxhash64("k"), F.coalesce("own", F.lit(1))))).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("k"), F.coalesce("mixed", F.lit(1)))))
    placed = written_once(placed.select("cluster", "k", "n", "label", block.alias("block"), F.when(pure, F.col("label")).alias("only")))
    one = placed.select("cluster", "block", "only").distinct()
    other = one.select("cluster", F.col("block").alias("block2"), F.col("only").alias("only2"))
    # Pairs of blocks, not of documents; blocks of one and the same component are left out.
    pairs = one.join(other, "cluster").where("block <= block2 and (only is null or only2 is null or only <> only2)")
    pairs = pairs.select(F.xxhash64("block", "block2").alias("task"), "block", "block2")
    sides = pairs.select("task", "block", F.when(F.col("block") == F.col("block2"), -1).otherwise(0).alias("side")).unionByName(
        pairs.where("block <> block2").select("task", F.col("block2").alias("block"), F.lit(1).alias("side"))
    )
    tasks = sides.join(placed, "block").join(texts.select("k", "sketch", "t"), "k")
    return _relabelled(state, written_once(_confirmed(tasks, words, percent))).select("k", "label")


def component_labels(df: DataFrame, classes: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """k, label for every class that is linked to another."""
    clusters = written_once(connected_components(candidate_links(classes, percent)).withColumnRenamed("label", "cluster"))
    members = clusters.join(classes.select("k", "n", "sketch", "rep"), "k")
    # A single pair of very long documents fits as well: a document is never split.
    count, total = F.count(F.lit(1)), F.sum("n")
    sizes = members.groupBy("cluster").agg((((count <= BLOCK) & (total <= BLOCK_SHINGLES)) | (count == 2)).alias("fits"))
    wanted = members.join(sizes, "cluster").select("cluster", "fits", "k", "n", "sketch", F.col("rep.h").alias("h"), F.col("rep.nb").alias("nb"))
    keys = text_key(F.col(text))
    texts = df.select(keys[0], keys[1].alias("nb"), F.col(text).cast("string").alias("t"))
    # Copies of a text are many, its class is one: reduce before the texts travel on.
    held = written_once(texts.join(wanted, ["h", "nb"]).groupBy("k").agg(*[F.first(c).alias(c) for c in ("cluster", "fits", "n", "sketch", "t")]))
    few = held.where("fits")
    small = _confirmed(few.select(F.col("cluster").alias("task"), F.lit(-1).alias("side"), "k", "n", F.col("k").alias("label"), "sketch", "t"), words, percent, whole=True)
    labels = small.select(F.col("a").alias("k"), F.col("b").alias("label"))
    many = held.where("not fits")
    if not many.isEmpty():
        labels = labels.unionByName(_large_clusters(written_once(many.drop("fits")), words, percent))
    return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, h, nb (key of the text), n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of
    their distinct lower-case word shingles; ``component_id`` is the smallest
    key reachable and ``kept`` marks the documents that carry it.  Null or
    empty texts and texts without words have no shingles and stand alone.  A
    null key never names a component; a component of null keys only has a null
    id, and its documents are kept, as are null keys that stand alone.
    Repeated rows repeat their result.  Sets are compared by 64-bit hashes of
    their shingles.  A pair exactly at the threshold is missed with a chance
    of about 1e-6.
    """
    kind = df.schema[key].dataType.simpleString()
    keys = text_key(F.col(text))
    source = df.select(F.col(key).alias("doc_id"), keys[0], keys[1].alias("nb"), F.col(text).cast("string").alias("t"))

    def features(batches):
        for batch in batches:
            out = []
            for t in batch.column("t").to_pylist():
                s = shingles_of(t, words)
                if not len(s):
                    out.append((None, 0, None, None))
                    continue
                low = minwise(s)
                roots = _mixed(low[:TREES] + np.arange(1, TREES + 1, dtype=np.uint64))
                out.append((xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s), (low >> np.uint64(32)).astype(np.uint32).tobytes(), roots.view(np.int64)))
            k, n, sketch, roots = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), batch.column("nb"), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(roots, pa.list_(pa.int64()))],
                names=["doc_id", "h", "nb", "k", "n", "sketch", "roots"],
            )
        _known.clear()

    rows = written_once(source.mapInArrow(in_pieces(features, 1000), f"doc_id {kind}, h long, nb int, k long, n long, sketch binary, roots array<long>"))
    classes = written_once(
        rows.where("k is not null").groupBy("k").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"), F.min(F.struct("h", "nb")).alias("rep"), F.min("doc_id").alias("least")
        )
    )
    labels = component_labels(df, classes, text, words, percent)
    owned = classes.select("k", "least").join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    lowest = owned.groupBy("label").agg(F.min("least").alias("component_id"))
    of = owned.join(lowest, "label").select("k", "component_id")
    named = rows.select("doc_id", "h", "nb", "k", F.col("n").alias("n_shingles")).join(of, "k", "left")
    named = named.withColumn("component_id", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("k")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without all but one document of each component; texts without words all stay."""
    found = near_duplicates(df, key, text, words, percent)
    # A text has one component: what is kept follows from the text and the key.
    names = written_once(found.where("n_shingles > 0").groupBy("h", "nb").agg(F.min("component_id").alias("component")))
    h, nb = text_key(F.col(text))
    joined = packed(df, h=h, nb=nb, k=F.col(key)).join(names.withColumn("named", F.lit(True)), ["h", "nb"], "left")
    stays = joined.where(F.col("named").isNull() | F.col("k").eqNullSafe(F.col("component")))
    twice = found.where("n_shingles > 0 and kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("twice"))
    if twice.isEmpty():
        return stays.select(*unpacked(stays, df.columns))
    # A key that several kept rows share: one of them stays, the least by its text key.
    marked = stays.join(written_once(twice), F.col("k").eqNullSafe(F.col("twice")), "left").withColumn("again", F.col("twice").isNotNull() | (F.col("k").isNull() & F.col("named").isNotNull()))
    single = marked.where("not again or named is null")
    one = marked.where("again and named is not null").dropDuplicates(["component"])
    return single.select(*unpacked(single, df.columns)).unionByName(one.select(*unpacked(one, df.columns)))
