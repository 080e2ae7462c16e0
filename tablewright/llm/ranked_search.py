"""Ranked search over a document FP-tree with branch-and-bound.

A document is reduced to those of its terms that items ask for, ordered by
document frequency (frequent ones first), so that documents share paths of a
prefix tree.  Every node knows the largest term frequency of each term and the
smallest length factor ``m`` among the documents below it.  A score grows with
term frequencies and falls with ``m``, hence both bound the scores of the whole
subtree.  The tree is walked depth first with the set of items that can still
gain from a subtree; an item leaves it where its bound is below its k-th score
so far, and a subtree that no item needs is not entered.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.llm.common import ascii_lower, in_pieces, release_memory
from tablewright.session import discard, written_once

# Fixed value: a term is a run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes of item terms that are searched for in one pass, documents and postings of one tree, and partitions merged at once.
BLOCK_BYTES = 1 << 20
TREE_DOCS = 16_384
TREE_POSTINGS = 1 << 20
MERGED_PARTITIONS = 256
NO_ID = (1 << 63) - 1


def gain(tf, m):
    """What a term adds for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Items:
    """Items as columns of a term-item matrix in compressed rows, terms by falling document frequency."""

    def __init__(self, terms: list[list[str]], df: dict[str, int], n_docs: int):
        found = sorted({t for own in terms for t in own if df.get(t)}, key=lambda t: (-df[t], t))
        self.rank = {t: n for n, t in enumerate(found)}
        self.n_items = len(terms)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in found], np.int64)
        pairs = sorted({(self.rank[t], i) for i, own in enumerate(terms) for t in own if t in self.rank})
        self.items = np.array([i for _, i in pairs], np.int64)
        self.at = np.searchsorted(np.array([r for r, _ in pairs], np.int64), np.arange(len(found) + 1))

    def scores(self, ranks: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        """Score of every item; sums stay far below 2**53, where doubles are exact."""
        first, n = self.at[ranks], self.at[ranks + 1] - self.at[ranks]
        ends = np.cumsum(n)
        entries = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)
        return np.bincount(self.items[entries], np.repeat(self.weight[ranks] * gain(tf, m), n), self.n_items)


class Node:
    """Documents that share their first ``depth`` terms: maxima of tf, minimum of m, children."""

    __slots__ = ("depth", "ranks", "tf", "m", "children", "ids")

    def __init__(self, depth: int, ranks=None, tf=None, m: int = 0, ids=()):
        self.depth, self.ranks, self.tf, self.m, self.ids, self.children = depth, ranks, tf, m, ids, []

    def close(self) -> None:
        ranks = np.concatenate([c.ranks for c in self.children])
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        new = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else order
        tf = np.concatenate([c.tf for c in self.children])[order]
        self.ranks, self.tf = ranks[new], np.maximum.reduceat(tf, new) if len(new) else tf
        self.m = min(c.m for c in self.children)


def shared_start(a: bytes, b: bytes) -> int:
    """Number of leading terms (four bytes each) that two vectors share."""
    size = min(len(a), len(b)) // 4
    if a[: 4 * size] == b[: 4 * size]:
        return size
    x, y = np.frombuffer(a, ">u4", size), np.frombuffer(b, ">u4", size)
    return int((x != y).argmax())


def document_tree(vectors: list[tuple[bytes, bytes, int, int]], k: int) -> Node:
    """Tree of (term ranks, term frequencies, m, id), the first two as big-endian numbers of four bytes.

    Paths without a branch are one edge.  Documents that agree in all but
    their id are one leaf; its ``k`` smallest ids are enough for any answer.
    """
    vectors.sort()
    leaves: list[Node] = []
    same = None
    for ranks, tf, m, doc in vectors:
        if same == (ranks, tf, m):
            if len(leaves[-1].ids) < k:
                leaves[-1].ids.append(doc)
        else:
            same = ranks, tf, m
            leaves.append(Node(len(ranks) // 4, np.frombuffer(ranks, ">u4").astype(np.int64), np.frombuffer(tf, ">u4").astype(np.int64), m, [doc]))
            leaves[-1].children = ranks
    keys = [leaf.children for leaf in leaves]
    open_nodes = [Node(0)]
    for n, leaf in enumerate(leaves):
        leaf.children = ()
        depth = shared_start(keys[n], keys[n + 1]) if n + 1 < len(keys) else 0
        last = leaf
        while open_nodes[-1].depth > depth:
            done = open_nodes.pop()
            done.children.append(last)
            done.close()
            last = done
        if open_nodes[-1].depth < depth:
            open_nodes.append(Node(depth))
        open_nodes[-1].children.append(last)
    root = open_nodes[0]
    root.close()
    return root


class Best:
    """The k best documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.found = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items)  # scores of 0 do not count

    def offer(self, item: int, score: int, ids: list[int]) -> None:
        heap = self.found[item]
        for doc in ids:
            entry = (score, -doc)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                break
        if len(heap) == self.k:
            self.least[item] = heap[0][0]

    def search(self, root: Node, items: Items) -> int:
        """Walk a tree; returns the number of nodes whose bounds were computed."""
        todo, looked = [(root, np.ones(items.n_items, bool))], 0
        while todo:
            node, wanted = todo.pop()
            looked += 1
            # For a leaf the bound is the score itself.
            bound = items.scores(node.ranks, node.tf, node.m)
            wanted = wanted & (bound >= self.least)
            if not wanted.any():
                continue
            if node.children:
                todo += [(child, wanted) for child in node.children]
            else:
                for item in np.flatnonzero(wanted).tolist():
                    self.offer(item, int(bound[item]), node.ids)
        return looked


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list]:
    """Distinct items with their terms, in blocks of at most ``BLOCK_BYTES`` (or one item)."""
    lower = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.col(key).alias("item"), F.array_sort(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("terms"))
    rows = rows.where(F.size("terms") > 0).distinct().withColumn("bytes", F.octet_length(F.array_join("terms", " ")) + 64)
    rows = written_once(rows.withColumn("deal", F.xxhash64("item", "terms")))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n"), F.coalesce(F.max("bytes"), F.lit(0)).alias("top")).first()
    if not total.n:
        return
    blocks, most = -(-total.n // BLOCK_BYTES), None
    while most is None or (most > max(BLOCK_BYTES, total.top) and blocks < 1 << 30):
        blocks *= 1 if most is None else 2
        block = F.pmod("deal", F.lit(blocks))
        most = rows.groupBy(block.alias("b")).agg(F.sum("bytes").alias("n")).agg(F.max("n").alias("n")).first().n
    for n in range(blocks):
        held = rows.where(block == n).select("item", "terms").collect()
        if held:
            yield held
    discard(rows)


def _restricted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc, n (terms of the text with repeats) and the frequencies of the wanted terms, of texts with a term."""
    wanted = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    shape = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
    find = re.compile(TERM).findall

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = wanted.value.get
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(*[batch.column(c).to_pylist() for c in (0, 1)], strict=True):
                found = find(ascii_lower(text)) if text else []
                if found:
                    times = Counter(map(number, found))
                    times.pop(None, None)
                    for column, value in zip(out, (doc, len(found), list(times), list(times.values())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape, strict=True)], schema=shape)

    return docs.mapInArrow(in_pieces(counted, 400), "doc long, n long, terms array<int>, tf array<int>")


def _searched(vectors: DataFrame, items: Items, terms: list[str], keys: list, key_type, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The best documents of every item among those of a partition."""
    # The place of a term in the tree's order; a term of no document is never looked up.
    places = np.array([items.rank.get(t, -1) for t in terms], np.int64)
    sent = vectors.sparkSession.sparkContext.broadcast((items, places, keys))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, names = sent.value
        found, held, postings = Best(known.n_items, k), [], 0

        def look() -> None:
            found.search(document_tree(held, k), known)
            held.clear()

        for batch in batches:
            n, docs = batch.column("n").to_numpy(), batch.column("doc").fill_null(NO_ID).to_pylist()
            ms = (50 + (50 * n * n_docs) // n_terms).tolist()
            terms_of = batch.column("terms")
            ends = np.concatenate([[0], np.cumsum(terms_of.value_lengths().to_numpy())])
            ranks, tf = place[terms_of.flatten().to_numpy()], batch.column("tf").flatten().to_numpy()
            order = np.lexsort((ranks, np.repeat(np.arange(len(docs)), np.diff(ends))))
            ranks, tf, cuts = ranks[order].astype(">u4").tobytes(), tf[order].astype(">u4").tobytes(), (4 * ends).tolist()
            for i, doc in enumerate(docs):
                if cuts[i + 1] > cuts[i]:
                    part = slice(cuts[i], cuts[i + 1])
                    held.append((ranks[part], tf[part], ms[i], doc))
                    postings += (cuts[i + 1] - cuts[i]) // 4
                    if len(held) >= TREE_DOCS or postings >= TREE_POSTINGS:
                        look()
                        postings = 0
        if held:
            look()
        rows = [(item, -doc, score) for item, heap in enumerate(found.found) for score, doc in heap]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        ids = pa.array([None if d == NO_ID else d for d in doc], pa.int64())
        part = np.full(len(rows), TaskContext.get().partitionId() // MERGED_PARTITIONS)
        release_memory()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array([names[i] for i in item], arrow_type), pa.array(part, pa.int32()), ids, pa.array(score, pa.int64())],
            names=["number", "item", "part", "doc", "score"],
        )

    arrow_type = to_arrow_type(key_type)
    return vectors.mapInArrow(in_pieces(best, 4000), f"number int, item {key_type.simpleString()}, part int, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` highest-scoring documents of every item: the item's key, rank, the document's key, score.

    All documents are ranked for all items.  Items are taken in blocks of
    bounded size; for each, documents are reduced to the block's terms once
    and every partition walks its own trees.  At most ``k`` rows per item and
    partition go on, and they are merged in two steps.

    Documents and items that are null or hold no term have no rows, neither
    have scores of 0.  Ties go to the smaller document key, null last; a
    repeated document is ranked as often as it occurs, a repeated item is
    answered once; items that share a key but not their terms are answered
    apart.  Document keys are integers.  Only keys and texts are read, so
    other columns can have any names; empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    key_type = items.schema[item_key].dataType
    answers = []
    for block in _item_blocks(items, item_key, text):
        terms = sorted({t for r in block for t in r.terms})
        vectors = written_once(_restricted(rows, terms))
        size = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not size.docs:
            break
        # One row per term of the block at most.
        df = {terms[r.term]: r["count"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
        known = Items([r.terms for r in block], df, size.docs)
        found = written_once(_searched(vectors, known, terms, [r.item for r in block], key_type, size.docs, size.terms, k))
        discard(vectors)
        best_first = [F.desc("score"), F.asc_nulls_last("doc")]
        for group in (["number", "part"], ["number"]):
            found = found.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*best_first))).where(F.col("rank") <= k)
        answers.append(found.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(doc_key), "score"))
    if not answers:
        return spark.createDataFrame([], f"`{item_key}` {key_type.simpleString()}, rank int, `{doc_key}` long, score long")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
