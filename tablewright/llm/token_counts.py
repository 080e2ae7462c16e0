"""Greedy longest-match token counts in one pass over the text.

A trie of the vocabulary gets failure links.  Where the trie has no edge for
the next byte, the longest tokens matched so far are popped and the automaton
goes on from the node of what is left; how many tokens each failure pops is
computed beforehand, so counting needs no backtracking and builds no pieces.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.bpe import CACHED_LENGTH, CACHED_WORDS, PRETOKEN, load, read_spec
from tablewright.llm.common import append, by_slices


class LongestMatch:
    """Counts the tokens of greedy longest-match segmentation; every single byte must be a token."""

    def __init__(self, vocabulary: list[bytes]):
        edge: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        is_token = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in edge:
                    edge[key] = len(is_token)
                    children[node].append((byte, len(is_token)))
                    children.append([])
                    is_token.append(False)
                node = edge[key]
            is_token[node] = node > 0
        if not all(is_token[edge.get(b, 0)] for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        fail, pops = [0] * len(is_token), [0] * len(is_token)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node]:
                if is_token[child]:
                    pops[child] = 1
                else:
                    back, n = fail[node], pops[node]
                    while back << 8 | byte not in edge:
                        n += pops[back]
                        back = fail[back]
                    fail[child], pops[child] = edge[back << 8 | byte], n
                queue.append(child)
        self.edge, self.fail, self.pops = edge, fail, pops
        self.known: dict[str, int] = {}
        self.split = regex.compile(PRETOKEN).findall

    def count(self, raw: bytes) -> int:
        edge, fail, pops = self.edge, self.fail, self.pops
        node = n = 0
        for byte in raw:
            after = edge.get(node << 8 | byte)
            while after is None:
                n += pops[node]
                node = fail[node]
                after = edge.get(node << 8 | byte)
            node = after
        while node:
            n += pops[node]
            node = fail[node]
        return n

    def of_text(self, text: str | None) -> int:
        """Tokens of all pre-tokens of a text."""
        if not text:
            return 0
        total, known = 0, self.known
        for piece in self.split(text):
            n = known.get(piece)
            if n is None:
                n = self.count(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= CACHED_LENGTH:
                    if len(known) >= 2 * CACHED_WORDS:
                        known.clear()
                    known[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def automaton(spec: str) -> LongestMatch:
    return LongestMatch([raw for raw in load.__wrapped__(spec).bytes_of if raw])


def count_tokens(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of longest-match tokens of every whole text.

    Null and empty texts have none.  A text is cut into the vocabulary's
    pre-tokens, each of which is matched greedily, longest token first.  Rows
    are independent; an input column called ``name`` gives way.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        matcher = automaton(spec.value)
        return by_slices(lambda part: pa.array(map(matcher.of_text, part), pa.int64()))(texts)

    return append(df, **{name: counted(F.col(text).cast("string"))})
