"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

BPE merges make the encoding of a text prefix unique, so it is enough to store
one token per prefix: the last one.  An automaton over the vocabulary yields,
for every position, the tokens that end there (longest first).  Token ``t`` is
the last token of a prefix when it is compatible with the last token of what
precedes it; following the stored tokens back from the end gives the ids.  The
work is linear in the text, also for a text that is one very long word.

Two tokens are compatible when no merge across their seam would ever fire.
The pieces that touch the seam while the left token is built are the right
spine of its merge tree; for the right token they are the left spine.  A merge
of two such pieces fires if its rank is below the rank that consumes the left
piece and not above the rank that consumes the right one (on equal ranks the
leftmost merge is first).
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, by_slices

# Fixed value: the pre-tokenizer's pattern of the vocabulary files.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60
CACHED_WORDS = 200_000
CACHED_PAIRS = 400_000
CACHED_LENGTH = 48


def byte_characters() -> dict[str, int]:
    """The printable stand-ins for bytes: visible Latin-1 as is, the rest from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, spec: str):
        loaded = json.loads(spec)
        to_byte = byte_characters()
        vocab = loaded["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        as_bytes = {t: bytes(to_byte[c] for c in t) for t in vocab if t not in self.special}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, raw in as_bytes.items():
            self.bytes_of[vocab[token]] = raw
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts = parts = {}
        for r, pair in enumerate(loaded["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left], vocab[right]] = r
            parts[vocab[left + right]] = (vocab[left], vocab[right], r)
        self.automaton = ahocorasick.Automaton()
        for token, raw in as_bytes.items():
            self.automaton.add_word(raw.decode("latin-1"), vocab[token])
        self.automaton.make_automaton()
        self.split = regex.compile(PRETOKEN).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.size_of = [len(raw) for raw in self.bytes_of]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.tested: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at one edge of a token, each with the rank of the merge that consumes it."""
        found, parts = [(token, NEVER)], self.parts
        while token in parts:
            token, ends = parts[token][side], parts[token][2]
            found.append((token, ends))
        return found

    def compatible(self, left: int, right: int) -> bool:
        rank = self.rank.get
        touching = self._spine(right, 0)
        fits = not any(
            rank((a, b), NEVER) < a_ends and rank((a, b), NEVER) <= b_ends
            for a, a_ends in self._spine(left, 1)
            for b, b_ends in touching
        )
        if len(self.tested) >= CACHED_PAIRS:
            self.tested.clear()
        self.tested[left << 20 | right] = fits
        return fits

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        raw = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last = [-1] * len(raw)
        size_of, tested = self.size_of, self.tested
        for end, token in self.automaton.iter(raw):
            if last[end] < 0:
                before = end - size_of[token]
                if before < 0:
                    last[end] = token
                else:
                    fits = tested.get(last[before] << 20 | token)
                    if fits is None:
                        fits = self.compatible(last[before], token)
                    if fits:
                        last[end] = token
        ids, at = [], len(raw) - 1
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= size_of[token]
        return tuple(reversed(ids))

    def _remember(self, chunk: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Keep ``ids``; the cache is bounded, its older half still answers."""
        if len(chunk) <= CACHED_LENGTH:
            if len(self.pieces) >= CACHED_WORDS:
                self.older, self.pieces = self.pieces, {}
            self.pieces[chunk] = ids
        return ids

    def _pretoken(self, piece: str) -> tuple[int, ...]:
        if piece.isspace():  # never among the chunks that _plain looks up
            return self.word(piece)
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._remember(piece, self.older.get(piece) or self.word(piece))
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._pretoken, self.split(chunk))))

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        A single space between two visible characters always starts a
        pre-token, so the text falls apart there and each part can be looked
        up; parts that touch other white space are encoded together.
        """
        out, held = [], None
        for n, part in enumerate(text.split(" ")):
            chunk = " " + part if n else part
            if held is None and (ids := self.pieces.get(chunk)):
                # Only chunks without white space at their edges are kept.
                out += ids
            elif part and not part[0].isspace() and not part[-1].isspace():
                if held is not None:
                    out += self._chunk(held + chunk)
                    held = None
                elif part.isalpha() and part.isascii():
                    out += self._pretoken(chunk)
                else:
                    out += self._remember(chunk, self.older.get(chunk) or self._chunk(chunk))
            else:
                held = chunk if held is None else held + chunk
        if held is not None:
            out += self._chunk(held)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.apart is None or not any(t in text for t in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.apart(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self._plain(part))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(spec: str) -> ByteBPE:
    return ByteBPE(spec)


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver; its size (a few MB) bounds what is sent to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of every text and the text that they decode to.

    Null and empty texts give no ids and an empty decoded text.  Special
    tokens written in a text become their ids, as the library does by default.
    Texts are encoded whole, rows are independent: repeated rows repeat their
    result, an empty table gives an empty one, and input columns named like
    the results give way.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(path))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def coded(texts: pa.Array) -> pa.Array:
        bpe = load(spec.value)

        def some(part: list) -> pa.Array:
            all_ids = [bpe.encode(t) for t in part]
            return pa.StructArray.from_arrays(
                [pa.array(all_ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, all_ids), pa.string())], ["ids", "decoded"]
            )

        return by_slices(some)(texts)

    both = append(df, _coded=coded(F.col(text).cast("string")))
    return append(both, **{ids: F.col("_coded.ids"), decoded: F.col("_coded.decoded")}).drop("_coded")
