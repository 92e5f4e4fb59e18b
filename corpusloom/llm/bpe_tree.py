"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves. An element of the monoid is a stretch with its stable tokens and two
open ends. Neighbours are joined by encoding a window around their border; the window grows until
the tokens outside it cannot change:

* Between matches of the splitting pattern, that is where white space follows a character that is
  none, and in a text without such places where letters and digits meet or either ends at other
  signs. No match spans such a place and no look-ahead crosses it, so both sides encode alone.
* Inside one long match, where the tokens on both sides of the window's edges form valid pairs. A
  token sequence is the encoding of its bytes exactly when each two neighbours are the encoding of
  theirs, and all other pairs already stood side by side in an encoding.

In a run of equal signs no border settles, since each token's place depends on where the run began.
A window that has grown to REACH tokens on both sides tells; the match is then merged as a whole, in
rounds that join all pairs of the lowest rank at once, and by a heap where rounds cannot tell the order.

Decoding concatenates byte strings up the same kind of tree.
"""

from __future__ import annotations

import base64
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._bytes import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, and bytes of a leaf inside one match of the pattern.
LEAF_CHARS, LEAF_BYTES = 320, 32
#: Ids that are joined at once when decoding; pieces whose ids a task remembers; what is no token.
LEAF_IDS, REMEMBERED, NO_RANK = 256, 400_000, 1 << 62
#: Places between matches: white space of these kinds behind a character that is none.
BORDERS = re.compile(r"(?<=\S)[ \t\n\x0b\x0c\r]")
#: Further ones, for texts with hardly any: between letters and numbers, and where either ends at a sign that is neither.
CLASS_BORDERS = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
#: Characters for each border that a text has at least, or else the further ones are looked for.
FAR_APART = 4096
#: Tokens on each side of a window that has not settled; rounds of a whole match, and different pairs of one round.
REACH, ROUNDS, KINDS = 64, 64, 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class TreeCodec:
    """Encoder and decoder of one vocabulary; special tokens do not exist here."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self._matches = regex.compile(pattern)
        self._ranks, self._bytes = ranks, {i: t for t, i in ranks.items()}
        self._leaf_chars, self._leaf_bytes = max(2, leaf_chars), max(2, leaf_bytes)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, list[int]] = {}

    # -- bytes within one match of the pattern

    def _merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of the lowest rank, the leftmost of equal ones first, until none make a token."""
        rank, edges = self._ranks.get, list(range(len(piece) + 1))
        joined = [rank(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while joined:
            least = min(joined)
            if least == NO_RANK:
                break
            k = joined.index(least)
            del edges[k + 1], joined[k]
            if k:
                joined[k - 1] = rank(piece[edges[k - 1] : edges[k + 1]], NO_RANK)
            if k < len(joined):
                joined[k] = rank(piece[edges[k] : edges[k + 2]], NO_RANK)
        return [self._ranks[piece[a:b]] for a, b in zip(edges, edges[1:], strict=False)]

    def _piece_leaf(self, piece: bytes) -> list[int]:
        whole = self._ranks.get(piece)
        return [whole] if whole is not None else self._merge(piece)

    def _is_pair(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            both = self._bytes[a] + self._bytes[b]
            known = self._pairs[a, b] = self._piece_leaf(both) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern, however long."""
        tokens = self._halves(piece)
        return self._whole(piece) if tokens is None else tokens

    def _halves(self, piece: bytes) -> list[int] | None:
        """The tokens by halves; none where a border does not settle."""
        if len(piece) <= self._leaf_bytes:
            return self._piece_leaf(piece)
        middle = len(piece) // 2
        left = self._halves(piece[:middle])
        right = None if left is None else self._halves(piece[middle:])
        if left is None or right is None:
            return None
        reach = 1
        while reach <= REACH:
            i, j = min(reach, len(left)), min(reach, len(right))
            window = b"".join(self._bytes[t] for t in (*left[len(left) - i :], *right[:j]))
            tokens = self._piece_leaf(window)
            held_left = i == len(left) or self._is_pair(left[-i - 1], tokens[0])
            held_right = j == len(right) or self._is_pair(tokens[-1], right[j])
            if held_left and held_right:
                return left[: len(left) - i] + tokens + right[j:]
            reach *= 2
        return None

    def _whole(self, piece: bytes) -> list[int]:
        """A match that cannot be halved: rounds that merge all pairs of the lowest rank, while what they make is of a higher one."""
        one = np.array([self._ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        ids = one[np.frombuffer(piece, np.uint8)]
        size = np.int64(len(self._bytes) + 1 + max(self._bytes, default=0))

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
            """Rank of each pair, by the few different ones."""
            kinds, at = np.unique(a * size + b, return_inverse=True)
            if len(kinds) > KINDS:
                return None
            pairs = [self._ranks.get(self._bytes[k // size] + self._bytes[k % size], NO_RANK) for k in kinds.tolist()]
            return np.array(pairs, dtype=np.int64)[at]

        for _ in range(ROUNDS):
            if len(ids) < 2:
                return ids.tolist()
            ranks = rank(ids[:-1], ids[1:])
            if ranks is None:
                break
            least = ranks.min()
            if least == NO_RANK:
                return ids.tolist()
            # From the left, every pair of this rank that does not overlap the one before it.
            hits = np.flatnonzero(ranks == least)
            first = np.concatenate(([True], np.diff(hits) > 1))
            begin = hits[first][np.cumsum(first) - 1]
            hits = hits[(hits - begin) % 2 == 0]
            # Whatever a new token stands beside on the way must be of a higher rank, or the order is another.
            before, behind = hits[hits > 0] - 1, hits[hits + 2 < len(ids)] + 2
            left = ids[before].copy()
            left[np.isin(before, hits + 1)] = least
            made = np.full(len(ids), least)
            later = [rank(left, made[: len(left)]), rank(made[: len(behind)], ids[behind])]
            if any(r is None or (len(r) and r.min() <= least) for r in later):
                break
            keep = np.ones(len(ids), dtype=bool)
            keep[hits + 1] = False
            ids = ids.copy()
            ids[hits] = least
            ids = ids[keep]
        return self._by_heap(ids.tolist())

    def _by_heap(self, ids: list[int]) -> list[int]:
        """Merge the neighbours of the lowest rank, the leftmost of equal ones first, from any stage of merging on."""
        rank, own = self._ranks.get, self._bytes
        n = len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            r = rank(own[ids[k]] + own[ids[k + 1]])
            if r is not None:
                heap.append((r, k, ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = following[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two is no longer there
            ids[k], ids[j] = r, -1
            following[k] = m = following[j]
            if m < n:
                before[m] = k
                r = rank(own[ids[k]] + own[ids[m]])
                if r is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[m]))
            i = before[k]
            if i >= 0:
                r = rank(own[ids[i]] + own[ids[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
        return [t for t in ids if t >= 0]

    # -- texts

    def _window(self, text: str, low: int, high: int) -> list[int]:
        """Match by match; a match longer than a leaf is a tree of its own."""
        known = self._words
        pieces = self._matches.findall(text, low, high)
        try:
            return list(chain.from_iterable(map(known.__getitem__, pieces)))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        found: list[int] = []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= self._leaf_chars:
                    known[piece] = ids
            found += ids
        return found

    def encode(self, text: str) -> list[int]:
        borders = [m.start() for m in BORDERS.finditer(text)] if len(text) > self._leaf_chars else []
        if len(borders) * FAR_APART < len(text) and len(text) > self._leaf_chars:
            borders = sorted({*borders, *(m.start() for m in CLASS_BORDERS.finditer(text))})
        part = self._part(text, borders, 0, len(borders), 0, len(text))
        if part is None:
            return self._window(text, 0, len(text))
        first, tokens, last = part
        return self._window(text, 0, first) + tokens + self._window(text, last, len(text))

    def _part(self, text: str, borders: list[int], i: int, j: int, low: int, high: int) -> tuple[int, list[int], int] | None:
        """The stable part of a stretch that holds borders[i:j]: first border, tokens from there to the last border, last border.

        What lies before the first and behind the last border of a half is settled by the join with
        its neighbour, whose window reaches from the last border of the one to the first of the other.
        """
        if i == j:
            return None
        if high - low <= self._leaf_chars:
            return borders[i], self._window(text, borders[i], borders[j - 1]), borders[j - 1]
        middle = (low + high) // 2
        k = bisect_left(borders, middle, i, j)
        left, right = self._part(text, borders, i, k, low, middle), self._part(text, borders, k, j, middle, high)
        if left is None or right is None:
            return left or right
        first, tokens, a = left
        b, more, last = right
        tokens += self._window(text, a, b)
        tokens += more
        return first, tokens, last

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self._bytes.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@cache
def _codec(path: str | None, pattern: str | None) -> TreeCodec:
    """One codec for all tasks that a Python process runs, so that what it remembers serves the next task too."""
    import public_tokenizers

    return TreeCodec(load_ranks(path or default_vocabulary()), pattern or public_tokenizers.PATTERN)


def _encode(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str | None) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        for part in slices(batch, "text"):
            ids = [np.asarray(codec.encode(t or ""), dtype="<u4").tobytes() for t in part.column("text").to_pylist()]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str | None) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        for part in slices(batch, "ids"):
            texts = [codec.decode(np.frombuffer(i or b"", dtype="<u4")) for i in part.column("ids").to_pylist()]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])


def _code(batches: Iterator[pa.RecordBatch], path: str | None, pattern: str | None) -> Iterator[pa.RecordBatch]:
    codec = _codec(path, pattern)
    for batch in batches:
        for part in slices(batch, "text"):
            ids = [np.asarray(codec.encode(t or ""), dtype="<u4") for t in part.column("text").to_pylist()]
            columns = [pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(list(map(codec.decode, ids)), pa.binary())]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have no tokens. Repeated rows and null ids are kept as they come; an empty
    table gives an empty result; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda b: _encode(b, vocabulary, pattern), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids; null ids decode to none."""
    slim = encoded.select("doc_id", "n_tokens", "ids")
    return slim.mapInArrow(lambda b: _decode(b, vocabulary, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")


def code(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """What ``decode(encode(docs))`` gives, in one pass."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda b: _code(b, vocabulary, pattern), "doc_id long, n_tokens long, ids binary, decoded binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = code(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
