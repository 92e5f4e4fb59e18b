"""Sum-of-squares online packing of token streams into fixed windows.

Each document becomes full windows plus a remainder; a remainder goes to the fill level that
minimises the sum of squared counts of partially filled windows. Partitions pack on their own,
so nothing is shuffled. Of the windows that are open at the end of a partition, the fullest are
filled up from the emptiest; the last ones have powers of two as their lengths. Nothing is padded.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm._bytes import NARROW_BYTES, SPACE, WindowHash, buffers, byte_class, slices

WINDOW = 2048
EOS_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Distinct chunks that a task remembers; beyond it the memory starts anew.
CACHE_CHUNKS = 400_000

LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
#: ASCII bytes that are no letters.
NOT_LETTER = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of each row that byte-level BPE encodes alike alone and in context.

    No match of the splitting pattern spans, and none looks across, a place where white space
    follows a character that is none, or where another character follows a letter. Only such
    places are cut. After a lead byte under which Unicode has further white space no cut is made,
    and letters are told for ASCII and Latin-1 alone; a missed cut only makes a chunk longer.
    """
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n > 1:
        solid = (data > 0x20) & (data != 0x7F)
        odd = np.zeros(n, dtype=bool)
        odd[1:] |= data[:-1] == 0xC2
        odd[2:] |= np.isin(data[:-2], (0xE1, 0xE2, 0xE3))
        cut[1:] = SPACE[data[1:]] & (solid & ~odd)[:-1]
        letter = LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= letter[:-1] & NOT_LETTER[data[1:]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


class ChunkEncoder:
    """Token ids of texts, each distinct chunk being encoded once while it is remembered."""

    def __init__(self, encode: Callable[[bytes], bytes], remember: int = CACHE_CHUNKS, special: tuple[bytes, ...] = ()):
        self._encode, self._remember, self._known = encode, remember, {}
        self._special = re.compile(b"|".join(map(re.escape, special))) if special else None

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of each row; one that holds the string of a special token is a chunk as a whole."""
        starts, ends = chunk_spans(data, offsets)
        at = [m.start() for m in self._special.finditer(data.tobytes())] if self._special else []
        if at:
            rows = np.unique(np.searchsorted(offsets, at, side="right") - 1)
            whole = np.zeros(len(offsets) - 1, dtype=bool)
            whole[rows] = True
            row = np.searchsorted(offsets, starts, side="right") - 1
            keep = ~whole[row] | (starts == offsets[row])
            starts = starts[keep]
            ends = np.append(starts[1:], len(data))
        return starts, ends

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and each row's bounds among them."""
        data, offsets = buffers(column)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        starts, ends = self._chunks(data, offsets)
        _, first, which = np.unique(WindowHash(data)(starts, ends), return_index=True, return_inverse=True)
        twin = np.repeat(starts[first][which] - starts, ends - starts) + np.arange(len(data))
        if not np.array_equal(data[np.minimum(twin, len(data) - 1)], data):  # different chunks share a hash
            first = which = np.arange(len(starts))
        if len(self._known) > self._remember:
            self._known.clear()
        known, raw, parts = self._known, data.tobytes(), []
        for low, high in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            chunk = raw[low:high]
            ids = known.get(chunk)
            if ids is None:
                known[chunk] = ids = self._encode(chunk)
            parts.append(ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        counts = sizes[which]
        stops = np.cumsum(counts)
        begin = (np.cumsum(sizes) - sizes)[which]
        ids = flat[np.repeat(begin - (stops - counts), counts) + np.arange(int(stops[-1]))]
        return ids, np.concatenate(([0], stops))[np.searchsorted(starts, offsets, side="left")]


def load_encoder(path: str) -> ChunkEncoder:
    """The public vocabulary by the tokenizers library; the string of a special token in a text is that token, as there."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())
    holds_special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)").search
    # What a byte looks like to the model: printable bytes are themselves, the others follow from U+0100 on.
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in printable]
    alphabet = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    # Chunks that are one match of the splitting pattern go straight to the merges.
    single = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
    merges = tokenizer.model.tokenize

    def encode(chunk: bytes) -> bytes:
        word = chunk[1:] if chunk[0] == 0x20 else chunk
        if holds_special(chunk):
            ids = tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids
        elif word.isalpha():  # ASCII letters look like themselves
            ids = [t.id for t in merges((alphabet[0x20] if len(word) < len(chunk) else "") + word.decode("ascii"))]
        elif single(chunk):
            ids = [t.id for t in merges(chunk.decode("latin-1").translate(alphabet))]
        else:
            ids = tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    return ChunkEncoder(encode, special=special)


class SumOfSquares:
    """Places remainders online; ``count[h]`` is the number of open windows filled up to h."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of ``size`` < window somewhere; a window that became full is returned."""
        n, w = self.count, self.window
        # Change of the sum of squares, halved: leaving level h saves n[h] - 1/2, entering h + size costs n[h + size] + 1/2.
        cost = n[size : w + 1] - n[: w - size + 1] + 1.0
        cost[w - size] -= n[w] + 0.5  # a full window is no longer counted
        cost[0] = n[size] + 0.5
        cost[1:][n[1 : w - size + 1] == 0] = np.inf
        level = int(np.argmin(cost))
        if level:
            held = self.open[level].pop()
            n[level] -= 1
        else:
            held = []
        held.append(piece)
        if level + size == w:
            return held
        self.open[level + size].append(held)
        n[level + size] += 1
        return None

    def close(self) -> Iterator[list[tuple]]:
        """The windows that are still open, as sequences: full ones, and at the end powers of two.

        The fullest window keeps what was placed in it and is filled up from the emptiest one, whose
        pieces are cut as they are needed; so only what stood in the emptiest windows moves.
        """
        windows = [held for level in reversed(self.open) for held in level]
        spare: list[tuple] = []
        first, last = 0, len(windows) - 1
        while first <= last:
            held, need = windows[first], self.window - sum(len(p[2]) for p in windows[first])
            first += 1
            while need and (spare or first <= last):
                if not spare:
                    spare = windows[last][::-1]
                    last -= 1
                doc_id, start, tokens, total = spare.pop()
                held.append((doc_id, start, tokens[:need], total))
                if len(tokens) > need:
                    spare.append((doc_id, start + need, tokens[need:], total))
                need -= len(held[-1][2])
            if need:
                spare = held[::-1]
                break
            yield held
        # Less than a window is left.
        left = sum(len(p[2]) for p in spare)
        while left:
            size = 1 << left.bit_length() - 1
            left -= size
            sequence = []
            while size:
                doc_id, start, tokens, total = spare.pop()
                sequence.append((doc_id, start, tokens[:size], total))
                if len(tokens) > size:
                    spare.append((doc_id, start + size, tokens[size:], total))
                size -= len(sequence[-1][2])
            yield sequence


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, window: int, eos: int) -> Iterator[pa.RecordBatch]:
    encode = load_encoder(path)
    squares = SumOfSquares(window)
    base = TaskContext.get().partitionId() << 33
    sequence, rows = 0, []

    def emit(pieces: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset))
            offset += len(ids)
        sequence += 1

    def flush() -> pa.RecordBatch:
        schema = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        out = pa.record_batch([pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])
        rows.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text", NARROW_BYTES):
            ids, bounds = encode(part.column("text"))
            for doc_id, low, high in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                tokens = np.append(ids[low:high], np.uint32(eos)).astype("<u4")
                total = len(tokens)
                whole = total - total % window
                for start in range(0, whole, window):
                    emit([(doc_id, start, tokens[start : start + window], total)])
                if whole < total:
                    full = squares.place((doc_id, whole, tokens[whole:], total), total - whole)
                    if full is not None:
                        emit(full)
            if len(rows) > 20_000:
                yield flush()
    for sequence_of in squares.close():
        emit(sequence_of)
    yield flush()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, eos: int = EOS_ID, vocabulary: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens; one row per piece.

    A document is its ids followed by ``eos``; null and empty texts are that one id. Rows with the
    same or a null id are documents of their own. Every sequence is full or has a power of two as
    its length (``window`` must be one). An empty table gives no rows; other columns are not read.
    ``sequence_id`` is unique and fixed by the partition, so a repeated task gives the same rows.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    path = vocabulary or default_vocabulary()
    slim = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return slim.mapInArrow(lambda batches: _pack_partition(batches, path, window, eos), PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
