"""Near-duplicate components by an exact Jaccard join over word shingles with signature trees.

Sets of texts stand in trees whose nodes hold the OR (and the AND) of their members' token bitmaps
and a range of set sizes. A tree is walked with itself, or with another one, two nodes at a time; a
pair of nodes is left as soon as the largest overlap that bitmaps and sizes allow is too small, or
when all below is connected already. Trees stand over buckets of texts that share a token:

1. Each text is hashed to its set of shingles. Equal sets are one node from there on.
2. ROUNDS times a node goes to the bucket of its smallest token under another hash, with its whole
   set. The walk compares what survives in place and stops where nodes are connected, so a group of
   copies costs comparisons in proportion to its size. Large buckets are dealt to random blocks.
3. Two sets that link share a token among the first quarter of each, in one order that all sets
   follow. The tokens of these prefixes make the buckets of the last walk, over every token in which
   several components still meet. A pair leaves a bucket only when no earlier shared token is in
   sight, and only when enough may be shared from this token on. What survives is compared in full.

The first walks find most links cheaply; the last one makes the result exact. Tokens that a bounded
sample shows to be frequent go last in the order, so a passage that many texts share hardly ever
makes a bucket. The sample steers only the work: any order gives the same result. Shingles are told
apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._bytes import LOWER, NARROW_BYTES, SPACE, WindowHash, buffers, mix, per_row, slices, spans
from corpusloom.llm._store import Scratch

WORDS, PERCENT = 5, 75
#: 64-bit words of a bitmap that is sent with a row; of one made in a task, at most.
BITMAP_WORDS, WIDEST = 16, 1024
#: Members of a leaf, children of a node, members of a block, pairs of nodes that a walk looks at together.
LEAF, FANOUT, BLOCK, FRONTIER = 8, 4, 512, 4096
#: Walks over whole sets, each under another hash; sets that one component sends to a bucket (expected).
ROUNDS, SENT = 3, 64
#: Earlier tokens of its prefix that a row carries, so that a pair leaves only the first bucket that both are in.
EARLIER = 8
#: One set in so many is sampled for frequent tokens, but no fewer than SAMPLE where there are; sampled sets that
#: make a token frequent; frequent tokens that are sent to all tasks (at most, 16 bytes each).
SAMPLE_EVERY, SAMPLE, FREQUENT, FREQUENT_KEPT = 8, 8192, 4, 2_000_000
#: Rows of a few numbers each that are sent to all tasks, at most; longer lists are shuffled.
ROWS_SENT = 2_000_000
#: Tokens in the common order: rare ones are below this number, frequent ones from it on.
FIRST_FREQUENT = 1 << 62
#: Shingles of more bytes than this are hashed on their own.
LONG_SHINGLE = 512


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and each row's bounds among them."""
    data, offsets = buffers(column)
    data = LOWER[data]
    inside = ~SPACE[data]
    starts, ends = spans(inside, offsets)
    bounds = per_row(starts, offsets)
    n = np.diff(bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    # One space after each word, whatever stood there, so that a shingle is one stretch of bytes.
    keep = inside.copy()
    keep[ends[ends < len(data)]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    joined = np.where(inside, data, np.uint8(0x20))[keep]
    row = np.repeat(np.arange(len(n)), n)
    width = np.minimum(words, n)[row]
    first = np.flatnonzero(np.arange(len(starts)) - bounds[row] + width <= n[row])
    low, high = place[starts[first]], place[ends[first + width[first] - 1]]
    tokens = WindowHash(joined)(low, high)
    for k in np.flatnonzero(high - low > LONG_SHINGLE):  # long regular input can make a polynomial hash collide
        tokens[k] = _whole_hash(joined[low[k] : high[k]].tobytes())
    row = row[first]
    order = np.lexsort((tokens, row))
    tokens, row = tokens[order], row[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    return tokens[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def _whole_hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def may_link(most: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes a and b with an overlap of at most ``most`` can link."""
    return 100 * most >= percent * (a + b - most)


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Tokens that two ascending arrays share."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int(np.count_nonzero(q[at] == p)) if len(q) else 0


def linked(p: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> bool:
    both = overlap(p, q)
    return both > 0 and 100 * both >= percent * (len(p) + len(q) - both)


def bitmaps(tokens: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """One bitmap of ``words`` 64-bit words for each set."""
    n = len(bounds) - 1
    bits = np.zeros((n, 64 * words), dtype=bool)
    bits[np.repeat(np.arange(n), np.diff(bounds)), (tokens >> np.uint64(17)) % np.uint64(64 * words)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


# -- the tree


class SignatureTree:
    """Members sorted by component, size and bitmap; level 0 has the members, each further level the nodes over it.

    ``room`` is the most that a member can share with another one (its size, or less where it is
    known that its first tokens are not shared).
    """

    def __init__(self, size: np.ndarray, bits: np.ndarray, comp: np.ndarray, room: np.ndarray | None = None):
        room = size if room is None else room
        self.order = np.lexsort((bits[:, 0], size, comp)) if len(size) else np.zeros(0, np.int64)
        # Of each node: smallest and largest set, most room, OR and AND of bitmaps.
        level = (size[self.order], size[self.order], room[self.order], bits[self.order], bits[self.order])
        self.levels, self.fanouts = [level], []
        while len(self.levels[-1][0]) > 1:
            low, high, room, some, every = self.levels[-1]
            self.fanouts.append(FANOUT if self.fanouts else LEAF)
            at = np.arange(0, len(low), self.fanouts[-1])
            least, most, room = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(room, at)
            self.levels.append((least, most, room, np.bitwise_or.reduceat(some, at, axis=0), np.bitwise_and.reduceat(every, at, axis=0)))
        self.relabel(comp)

    def relabel(self, comp: np.ndarray) -> None:
        """Smallest and largest component below each node; where they are the same, all below is connected."""
        self.comps = [(comp[self.order],) * 2]
        for fanout in self.fanouts:
            least, most = self.comps[-1]
            at = np.arange(0, len(least), fanout)
            self.comps.append((np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of each node one level below, with the place of their parent in ``nodes``."""
        fanout, n = self.fanouts[level - 1], len(self.levels[level - 1][0])
        below = (nodes[:, None] * fanout + np.arange(fanout)).ravel()
        parent = np.repeat(np.arange(len(nodes)), fanout)
        return below[below < n], parent[below < n]


def _passes(a: SignatureTree, la: int, i: np.ndarray, b: SignatureTree, lb: int, j: np.ndarray) -> np.ndarray:
    """Pairs of nodes below which two members of different components may still link.

    A bit that all members of a node have and no member of the other has costs each member at least
    one token of the overlap. The rest is bounded by the sizes: the more overlap, the better, and
    the sets should be as small as they can be with that overlap.
    """
    (least_a, most_a), (least_b, most_b) = ([x[k] for x in t.comps[level]] for t, level, k in ((a, la, i), (b, lb, j)))
    open_ = ~((least_a == most_a) & (least_b == most_b) & (least_a == least_b))
    i, j = i[open_], j[open_]
    low_a, high_a, room_a, some_a, every_a = (x[i] for x in a.levels[la])
    low_b, high_b, room_b, some_b, every_b = (x[j] for x in b.levels[lb])
    most = np.minimum(high_a - _count(every_a & ~some_b), high_b - _count(every_b & ~some_a))
    most = np.minimum(most, np.minimum(room_a, room_b))
    open_[open_] = may_link(most, np.maximum(low_a, most), np.maximum(low_b, most))
    return open_


def dual_walk(a: SignatureTree, b: SignatureTree, visit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Hands the members (i of a, j of b) that survive to ``visit``; a tree walked with itself gives each pair once.

    Depth first in bounded parts, so that memory does not follow the number of pairs, and so that
    what ``visit`` connects (and tells the trees by ``relabel``) is left out further on.
    """
    same = a is b
    start = np.zeros(min(1, len(a.order), len(b.order)), np.int64)
    todo = [(len(a.levels) - 1, start, len(b.levels) - 1, start)]
    while todo:
        la, i, lb, j = todo.pop()
        if len(i) > FRONTIER:
            todo += [(la, i[k : k + FRONTIER], lb, j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)][::-1]
            continue
        if same and la == lb:
            once = i <= j if la else i < j
            i, j = i[once], j[once]
        ok = _passes(a, la, i, b, lb, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            visit(a.order[i], b.order[j])
            continue
        if la >= lb:
            below, parent = a.children(la, i)
            i, j, la = below, j[parent], la - 1
        if lb > la:
            below, parent = b.children(lb, j)
            i, j, lb = i[parent], below, lb - 1
        todo.append((la, i, lb, j))


# -- Arrow stages


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64), pa.int64())


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each row's stretch of 8-byte values as binary."""
    offsets = (bounds * 8).astype(np.int64)
    blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return blob.cast(pa.binary())


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 8-byte values of a binary column, and each row's bounds among them."""
    data, offsets = _raw(column)
    return np.frombuffer(data.tobytes(), dtype=np.uint64), offsets // 8


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", NARROW_BYTES):
            tokens, bounds = shingle_sets(part.column("text"))
            n = np.diff(bounds)
            sums = []
            for seed in (1, 2):
                each = np.concatenate(([0], np.cumsum(mix(tokens ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), dtype=np.uint64))).astype(np.uint64)
                sums.append(_longs(each[bounds[1:]] - each[bounds[:-1]]))
            some = np.flatnonzero(n)
            least = np.zeros((len(n), ROUNDS), dtype=np.uint64)
            for r in range(ROUNDS if len(some) else 0):
                least[some, r] = np.minimum.reduceat(mix(tokens + np.uint64(0xD6E8FEB86659FD93 * (r + 1) & (1 << 64) - 1)), bounds[:-1][some])
            columns = [part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), *sums]
            columns += [_longs(least[:, r]) for r in range(ROUNDS)]
            yield pa.record_batch(columns, names=DESCRIBED)


DESCRIBED = ["row", "doc_id", "n", "key_a", "key_b", *(f"least_{r}" for r in range(ROUNDS))]


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", NARROW_BYTES):
            yield pa.record_batch([_longs(shingle_sets(part.column("text"))[0])], names=["token"])


def _token_sets(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", NARROW_BYTES):
            yield pa.record_batch([part.column("node"), _blobs(*shingle_sets(part.column("text"), words))], names=["node", "tokens"])


def wide_words(n: np.ndarray) -> np.ndarray:
    """Words of a set's own bitmap: a power of two with room for two to four bits a token."""
    return np.exp2(np.ceil(np.log2(np.clip(n / 32, 1, WIDEST)))).astype(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Each set's size and a bitmap as wide as it needs to be told apart."""
    for batch in batches:
        for part in slices(batch, "text", NARROW_BYTES):
            tokens, bounds = shingle_sets(part.column("text"), words)
            n = np.diff(bounds)
            bits = [bitmaps(tokens[low:high], np.array([0, high - low]), int(w)).tobytes() for low, high, w in zip(bounds[:-1], bounds[1:], wide_words(n), strict=True)]
            yield pa.record_batch([part.column("node"), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["node", "n", "wide"])


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words, both powers of two."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _sketches_fit(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps leave room for enough overlap."""
    for batch in batches:
        ok = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "wide_a", "wide_b")), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(p), len(q))
            p, q = fold(p, words), fold(q, words)
            most = min(n - int(_count(p & ~q)), m - int(_count(q & ~p)))
            ok.append(bool(may_link(most, n, m, percent)))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """An overlap is at least PERCENT of a set's own size, so of this many tokens one must be shared."""
    return n - -(-PERCENT * n // 100) + 1


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each set's bitmap and prefix in the common order: rare tokens by hash, then frequent ones by place."""
    for batch in batches:
        for part in slices(batch, "text", NARROW_BYTES):
            tokens, bounds = shingle_sets(part.column("text"))
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            keys = tokens >> np.uint64(2)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                late = frequent[at] == tokens
                keys = np.where(late, np.uint64(FIRST_FREQUENT) + place[at].astype(np.uint64), keys)
                keys = keys[np.lexsort((keys, row))]
            taken = np.arange(len(keys)) - bounds[row] < prefix_length(n)[row]
            edges = np.concatenate(([0], np.cumsum(np.where(n, prefix_length(n), 0))))
            prefix = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), _longs(keys[taken]))
            words = bitmaps(tokens, bounds, BITMAP_WORDS)
            bits = _blobs(words.ravel(), np.arange(len(n) + 1) * BITMAP_WORDS)
            yield pa.record_batch([part.column("node"), pa.array(n, pa.int64()), bits, prefix], names=["node", "n", "bits", "prefix"])


def _whole_buckets(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole buckets: rows that agree in ``keys`` stand together, but may go on in the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = np.stack([np.asarray(t.column(c)) for c in keys], axis=1)
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        if len(other):
            cut = int(other[-1]) + 1
            yield pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks()
            held = [t.slice(cut)]
        elif held and (np.array([np.asarray(held[-1].column(c))[-1] for c in keys]) != key[0]).any():
            yield pa.concat_tables(held).combine_chunks()
            held = [t]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _edges(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each bucket in the rows of a table."""
    key = np.stack([np.asarray(t.column(c)) for c in keys], axis=1)
    edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    return np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))


def bucket_links(sets: list[np.ndarray], comp: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (i, j) that connect all of one bucket's sets that links within it connect, and the labels that they give.

    What ``comp`` connects already stays so and needs no link.
    """
    links: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets])
    label = comp.copy()

    def compare(i: int, j: int) -> bool:
        if not linked(sets[i], sets[j]):
            return False
        links.append((i, j))
        label[label == label[j]] = label[i]
        return True

    if len(sets) <= LEAF:
        for i in range(len(sets)):
            for j in range(i):
                if label[i] != label[j] and may_link(min(size[i], size[j]), size[i], size[j]):
                    compare(i, j)
        return links, label
    # A bitmap tells sets apart well when it has more bits than the sets have tokens.
    words = 1
    while words < WIDEST and 32 * words < size.max():
        words *= 2
    bits = bitmaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))), words)
    tree = SignatureTree(size, bits, comp)

    def visit(i: np.ndarray, j: np.ndarray) -> None:
        found = False
        while len(i):
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            # One pair of each component at a time, since a link may connect the rest.
            first = np.unique(label[i], return_index=True)[1]
            for k in first.tolist():
                if label[i[k]] != label[j[k]]:
                    found |= compare(int(i[k]), int(j[k]))
            i, j = np.delete(i, first), np.delete(j, first)
        if found:
            tree.relabel(label)

    dual_walk(tree, tree, visit)
    return links, label


def _set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the walk of each bucket's tree over whole sets connects: each node with the least one of its label."""
    for t in _whole_buckets(batches, ["token", "block"]):
        node, comp = np.asarray(t.column("node")), np.asarray(t.column("comp"))
        tokens, bounds = _sets(t.column("tokens"))
        out = []
        for low, high in zip(*_edges(t, ["token", "block"]), strict=True):
            if comp[low:high].min() < comp[low:high].max():
                sets = [tokens[bounds[k] : bounds[k + 1]] for k in range(low, high)]
                links, label = bucket_links(sets, comp[low:high])
                if links:
                    own, which = node[low:high], np.unique(label, return_inverse=True)[1]
                    least = np.full(which.max() + 1, own.max())
                    np.minimum.at(least, which, own)
                    out += zip(least[which].tolist(), own.tolist(), strict=True)
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _prefix_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that survive the walk of each bucket's tree, or of the trees over two of its blocks."""
    keys = ["token", "low", "high"]
    for t in _whole_buckets(batches, keys):
        begin, end = _edges(t, keys)
        node, size, comp, room, block = (np.asarray(t.column(c), dtype=np.int64) for c in ("node", "n", "comp", "room", "block"))
        low_block, high_block = np.asarray(t.column("low")), np.asarray(t.column("high"))
        bits = _sets(t.column("bits"))[0].reshape(-1, BITMAP_WORDS)
        earlier = np.full((len(node), EARLIER), -1, dtype=np.int64)
        flat, edges = _lists(t.column("earlier"))
        held = np.diff(edges)
        earlier[np.repeat(np.arange(len(node)), held), np.arange(len(flat)) - np.repeat(edges[:-1], held)] = flat
        out: list[np.ndarray] = []

        def found(i: np.ndarray, j: np.ndarray) -> None:
            for k in range(0, len(i), FRONTIER):
                p, q = i[k : k + FRONTIER], j[k : k + FRONTIER]
                before = ((earlier[p][:, :, None] == earlier[q][:, None, :]) & (earlier[p] >= 0)[:, :, None]).any(axis=(1, 2))
                out.append(np.stack([np.minimum(node[p], node[q]), np.maximum(node[p], node[q])], axis=1)[~before])

        large = end - begin > LEAF
        # Small buckets are one leaf each: all their pairs at once, by distance.
        group = np.repeat(np.arange(len(begin)), end - begin)
        for d in range(1, LEAF):
            i = np.flatnonzero((group[d:] == group[:-d]) & ~large[group[d:]])
            j = i + d
            ok = (comp[i] != comp[j]) & ((low_block[i] == high_block[i]) | (block[i] != block[j]))
            i, j = i[ok], j[ok]
            most = np.minimum(room[i], room[j])
            most = np.minimum(most, np.minimum(size[i] - _count(bits[i] & ~bits[j]), size[j] - _count(bits[j] & ~bits[i])))
            ok = may_link(most, size[i], size[j])
            found(i[ok], j[ok])
        for g in np.flatnonzero(large):
            s = slice(begin[g], end[g])
            parts = [np.flatnonzero(block[s] == x) + begin[g] for x in dict.fromkeys((low_block[begin[g]], high_block[begin[g]]))]
            trees = [SignatureTree(size[p], bits[p], comp[p], room[p]) for p in parts]
            if all(len(p) for p in parts):
                dual_walk(trees[0], trees[-1], lambda i, j, p=parts: found(p[0][i], p[-1][j]))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    edges = np.asarray(column.offsets, dtype=np.int64)
    return np.asarray(column.values)[edges[0] : edges[-1]], edges - edges[0]


def _compare(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets link."""
    for batch in batches:
        (x, bx), (y, by) = _sets(batch.column("tokens_a")), _sets(batch.column("tokens_b"))
        ok = [linked(x[bx[r] : bx[r + 1]], y[by[r] : by[r + 1]], percent) for r in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


# -- Spark jobs


def frequent_tokens(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that a sample of texts shows to be frequent, ascending, and their place by how frequent they are."""
    every = min(SAMPLE_EVERY, max(1, rows // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(_all_tokens, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    kept = counts.orderBy(F.desc("count"), "token").limit(FREQUENT_KEPT).toArrow()
    token = np.asarray(kept["token"], dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], (len(token) - np.arange(len(token)))[order]


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node of the links; comp is the smallest node it reaches.

    Each round takes the smallest label among neighbours and then the label of the label; rounds
    grow with the logarithm of the longest path. Labels are kept as tables.
    """
    edges = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "near").alias("next"))
        step = scratch.write(step, "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("new"), "comp")
        moved = scratch.write(moved, "labels")
        labels = moved.select("node", F.col("new").alias("comp"))
        if not moved.where("new <> comp").limit(1).count():
            return labels


def _slim(table: DataFrame) -> DataFrame:
    """A written table of slim rows, to be sent to all tasks where it has no more than ROWS_SENT."""
    return F.broadcast(table) if table.count() <= ROWS_SENT else table


def _connected(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of all nodes that any link so far connects; earlier components are single nodes for the new links."""
    if labels is None:
        return components(links, scratch)
    side = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    roots = components(named, scratch)
    old = labels.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left")
    old = old.select("node", F.coalesce("root", "comp").alias("comp"))
    new = roots.join(labels.select("node"), "node", "left_anti")
    return scratch.write(old.unionByName(new), "labels")


def _with_comp(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(_slim(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _whole_sets(texts: DataFrame, nodes: DataFrame, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """(node, tokens) of the given nodes, which are written first."""
    nodes = scratch.write(nodes, "nodes")
    return scratch.write(texts.join(_slim(nodes), "node", "left_semi").select("node", "text").mapInArrow(lambda b: _token_sets(b, words), "node long, tokens binary"), "sets")


def _met(heads: DataFrame) -> DataFrame:
    """Nodes whose smallest token under some hash is that of another node too."""
    found = None
    for r in range(ROUNDS):
        token = F.col(f"least_{r}")
        several = heads.groupBy(token.alias("token")).count().where("count > 1").select("token")
        some = heads.select("node", token.alias("token")).join(several, "token", "left_semi").select("node")
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def _least_token_links(heads: DataFrame, sets: DataFrame, labels: DataFrame | None, r: int, scratch: Scratch) -> DataFrame:
    """Links among the nodes that share their smallest token under hash ``r``, by trees over whole sets.

    Of a component that stands in a bucket with many nodes only some go there, which steers the work
    alone: the last walk looks at every pair of components.
    """
    each = _with_comp(heads.select("node", F.col(f"least_{r}").alias("token")), labels)
    by_comp = each.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("own"))
    mixed = by_comp.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum(F.least("own", F.lit(SENT))).alias("members")).where("comps > 1")
    # The one row of each bucket goes to its members, not they to it, so that a large bucket is no one task's work.
    mixed = _slim(scratch.write(mixed, "mixed"))
    sent = by_comp.join(mixed, "token").select("token", "comp", "own", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    dealt = lambda k: F.pmod(F.xxhash64("node", F.lit(r), F.lit(k)), F.lit(1 << 20))
    chosen = each.join(sent, ["token", "comp"]).where(dealt(0) * F.col("own") < F.lit(SENT << 20))
    chosen = scratch.write(chosen.select("node", "token", "comp", F.pmod(dealt(1), "blocks").alias("block")), "chosen")
    rows = sets.join(_slim(chosen), "node").select("token", "block", "node", "comp", "tokens")
    return rows.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(_set_links, "a long, b long")


def _slots(n: Column) -> Column:
    """Size class; sets that link are of the same or neighbouring classes."""
    return F.floor(F.ln(n) / F.ln(F.lit(101 / PERCENT))).cast("long")


def _bucket_rows(prefixes: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Rows of the buckets in which several components meet; a large bucket is dealt to pairs of blocks.

    A block holds members of one size class, and those of the bucket's largest component stand in
    blocks of their own, which do not meet each other. A block meets the blocks of its own and the
    neighbouring classes.
    """
    known = scratch.write(_with_comp(prefixes, labels), "known")
    slim = known.select("node", "comp", "n", F.posexplode("prefix").alias("place", "token"))
    # The smaller set of a pair needs a shared token early in its prefix.
    early = (100 + PERCENT) * (F.col("n") - F.col("place")) >= 2 * PERCENT * F.col("n")
    slim = slim.select("token", "node", "comp", (F.col("n") - F.col("place")).cast("int").alias("room"), early.alias("early"))
    kept = ["token", "members", "node", "comp", "room"]
    # A token that is not frequent stands in few sets, so its rows can meet in one place.
    of_token = Window.partitionBy("token")
    ends = {"least": F.min("comp").over(of_token), "most": F.max("comp").over(of_token), "some": F.max("early").over(of_token), "members": F.count(F.lit(1)).over(of_token)}
    rare = slim.where(F.col("token") < FIRST_FREQUENT).withColumns(ends).where("least <> most and some").select(kept)
    # Frequent ones are as few as are sent to all tasks, and are counted before they are shuffled.
    often = slim.where(F.col("token") >= FIRST_FREQUENT)
    ends = often.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("early").alias("some"), F.count(F.lit(1)).alias("members"))
    often = often.join(F.broadcast(ends.where("least <> most and some").select("token", "members")), "token").select(kept)
    shared = scratch.write(rare.unionByName(often), "shared")

    tokens = F.transform("own", lambda x: x["token"])
    earlier = lambda i: F.slice(tokens, F.greatest(i - EARLIER, F.lit(0)) + 1, F.least(i, F.lit(EARLIER)))
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("room")).alias("late"), "token", "members", "room"))).alias("own"))
    rows = own.select("node", F.explode(F.transform("own", lambda x, i: F.struct(x["token"].alias("token"), x["room"].cast("long").alias("room"), x["members"].alias("members"), earlier(i).alias("earlier")))).alias("x"))
    rows = rows.join(known.select("node", "comp", "n", "bits"), "node")
    rows = rows.select("x.token", "x.members", "x.earlier", "node", "comp", "n", "x.room", "bits")
    columns = ["token", "low", "high", "block", "node", "comp", "n", "room", "bits", "earlier"]
    zero = F.lit(0).cast("long")
    small = rows.where(F.col("members") <= BLOCK).withColumns({"low": zero, "high": zero, "block": zero})

    wide = shared.where(F.col("members") > BLOCK)
    by_comp = wide.join(known.select("node", "n"), "node").groupBy("token", "comp", _slots(F.col("n")).alias("class")).agg(F.count(F.lit(1)).alias("own"))
    top = by_comp.groupBy("token", "comp").agg(F.sum("own").alias("own")).groupBy("token").agg(F.max_by("comp", "own").alias("top"))
    sizes = by_comp.join(top, "token").groupBy("token", "top", (F.col("class") * 2 + (F.col("comp") == F.col("top")).cast("long")).alias("group")).agg(F.ceil(F.sum("own") / BLOCK).alias("blocks"))
    sizes = sizes.groupBy("token", "top").agg(F.collect_list(F.struct("group", "blocks")).alias("groups"))
    sizes = scratch.write(sizes, "blocks")
    code = lambda group, k: F.shiftleft(group, 32) + k
    mine = (_slots(F.col("n")) * 2 + (F.col("comp") == F.col("top")).cast("long")).alias("mine")
    large = rows.where(F.col("members") > BLOCK).join(sizes, "token").withColumn("mine", mine)
    own_blocks = F.filter("groups", lambda g: g["group"] == F.col("mine"))[0]["blocks"]
    large = large.withColumn("block", code(F.col("mine"), F.pmod(F.xxhash64("node", "token"), own_blocks)))
    meets = lambda g: (F.abs(F.floor(g["group"] / 2) - F.floor(F.col("mine") / 2)) <= 1) & ~((g["group"] % 2 == 1) & (F.col("mine") % 2 == 1))
    others = F.flatten(F.transform(F.filter("groups", meets), lambda g: F.transform(F.sequence(F.lit(0).cast("long"), g["blocks"] - 1), lambda k: code(g["group"], k))))
    large = large.withColumn("other", F.explode(others)).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return small.select(columns).unionByName(large.select(columns))


def linked_pairs(pairs: DataFrame, texts: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link: those that wide bitmaps leave, compared in full."""
    both = F.explode(F.array("a", "b")).alias("node")
    side = lambda table, x, *held: table.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in held))
    nodes = scratch.write(pairs.select(both).distinct(), "nodes")
    sketch = scratch.write(texts.join(_slim(nodes), "node", "left_semi").select("node", "text").mapInArrow(lambda b: _sketches(b, words), "node long, n long, wide binary"), "sketches")
    met = pairs.join(side(sketch, "a", "n", "wide"), "a").join(side(sketch, "b", "n", "wide"), "b")
    near = scratch.write(met.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(lambda b: _sketches_fit(b, percent), "a long, b long"), "near")
    sets = _whole_sets(texts, near.select(both).distinct(), scratch, words)
    met = near.join(side(sets, "a", "tokens"), "a").join(side(sets, "b", "tokens"), "b")
    return scratch.write(met.select("a", "b", "tokens_a", "tokens_b").mapInArrow(lambda b: _compare(b, percent), "a long, b long"), "links")


def grouped_rows(described: DataFrame, heads: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """row, doc_id, n_shingles, component_id and stays of every described row, from the labels of the heads of equal sets."""
    roots = _with_comp(heads.select("node", "key_a", "key_b", "n"), labels).select("key_a", "key_b", "n", F.col("comp").alias("root"))
    rooted = described.select("row", "doc_id", "n", "key_a", "key_b").join(roots, ["key_a", "key_b", "n"], "left")
    first = rooted.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    # Written, so that the join below is a stage of its own, in which a large component can be split.
    first = _slim(scratch.write(first, "first"))
    return rooted.join(first, "root", "left").select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (F.col("root").isNull() | (F.col("row") == F.col("first.row"))).alias("stays"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Sets hold the distinct 5-word shingles of the text with A-Z lower-cased; a text of fewer words
    is one shingle; a null, empty or blank text has none, links with nothing and is its own
    component. Rows with equal sets belong together. Null ids are the largest; a component of null
    ids only has a null id. An empty table gives an empty result; other columns are not read.

    With ``row_col``, a unique number of each row, there are two more columns: ``row``, that number,
    and ``stays``, which is true for one row of each component: that of the smallest id, and of
    these the smallest number. ``rounds`` (at most ROUNDS) of walks over whole sets come before the
    exact one; any number gives the same result.
    """
    scratch = Scratch(docs.sparkSession)
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows if row_col else scratch.write(rows, "numbered")
    described = scratch.write(rows.mapInArrow(_describe, ", ".join(f"{c} long" for c in DESCRIBED)), "described")
    # Equal sets are one: the row with the smallest number stands for them.
    heads = described.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("row").alias("node"), *(F.first(f"least_{r}").alias(f"least_{r}") for r in range(ROUNDS)))
    heads = scratch.write(heads, "heads")
    texts = rows.select(F.col("row").alias("node"), "text")

    labels = None
    sets = _whole_sets(texts, _met(heads), scratch)
    for r in range(rounds):
        links = scratch.write(_least_token_links(heads, sets, labels, r, scratch), "links")
        labels = _connected(labels, links, scratch)
    scratch.drop(sets)

    frequent, place = frequent_tokens(texts, heads.count())
    prefixes = texts.mapInArrow(lambda b: _prefixes(b, frequent, place), "node long, n long, bits binary, prefix array<bigint>")
    copies = described.where("n > 0").select(F.col("row").alias("node")).join(heads.select("node"), "node", "left_anti")
    buckets = _bucket_rows(prefixes.where("n > 0").join(_slim(scratch.write(copies, "copies")), "node", "left_anti"), labels, scratch)
    together = buckets.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    pairs = scratch.write(together.mapInArrow(_prefix_pairs, "a long, b long").distinct(), "pairs")
    labels = _connected(labels, linked_pairs(pairs, texts, scratch), scratch)

    out = grouped_rows(described, heads, labels, scratch)
    if row_col is None:
        out = out.drop("row", "stays")
    return scratch.finish(out, "groups")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d
),
n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS token FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT r.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM reach r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n
"""
