"""Near-duplicate components by a multi-index Hamming join over b-bit MinHash signatures.

A signature holds, for each of CHUNKS * WIDTH hash functions, BITS bits of the smallest hash of a
text's shingles. Two sets of similarity s differ in each symbol with probability 1 - s, so for sets
that link the number of different symbols is binomial and hardly ever above THRESHOLD; ``missed``
gives the probability.

The join guarantees every pair of signatures within that distance. Symbols are split into chunks; of
at most THRESHOLD = CHUNKS * (RADIUS + 1) - 1 errors some chunk has at most RADIUS (pigeonhole). The
errors that a chunk may have are enumerated: for each choice of RADIUS symbols to leave out, the rest
is a key, and two chunks within RADIUS errors share at least one. A pair is looked at only in the
first bucket that both are in.

1. Each text is hashed to its set and its signature. Equal sets are one node from there on.
2. ROUNDS times nodes with an equal chunk meet, with their whole sets, nearest signatures first; what
   is connected already is not compared. So a group of copies is one component before it is expanded.
3. All keys of all nodes are counted, map-side first. Only buckets in which several components still
   meet are gathered, with signatures and bitmaps. Nodes that are within the distance of one of
   another component, and whose bitmaps leave room for enough overlap, meet once more with their whole
   sets. No pair leaves a bucket but a link that connects.

Step 2 steers the work: with any number of rounds step 3 looks at every pair of components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._bytes import mix, slices
from corpusloom.llm._store import Scratch
from corpusloom.llm.jaccard_join import _blobs, _connected, _count, _edges, _longs, _raw, _sets, _slim, _whole_buckets, _whole_sets, _with_comp, grouped_rows, linked, may_link, shingle_sets

WORDS, PERCENT = 3, 85
#: Chunks of a signature, symbols of a chunk, errors of a chunk that are enumerated, bits of a symbol.
CHUNKS, WIDTH, RADIUS, BITS = 12, 5, 1, 16
SYMBOLS, THRESHOLD = CHUNKS * WIDTH, CHUNKS * (RADIUS + 1) - 1
#: Choices of symbols that a key keeps.
KEPT = list(combinations(range(WIDTH), WIDTH - RADIUS))
#: Rounds over whole chunks; nodes of one component that go to a bucket there (expected); nodes of a block; pairs compared at once.
ROUNDS, SENT, BLOCK, PAIRS = 3, 64, 512, 1 << 13
#: 64-bit words of a set's bitmap, at most.
WIDEST = 64

_random = np.random.default_rng(1105)
_FLIPS = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1)
_FACTORS = _random.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def missed(similarity: float = PERCENT / 100) -> float:
    """Probability that two sets of this similarity have signatures beyond the threshold."""
    same = similarity + (1 - similarity) / 2**BITS
    return sum(comb(SYMBOLS, k) * (1 - same) ** k * same ** (SYMBOLS - k) for k in range(THRESHOLD + 1, SYMBOLS + 1))


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of SYMBOLS symbols for each set; zeros for an empty one."""
    out = np.zeros((len(bounds) - 1, SYMBOLS), dtype=np.uint16)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        at = bounds[:-1][some]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((tokens ^ _FLIPS[k]) * _FACTORS[k], at)
            out[some, k] = mix(least) >> np.uint64(64 - BITS)
    return out


def _folded(symbols: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of symbols."""
    h = np.full(len(symbols), np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for k in range(symbols.shape[1]):
        h = mix(h ^ symbols[:, k].astype(np.uint64) + np.uint64(1))
    return h


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature one key for each chunk and choice of kept symbols."""
    chunks = sig.reshape(len(sig), CHUNKS, WIDTH)
    return np.stack([_folded(chunks[:, c, kept], 1 + c * len(KEPT) + i) for c in range(CHUNKS) for i, kept in enumerate(KEPT)], axis=1)


def first_key(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each pair of signatures, and the number of the first key that both have (beyond all keys where there is none)."""
    differ = (p != q).reshape(len(p), CHUNKS, WIDTH)
    shared = np.stack([~differ[:, :, kept].any(axis=2) for kept in KEPT], axis=2).reshape(len(p), -1)
    return differ.sum(axis=(1, 2)), np.where(shared.any(axis=1), shared.argmax(axis=1), shared.shape[1])


def bitmaps(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all sets one after the other, and their bounds: a power of two of words for each, with eight bits a token or more, up to WIDEST words."""
    n = np.diff(bounds)
    words = np.exp2(np.ceil(np.log2(np.clip(n / 8, 1, WIDEST)))).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(words)))
    row = np.repeat(np.arange(len(n)), n)
    bits = np.zeros(64 * edges[-1], dtype=np.uint8)
    bits[64 * edges[row] + ((tokens >> np.uint64(17)) % (64 * words[row]).astype(np.uint64)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64), edges


class Bitmaps:
    """Bitmaps of several widths; two are compared at the width of the narrower one."""

    def __init__(self, flat: np.ndarray, edges: np.ndarray):
        self._flat, self._at, self._words = flat, edges[:-1], np.diff(edges)

    def _folded(self, rows: np.ndarray, wide: int, words: int) -> np.ndarray:
        held = self._flat[self._at[rows][:, None] + np.arange(wide)]
        return np.bitwise_or.reduce(held.reshape(len(rows), wide // words, words), axis=1)

    def most(self, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The most that the sets of rows p and q, of sizes n, can share: what one has and the other has not costs a token each."""
        out = np.zeros(len(p), dtype=np.int64)
        pairs = np.stack([self._words[p], self._words[q]], axis=1)
        for a, b in np.unique(pairs, axis=0):
            at = np.flatnonzero((pairs[:, 0] == a) & (pairs[:, 1] == b))
            x, y = self._folded(p[at], a, min(a, b)), self._folded(q[at], b, min(a, b))
            out[at] = np.minimum(n[p[at]] - _count(x & ~y), n[q[at]] - _count(y & ~x))
        return out


# -- Arrow stages


DESCRIBED = "row long, doc_id long, n long, key_a long, key_b long, sig binary, bits binary, " + ", ".join(f"chunk_{r} long" for r in range(ROUNDS))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            tokens, bounds = shingle_sets(part.column("text"), WORDS)
            columns = [part.column("row"), part.column("doc_id"), pa.array(np.diff(bounds), pa.int64())]
            for seed in (1, 2):
                each = np.concatenate(([0], np.cumsum(mix(tokens ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), dtype=np.uint64))).astype(np.uint64)
                columns.append(_longs(each[bounds[1:]] - each[bounds[:-1]]))
            sig = signatures(tokens, bounds)
            columns.append(pa.array([s.tobytes() for s in sig], pa.binary()))
            columns.append(_blobs(*bitmaps(tokens, bounds)))
            columns += [_longs(_folded(sig.reshape(len(sig), CHUNKS, WIDTH)[:, r], 0)) for r in range(ROUNDS)]
            yield pa.record_batch(columns, names=["row", "doc_id", "n", "key_a", "key_b", "sig", "bits", *(f"chunk_{r}" for r in range(ROUNDS))])


def _signed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(_raw(column)[0].tobytes(), dtype=np.uint16).reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key of every node."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            keys = chunk_keys(_signed(part.column("sig")))
            each = np.repeat(np.arange(part.num_rows), keys.shape[1])
            which = np.tile(np.arange(keys.shape[1]), part.num_rows)
            columns = [_longs(keys.ravel()), pa.array(which, pa.int32()), part.column("node").take(pa.array(each)), part.column("comp").take(pa.array(each))]
            yield pa.record_batch(columns, names=["token", "which", "node", "comp"])


class Connected:
    """Which rows of a task are in one component, given that and what was linked since."""

    def __init__(self, comp: np.ndarray):
        self._root = np.unique(comp, return_inverse=True)[1].tolist()
        self._parent = list(range(len(self._root)))

    def _find(self, row: int) -> int:
        x, parent = self._root[row], self._parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def apart(self, i: int, j: int) -> bool:
        return self._find(i) != self._find(j)

    def join(self, i: int, j: int) -> None:
        self._parent[self._find(i)] = self._find(j)


def connect(sets: list[np.ndarray], sig: np.ndarray, comp: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets that connect all components which links among these sets connect, nearest signatures first."""
    size = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    open_ = (comp[i] != comp[j]) & may_link(np.minimum(size[i], size[j]), size[i], size[j], percent)
    i, j = i[open_], j[open_]
    far = np.concatenate([(sig[i[k : k + PAIRS]] != sig[j[k : k + PAIRS]]).sum(axis=1) for k in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])
    near = np.flatnonzero(far <= THRESHOLD)
    near = near[np.argsort(far[near], kind="stable")]
    found, links = Connected(comp), []
    for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
        if found.apart(a, b) and linked(sets[a], sets[b], percent):
            found.join(a, b)
            links.append((a, b))
    return links


def _chunk_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole_buckets(batches, ["token", "block"]):
        node, comp, sig = np.asarray(t.column("node")), np.asarray(t.column("comp")), _signed(t.column("sig"))
        tokens, bounds = _sets(t.column("tokens"))
        out = []
        for low, high in zip(*_edges(t, ["token", "block"]), strict=True):
            if comp[low:high].min() < comp[low:high].max():
                found = connect([tokens[bounds[k] : bounds[k + 1]] for k in range(low, high)], sig[low:high], comp[low:high])
                out += [sorted((node[low + a], node[low + b])) for a, b in found]
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


BUCKETS = ["token", "low", "high"]


def _near(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket and different components within the distance and with room for a link, each in the first bucket that it shares."""
    begin, end = _edges(t, BUCKETS)
    n, comp, which, block, low, high = (np.asarray(t.column(c), dtype=np.int64) for c in ("n", "comp", "which", "block", "low", "high"))
    sig, bits = _signed(t.column("sig")), Bitmaps(*_sets(t.column("bits")))
    # How many rows of its bucket stand behind each row.
    behind = np.repeat(end, end - begin) - 1 - np.arange(len(n))
    i, d = np.flatnonzero(behind >= 1), 1
    while len(i):
        ok = (comp[i] != comp[i + d]) & ((low[i] == high[i]) | (block[i] != block[i + d]))
        p = i[ok]
        p = p[may_link(np.minimum(n[p], n[p + d]), n[p], n[p + d], PERCENT)]
        for k in range(0, len(p), PAIRS):
            a, b = p[k : k + PAIRS], p[k : k + PAIRS] + d
            far, first = first_key(sig[a], sig[b])
            met = (far <= THRESHOLD) & (first == which[a])
            a, b = a[met], b[met]
            room = may_link(bits.most(n, a, b), n[a], n[b], PERCENT)
            if room.any():
                yield a[room], b[room]
        d += 1
        i = i[behind[i] >= d]


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a bucket that are near another one."""
    for t in _whole_buckets(batches, BUCKETS):
        near = np.zeros(t.num_rows, dtype=bool)
        for a, b in _near(t):
            near[a] = near[b] = True
        yield from t.filter(pa.array(near)).to_batches()


def _near_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of near rows, on whole sets, until what links is connected."""
    for t in _whole_buckets(batches, BUCKETS):
        node, comp = np.asarray(t.column("node")), np.asarray(t.column("comp"))
        tokens, bounds = _sets(t.column("tokens"))
        found = Connected(comp)
        out = []
        for a, b in _near(t):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if found.apart(i, j) and linked(tokens[bounds[i] : bounds[i + 1]], tokens[bounds[j] : bounds[j + 1]], PERCENT):
                    found.join(i, j)
                    out.append(sorted((node[i], node[j])))
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


# -- Spark jobs


def _met(heads: DataFrame) -> DataFrame:
    """Nodes that share one of the first chunks with another node."""
    found = None
    for r in range(ROUNDS):
        token = F.col(f"chunk_{r}")
        several = heads.groupBy(token.alias("token")).count().where("count > 1").select("token")
        some = heads.select("node", token.alias("token")).join(several, "token", "left_semi").select("node")
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def _equal_chunk_links(heads: DataFrame, sets: DataFrame, labels: DataFrame | None, r: int, scratch: Scratch) -> DataFrame:
    """Links among nodes whose chunk ``r`` is equal; a component that stands in a bucket with many nodes sends some."""
    each = _with_comp(heads.select("node", F.col(f"chunk_{r}").alias("token")), labels)
    by_comp = each.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("own"))
    mixed = by_comp.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum(F.least("own", F.lit(SENT))).alias("members")).where("comps > 1")
    mixed = _slim(scratch.write(mixed, "mixed"))
    sent = by_comp.join(mixed, "token").select("token", "comp", "own", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    dealt = lambda k: F.pmod(F.xxhash64("node", F.lit(r), F.lit(k)), F.lit(1 << 20))
    chosen = each.join(sent, ["token", "comp"]).where(dealt(0) * F.col("own") < F.lit(SENT << 20))
    chosen = scratch.write(chosen.select("node", "token", "comp", F.pmod(dealt(1), "blocks").alias("block")), "chosen")
    rows = sets.join(heads.select("node", "sig"), "node").join(_slim(chosen), "node").select("token", "block", "node", "comp", "sig", "tokens")
    return rows.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(_chunk_links, "a long, b long")


def _bucket_rows(heads: DataFrame, described: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Rows of the buckets in which several components meet; large ones are dealt to pairs of blocks.

    The nodes of a large bucket's largest component stand in blocks of their own, which do not meet
    each other.
    """
    known = scratch.write(_with_comp(heads.select("node", "n", "sig"), labels), "known")
    each = known.select("node", "comp", "sig").mapInArrow(_keys, "token long, which int, node long, comp long")
    # Counted map-side first, so that a key of very many nodes is no one task's work.
    mixed = each.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("members")).where("least <> most")
    mixed = _slim(scratch.write(mixed.select("token", "members"), "mixed"))
    shared = scratch.write(each.join(mixed, "token"), "shared")

    zero = F.lit(0).cast("long")
    small = shared.where(F.col("members") <= BLOCK).withColumns({"low": zero, "high": zero, "block": zero})
    wide = shared.where(F.col("members") > BLOCK)
    top = wide.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("own")).groupBy("token").agg(F.max_by("comp", "own").alias("top"), F.max("own").alias("own"))
    top = _slim(scratch.write(top, "top"))
    blocks = {"tops": F.ceil(F.col("own") / BLOCK), "rest": F.ceil((F.col("members") - F.col("own")) / BLOCK)}
    large = wide.join(top, "token").withColumns(blocks).withColumn("is_top", F.col("comp") == F.col("top"))
    # Blocks below ``rest`` hold the other components.
    dealt = F.xxhash64("node", "token")
    large = large.withColumn("block", F.when(F.col("is_top"), F.col("rest") + F.pmod(dealt, "tops")).otherwise(F.pmod(dealt, "rest")))
    last = F.when(F.col("is_top"), F.col("rest")).otherwise(F.col("rest") + F.col("tops"))
    large = large.withColumn("other", F.explode(F.sequence(zero, last - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    columns = ["token", "which", "node", "comp", "low", "high", "block"]
    rows = small.select(columns).unionByName(large.select(columns))
    nodes = _slim(scratch.write(shared.select("node").distinct(), "nodes"))
    held = described.select(F.col("row").alias("node"), "n", "sig", "bits").join(nodes, "node", "left_semi")
    return rows.join(scratch.write(held, "held"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept of every row.

    Sets hold the distinct 3-word shingles of the text with A-Z lower-cased; a text of fewer words is
    one shingle; a null, empty or blank text has none, links with nothing and is its own component.
    Rows with equal sets belong together. ``kept`` says that doc_id is component_id, so rows that
    repeat the id of a kept row in its component are kept too. Null ids are the largest; a component of null
    ids only has a null id, and they are kept. An empty table gives an empty result; other columns are not read.

    Links that are found are exact. A pair whose similarity is just the threshold has signatures
    beyond the distance with probability ``missed()``, one of greater similarity more rarely.

    With ``row_col``, a unique number of each row, there are two more columns: ``row``, that number,
    and ``stays``, true for one row of each component. ``rounds`` (at most ROUNDS) over equal chunks
    come before all keys are looked at; any number gives the same result.
    """
    scratch = Scratch(docs.sparkSession)
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows if row_col else scratch.write(rows, "numbered")
    described = scratch.write(rows.mapInArrow(_describe, DESCRIBED), "described")
    held = ["sig", *(f"chunk_{r}" for r in range(ROUNDS))]
    # Equal sets are one: the row with the smallest number stands for them.
    heads = described.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("row").alias("node"), *(F.first(c).alias(c) for c in held))
    heads = scratch.write(heads, "heads")
    texts = rows.select(F.col("row").alias("node"), "text")

    labels = None
    if rounds:
        sets = _whole_sets(texts, _met(heads), scratch, WORDS)
        for r in range(rounds):
            links = scratch.write(_equal_chunk_links(heads, sets, labels, r, scratch), "links")
            labels = _connected(labels, links, scratch)
        scratch.drop(sets)

    together = lambda rows: rows.repartition(*BUCKETS).sortWithinPartitions(*BUCKETS)
    rows = together(_bucket_rows(heads, described, labels, scratch))
    near = scratch.write(rows.mapInArrow(_near_rows, rows.schema), "near")
    sets = _whole_sets(texts, near.select("node").distinct(), scratch, WORDS)
    links = scratch.write(together(near.join(sets, "node")).mapInArrow(_near_links, "a long, b long"), "links")
    labels = _connected(labels, links, scratch)
    out = grouped_rows(described, heads, labels, scratch).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    if row_col is None:
        out = out.drop("row", "stays")
    return scratch.finish(out, "groups")


def op11_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g
  FROM d
),
n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS token FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT r.doc_id, n.n AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept FROM reach r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n
"""
