"""Exact top-k inner-product search with a pivot-distance index.

Each vector belongs to the nearest pivot of its length and, by its distance from it, to an annulus.
Annuli are cut into blocks of bounded size; one job serves all lengths. A block of queries first searches the annulus that promises most to
learn a score to beat, then only the annuli whose triangle-inequality bound can still reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._store import materialize

#: Vectors that the pivots of a length are chosen from (at most), pivots, annuli of a pivot, vectors and queries of a block.
SAMPLE, PIVOTS, RINGS, BLOCK, QUERY_BLOCK = 2048, 32, 16, 256, 256
#: Vectors of one length that are placed at once.
PACK = 1024
SCALE = 256

#: Components beyond this (after scaling) take no part, so that scores of vectors of up to 2048 components fit in 64 bits.
LARGEST = 1 << 26
#: Bytes of pivots or directories that are sent to all tasks, at most; more are joined by shuffle.
SENT_BYTES = 64 << 20

#: Below every score.
NO_SCORE = -(1 << 63)

RESULT = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors that take part: id and components not null, components finite and not beyond LARGEST, at least one."""
    x = F.col(vector_col)
    fit = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0)
    fit &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LARGEST))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal from the vector nearest the mean."""
    chosen = [int(np.argmin(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _pivots(frame: pd.DataFrame, block: int) -> pd.DataFrame:
    """The pivots of one length and the width of their annuli, from a sample; a length that fits in a block has one annulus."""
    frame = frame.sort_values(["place", "row"])[:SAMPLE]
    x = np.array(frame["v"].tolist(), dtype=np.float64)
    many = frame["n"].iloc[0] > block
    pivots = choose_pivots(x, PIVOTS if many else 1)
    spread = np.sqrt(np.min([((x - p) ** 2).sum(axis=1) for p in pivots], axis=0))
    width = max(float(spread.max()), 1.0) / (RINGS - 1) if many else np.inf
    return pd.DataFrame({"dim": frame["dim"].iloc[:1].to_numpy(), "pivots": [pivots.astype("<f8").tobytes()], "width": [width]})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one length and one batch together, so that each pack is joined with its pivots once."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            same = np.flatnonzero(dims == dim)
            for i in range(0, len(same), PACK):
                part = batch.take(pa.array(same[i : i + PACK]))
                held = [part.column("row"), part.column("vec_id"), part.column("v").flatten()]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in held]
                yield pa.record_batch([pa.array([dim], pa.int64()), *lists], names=["dim", "rows", "vec_ids", "flat"])


def _assign(batches: Iterator[pa.RecordBatch], rings: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            dim, width = batch.column("dim")[i].as_py(), batch.column("width")[i].as_py()
            pivots = np.frombuffer(batch.column("pivots")[i].as_py(), dtype="<f8").reshape(-1, dim)
            rows, vec_ids, flat = (batch.column(c)[i].values for c in ("rows", "vec_ids", "flat"))
            v = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
            far = np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            pivot = far.argmin(axis=1)
            dist = far[np.arange(len(v)), pivot]
            ring = np.minimum((dist / width).astype(np.int64), rings - 1)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * dim + 1, dim), pa.int32()), flat)
            dims = pa.array(np.full(len(v), dim), pa.int64())
            extra = [pa.array(pivot, pa.int64()), pa.array(ring, pa.int64()), pa.array(dist, pa.float64()), pa.array(np.sqrt((v * v).sum(axis=1)), pa.float64())]
            yield pa.record_batch([dims, rows, vec_ids, vectors, *extra], names=["dim", "row", "vec_id", "v", "pivot", "ring", "dist", "norm"])


def bounds(queries: np.ndarray, directory: dict) -> np.ndarray:
    """Upper bound of the inner product of each query with any vector of each annulus.

    With p the pivot and r the distance from it: q.x = q.p + q.(x - p) <= q.p + |q| r, and
    2 q.x = |q|^2 + |x|^2 - |q - x|^2 where |q - x| is at least the distance between |q - p| and
    the annulus. The smaller bound holds; a little is added for rounding.
    """
    q = queries.astype(np.float64)
    pivots, own = directory["pivots"], directory["pivot"]
    norm = np.sqrt((q * q).sum(axis=1))[:, None]
    # One distance and one product for each pivot, not for each of its annuli.
    away = np.stack([np.sqrt(((q - p) ** 2).sum(axis=1)) for p in pivots], axis=1)[:, own]
    gap = np.maximum(0, np.maximum(directory["low"] - away, away - directory["high"]))
    shell = (norm**2 + directory["norm"] ** 2 - gap**2) / 2
    cone = (q @ pivots.T)[:, own] + norm * directory["high"]
    best = np.minimum(np.minimum(shell, cone), norm * directory["norm"])
    return best + 1e-6 * (1 + np.abs(best))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles are exact while no sum can pass 2^53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def _route(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """For each block of queries and each annulus that its queries still have to search, one row with those queries."""
    for batch in batches:
        for row in batch.to_pylist():
            held = row["queries"]
            directory = {c: np.array([cell[c] for cell in row["cells"]]) for c in ("pivot", "ring", "low", "high", "norm")}
            directory["pivots"] = np.frombuffer(row["pivots"], dtype="<f8").reshape(-1, row["dim"])
            bound = bounds(np.array([h["v"] for h in held], dtype=np.int64), directory)
            home = bound.argmax(axis=1)
            if first:
                todo = home[:, None] == np.arange(bound.shape[1])
            else:
                beat = np.array([-np.inf if h["beat"] is None else h["beat"] for h in held])
                todo = (bound >= beat[:, None]) & (home[:, None] != np.arange(bound.shape[1]))
            for k in np.flatnonzero(todo.any(axis=0)):
                picked = [held[i] for i in np.flatnonzero(todo[:, k])]
                yield pa.record_batch(
                    [
                        pa.array([row["dim"]], pa.int64()),
                        pa.array([int(directory["pivot"][k])], pa.int64()),
                        pa.array([int(directory["ring"][k])], pa.int64()),
                        pa.array([[h["row"] for h in picked]], pa.list_(pa.int64())),
                        pa.array([[h["vec_id"] for h in picked]], pa.list_(pa.int64())),
                        pa.array([[NO_SCORE if h["beat"] is None else h["beat"] for h in picked]], pa.list_(pa.int64())),
                        pa.array([np.array([h["v"] for h in picked], dtype="<i8").tobytes()], pa.binary()),
                    ],
                    names=["dim", "pivot", "ring", "query_rows", "query_ids", "query_beats", "query_data"],
                )


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best vectors of a block for each query of a block that reach the query's score to beat; ties to the smaller id."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim = batch.column("dim")[i].as_py()
            rows, ids, beats = (np.asarray(batch.column(c)[i].as_py(), dtype=np.int64) for c in ("query_rows", "query_ids", "query_beats"))
            q = np.frombuffer(batch.column("query_data")[i].as_py(), dtype="<i8").reshape(-1, dim)
            vec_rows, vec_ids = (np.asarray(batch.column(c)[i].as_py(), dtype=np.int64) for c in ("rows", "vec_ids"))
            x = np.asarray(batch.column("flat")[i].values, dtype=np.int64).reshape(-1, dim)
            scores = _products(q, x)
            out: list[list] = [[], [], [], []]
            for j in range(len(q)):
                others = np.flatnonzero((vec_rows != rows[j]) & (scores[j] >= beats[j]))
                s = scores[j, others]
                if len(s) > k:
                    others = others[s >= np.partition(s, len(s) - k)[len(s) - k]]
                best = others[np.lexsort((vec_ids[others], -scores[j, others]))][:k]
                out[0] += [rows[j]] * len(best)
                out[1] += [ids[j]] * len(best)
                out[2] += vec_ids[best].tolist()
                out[3] += scores[j, best].tolist()
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["query_row", "query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sent(table: DataFrame, size: str) -> DataFrame:
    """A written table with a row for each length, sent to all tasks where the sum of ``size`` is under the bound."""
    return F.broadcast(table) if (table.agg(F.sum(F.expr(size))).first()[0] or 0) <= SENT_BYTES else table


def _placed(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every vector with its pivot and annulus, and the pivots of every length; ``vectors`` has row, vec_id, v and dim."""
    counts = materialize(vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # By a hash of the row, somewhat more than SAMPLE rows of a length, and all rows of a short one.
    place = F.shiftrightunsigned(F.xxhash64("row"), 1)
    drawn = vectors.join(_sent(counts, "16"), "dim").withColumn("place", place).where((F.col("n") <= 2 * SAMPLE) | (F.col("place") < 1.25 * SAMPLE * float(1 << 63) / F.col("n")))
    block = BLOCK
    pivots = materialize(
        drawn.select("dim", "n", "place", "row", "v").groupBy("dim").applyInPandas(lambda frame: _pivots(frame, block), "dim long, pivots binary, width double"), "pivots"
    )
    packs = vectors.select("dim", "row", "vec_id", "v").mapInArrow(_pack, "dim long, rows array<bigint>, vec_ids array<bigint>, flat array<bigint>")
    schema = "dim long, row long, vec_id long, v array<bigint>, pivot long, ring long, dist double, norm double"
    return materialize(packs.join(_sent(pivots, "octet_length(pivots)"), "dim").mapInArrow(lambda b: _assign(b, RINGS), schema), "placed"), pivots


def _search_all(vectors: DataFrame, is_query: str, k: int) -> DataFrame:
    """Search among the vectors of each length; ``vectors`` has row, vec_id, v and dim."""
    placed, pivots = _placed(vectors)
    annulus = ["dim", "pivot", "ring"]
    asks = F.count_if(F.expr(is_query)).alias("asked")
    rings = placed.groupBy(*annulus).agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm"), asks)
    rings = materialize(rings, "rings")
    # At most PIVOTS * RINGS cells for each length.
    cells = rings.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("pivot", "ring", "low", "high", "norm"))).alias("cells"), F.sum("asked").alias("asked"))
    directory = materialize(cells.where("asked > 0").join(pivots.drop("width"), "dim"), "directory")
    by_length = _sent(directory, "octet_length(pivots) + 40 * size(cells)")
    blocks = (
        placed.join(rings.select(*annulus, "n"), annulus)
        .withColumn("chunk", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / BLOCK).cast("long")))
        .groupBy(*annulus, "chunk")
        .agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("held"))
        .select(*annulus, F.col("held.row").alias("rows"), F.col("held.vec_id").alias("vec_ids"), F.flatten("held.v").alias("flat"))
    )
    queries = placed.where(is_query).join(by_length.select("dim", F.ceil(F.col("asked") / QUERY_BLOCK).cast("long").alias("n_blocks")), "dim")

    def run(asked: DataFrame, first: bool) -> DataFrame:
        query_blocks = (
            asked.groupBy("dim", F.pmod(F.xxhash64("row"), F.col("n_blocks")).alias("block"))
            .agg(F.collect_list(F.struct("row", "vec_id", "v", "beat")).alias("queries"))
            .join(by_length.select("dim", "cells", "pivots"), "dim")
            .select("dim", "queries", "cells", "pivots")
        )
        routed = query_blocks.mapInArrow(
            lambda b: _route(b, first), "dim long, pivot long, ring long, query_rows array<bigint>, query_ids array<bigint>, query_beats array<bigint>, query_data binary"
        )
        return routed.join(blocks, annulus).mapInArrow(lambda b: _search(b, k), RESULT)

    near = materialize(_best(run(queries.withColumn("beat", F.lit(None).cast("long")), True), k), "near")
    beat = near.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("beat"))
    far = run(queries.join(beat, "row", "left"), False)
    return _best(near.drop("rank").unionByName(far), k)


def exact_top_k(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row.

    ``is_query`` is a condition on vec_id. A row never finds itself; another row that repeats its id
    may be found. Rows whose id or vector is null, whose vector is empty or holds null, non-finite or
    huge components (LARGEST after scaling) take no part. Vectors are compared with those of their own length. Queries get all
    other rows where these are fewer than k; without queries or rows the result is empty.
    """
    clean = materialize(quantised(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v").cast("long")), "vectors")
    return _search_all(clean, is_query, k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


OP9_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
