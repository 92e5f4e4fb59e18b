"""Lloyd's clustering of integer vectors with annulus search.

Centroids stand sorted by their norm. A vector's upper bound is its exact distance from one centroid:
that of its home, which is the nearest one at the start, or at the start itself the one of the most
similar norm. By the triangle inequality no centroid whose norm differs from the vector's by more can
be nearer, or as near. The others, an annulus, are a stretch of the sorted norms that two binary
searches find; only these are compared, exactly and in integers, with ties to the smaller number.

A round is one pass over the vectors. Each task sends one row of sums for each centroid; what the
driver gets is one row of sums for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import materialize

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Vectors that are compared at once.
PACK = 4096
#: Components beyond this (after scaling) take no part, so that sums of squares of DIM differences fit in 64 bits.
LARGEST = 1 << 27


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v = floor(scale * x) of the vectors with ``dim`` components, none null, non-finite or too large."""
    x = F.col(vector_col)
    exact = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LARGEST))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & fits).select(F.col(id_col).cast("long").alias("vec_id"), exact.alias("v"))


class Annuli:
    """Centroids sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, dtype=np.int64)
        norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.lexsort((np.arange(len(norms)), norms))
        self.norms = norms[self.order]

    def nearest(self, v: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each vector, its squared distance, and how many distances were computed."""
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        if home is None:
            after = np.searchsorted(self.norms, norm).clip(max=len(self.norms) - 1)
            before = np.maximum(after - 1, 0)
            home = self.order[np.where(norm - self.norms[before] < self.norms[after] - norm, before, after)]
        best, least = home.copy(), self._distance(v, self.centroids[home])
        # Widened by far more than rounding can amount to, so that a centroid on the edge stays in.
        reach = np.sqrt(least.astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + norm)
        low = np.searchsorted(self.norms, norm - reach, side="left")
        high = np.searchsorted(self.norms, norm + reach, side="right")
        compared = len(v)
        for place, number in enumerate(self.order.tolist()):
            rows = np.flatnonzero((low <= place) & (place < high) & (home != number))
            if not len(rows):
                continue
            compared += len(rows)
            away = self._distance(v[rows], self.centroids[number])
            nearer = (away < least[rows]) | ((away == least[rows]) & (number < best[rows]))
            rows = rows[nearer]
            best[rows], least[rows] = number, away[nearer]
        return best, least, compared

    @staticmethod
    def _distance(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        diff = v - c
        return np.einsum("ij,ij->i", diff, diff)


def _packs(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, PACK):
            part = batch.slice(k, PACK)
            yield part, np.asarray(part.column("v").flatten(), dtype=np.int64).reshape(-1, dim)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    annuli = Annuli(centroids)
    for part, v in _packs(batches, dim):
        home = np.asarray(part.column("home"), dtype=np.int64) if "home" in part.schema.names else None
        best, least, _ = annuli.nearest(v, home)
        yield pa.record_batch([part.column("vec_id"), part.column("v"), pa.array(best, pa.int64()), pa.array(least, pa.int64())], names=["vec_id", "v", "cluster", "distance"])


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """One row for each centroid that a task's vectors are nearest to: how many, and the sum of each component."""
    annuli = Annuli(centroids)
    n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
    for part, v in _packs(batches, dim):
        best, _, _ = annuli.nearest(v, np.asarray(part.column("home"), dtype=np.int64))
        n += np.bincount(best, minlength=len(n))
        order = np.argsort(best, kind="stable")
        at = np.flatnonzero(np.diff(best[order], prepend=-1))
        total[best[order][at]] += np.add.reduceat(v[order], at, axis=0)
    some = np.flatnonzero(n)
    yield pa.record_batch([pa.array(some, pa.int64()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])


def initial(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; rows that repeat an id stand in the order of their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("key")
    first = vectors.where("vec_id is not null").select(key, "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Centroids after one round; one without vectors stays where it is."""
    tasks = vectors.select("v", "home").mapInArrow(lambda b: _sums(b, centroids, dim), "cluster long, n long, total array<bigint>")
    parts = tasks.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)))
    out = centroids.copy()
    for r in parts.collect():
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    return out


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every vector that takes part, and the final centroids.

    Vectors that are null, of another length, or hold null, non-finite or huge components (LARGEST
    after scaling) take no part. Repeated rows count as often as they come. A row without an id is
    clustered, but starts no centroid. With fewer vectors than clusters there are fewer centroids;
    without vectors (with ids) the result is empty. Sums are 64-bit and exact for up to 2^36 vectors;
    ``dim`` is at most DIM. Other columns are not read.
    """
    if not 1 <= dim <= DIM:
        raise ValueError(f"vectors have 1 to {DIM} components")
    clean = quantised(vectors, dim, scale, id_col, vector_col)
    centroids = initial(clean, clusters, seed)
    schema = "vec_id long, v array<bigint>, cluster long, distance long"
    if not len(centroids):
        return clean.where("false").selectExpr("vec_id", "v", "cast(0 as long) as cluster", "cast(0 as long) as distance"), centroids
    start = centroids
    homes = materialize(clean.mapInArrow(lambda b: _assign(b, start, dim), schema).select("vec_id", "v", F.col("cluster").alias("home")), "vectors")
    for _ in range(rounds):
        before = centroids
        centroids = moved(homes, centroids, dim)
        if (before == centroids).all():  # further rounds would give the same
            break
    final = centroids
    return homes.mapInArrow(lambda b: _assign(b, final, dim), schema), final


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = materialize(assigned.select("vec_id", "cluster", "distance"), "assigned")
    names = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    named = spark.createDataFrame(names, "cluster long, centroid_sha256 string")
    # One row for each centroid.
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(named), "cluster")
    total = assigned.agg(F.sum("distance").alias("inertia"))
    per_cluster = F.broadcast(sums.crossJoin(F.broadcast(total)))
    return assigned.join(per_cluster, "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The rounds written out one after the other over a row for each component."""
    steps = []
    for t in range(rounds + 1):
        steps.append(
            f"far{t} AS (SELECT x.vec_id, c.c, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM x JOIN c{t} c ON c.i = x.i GROUP BY ALL), "
            f"a{t} AS MATERIALIZED (SELECT vec_id, c, d FROM far{t} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"
        )
        if t < rounds:
            steps.append(
                f"m{t} AS (SELECT a.c, x.i, sum(x.x) AS s, count(*) AS n FROM a{t} a JOIN x ON x.vec_id = a.vec_id GROUP BY ALL), "
                f"c{t + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x FROM c{t} c LEFT JOIN m{t} m ON m.c = c.c AND m.i = c.i)"
            )
    chain = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
x AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM kept),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT f.c, x.i, x.x FROM first f JOIN x USING (vec_id) WHERE f.c < {clusters}),
{chain},
names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN names USING (c)
"""


OP13_SQL = _sql()
