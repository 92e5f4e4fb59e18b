"""Products of two tables of vectors on a grid of blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a row of the grid and of a column of it.
ROWS, COLUMNS = 1 << 15, 1 << 13


def best_products(vectors: DataFrame, vocabulary: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """vec_id, token and score: for each vector the entry with the largest inner product (rounded to six places), ties to the smaller token.

    Both tables, with vec_id and embedding, are dealt to stripes whose number grows with the table;
    a vector goes to each cell of its row of the grid, an entry to each cell of its column. A cell
    keeps one row for each of its vectors, and the best of a vector's cells is found map-side first.
    Neither side is sent to all tasks, whatever its size. Vectors are compared with entries of their
    own length; one without such an entry, or without components, has no row. Repeated ids are separate vectors.
    """
    clean = lambda t: t.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("vec_id", "embedding")
    vectors, vocabulary = clean(vectors), clean(vocabulary)
    high, wide = max(1, ceil(vectors.count() / rows)), max(1, ceil(vocabulary.count() / columns))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.withColumn("place", F.monotonically_increasing_id()).withColumn("row", deal(high)).withColumn("column", every(wide))
    right = vocabulary.withColumn("column", deal(wide)).withColumn("row", every(high))

    def best(own: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths, others = own["embedding"].map(len).to_numpy(), entries["embedding"].map(len).to_numpy()
        for n in np.intersect1d(lengths, others):
            mine, theirs = own[lengths == n], entries[others == n].sort_values("vec_id")
            x, y = (np.array(t["embedding"].tolist(), dtype=np.float64) for t in (mine, theirs))
            ids = theirs["vec_id"].to_numpy()
            for k in range(0, len(x), 1024):
                score = np.round(x[k : k + 1024] @ y.T, 6)
                at = score.argmax(axis=1)
                out.append(pd.DataFrame({"place": mine["place"].iloc[k : k + 1024], "vec_id": mine["vec_id"].iloc[k : k + 1024], "token": ids[at], "score": score[np.arange(len(at)), at]}))
        return pd.concat(out) if out else pd.DataFrame({"place": [], "vec_id": [], "token": [], "score": []})

    cells = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInPandas(best, "place long, vec_id long, token long, score double")
    first = F.min(F.struct((-F.col("score")).alias("less"), "token")).alias("b")
    return cells.groupBy("place", "vec_id").agg(first).select("vec_id", "b.token", (-F.col("b.less")).alias("score"))
