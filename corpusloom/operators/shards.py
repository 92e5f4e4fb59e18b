"""Building shards of bounded size from ordered documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "lane string, shard_no long, id long, start long, stop long"


def _passage(lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Fill and number of flushes after a run of documents, for each fill (0 to budget) before it.

    Fills that have met stay together, and all meet soon, since a flush forgets what was before.
    """
    fills, which = np.arange(budget + 1), np.arange(budget + 1)
    flushes = np.zeros(budget + 1, dtype=np.int64)
    for n in lengths.tolist():
        full = (fills > 0) & (fills + n > budget)
        flushes += full[which]
        fills = np.where(full, 0, fills) + n
        if len(fills) > 1:
            # A document longer than the budget makes a fill beyond it, which the next one flushes.
            fills, back = np.unique(fills, return_inverse=True)
            which = back[which]
    return fills[which], flushes


def _passages(groups: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    for pdf in groups:
        if len(pdf):
            for (lane, chunk), own in pdf.groupby(["lane", "chunk"], sort=False):
                fill, flushes = _passage(own["lengths"].iloc[0], budget)
                yield pd.DataFrame({"lane": [lane], "chunk": [chunk], "fill": [np.minimum(fill, budget + 1).tolist()], "flushes": [flushes.tolist()]})


def _composed(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Fill and number of the open shard before each chunk of one lane."""
    fill, shard, rows = 0, 0, []
    for lane, chunk, after, flushes in pdf.sort_values("chunk")[["lane", "chunk", "fill", "flushes"]].itertuples(index=False):
        rows.append((lane, chunk, fill, shard))
        # A fill beyond the budget flushes at the next document, like a full one.
        shard += flushes[min(fill, budget)]
        fill = after[min(fill, budget)]
    return pd.DataFrame(rows, columns=["lane", "chunk", "fill", "shard_no"])


def _spans(groups: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    for pdf in groups:
        rows = []
        for lane, ids, lengths, fill, shard in pdf[["lane", "ids", "lengths", "fill", "shard_no"]].itertuples(index=False):
            for ident, n in zip(ids, lengths, strict=True):
                if fill and fill + n > budget:
                    shard, fill = shard + 1, 0
                rows.append((lane, shard, ident, fill, fill + n))
                fill += n
        yield pd.DataFrame(rows, columns=["lane", "shard_no", "id", "start", "stop"])


def build(documents: DataFrame, budget: int, chunk: int = 4096) -> DataFrame:
    """Spans of documents (lane, id, length > 0) in shards: in the order of ids, a shard ends before the document that would overflow it.

    Where a shard starts depends on all documents before it, but only through the fill so far. Each
    chunk of ids is first run for every possible fill, the chunks of a lane are put together from
    those short tables, and each chunk is then run once more from its true start.
    """
    part = F.floor(F.col("id") / chunk).alias("chunk")
    lists = documents.groupBy("lane", part).agg(F.sort_array(F.collect_list(F.struct("id", "length"))).alias("d"))
    lists = lists.select("lane", "chunk", F.col("d.id").alias("ids"), F.col("d.length").alias("lengths"))
    passages = lists.select("lane", "chunk", "lengths").mapInPandas(lambda g: _passages(g, budget), "lane string, chunk long, fill array<long>, flushes array<long>")
    starts = passages.groupBy("lane").applyInPandas(lambda pdf: _composed(pdf, budget), "lane string, chunk long, fill long, shard_no long")
    return lists.join(starts, ["lane", "chunk"]).mapInPandas(lambda g: _spans(g, budget), SPANS)
