"""Packing of units (shard, seq, id, length) into windows: closed forms where order allows, else one pass over a shard.

``seq`` is an integer that orders a shard's units without ties.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import row_numbers, running_sums

PIECES = "shard string, win long, id long, start long, length long, offset long"


def pad_only(units: DataFrame, ctx: int) -> DataFrame:
    """One unit per window, cut at the window."""
    placed = row_numbers(units, "shard", ["seq"], "place")
    zero = F.lit(0).cast("long")
    return placed.select("shard", (F.col("place") - 1).alias("win"), "id", zero.alias("start"), F.least("length", F.lit(ctx)).alias("length"), zero.alias("offset"))


def long_context(units: DataFrame, ctx: int) -> DataFrame:
    """A unit fills as many windows of its own as it needs."""
    n = F.ceil(F.col("length") / ctx)
    placed = running_sums(units.where("length > 0"), "shard", ["seq"], {"upto": n})
    cut = placed.select("shard", "id", "length", (F.col("upto") - n).alias("first"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(ctx).cast("long"))).alias("k", "start"))
    return cut.select("shard", (F.col("first") + F.col("k")).alias("win"), "id", "start", F.least(F.col("length") - F.col("start"), F.lit(ctx)).alias("length"), F.lit(0).cast("long").alias("offset"))


def concat_chop(units: DataFrame, ctx: int) -> DataFrame:
    """One stream per shard cut at every ``ctx``: a running offset says which windows a unit reaches."""
    placed = running_sums(units.where("length > 0"), "shard", ["seq"], {"end": F.col("length")}).withColumn("at", F.col("end") - F.col("length"))
    cut = placed.withColumn("win", F.explode(F.sequence(F.floor(F.col("at") / ctx), F.floor((F.col("end") - 1) / ctx))))
    low = F.greatest(F.col("at"), F.col("win") * ctx)
    return cut.select("shard", "win", "id", (low - F.col("at")).alias("start"), (F.least(F.col("end"), (F.col("win") + 1) * ctx) - low).alias("length"), (low - F.col("win") * ctx).alias("offset"))


class Bins:
    """Open windows of one shard; a window that nothing more fits in is forgotten."""

    def __init__(self, ctx: int, policy: str):
        self.ctx, self.policy, self.n = ctx, policy, 0
        self.filled: dict[int, list[int]] = {}  # by fill, the windows of that fill as a heap

    def open(self, fill: int) -> int:
        self.n += 1
        if fill < self.ctx:
            heapq.heappush(self.filled.setdefault(fill, []), self.n - 1)
        return self.n - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset of a piece: the first window with room, or by ``best_fit`` the fullest and then the first."""
        fits = [f for f in self.filled if f + size <= self.ctx]
        if not fits:
            return self.open(size), 0
        fill = max(fits) if self.policy == "best_fit" else min(fits, key=lambda f: self.filled[f][0])
        window = heapq.heappop(self.filled[fill])
        if not self.filled[fill]:
            del self.filled[fill]
        if fill + size < self.ctx:
            heapq.heappush(self.filled.setdefault(fill + size, []), window)
        return window, fill


def _binned(frames: Iterator[pd.DataFrame], ctx: int, policy: str) -> Iterator[pd.DataFrame]:
    current, bins = None, None
    for pdf in frames:
        rows = []
        for shard, ident, length in zip(pdf["shard"], pdf["id"], pdf["length"].tolist(), strict=True):
            if bins is None or shard != current:
                current, bins = shard, Bins(ctx, policy)
            if length > ctx and policy != "whole":
                for start in range(0, length, ctx):
                    size = min(ctx, length - start)
                    rows.append((shard, bins.open(size), ident, start, size, 0))
            elif length:
                window, offset = bins.place(min(length, ctx))
                rows.append((shard, window, ident, 0, min(length, ctx), offset))
        yield pd.DataFrame(rows, columns=["shard", "win", "id", "start", "length", "offset"])


def binned(units: DataFrame, ctx: int, policy: str) -> DataFrame:
    """First fit in arrival order (``greedy``), the tightest fit from the longest down (``best_fit``), or first fit of units cut at a window (``whole``).

    Each fit depends on all earlier ones of its shard, so a shard, however long, passes through one
    task; only the windows that still have room are held. Shards of bounded size come from
    ``operators.shards.build``.
    """
    order = [F.desc("length"), F.col("seq")] if policy == "best_fit" else [F.col("seq")]
    return units.repartition("shard").sortWithinPartitions("shard", *order).mapInPandas(lambda f: _binned(f, ctx, policy), PIECES)


def summary(pieces: DataFrame, ctx: int) -> DataFrame:
    """Windows, tokens, padding, use and split units of each shard."""
    per = pieces.groupBy("shard").agg(F.count_distinct("win").alias("windows"), F.sum("length").alias("tokens"))
    split = pieces.groupBy("shard", "id").agg(F.count_distinct("win").alias("n")).groupBy("shard").agg(F.count_if(F.col("n") > 1).alias("split_units"))
    return per.join(split, "shard").select(
        "shard", "windows", "tokens", (F.col("windows") * ctx - F.col("tokens")).alias("padding"), F.round(F.col("tokens") / (F.col("windows") * ctx), 4).alias("used"), "split_units"
    )
