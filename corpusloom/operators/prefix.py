"""Order-dependent sums and ranks in two levels, so that a key with very many rows is no single task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of an integer order that make one chunk.
CHUNK = 4096


def running_sums(df: DataFrame, key: str, order: list[str | Column], values: dict[str, Column], chunk: Column | None = None) -> DataFrame:
    """``df`` plus, for each name in ``values``, the sum over the rows of its key up to and with this one.

    ``order`` has no ties in a key; ``chunk`` ascends with it, and without one it is CHUNK values of
    the first column. A chunk is summed on its own; the chunks' totals, one slim row for some
    thousand rows, are summed over the key and give each chunk its start.
    """
    part = F.floor(F.col(order[0]) / CHUNK) if chunk is None else chunk
    inner = Window.partitionBy(key, "chunk_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumns({"chunk_no": part, **{f"{n}_value": v.cast("long") for n, v in values.items()}})
    before = Window.partitionBy(key).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy(key, "chunk_no").agg(*(F.sum(f"{n}_value").alias(f"{n}_total") for n in values))
    starts = totals.select(key, "chunk_no", *(F.coalesce(F.sum(f"{n}_total").over(before), F.lit(0)).alias(f"{n}_start") for n in values))
    summed = numbered.withColumns({n: F.sum(f"{n}_value").over(inner) for n in values}).join(starts, [key, "chunk_no"])
    summed = summed.withColumns({n: F.col(n) + F.col(f"{n}_start") for n in values})
    return summed.drop("chunk_no", *(f"{n}_value" for n in values), *(f"{n}_start" for n in values))


def row_numbers(df: DataFrame, key: str, order: list[str | Column], out: str, chunk: Column | None = None) -> DataFrame:
    """``df`` plus each row's place in its key, from one."""
    return running_sums(df, key, order, {out: F.lit(1)}, chunk)


def fold_by_key(df: DataFrame, key: str, order: str, start, step, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows of a sequential fold over each key in order: ``step(state, row)`` gives the next state and an output row.

    A key's rows pass through one task one after the other, and nothing but the state is held.
    """
    import pandas as pd

    names = [f.split()[0] for f in schema.split(", ")]

    def apply(frames):  # noqa: ANN001, ANN202
        current, state = None, None
        for f in frames:
            rows = []
            for row in f.itertuples(index=False):
                if current is None or getattr(row, key) != current:
                    current, state = getattr(row, key), start
                state, out = step(state, row)
                rows.append(out)
            yield pd.DataFrame(rows, columns=names)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(apply, schema)
