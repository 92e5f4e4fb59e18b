"""Order-dependent duplicate resolution over a table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.similarity import small
from corpusloom.sources.store import materialize


def resolve_in_order(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, original): each node in id order is a duplicate when an earlier neighbour is an original.

    A duplicate never becomes an original, so this is not connected components. Each round settles
    the nodes whose earlier neighbours are all settled or among them an original; ``original`` is
    the smallest such neighbour, or null for originals. ``pairs`` has (a, b) with a < b.
    """
    # Nodes without a pair are originals; only the others have a state.
    ends = F.array(*(F.struct(F.col(x).alias("id"), F.lit(x == "b").alias("later")) for x in "ab"))
    state = pairs.select(F.explode(ends).alias("end")).groupBy("end.id").agg(F.bool_or("end.later").alias("later"))
    state = materialize(state.select("id", F.when(~F.col("later"), F.lit(True)).alias("is_original")), "state")
    left = pairs
    while True:
        before = small(state.withColumnsRenamed({"id": "a", "is_original": "before"}), "9")
        earlier = left.join(before, "a").groupBy("b").agg(
            F.coalesce(F.bool_or("before"), F.lit(False)).alias("any_original"), F.count_if(F.col("before").isNull()).alias("unsettled")
        )
        moved = state.join(earlier.withColumnRenamed("b", "id"), "id", "left").select(
            "id",
            F.when(F.col("is_original").isNotNull(), F.col("is_original"))
            .when(F.col("any_original"), F.lit(False))
            .when(F.coalesce("unsettled", F.lit(0)) == 0, F.lit(True))
            .alias("is_original"),
        )
        state = materialize(moved, "state")
        unsettled = state.where("is_original is null").select(F.col("id").alias("b"))
        if not unsettled.limit(1).count():
            break
        # Only pairs whose later node is open are looked at again.
        left = materialize(left.join(small(unsettled, "8"), "b", "left_semi"), "pairs")
    originals = small(state.where("is_original").select(F.col("id").alias("a")), "8")
    duplicates = small(state.where("not is_original").select(F.col("id").alias("b")), "8")
    first = pairs.join(originals, "a", "left_semi").join(duplicates, "b", "left_semi").groupBy("b").agg(F.min("a").alias("original"))
    return nodes.select("id").join(first.withColumnRenamed("b", "id"), "id", "left")
