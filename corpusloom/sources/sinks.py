"""Sinks: ordered JSON lines, partitioned tables, shard files and one-row evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, order: str) -> None:
    """JSON lines in the order of a column; ranges are sorted side by side and files follow the order."""
    fields = sorted(df.columns)
    df.repartitionByRange(order).sortWithinPartitions(order).select(*fields).write.mode("overwrite").json(path)


def learning_tables(tokens: DataFrame, exposures: DataFrame, path: str, decimals: int = 6) -> None:
    """Token and exposure tables by branch, doubles rounded half to even."""
    for name, df in (("tokens", tokens), ("exposures", exposures)):
        rounded = [F.bround(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        df.select(*rounded).write.mode("overwrite").partitionBy("branch_id").parquet(f"{path}/{name}")


def shard_files(shards: DataFrame, path: str) -> None:
    """Manifests as JSON, and token arrays as little-endian unsigned 32-bit blobs, both by shard."""
    from corpusloom.functions.hashing import le_uint32

    shards.drop("tokens").write.mode("overwrite").partitionBy("shard_id").json(f"{path}/manifests")
    shards.select("shard_id", le_uint32("tokens").alias("blob")).write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/tokens")


def evidence(df: DataFrame, path: str) -> None:
    """Requirement rows as JSON lines beside a Markdown table, both written by Spark."""
    df.write.mode("overwrite").json(f"{path}/json")
    line = F.concat(F.lit("| "), F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), " | "), F.lit(" |"))
    df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/markdown")
