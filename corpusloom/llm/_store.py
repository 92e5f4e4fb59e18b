"""Tables cut from their lineage: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, as in tests, a new local one of a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of an Arrow batch, after which the next row begins another one. Both Python and the JVM hold whole batches, in buffers
#: that double as they grow, and rows of whole texts would make batches of tens of MB.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches hold about 2 MB in what runs within."""
    key, most = BATCH_BYTES
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so a lost executor costs no recomputation.

    The files stay until the folder is cleared, since the returned table reads them.
    """
    return _write(df, name)[0]


class Scratch:
    """Intermediate tables of one job; they are removed when its result is written, or before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(_write(df, name))
        return self.held[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more; without a table, all."""
        gone = [(t, path) for t, path in self.held if not tables or any(t is x for x in tables)]
        self.held = [(t, path) for t, path in self.held if all(path != p for _, p in gone)]
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for _, path in gone:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """The result as a table of its own, which no longer needs the intermediate ones."""
        table = materialize(df, name)
        self.drop()
        return table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
