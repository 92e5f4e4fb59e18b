"""An append-only, hash-chained event log whose offsets and heads live in stream state, with checkpoints that bind state to log.

Each key (a branch) has one chain. Its state holds the hash of the last entry, the next offset and
the place of the last event that was entered, so offsets go on over micro-batches, and an event that
comes again is known by its place and changes nothing. A branch's events must come in the order of
their time, as a log keyed by branch gives them; within a batch they may stand in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions.hashing import GENESIS

STATE = "head string, next_offset long, last_us long, last_id long"
ENTRIES = "branch long, step long, event_id long, us long, payload string, prev_hash string, entry_hash string"
#: Columns of a saved state, one row for each branch.
SAVED = f"branch long, {STATE}"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Refused(ValueError):
    """A checkpoint that does not fit the log it is to go on with."""


class Chain(StatefulProcessor):
    """Enters the events of a branch behind its last entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._chain = handle.getValueState("chain", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        # A branch has few events in a batch: rows cost less than a frame for each branch.
        stored = self._chain.get()
        head, offset, *last = stored or (GENESIS, 0, None, None)
        last = None if last[0] is None else tuple(last)
        begun = offset
        for us, ident, payload in sorted((r["us"], r["event_id"], r["payload"]) for r in rows):
            if last is not None and (us, ident) <= last:
                continue
            entry = hashlib.sha256((payload + head).encode()).hexdigest()
            yield Row(branch=key[0], step=offset, event_id=ident, us=us, payload=payload, prev_hash=head, entry_hash=entry)
            head, offset, last = entry, offset + 1, (us, ident)
        if offset > begun:
            self._chain.update((head, offset, *last))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: ANN001, N802, N803
        self._chain.update((initialState["head"], initialState["next_offset"], initialState["last_us"], initialState["last_id"]))

    def close(self) -> None:
        pass


def entries(events: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Ledger entries of a stream with branch, event_id, us and payload, from nothing or from a saved state.

    Rows without a branch, place or payload cannot be chained and are left out.
    """
    fit = events.select("branch", "event_id", "us", "payload").dropna()
    start = saved.select("branch", "head", "next_offset", "last_us", "last_id").groupBy("branch") if saved is not None else None
    return fit.groupBy("branch").transformWithState(Chain(), ENTRIES, "Append", "None", start)


@contextmanager
def rocks(spark: SparkSession):  # noqa: ANN201
    """The state store that keeps named state, for queries started within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(spark: SparkSession, stream: DataFrame, folder: str) -> None:
    """Process what is there and stop. ``folder`` gets the log, a row for each batch (commits), and the stream's own checkpoint.

    A batch has a folder of its own, so one that is written again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
        commit = batch.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("branch").alias("branches"), F.sum(F.conv(F.substring("entry_hash", 1, 8), 16, 10).cast("long")).alias("digest"))
        commit.write.mode("overwrite").parquet(f"{folder}/commits/batch={batch_id}")
        batch.unpersist()

    with rocks(spark):
        query = stream.writeStream.option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()


def log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{ENTRIES}, batch long").parquet(f"{folder}/log")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("entries long, branches long, digest long, batch long").parquet(f"{folder}/commits")


# -- checkpoints


def sealed(state: DataFrame) -> DataFrame:
    """A seal over a saved state: rows, entries and a sum of hashes that any changed row changes."""
    row = F.sha2(F.concat_ws("|", "branch", "head", "next_offset", "last_us", "last_id"), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return state.agg(F.count(F.lit(1)).alias("branches"), F.coalesce(F.sum("next_offset"), F.lit(0)).alias("entries"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("seal"))


def save(spark: SparkSession, folder: str, target: str) -> None:
    """Read the state of a stopped stream out of its store and keep it beside its seal."""
    stored = spark.read.format("statestore").option("stateVarName", "chain").load(f"{folder}/stream")
    state = stored.select(F.col("key.branch").alias("branch"), *(F.col(f"value.{f.split()[0]}") for f in STATE.split(", ")))
    state.write.parquet(f"{target}/state")
    sealed(spark.read.schema(SAVED).parquet(f"{target}/state")).write.parquet(f"{target}/seal")


def faults(state: DataFrame, entered: DataFrame) -> DataFrame:
    """Branches whose saved state does not stand at the end of the log: where the state is, where the log is, and why it is refused."""
    w = F.struct("step", "entry_hash", "us", "event_id")
    ends = entered.groupBy("branch").agg(F.max(w).alias("end"), F.count(F.lit(1)).alias("n"))
    both = state.join(ends, "branch", "full_outer")
    why = (
        F.when(F.col("next_offset").isNull(), "no_state")
        .when(F.col("n").isNull(), "no_log")
        .when(F.col("n") != F.col("end.step") + 1, "log_has_gaps")
        .when(F.col("end.step") + 1 != F.col("next_offset"), "offset_differs")
        .when((F.col("end.entry_hash") != F.col("head")) | (F.col("end.us") != F.col("last_us")) | (F.col("end.event_id") != F.col("last_id")), "head_differs")
    )
    return both.select("branch", F.col("next_offset").alias("state_offset"), (F.col("end.step") + 1).alias("log_offset"), why.alias("reason")).where("reason is not null")


def restore(spark: SparkSession, target: str, entered: DataFrame) -> DataFrame:
    """A saved state that fits its seal and the log; any other is refused before anything goes on from it."""
    state = spark.read.schema(SAVED).parquet(f"{target}/state")
    kept, found = spark.read.parquet(f"{target}/seal").first(), sealed(state).first()
    if kept != found:
        raise Refused(f"the state is not what was sealed: {found} instead of {kept}")
    bad = faults(state, entered).limit(5).collect()
    if bad:
        raise Refused(f"state and log do not fit: {bad}")
    return state


def broken(entered: DataFrame) -> DataFrame:
    """branch, entries and the first offset that does not follow from the one before, for every branch."""
    w = Window.partitionBy("branch").orderBy("step")
    off = (F.col("step") != F.coalesce(F.lag("step").over(w) + 1, F.lit(0))) | (F.col("prev_hash") != F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS)))
    off |= F.col("entry_hash") != F.sha2(F.concat("payload", "prev_hash"), 256)
    return entered.withColumn("off", off).groupBy("branch").agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("off"), F.col("step"))).alias("first_break"))
