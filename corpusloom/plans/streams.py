"""The event table as a stream, processed to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.ledger import CHAIN_SQL, payload
from corpusloom.plans.registry import query
from corpusloom.sources.store import shared_dir
from corpusloom.sources.tables import table
from corpusloom.streaming import events as ev
from corpusloom.streaming import ledger as lg


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _complete(spark: SparkSession, sf_dir: str, name: str, plan) -> DataFrame:
    folder = _folder(spark, name)
    stream = ev.read_events(spark, f"{sf_dir}/events*.parquet")
    last = ev.run_once(plan(stream), f"{folder}/out", f"{folder}/state", "complete")
    if last is None:
        raise ValueError("there are no event files")
    return ev.of_batch(spark, f"{folder}/out", last)


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*)::BIGINT AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir, "tumbling", ev.tumbling).select(F.unix_seconds("start").alias("start_s"), "event_type", "n", "total")


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT - 3600 * k AS start_s, count(*)::BIGINT AS n FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir, "sliding", ev.sliding).select(F.unix_seconds("start").alias("start_s"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir, "sessions", ev.sessions).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT user_id, count(*)::BIGINT AS seen, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS served, greatest(0, CAST(ceil(0.25 * count(*)) AS BIGINT) - count(*) FILTER (WHERE event_type = 'error'))::BIGINT AS needed FROM events GROUP BY user_id")
def stream_floor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of every user: the row with the most seen."""
    folder = _folder(spark, "floors")
    stream = ev.read_events(spark, f"{sf_dir}/events*.parquet")
    ev.run_once(ev.floor_state(stream), f"{folder}/out", f"{folder}/state", "update")
    rows = spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.max(F.struct("seen", "served", "needed")).alias("s"))
    return rows.select("user_id", "s.seen", "s.served", "s.needed")


@query("SELECT event_type, count(DISTINCT event_id)::BIGINT AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def stream_dedup_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated events appended batch by batch to a ledger that a repeated batch leaves unchanged."""
    folder = _folder(spark, "ledger")
    stream = ev.deduplicated(ev.read_events(spark, f"{sf_dir}/events*.parquet"))
    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(ev.append_ledger(f"{folder}/out")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count_distinct("event_id").alias("n"), F.round(F.sum("value"), 3).alias("total"))


#: Files that the events are dealt to by time, and those that come a second time, as after a crash.
FILES, AGAIN = 6, (1, 3)
ORDER = [k for f in range(FILES) for k in ([f, f] if f in AGAIN else [f])]
FILES_SQL = f"""f AS (SELECT *, epoch_us(ts) AS us, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * {FILES} // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS file FROM events)"""


def dealt_events(spark: SparkSession, sf_dir: str, folder: str, order: list[int]) -> None:
    """The events in files by time, written one after the other, which is the order in which a stream reads them.

    A file holds a range of time, so a larger table needs more files for the same size.
    """
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("branch"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), payload().alias("payload"))
    ends = e.agg(F.min("us"), F.max("us")).first()
    if ends[0] is None:
        raise ValueError("there are no events")
    filed = e.withColumn("file", F.floor((F.col("us") - ends[0]) * FILES / (ends[1] - ends[0] + 1)))
    for n, k in enumerate(order):
        filed.where(F.col("file") == k).drop("file").repartition(1).write.parquet(f"{folder}/in/{n:04d}")


def streamed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("branch long, event_id long, us long, payload string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def ledger_run(spark: SparkSession, sf_dir: str) -> str:
    """Run the ledger over files of which some come twice; the folder with log, commits and stream."""
    folder = _folder(spark, "chain")
    dealt_events(spark, sf_dir, folder, ORDER)
    lg.run(spark, lg.entries(streamed(spark, folder)), folder)
    return folder


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT user_id, step::BIGINT AS step, prev_hash, entry_hash FROM c")
def stream_ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash chain of every user, entered by a stream batch by batch with offsets that go on, though some batches come twice."""
    return lg.log(spark, ledger_run(spark, sf_dir)).select(F.col("branch").alias("user_id"), "step", "prev_hash", "entry_hash")


@query(
    f"""WITH RECURSIVE {CHAIN_SQL}, {FILES_SQL}, h AS (SELECT f.file, c.user_id, c.entry_hash FROM c JOIN f ON f.event_id = c.event_id),
o(batch, file, fresh) AS (VALUES {", ".join(str((n, k, ORDER.index(k) == n)) for n, k in enumerate(ORDER))})
SELECT o.batch::BIGINT AS batch, count(h.user_id) FILTER (WHERE o.fresh)::BIGINT AS entries, count(DISTINCT CASE WHEN o.fresh THEN h.user_id END)::BIGINT AS branches,
 CAST(sum(CASE WHEN o.fresh THEN CAST('0x' || substr(h.entry_hash, 1, 8) AS BIGINT) END) AS BIGINT) AS digest FROM o LEFT JOIN h ON h.file = o.file GROUP BY o.batch"""
)
def stream_ledger_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each committed batch; one whose events were entered before adds nothing."""
    return lg.commits(spark, ledger_run(spark, sf_dir)).select("batch", "entries", "branches", "digest")


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT user_id, count(*)::BIGINT AS entries, arg_max(entry_hash, step) AS head, NULL::BIGINT AS first_break FROM c GROUP BY user_id")
def restored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger whose stream stopped half way: its state, read out of the state store and checked against the log, starts another stream, and both logs are one chain."""
    first, second = _folder(spark, "chain"), _folder(spark, "chain")
    half = FILES // 2
    dealt_events(spark, sf_dir, first, list(range(half)))
    lg.run(spark, lg.entries(streamed(spark, first)), first)
    lg.save(spark, first, f"{first}/saved")
    # The new stream gets the last old file once more, as a source does that was not told how far it had come.
    dealt_events(spark, sf_dir, second, list(range(half - 1, FILES)))
    state = lg.restore(spark, f"{first}/saved", lg.log(spark, first))
    lg.run(spark, lg.entries(streamed(spark, second), state), second)
    whole = lg.log(spark, first).unionByName(lg.log(spark, second))
    heads = whole.groupBy("branch").agg(F.max_by("entry_hash", "step").alias("head"))
    return lg.broken(whole).join(heads, "branch").select(F.col("branch").alias("user_id"), "entries", "head", "first_break")
