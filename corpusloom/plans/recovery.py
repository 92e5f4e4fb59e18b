"""Runs of a loader kept as stored snapshots and versions of a ledger: resume, replay and fork from what is stored, and a report of what does not fit.

A store is a folder. ``ledger/version=n`` has what each step of each source drew, as a hash, with the
cursor before and behind it; ``snapshots`` has the cursor behind every few steps. Versions are added,
never changed. A plan is always derived anew from the documents, from a stored cursor on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.prefix import row_numbers
from corpusloom.plans.registry import query
from corpusloom.sources.store import shared_dir
from corpusloom.sources.tables import table

#: Documents of a source that a step draws, steps between snapshots, the longest document that is drawn at first.
DRAWN, EVERY, LONGEST = 4, 3, 6000
LEDGER = "source string, step long, first long, next long, step_hash string"
SNAPSHOT = "source string, step long, cursor long"

DRAWS_SQL = f"""e AS (SELECT doc_id, source, n_chars > {LONGEST} AS too_long FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 7 <> 3),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY too_long, doc_id) - 1 AS cursor FROM e), p AS (SELECT source, cursor // {DRAWN} AS step, cursor, doc_id, too_long FROM o)"""
HASHES_SQL = f"{DRAWS_SQL}, h AS (SELECT source, step, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY cursor)) AS step_hash FROM p GROUP BY 1, 2), n AS (SELECT source, max(step) + 1 AS n FROM h GROUP BY source)"


def draws(documents: DataFrame) -> DataFrame:
    """source, cursor, doc_id and whether the length limit was relaxed.

    A pool is passed in id order; what is reserved or out of band is never drawn, and what is too
    long only when nothing else is left. A source is numbered in two levels, so a large one is no
    single task's work.
    """
    d = documents.where((F.col("doc_id") % 13 != 0) & (F.col("doc_id") % 7 != 3))
    d = d.select("doc_id", "source", (F.col("n_chars") > LONGEST).cast("int").alias("late"))
    chunk = F.col("late").cast("long") * (1 << 44) + F.floor(F.col("doc_id") / 4096)
    numbered = row_numbers(d, "source", ["late", "doc_id"], "place", chunk)
    return numbered.select("source", (F.col("place") - 1).alias("cursor"), "doc_id", (F.col("late") == 1).alias("relaxed"))


def stepwise(pool: DataFrame, first: DataFrame | None = None, drawn: int = DRAWN) -> DataFrame:
    """The ledger of a pool by steps of ``drawn``, or, with rows (source, step, cursor), only from that cursor on, beginning with that step."""
    if first is None:
        at = pool.withColumn("step", F.floor(F.col("cursor") / drawn))
    else:
        start = first.select("source", F.col("step").alias("start"), F.col("cursor").alias("from"))
        at = pool.join(F.broadcast(start), "source").where("cursor >= from")  # a row a source
        at = at.withColumn("step", F.col("start") + F.floor((F.col("cursor") - F.col("from")) / drawn))
    ids = F.sort_array(F.collect_list(F.struct("cursor", F.col("doc_id").cast("string").alias("id"))))["id"]
    steps = at.groupBy("source", "step").agg(F.min("cursor").alias("first"), (F.max("cursor") + 1).alias("next"), F.sha2(F.array_join(ids, ","), 256).alias("step_hash"))
    return steps.select([f.split()[0] for f in LEDGER.split(", ")])


class Store:
    """A run's folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def ledger(self, version: int | str) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger/version={version}")

    def write_ledger(self, rows: DataFrame, version: int | str) -> None:
        rows.write.parquet(f"{self.folder}/ledger/version={version}")

    def snapshots(self) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.folder}/snapshots")

    def record(self, documents: DataFrame) -> None:
        """Run the whole plan: its ledger is version 1, and every few steps a snapshot is kept."""
        self.write_ledger(stepwise(draws(documents)), 1)
        done = self.ledger(1)
        done.where(F.col("step") % EVERY == EVERY - 1).select("source", (F.col("step") + 1).alias("step"), F.col("next").alias("cursor")).write.parquet(f"{self.folder}/snapshots")

    def change(self, damage: Callable[[DataFrame], DataFrame], version: int = 2, of: int = 1) -> None:
        self.write_ledger(damage(self.ledger(of)), version)


def differences(ledger: DataFrame, again: DataFrame) -> DataFrame:
    """Steps in which a ledger is not what was derived again: lost, extra or changed, with both hashes."""
    ledger = ledger.select("source", "step", F.col("step_hash").alias("stored"), F.lit(True).alias("kept"))
    both = ledger.join(again.select("source", "step", F.col("step_hash").alias("replayed"), F.lit(True).alias("made")), ["source", "step"], "full_outer")
    why = F.when(F.col("kept").isNull(), "lost").when(F.col("made").isNull(), "extra").when(~F.col("stored").eqNullSafe(F.col("replayed")), "changed")
    return both.withColumn("reason", why).select("source", "step", "stored", "replayed", "reason").where("reason is not null")


def resume(store: Store, documents: DataFrame, version: int, crashed: DataFrame) -> DataFrame:
    """What a resumed run finds, from rows (source, crash): the last step that each source had served.

    It goes on from the last snapshot at or before the crash, or from the start. What a ledger holds
    from there on are orphans, which the regenerated steps supersede; they are kept as the next
    version. The report says how many there were and how they compare.
    """
    at = store.snapshots().join(crashed, "source").where("step <= crash + 1").groupBy("source").agg(F.max_by(F.struct("step", "cursor"), "step").alias("s"))
    first = crashed.join(at, "source", "left").select("source", F.coalesce("s.step", F.lit(0)).alias("step"), F.coalesce("s.cursor", F.lit(0)).alias("cursor"))
    held = store.ledger(version).join(F.broadcast(first.select("source", F.col("step").alias("from"))), "source")
    store.write_ledger(held.where("step < from").drop("from").unionByName(stepwise(draws(documents), first)), version + 1)
    # Read back, so that the plan is derived once.
    again = store.ledger(version + 1).join(F.broadcast(first.select("source", F.col("step").alias("from"))), "source").where("step >= from").drop("from")
    orphans = held.where("step >= from")
    apart = differences(orphans, again).groupBy("source").agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("lost", "extra", "changed")))
    digest = F.sum(F.conv(F.substring("step_hash", 1, 8), 16, 10).cast("long")).alias("digest")
    made = again.groupBy("source").agg(F.count(F.lit(1)).alias("regenerated"), digest)
    report = first.select("source", F.col("step").alias("resumed_at")).join(made, "source", "left").join(orphans.groupBy("source").agg(F.count(F.lit(1)).alias("orphans")), "source", "left").join(apart, "source", "left")
    return report.na.fill(0, ["regenerated", "orphans", "lost", "extra", "changed"])


def replay(store: Store, documents: DataFrame, version: int) -> DataFrame:
    """Every interval between snapshots derived again from the cursor that is stored before it, against a version of the ledger.

    A snapshot that does not fit its neighbours shows itself too, in the steps that begin at its cursor.
    """
    snaps = store.snapshots()
    zero = store.ledger(1).select("source").distinct().select("source", F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("cursor"))
    starts = snaps.unionByName(zero)
    pool = draws(documents)
    interval = F.floor(F.col("cursor") / (DRAWN * EVERY)).alias("interval")
    # A cursor lies in the interval that its own arithmetic says; the stored cursor of that interval says which step it is.
    owner = starts.select("source", F.floor(F.col("step") / EVERY).alias("interval"), F.col("step").alias("start"), F.col("cursor").alias("from"))
    at = pool.withColumn("interval", interval).join(owner, ["source", "interval"])
    at = at.withColumn("step", F.col("start") + F.floor((F.col("cursor") - F.col("from")) / DRAWN))
    ids = F.sort_array(F.collect_list(F.struct("cursor", F.col("doc_id").cast("string").alias("id"))))["id"]
    again = at.groupBy("source", "step").agg(F.sha2(F.array_join(ids, ","), 256).alias("step_hash"))
    return differences(store.ledger(version), again)


def fork(store: Store, documents: DataFrame, step: int, drawn: int, name: str) -> DataFrame:
    """A branch that goes on from a snapshot with its own batch size; its steps are stored under its name and compared with the parent's stored ones.

    A source without that snapshot does not fork.
    """
    first = store.snapshots().where(F.col("step") == step)
    store.write_ledger(stepwise(draws(documents), first, drawn), name)
    branch, parent = store.ledger(name), store.ledger(1).select("source", "step", F.col("step_hash").alias("parent"))
    both = branch.join(parent, ["source", "step"], "left")
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("step_hash") == F.col("parent")).alias("same"), F.min(F.when(~F.col("step_hash").eqNullSafe(F.col("parent")), F.col("step"))).alias("first_difference")
    )


# -- queries


def recorded(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    store = Store(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}")
    store.record(documents)
    return store, documents


def damaged(ledger: DataFrame) -> DataFrame:
    """A ledger after a bad night: some steps lost, some with other hashes, and a step that was never planned."""
    left = ledger.where("step % 5 <> 3").withColumn("step_hash", F.when(F.col("step") % 7 == 4, F.reverse("step_hash")).otherwise(F.col("step_hash")))
    last = ledger.groupBy("source").agg((F.max("step") + 1).alias("step"), F.max("next").alias("first"))
    return left.unionByName(last.select("source", "step", "first", (F.col("first") + DRAWN).alias("next"), F.lit("orphan").alias("step_hash")))


DAMAGED_SQL = f"{HASHES_SQL}, x AS (SELECT source, step, CASE WHEN step % 7 = 4 THEN reverse(step_hash) ELSE step_hash END AS step_hash FROM h WHERE step % 5 <> 3 UNION ALL SELECT source, n, 'orphan' FROM n)"


@query(f"WITH {DRAWS_SQL} SELECT source, step::BIGINT AS step, cursor::BIGINT AS cursor, doc_id, too_long AS relaxed FROM p")
def pool_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = draws(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
    return d.select("source", F.floor(F.col("cursor") / DRAWN).alias("step"), "cursor", "doc_id", "relaxed")


@query(
    f"""WITH {DAMAGED_SQL}, c AS (SELECT source, 2 * n // 3 AS crash, (2 * n // 3 + 1) // {EVERY} * {EVERY} AS at FROM n),
b AS (SELECT c.source, coalesce(h.step, x.step) AS step, h.step_hash AS made, x.step_hash AS kept FROM (SELECT h.*, c.at FROM h JOIN c USING (source) WHERE h.step >= c.at) h FULL OUTER JOIN (SELECT x.*, c.at FROM x JOIN c USING (source) WHERE x.step >= c.at) x ON x.source = h.source AND x.step = h.step JOIN c ON c.source = coalesce(h.source, x.source))
SELECT c.source, c.at::BIGINT AS resumed_at, count(made)::BIGINT AS regenerated, CAST(sum(CAST('0x' || substr(made, 1, 8) AS BIGINT)) AS BIGINT) AS digest, count(kept)::BIGINT AS orphans,
 count(*) FILTER (WHERE kept IS NULL AND made IS NOT NULL)::BIGINT AS lost, count(*) FILTER (WHERE made IS NULL AND kept IS NOT NULL)::BIGINT AS extra, count(*) FILTER (WHERE made <> kept)::BIGINT AS changed
FROM c LEFT JOIN b ON b.source = c.source GROUP BY c.source, c.at"""
)
def resumed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's run broke off after two thirds of its steps, and its ledger was damaged; it goes on from the last stored snapshot before."""
    store, documents = recorded(spark, sf_dir)
    store.change(damaged)
    crashed = store.ledger(1).groupBy("source").agg(F.floor((F.max("step") + 1) * 2 / 3).alias("crash"))
    return resume(store, documents, 2, crashed)


@query(
    f"""WITH {DAMAGED_SQL} SELECT coalesce(h.source, x.source) AS source, coalesce(h.step, x.step)::BIGINT AS step, x.step_hash AS stored, h.step_hash AS replayed,
 CASE WHEN x.source IS NULL THEN 'lost' WHEN h.source IS NULL THEN 'extra' ELSE 'changed' END AS reason FROM h FULL OUTER JOIN x ON x.source = h.source AND x.step = h.step WHERE h.step_hash IS DISTINCT FROM x.step_hash"""
)
def replayed_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intervals of a damaged ledger replayed from their stored cursors: just the steps that are not what was served."""
    store, documents = recorded(spark, sf_dir)
    store.change(damaged)
    return replay(store, documents, 2)


@query(
    f"""WITH {HASHES_SQL}, f AS (SELECT source, {EVERY} + (cursor - {EVERY * DRAWN}) // 2 AS step, cursor, doc_id FROM p WHERE cursor >= {EVERY * DRAWN}),
g AS (SELECT source, step, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY cursor)) AS step_hash FROM f GROUP BY 1, 2),
w AS (SELECT g.source, count(*) AS steps, count(*) FILTER (WHERE g.step_hash = h.step_hash) AS same, min(g.step) FILTER (WHERE g.step_hash IS DISTINCT FROM h.step_hash) AS first_difference FROM g LEFT JOIN h ON h.source = g.source AND h.step = g.step GROUP BY g.source),
k AS (SELECT source, count(*) AS control_steps FROM h WHERE step >= {EVERY} GROUP BY source)
SELECT w.source, w.steps::BIGINT AS steps, w.same::BIGINT AS same, w.first_difference::BIGINT AS first_difference, k.control_steps::BIGINT AS control_steps, k.control_steps::BIGINT AS control_same FROM w JOIN k ON k.source = w.source"""
)
def forked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch that draws half as much from the first snapshot on, and a control that changes nothing, each stored and compared with the stored parent."""
    store, documents = recorded(spark, sf_dir)
    changed = fork(store, documents, EVERY, DRAWN // 2, "half")
    control = fork(store, documents, EVERY, DRAWN, "control").select("source", F.col("steps").alias("control_steps"), F.col("same").alias("control_same"))
    return changed.join(control, "source")
