"""The chained log over batches: replays, restoring, and states that do not fit."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.hashing import GENESIS
from corpusloom.streaming import ledger as lg

EVENT = "branch long, event_id long, us long, payload string"


def write(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{folder}/in/{n:04d}")
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def plain(rows):
    out, head, step = [], {}, {}
    for b, i, us, p in sorted(set(rows), key=lambda r: (r[2], r[1])):
        before = head.get(b, GENESIS)
        head[b] = hashlib.sha256((p + before).encode()).hexdigest()
        out.append((b, step.get(b, 0), i, before, head[b]))
        step[b] = step.get(b, 0) + 1
    return sorted(out)


def made(n=60):
    r = random.Random(5)
    return [(r.randrange(4), i, 1000 * (i // 3), f"p{i}") for i in range(n)]


def chain(log):
    return sorted((r.branch, r.step, r.event_id, r.prev_hash, r.entry_hash) for r in log.collect())


@pytest.fixture(scope="module")
def half(spark, tmp_path_factory):
    """A stream that stopped after a half of the rows, and its saved state."""
    folder, rows = str(tmp_path_factory.mktemp("half")), made()
    lg.run(spark, lg.entries(write(spark, folder, [rows[:12], rows[12:30][::-1] + [rows[15]]])), folder)
    lg.save(spark, folder, f"{folder}/saved")
    return folder, rows


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    rows = made()
    odd = [(None, 900, 1, "no branch"), (1, None, 1, "no id"), (1, 901, None, "no time"), (1, 902, 1, None)]
    stream = write(spark, str(tmp_path), [rows[:21], rows[:21], odd, rows[12:42], rows[42:], rows])
    lg.run(spark, lg.entries(stream), str(tmp_path))
    log = lg.log(spark, str(tmp_path))
    assert chain(log) == plain(rows)
    assert {r.branch: (r.entries, r.first_break) for r in lg.broken(log).collect()} == {b: (sum(x[0] == b for x in rows), None) for b in range(4)}
    assert [(r.batch, r.entries) for r in lg.commits(spark, str(tmp_path)).orderBy("batch").collect()] == [(0, 21), (1, 0), (2, 0), (3, 21), (4, 18), (5, 0)]
    lg.run(spark, lg.entries(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")), str(tmp_path))
    assert lg.log(spark, str(tmp_path)).count() == 60


def test_a_restored_stream_ends_like_one_that_never_stopped(spark, half, tmp_path):
    folder, rows = half
    state = lg.restore(spark, f"{folder}/saved", lg.log(spark, folder))
    # The second stream has a branch that the state does not know, and rows that were entered before.
    more = [(9, 500, 99_000, "new")]
    lg.run(spark, lg.entries(write(spark, str(tmp_path), [rows[24:40], rows[40:] + more]), state), str(tmp_path))
    assert chain(lg.log(spark, folder).unionByName(lg.log(spark, str(tmp_path)))) == plain(rows + more)


def test_a_state_that_does_not_fit_is_refused(spark, half, tmp_path):
    folder, _ = half
    saved, log = f"{folder}/saved", lg.log(spark, folder)
    assert lg.restore(spark, saved, log).count() == 4
    state = spark.read.parquet(f"{saved}/state")
    cases = {
        "offset_differs": log.where(f"not (branch = 1 and step = {log.where('branch = 1').count() - 1})"),
        "log_has_gaps": log.where("not (branch = 2 and step = 1)"),
        "no_log": log.where("branch <> 3"),
        "head_differs": log.withColumn("entry_hash", F.when((F.col("branch") == 0), F.lit("x")).otherwise(F.col("entry_hash"))),
    }
    for reason, damaged in cases.items():
        found = lg.faults(state, damaged).collect()
        assert [r.reason for r in found] == [reason]
        with pytest.raises(lg.Refused, match=reason):
            lg.restore(spark, saved, damaged)
    assert [r.reason for r in lg.faults(state.where("branch <> 1"), log).collect()] == ["no_state"]
    for n, change in enumerate((F.col("next_offset") + F.when(F.col("branch") == 2, 1).otherwise(0), F.col("next_offset"))):
        target = f"{tmp_path}/{n}"
        (state.withColumn("next_offset", change) if n == 0 else state.where("branch <> 1")).write.parquet(f"{target}/state")
        spark.read.parquet(f"{saved}/seal").write.parquet(f"{target}/seal")
        with pytest.raises(lg.Refused, match="sealed"):
            lg.restore(spark, target, log)


def test_breaks_are_found_where_they_are(spark, half):
    folder, _ = half
    log = lg.log(spark, folder)
    cut = log.where("not (branch = 2 and step = 1)").withColumn("payload", F.when((F.col("branch") == 3) & (F.col("step") == 2), "edited").otherwise(F.col("payload")))
    assert {r.branch: r.first_break for r in lg.broken(cut).collect()} == {0: None, 1: None, 2: 2, 3: 2}
