"""Step plans, spikes and recovery: by brute force, and with stores that are damaged on purpose."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import planner, recovery


def one_by_one(delivered, available, base, floors, slots):
    """The plan of one step, slot by slot."""
    there = [a > 0 for a in available]
    total = sum(delivered) + slots
    need = [0] * len(base)
    for k, f in enumerate(floors):
        while there[k] and need[k] < slots and 100 * (delivered[k] + need[k]) < f * total:
            need[k] += 1
    plan = [max(b, n) if t else 0 for b, n, t in zip(base, need, there, strict=True)]
    free = [k for k in range(len(base)) if there[k] and need[k] == 0]
    while sum(plan) != slots and free:
        k = max(free, key=lambda k: (plan[k], k))
        if sum(plan) > slots and not plan[k]:
            break
        plan[k] += -1 if sum(plan) > slots else 1
    return plan, [min(p, a) for p, a in zip(plan, available, strict=True)], need


def test_plans_slot_by_slot():
    r = random.Random(1)
    for _ in range(5000):
        floors = tuple(r.choice([0, 0, 5, 15, 40, 90]) for _ in range(5))
        args = (tuple(r.randint(0, 30) for _ in range(5)), [r.choice([0, 1, 3, 9]) for _ in range(5)], [r.randint(0, 4) for _ in range(5)], floors, r.randint(1, 9))
        assert planner.plan_batch(*args) == one_by_one(*args)


def test_unserved_floors_carry_over(spark):
    lanes = {"click": 0, "error": 1, "view": 4}
    rows = []
    for step in range(9):
        have = [0] * 5
        have[lanes["click"]] = 8
        have[lanes["error"]] = 8 if step in (0, 6) else 0  # the floor's lane is there twice
        rows.append((1, step, have, [4, 1, 1, 1, 1]))
    got = planner.planned_steps(spark.createDataFrame(rows, "user_id long, step long, available array<long>, base array<long>")).orderBy("step").collect()
    assert [g.needed[1] for g in got] == [2, 0, 0, 0, 0, 0, 7, 0, 0] and got[6].served[1] == 7 and sum(got[6].served) == 8
    assert all(sum(g.planned) == 8 for g in got)


def test_spikes_and_suspects_against_recomputed_windows(spark):
    r = random.Random(3)
    rows = []
    for user in range(6):
        for i in range(4 * 30 + user):
            x = r.randint(900, 1100)
            if user == 1 and i == 50:
                x = 40_000  # one row carries the spike
            if user == 2 and 60 <= i < 64:
                x = 9_000  # four rows do
            if user == 3 and i // 4 == 12:
                x = 1000
            rows.append((user, i // 4, 1000 * user + i, x if user != 4 else 1000))  # no spread at all
    got = planner.ablated(spark.createDataFrame(rows, "user_id long, batch long, event_id long, x long")).collect()
    found = {(g.user_id, g.batch, g.kind, g.suspect): (g.score, g.replayed, g.reproduced) for g in got}
    want = {}
    for user in range(6):
        series = {}
        for u, b, e, x in rows:
            if u == user:
                series.setdefault(b, []).append((e, x))
        mean = {b: 12 * statistics.fmean(x for _, x in v) for b, v in series.items()}
        for b, own in series.items():
            window = [k for k in range(b - 8, b) if k in mean]

            def z(m, over):
                sd = statistics.pstdev([mean[k] for k in over])
                return (m - statistics.fmean([mean[k] for k in over])) / sd if sd > 1e-9 else None

            score = z(mean[b], window) if len(window) >= 4 else None
            if score is None or score < 4:
                continue
            for e, _ in own:
                left = [x for o, x in own if o != e]
                want[user, b, "row", e] = (score, z(12 * statistics.fmean(left), window) if left else None)
            for k in window:
                want[user, b, "baseline", k] = (score, z(mean[b], [o for o in window if o != k]))
    assert found.keys() == want.keys() and {k[0] for k in want} >= {1, 2}
    for k, (score, replayed) in want.items():
        assert found[k][0] == pytest.approx(score) and found[k][1] == (None if replayed is None else pytest.approx(replayed))
        assert found[k][2] == (None if replayed is None else replayed >= score / 2)
    assert [k[3] for k, v in found.items() if k[:3] == (1, 12, "row") and not v[2]] == [1050]
    assert all(v[2] for k, v in found.items() if k[:3] == (2, 15, "row"))


@pytest.fixture
def store(spark, tmp_path):
    documents = spark.createDataFrame([(i, f"s{i % 3}" if i % 50 else "small", 10_000 if i % 11 == 0 else 100) for i in range(400)], "doc_id long, source string, n_chars long")
    s = recovery.Store(spark, str(tmp_path))
    s.record(documents)
    return s, documents


def test_a_sound_store_has_nothing_to_report(spark, store):
    s, documents = store
    assert recovery.replay(s, documents, 1).count() == 0
    crashed = s.ledger(1).groupBy("source").agg(F.lit(7).cast("long").alias("crash"))
    got = {r.source: r for r in recovery.resume(s, documents, 1, crashed).collect()}
    assert {k: r.resumed_at for k, r in got.items()} == {"s0": 6, "s1": 6, "s2": 6, "small": 0}
    assert all((r.lost, r.extra, r.changed) == (0, 0, 0) and r.regenerated == r.orphans for r in got.values())
    assert sorted(map(tuple, s.ledger(2).collect())) == sorted(map(tuple, s.ledger(1).collect()))


def test_lost_added_and_edited_steps_are_named(spark, store):
    s, documents = store
    s.change(lambda x: x.where("not (source = 's1' and step = 4)").withColumn("step_hash", F.when(F.expr("source = 's2' and step = 0"), "edited").otherwise(F.col("step_hash"))).unionByName(x.where("source = 's0' and step = 1").withColumn("step", F.lit(99).cast("long"))))
    assert {(r.source, r.step, r.reason) for r in recovery.replay(s, documents, 2).collect()} == {("s1", 4, "lost"), ("s2", 0, "changed"), ("s0", 99, "extra")}


def test_a_wrong_snapshot_shows_in_its_interval(spark, store, tmp_path):
    s, documents = store
    other = recovery.Store(spark, f"{tmp_path}/other")
    other.write_ledger(s.ledger(1), 1)
    s.snapshots().withColumn("cursor", F.when(F.expr("source = 's1' and step = 6"), F.col("cursor") + 1).otherwise(F.col("cursor"))).write.parquet(f"{other.folder}/snapshots")
    wrong = recovery.replay(other, documents, 1).collect()
    assert wrong and {r.source for r in wrong} == {"s1"} and min(r.step for r in wrong) <= 6 and max(r.step for r in wrong) <= 8
    crashed = s.ledger(1).groupBy("source").agg(F.lit(6).cast("long").alias("crash"))
    got = {r.source: r.changed for r in recovery.resume(other, documents, 1, crashed).collect()}
    assert got["s1"] > 0 and got["s0"] == 0


def test_a_changed_document_shows_where_it_is_drawn(spark, store):
    s, documents = store
    gone = documents.where("doc_id <> 100")
    reasons = {(r.source, r.reason) for r in recovery.replay(s, gone, 1).collect()}
    source = documents.where("doc_id = 100").first().source
    assert reasons and {r for r, _ in reasons} == {source}


def test_forks_differ_from_their_first_changed_step(spark, store):
    s, documents = store
    changed = {r.source: r for r in recovery.fork(s, documents, 3, 2, "half").collect()}
    control = {r.source: r for r in recovery.fork(s, documents, 3, 4, "control").collect()}
    assert changed.keys() == control.keys() == {"s0", "s1", "s2"}
    assert all(r.first_difference == 3 and r.same == 0 for r in changed.values())
    assert all(r.first_difference is None and r.same == r.steps for r in control.values())
