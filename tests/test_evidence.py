"""A verifier finds what its queries' damage does not touch: leaks, wrong lanes, lost entries, lost rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import evidence as ev


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bundle") / "b")
    ev.write(spark, sf_dir, path)
    return path


def failed(spark, folder, changed):
    return {r.check: r.failed for r in ev.verify(ev.Bundle(spark, folder, changed)).collect() if r.failed}


def test_leaks_and_wrong_lanes(spark, folder):
    served = spark.read.parquet(f"{folder}/batches").select(F.explode("ids").alias("e")).first().e
    changed = {
        "decisions": lambda t: t.withColumn("decision", F.when(F.col("event_id") == served, "rejected").otherwise(F.col("decision"))),
        "batches": lambda t: t.withColumn("lanes", F.when((F.col("user_id") == 0) & (F.col("batch") == 0), F.transform_values("lanes", lambda k, v: v + 1)).otherwise(F.col("lanes"))),
    }
    got = failed(spark, folder, changed)
    assert got["nothing_rejected_was_served"] == 1 and got["lanes_agree_with_the_ledger"] == 1 and got["batch_hashes_recompute"] == 1
    assert set(got) <= {"nothing_rejected_was_served", "lanes_agree_with_the_ledger", "batch_hashes_recompute", "rejection_rate_reconstructs", "delivered_shares_match"}


def test_lost_rows(spark, folder):
    first = spark.read.parquet(f"{folder}/batches").orderBy("user_id", "batch").first()
    lost = first.ids[0]
    changed = {
        "ledger": lambda t: t.where(~F.col("payload").startswith(f"{lost}|")),
        "performance": lambda t: t.where(F.col("user_id") != first.user_id),
        "shares": lambda t: t.withColumn("share", F.col("share") + 0.01),
        "manifests": lambda t: t.withColumn("license_tier", F.when(F.col("admitted"), "unknown").otherwise(F.col("license_tier"))),
    }
    got = failed(spark, folder, changed)
    admitted = spark.read.parquet(f"{folder}/manifests").where("admitted").count()
    assert got["members_are_in_the_ledger"] == 1 and got["tokens_agree_with_the_ledger"] == 1 and got["ledger_hashes_recompute"] >= 1 and got["ledger_offsets_are_gapless"] == 1
    assert got["raw_tokens_reconstruct"] == got["loss_tokens_reconstruct"] == got["utilization_reconstructs"] == 1
    assert got["delivered_shares_match"] == spark.read.parquet(f"{folder}/shares").count() and got.get("admission_recomputes", 0) == admitted


def test_a_ledger_reloaded_from_lines_in_any_order(spark, tmp_path):
    import hashlib
    import json
    import random

    from corpusloom.functions.hashing import GENESIS
    from corpusloom.plans.manifests import reloaded

    rows = []
    for user in (1, 2, 3):
        head = GENESIS
        for k in range(6):
            body = f"{user}:{k}"
            entry = hashlib.sha256((body + head).encode()).hexdigest()
            rows.append({"user_id": user, "ledger_offset": k, "payload": body if (user, k) != (2, 4) else "edited", "prev_hash": head, "entry_hash": entry})
            head = entry
    rows = [r for r in rows if (r["user_id"], r["ledger_offset"]) != (3, 2)]
    random.Random(1).shuffle(rows)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[i::3]) + "\n")
    bad = {(r.user_id, r.ledger_offset) for r in reloaded(spark, str(tmp_path)).where("not sound").collect()}
    assert bad == {(2, 4), (3, 3)}
