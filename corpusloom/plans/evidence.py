"""A run's evidence as a bundle of stored tables, and a verifier that recomputes every claim from the bundle alone.

The writer and the verifier share no code but the canonical form of what is hashed. What a check
counts are units (entries, batches, shards, branches) and those that do not hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import GENESIS
from corpusloom.plans.ledger import DECISIONS_SQL, chained, decisions, payload
from corpusloom.plans.registry import query
from corpusloom.plans.windows import STEPS_SQL, steps
from corpusloom.sources.store import shared_dir
from corpusloom.sources.tables import table

#: Slots of a batch, documents of a shard (by id), lane without loss, tokenizer of all shards, scope of the summary.
BATCH, SHARD, NO_LOSS, TOKENIZER, SCOPE = 8, 64, "error", "utf-8/1", "all branches"
#: Decisions whose samples are served.
SERVED = ("accepted", "protected")


def batch_hash(ids: Column, lanes: Column) -> Column:
    """Hash of a batch's members in their order and of its lanes in the order of their names."""
    names = F.array_sort(F.map_keys(lanes))
    return F.sha2(F.concat(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit(";"), F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), lanes[k].cast("string"))), ",")), 256)


def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The bundle of a run over the events (branches are users) and of shards of the documents."""
    s = steps(spark, sf_dir).withColumn("payload", payload()).withColumn("step", F.col("step").cast("long"))
    chained(s, "user_id", "step", "payload", with_body=True).write.parquet(f"{folder}/ledger")

    d = decisions(spark, sf_dir).select("event_id", "user_id", "lane", "score", "decision")
    d.write.parquet(f"{folder}/decisions")
    judged = F.col("score").isNotNull()
    kept = F.count_if(judged & F.col("decision").isin(*SERVED)) / F.count_if(judged)
    d.agg(F.lit(SCOPE).alias("scope"), F.round(1 - kept, 4).alias("rejection_rate")).write.parquet(f"{folder}/summary")

    served = s.join(d.where(F.col("decision").isin(*SERVED)).select("event_id"), "event_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("step")) - 1
    served = served.select("user_id", F.floor(place / BATCH).alias("batch"), "step", "event_id", F.col("event_type").alias("lane"), F.round(F.col("value") * 100).cast("long").alias("tokens"))
    # A batch has at most BATCH members.
    lanes = served.groupBy("user_id", "batch", "lane").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id", "batch").agg(F.map_from_entries(F.collect_list(F.struct("lane", "n"))).alias("lanes"))
    members = served.groupBy("user_id", "batch").agg(
        F.array_sort(F.collect_list(F.struct("step", "event_id")))["event_id"].alias("ids"), F.sum("tokens").alias("n_tokens"), F.sum(F.when(F.col("lane") != NO_LOSS, F.col("tokens")).otherwise(0)).alias("n_loss"), (BATCH - F.count(F.lit(1))).alias("n_pad")
    )
    batches = members.join(lanes, ["user_id", "batch"])
    batches.withColumn("batch_hash", batch_hash(F.col("ids"), F.col("lanes"))).write.parquet(f"{folder}/batches")
    b = spark.read.parquet(f"{folder}/batches")
    used = (F.count(F.lit(1)) * BATCH - F.sum("n_pad")) / (F.count(F.lit(1)) * BATCH)
    b.groupBy("user_id").agg(F.sum("n_tokens").alias("raw_tokens"), F.sum("n_loss").alias("loss_tokens"), F.round(used, 6).alias("utilization")).write.parquet(f"{folder}/performance")
    counted = b.select(F.explode("lanes").alias("lane", "n")).groupBy("lane").agg(F.sum("n").alias("n"))
    counted.select("lane", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share")).write.parquet(f"{folder}/shares")  # a row a lane

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("doc_id") / SHARD).alias("part"))
    shards = docs.groupBy("source", "part").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "text")))["text"], "\n").alias("body"), F.count(F.lit(1)).alias("documents"), F.count_distinct("text").alias("different"), F.array_sort(F.collect_set("lang")).alias("languages")
    )
    shards.select("source", "part", F.encode("body", "UTF-8").alias("body")).write.parquet(f"{folder}/shards")
    facts = shards.select(
        "source", "part", F.sha2(F.encode("body", "UTF-8"), 256).alias("content_hash"), F.lit(TOKENIZER).alias("tokenizer"), "documents", F.octet_length("body").cast("long").alias("bytes"), "languages",
        F.when(F.col("documents") > F.col("different"), "contains_duplicates").otherwise("unique").alias("dedup_status"),
        F.when(F.lower("body").rlike("all rights reserved|confidential"), "unsafe").otherwise("safe").alias("license_tier"),
    )
    facts.withColumn("admitted", (F.col("dedup_status") == "unique") & (F.col("license_tier") == "safe")).write.parquet(f"{folder}/manifests")


class Bundle:
    """The stored tables; ``changed`` puts others in the place of some, as a damaged bundle has them."""

    def __init__(self, spark: SparkSession, folder: str, changed: dict[str, Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.folder, self.changed = spark, folder, changed or {}

    def __getitem__(self, name: str) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.folder}/{name}")
        return self.changed.get(name, lambda t: t)(stored)


def held(units: DataFrame, **checks: Column) -> DataFrame:
    """check, units and failed of checks of the same units, in one pass: rows, and those for which a condition is not true (null is not)."""
    counts = units.agg(F.count(F.lit(1)).alias("units"), *(F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in checks.items()))
    return counts.select("units", F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("failed")) for name in checks))).alias("c")).select("c.check", "units", "c.failed")


def verify(b: Bundle) -> DataFrame:
    """Every check, recomputed from the stored tables."""
    w = Window.partitionBy("user_id").orderBy("step")
    ledger = b["ledger"].withColumns({"before": F.lag("entry_hash").over(w), "last": F.lag("step").over(w)})
    batches = b["batches"]
    # Lanes from the ledger's own entries, whose payloads name event and lane.
    entry = b["ledger"].select(F.split("payload", r"\|").alias("p")).select(F.col("p")[0].cast("long").alias("event_id"), F.col("p")[1].alias("lane"), F.col("p")[2].cast("long").alias("tokens"))
    members = batches.select("user_id", "batch", F.explode("ids").alias("event_id")).join(entry, "event_id", "left")
    again = members.groupBy("user_id", "batch").agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("lane") != NO_LOSS, F.col("tokens")).otherwise(0)).alias("loss"), F.count("lane").alias("known"))
    by_lane = members.groupBy("user_id", "batch", "lane").agg(F.count(F.lit(1)).alias("found"))
    claimed = batches.select("user_id", "batch", F.explode("lanes").alias("lane", "stated"))
    apart = claimed.join(by_lane, ["user_id", "batch", "lane"], "full_outer").where(~F.col("stated").eqNullSafe(F.col("found"))).select("user_id", "batch").distinct().withColumn("apart", F.lit(True))
    lanes = batches.select("user_id", "batch", "n_tokens", "n_loss", "ids", "n_pad").join(apart, ["user_id", "batch"], "left").join(again, ["user_id", "batch"], "left")

    sums = batches.groupBy("user_id").agg(F.sum("n_tokens").alias("raw"), F.sum("n_loss").alias("loss"), F.round(1 - F.sum("n_pad") / (BATCH * F.count(F.lit(1))), 6).alias("used"))
    performance = b["performance"].join(sums, "user_id", "full_outer")
    total = claimed.groupBy("lane").agg(F.sum("stated").alias("n"))
    shares = total.select("lane", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("found")).join(b["shares"], "lane", "full_outer")  # a row a lane

    d = b["decisions"]
    judged = d.where("score is not null")
    rate = judged.agg((1 - F.count_if(F.col("decision").isin(*SERVED)) / F.count(F.lit(1))).alias("found"))
    summary = b["summary"].crossJoin(rate)  # one row each
    verdicts = d.groupBy("event_id").agg(F.bool_or(F.col("decision").isin(*SERVED)).alias("admitted"))
    served = members.select("event_id").join(verdicts, "event_id", "left")

    manifests = b["manifests"]
    shards = manifests.select("source", "part", "content_hash", "bytes").join(b["shards"], ["source", "part"], "full_outer")
    tokenizers = manifests.select(F.col("tokenizer") == TOKENIZER)
    should = (F.col("dedup_status") == "unique") & (F.col("license_tier") == "safe")
    for field in ("content_hash", "tokenizer", "dedup_status", "license_tier"):
        should &= F.coalesce(~F.col(field).isin("", "missing", "unknown"), F.lit(False))
    return reduce(
        DataFrame.unionByName,
        [
            held(
                ledger,
                ledger_hashes_recompute=(F.sha2(F.concat("payload", "prev_hash"), 256) == F.col("entry_hash")) & (F.col("prev_hash") == F.coalesce("before", F.lit(GENESIS))),
                ledger_offsets_are_gapless=F.col("step") == F.coalesce(F.col("last") + 1, F.lit(0)),
            ),
            held(batches, batch_hashes_recompute=batch_hash(F.col("ids"), F.col("lanes")) == F.col("batch_hash")),
            held(
                lanes,
                lanes_agree_with_the_ledger=F.col("apart").isNull(),
                tokens_agree_with_the_ledger=(F.col("tokens") == F.col("n_tokens")) & (F.col("loss") == F.col("n_loss")),
                members_are_in_the_ledger=(F.col("known") == F.size("ids")) & (F.size("ids") + F.col("n_pad") == BATCH),
            ),
            held(
                performance,
                raw_tokens_reconstruct=F.col("raw") == F.col("raw_tokens"),
                loss_tokens_reconstruct=F.col("loss") == F.col("loss_tokens"),
                utilization_reconstructs=F.abs(F.col("used") - F.col("utilization")) < 2e-6,
            ),
            held(shares, delivered_shares_match=F.abs(F.col("found") - F.col("share")) < 1e-3),
            held(summary, summary_declares_its_scope=F.col("scope") == SCOPE, rejection_rate_reconstructs=F.abs(F.col("found") - F.col("rejection_rate")) <= 5.1e-5),
            held(served, nothing_rejected_was_served=F.col("admitted")),
            held(shards, content_hashes_recompute=(F.sha2("body", 256) == F.col("content_hash")) & (F.octet_length("body") == F.col("bytes"))),
            held(tokenizers, one_tokenizer_everywhere=F.col(tokenizers.columns[0])),
            held(manifests, admission_recomputes=should == F.col("admitted")),
        ],
    )


# -- queries

PARTS_SQL = f"""{DECISIONS_SQL}, {STEPS_SQL}, sv AS (SELECT s.user_id, s.step, s.event_id, s.event_type AS lane FROM s JOIN x ON x.event_id = s.event_id WHERE x.decision IN ('accepted', 'protected')),
bt AS (SELECT user_id, batch, count(*) AS members FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY step) - 1) // {BATCH} AS batch FROM sv) GROUP BY 1, 2),
mf AS (SELECT source, doc_id // {SHARD} AS part FROM documents GROUP BY 1, 2),
u(entries, batches, branches, lanes, served, shards) AS (SELECT (SELECT count(*) FROM s), (SELECT count(*) FROM bt), (SELECT count(DISTINCT user_id) FROM bt), (SELECT count(DISTINCT lane) FROM sv), (SELECT count(*) FROM sv), (SELECT count(*) FROM mf))"""
UNITS = {
    "ledger_hashes_recompute": "entries", "ledger_offsets_are_gapless": "entries", "batch_hashes_recompute": "batches", "lanes_agree_with_the_ledger": "batches", "tokens_agree_with_the_ledger": "batches",
    "members_are_in_the_ledger": "batches", "raw_tokens_reconstruct": "branches", "loss_tokens_reconstruct": "branches", "utilization_reconstructs": "branches", "delivered_shares_match": "lanes",
    "summary_declares_its_scope": "1", "rejection_rate_reconstructs": "1", "nothing_rejected_was_served": "served", "content_hashes_recompute": "shards", "one_tokenizer_everywhere": "shards", "admission_recomputes": "shards",
}


def _rows_sql(failed: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", ({n})::BIGINT AS units, ({failed.get(c, '0')})::BIGINT AS failed FROM u" for c, n in UNITS.items())


def bundle(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{shared_dir(spark)}/evidence-{uuid.uuid4().hex}"
    write(spark, sf_dir, folder)
    return folder


@query(f"WITH {PARTS_SQL} {_rows_sql({})}")
def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over a sound bundle."""
    return verify(Bundle(spark, bundle(spark, sf_dir)))


#: What happens to a bundle's tables, and how many units of which checks must then fail.
DAMAGE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ledger": lambda t: t.withColumn("entry_hash", F.when(F.expr("step = 2 and user_id % 3 = 0"), F.reverse("entry_hash")).otherwise(F.col("entry_hash"))),
    "batches": lambda t: t.withColumn("batch_hash", F.when(F.col("batch") % 5 == 1, F.lit("0")).otherwise(F.col("batch_hash"))),
    "performance": lambda t: t.withColumns({"raw_tokens": F.col("raw_tokens") + (F.col("user_id") % 4 == 1).cast("long"), "utilization": F.when(F.col("user_id") % 7 == 2, F.lit(0.0)).otherwise(F.col("utilization"))}),
    "summary": lambda t: t.withColumns({"scope": F.lit("one branch"), "rejection_rate": F.col("rejection_rate") + 0.01}),
    "shards": lambda t: t.where("part % 9 <> 4").withColumn("body", F.when(F.col("part") % 7 == 2, F.concat("body", F.lit(b" "))).otherwise(F.col("body"))),
    "manifests": lambda t: t.withColumns({"tokenizer": F.when(F.col("part") % 11 == 3, "utf-8/2").otherwise(F.col("tokenizer")), "admitted": F.col("admitted") != (F.col("part") % 6 == 5)}),
}
DAMAGED = {
    "ledger_hashes_recompute": "SELECT count(*) FROM (SELECT user_id, step FROM s WHERE step = 2 AND user_id % 3 = 0 UNION SELECT user_id, step FROM s WHERE step = 3 AND user_id % 3 = 0)",
    "batch_hashes_recompute": "SELECT count(*) FROM bt WHERE batch % 5 = 1",
    "raw_tokens_reconstruct": "SELECT count(DISTINCT user_id) FROM bt WHERE user_id % 4 = 1",
    "utilization_reconstructs": "SELECT count(DISTINCT user_id) FROM bt WHERE user_id % 7 = 2",
    "summary_declares_its_scope": "1",
    "rejection_rate_reconstructs": "1",
    "content_hashes_recompute": "SELECT count(*) FROM mf WHERE part % 9 = 4 OR part % 7 = 2",
    "one_tokenizer_everywhere": "SELECT count(*) FROM mf WHERE part % 11 = 3",
    "admission_recomputes": "SELECT count(*) FROM mf WHERE part % 6 = 5",
}


@query(f"WITH {PARTS_SQL} {_rows_sql(DAMAGED)}")
def evidence_checks_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over a bundle that was damaged in many places: each check counts just the units that its damage touched."""
    return verify(Bundle(spark, bundle(spark, sf_dir), DAMAGE))
