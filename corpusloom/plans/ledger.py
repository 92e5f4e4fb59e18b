"""Hash-chained event ledgers, supersession and audit."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import GENESIS
from corpusloom.operators.prefix import fold_by_key
from corpusloom.plans.registry import query
from corpusloom.plans.windows import STEPS_SQL, steps
from corpusloom.sources.tables import table


def payload() -> Column:
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.round(F.col("value") * 100).cast("long").cast("string"))


PAYLOAD_SQL = "event_id || '|' || event_type || '|' || CAST(round(value * 100) AS BIGINT)"
CHAIN_SQL = f"""{STEPS_SQL}, e AS (SELECT user_id, step, event_id, {PAYLOAD_SQL} AS payload FROM s),
c(user_id, step, event_id, prev_hash, entry_hash) AS (SELECT user_id, step, event_id, '{GENESIS}', sha256(payload || '{GENESIS}') FROM e WHERE step = 0
 UNION ALL SELECT e.user_id, e.step, e.event_id, c.entry_hash, sha256(e.payload || c.entry_hash) FROM c JOIN e ON e.user_id = c.user_id AND e.step = c.step + 1)"""


def chained(events: DataFrame, key: str, order: str, body: str, with_body: bool = False) -> DataFrame:
    """Each key's entries in order, every one with the hash of the one before and its own, and ``with_body`` with its body, which no join then needs to bring.

    A link needs the link before, so a key's entries stream through one task, which holds the last hash.
    """

    def link(head: str, row: tuple) -> tuple[str, tuple]:
        entry = hashlib.sha256((getattr(row, body) + head).encode()).hexdigest()
        out = (getattr(row, key), getattr(row, order), head, entry)
        return entry, (*out, getattr(row, body)) if with_body else out

    slim = events.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), body)
    return fold_by_key(slim, key, order, GENESIS, link, f"{key} long, {order} long, prev_hash string, entry_hash string" + (f", {body} string" if with_body else ""))


def first_breaks(ledger: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """The first entry of each key whose hash or whose predecessor's hash does not fit: fully parallel, from the stored hashes."""
    w = Window.partitionBy(key).orderBy(order)
    expected_prev = F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))
    bad = (F.col("prev_hash") != expected_prev) | (F.col("entry_hash") != F.sha2(F.concat(body, "prev_hash"), 256))
    return ledger.withColumn("bad", bad).groupBy(key).agg(F.min(F.when(F.col("bad"), F.col(order))).alias("first_break"), F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT user_id, step::BIGINT AS step, prev_hash, entry_hash FROM c")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = steps(spark, sf_dir).withColumn("payload", payload()).withColumn("step", F.col("step").cast("long"))
    return chained(e, "user_id", "step", "payload")


@query(f"WITH {STEPS_SQL} SELECT user_id, CASE WHEN user_id % 2 = 1 AND count(*) > 3 THEN 3 END::BIGINT AS first_break, count(*)::BIGINT AS n FROM s GROUP BY user_id")
def tampered_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification finds entry 3 of every odd user, whose payload was changed after the chain was built."""
    e = steps(spark, sf_dir).withColumn("payload", payload()).withColumn("step", F.col("step").cast("long"))
    ledger = chained(e, "user_id", "step", "payload").join(e.select("user_id", "step", "payload"), ["user_id", "step"])
    edited = F.when((F.col("user_id") % 2 == 1) & (F.col("step") == 3), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return first_breaks(ledger.withColumn("payload", edited), "user_id", "step", "payload")


#: Events of type error retire the three steps before them in their user's log.
RETIRED_SQL = f"{STEPS_SQL}, r AS (SELECT DISTINCT user_id, step - k AS step FROM s CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE event_type = 'error')"


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that no later marker retired; nothing is deleted, readers leave retired ones out by an anti join."""
    s = steps(spark, sf_dir)
    retired = s.where("event_type = 'error'").select("user_id", F.explode(F.array(*(F.col("step") - k for k in (1, 2, 3)))).alias("step"))
    return s.join(retired, ["user_id", "step"], "left_anti")


@query(f"WITH {RETIRED_SQL} SELECT event_type, count(*)::BIGINT AS n_live, round(sum(value), 3) AS total FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id AND r.step = s.step) GROUP BY event_type")
def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_live"), F.round(F.sum("value"), 3).alias("total"))


@query(
    f"""WITH {RETIRED_SQL}, l AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id AND r.step = s.step))
SELECT (step // 25)::BIGINT AS interval_no, count(*)::BIGINT AS entries, count(DISTINCT user_id)::BIGINT AS branches, count(DISTINCT event_type)::BIGINT AS lanes, round(avg(value), 4) AS mean_value FROM l GROUP BY 1"""
)
def interval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).groupBy(F.floor(F.col("step") / 25).alias("interval_no")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("user_id").alias("branches"), F.count_distinct("event_type").alias("lanes"), F.round(F.avg("value"), 4).alias("mean_value")
    )


@query(
    f"""WITH {STEPS_SQL}, a AS (SELECT user_id AS pair, step, event_type FROM s), b AS (SELECT user_id - 1 AS pair, step, event_type FROM s WHERE user_id - 1 IN (SELECT user_id FROM s)),
c AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.step, b.step) AS step, a.event_type AS x, b.event_type AS y FROM a FULL OUTER JOIN b ON a.pair = b.pair AND a.step = b.step)
SELECT pair::BIGINT AS user_id, count(*)::BIGINT AS compared, count(*) FILTER (WHERE x = y)::BIGINT AS same, min(step) FILTER (WHERE x IS DISTINCT FROM y)::BIGINT AS first_difference FROM c GROUP BY pair"""
)
def trace_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's ordered trace beside the next user's: one full outer join on pair and step, and where the two first differ."""
    s = steps(spark, sf_dir).select("user_id", "step", "event_type")
    a = s.select(F.col("user_id").alias("pair"), "step", F.col("event_type").alias("x"))
    known = s.select(F.col("user_id").alias("pair")).distinct()
    b = s.select((F.col("user_id") - 1).alias("pair"), "step", F.col("event_type").alias("y")).join(known, "pair", "left_semi")
    both = a.join(b, ["pair", "step"], "full_outer")
    return both.groupBy(F.col("pair").alias("user_id")).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.col("x") == F.col("y")).alias("same"), F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("step"))).cast("long").alias("first_difference")
    )


@query(
    """WITH m AS (SELECT conv_id, map_from_entries(list({'k': role, 'v': n} ORDER BY role)) AS lanes FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY conv_id)
SELECT role, sum(n)::BIGINT AS n, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY role"""
)
def lane_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch (a conversation) has a map lane to count; shares come from the exploded maps."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    batches = counts.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("lanes"))
    lanes = batches.select(F.explode("lanes").alias("role", "n")).groupBy("role").agg(F.sum("n").alias("n"))
    return lanes.select("role", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # a row a role


DECISIONS_SQL = """d AS (SELECT event_id, user_id, event_type AS lane, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS score, row_number() OVER (PARTITION BY user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END ORDER BY value DESC, event_id) AS rank FROM events),
x AS (SELECT *, CASE WHEN score IS NULL THEN 'deferred' WHEN rank <= 20 THEN 'accepted' WHEN lane = 'signup' AND rank <= 40 THEN 'protected' ELSE 'rejected' END AS decision FROM d)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's pool: errors are deferred unscored, the best twenty are accepted, sign-ups are protected up to forty."""
    unscored = F.col("event_type") == "error"
    order = Window.partitionBy("user_id", unscored.cast("int")).orderBy(F.desc("value"), "event_id")
    d = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("lane"), F.when(~unscored, F.col("value")).alias("score"), F.row_number().over(order).alias("rank"))
    named = F.when(F.col("score").isNull(), "deferred").when(F.col("rank") <= 20, "accepted").when((F.col("lane") == "signup") & (F.col("rank") <= 40), "protected").otherwise("rejected")
    return d.withColumn("decision", named)


@query(f"WITH {DECISIONS_SQL} SELECT lane, count(*) FILTER (WHERE decision = 'accepted')::BIGINT AS accepted, count(*) FILTER (WHERE decision = 'deferred')::BIGINT AS deferred, count(*) FILTER (WHERE decision = 'protected')::BIGINT AS protected, count(*) FILTER (WHERE decision = 'rejected')::BIGINT AS rejected FROM x GROUP BY lane")
def decision_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["accepted", "deferred", "protected", "rejected"]
    return decisions(spark, sf_dir).groupBy("lane").pivot("decision", names).count().na.fill(0, names)


@query(
    f"""WITH {DECISIONS_SQL} SELECT user_id, count(score)::BIGINT AS judged, round(1 - count(*) FILTER (WHERE decision IN ('accepted', 'protected')) / nullif(count(score), 0), 6) AS step_rejection,
 round(1 - count(DISTINCT CASE WHEN decision IN ('accepted', 'protected') THEN lane END) / nullif(count(DISTINCT CASE WHEN score IS NOT NULL THEN lane END), 0), 6) AS supply_rejection, round(avg(score), 6) AS mean_score FROM x GROUP BY user_id"""
)
def rejection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rates: of judgements, and of distinct things judged; what was never scored counts in neither."""
    kept = F.col("decision").isin("accepted", "protected")
    some = lambda c: F.nullif(c, F.lit(0))
    return decisions(spark, sf_dir).groupBy("user_id").agg(
        F.count("score").alias("judged"),
        F.round(1 - F.count_if(kept) / some(F.count("score")), 6).alias("step_rejection"),
        F.round(1 - F.count_distinct(F.when(kept, F.col("lane"))) / some(F.count_distinct(F.when(F.col("score").isNotNull(), F.col("lane")))), 6).alias("supply_rejection"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


@query(f"WITH {DECISIONS_SQL}, k AS (SELECT user_id, lane FROM x WHERE decision = 'rejected' EXCEPT SELECT user_id, lane FROM x WHERE decision IN ('accepted', 'protected')) SELECT user_id, count(*)::BIGINT AS lanes_only_rejected FROM k GROUP BY user_id")
def only_rejected_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected minus kept, the set whose members must not have been served."""
    d = decisions(spark, sf_dir)
    gone = d.where("decision = 'rejected'").select("user_id", "lane").subtract(d.where("decision in ('accepted', 'protected')").select("user_id", "lane"))
    return gone.groupBy("user_id").agg(F.count(F.lit(1)).alias("lanes_only_rejected"))


@query(f"WITH {STEPS_SQL} SELECT (event_id % 4)::BIGINT AS rank, event_type, count(*)::BIGINT AS n FROM s GROUP BY 1, 2")
def rank_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy(F.pmod("event_id", F.lit(4)).alias("rank"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def select_in_rank_order(rows: list[tuple[int, str, float]], capacity: int, quota: dict[str, int], floors: dict[str, int]) -> list[tuple[int, str, str]]:
    """(id, decision, reason) of one step's pool: floors are served first, then merit, both in rank order; the batch is bounded."""
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    taken: dict[str, int] = {}
    out: dict[int, tuple[str, str]] = {}
    for by_floor in (True, False):
        for ident, lane, _ in order:
            if ident in out or (by_floor and taken.get(lane, 0) >= floors.get(lane, 0)):
                continue
            if sum(taken.values()) >= capacity:
                out[ident] = ("deferred", "batch_full")
            elif not by_floor and taken.get(lane, 0) >= quota.get(lane, capacity):
                out[ident] = ("deferred", "lane_quota_full")
            else:
                out[ident] = ("protected", "floor") if by_floor else ("accepted", "merit")
                taken[lane] = taken.get(lane, 0) + 1
    return [(i, *out[i]) for i, _, _ in sorted(rows)]


CHOSEN_SQL = f"""{STEPS_SQL}, o AS (SELECT user_id, step // 40 AS pool, event_id, event_type AS lane, value, row_number() OVER (PARTITION BY user_id, step // 40 ORDER BY value DESC, event_id) AS k, row_number() OVER (PARTITION BY user_id, step // 40, event_type ORDER BY value DESC, event_id) AS in_lane FROM s),
f AS (SELECT *, lane IN ('error', 'signup') AND in_lane <= 2 AS floored FROM o),
g AS (SELECT *, sum(CASE WHEN floored THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, pool) AS n_floor, CASE WHEN NOT floored AND in_lane <= 4 THEN 1 ELSE 0 END AS wants FROM f),
h AS (SELECT *, n_floor + sum(wants) OVER (PARTITION BY user_id, pool ORDER BY k) - wants AS before FROM g)"""


@query(
    f"""WITH {CHOSEN_SQL} SELECT user_id, pool::BIGINT AS pool, event_id, CASE WHEN floored THEN 'protected' WHEN before >= 12 OR wants = 0 THEN 'deferred' ELSE 'accepted' END AS decision,
 CASE WHEN floored THEN 'floor' WHEN before >= 12 THEN 'batch_full' WHEN wants = 0 THEN 'lane_quota_full' ELSE 'merit' END AS reason FROM h"""
)
def bounded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per step of a user's stream (forty events), a batch of twelve with floors for two lanes and a quota of four each.

    Admission depends on who was admitted before, so one step's pool, whose size is fixed, is one group.
    """
    import pandas as pd

    pools = steps(spark, sf_dir).select("user_id", F.floor(F.col("step") / 40).alias("pool"), "event_id", "event_type", "value")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["event_id"], pdf["event_type"], pdf["value"], strict=True))
        chosen = select_in_rank_order(rows, 12, dict.fromkeys(("view", "click", "purchase", "signup", "error"), 4), {"error": 2, "signup": 2})
        return pd.DataFrame(chosen, columns=["event_id", "decision", "reason"]).assign(user_id=pdf["user_id"].iloc[0], pool=pdf["pool"].iloc[0])

    return pools.groupBy("user_id", "pool").applyInPandas(choose, "user_id long, pool long, event_id long, decision string, reason string")
