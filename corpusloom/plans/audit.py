"""Audit queries: batches and their decisions, selection with every reason, independent rescans, controls that break what must hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import GENESIS
from corpusloom.plans.ledger import CHAIN_SQL, DECISIONS_SQL, PAYLOAD_SQL, chained, decisions, live, payload
from corpusloom.plans.ledger import RETIRED_SQL
from corpusloom.plans.registry import query
from corpusloom.plans.windows import STEPS_SQL, steps
from corpusloom.sources.store import materialize
from corpusloom.sources.tables import table

#: A batch is sixteen consecutive events; the events of a user are the decisions about that user's pool.
BATCH = 16


@query(
    f"""WITH {RETIRED_SQL}, l AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = s.user_id AND r.step = s.step))
SELECT step::BIGINT AS step, min(event_id)::BIGINT AS first_live FROM l WHERE step % 10 = 0 GROUP BY step"""
)
def first_live_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups, all at once: the first live entry at each tenth step of any branch."""
    return live(spark, sf_dir).where("step % 10 = 0").groupBy(F.col("step").cast("long").alias("step")).agg(F.min("event_id").alias("first_live"))


@query(f"WITH {DECISIONS_SQL} SELECT event_id, user_id, lane, decision, round(score, 4) AS score FROM x WHERE decision = 'protected' OR lane = 'click' AND decision = 'rejected' AND (score IS NULL OR score < 5)")
def filtered_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by optional filters of lane, decision and score, where an unscored one passes the score filter."""
    d = decisions(spark, sf_dir)

    def pick(lane: str | None = None, decision: str | None = None, below: float | None = None) -> DataFrame:
        out = d
        for c, v in (("lane", lane), ("decision", decision)):
            out = out.where(F.col(c) == v) if v is not None else out
        return out.where(F.col("score").isNull() | (F.col("score") < below)) if below is not None else out

    both = pick(decision="protected").unionByName(pick("click", "rejected", 5.0))
    return both.select("event_id", "user_id", "lane", "decision", F.round("score", 4).alias("score"))


@query(
    f"""WITH {DECISIONS_SQL}, b AS (SELECT event_id // {BATCH} AS batch, list(event_id) AS ids FROM x GROUP BY 1), e AS (SELECT batch, unnest(ids) AS event_id FROM b)
SELECT batch::BIGINT AS batch, count(*)::BIGINT AS named, count(*) FILTER (WHERE decision IN ('accepted', 'protected'))::BIGINT AS admitted, count(*) FILTER (WHERE score IS NULL)::BIGINT AS unscored, round(max(score), 4) AS best FROM e JOIN x ON x.event_id = e.event_id GROUP BY batch"""
)
def batch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions that each batch names in a list: the lists are exploded and joined by equality."""
    d = decisions(spark, sf_dir)
    batches = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / BATCH).alias("batch")).agg(F.collect_list("event_id").alias("ids"))  # BATCH ids a row
    e = batches.select("batch", F.explode("ids").alias("event_id")).join(d, "event_id")
    return e.groupBy("batch").agg(
        F.count(F.lit(1)).alias("named"), F.count_if(F.col("decision").isin("accepted", "protected")).alias("admitted"), F.count_if(F.col("score").isNull()).alias("unscored"), F.round(F.max("score"), 4).alias("best")
    )


@query(f"WITH {DECISIONS_SQL}, k AS (SELECT user_id, lane, min(event_id) AS admitting FROM x WHERE decision IN ('accepted', 'protected') GROUP BY 1, 2) SELECT s.user_id, s.lane, k.admitting::BIGINT AS admitting FROM (SELECT DISTINCT user_id, lane FROM x) s LEFT JOIN k ON k.user_id = s.user_id AND k.lane = s.lane")
def admitting_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision that admitted each sample (a lane of a user), null where none did."""
    d = decisions(spark, sf_dir)
    admitting = F.min(F.when(F.col("decision").isin("accepted", "protected"), F.col("event_id")))
    return d.groupBy("user_id", "lane").agg(admitting.alias("admitting"))


#: Selection among a user's events: a batch of TARGET, at most QUOTA a lane, the reserve held back, some ids fenced off, some types out of the stage.
TARGET, QUOTA, FLOOR = 12, 5, 1
SELECTION_SQL = f"""c AS (SELECT event_id, user_id, event_type AS lane, value AS score, event_id % 37 = 0 AS fenced, event_id % 11 = 0 AS reserved, event_id % 7 = 0 AS off_band FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, fenced OR reserved OR off_band ORDER BY score DESC, event_id) AS place FROM c),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, lane, fenced OR reserved OR off_band ORDER BY place) AS in_lane FROM r),
k AS (SELECT *, count(*) FILTER (WHERE in_lane <= {QUOTA} AND NOT (fenced OR reserved OR off_band)) OVER (PARTITION BY user_id ORDER BY CASE WHEN fenced OR reserved OR off_band THEN 1 ELSE 0 END, place ROWS UNBOUNDED PRECEDING) AS taken FROM q),
d AS (SELECT *, CASE WHEN fenced THEN 'eval_overlap' WHEN reserved THEN 'reserved_for_anneal' WHEN off_band THEN 'off_band' WHEN in_lane > {QUOTA} THEN 'lane_quota_full' WHEN taken > {TARGET} AND in_lane <= {FLOOR} THEN 'protected_floor' WHEN taken > {TARGET} THEN 'below_proxy_threshold' END AS reason FROM k)"""


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the reason that decided it, null where it was accepted.

    Gates come first, and what they stop takes no place in the ranking. The rest is taken in rank
    order: a full lane passes its place on to the next candidate, and a lane without anything yet
    keeps its best one beyond the target. What is reserved is not scored.
    """
    gate = F.col("fenced") | F.col("reserved") | F.col("off_band")
    c = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("lane"), F.col("value").alias("score"), *((F.col("event_id") % m == 0).alias(n) for n, m in (("fenced", 37), ("reserved", 11), ("off_band", 7))))
    c = c.withColumn("stopped", gate.cast("int"))
    place = F.row_number().over(Window.partitionBy("user_id", "stopped").orderBy(F.desc("score"), "event_id"))
    in_lane = F.row_number().over(Window.partitionBy("user_id", "stopped", "lane").orderBy("place"))
    q = c.withColumn("place", place).withColumn("in_lane", in_lane)
    fits = (F.col("in_lane") <= QUOTA) & (F.col("stopped") == 0)
    q = q.withColumn("taken", F.count_if(fits).over(Window.partitionBy("user_id").orderBy("stopped", "place").rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("taken") > TARGET
    reason = (
        F.when(F.col("fenced"), "eval_overlap").when(F.col("reserved"), "reserved_for_anneal").when(F.col("off_band"), "off_band").when(F.col("in_lane") > QUOTA, "lane_quota_full")
        .when(over & (F.col("in_lane") <= FLOOR), "protected_floor").when(over, "below_proxy_threshold")
    )
    return q.withColumn("reason", reason)


@query(
    f"""WITH {SELECTION_SQL} SELECT event_id, user_id, lane, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'protected_floor' THEN 'protected' WHEN reason = 'reserved_for_anneal' THEN 'deferred' ELSE 'rejected' END AS decision, reason,
 CASE WHEN NOT reserved OR fenced THEN round(score, 4) END AS score, CASE WHEN NOT (fenced OR reserved OR off_band) THEN place END::BIGINT AS rank FROM d"""
)
def selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.col("reason")
    decision = F.when(reason.isNull(), "accepted").when(reason == "protected_floor", "protected").when(reason == "reserved_for_anneal", "deferred").otherwise("rejected")
    unscored = F.col("reserved") & ~F.col("fenced")
    return selection(spark, sf_dir).select(
        "event_id", "user_id", "lane", decision.alias("decision"), "reason", F.when(~unscored, F.round("score", 4)).alias("score"), F.when(F.col("stopped") == 0, F.col("place")).cast("long").alias("rank")
    )


@query(f"WITH {SELECTION_SQL} SELECT user_id, count(*) FILTER (WHERE reserved AND NOT fenced)::BIGINT AS held, count(*) FILTER (WHERE reserved AND NOT fenced AND event_id >= 5000)::BIGINT AS released, count(*) FILTER (WHERE reason IS NULL OR reason = 'protected_floor')::BIGINT AS served FROM d GROUP BY user_id")
def reserve_and_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reserve holds back, what of it the last stage (from event 5,000 on) releases, and what was served."""
    held = F.col("reserved") & ~F.col("fenced")
    return selection(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(held).alias("held"), F.count_if(held & (F.col("event_id") >= 5000)).alias("released"), F.count_if(F.col("reason").isNull() | (F.col("reason") == "protected_floor")).alias("served")
    )


@query(
    """WITH w AS (SELECT doc_id, sha256(text) AS h, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, sha256(text) AS h, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM w WHERE len(w) > 12)),
b AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) > 12)),
f AS (SELECT DISTINCT doc_id, item_id, 'containment' AS why FROM g JOIN b ON g.g = b.g UNION SELECT doc_id, item_id, 'identical' FROM w JOIN i ON w.h = i.h)
SELECT doc_id, string_agg(DISTINCT why, ',' ORDER BY why) AS reasons, count(DISTINCT item_id)::BIGINT AS items FROM f GROUP BY doc_id"""
)
def contamination_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination from the texts alone, by code that shares nothing with the admission gates: identity and 13-word runs.

    The benchmark's runs are hashed and sorted once; a document's runs are looked up where they are
    made, so nothing but hits leaves the scan. Hits are confirmed by the words themselves.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    runs = lambda w: F.when(F.size(w) > 12, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 12), lambda k: F.array_join(F.slice(w, k, F.lit(13)), " ")))).otherwise(F.array().cast("array<string>"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("h"), words(F.col("text")).alias("w"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), words(F.col("text")).alias("w"))
    inside = docs.select("doc_id", F.explode(runs(F.col("w"))).alias("g")).join(items.select("item_id", F.explode(runs(F.col("w"))).alias("g")), "g")
    found = inside.select("doc_id", "item_id", F.lit("containment").alias("why")).distinct()
    found = found.unionByName(docs.join(items, "h").select("doc_id", "item_id", F.lit("identical").alias("why")))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"), F.count_distinct("item_id").alias("items"))


@query(f"WITH RECURSIVE {CHAIN_SQL}, h AS (SELECT user_id, count(*)::BIGINT AS entries, max_by(entry_hash, step) AS head FROM c GROUP BY user_id) SELECT user_id, entries, head, 'intact' AS verdict FROM h")
def independent_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains checked a second way: entries and their predecessors are joined by hash, not by order, and the walk must cover the log once."""
    e = steps(spark, sf_dir).withColumn("payload", payload()).withColumn("step", F.col("step").cast("long"))
    ledger = chained(e, "user_id", "step", "payload").join(e.select("user_id", "step", "payload"), ["user_id", "step"])
    before = ledger.select("user_id", F.col("entry_hash").alias("prev_hash"), F.col("step").alias("step_before"))
    linked = ledger.join(before, ["user_id", "prev_hash"], "left")
    first = F.col("prev_hash") == GENESIS
    sound = F.sha2(F.concat("payload", "prev_hash"), 256) == F.col("entry_hash")
    sound &= (first & (F.col("step") == 0)) | (F.col("step_before") == F.col("step") - 1)
    out = linked.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", "step").alias("head"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("ok"), F.count_if(first).alias("starts"))
    return out.select("user_id", "entries", "head", F.when(F.col("ok") & (F.col("starts") == 1), "intact").otherwise("broken").alias("verdict"))


#: Recovery markers, as events tell them: an error is a crash, the next login a resume, and a sign-up after a crash a fork.
@query(
    f"""WITH {STEPS_SQL}, m AS (SELECT user_id, step, event_type, max(CASE WHEN event_type = 'error' THEN step END) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS crash, lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS before FROM s)
SELECT user_id, step::BIGINT AS step, CASE WHEN event_type = 'error' THEN 'crash' WHEN before = 'error' AND event_type = 'signup' THEN 'fork' ELSE 'resume' END AS marker, CASE WHEN event_type = 'error' THEN 4 ELSE 8 END::BIGINT AS world_size, crash::BIGINT AS after_crash FROM m WHERE event_type = 'error' OR before = 'error'"""
)
def recovery_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash, resume and fork rows with the world size that held, and the crash each one follows."""
    w = Window.partitionBy("user_id").orderBy("step")
    m = steps(spark, sf_dir).withColumns({"before": F.lag("event_type").over(w), "crash": F.max(F.when(F.col("event_type") == "error", F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    crash = F.col("event_type") == "error"
    marker = F.when(crash, "crash").when(F.col("event_type") == "signup", "fork").otherwise("resume")
    return m.where(crash | (F.col("before") == "error")).select(
        "user_id", F.col("step").cast("long").alias("step"), marker.alias("marker"), F.when(crash, 4).otherwise(8).cast("long").alias("world_size"), F.col("crash").cast("long").alias("after_crash")
    )


#: Edits of a log, and the check that must refuse it.
CONTROLS = {
    "payload_edited": "entry_hash", "entry_dropped": "sequence", "entry_repeated": "sequence", "order_swapped": "link", "head_replaced": "link",
    "rehashed": "link", "spliced": "link", "last_removed": "count", "first_removed": "sequence", "renumbered": "sequence",
}


@query(f"WITH c(control, caught_by) AS (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for a, b in CONTROLS.items())}), n AS (SELECT count(*)::BIGINT AS u FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 4)) SELECT control, caught_by, u AS applied, u AS refused FROM c, n")
def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each invariant of a chained log is broken on purpose in the middle of every user's whole log (of four entries or more), and the named check must refuse it every time.

    The checks know a log, its number of entries as a manifest has it, and nothing of the edit.
    """
    e = steps(spark, sf_dir).withColumn("payload", payload()).withColumn("step", F.col("step").cast("long"))
    sizes = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    ledger = chained(e, "user_id", "step", "payload", with_body=True).join(sizes, "user_id")
    ledger = materialize(ledger.withColumn("middle", F.floor(F.col("n") / 2)), "ledger")
    at = F.col("step") == F.col("middle")
    other = lambda c, x: F.when(at, x).otherwise(F.col(c))
    forged = F.concat("payload", F.lit("?"))
    edited = {
        "payload_edited": ledger.withColumn("payload", other("payload", forged)),
        "entry_dropped": ledger.where(~at),
        "entry_repeated": ledger.unionByName(ledger.where(at)),
        "order_swapped": ledger.withColumn("step", F.when(F.col("step") == F.col("middle") - 1, F.col("middle")).otherwise(other("step", F.col("middle") - 1))),
        "head_replaced": ledger.withColumn("prev_hash", F.when(F.col("step") == 0, F.lit("f" * 64)).otherwise(F.col("prev_hash"))),
        # The edited entry has a hash of its own again, which the next one does not know.
        "rehashed": ledger.withColumns({"payload": other("payload", forged), "entry_hash": other("entry_hash", F.sha2(F.concat(forged, "prev_hash"), 256))}),
        # An entry that is sound, but follows from another beginning.
        "spliced": ledger.withColumns({"prev_hash": other("prev_hash", F.sha2("prev_hash", 256)), "entry_hash": other("entry_hash", F.sha2(F.concat("payload", F.sha2("prev_hash", 256)), 256))}),
        "last_removed": ledger.where(F.col("step") < F.col("n") - 1),
        "first_removed": ledger.where("step > 0"),
        "renumbered": ledger.withColumn("step", F.when(F.col("step") >= F.col("middle"), F.col("step") + 1).otherwise(F.col("step"))),
    }
    # An entry's own hash is checked where it is; what travels to its neighbours are the bytes of two hashes.
    sound = F.sha2(F.concat("payload", "prev_hash"), 256) == F.col("entry_hash")
    slim = lambda log: log.select("user_id", "step", "n", F.unhex("prev_hash").alias("prev_hash"), F.unhex("entry_hash").alias("entry_hash"), sound.alias("sound"))
    everything = reduce(DataFrame.unionByName, (slim(log).withColumn("control", F.lit(name)) for name, log in edited.items()))
    w = Window.partitionBy("control", "user_id").orderBy("step")
    checked = everything.withColumns({"due": F.row_number().over(w) - 1, "link": F.coalesce(F.lag("entry_hash").over(w), F.unhex(F.lit(GENESIS)))})
    failed = {
        "entry_hash": ~F.col("sound") & (F.col("prev_hash") == F.col("link")),
        "sequence": F.col("step") != F.col("due"),
        "link": F.col("prev_hash") != F.col("link"),
    }
    by_user = checked.groupBy("control", "user_id").agg(*(F.bool_or(c).alias(n) for n, c in failed.items()), (F.count(F.lit(1)) != F.first("n")).alias("count"))
    caught = F.when(F.col("sequence"), "sequence").when(F.col("link"), "link").when(F.col("entry_hash"), "entry_hash").when(F.col("count"), "count")
    expected = spark.createDataFrame(list(CONTROLS.items()), "control string, caught_by string")
    return by_user.join(F.broadcast(expected), "control").groupBy("control", "caught_by").agg(F.count(F.lit(1)).alias("applied"), F.count_if(caught == F.col("caught_by")).alias("refused"))


#: Kinds of events that every branch is to have had, and the step before which.
EXPECTED, BEFORE = ("click", "error", "purchase", "signup", "view"), 8


@query(f"WITH {STEPS_SQL} SELECT user_id, missing_control FROM ((SELECT user_id, unnest({list(EXPECTED)}) AS missing_control FROM (SELECT DISTINCT user_id FROM s)) EXCEPT ALL (SELECT DISTINCT user_id, event_type FROM s WHERE step < {BEFORE}))")
def controls_not_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls that a branch declared and did not produce in its first steps: what is expected of each, minus what its log has."""
    s = steps(spark, sf_dir).select("user_id", "event_type", "step")
    declared = s.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, EXPECTED))).alias("missing_control"))
    return declared.exceptAll(s.where(F.col("step") < BEFORE).select("user_id", "event_type").distinct())


@query(
    f"""WITH {STEPS_SQL}, a AS (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM s GROUP BY 1, 2), h AS (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM s WHERE step % 2 = 0 GROUP BY 1, 2)
SELECT a.user_id, count(*) FILTER (WHERE abs(a.n / a.t - coalesce(h.n / h.t, 0)) > 0.1)::BIGINT AS off, round(max(abs(a.n / a.t - coalesce(h.n / h.t, 0))), 6) AS largest FROM a LEFT JOIN h ON h.user_id = a.user_id AND h.event_type = a.event_type GROUP BY a.user_id"""
)
def map_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of shares key by key, a missing key being zero: each user's event types in all steps and in every other one."""
    s = steps(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("step") % 2 == 0).alias("m"))
    shares = s.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("b"), F.sum("n").alias("ta"), F.sum("m").alias("tb"))
    gap = F.map_zip_with("a", "b", lambda k, x, y: F.abs(F.coalesce(x, F.lit(0)) / F.col("ta") - F.coalesce(F.try_divide(y, F.col("tb")), F.lit(0))))
    gaps = F.map_values(gap)
    return shares.select("user_id", F.size(F.filter(gaps, lambda g: g > 0.1)).cast("long").alias("off"), F.round(F.array_max(gaps), 6).alias("largest"))


@query(f"WITH {STEPS_SQL}, x AS (SELECT user_id, step, {PAYLOAD_SQL} AS p FROM s), f AS (SELECT user_id, sha256(string_agg(p, '|' ORDER BY step)) AS h, count(*)::BIGINT AS n FROM x GROUP BY user_id) SELECT user_id, n, h AS run_hash, TRUE AS same FROM f")
def determinism_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of every branch's trace, dealt differently over tasks, must have one hash."""

    def trace(s: DataFrame) -> DataFrame:
        entry = F.struct("step", payload().alias("p"))
        return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(entry))["p"], "|"), 256).alias("run_hash"))

    once = trace(steps(spark, sf_dir))
    again = trace(steps(spark, sf_dir).repartition(7, "event_id")).select("user_id", F.col("run_hash").alias("second"))
    return once.join(again, "user_id").select("user_id", "n", "run_hash", (F.col("run_hash") == F.col("second")).alias("same"))
