"""The step planner with floors that carry over, and the ablation of spikes by what is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import fold_by_key
from corpusloom.plans.mixture import PLAN_SQL, largest_remainder, plan_tables
from corpusloom.plans.registry import query
from corpusloom.plans.windows import STEPS_SQL, steps

#: Events of a step's pool, slots of a batch, lanes in the order of their names, floors in per cent, first steps of the plan's stages.
POOL, SLOTS = 10, 8
LANES = ("click", "error", "purchase", "signup", "view")
FLOOR_PERCENT = (0, 15, 0, 12, 0)
STAGE_STEPS = (("warm", 0), ("main", 2), ("anneal", 5))


def plan_batch(delivered: tuple[int, ...], available: list[int], base: list[int], floors: tuple[int, ...] = FLOOR_PERCENT, slots: int = SLOTS) -> tuple[list[int], list[int], list[int]]:
    """(planned, served, needed) of one step, lane by lane.

    A lane whose pool is empty plans nothing. Floors that the stream so far has not reached come
    first; then slots are taken from the lane with most of them (the later name of equal ones), or
    given to it, until the batch is full. A lane that a floor raised neither gives nor takes.
    """
    there = [a > 0 for a in available]
    total = sum(delivered) + slots
    needed = [min(slots, max(0, -(-f * total // 100) - d)) if a else 0 for f, d, a in zip(floors, delivered, there, strict=True)]
    planned = [max(b, n) if a else 0 for b, n, a in zip(base, needed, there, strict=True)]
    free = [k for k, n in enumerate(needed) if there[k] and not n]
    while sum(planned) > slots:
        donor = max(((planned[k], k) for k in free if planned[k]), default=None)
        if donor is None:
            break
        planned[donor[1]] -= 1
    if free and sum(planned) < slots:
        planned[max((planned[k], k) for k in free)[1]] += slots - sum(planned)
    return planned, [min(p, a) for p, a in zip(planned, available, strict=True)], needed


def planned_steps(pools: DataFrame, branch: str = "user_id") -> DataFrame:
    """Plans of all steps of each branch, from rows (branch, step, available, base) in arrays by lane.

    What a step serves depends on all steps before, but only through five counts: a branch's steps
    stream through one task, which holds these.
    """

    def step(state: tuple[int, ...], row: tuple) -> tuple[tuple[int, ...], tuple]:
        planned, served, needed = plan_batch(state, list(row.available), list(row.base))
        unserved = sum(max(0, n - s) for n, s in zip(needed, served, strict=True))
        return tuple(d + s for d, s in zip(state, served, strict=True)), (getattr(row, branch), row.step, planned, served, needed, unserved)

    schema = f"{branch} long, step long, planned array<long>, served array<long>, needed array<long>, unserved long"
    return fold_by_key(pools, branch, "step", (0,) * len(LANES), step, schema)


LISTED = ", ".join(f"'{x}'" for x in LANES)
STAGE_SQL = "CASE " + " ".join(f"WHEN step >= {k} THEN '{s}'" for s, k in reversed(STAGE_STEPS)) + " END"
PLANNED_SQL = f"""{STEPS_SQL}, {PLAN_SQL},
qb AS (SELECT stage, lane, CAST(share AS DOUBLE) * {SLOTS} AS raw FROM sh), qr AS (SELECT *, floor(raw)::BIGINT AS low, row_number() OVER (PARTITION BY stage ORDER BY raw - floor(raw) DESC, lane) AS place FROM qb),
qs AS (SELECT stage, list(low + CASE WHEN place <= rest THEN 1 ELSE 0 END ORDER BY lane) AS base FROM (SELECT *, {SLOTS} - sum(low) OVER (PARTITION BY stage) AS rest FROM qr) GROUP BY stage),
pc AS (SELECT user_id, step // {POOL} AS step, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3),
pl AS (SELECT user_id, step, list_transform([{LISTED}], lambda x: coalesce(map_from_entries(list({{'k': event_type, 'v': n}}))[x], 0)) AS available FROM pc GROUP BY 1, 2),
pp AS (SELECT pl.*, qs.base FROM pl JOIN qs ON qs.stage = {STAGE_SQL}),
r(user_id, step, delivered, planned, served, needed) AS (
 SELECT user_id, -1::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::BIGINT[], NULL::BIGINT[], NULL::BIGINT[] FROM (SELECT DISTINCT user_id FROM pp)
 UNION ALL
 SELECT user_id, step, list_transform([1, 2, 3, 4, 5], lambda i: delivered[i] + least(planned[i], available[i])), planned, list_transform([1, 2, 3, 4, 5], lambda i: least(planned[i], available[i])), needed FROM (
  SELECT *, list_transform([1, 2, 3, 4, 5], lambda i: first_plan[i] - len(list_filter(given, lambda k: k % 10 = i)) + CASE WHEN takes % 10 = i THEN greatest(0, {SLOTS} - list_sum(first_plan)) ELSE 0 END)::BIGINT[] AS planned FROM (
   SELECT *, list_max(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN available[i] > 0 AND needed[i] = 0 THEN first_plan[i] * 10 + i END)) AS takes,
    list_reverse_sort(flatten(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN available[i] > 0 AND needed[i] = 0 THEN list_transform(range(1, first_plan[i] + 1), lambda h: h * 10 + i) ELSE [] END)))[1:greatest(0, list_sum(first_plan) - {SLOTS})] AS given FROM (
    SELECT *, list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN available[i] > 0 THEN greatest(base[i], needed[i]) ELSE 0 END)::BIGINT[] AS first_plan FROM (
     SELECT p.user_id, p.step::BIGINT AS step, p.available, p.base, r.delivered,
      list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN p.available[i] > 0 THEN least({SLOTS}, greatest(0, ({list(FLOOR_PERCENT)}[i] * (list_sum(r.delivered) + {SLOTS}) + 99) // 100 - r.delivered[i])) ELSE 0 END)::BIGINT[] AS needed
     FROM r JOIN pp p ON p.user_id = r.user_id AND p.step = r.step + 1)))))"""


@query(
    f"""WITH RECURSIVE {PLANNED_SQL} SELECT user_id, step, array_to_string(planned, ',') AS planned, array_to_string(served, ',') AS served, array_to_string(needed, ',') AS needed,
 CAST(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: greatest(0, needed[i] - served[i]))) AS BIGINT) AS unserved FROM r WHERE step >= 0"""
)
def step_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's stream in steps of ten events: what a batch of eight plans and serves of each lane, with floors that carry over when they were not served."""
    s = steps(spark, sf_dir).select("user_id", F.floor(F.col("step") / POOL).alias("step"), "event_type")
    available = F.array(*(F.count_if(F.col("event_type") == x) for x in LANES)).alias("available")
    pools = s.groupBy("user_id", "step").agg(available)
    _, shares, _ = plan_tables(spark)
    slots = largest_remainder(shares, SLOTS, ["stage"], "lane", "share")
    base = slots.groupBy("stage").agg(F.array_sort(F.collect_list(F.struct("lane", "slots")))["slots"].alias("base"))  # a row a stage
    stage = F.expr(STAGE_SQL)
    p = planned_steps(pools.withColumn("stage", stage).join(F.broadcast(base), "stage").select("user_id", "step", "available", "base"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return p.select("user_id", "step", joined("planned"), joined("served"), joined("needed"), "unserved")


# -- spikes

#: Events of a batch, batches looked back on, batches needed, score of a spike, share of it that a replay must reach again.
BATCH, BACK, NEEDED, SPIKE, AGAIN = 4, 8, 4, 4.0, 0.5
#: Twelve times a batch's mean in hundredths is an integer for batches of one to four.
UNIT = 12

BATCHES_SQL = f"""{STEPS_SQL}, e AS (SELECT user_id, step // {BATCH} AS batch, event_id, CAST(round(value * 100) AS BIGINT) AS x FROM s),
b AS (SELECT user_id, batch, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x) * {UNIT} // count(*) AS BIGINT) AS m FROM e GROUP BY 1, 2),
z AS (SELECT *, avg(m) OVER w AS mean, stddev_pop(m) OVER w AS sd, count(*) OVER w AS k FROM b WINDOW w AS (PARTITION BY user_id ORDER BY batch ROWS BETWEEN {BACK} PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (m - mean) / sd AS score FROM z WHERE k >= {NEEDED} AND sd > 0 AND (m - mean) / sd >= {SPIKE})"""


def batches(events: DataFrame) -> DataFrame:
    """user_id, batch, its rows and twelve times its mean, from (user_id, batch, event_id, x)."""
    b = events.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    return b.withColumn("m", F.expr(f"total * {UNIT} div n"))


def score(m, k, total, squares):  # noqa: ANN001, ANN201
    """Deviations of m from a baseline that is known by its count, sum and sum of squares, all integers."""
    spread = k * squares - total * total
    return F.when(spread > 0, (m * k - total) / F.sqrt(spread.cast("double")))


def spiking(series: DataFrame) -> DataFrame:
    """Batches that stand out from those before, with the sums of their baseline."""
    w = Window.partitionBy("user_id").orderBy("batch").rowsBetween(-BACK, -1)
    sums = {"k": F.count("m").over(w), "a": F.sum("m").over(w), "q": F.sum(F.col("m") * F.col("m")).over(w)}
    z = score(F.col("m"), F.col("k"), F.col("a"), F.col("q"))
    return series.withColumns(sums).withColumn("score", z).where((F.col("k") >= NEEDED) & (F.col("score") >= SPIKE))


def ablated(events: DataFrame) -> DataFrame:
    """Every spike with every suspect: what the score is when that row is left out of the batch, or that batch out of the baseline.

    Sums are integers and can be undone, so a suspect costs a subtraction and no second pass over its window.
    """
    series = batches(events)
    found = spiking(series)
    m, k, a, q = (F.col(c) for c in ("m", "k", "a", "q"))
    # A row of the spiking batch: the batch's mean without it, over the same baseline.
    rows = found.join(events.select("user_id", "batch", "event_id", "x"), ["user_id", "batch"])
    without = F.when(F.col("n") > 1, (F.col("total") - F.col("x")) * UNIT / (F.col("n") - 1))
    rows = rows.select("user_id", "batch", F.lit("row").alias("kind"), F.col("event_id").alias("suspect"), "score", score(without, k, a, q).alias("replayed"))
    # A batch of the baseline: its sums without it.
    back = found.withColumn("at", F.explode(F.sequence(F.col("batch") - BACK, F.col("batch") - 1)))
    other = series.select("user_id", F.col("batch").alias("at"), F.col("m").alias("y"))
    y = F.col("y")
    held = back.join(other, ["user_id", "at"]).select("user_id", "batch", F.lit("baseline").alias("kind"), F.col("at").alias("suspect"), "score", score(m, k - 1, a - y, q - y * y).alias("replayed"))
    return rows.unionByName(held).withColumn("reproduced", F.col("replayed") >= AGAIN * F.col("score"))


@query(
    f"""WITH {BATCHES_SQL},
r AS (SELECT p.user_id, p.batch, 'row' AS kind, e.event_id AS suspect, p.score, (SELECT avg(o.x) * {UNIT} FROM e o WHERE o.user_id = p.user_id AND o.batch = p.batch AND o.event_id <> e.event_id) AS left_, p.mean, p.sd FROM p JOIN e ON e.user_id = p.user_id AND e.batch = p.batch),
h AS (SELECT p.user_id, p.batch, p.m, p.score, x.batch AS suspect, avg(o.m) AS mean, stddev_pop(o.m) AS sd FROM p JOIN b x ON x.user_id = p.user_id AND x.batch BETWEEN p.batch - {BACK} AND p.batch - 1
 JOIN b o ON o.user_id = p.user_id AND o.batch BETWEEN p.batch - {BACK} AND p.batch - 1 AND o.batch <> x.batch GROUP BY 1, 2, 3, 4, 5),
u AS (SELECT user_id, batch, kind, suspect, score, (left_ - mean) / sd AS replayed FROM r UNION ALL SELECT user_id, batch, 'baseline', suspect, score, CASE WHEN sd > 0 THEN (m - mean) / sd END FROM h)
SELECT user_id, batch::BIGINT AS batch, kind, suspect::BIGINT AS suspect, round(score, 4) AS score, round(replayed, 4) AS replayed, replayed >= {AGAIN} * score AS reproduced FROM u"""
)
def spike_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes of batches of four events, and for each suspect whether at least half of the score is there again without it."""
    e = steps(spark, sf_dir).select("user_id", F.floor(F.col("step") / BATCH).alias("batch"), "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))
    a = ablated(e)
    return a.select("user_id", "batch", "kind", "suspect", F.round("score", 4).alias("score"), F.round("replayed", 4).alias("replayed"), "reproduced")


@query(
    f"""WITH {BATCHES_SQL}, r AS (SELECT p.user_id, p.batch, p.score, e.event_id, ((p.total - e.x) * {UNIT} / (p.n - 1.0) - p.mean) / p.sd AS replayed FROM p JOIN e ON e.user_id = p.user_id AND e.batch = p.batch WHERE p.n > 1)
SELECT user_id, batch::BIGINT AS batch, round(score, 4) AS score, count(*)::BIGINT AS suspects, count(*) FILTER (WHERE replayed < {AGAIN} * score)::BIGINT AS responsible,
 CASE count(*) FILTER (WHERE replayed < {AGAIN} * score) WHEN 0 THEN 'interaction' WHEN 1 THEN 'one_row' ELSE 'batch' END AS attribution FROM r GROUP BY user_id, batch, score"""
)
def spike_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each spike is put down to: one row, several that each carry it, or none of them alone."""
    e = steps(spark, sf_dir).select("user_id", F.floor(F.col("step") / BATCH).alias("batch"), "event_id", F.round(F.col("value") * 100).cast("long").alias("x"))
    a = ablated(e).where("kind = 'row' and replayed is not null").groupBy("user_id", "batch", "score")
    a = a.agg(F.count(F.lit(1)).alias("suspects"), F.count_if(~F.col("reproduced")).alias("responsible"))
    named = F.when(F.col("responsible") == 0, "interaction").when(F.col("responsible") == 1, "one_row").otherwise("batch")
    return a.select("user_id", "batch", F.round("score", 4).alias("score"), "suspects", "responsible", named.alias("attribution"))
