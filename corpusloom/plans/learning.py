"""Learning analytics over observations; an event's scaled value stands in for a token's loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.plans.windows import STEPS_SQL, steps

#: Perplexity from which a token is hot, loss an exponent is cut at, and class limits.
HOT, LARGEST_LOSS, USEFUL, EXCESS = 50.0, 30.0, 0.002, 0.05
OBS_SQL = f"{STEPS_SQL}, o AS (SELECT event_id, user_id, event_type AS lane, step, value / 100.0 AS loss, (event_id % 7) / 10.0 + 1.5 AS reference, CASE WHEN step < 40 THEN 'early' WHEN step < 100 THEN 'mid' ELSE 'late' END AS phase FROM s)"


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(LARGEST_LOSS)))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("step") < 40, "early").when(F.col("step") < 100, "mid").otherwise("late")
    return steps(spark, sf_dir).select(
        "event_id", "user_id", F.col("event_type").alias("lane"), "step", (F.col("value") / 100.0).alias("loss"), ((F.col("event_id") % 7) / 10.0 + 1.5).alias("reference"), phase.alias("phase")
    )


@query(
    f"""WITH {OBS_SQL} SELECT lane, phase, grouping(lane)::INTEGER AS g_lane, grouping(phase)::INTEGER AS g_phase, count(*)::BIGINT AS n, round(avg(loss), 6) AS mean_loss, round(exp(least(avg(loss), 30)), 4) AS geo_ppl,
 round(100.0 * count(*) FILTER (WHERE exp(least(loss, 30)) >= 50) / count(*), 2) AS hot_pct FROM o GROUP BY GROUPING SETS ((lane), (phase), (lane, phase), ())"""
)
def loss_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions in one pass by grouping sets."""
    o = observations(spark, sf_dir)
    sets = o.groupingSets([["lane"], ["phase"], ["lane", "phase"], []], "lane", "phase")
    return sets.agg(
        F.grouping("lane").cast("int").alias("g_lane"),
        F.grouping("phase").cast("int").alias("g_phase"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("loss"), 6).alias("mean_loss"),
        F.round(perplexity(F.avg("loss")), 4).alias("geo_ppl"),
        F.round(F.count_if(perplexity(F.col("loss")) >= HOT) * 100.0 / F.count(F.lit(1)), 2).alias("hot_pct"),
    )


def quadrant(loss: Column, reference: Column, cut: Column) -> Column:
    excess = loss - reference
    hard = F.when(excess > EXCESS, "learnable_hard").otherwise("irreducible_hard")
    return F.when(loss >= cut, hard).otherwise(F.when(excess < -EXCESS, "saturating").otherwise("already_learned"))


@query(
    f"""WITH {OBS_SQL}, q AS (SELECT lane, loss - reference AS excess, CASE WHEN loss >= 1.8 THEN CASE WHEN loss - reference > 0.05 THEN 'learnable_hard' ELSE 'irreducible_hard' END WHEN loss - reference < -0.05 THEN 'saturating' ELSE 'already_learned' END AS quadrant FROM o)
SELECT lane, quadrant, count(*)::BIGINT AS n, round(avg(excess), 6) AS mean_excess, round(count(*) / sum(count(*)) OVER (PARTITION BY lane), 4) AS share FROM q GROUP BY lane, quadrant"""
)
def excess_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    q = o.select("lane", (F.col("loss") - F.col("reference")).alias("excess"), quadrant(F.col("loss"), F.col("reference"), F.lit(1.8)).alias("quadrant"))
    n = q.groupBy("lane", "quadrant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("excess"), 6).alias("mean_excess"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lane")), 4))


@query(
    f"""WITH {OBS_SQL}, t AS (SELECT user_id, lane, arg_min(loss, step) AS first, arg_max(loss, step) AS last, count(*) AS n FROM o GROUP BY 1, 2)
SELECT CASE WHEN first >= 1 AND last >= 1 THEN 'H_to_H' WHEN first >= 1 THEN 'H_to_L' WHEN last >= 1 THEN 'L_to_H' ELSE 'L_to_L' END AS class, count(*)::BIGINT AS n, round(avg(last - first), 6) AS mean_delta FROM t WHERE n > 1 GROUP BY 1"""
)
def trajectory_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last loss of everything seen more than once."""
    t = observations(spark, sf_dir).groupBy("user_id", "lane").agg(F.min_by("loss", "step").alias("first"), F.max_by("loss", "step").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = F.concat(F.when(F.col("first") >= 1, "H").otherwise("L"), F.lit("_to_"), F.when(F.col("last") >= 1, "H").otherwise("L"))
    return t.groupBy(named.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("last") - F.col("first")), 6).alias("mean_delta"))


@query(
    f"""WITH {OBS_SQL}, d AS (SELECT *, lag(loss) OVER (PARTITION BY user_id, lane ORDER BY step) - loss AS delta FROM o), p AS (SELECT user_id, lane, phase, avg(delta) AS delta, avg(CASE WHEN exp(least(loss, 30)) >= 50 THEN 100.0 ELSE 0 END) AS hot FROM d GROUP BY 1, 2, 3),
c AS (SELECT user_id, lane, arg_max(phase, (delta, phase)) AS best_phase, sum(delta) AS total, max(delta) AS most, min(delta) AS least, avg(hot) AS hot FROM p WHERE delta IS NOT NULL GROUP BY 1, 2)
SELECT user_id, lane, best_phase, round(total + 1e-9, 4) AS total_delta, CASE WHEN most > 0.002 AND least < -0.002 THEN 'phase_guard' WHEN total <= 0 THEN 'delay_or_reclean' WHEN hot > 40 THEN 'keep_with_phase_guard' ELSE 'protect_or_upsample' END AS action FROM c"""
)
def report_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card per shard (a user's lane): loss movement by phase and what follows from it; a little is added so that no sum lies halfway when it is rounded."""
    w = Window.partitionBy("user_id", "lane").orderBy("step")
    d = observations(spark, sf_dir).withColumn("delta", F.lag("loss").over(w) - F.col("loss"))
    p = d.groupBy("user_id", "lane", "phase").agg(F.avg("delta").alias("delta"), F.avg(F.when(perplexity(F.col("loss")) >= HOT, 100.0).otherwise(0.0)).alias("hot")).where("delta is not null")
    c = p.groupBy("user_id", "lane").agg(
        F.max(F.struct("delta", "phase")).alias("best"), F.sum("delta").alias("total"), F.max("delta").alias("most"), F.min("delta").alias("least"), F.avg("hot").alias("hot")
    )
    action = (
        F.when((F.col("most") > USEFUL) & (F.col("least") < -USEFUL), "phase_guard")
        .when(F.col("total") <= 0, "delay_or_reclean")
        .when(F.col("hot") > 40, "keep_with_phase_guard")
        .otherwise("protect_or_upsample")
    )
    return c.select("user_id", "lane", F.col("best.phase").alias("best_phase"), F.round(F.col("total") + 1e-9, 4).alias("total_delta"), action.alias("action"))


@query(
    f"""WITH {OBS_SQL}, l AS (SELECT user_id, arg_max(exp(least(loss, 30)), step) AS ppl, count(*) AS exposures FROM o GROUP BY user_id), m AS (SELECT median(ppl) AS med FROM l)
SELECT user_id, round(ppl / med, 4) AS ratio, exposures::BIGINT AS exposures, CASE WHEN ppl / med >= 1.2 THEN 'harder_place_earlier' WHEN ppl / med <= 1 / 1.2 THEN 'easier_do_not_repeat' ELSE 'typical_keep' END AS action FROM l CROSS JOIN m"""
)
def reuse_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last perplexity against the median of all."""
    last = observations(spark, sf_dir).groupBy("user_id").agg(F.max_by(perplexity(F.col("loss")), "step").alias("ppl"), F.count(F.lit(1)).alias("exposures"))
    # The median is taken from the counts of distinct values, which are made in each task first.
    ratio = F.col("ppl") / F.col("med")
    action = F.when(ratio >= 1.2, "harder_place_earlier").when(ratio <= 1 / 1.2, "easier_do_not_repeat").otherwise("typical_keep")
    return last.crossJoin(F.broadcast(last.agg(F.median("ppl").alias("med")))).select("user_id", F.round(ratio, 4).alias("ratio"), "exposures", action.alias("action"))  # one median


@query(
    f"""WITH {OBS_SQL}, z AS (SELECT *, avg(loss) OVER w AS mean, stddev_pop(loss) OVER w AS sd, count(*) OVER w AS k FROM o WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
b AS (SELECT user_id, step FROM z WHERE k >= 4 AND sd > 1e-12 AND (loss - mean) / sd >= 4), u AS (SELECT DISTINCT user_id, step + k AS step FROM b CROSS JOIN (SELECT unnest([-1, 0, 1]) AS k))
SELECT CASE WHEN u.step IS NOT NULL THEN 'withheld' WHEN d > 0.002 THEN 'useful' WHEN d < -0.002 THEN 'harmful' ELSE 'neutral' END AS verdict, count(*)::BIGINT AS n FROM (SELECT user_id, step, lag(loss) OVER (PARTITION BY user_id ORDER BY step) - loss AS d FROM o) x LEFT JOIN u ON u.user_id = x.user_id AND u.step = x.step GROUP BY 1"""
)
def attributed_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts are withheld within a step of a spike."""
    from corpusloom.plans.windows import spikes

    o = observations(spark, sf_dir)
    unsafe = spikes(o, metric="loss").select("user_id", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step")).distinct().withColumn("unsafe", F.lit(True))
    d = o.select("user_id", "step", (F.lag("loss").over(Window.partitionBy("user_id").orderBy("step")) - F.col("loss")).alias("d")).join(unsafe, ["user_id", "step"], "left")
    named = F.when(F.col("unsafe"), "withheld").when(F.col("d") > USEFUL, "useful").when(F.col("d") < -USEFUL, "harmful").otherwise("neutral")
    return d.groupBy(named.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS place FROM o) SELECT user_id, count(*)::BIGINT AS kept, round(avg(loss), 6) AS mean_loss FROM r WHERE (place - 1) % 5 = 0 GROUP BY user_id")
def tier_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling tier that keeps every fifth observation of a user."""
    w = Window.partitionBy("user_id").orderBy("step")
    r = observations(spark, sf_dir).withColumn("place", F.row_number().over(w))
    return r.where((F.col("place") - 1) % 5 == 0).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("loss"), 6).alias("mean_loss"))


@query(
    f"""WITH {OBS_SQL}, j AS (SELECT lane, octet_length(encode('{{"user_id":' || user_id || ',"step":' || step || ',"lane":"' || lane || '"}}')) AS b FROM o)
SELECT lane, count(*)::BIGINT AS n, round(avg(b), 2) AS bytes_each, (sum(b) * 1000)::BIGINT AS bytes_at_1000x FROM j GROUP BY lane"""
)
def ledger_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of an observation's key as JSON by lane, and at a thousand times the rows."""
    o = observations(spark, sf_dir)
    size = F.octet_length(F.to_json(F.struct("user_id", "step", "lane")))
    return o.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(size), 2).alias("bytes_each"), (F.sum(size) * 1000).alias("bytes_at_1000x"))


@query(f"WITH {OBS_SQL} SELECT lane, sum(CASE WHEN step % 4 = 0 THEN 8 ELSE 16 END)::BIGINT AS tokens, round(sum(loss), 4) AS seconds, round(sum(CASE WHEN step % 4 = 0 THEN 8 ELSE 16 END) / sum(loss), 4) AS rate, round(count(*) FILTER (WHERE step % 4 <> 0) / count(*), 4) AS useful FROM o GROUP BY lane")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(F.when(F.col("step") % 4 == 0, 8).otherwise(16))
    return observations(spark, sf_dir).groupBy("lane").agg(
        tokens.alias("tokens"), F.round(F.sum("loss"), 4).alias("seconds"), F.round(tokens / F.sum("loss"), 4).alias("rate"), F.round(F.count_if(F.col("step") % 4 != 0) / F.count(F.lit(1)), 4).alias("useful")
    )
