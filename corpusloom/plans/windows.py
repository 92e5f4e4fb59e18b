"""Ordered-scan computations over the event series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

#: Fixed values of the spike rule: rows looked back on, rows needed, score that fires.
LOOK_BACK, NEEDED, SCORE = 8, 4, 4.0


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as a series: step counts from 0 in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value", (F.row_number().over(order) - 1).alias("step"))


STEPS_SQL = "s AS (SELECT event_id, user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"
SPIKE_SQL = f"""{STEPS_SQL}, z AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
spikes AS (SELECT event_id, user_id, step, value, round((value - mean) / sd, 4) AS z FROM z WHERE n >= 4 AND sd > 1e-12 AND (value - mean) / sd >= 4.0)"""


def spikes(series: DataFrame, key: str = "user_id", step: str = "step", metric: str = "value") -> DataFrame:
    """Rows whose metric is at least SCORE population deviations above the mean of the rows before; they do not see themselves."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(-LOOK_BACK, -1)
    looked = series.withColumns({"mean": F.avg(metric).over(w), "sd": F.stddev_pop(metric).over(w), "n_before": F.count(F.lit(1)).over(w)})
    z = (F.col(metric) - F.col("mean")) / F.col("sd")
    return looked.where((F.col("n_before") >= NEEDED) & (F.col("sd") > 1e-12)).withColumn("z", z).where(F.col("z") >= SCORE)


@query(f"WITH {SPIKE_SQL} SELECT * FROM spikes")
def trailing_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(steps(spark, sf_dir)).select("event_id", "user_id", "step", "value", F.round("z", 4).alias("z"))


@query(f"WITH {SPIKE_SQL} SELECT s.event_id, count(*) > 0 AS unsafe FROM s JOIN spikes k ON s.user_id = k.user_id AND s.step BETWEEN k.step - 1 AND k.step + 1 GROUP BY s.event_id")
def unsafe_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within one step of a spike: the small window is exploded, so the join stays an equi-join."""
    s = steps(spark, sf_dir)
    near = spikes(s).select("user_id", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step")).distinct()
    return s.join(near, ["user_id", "step"]).select("event_id", F.lit(True).alias("unsafe"))


@query(f"WITH {STEPS_SQL} SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY step), 4) AS delta FROM s")
def delta_to_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("step")
    return steps(spark, sf_dir).select("event_id", F.round(F.col("value") - F.lag("value").over(w), 4).alias("delta"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1")
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each key as an aggregate: map-side it keeps one row per key, which a window would not."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("e"))
    return last.select("user_id", "event_type", "e.event_id", "e.value")


def ema(values: Column, keep: float = 0.95, start: Column | None = None) -> Column:
    """Exponential mean over an ordered array, from the first value or a carried one."""
    first = start if start is not None else F.element_at(values, 1)
    rest = values if start is not None else F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, first.cast("double"), lambda s, x: s * keep + x * (1 - keep))


@query(
    f"""WITH RECURSIVE {STEPS_SQL}, e(user_id, step, ema) AS (SELECT user_id, step, value FROM s WHERE step = 0 UNION ALL SELECT s.user_id, s.step, 0.95 * e.ema + 0.05 * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.step = e.step + 1)
SELECT user_id, round(arg_max(ema, step), 4) AS ema, (max(step) + 1)::BIGINT AS n FROM e GROUP BY user_id"""
)
def smoothed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean of each user's values: a block of steps is weighted on its own, and blocks are joined by what each keeps of the ones before.

    The first value counts whole, every other one with a twentieth, and each later step keeps 0.95.
    """
    block = 64
    s = steps(spark, sf_dir).select("user_id", "step", "value", F.floor(F.col("step") / block).alias("block"))
    weight = F.when(F.col("step") == 0, 1.0).otherwise(0.05) * F.pow(F.lit(0.95), (F.col("block") + 1) * block - 1 - F.col("step"))
    parts = s.groupBy("user_id", "block").agg(F.sum(weight * F.col("value")).alias("part"), F.count(F.lit(1)).alias("n"))
    # A block's sum is what it would be at the block's end; the last step of all says how far back that is.
    total = parts.groupBy("user_id").agg(F.sum("n").alias("n"))
    back = (F.col("n_all") - 1) - ((F.col("block") + 1) * block - 1)
    joined = parts.join(total.withColumnRenamed("n", "n_all"), "user_id").withColumn("at_end", F.col("part") * F.pow(F.lit(0.95), back))
    return joined.groupBy("user_id").agg(F.round(F.sum("at_end"), 4).alias("ema"), F.first("n_all").alias("n"))


@query(
    f"""WITH {STEPS_SQL}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY step) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY step) - 1 AS segment FROM c)
SELECT event_id, segment::BIGINT AS segment, (row_number() OVER (PARTITION BY user_id, segment ORDER BY step) - 1)::BIGINT AS position FROM g"""
)
def segment_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments begin where the owner changes; positions start anew in each."""
    w = Window.partitionBy("user_id").orderBy("step")
    changed = F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)
    g = steps(spark, sf_dir).withColumn("new", changed).withColumn("segment", (F.sum("new").over(w) - 1).cast("long"))
    return g.select("event_id", "segment", (F.row_number().over(Window.partitionBy("user_id", "segment").orderBy("step")) - 1).cast("long").alias("position"))


@query(
    f"""WITH {STEPS_SQL}, g AS (SELECT *, epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY step)) AS gap FROM s), h AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY step) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, round(sum(value), 3) AS total FROM h GROUP BY user_id, session"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("step")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(w))
    s = steps(spark, sf_dir).withColumn("new", F.when(gap.isNull() | (gap > 3600), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(
    f"""WITH {STEPS_SQL}, b AS (SELECT user_id, step // 8 AS block, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY n DESC, event_type) AS place FROM b)
SELECT user_id, block::BIGINT AS block, event_type AS label, n::BIGINT AS n FROM r WHERE place = 1"""
)
def block_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common type of every eight events, ties to the first name."""
    counts = steps(spark, sf_dir).groupBy("user_id", F.floor(F.col("step") / 8).alias("block"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("user_id", "block").agg(F.min(F.struct((-F.col("n")).alias("minus"), "event_type")).alias("b"))
    return best.select("user_id", "block", F.col("b.event_type").alias("label"), (-F.col("b.minus")).alias("n"))


@query(
    """WITH r AS (SELECT o_custkey, o_totalprice AS v, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS next FROM orders)
SELECT o_custkey, round(max(v / next), 6) AS largest_gap FROM r WHERE next > 0 GROUP BY o_custkey"""
)
def largest_supply_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest ratio of a value to the next lower one."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / F.lead("o_totalprice").over(w)).alias("ratio"))
    return r.where("ratio is not null").groupBy("o_custkey").agg(F.round(F.max("ratio"), 6).alias("largest_gap"))


@query(
    f"""WITH {STEPS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM s), d AS (SELECT user_id, least(9, floor(step / total * 10))::BIGINT AS decile, avg(value) AS mean FROM n GROUP BY 1, 2)
SELECT decile, round(avg(mean), 4) AS mean, round(min(mean), 4) AS least, round(max(mean), 4) AS most, count(*)::BIGINT AS n_users FROM d GROUP BY decile"""
)
def position_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = steps(spark, sf_dir).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    decile = F.least(F.lit(9), F.floor(F.col("step") / F.col("total") * 10)).cast("long")
    d = n.groupBy("user_id", decile.alias("decile")).agg(F.avg("value").alias("m"))
    return d.groupBy("decile").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.min("m"), 4).alias("least"), F.round(F.max("m"), 4).alias("most"), F.count(F.lit(1)).alias("n_users"))


@query(
    f"""WITH {STEPS_SQL}, b AS (SELECT user_id, avg(value) FILTER (WHERE step < 20) AS mean, stddev_samp(value) FILTER (WHERE step < 20) AS sd FROM s GROUP BY user_id),
z AS (SELECT s.user_id, s.step, (s.value - b.mean) / b.sd AS z FROM s JOIN b ON s.user_id = b.user_id WHERE s.step >= 20 AND b.sd > 0)
SELECT user_id, min(step) FILTER (WHERE z > 2)::BIGINT AS first_shift, round(max(z), 4) AS peak FROM z GROUP BY user_id"""
)
def fixed_baseline_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First step whose score against the first twenty passes two, and the highest score after them."""
    s = steps(spark, sf_dir)
    early = F.when(F.col("step") < 20, F.col("value"))
    base = s.groupBy("user_id").agg(F.avg(early).alias("mean"), F.stddev_samp(early).alias("sd")).where("sd > 0")
    z = s.where("step >= 20").join(base, "user_id").select("user_id", "step", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))
    return z.groupBy("user_id").agg(F.min(F.when(F.col("z") > 2, F.col("step"))).cast("long").alias("first_shift"), F.round(F.max("z"), 4).alias("peak"))


@query(
    """WITH h AS (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS hour FROM events), a AS (SELECT user_id, hour, count(*) AS n FROM h GROUP BY 1, 2), b AS (SELECT user_id, min(hour) AS lo, max(hour) AS hi, count(*) AS seen FROM a GROUP BY user_id)
SELECT b.user_id, (hi - lo + 1 - seen)::BIGINT AS missing, (SELECT count(*) FROM a WHERE a.user_id = b.user_id AND n > 1)::BIGINT AS repeated FROM b"""
)
def gaps_and_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each user's span without an event, and hours with more than one."""
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600).alias("hour")
    counts = table(spark, sf_dir, "events").groupBy("user_id", hour).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg((F.max("hour") - F.min("hour") + 1 - F.count(F.lit(1))).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("WITH m AS (SELECT event_type, min(value) AS least FROM events GROUP BY event_type) SELECT e.event_type, round(exp(avg(ln(value + 1))), 4) AS geo_mean, count(*)::BIGINT AS n FROM events e JOIN m ON m.event_type = e.event_type AND value <= least + 5 GROUP BY e.event_type")
def near_minimum_geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric mean over the rows within five of each type's minimum."""
    e = table(spark, sf_dir, "events")
    least = e.groupBy("event_type").agg(F.min("value").alias("least"))
    near = e.join(least, "event_type").where("value <= least + 5")
    return near.groupBy("event_type").agg(F.round(F.exp(F.avg(F.ln(F.col("value") + 1))), 4).alias("geo_mean"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {STEPS_SQL} SELECT user_id, (step // 16)::BIGINT AS win, count(*)::BIGINT AS n, round(min(value), 4) AS least, round(max(value), 4) AS most FROM s GROUP BY 1, 2"""
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of sixteen events that do not overlap."""
    return steps(spark, sf_dir).groupBy("user_id", F.floor(F.col("step") / 16).alias("win")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most")
    )
