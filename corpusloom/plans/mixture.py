"""Mixture plans: quotas, seams, floors, feasibility and water-filled allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import running_sums
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table


def largest_remainder(shares: DataFrame, slots: int, by: list[str], name: str, share: str) -> DataFrame:
    """Integer slots that add up to ``slots`` in each group: floors, then one each by largest fraction, ties by name."""
    raw = F.col(share) * slots
    w = Window.partitionBy(*by)
    based = shares.withColumns({"base": F.floor(raw).cast("long"), "fraction": raw - F.floor(raw)})
    place = F.row_number().over(w.orderBy(F.desc("fraction"), name))
    return based.withColumn("slots", F.col("base") + F.when(place <= slots - F.sum("base").over(w), 1).otherwise(0)).drop("base", "fraction")


@query(
    """WITH s AS (SELECT lang, source, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY lang, source),
b AS (SELECT *, floor(share * 64)::BIGINT AS base, share * 64 - floor(share * 64) AS fraction FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fraction DESC, source) AS place, 64 - sum(base) OVER (PARTITION BY lang) AS rest FROM b)
SELECT lang, source, (base + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS slots FROM r"""
)
def lane_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    shares = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    return largest_remainder(shares, 64, ["lang"], "source", "share").select("lang", "source", "slots")


#: A three-stage plan over the event stream: stage, first and last position, share of each type.
STAGES = (("warm", 0, 2000), ("main", 2000, 7000), ("anneal", 7000, 1 << 40))
SHARES = {
    "warm": {"click": 0.4, "view": 0.3, "purchase": 0.1, "signup": 0.1, "error": 0.1},
    "main": {"click": 0.2, "view": 0.4, "purchase": 0.2, "signup": 0.1, "error": 0.1},
    "anneal": {"click": 0.1, "view": 0.2, "purchase": 0.4, "signup": 0.2, "error": 0.1},
}
SEAMS = (("warm", "main", 2000, 400), ("main", "anneal", 7000, 1000))
PLAN_SQL = (
    f"st(stage, t0, t1) AS (VALUES {', '.join(map(str, STAGES))}), sh(stage, lane, share) AS (VALUES "
    + ", ".join(str((s, k, v)) for s, m in SHARES.items() for k, v in m.items())
    + f"), se(a, b, mid, band) AS (VALUES {', '.join(map(str, SEAMS))})"
)


def plan_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages, shares and seams of the plan; a handful of rows each."""
    return (
        spark.createDataFrame(STAGES, "stage string, t0 long, t1 long"),
        spark.createDataFrame([(s, k, v) for s, m in SHARES.items() for k, v in m.items()], "stage string, lane string, share double"),
        spark.createDataFrame(SEAMS, "a string, b string, at long, band long"),
    )


@query(f"WITH {PLAN_SQL} SELECT event_id, stage FROM events JOIN st ON event_id >= t0 AND event_id < t1")
def stage_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join of positions with the plan's stages."""
    stages, _, _ = plan_tables(spark)
    return table(spark, sf_dir, "events").join(F.broadcast(stages), (F.col("event_id") >= F.col("t0")) & (F.col("event_id") < F.col("t1"))).select("event_id", "stage")


@query(
    f"""WITH {PLAN_SQL}, p AS (SELECT DISTINCT event_id // 100 * 100 AS pos FROM events), w AS (SELECT p.pos, coalesce(se.a, st.stage) AS a, coalesce(se.b, st.stage) AS b,
 coalesce((p.pos - (mid - band // 2)) / CAST(band // 2 * 2 AS DOUBLE), 1.0) AS w FROM p JOIN st ON pos >= t0 AND pos < t1 LEFT JOIN se ON pos >= mid - band // 2 AND pos < mid + band // 2)
SELECT w.pos, x.lane, round((1 - w.w) * x.share + w.w * y.share, 6) AS share FROM w JOIN sh x ON x.stage = w.a JOIN sh y ON y.stage = w.b AND y.lane = x.lane"""
)
def blended_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane shares along the stream; inside a seam's band the two stages blend linearly."""
    stages, shares, seams = plan_tables(spark)
    pos = table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 100) * 100).alias("pos")).distinct()
    half = F.floor(F.col("band") / 2)
    at = pos.join(F.broadcast(stages), (F.col("pos") >= F.col("t0")) & (F.col("pos") < F.col("t1"))).join(
        F.broadcast(seams), (F.col("pos") >= F.col("at") - half) & (F.col("pos") < F.col("at") + half), "left"
    )
    weight = F.coalesce((F.col("pos") - (F.col("at") - half)) / (half * 2), F.lit(1.0))
    w = at.select("pos", F.coalesce("a", "stage").alias("a"), F.coalesce("b", "stage").alias("b"), weight.alias("w"))
    x, y = shares.select(F.col("stage").alias("a"), "lane", F.col("share").alias("from")), shares.select(F.col("stage").alias("b"), "lane", F.col("share").alias("to"))
    return w.join(F.broadcast(x), "a").join(F.broadcast(y), ["b", "lane"]).select("pos", "lane", F.round((1 - F.col("w")) * F.col("from") + F.col("w") * F.col("to"), 6).alias("share"))


#: Floors that survive normalisation: pinned lanes keep at least this share.
FLOORS = {"error": 0.15, "signup": 0.12}


@query(
    f"""WITH {PLAN_SQL}, f(lane, floor) AS (VALUES {', '.join(map(str, FLOORS.items()))}), m AS (SELECT sh.stage, sh.lane, share, floor, CASE WHEN floor IS NOT NULL THEN greatest(share, floor) END AS pinned FROM sh LEFT JOIN f ON f.lane = sh.lane),
t AS (SELECT *, coalesce(sum(pinned) OVER (PARTITION BY stage), 0) AS pins, sum(CASE WHEN pinned IS NULL THEN share END) OVER (PARTITION BY stage) AS free FROM m),
d AS (SELECT stage, lane, round(coalesce(pinned, share / free * greatest(0, 1 - pins)), 6) AS target FROM t),
e AS (SELECT st.stage, event_type AS lane, count(*) / sum(count(*)) OVER (PARTITION BY st.stage) AS delivered FROM events JOIN st ON event_id >= t0 AND event_id < t1 GROUP BY 1, 2)
SELECT d.stage, d.lane, d.target, round(coalesce(e.delivered, 0), 6) AS delivered FROM d LEFT JOIN e ON e.stage = d.stage AND e.lane = d.lane"""
)
def floored_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's shares with floors pinned and the rest rescaled, beside what was delivered."""
    stages, shares, _ = plan_tables(spark)
    floors = spark.createDataFrame(list(FLOORS.items()), "lane string, floor double")
    w = Window.partitionBy("stage")
    m = shares.join(F.broadcast(floors), "lane", "left").withColumn("pinned", F.when(F.col("floor").isNotNull(), F.greatest("share", "floor")))
    t = m.withColumns({"pins": F.coalesce(F.sum("pinned").over(w), F.lit(0.0)), "free": F.sum(F.when(F.col("pinned").isNull(), F.col("share"))).over(w)})
    target = t.select("stage", "lane", F.round(F.coalesce("pinned", F.col("share") / F.col("free") * F.greatest(F.lit(0.0), 1 - F.col("pins"))), 6).alias("target"))
    counts = (
        table(spark, sf_dir, "events").join(F.broadcast(stages), (F.col("event_id") >= F.col("t0")) & (F.col("event_id") < F.col("t1"))).groupBy("stage", F.col("event_type").alias("lane")).count()
    )
    delivered = counts.select("stage", "lane", (F.col("count") / F.sum("count").over(w)).alias("d"))
    return target.join(delivered, ["stage", "lane"], "left").select("stage", "lane", "target", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("delivered"))


@query(
    f"""WITH {PLAN_SQL}, n AS (SELECT stage, event_type AS lane, count(*) AS k FROM events JOIN st ON event_id >= t0 AND event_id < t1 GROUP BY 1, 2), tot AS (SELECT stage, sum(k) AS k FROM n GROUP BY stage),
a AS (SELECT sh.lane, sum(sh.share * tot.k) / (SELECT sum(k) FROM n) AS target FROM sh JOIN tot ON tot.stage = sh.stage GROUP BY sh.lane), d AS (SELECT lane, sum(k) / (SELECT sum(k) FROM n) AS delivered FROM n GROUP BY lane)
SELECT round(0.5 * sum(abs(coalesce(d.delivered, 0) - coalesce(a.target, 0))), 6) AS tvd, count(*)::BIGINT AS lanes FROM a FULL OUTER JOIN d ON d.lane = a.lane"""
)
def mixture_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation distance of what was delivered from the stage-weighted target."""
    stages, shares, _ = plan_tables(spark)
    n = table(spark, sf_dir, "events").join(F.broadcast(stages), (F.col("event_id") >= F.col("t0")) & (F.col("event_id") < F.col("t1"))).groupBy("stage", F.col("event_type").alias("lane")).agg(F.count(F.lit(1)).alias("k"))
    per_stage = n.groupBy("stage").agg(F.sum("k").alias("total"))
    target = shares.join(per_stage, "stage").groupBy("lane").agg(F.sum(F.col("share") * F.col("total")).alias("t"))
    delivered = n.groupBy("lane").agg(F.sum("k").alias("d"))
    both = target.join(delivered, "lane", "full_outer").select(F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("d", F.lit(0)).alias("d"))
    whole = F.sum("d")
    return both.agg(F.collect_list(F.struct("t", "d")).alias("rows"), whole.alias("n"), F.count(F.lit(1)).alias("lanes")).select(
        F.round(F.aggregate("rows", F.lit(0.0), lambda s, r: s + F.abs(r["d"] / F.col("n") - r["t"] / F.col("n"))) * 0.5, 6).alias("tvd"), "lanes"
    )  # a row a lane


@query(
    """WITH e AS (SELECT event_id, event_type, event_id + 1 AS pos FROM events), k AS (SELECT pos // 100 AS step, count(*) FILTER (WHERE event_type = 'error') AS n, count(*) AS total FROM e GROUP BY 1),
r AS (SELECT step, total, coalesce(sum(n) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(total) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM k)
SELECT step::BIGINT AS step, greatest(0, least(total, CAST(ceil(0.25 * (seen + total)) AS BIGINT) - before))::BIGINT AS needed FROM r"""
)
def floor_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of a hundred events must deliver to keep a running floor of a quarter.

    Events are counted per step first, and the running sums over steps are made in two levels.
    """
    e = table(spark, sf_dir, "events").select("event_type", F.floor((F.col("event_id") + 1) / 100).alias("step"))
    k = e.groupBy("step").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.count(F.lit(1)).alias("total"))
    r = running_sums(k.withColumn("all", F.lit(0)), "all", ["step"], {"upto": F.col("n"), "seen": F.col("total")})
    r = r.select("step", "total", (F.col("upto") - F.col("n")).alias("before"), (F.col("seen") - F.col("total")).alias("seen"))
    need = F.ceil((F.col("seen") + F.col("total")) * 0.25) - F.col("before")
    return r.select("step", F.greatest(F.lit(0), F.least("total", need)).alias("needed"))


def verdict(epochs: Column) -> Column:
    return F.when(epochs <= 1, "covered").when(epochs <= 4, "repeat").otherwise("synthesize")


@query(
    """WITH s AS (SELECT source, sum(n_chars) AS supply FROM documents GROUP BY source), t AS (SELECT *, 3.0 * sum(supply) OVER () / count(*) OVER () AS demand FROM s)
SELECT source, supply::BIGINT AS supply, round(demand / supply, 4) AS epochs, CASE WHEN demand / supply <= 1 THEN 'covered' WHEN demand / supply <= 4 THEN 'repeat' ELSE 'synthesize' END AS verdict,
 round(1 - demand / (supply * 4.0), 4) AS headroom, CASE WHEN 1 - demand / (supply * 4.0) < 0 THEN 'already_breached' WHEN 1 - demand / (supply * 4.0) < 0.2 THEN 'fragile' ELSE 'robust' END AS status,
 round(greatest(0, least(0.95, 1 - demand / (supply * 4.0))), 4) AS max_rejection FROM t"""
)
def supply_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand against supply: epochs, tolerable dedup, and the largest rejection rate in closed form."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("supply"))
    mean = s.agg((F.sum("supply") * 3.0 / F.count(F.lit(1))).alias("demand"))
    epochs, room = F.col("demand") / F.col("supply"), 1 - F.col("demand") / (F.col("supply") * 4.0)
    return s.crossJoin(F.broadcast(mean)).select(
        "source",
        "supply",
        F.round(epochs, 4).alias("epochs"),
        verdict(epochs).alias("verdict"),
        F.round(room, 4).alias("headroom"),
        F.when(room < 0, "already_breached").when(room < 0.2, "fragile").otherwise("robust").alias("status"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.95), room)), 4).alias("max_rejection"),
    )


def water_fill(supply: DataFrame, name: str, amount: str, alpha: float, cap: float, budget: float) -> DataFrame:
    """Shares of a budget in proportion to supply^alpha, none above cap * supply, exact by sorted break points.

    With lanes sorted by weight / cap, those filled to the cap come first: a lane is capped when its
    part of what the capped lanes before it leave exceeds its cap.
    """
    w = F.pow(F.col(amount), alpha)
    lanes = supply.select(name, F.col(amount).alias("amount"), w.alias("weight"), (F.col(amount) * cap).alias("cap"))
    order = Window.orderBy(F.desc(F.col("weight") / F.col("cap")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = lanes.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weights": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "all": F.sum("weight").over(Window.partitionBy())})
    level = (F.lit(budget) - F.col("caps")) / (F.col("all") - F.col("weights"))
    capped = seen.withColumn("capped", F.col("weight") * level >= F.col("cap"))
    rest = capped.where("not capped").agg(F.min(F.struct("caps", "weights", "all")).alias("m"))
    final = (F.lit(budget) - F.col("m.caps")) / (F.col("m.all") - F.col("m.weights"))
    return capped.crossJoin(F.broadcast(rest)).select(name, "amount", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final).alias("allocated"), "capped")


@query(
    """WITH RECURSIVE s AS (SELECT lang, sum(n_chars)::DOUBLE AS a, pow(sum(n_chars), 0.3) AS w FROM documents GROUP BY lang), b AS (SELECT 2.0 * sum(a) AS budget FROM s),
i(k, level) AS (SELECT 0, (SELECT budget / sum(w) FROM s, b GROUP BY budget) UNION ALL SELECT k + 1, (SELECT (budget - sum(CASE WHEN w * i.level >= 4 * a THEN 4 * a ELSE 0 END)) / sum(CASE WHEN w * i.level >= 4 * a THEN 0 ELSE w END) FROM s, b GROUP BY budget) FROM i WHERE k < 30)
SELECT lang, a::BIGINT AS supply, round(CASE WHEN w * level >= 4 * a THEN 4 * a ELSE w * level END, 3) AS allocated, w * level >= 4 * a AS capped FROM s, i WHERE k = 30"""
)
def water_filled_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of twice the corpus over languages with supply^0.3 and four epochs at most; a row a language."""
    s = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("supply"))
    total = s.agg(F.sum("supply")).first()[0] or 0
    return water_fill(s, "lang", "supply", 0.3, 4.0, 2.0 * total).select("lang", F.col("amount").alias("supply"), F.round("allocated", 3).alias("allocated"), "capped")


@query(
    """WITH d AS (SELECT lang, source, sum(n_chars) AS n FROM documents GROUP BY 1, 2), l AS (SELECT lang, sum(n) AS total, max(n) AS largest FROM d GROUP BY lang)
SELECT lang, total::BIGINT AS total, round(largest / total, 6) AS largest_share, total >= 0.05 * sum(total) OVER () AS rare_gate FROM l"""
)
def rare_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("n"))
    lang = d.groupBy("lang").agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
    return lang.select("lang", "total", F.round(F.col("largest") / F.col("total"), 6).alias("largest_share"), (F.col("total") >= F.sum("total").over(Window.partitionBy()) * 0.05).alias("rare_gate"))
