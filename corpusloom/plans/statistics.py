"""Fits, correlations, concentration, resampling and schedule formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.functions.hashing import derived_seed
from corpusloom.operators.prefix import row_numbers
from corpusloom.plans.registry import query
from corpusloom.plans.text import words_sql
from corpusloom.plans.windows import STEPS_SQL, steps
from corpusloom.sources.tables import table


@query(
    """SELECT p_brand, round(-regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS exponent, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept,
 round(corr(l_extendedprice, l_quantity), 6) AS pearson FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""
)
def log_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    y, x = F.ln("l_extendedprice"), F.ln("l_quantity")
    return joined.groupBy("p_brand").agg(
        F.round(-F.regr_slope(y, x), 6).alias("exponent"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("pearson")
    )


@query(
    """WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part)
SELECT p_brand, round(corr(a, b), 6) AS spearman, count(*)::BIGINT AS n FROM r GROUP BY p_brand"""
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    r = table(spark, sf_dir, "part").select("p_brand", F.row_number().over(w.orderBy("p_size", "p_partkey")).alias("a"), F.row_number().over(w.orderBy("p_retailprice", "p_partkey")).alias("b"))
    return r.groupBy("p_brand").agg(F.round(F.corr("a", "b"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


WORD_COUNTS_SQL = f"c AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({words_sql('text')}) AS word FROM documents) GROUP BY lang, word)"


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each word type by language; counted map-side, so frequent words are no hot keys."""
    return table(spark, sf_dir, "documents").select("lang", F.explode(fx.words("text")).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, k AS (SELECT lang, n, count(*) AS types FROM c GROUP BY lang, n), t AS (SELECT lang, sum(types) AS v, sum(n * types) AS total FROM k GROUP BY lang),
p AS (SELECT k.lang, n, types, v, total, sum(types) OVER (PARTITION BY k.lang ORDER BY n) AS upto FROM k JOIN t ON t.lang = k.lang)
SELECT lang, any_value(v)::BIGINT AS types, any_value(total)::BIGINT AS tokens, round(exp(-sum(types * (n / total) * ln(n / total))), 4) AS effective_types,
 round(sum(n * (types * (2 * (upto - types) + types + 1) - types * (any_value_v + 1))) / (any_value(total) * any_value(v)), 6) AS gini FROM (SELECT *, v AS any_value_v FROM p) GROUP BY lang"""
)
def load_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gini coefficient and exponential entropy of word use.

    Types of one count are one row, so the sorted sums go over the distinct counts, not over types.
    """
    w = Window.partitionBy("lang")
    k = word_counts(spark, sf_dir).groupBy("lang", "n").agg(F.count(F.lit(1)).alias("types"))
    p = k.withColumns({"v": F.sum("types").over(w), "total": F.sum(F.col("n") * F.col("types")).over(w), "upto": F.sum("types").over(w.orderBy("n"))})
    share = F.col("n") / F.col("total")
    # Ranks of a block of equal values add up to types * (2 * before + types + 1) / 2.
    rank2 = F.col("types") * ((F.col("upto") - F.col("types")) * 2 + F.col("types") + 1) - F.col("types") * (F.col("v") + 1)
    return p.groupBy("lang").agg(
        F.first("v").alias("types"),
        F.first("total").alias("tokens"),
        F.round(F.exp(-F.sum(F.col("types") * share * F.ln(share))), 4).alias("effective_types"),
        F.round(F.sum(F.col("n") * rank2) / (F.first("total") * F.first("v")), 6).alias("gini"),
    )


@query(f"WITH {WORD_COUNTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM c) SELECT lang, word, n::BIGINT AS n, place::BIGINT AS place FROM r WHERE place <= 50")
def most_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return word_counts(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 50").withColumn("place", F.col("place").cast("long"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, b AS (SELECT lang, CASE WHEN n < 3 THEN 'rare' WHEN n <= 30 THEN 'middle' ELSE 'frequent' END AS bucket, n, length(word) AS len FROM c)
SELECT lang, bucket, count(*)::BIGINT AS types, sum(n)::BIGINT AS tokens, round(avg(len), 4) AS mean_length, round(sum(n) / sum(sum(n)) OVER (PARTITION BY lang), 6) AS share FROM b GROUP BY lang, bucket"""
)
def frequency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    bucket = F.when(n < 3, "rare").when(n <= 30, "middle").otherwise("frequent")
    b = word_counts(spark, sf_dir).groupBy("lang", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.round(F.avg(F.length("word")), 4).alias("mean_length"))
    return b.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("lang")), 6))


@query(
    f"""WITH {WORD_COUNTS_SQL}, f AS (SELECT lang, array_to_string(list_sort(list_distinct(string_split(word, ''))), '') AS feature, n FROM c), g AS (SELECT lang, feature, count(*) AS k, sum(n) AS m FROM f GROUP BY 1, 2), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang)
SELECT g.lang, sum(k - 1)::BIGINT AS collisions, count(*) FILTER (WHERE k > 1)::BIGINT AS groups, round(sum(CASE WHEN k > 1 THEN m / total ELSE 0 END), 6) AS mass FROM g JOIN t ON t.lang = g.lang GROUP BY g.lang"""
)
def feature_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word types with the same set of characters."""
    feature = F.array_join(F.array_sort(F.array_distinct(F.split("word", ""))), "")
    c = word_counts(spark, sf_dir)
    g = c.groupBy("lang", feature.alias("feature")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m"))
    total = F.sum("m")
    return g.groupBy("lang").agg(F.sum(F.col("k") - 1).alias("collisions"), F.count_if(F.col("k") > 1).alias("groups"), F.round(F.sum(F.when(F.col("k") > 1, F.col("m")).otherwise(0)) / total, 6).alias("mass"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), f AS (SELECT c.lang, substr(word, 1, 3) AS head, n / total AS p FROM c JOIN t ON t.lang = c.lang), g AS (SELECT lang, head, sum(p) AS pg, count(*) AS k FROM f GROUP BY 1, 2)
SELECT f.lang, round(sum(p * ln(p / (pg / k))), 6) AS kl FROM f JOIN g ON g.lang = f.lang AND g.head = f.head WHERE k > 1 GROUP BY f.lang"""
)
def collision_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information lost when types of one group are told apart no more; the sum splits into per-group terms, so no join is needed."""
    c = word_counts(spark, sf_dir)
    total = c.groupBy("lang").agg(F.sum("n").alias("total"))
    f = c.join(total, "lang").select("lang", F.substring("word", 1, 3).alias("head"), (F.col("n") / F.col("total")).alias("p"))
    g = f.groupBy("lang", "head").agg(F.sum("p").alias("pg"), F.count(F.lit(1)).alias("k"), F.sum(F.col("p") * F.ln("p")).alias("plogp")).where("k > 1")
    return g.groupBy("lang").agg(F.round(F.sum(F.col("plogp") - F.col("pg") * F.ln(F.col("pg") / F.col("k"))), 6).alias("kl"))


@query("SELECT label, round(avg(embedding[1]), 6) AS mean, coalesce(round(stddev_samp(embedding[1]), 6), 0) AS sd, count(*)::BIGINT AS n FROM embeddings GROUP BY label")
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.element_at("embedding", 1).cast("double")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(x), 6).alias("mean"), F.coalesce(F.round(F.stddev_samp(x), 6), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS i, x, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT event_type, user_id, avg(value) AS x FROM events GROUP BY 1, 2)),
d AS (SELECT event_type, n, i AS slot, unnest(range(1, 201)) AS b FROM v WHERE i % 8 = 0), s AS (SELECT event_type, n, b, CAST('0x' || substr(sha256(event_type || ':' || slot || ':' || b), 1, 15) AS BIGINT) % greatest(n - 7, 1) AS start FROM d),
p AS (SELECT event_type, b, unnest(range(start, least(start + 8, n))) AS i FROM s), m AS (SELECT p.event_type, b, avg(x) AS m FROM p JOIN v ON v.event_type = p.event_type AND v.i = p.i GROUP BY 1, 2)
SELECT event_type, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, count(*)::BIGINT AS resamples FROM m GROUP BY event_type"""
)
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of each type's mean from 200 moving-block resamples over users' means.

    Starts come from SHA-256 of type, place and resample, so the result is the same every time; a
    resample is an equi-join of starts with the ordered values, and its mean a grouped sum.
    """
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("x"))
    n = users.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))  # a row a type
    v = row_numbers(users, "event_type", ["user_id"], "place").withColumn("i", F.col("place") - 1).drop("place").join(F.broadcast(n), "event_type")
    block = 8
    draws = v.where(F.col("i") % block == 0).select("event_type", "n", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(200))).alias("b"))
    draws = draws.withColumn("start", derived_seed(F.col("event_type"), F.col("slot"), F.col("b")) % F.greatest(F.col("n") - block + 1, F.lit(1)))
    picks = draws.select("event_type", "b", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + block - 1, F.col("n") - 1))).alias("i"))
    means = picks.join(v.select("event_type", "i", "x"), ["event_type", "i"]).groupBy("event_type", "b").agg(F.avg("x").alias("m"))
    return means.groupBy("event_type").agg(F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"), F.count(F.lit(1)).alias("resamples"))


@query(
    """WITH p AS (SELECT p_brand, p_partkey, p_size, p_retailprice, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS stratum FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, stratum ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY p_brand, stratum ORDER BY sha256('3:' || p_partkey), p_partkey) AS j FROM p)
SELECT x.p_partkey, y.p_size AS permuted_size FROM a x JOIN a y ON x.p_brand = y.p_brand AND x.stratum = y.stratum AND x.i = y.j"""
)
def stratified_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes permuted within a brand's price quarter: two orders of each stratum joined by place, the second from a hash."""
    p = table(spark, sf_dir, "part").withColumn("stratum", F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")))
    w = Window.partitionBy("p_brand", "stratum")
    key = F.sha2(F.concat(F.lit("3:"), F.col("p_partkey").cast("string")), 256)
    x = p.select("p_partkey", "p_brand", "stratum", F.row_number().over(w.orderBy("p_partkey")).alias("i"))
    y = p.select("p_brand", "stratum", F.row_number().over(w.orderBy(key, "p_partkey")).alias("i"), F.col("p_size").alias("permuted_size"))
    return x.join(y, ["p_brand", "stratum", "i"]).select("p_partkey", "permuted_size")


def learning_rate(step: Column, warmup: int, total: Column | int, floor: float) -> Column:
    """Linear warm-up, then a cosine down to a floor."""
    done = (step - warmup) / (total - warmup)
    return F.when(step < warmup, (step + 1) / warmup).otherwise(F.cos(F.least(done, F.lit(1.0)) * F.pi()) * 0.5 * (1 - floor) + 0.5 * (1 + floor))


#: Warm-up steps of a branch, and what is left of the rate at its end.
WARM_UP, FLOOR = 5, 0.1


@query(
    f"""WITH {STEPS_SQL}, r AS (SELECT event_id, step, count(*) OVER (PARTITION BY user_id) AS total FROM s)
SELECT event_id, step::BIGINT AS step, round(CASE WHEN step < {WARM_UP} THEN (step + 1) / {WARM_UP}.0 ELSE {FLOOR} + {1 - FLOOR} * 0.5 * (1 + cos(least((step - {WARM_UP}) / greatest(total - {WARM_UP}, 1)::DOUBLE, 1.0) * pi())) END, 6) AS lr,
 round((1 - power(0.9, step + 1)) / sqrt(1 - power(0.999, step + 1)), 6) AS bias_ratio FROM r"""
)
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at each step of each branch, whose length sets the schedule, and the ratio of bias corrections there."""
    s = steps(spark, sf_dir).select("event_id", "user_id", F.col("step").cast("long").alias("step"))
    total = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    t = F.col("step") + 1
    rate = learning_rate(F.col("step"), WARM_UP, F.greatest(F.col("total"), F.lit(WARM_UP + 1)), FLOOR)
    return s.join(total, "user_id").select("event_id", "step", F.round(rate, 6).alias("lr"), F.round((1 - F.pow(F.lit(0.9), t)) / F.sqrt(1 - F.pow(F.lit(0.999), t)), 6).alias("bias_ratio"))


@query(
    """WITH p AS (SELECT label, sum(len(embedding)) AS parameters FROM embeddings GROUP BY label), g(stage) AS (VALUES (0), (1), (2), (3)), n AS (SELECT 8 * (1 << k) AS gpus FROM (SELECT unnest(range(0, 4)) AS k))
SELECT label::BIGINT AS label, stage::BIGINT AS stage, gpus::BIGINT AS gpus, round(parameters * CASE stage WHEN 0 THEN 16.0::DOUBLE WHEN 1 THEN 4 + 12.0::DOUBLE / gpus WHEN 2 THEN 2 + 14.0::DOUBLE / gpus ELSE 16.0::DOUBLE / gpus END, 2) AS bytes,
 round(parameters * CASE stage WHEN 3 THEN 3 ELSE 2 END * (gpus - 1) / gpus::DOUBLE * 2.0, 2) AS bytes_sent FROM p CROSS JOIN g CROSS JOIN n"""
)
def sharded_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each table of vectors takes on a device, and bytes sent, by sharding stage and number of devices (mixed precision with Adam)."""
    p = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.sum(F.size("embedding")).alias("parameters"))
    stages, devices = (F.array(*(F.lit(x).cast("long") for x in xs)) for xs in (range(4), (8, 16, 32, 64)))
    grid = p.withColumn("stage", F.explode(stages)).withColumn("gpus", F.explode(devices))
    g = F.col("gpus")
    memory = F.when(F.col("stage") == 0, 16.0).when(F.col("stage") == 1, F.lit(12.0) / g + 4).when(F.col("stage") == 2, F.lit(14.0) / g + 2).otherwise(F.lit(16.0) / g)
    sent = F.when(F.col("stage") == 3, 3).otherwise(2) * (g - 1) / g * 2.0
    return grid.select("label", "stage", "gpus", F.round(F.col("parameters") * memory, 2).alias("bytes"), F.round(F.col("parameters") * sent, 2).alias("bytes_sent"))


def adam(gradients: Column, b1: float = 0.9, b2: float = 0.999, rate: float = 0.01, eps: float = 1e-8) -> Column:
    """Parameter after an ordered array of gradients, from zero."""
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(1.0).alias("p1"), F.lit(1.0).alias("p2"), F.lit(0.0).alias("x"))

    def step(s: Column, g: Column) -> Column:
        m, v = s["m"] * b1 + g * (1 - b1), s["v"] * b2 + g * g * (1 - b2)
        p1, p2 = s["p1"] * b1, s["p2"] * b2
        return F.struct(m.alias("m"), v.alias("v"), p1.alias("p1"), p2.alias("p2"), (s["x"] - (m / (1 - p1)) / (F.sqrt(v / (1 - p2)) + eps) * rate).alias("x"))

    return F.aggregate(gradients, start, step, lambda s: s["x"])


@query(
    """WITH RECURSIVE g AS (SELECT vec_id, unnest(range(1, 65)) AS t, CAST(unnest(embedding) AS DOUBLE) AS g FROM embeddings),
a(vec_id, t, m, v, x) AS (SELECT vec_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM embeddings UNION ALL
 SELECT a.vec_id, a.t + 1, 0.9 * a.m + 0.1 * g.g, 0.999 * a.v + 0.001 * g.g * g.g, a.x - 0.01 * ((0.9 * a.m + 0.1 * g.g) / (1 - power(0.9, a.t + 1))) / (sqrt((0.999 * a.v + 0.001 * g.g * g.g) / (1 - power(0.999, a.t + 1))) + 1e-8) FROM a JOIN g ON g.vec_id = a.vec_id AND g.t = a.t + 1)
SELECT vec_id, round(x, 5) AS x FROM a WHERE t = 64"""
)
def adam_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    grads = F.transform("embedding", lambda g: g.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(adam(grads), 5).alias("x"))


@query(
    """WITH r AS (SELECT p_brand, p_size AS x, avg(p_retailprice) AS y FROM part GROUP BY 1, 2), n AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER (PARTITION BY p_brand ORDER BY y, x) AS best FROM r WINDOW w AS (PARTITION BY p_brand ORDER BY x))
SELECT p_brand, x::BIGINT AS lowest_at, CASE WHEN x0 IS NULL OR x2 IS NULL THEN 'ENDPOINT' ELSE 'INTERIOR' END AS status, round(x - 0.5 * ((x - x0) * (x - x0) * (y - y2) - (x - x2) * (x - x2) * (y - y0)) / ((x - x0) * (y - y2) - (x - x2) * (y - y0)), 4) AS vertex FROM n WHERE best = 1"""
)
def parabola_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex of the parabola through the lowest point and its neighbours; at an end of the grid there is none."""
    w = Window.partitionBy("p_brand")
    r = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    at = w.orderBy("x")
    n = r.withColumns({"x0": F.lag("x").over(at), "y0": F.lag("y").over(at), "x2": F.lead("x").over(at), "y2": F.lead("y").over(at), "best": F.row_number().over(w.orderBy("y", "x"))})
    a, b = F.col("x") - F.col("x0"), F.col("x") - F.col("x2")
    p, q = F.col("y") - F.col("y2"), F.col("y") - F.col("y0")
    vertex = F.col("x") - (a * a * p - b * b * q) / (a * p - b * q) * 0.5
    status = F.when(F.col("x0").isNull() | F.col("x2").isNull(), "ENDPOINT").otherwise("INTERIOR")
    return n.where("best = 1").select("p_brand", F.col("x").cast("long").alias("lowest_at"), status.alias("status"), F.round(vertex, 4).alias("vertex"))
