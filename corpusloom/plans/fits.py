"""Losses by slice, schedule families, exponents by several estimators, paired comparisons, resampling and ranks of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.plans.statistics import WORD_COUNTS_SQL, word_counts
from corpusloom.plans.windows import STEPS_SQL, steps
from corpusloom.sources.tables import table


@query(
    """WITH v AS (SELECT value AS loss, octet_length(encode(event_type)) AS b, event_id % 5 = 0 AS held, value < 10 AS hit FROM events)
SELECT unnest(['all', 'seen', 'heldout']) AS slice, unnest([count(*), count(*) FILTER (WHERE NOT held), count(*) FILTER (WHERE held)])::BIGINT AS tokens, unnest([sum(b), sum(b) FILTER (WHERE NOT held), sum(b) FILTER (WHERE held)])::BIGINT AS bytes,
 unnest([round(avg(hit::INT), 6), round(avg(hit::INT) FILTER (WHERE NOT held), 6), round(avg(hit::INT) FILTER (WHERE held), 6)]) AS accuracy, unnest([round(sum(loss) / ln(2) / sum(b), 6), round(sum(loss) FILTER (WHERE NOT held) / ln(2) / sum(b) FILTER (WHERE NOT held), 6), round(sum(loss) FILTER (WHERE held) / ln(2) / sum(b) FILTER (WHERE held), 6)]) AS bits_per_byte FROM v"""
)
def validation_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, bytes, accuracy and bits per byte over all, seen and held-out rows in one pass: each row counts in two slices."""
    v = table(spark, sf_dir, "events").select(F.explode(F.array(F.lit("all"), F.when(F.col("event_id") % 5 == 0, "heldout").otherwise("seen"))).alias("slice"), F.col("value").alias("loss"), F.octet_length("event_type").alias("b"))
    return v.groupBy("slice").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("b").alias("bytes"), F.round(F.avg((F.col("loss") < 10).cast("int")), 6).alias("accuracy"), F.round(F.sum("loss") / F.lit(float(np.log(2))) / F.sum("b"), 6).alias("bits_per_byte")
    )


@query(
    f"""WITH {WORD_COUNTS_SQL}, t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), p AS (SELECT c.lang, CASE WHEN n < 2 THEN 'once' WHEN n < 10 THEN 'few' WHEN n < 100 THEN 'some' ELSE 'many' END AS bucket, n, -ln(n / total) AS nll, octet_length(encode(word)) AS b FROM c JOIN t ON t.lang = c.lang)
SELECT lang, bucket, sum(n)::BIGINT AS tokens, round(sum(n * nll) / sum(n), 6) AS nll, round(sum(n * nll) / ln(2) / sum(n * b), 6) AS bits_per_byte FROM p GROUP BY lang, bucket"""
)
def loss_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram loss of each language's words by how often they occur."""
    c = word_counts(spark, sf_dir)
    t = c.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    n = F.col("n")
    bucket = F.when(n < 2, "once").when(n < 10, "few").when(n < 100, "some").otherwise("many")
    p = c.join(F.broadcast(t), "lang").select("lang", bucket.alias("bucket"), "n", (-F.ln(n / F.col("total"))).alias("nll"), F.octet_length("word").alias("b"))
    return p.groupBy("lang", "bucket").agg(
        F.sum("n").alias("tokens"), F.round(F.sum(n * F.col("nll")) / F.sum("n"), 6).alias("nll"), F.round(F.sum(n * F.col("nll")) / F.lit(float(np.log(2))) / F.sum(n * F.col("b")), 6).alias("bits_per_byte")
    )


@query(
    """WITH b AS (SELECT user_id, value AS loss, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS boundary FROM events)
SELECT boundary, count(*)::BIGINT AS n, round(exp(least(avg(loss), 20)), 6) AS perplexity FROM b GROUP BY boundary"""
)
def boundary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity at the last row of a run and elsewhere."""
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    b = table(spark, sf_dir, "events").select(F.col("value").alias("loss"), (~following.eqNullSafe(F.col("event_type"))).alias("boundary"))
    return b.groupBy("boundary").agg(F.count(F.lit(1)).alias("n"), F.round(F.exp(F.least(F.avg("loss"), F.lit(20))), 6).alias("perplexity"))


#: Shares of a run that are warm-up and that come before the decay.
WARM, DECAY = 0.1, 0.8


@query(
    f"""WITH {STEPS_SQL}, t AS (SELECT user_id, step AS t, count(*) OVER (PARTITION BY user_id) AS n FROM s),
m AS (SELECT user_id, least(1.0, (t + 1) / (n * {WARM}::DOUBLE)) AS w, 0.5 * (1 + cos(pi() * t / n)) AS c, least(1.0, (n - t) / (n * {1 - DECAY:.1f}::DOUBLE)) AS d FROM t),
f AS (SELECT user_id, unnest(['cosine', 'cosine_no_warmup', 'wsd', 'annealed_wsd']) AS family, unnest([w * c, c, w * d, w * d * d]) AS x FROM m)
SELECT user_id, family, round(avg(x), 6) AS mean_multiplier, round(max(x), 6) AS highest FROM f GROUP BY user_id, family"""
)
def schedule_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and highest multiplier of four schedules over each branch's run."""
    s = steps(spark, sf_dir).select("user_id", F.col("step").alias("t"))
    t = s.join(s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")
    n = F.col("n")
    w = F.least(F.lit(1.0), (F.col("t") + 1) / (n * WARM))
    c, d = 0.5 * (1 + F.cos(F.lit(np.pi) * F.col("t") / n)), F.least(F.lit(1.0), (n - F.col("t")) / (n * round(1 - DECAY, 1)))
    m = t.select("user_id", F.explode(F.array(*(F.struct(F.lit(k).alias("family"), x.alias("x")) for k, x in (("cosine", w * c), ("cosine_no_warmup", c), ("wsd", w * d), ("annealed_wsd", w * d * d))))).alias("m"))
    return m.groupBy("user_id", "m.family").agg(F.round(F.avg("m.x"), 6).alias("mean_multiplier"), F.round(F.max("m.x"), 6).alias("highest"))


ESTIMATES_SQL = """g AS (SELECT p_brand, l_quantity AS x, avg(l_extendedprice) AS y, min(l_extendedprice) AS least, median(l_extendedprice) AS mid FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
e AS (SELECT p_brand, x, unnest(['mean', 'least', 'median']) AS estimator, unnest([y, least, mid]) AS y FROM g),
r AS (SELECT *, 'all' AS grid FROM e UNION ALL SELECT *, 'coarse' FROM e WHERE x % 10 = 0)"""


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity of each brand: three estimators, on the whole grid of quantities and on every tenth."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    g = joined.groupBy("p_brand", F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("mean"), F.min("l_extendedprice").alias("least"), F.median("l_extendedprice").alias("median"))
    e = g.select("p_brand", "x", F.explode(F.array(*(F.struct(F.lit(n).alias("estimator"), F.col(n).cast("double").alias("y")) for n in ("mean", "least", "median")))).alias("e")).select("p_brand", "x", "e.*")
    grids = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("x") % 10 == 0, "coarse"))))
    return e.select("*", grids.alias("grid"))


@query(
    f"""WITH {ESTIMATES_SQL} SELECT p_brand, estimator, grid, round(ln(arg_max(y, x) / arg_min(y, x)) / ln(max(x) / min(x)), 6) AS endpoint, round(regr_slope(ln(y), ln(x)), 6) AS least_squares, round(regr_slope(y, x), 2) AS linear FROM r GROUP BY 1, 2, 3"""
)
def estimator_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponents by estimator, fit and grid: from the two end points, by least squares of logarithms, and a linear slope."""
    r = estimates(spark, sf_dir)
    ends = F.ln(F.max_by("y", "x") / F.min_by("y", "x")) / F.ln(F.max("x") / F.min("x"))
    return r.groupBy("p_brand", "estimator", "grid").agg(
        F.round(ends, 6).alias("endpoint"), F.round(F.regr_slope(F.ln("y"), F.ln("x")), 6).alias("least_squares"), F.round(F.regr_slope("y", F.col("x").cast("double")), 2).alias("linear")
    )


@query(
    """WITH m AS (SELECT user_id % 4 AS arm, event_type AS seed, avg(value) AS loss FROM events GROUP BY 1, 2), p AS (SELECT a.arm AS a, b.arm AS b, a.seed, a.loss - b.loss AS gap FROM m a JOIN m b ON a.seed = b.seed AND a.arm < b.arm)
SELECT a::BIGINT AS a, b::BIGINT AS b, count(*)::BIGINT AS seeds, round(avg(gap), 6) AS mean_gap, round(stddev_samp(gap), 6) AS sd, (count(*) FILTER (WHERE gap > 0) IN (0, count(*))) AS signs_agree FROM p GROUP BY 1, 2"""
)
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two arms seed by seed, and whether all have one sign."""
    m = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("arm"), F.col("event_type").alias("seed")).agg(F.avg("value").alias("loss"))
    p = m.select(F.col("arm").alias("a"), "seed", F.col("loss").alias("x")).join(m.select(F.col("arm").alias("b"), "seed", F.col("loss").alias("y")), "seed").where("a < b").withColumn("gap", F.col("x") - F.col("y"))
    up = F.count_if(F.col("gap") > 0)
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.stddev_samp("gap"), 6).alias("sd"), ((up == 0) | (up == F.count(F.lit(1)))).alias("signs_agree"))


@query(
    """WITH m AS (SELECT user_id, max(value) AS top FROM events GROUP BY user_id) SELECT e.user_id, round(any_value(top) + ln(sum(exp(value - top))), 6) AS log_normaliser, round(max(value) - (any_value(top) + ln(sum(exp(value - top)))), 6) + 0.0 AS best_log_probability FROM events e JOIN m ON m.user_id = e.user_id GROUP BY e.user_id"""
)
def log_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm of a sum of exponentials, taken from the largest value so that nothing overflows."""
    e = table(spark, sf_dir, "events").select("user_id", "value")
    top = e.groupBy("user_id").agg(F.max("value").alias("top"))
    z = F.first("top") + F.ln(F.sum(F.exp(F.col("value") - F.col("top"))))
    return e.join(top, "user_id").groupBy("user_id").agg(F.round(z, 6).alias("log_normaliser"), (F.round(F.max("value") - z, 6) + F.lit(0.0)).alias("best_log_probability"))


@query(
    """WITH u AS (SELECT event_type, unnest(range(0, 400)) AS draw, n FROM (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)), m AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1),
h AS (SELECT u.event_type, draw, mean, sd, list_sum([CAST('0x' || substr(sha256(u.event_type || ':' || draw || ':' || k), 1, 8) AS BIGINT) / 4294967296 FOR k IN range(0, 12)]) - 6 AS z FROM u JOIN m ON m.event_type = u.event_type),
v AS (SELECT event_type, mean, mean + sd * z / 10 AS x, row_number() OVER (PARTITION BY event_type ORDER BY mean + sd * z / 10, draw) AS k FROM h)
SELECT event_type, round(avg(x), 6) AS mean, round(max(x) FILTER (WHERE k = 11), 6) AS low, round(max(x) FILTER (WHERE k = 390), 6) AS high, round(avg((x > mean)::INT), 4) AS above FROM v GROUP BY event_type"""
)
def noise_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hundred draws of noise about each mean, with the bounds of 95 of a hundred and the share above it.

    A draw's noise is a sum of twelve uniform numbers from SHA-256, so it does not depend on tasks.
    """
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    draws = m.select("*", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("draw"))
    uniform = lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", "event_type", F.col("draw").cast("string"), k.cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    z = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(11)), uniform), F.lit(0.0), lambda a, b: a + b) - 6
    v = draws.withColumn("x", F.col("mean") + F.col("sd") * z / 10)
    v = v.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy("x", "draw")))
    at = lambda k, n: F.round(F.max(F.when(F.col("k") == k, F.col("x"))), 6).alias(n)
    return v.groupBy("event_type").agg(F.round(F.avg("x"), 6).alias("mean"), at(11, "low"), at(390, "high"), F.round(F.avg((F.col("x") > F.col("mean")).cast("int")), 4).alias("above"))


@query(
    """WITH n AS (SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), r AS (SELECT string_agg(n_name || ' has ' || (n + CASE WHEN n_name = 'FRANCE' THEN 1 ELSE 0 END) || ' customers.', ' ' ORDER BY n_name) AS t FROM n)
SELECT n_name, n, contains(t, n_name || ' has ' || n || ' customers.') AS stated FROM n, r"""
)
def stated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a report states, against those of the tables; one of them was misstated."""
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    n = customers.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    line = lambda k: F.concat_ws(" ", "n_name", F.lit("has"), k.cast("string"), F.lit("customers."))
    report = n.agg(F.array_join(F.array_sort(F.collect_list(line(F.col("n") + F.when(F.col("n_name") == "FRANCE", 1).otherwise(0)))), " ").alias("t"))
    return n.crossJoin(F.broadcast(report)).select("n_name", "n", F.contains("t", line(F.col("n"))).alias("stated"))  # one report


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT a.o_orderkey AS card, b.o_orderkey AS antecedent, date_diff('day', b.o_orderdate, a.o_orderdate)::BIGINT AS days, CASE WHEN b.o_orderdate = a.o_orderdate THEN 'same_day' ELSE 'ok' END AS verdict,
 round(640 * date_diff('day', DATE '1992-01-01', CAST(a.o_orderdate AS DATE)) / 2557.0, 3) AS x FROM o a JOIN orders b ON b.o_orderkey = a.before"""
)
def antecedent_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order and the one that it follows, by a join on the key it names; its date as a place on an axis of 640 units."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("d", "o_orderkey"))
    a = orders.select(F.col("o_orderkey").alias("card"), "d", before.alias("antecedent"))
    b = orders.select(F.col("o_orderkey").alias("antecedent"), F.col("d").alias("e"))
    return a.join(b, "antecedent").select(
        "card", "antecedent", F.date_diff("d", "e").cast("long").alias("days"), F.when(F.col("d") == F.col("e"), "same_day").otherwise("ok").alias("verdict"), F.round(640 * F.date_diff("d", F.lit("1992-01-01").cast("date")) / 2557.0, 3).alias("x")
    )


@query(
    f"""WITH {WORD_COUNTS_SQL}, v AS (SELECT lang, count(*) AS v, max(octet_length(encode(word))) AS longest FROM c GROUP BY lang)
SELECT lang, v::BIGINT AS vocabulary, d::BIGINT AS width, (v * d)::BIGINT AS dense, (longest * 257 * d)::BIGINT AS factored, round(v / (longest * 257.0)::DOUBLE, 4) AS ratio FROM v CROSS JOIN (SELECT unnest([256, 1024, 4096]) AS d)"""
)
def parameter_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a table of vectors for each language's words, and of one built from cells of byte and place up to its longest word."""
    v = word_counts(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.max(F.octet_length("word")).cast("long").alias("longest"))
    p = v.withColumn("width", F.explode(F.array(*(F.lit(x).cast("long") for x in (256, 1024, 4096)))))
    return p.select("lang", "vocabulary", "width", (F.col("vocabulary") * F.col("width")).alias("dense"), (F.col("longest") * 257 * F.col("width")).alias("factored"), F.round(F.col("vocabulary") / (F.col("longest") * 257.0), 4).alias("ratio"))


@query(f"WITH {WORD_COUNTS_SQL}, t AS (SELECT word, sum(n) AS n, count(DISTINCT lang) AS langs FROM c GROUP BY word) SELECT langs::BIGINT AS languages, count(*)::BIGINT AS types, sum(n)::BIGINT AS tokens, round(sum(n) / sum(sum(n)) OVER (), 6) AS coverage FROM t GROUP BY langs")
def heldout_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of all words a vocabulary shared by one, two or more languages covers."""
    t = word_counts(spark, sf_dir).groupBy("word").agg(F.sum("n").alias("n"), F.count_distinct("lang").alias("languages"))
    g = t.groupBy("languages").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"))
    return g.select("languages", "types", "tokens", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6).alias("coverage"))  # a row a number of languages


def gram(vectors: DataFrame, column: str) -> DataFrame:
    """One row: number of vectors and the sums of products of their components, added up in each task first."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for f in frames:
            if len(f):
                x = np.array(f[column].tolist(), dtype=np.float64)
                total, n = x.T @ x if total is None else total + x.T @ x, n + len(x)
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel(), "n": n})

    parts = vectors.select(column).mapInPandas(partial, "at long, s double, n long")
    sums = parts.groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("g")).select("n", F.col("g.s").alias("gram"))  # the square of the width


@query()
def matrix_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, and exponential entropy of the eigenvalues, of the matrix of all embeddings; only its square of the width leaves the tasks."""

    def ranks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, g in zip(f["n"], f["gram"], strict=True):
                width = int(np.sqrt(len(g)))
                e = np.linalg.eigvalsh(np.array(g).reshape(width, width)).clip(0)
                p = e[e > 0] / e.sum()
                yield pd.DataFrame({"n": [n], "width": [width], "rank": [int((e > 1e-9 * e.max()).sum())], "effective_rank": [round(float(np.exp(-(p * np.log(p)).sum())), 4)]})

    return gram(table(spark, sf_dir, "embeddings"), "embedding").mapInPandas(ranks, "n long, width long, rank long, effective_rank double")


#: Where the small number stands that keeps a division finite: outside the root, inside it, or both with a floor.
@query(
    """WITH g AS (SELECT user_id, avg(value) AS m, avg(value * value) AS v FROM events GROUP BY user_id) SELECT user_id, round(m / (sqrt(v) + 1e-3), 6) AS outside, round(m / sqrt(v + 1e-3), 6) AS inside, round(m / (sqrt(greatest(v, 1e-3)) + 1e-3), 6) AS floored FROM g"""
)
def epsilon_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("v"))
    form: dict[str, Column] = {"outside": F.sqrt("v") + 1e-3, "inside": F.sqrt(F.col("v") + 1e-3), "floored": F.sqrt(F.greatest("v", F.lit(1e-3))) + 1e-3}
    return g.select("user_id", *(F.round(F.col("m") / d, 6).alias(n) for n, d in form.items()))
