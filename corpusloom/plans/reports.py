"""Reports over observations, words and orders: many dimensions at once, profiles, bands, repairs of labels, lists and their gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.grid import best_products
from corpusloom.plans.learning import OBS_SQL, observations
from corpusloom.plans.registry import query
from corpusloom.plans.shards import MASK_SQL, windows
from corpusloom.plans.statistics import WORD_COUNTS_SQL, word_counts
from corpusloom.plans.windows import STEPS_SQL, steps
from corpusloom.sources.tables import table

#: Dimensions of an observation besides its lane, each from what a row holds.
DIMENSIONS = ("lane", "user", "stage", "bucket", "boundary", "parity", "phase")


@query(
    f"""WITH {OBS_SQL}, x AS (SELECT loss, lane, 'u' || user_id AS u, CASE WHEN step < 20 THEN 'warm' ELSE 'main' END AS stage, 'b' || CAST(floor(loss / 2) AS INTEGER) AS bucket, CASE WHEN step % 8 = 7 THEN 'end' ELSE 'inner' END AS boundary, CASE WHEN step % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, 'p' || (step // 25) AS phase FROM o),
k AS (SELECT loss, unnest({list(DIMENSIONS)}) AS dimension, unnest([lane, u, stage, bucket, boundary, parity, phase]) AS value FROM x)
SELECT dimension, value, count(*)::BIGINT AS n, round(sum(loss), 4) AS sum_loss, count(*) FILTER (WHERE loss > 6)::BIGINT AS hot FROM k GROUP BY dimension, value"""
)
def dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum of losses and hot rows by each of seven dimensions, from one aggregate with grouping sets."""
    step = F.col("step")
    x = observations(spark, sf_dir).select(
        "loss",
        "lane",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.when(step < 20, "warm").otherwise("main").alias("stage"),
        F.concat(F.lit("b"), F.floor(F.col("loss") / 2).cast("string")).alias("bucket"),
        F.when(step % 8 == 7, "end").otherwise("inner").alias("boundary"),
        F.when(step % 2 == 0, "even").otherwise("odd").alias("parity"),
        F.concat(F.lit("p"), F.floor(step / 25).cast("string")).alias("phase"),
    )
    g = x.groupingSets([[F.col(d)] for d in DIMENSIONS], *(F.col(d) for d in DIMENSIONS)).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 4).alias("sum_loss"), F.count_if(F.col("loss") > 6).alias("hot"), *(F.grouping(d).alias(f"no_{d}") for d in DIMENSIONS)
    )
    named = F.coalesce(*(F.when(F.col(f"no_{d}") == 0, F.lit(d)) for d in DIMENSIONS))
    value = F.coalesce(*(F.when(F.col(f"no_{d}") == 0, F.col(d)) for d in DIMENSIONS))
    return g.select(named.alias("dimension"), value.alias("value"), "n", "sum_loss", "hot")


@query(
    f"""WITH {OBS_SQL}, d AS (SELECT user_id, loss, ntile(10) OVER (PARTITION BY user_id ORDER BY step) AS decile FROM o), m AS (SELECT decile, avg(loss) AS mean FROM d GROUP BY decile), l AS (SELECT *, lag(mean) OVER (ORDER BY decile) AS before FROM m)
SELECT count(*)::BIGINT AS deciles, round(max(mean) - min(mean), 6) AS spread, bool_and(before IS NULL OR mean <= before) AS falls, bool_and(before IS NULL OR mean >= before) AS rises FROM l"""
)
def decile_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the mean loss over the deciles of position, and whether it only falls or only rises."""
    d = observations(spark, sf_dir).select("loss", F.ntile(10).over(Window.partitionBy("user_id").orderBy("step")).alias("decile"))
    m = d.groupBy("decile").agg(F.avg("loss").alias("mean"))
    l_ = m.withColumn("before", F.lag("mean").over(Window.orderBy("decile")))  # ten rows
    falls, rises = (F.bool_and(F.col("before").isNull() | c) for c in (F.col("mean") <= F.col("before"), F.col("mean") >= F.col("before")))
    return l_.agg(F.count(F.lit(1)).alias("deciles"), F.round(F.max("mean") - F.min("mean"), 6).alias("spread"), falls.alias("falls"), rises.alias("rises"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, b AS (SELECT lang, word, n, sum(n) OVER (PARTITION BY lang) AS total, sha256('9:' || word) AS k FROM c WHERE n BETWEEN 3 AND 3000), r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY k, word) AS seen FROM b)
SELECT lang, word, n::BIGINT AS n FROM r WHERE seen - n < 0.25 * total"""
)
def frequency_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that occur 3 to 3,000 times, in an order that a seed fixes, up to a quarter of what they cover together."""
    from corpusloom.operators.prefix import running_sums

    b = word_counts(spark, sf_dir).where("n between 3 and 3000").withColumn("k", F.sha2(F.concat(F.lit("9:"), "word"), 256))
    total = b.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    seen = running_sums(b, "lang", ["k", "word"], {"seen": F.col("n")}, F.substring("k", 1, 2)).join(F.broadcast(total), "lang")
    return seen.where(F.col("seen") - F.col("n") < 0.25 * F.col("total")).select("lang", "word", "n")


@query(
    """WITH v AS (SELECT vec_id, embedding, vec_id % 25 = 0 AS listed FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS token, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 6) AS score FROM v a JOIN v b ON b.listed),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token) AS k FROM s) SELECT vec_id, token, round(score, 4) AS score FROM r WHERE k = 1"""
)
def nearest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of a vocabulary (every 25th vector) with the largest inner product with each vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = best_products(e, e.where("vec_id % 25 = 0"))
    return found.select("vec_id", "token", F.round("score", 4).alias("score"))


@query(
    """WITH e AS (SELECT event_type AS lane, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 8) AS batch, value FROM events)
SELECT lane, batch, batch // 4 AS width, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM e GROUP BY 1, 2, 3"""
)
def isolated_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by arm, where a missing setting is its default before grouping, so that arms are not pooled; the width is derived, not read."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("lane"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(8)).alias("batch"), "value")
    return e.groupBy("lane", "batch", F.floor(F.col("batch") / 4).alias("width")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH s AS (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
SELECT CASE WHEN shipped IS NULL THEN 'NOT-RETURNED' WHEN o_orderdate IS NULL THEN 'NO-PAPER' WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(shipped AS DATE)) <= 30 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict, count(*)::BIGINT AS n, min(date_diff('day', CAST(o_orderdate AS DATE), CAST(shipped AS DATE)))::BIGINT AS least_days FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1"""
)
def stored_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored dates against those of another source, with a verdict for every way in which they may not meet."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("shipped"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered")).join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    days = F.date_diff("shipped", "ordered")
    verdict = F.when(F.col("shipped").isNull(), "NOT-RETURNED").when(F.col("ordered").isNull(), "NO-PAPER").when(days <= 30, "MATCH").otherwise("MISMATCH")
    return o.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.min(days).cast("long").alias("least_days"))


@query(
    """WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), a AS (SELECT lang, source FROM s WHERE n < 3), b AS (SELECT lang, source FROM s WHERE n * 0.82 < 3) SELECT * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def newly_infeasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that have too little only after a rejection of 18 in a hundred: a difference of two sets."""
    s = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    cells = lambda keep: s.where(F.col("n") * keep < 3).select("lang", "source")
    return cells(0.82).exceptAll(cells(1.0))


@query(
    """WITH r AS (SELECT source, max(doc_id // 10) AS top FROM documents GROUP BY source), a AS (SELECT source, unnest(range(0, top + 1)) AS slot FROM r), h AS (SELECT DISTINCT source, doc_id // 10 AS slot FROM documents)
SELECT a.source, count(*)::BIGINT AS missing, min(a.slot)::BIGINT AS first_missing FROM a LEFT JOIN h ON h.source = a.source AND h.slot = a.slot WHERE h.slot IS NULL GROUP BY a.source"""
)
def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which numbers of a list are not covered: each source's slots of ten ids, from zero to its last."""
    d = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 10).alias("slot")).distinct()
    # Gaps lie between neighbours, so no list of all numbers is made but of those that are missing.
    before = F.coalesce(F.lag("slot").over(Window.partitionBy("source").orderBy("slot")), F.lit(-1))
    gaps = d.withColumn("before", before).where(F.col("slot") - F.col("before") > 1)
    return gaps.groupBy("source").agg(F.sum(F.col("slot") - F.col("before") - 1).alias("missing"), F.min(F.col("before") + 1).alias("first_missing"))


@query("SELECT part, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT 'en' AS part, n_chars FROM documents WHERE lang = 'en' UNION ALL SELECT 'other', n_chars FROM documents WHERE lang <> 'en' UNION ALL SELECT 'bench', length(text) FROM benchmark) GROUP BY part")
def concatenated_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    parts = d.where("lang = 'en'").select(F.lit("en").alias("part"), "n_chars").unionByName(d.where("lang <> 'en'").select(F.lit("other").alias("part"), "n_chars"))
    parts = parts.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("bench").alias("part"), F.length("text").cast("long").alias("n_chars")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """SELECT p_brand, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 4) AS scale, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2, round(sqrt(regr_syy(ln(l_extendedprice), ln(l_quantity)) * (1 - regr_r2(ln(l_extendedprice), ln(l_quantity))) / (count(*) - 2)), 6) AS residual_sd FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"""
)
def fit_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R squared and the deviation of the residuals of a fit of logarithms."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    y, x = F.ln("l_extendedprice"), F.ln("l_quantity")
    sd = F.sqrt(F.regr_syy(y, x) * (1 - F.regr_r2(y, x)) / (F.count(F.lit(1)) - 2))
    return joined.groupBy("p_brand").agg(F.round(F.exp(F.regr_intercept(y, x)), 4).alias("scale"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(sd, 6).alias("residual_sd"))


@query(
    f"""WITH {OBS_SQL}, p AS (SELECT lane, step // 16 AS batch, avg(loss) AS y FROM o GROUP BY 1, 2), l AS (SELECT lane, batch, y, lag(y) OVER (PARTITION BY lane ORDER BY batch) AS before, lag(batch) OVER (PARTITION BY lane ORDER BY batch) AS b0 FROM p)
SELECT lane, batch::BIGINT AS batch, round(ln(y / before) / ln((batch + 1) / (b0 + 1)), 6) AS exponent FROM l WHERE before IS NOT NULL"""
)
def local_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponent between each two adjacent batch numbers of a lane, from the ratio of their mean losses."""
    p = observations(spark, sf_dir).groupBy("lane", F.floor(F.col("step") / 16).alias("batch")).agg(F.avg("loss").alias("y"))
    w = Window.partitionBy("lane").orderBy("batch")
    l_ = p.withColumns({"before": F.lag("y").over(w), "b0": F.lag("batch").over(w)}).where("before is not null")
    return l_.select("lane", "batch", F.round(F.ln(F.col("y") / F.col("before")) / F.ln((F.col("batch") + 1) / (F.col("b0") + 1)), 6).alias("exponent"))


@query("SELECT source, count(*)::BIGINT AS n, (count(*) - count(DISTINCT coalesce(text, '')))::BIGINT AS same_again, count(*) FILTER (WHERE coalesce(text, '') = '')::BIGINT AS empties, count(DISTINCT coalesce(text, ''))::BIGINT AS distinct_texts FROM documents GROUP BY source")
def same_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated, empty and distinct strings by source; texts are told apart by their digest, and copies are counted before they are shuffled."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), (F.coalesce("text", F.lit("")) == "").alias("empty"))
    each = d.groupBy("source", "digest", "empty").agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("source").agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("same_again"), F.sum(F.when(F.col("empty"), F.col("k")).otherwise(0)).alias("empties"), F.count(F.lit(1)).alias("distinct_texts"))


@query(
    f"""WITH {MASK_SQL}, w AS (SELECT conv_id, win, list(seg ORDER BY i) AS s, list(pos ORDER BY i) AS p, list(mask ORDER BY i) AS m FROM q GROUP BY 1, 2)
SELECT conv_id, win::BIGINT AS win, substr(sha256('{{"mask":[' || array_to_string(m, ',') || '],"position":[' || array_to_string(p, ',') || '],"segment":[' || array_to_string(s, ',') || ']}}'), 1, 16) AS sample_id FROM w"""
)
def window_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of a packed window: the first sixteen digits of the hash of its mask, positions and segments."""
    return windows(spark, sf_dir).select("conv_id", F.col("win").cast("long").alias("win"), F.substring(F.sha2(F.to_json(F.struct("mask", "position", "segment")), 256), 1, 16).alias("sample_id"))


@query(f"WITH {MASK_SQL} SELECT role, count(*)::BIGINT AS observed, count(DISTINCT conv_id)::BIGINT AS conversations, round(avg(pos), 4) AS mean_position FROM q WHERE mask = 1 GROUP BY role")
def observed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each token that bears loss, under the role of the token that is predicted."""
    rows = windows(spark, sf_dir).select("conv_id", F.explode(F.arrays_zip("position", "role", "mask")).alias("t")).where("t.mask = 1")
    return rows.groupBy("t.role").agg(F.count(F.lit(1)).alias("observed"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg("t.position"), 4).alias("mean_position"))


CAP = 6


@query(
    f"""WITH RECURSIVE {WORD_COUNTS_SQL}, t AS (SELECT DISTINCT word FROM c), f(word, i, used, k) AS (SELECT word, 0, 0, 0 FROM t UNION ALL SELECT word, i + 1, CASE WHEN used + octet_length(encode(substr(word, i + 1, 1))) > {CAP} OR i = 0 THEN octet_length(encode(substr(word, i + 1, 1))) ELSE used + octet_length(encode(substr(word, i + 1, 1))) END,
 k + CASE WHEN used + octet_length(encode(substr(word, i + 1, 1))) > {CAP} OR i = 0 THEN 1 ELSE 0 END FROM f WHERE i < length(word)), p AS (SELECT word, k FROM f WHERE i = length(word))
SELECT lang, sum(n)::BIGINT AS words, sum(n * k)::BIGINT AS pieces, sum(n * CAST(ceil(octet_length(encode(c.word)) / {CAP}) AS BIGINT))::BIGINT AS by_bytes_alone FROM c JOIN p ON p.word = c.word GROUP BY lang"""
)
def fertility_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest pieces of at most six bytes that cut words between characters only, and what bytes alone would need."""
    step = lambda s, c: F.struct(
        F.when((s["k"] == 0) | (s["used"] + F.octet_length(c) > CAP), F.octet_length(c)).otherwise(s["used"] + F.octet_length(c)).alias("used"),
        (s["k"] + F.when((s["k"] == 0) | (s["used"] + F.octet_length(c) > CAP), 1).otherwise(0)).alias("k"),
    )
    chars = F.filter(F.split("word", ""), lambda c: c != "")
    pieces = F.aggregate(chars, F.struct(F.lit(0).alias("used"), F.lit(0).alias("k")), step, lambda s: s["k"])
    c = word_counts(spark, sf_dir).select("lang", "n", pieces.alias("k"), F.ceil(F.octet_length("word") / CAP).alias("b"))
    return c.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.col("n") * F.col("k")).alias("pieces"), F.sum(F.col("n") * F.col("b")).alias("by_bytes_alone"))


@query(
    f"""WITH {OBS_SQL}, x AS (SELECT CASE WHEN step < 20 THEN 'warm' WHEN step < 60 THEN 'main' ELSE 'anneal' END AS stage, CASE WHEN step % 4 = 0 THEN 8 ELSE 16 END AS tokens, step % 4 <> 0 AS useful, loss AS seconds FROM o)
SELECT stage, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / (16.0 * count(*)), 6) AS utilization, round(sum(tokens) FILTER (WHERE useful) / sum(tokens), 6) AS useful_fraction, round(sum(tokens) / sum(seconds), 4) AS tokens_per_second, round(sum(tokens) FILTER (WHERE useful) / sum(seconds), 4) AS useful_per_second FROM x GROUP BY stage"""
)
def stage_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilization, useful fraction and rates by stage."""
    step = F.col("step")
    x = observations(spark, sf_dir).select(
        F.when(step < 20, "warm").when(step < 60, "main").otherwise("anneal").alias("stage"), F.when(step % 4 == 0, 8).otherwise(16).alias("tokens"), (step % 4 != 0).alias("useful"), F.col("loss").alias("seconds")
    )
    tokens, useful = F.sum("tokens"), F.sum(F.when(F.col("useful"), F.col("tokens")))
    return x.groupBy("stage").agg(
        tokens.alias("tokens"), F.round(tokens / (16.0 * F.count(F.lit(1))), 6).alias("utilization"), F.round(useful / tokens, 6).alias("useful_fraction"),
        F.round(tokens / F.sum("seconds"), 4).alias("tokens_per_second"), F.round(useful / F.sum("seconds"), 4).alias("useful_per_second"),
    )


@query(
    f"""WITH {STEPS_SQL}, r AS (SELECT user_id, step + 1 AS t, (1 - power(0.9, step + 1)) / sqrt(1 - power(0.999, step + 1)) AS r FROM s)
SELECT user_id, count(*)::BIGINT AS steps, arg_max(t, r)::BIGINT AS peak_step, round(max(r), 6) AS peak, round(arg_max(r, t), 6) AS last FROM r GROUP BY user_id"""
)
def correction_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in each branch's run the ratio of bias corrections is largest, and what it is at the end."""
    t = (F.col("step") + 1).cast("long")
    r = steps(spark, sf_dir).select("user_id", t.alias("t"), ((1 - F.pow(F.lit(0.9), t)) / F.sqrt(1 - F.pow(F.lit(0.999), t))).alias("r"))
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.max_by("t", "r").alias("peak_step"), F.round(F.max("r"), 6).alias("peak"), F.round(F.max_by("r", "t"), 6).alias("last"))


@query(
    """WITH s AS (SELECT source, lang, count(*) AS supply FROM documents GROUP BY 1, 2), st(stage, share) AS (VALUES ('warm', 0.2), ('main', 0.6), ('anneal', 0.2)), d AS (SELECT stage, lang, share * 1000 / (SELECT count(DISTINCT lang) FROM documents) AS demand FROM st CROSS JOIN (SELECT DISTINCT lang FROM s))
SELECT stage, d.lang, round(demand, 4) AS demand, t.supply::BIGINT AS supply, demand <= t.supply AS met FROM d JOIN (SELECT lang, sum(supply) AS supply FROM s GROUP BY lang) t ON t.lang = d.lang"""
)
def stage_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of each stage for each lane, against its supply; three stages by a row a lane."""
    supply = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("supply"))
    n = supply.agg(F.count(F.lit(1)).alias("lanes"))
    stages = spark.createDataFrame([("warm", 0.2), ("main", 0.6), ("anneal", 0.2)], "stage string, share double")
    demand = F.col("share") * 1000 / F.col("lanes")
    return supply.crossJoin(F.broadcast(stages)).crossJoin(F.broadcast(n)).select("stage", "lang", F.round(demand, 4).alias("demand"), "supply", (demand <= F.col("supply")).alias("met"))


@query("SELECT a.source AS left_source, b.source AS right_source, count(*)::BIGINT AS shared FROM (SELECT DISTINCT source, sha256(coalesce(text, '')) AS h FROM documents) a JOIN (SELECT DISTINCT source, sha256(coalesce(text, '')) AS h FROM documents) b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2")
def shared_between_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two sources both serve: an intersection of their digests, which a registry and what is served must not have."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).distinct()
    several = d.groupBy("h").agg(F.array_sort(F.collect_set("source")).alias("s")).where("size(s) > 1")  # as many as there are sources
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left_source"), b.alias("right_source")))))
    return several.select(F.inline(pairs)).groupBy("left_source", "right_source").agg(F.count(F.lit(1)).alias("shared"))


@query(
    """WITH k AS (SELECT item_id, substr(sha256('canary:' || item_id), 1, 8) AS canary FROM benchmark), t AS (SELECT doc_id, text || CASE WHEN doc_id % 61 = 5 THEN ' canary ' || substr(sha256('canary:' || (SELECT min(item_id) FROM benchmark)), 1, 8) ELSE '' END AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, 'canary ([0-9a-f]{8})', 1)) AS canary FROM t) SELECT w.doc_id, k.item_id, w.canary FROM w JOIN k ON k.canary = w.canary"""
)
def canary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a registered canary, by an equi-join on the strings found; every 61st document was given one."""
    canary = lambda c: F.substring(F.sha2(F.concat(F.lit("canary:"), c.cast("string")), 256), 1, 8)
    items = table(spark, sf_dir, "benchmark").select("item_id", canary(F.col("item_id")).alias("canary"))
    planted = items.agg(F.min_by("canary", "item_id").alias("planted"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(planted))  # one row
    text = F.concat("text", F.when(F.col("doc_id") % 61 == 5, F.concat(F.lit(" canary "), "planted")).otherwise(""))
    found = d.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("canary ([0-9a-f]{8})"), F.lit(1))).alias("canary"))
    return found.join(items, "canary").select("doc_id", "item_id", "canary")


@query(
    """WITH t AS (SELECT doc_id, source, length(regexp_replace(text, '[^ ]', '', 'g')) + 1 AS n FROM documents), o AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS upto, sum(n) OVER (PARTITION BY source) AS total FROM t)
SELECT source, count(*) FILTER (WHERE upto <= 500)::BIGINT AS whole_in_val, least(500, any_value(total))::BIGINT AS val_tokens, greatest(0, any_value(total) - 500)::BIGINT AS train_tokens FROM o GROUP BY source"""
)
def held_out_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's first 500 tokens are held out by position, wherever that cuts a document."""
    from corpusloom.operators.prefix import running_sums

    n = F.length(F.regexp_replace("text", "[^ ]", "")) + 1
    t = table(spark, sf_dir, "documents").select("doc_id", "source", n.cast("long").alias("n"))
    o = running_sums(t, "source", ["doc_id"], {"upto": F.col("n")})
    total = F.sum("n")
    return o.groupBy("source").agg(F.count_if(F.col("upto") <= 500).alias("whole_in_val"), F.least(F.lit(500), total).alias("val_tokens"), F.greatest(F.lit(0), total - 500).alias("train_tokens"))


@query(
    """WITH s AS (SELECT event_id // 100 AS step, user_id % 8 AS shard, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS score FROM events)
SELECT step::BIGINT AS step, shard::BIGINT AS shard, count(*)::BIGINT AS named, count(score)::BIGINT AS scored, round(avg(score) + 1e-9, 4) AS mean_score FROM s GROUP BY 1, 2"""
)
def shard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of the decisions that a step names for a shard; what was not scored is named but counts in no mean."""
    s = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 100).alias("step"), (F.col("user_id") % 8).alias("shard"), F.when(F.col("event_type") != "error", F.col("value")).alias("score")
    )
    return s.groupBy("step", "shard").agg(F.count(F.lit(1)).alias("named"), F.count("score").alias("scored"), F.round(F.avg("score") + 1e-9, 4).alias("mean_score"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, e AS (SELECT lang, n, unnest(regexp_extract_all(hex(encode(word)), '..')[1:16]) AS b, unnest(range(0, least(16, octet_length(encode(word)))::BIGINT)) AS pos FROM c)
SELECT lang, count(DISTINCT b || ':' || pos)::BIGINT AS live_slots, count(DISTINCT b)::BIGINT AS live_bytes, (256 * 16 - count(DISTINCT b || ':' || pos))::BIGINT AS dead_slots, sum(n)::BIGINT AS uses FROM e GROUP BY lang"""
)
def live_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a table of bytes by sixteen positions that the words seen reach, and those that none does."""
    pairs = F.slice(F.filter(F.split(F.hex(F.encode("word", "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), 1, 16)
    e = word_counts(spark, sf_dir).select("lang", "n", F.posexplode(pairs).alias("pos", "b"))
    # A slot is counted once a language before distinct ones are.
    slots = e.groupBy("lang", "b", "pos").agg(F.sum("n").alias("n"))
    live = F.count(F.lit(1))
    return slots.groupBy("lang").agg(live.alias("live_slots"), F.count_distinct("b").alias("live_bytes"), (256 * 16 - live).alias("dead_slots"), F.sum("n").alias("uses"))


@query(
    """SELECT lang, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')))::BIGINT AS tokens, sum(octet_length(encode(text)))::BIGINT AS bytes, round(sum(octet_length(encode(text))) / sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))), 6) AS bytes_per_token,
 round(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))) / greatest(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))), 1), 6) AS pieces_per_word FROM documents GROUP BY lang"""
)
def tokens_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, bytes and pieces a word of each language."""
    from corpusloom.functions import text as fx

    d = table(spark, sf_dir, "documents").select(
        "lang", F.size(fx.words("text")).alias("w"), F.octet_length("text").alias("b"), F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0))).alias("p")
    )
    tokens = F.sum("w")
    return d.groupBy("lang").agg(tokens.alias("tokens"), F.sum("b").alias("bytes"), F.round(F.sum("b") / tokens, 6).alias("bytes_per_token"), F.round(F.sum("p") / F.greatest(tokens, F.lit(1)), 6).alias("pieces_per_word"))


@query(
    """WITH l AS (SELECT l_returnflag, l_partkey % 100 AS card, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS lag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'),
m AS (SELECT card, l_returnflag, max(lag) AS lag FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY lag DESC, card) AS place FROM m) SELECT l_returnflag, card::BIGINT AS card, lag::BIGINT AS lag, place::BIGINT AS place FROM r WHERE place <= 10"""
)
def longest_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest lags of each class, one class left out."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o"))
    l_ = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_returnflag", (F.col("l_partkey") % 100).alias("card"), F.col("l_shipdate").cast("date").alias("s"))
    m = l_.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag", "card").agg(F.max(F.date_diff("s", "o")).cast("long").alias("lag"))
    place = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("lag"), "card")).cast("long")
    return m.withColumn("place", place).where("place <= 10").select("l_returnflag", "card", "lag", "place")


@query(
    """WITH e AS (SELECT event_id // 16 AS batch, event_id, event_type, round(value * 100)::BIGINT AS cents FROM events), f AS (SELECT batch, '[' || string_agg('{"cents":' || cents || ',"id":' || event_id || ',"type":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS j FROM e GROUP BY batch)
SELECT batch::BIGINT AS batch, sha256(j) AS stored_hash, batch % 9 <> 4 AS agrees FROM f"""
)
def batch_field_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's stored hash against one made anew from its own fields; every ninth batch had a field changed since."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 16).alias("batch"), "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    fields = F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("cents"), F.col("event_type").alias("type"))))
    shown = lambda a: F.sha2(F.to_json(F.transform(a, lambda x: F.struct(x["cents"].alias("cents"), x["id"].alias("id"), x["type"].alias("type")))), 256)
    f = e.groupBy("batch").agg(fields.alias("f"))  # sixteen events a batch
    changed = F.when(F.col("batch") % 9 == 4, F.transform("f", lambda x: x.withField("cents", x["cents"] + 1))).otherwise(F.col("f"))
    return f.select("batch", shown(F.col("f")).alias("stored_hash"), (shown(F.col("f")) == shown(changed)).alias("agrees"))


@query("SELECT user_id, step_no AS step, shard, tokens, loss_hot, loss_full FROM (SELECT user_id, event_id // 100 AS step_no, event_id % 4 AS shard, count(*)::BIGINT AS tokens, ((sum(round(value * 100)::BIGINT) + 50 * count(*)) // (100 * count(*)))::BIGINT AS loss_hot, round(avg(value / 100), 6) AS loss_full FROM events GROUP BY 1, 2, 3)")
def exposure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each step and shard of a branch; a hot tier keeps the loss as whole hundredths, the full one six decimals."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("step"), (F.col("event_id") % 4).alias("shard"))
    cents, n = F.sum(F.round(F.col("value") * 100).cast("long")), F.count(F.lit(1))
    return e.agg(n.alias("tokens"), F.floor((cents + 50 * n) / (100 * n)).alias("loss_hot"), F.round(F.avg(F.col("value") / 100), 6).alias("loss_full"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, p AS (SELECT lang, word, regexp_extract_all(hex(encode(word)), '..') AS h FROM c), l AS (SELECT lang, word, list_concat(list_transform(h[1:12], lambda x: CAST('0x' || x AS INTEGER) + 1), list_transform(range(0, greatest(12 - len(h), 0)), lambda i: 0)) AS labels, len(h) <= 12 AS whole FROM p)
SELECT lang, count(*)::BIGINT AS types, count(*) FILTER (WHERE whole)::BIGINT AS round_trips, sum(len(list_filter(labels, lambda x: x = 0)))::BIGINT AS pads FROM l GROUP BY lang"""
)
def label_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as twelve byte labels and back: decoding stops at the first pad, and what was cut does not come back."""
    pairs = F.filter(F.split(F.hex(F.encode("word", "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    labels = F.slice(F.concat(F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int") + 1), F.array_repeat(F.lit(0), 12)), 1, 12)
    w = word_counts(spark, sf_dir).select("lang", "word", labels.alias("l"))
    stop = F.array_position("l", F.lit(0))
    used = F.when(stop > 0, F.slice("l", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("l"))
    back = F.array_join(F.transform(used, lambda x: F.lpad(F.hex((x - 1).cast("long")), 2, "0")), "")
    same = back == F.hex(F.encode("word", "UTF-8"))
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("types"), F.count_if(same).alias("round_trips"), F.sum(F.size(F.filter("l", lambda x: x == 0))).alias("pads"))
