"""Runs of a loader: refused checkpoints, shifts of the mixture, seeded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import derived_int
from corpusloom.plans.registry import query
from corpusloom.plans.statistics import WORD_COUNTS_SQL, word_counts
from corpusloom.plans.windows import STEPS_SQL, steps
from corpusloom.sources.tables import table

#: Hashes that a checkpoint carries, and what their disagreement means.
SEALS = {"state": "state_corrupt", "plan": "plan_changed", "offset": "log_moved"}


@query(
    f"""WITH {STEPS_SQL}, c AS (SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS state, count(DISTINCT event_type)::BIGINT AS plan, max(step)::BIGINT AS last_step FROM s GROUP BY user_id)
SELECT user_id, CASE user_id % 4 WHEN 1 THEN 'state_corrupt' WHEN 2 THEN 'plan_changed' WHEN 3 THEN 'log_moved' ELSE 'loaded' END AS verdict, CASE WHEN user_id % 4 = 0 THEN last_step END AS resumes_at FROM c"""
)
def checkpoint_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints carry hashes of state, plan and log offset; one that disagrees with what is found is refused by its name, before anything is read from it."""
    c = steps(spark, sf_dir).groupBy("user_id").agg(
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("state"), F.count_distinct("event_type").alias("plan"), F.max("step").cast("long").alias("offset")
    )
    sealed = c.withColumns({f"{n}_hash": F.sha2(F.concat_ws(":", F.lit(n), F.col(n).cast("string")), 256) for n in SEALS})
    # What happened to the files since: of four checkpoints three were touched, each in one place.
    found = sealed.withColumns({n: F.col(n) + F.when(F.col("user_id") % 4 == k, 1).otherwise(0) for k, n in enumerate(SEALS, 1)})
    verdict = F.lit("loaded")
    for n, why in reversed(SEALS.items()):
        verdict = F.when(F.sha2(F.concat_ws(":", F.lit(n), F.col(n).cast("string")), 256) != F.col(f"{n}_hash"), why).otherwise(verdict)
    return found.select("user_id", verdict.alias("verdict")).join(c.select("user_id", "offset"), "user_id").select("user_id", "verdict", F.when(F.col("verdict") == "loaded", F.col("offset")).alias("resumes_at"))


@query(
    """WITH u AS (SELECT vec_id // 100 AS step, label AS expert, count(*) AS n FROM embeddings GROUP BY 1, 2), g AS (SELECT s.step, x.expert, coalesce(u.n, 0) AS n FROM (SELECT DISTINCT step FROM u) s CROSS JOIN (SELECT DISTINCT expert FROM u) x LEFT JOIN u ON u.step = s.step AND u.expert = x.expert),
m AS (SELECT *, avg(n) OVER (PARTITION BY step) AS mean FROM g) SELECT step::BIGINT AS step, expert::BIGINT AS expert, n::BIGINT AS used, round(sum(0.001 * sign(mean - n)) OVER (PARTITION BY expert ORDER BY step), 6) AS bias FROM m"""
)
def expert_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expert's bias goes up by a fixed step where it was used less than the mean of its step, and down where more."""
    u = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("step"), F.col("label").cast("long").alias("expert")).agg(F.count(F.lit(1)).alias("n"))
    grid = u.select("step").distinct().join(F.broadcast(u.select("expert").distinct()))  # as many experts as labels
    g = grid.join(u, ["step", "expert"], "left").na.fill(0, ["n"])
    mean = g.groupBy("step").agg(F.avg("n").alias("mean"))
    moved = g.join(mean, "step").withColumn("move", 0.001 * F.signum(F.col("mean") - F.col("n")))
    return moved.select("step", "expert", F.col("n").alias("used"), F.round(F.sum("move").over(Window.partitionBy("expert").orderBy("step")), 6).alias("bias"))


@query(f"WITH {STEPS_SQL} SELECT event_id, CASE WHEN step < 20 THEN 'first_pool' ELSE 'second_pool' END AS pool, (step >= 20 AND step < 24)::BOOLEAN AS just_shifted FROM s")
def mixture_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool that serves each step, which changes at step 20 of a branch."""
    return steps(spark, sf_dir).select("event_id", F.when(F.col("step") < 20, "first_pool").otherwise("second_pool").alias("pool"), ((F.col("step") >= 20) & (F.col("step") < 24)).alias("just_shifted"))


WINDOW = 64


@query(
    f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > {WINDOW}), k AS (SELECT doc_id, text, n, unnest([0, 1, 2]) AS k FROM d),
o AS (SELECT doc_id, k, text, CAST('0x' || substr(sha256('23:' || doc_id || ':' || k), 1, 15) AS BIGINT) % (n - {WINDOW}) AS start FROM k)
SELECT doc_id, k::BIGINT AS k, start, sha256(substr(text, start + 1, {WINDOW})) AS window_sha FROM o"""
)
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of each long text, whose offsets a seed fixes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n")).where(F.col("n") > WINDOW)
    o = d.select("doc_id", "text", "n", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3)))).alias("k"))
    seed = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("23"), F.col("doc_id").cast("string"), F.col("k").cast("string")), 256), 1, 15), 16, 10).cast("long")
    start = (seed % (F.col("n") - WINDOW)).alias("start")
    return o.select("doc_id", "k", "text", start).select("doc_id", "k", "start", F.sha2(F.substring("text", F.col("start") + 1, F.lit(WINDOW)), 256).alias("window_sha"))


@query("SELECT doc_id, CAST('0x' || substr(sha256('5:' || source || ':' || doc_id), 1, 15) AS BIGINT) % 97 AS draw FROM documents WHERE CAST('0x' || substr(sha256('5:' || source || ':' || doc_id), 1, 15) AS BIGINT) % 97 < 10")
def derived_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a tenth of all documents, each kept by a number derived from a seed and its own name."""
    draw = derived_int(97, 5, F.col("source"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", draw.alias("draw")).where("draw < 10")


#: A pipeline's rules by name with their thresholds, and what a tokenizer is besides its vocabulary.
PIPELINE = {"min_words": "20", "near_duplicate": "0.55", "pii": "email,phone_in,street_address", "repeat_run": "32"}
TOKENIZER = {"specials": "<pad>,<eos>", "version": "1"}


def _canonical_sql(fixed: dict[str, str], measured: str, value: str) -> str:
    parts = {**{k: f"'{v}'" for k, v in fixed.items()}, measured: value}
    return " || ".join(["'{'", " || ',' || ".join(f"""'"{k}":"' || {parts[k]} || '"'""" for k in sorted(parts)), "'}'"])


@query(
    f"""WITH {WORD_COUNTS_SQL}, v AS (SELECT lang, CAST(sum(CAST('0x' || substr(sha256(word), 1, 12) AS HUGEINT)) AS VARCHAR) AS digest FROM c GROUP BY lang),
s AS (SELECT source, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY source)
SELECT 'tokenizer' AS kind, lang AS name, sha256({_canonical_sql(TOKENIZER, "vocabulary", "digest")}) AS hash FROM v UNION ALL SELECT 'pipeline', source, sha256({_canonical_sql(PIPELINE, "documents", "n")}) FROM s"""
)
def configuration_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of what each language's vocabulary and each source's pipeline is; a word more or less, or a threshold, gives another. Names of rules count, their text does not.

    A vocabulary enters by the sum of its words' hashes, so that its order tells nothing and no list of it is made.
    """

    def hashed(values: dict[str, str], measured: str, value: Column) -> Column:
        parts = {**{k: F.lit(v) for k, v in values.items()}, measured: value}
        return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts)))), 256).alias("hash")

    one = F.conv(F.substring(F.sha2("word", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    words = word_counts(spark, sf_dir).groupBy("lang").agg(F.sum(one).cast("string").alias("digest"))
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("n"))
    a = words.select(F.lit("tokenizer").alias("kind"), F.col("lang").alias("name"), hashed(TOKENIZER, "vocabulary", F.col("digest")))
    return a.unionByName(sources.select(F.lit("pipeline").alias("kind"), F.col("source").alias("name"), hashed(PIPELINE, "documents", F.col("n"))))


@query(
    """WITH m AS (SELECT source, count(*)::BIGINT AS n, string_agg(DISTINCT lang, '+' ORDER BY lang) AS langs FROM documents GROUP BY source)
SELECT source, '{"@type":"cr:FileSet","name":"' || source || '","prov:hadMember":' || n || ',"inLanguage":"' || langs || '"}' AS record FROM m"""
)
def provenance_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shard's manifest as a JSON record of its provenance."""
    m = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("langs"))
    record = F.struct(F.lit("cr:FileSet").alias("@type"), F.col("source").alias("name"), F.col("n").alias("prov:hadMember"), F.col("langs").alias("inLanguage"))
    return m.select("source", F.to_json(record).alias("record"))


LICENSE_SQL = """CASE WHEN regexp_matches(lower(coalesce(text, '')), 'all rights reserved|confidential') THEN 'unsafe' WHEN regexp_matches(lower(coalesce(text, '')), 'cc by-nc|noncommercial|non-commercial') THEN 'review' ELSE 'safe' END"""


@query(
    f"""WITH l AS (SELECT doc_id, source, {LICENSE_SQL} AS tier, doc_id <> min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS copy, lang NOT IN ('en', 'de', 'fr', 'es') AS foreign_, len(list_distinct(string_split(coalesce(text, ''), chr(10)))) < 0.7 * len(string_split(coalesce(text, ''), chr(10))) AS repeats FROM documents)
SELECT doc_id, tier, array_to_string(list_filter([CASE WHEN tier = 'unsafe' THEN 'license' END, CASE WHEN copy THEN 'dedup' END, CASE WHEN foreign_ THEN 'language' END, CASE WHEN repeats THEN 'repeats' END], lambda r: r IS NOT NULL), ',') AS reasons FROM l"""
)
def license_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License tier of each document, and the reasons against it in their fixed order; what is turned away keeps them."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    lines = F.split(text, "\n")
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.sha2(text, 256).alias("digest"),
        F.when(low.rlike("all rights reserved|confidential"), "unsafe").when(low.rlike("cc by-nc|noncommercial|non-commercial"), "review").otherwise("safe").alias("tier"),
        (F.size(F.array_distinct(lines)) < 0.7 * F.size(lines)).alias("repeats"),
    )
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    joined = d.join(first, "digest")
    against = (("license", F.col("tier") == "unsafe"), ("dedup", F.col("doc_id") != F.col("first_id")), ("language", ~F.col("lang").isin("en", "de", "fr", "es")), ("repeats", F.col("repeats")))
    return joined.select("doc_id", "tier", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in against))), ",").alias("reasons"))
