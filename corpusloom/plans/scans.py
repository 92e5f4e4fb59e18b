"""Scans with splits, budgets and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import derived_int
from corpusloom.operators.prefix import row_numbers, running_sums
from corpusloom.operators.similarity import small
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table


@query(
    """WITH s AS (SELECT *, CASE WHEN doc_id % 20 = 0 THEN 'test' WHEN doc_id % 20 = 1 THEN 'validation' WHEN doc_id % 20 = 2 THEN 'proxy' ELSE 'train' END AS split FROM documents)
SELECT split, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT lang)::BIGINT AS n_langs FROM s GROUP BY split"""
)
def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its split; the fixture has none, so one is derived from the id."""
    r = F.col("doc_id") % 20
    split = F.when(r == 0, "test").when(r == 1, "validation").when(r == 2, "proxy").otherwise("train")
    return table(spark, sf_dir, "documents").groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.count_distinct("lang").alias("n_langs")
    )


BYTE_BUDGET = 200_000


@query(
    f"""WITH b AS (SELECT doc_id, lang, octet_length(encode(text)) + 16 AS size, coalesce(sum(octet_length(encode(text)) + 16) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM documents WHERE length(text) >= 200) SELECT doc_id, lang, size::BIGINT AS size, before::BIGINT AS before FROM b WHERE before < {BYTE_BUDGET}"""
)
def byte_budget_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language in id order until a byte budget is reached; short ones are skipped."""
    size = (F.octet_length("text") + 16).cast("long")
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 200).select("doc_id", "lang", size.alias("size"))
    seen = running_sums(d, "lang", ["doc_id"], {"before": F.col("size")}).withColumn("before", F.col("before") - F.col("size"))
    return seen.where(F.col("before") < BYTE_BUDGET).select("doc_id", "lang", "size", "before")


@query(
    """WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('7:' || doc_id), doc_id) AS place FROM documents)
SELECT doc_id, lang, source, place::BIGINT AS place FROM r WHERE place <= 3"""
)
def seeded_cell_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three documents of each (language, source) cell in an order that the seed fixes."""
    order = Window.partitionBy("lang", "source").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id")
    r = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.row_number().over(order).cast("long").alias("place"))
    return r.where("place <= 3")


@query(
    """SELECT doc_id, source, CAST(('0x' || substr(sha256('11:' || source || ':' || doc_id), 1, 15)) AS BIGINT) % 1000 AS slot,
 row_number() OVER (PARTITION BY source ORDER BY sha256('11:' || source || ':' || doc_id), doc_id)::BIGINT AS place FROM documents"""
)
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in an order derived from the seed, and a derived integer below 1000."""
    key = F.sha2(F.concat_ws(":", F.lit("11"), "source", F.col("doc_id").cast("string")), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", "source", key.alias("key"))
    # The hash spreads evenly, so its first digits make even chunks of the order.
    placed = row_numbers(d, "source", ["key", "doc_id"], "place", F.substring("key", 1, 3))
    return placed.select("doc_id", "source", derived_int(1000, 11, F.col("source"), F.col("doc_id")).alias("slot"), "place")


@query(
    """WITH r AS (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS seen, sum(n_chars) OVER (PARTITION BY lang) AS total FROM documents)
SELECT doc_id, lang, seen > 0.95 * total AS held_out FROM r"""
)
def held_out_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twentieth of each language's characters is held out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    total = d.groupBy("lang").agg(F.sum("n_chars").alias("total"))
    seen = running_sums(d, "lang", ["doc_id"], {"seen": F.coalesce("n_chars", F.lit(0))}).join(small(total, "40"), "lang")
    return seen.select("doc_id", "lang", (F.col("seen") > F.col("total") * 0.95).alias("held_out"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(json_extract(props, '$.k'))::BIGINT AS with_k, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def json_props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.round(F.sum("value"), 3).alias("total")
    )
