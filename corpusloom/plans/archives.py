"""Tables by way of other file formats: crawl archives and arrays, written to the shared folder and scanned back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources.arrays import scan_arrays, write_arrays
from corpusloom.sources.store import shared_dir
from corpusloom.sources.tables import table
from corpusloom.sources.wet import conversions, scan_wet, write_wet


def archived_pages(spark: SparkSession, sf_dir: str, split_bytes: int = 1 << 18) -> DataFrame:
    """Every page as a record of an archive, read by tasks that share the archives."""
    folder = f"{shared_dir(spark)}/wet-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    write_wet(pages.select(F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"), "url", F.col("html").alias("text")), folder)
    found = conversions(scan_wet(spark, folder, split_bytes))
    return found.withColumn("page_id", F.regexp_extract("record_id", "page:(-?[0-9]+)", 1).cast("long"))


@query("SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes, length(coalesce(html, ''))::BIGINT AS n_chars, sha256(coalesce(html, '')) AS text_sha256, FALSE AS truncated FROM pages")
def wet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(spark, sf_dir).select("page_id", "url", F.col("length").alias("bytes"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "truncated")


@query(
    r"""WITH w AS (SELECT page_id, regexp_replace(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '^www\.', '') AS host, len(list_filter(string_split_regex(coalesce(html, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS words FROM pages)
SELECT host, count(*)::BIGINT AS records, sum(words)::BIGINT AS words, max(words)::BIGINT AS most, count(*) FILTER (WHERE words >= 50)::BIGINT AS long_enough FROM w GROUP BY host"""
)
def wet_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First figures of a crawl: records and words of each host, straight from the archives."""
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    host = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1), r"^www\.", "")
    w = archived_pages(spark, sf_dir).select(host.alias("host"), words.cast("long").alias("words"))
    return w.groupBy("host").agg(F.count(F.lit(1)).alias("records"), F.sum("words").alias("words"), F.max("words").alias("most"), F.count_if(F.col("words") >= 50).alias("long_enough"))


def stored_vectors(spark: SparkSession, sf_dir: str, schema: str, columns: list[int] | None = None) -> DataFrame:
    """The embeddings from npz files of their own; rows that arrays cannot hold stay out."""
    folder = f"{shared_dir(spark)}/npz-{uuid.uuid4().hex}"
    fit = F.col("embedding").isNotNull() & (F.size("embedding") == 64) & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    write_arrays(table(spark, sf_dir, "embeddings").where(fit).select("vec_id", "embedding", "label"), folder, file_rows=1 << 14)
    return scan_arrays(spark, folder, schema, columns, partition_rows=1 << 12)


@query(
    """SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS dim, sha256(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT) AS VARCHAR)), ',')) AS vector_sha256
FROM embeddings WHERE len(embedding) = 64 AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0"""
)
def array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored_vectors(spark, sf_dir, "vec_id long, embedding array<float>, label int")
    exact = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4096).cast("string"))
    return v.select("vec_id", F.col("label").cast("long").alias("label"), F.size("embedding").cast("long").alias("dim"), F.sha2(F.array_join(exact, ","), 256).alias("vector_sha256"))


@query(
    """SELECT label::BIGINT AS label, count(*)::BIGINT AS n, CAST(sum(CAST(floor(CAST(embedding[1] AS DOUBLE) * 4096) AS BIGINT)) AS BIGINT) AS first, CAST(sum(CAST(floor(CAST(embedding[64] AS DOUBLE) * 4096) AS BIGINT)) AS BIGINT) AS last
FROM embeddings WHERE len(embedding) = 64 AND label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 GROUP BY label"""
)
def array_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components of every vector, summed by label; the reader hands on no others, and no ids."""
    v = stored_vectors(spark, sf_dir, "embedding array<float>, label int", columns=[0, 63])
    exact = lambda k: F.sum(F.floor(F.col("embedding")[k].cast("double") * 4096))
    return v.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), exact(0).alias("first"), exact(1).alias("last"))
