"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, an external sort places equal ones side by
side, and a window compares whole neighbouring texts. Only a text that more rows share than a
partition should hold is spread over several runs; the runs of a text meet again in a small
aggregate of one row per run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._store import materialize, shuffle_partitions

#: [\x20\x09-\x0D], deleted before texts are compared.
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Bytes of text that splitters hold; they place equal texts together, and whole texts are compared after.
SPLITTER_BYTES = 32


def normalised(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE_SPACE, F.coalesce(text, F.lit("")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; null is the empty text. The row with
    the most code points in its original text stays, then the smallest id (null after all others);
    of rows repeated with the same id and length exactly one stays. An empty table gives an empty
    result. Other columns are not read, so their names may clash with the result's.

    With ``carry`` the result holds only the rows that stay, and in one more column, ``carried``, a
    struct of these columns of theirs.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    digest = F.xxhash64(normalised(text))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        *([F.struct(*carry).alias("carried")] if carry else []),
        text.alias("text"),
        normalised(text).alias("norm"),
        F.coalesce(F.length(text), F.lit(0)).alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("hash", F.xxhash64("norm"))
    # A text shared by more than a quarter of a partition's fair share is dealt over several runs.
    # At most four times the number of partitions can be that frequent, which bounds the broadcast.
    share = max(1, docs.count() // (4 * shuffle_partitions(spark)))
    frequent = docs.select(digest.alias("hash")).groupBy("hash").count().where(F.col("count") > share)
    frequent = frequent.select("hash", F.ceil(F.col("count") / share).cast("long").alias("n_runs"))
    ranged = (
        base.join(F.broadcast(frequent), "hash", "left")
        .withColumn("run", F.coalesce(F.pmod("row", "n_runs"), F.lit(0)))
        .withColumn("spread", F.col("n_runs").isNotNull())
        .withColumn("head", F.substring(F.encode("norm", "UTF-8"), 1, SPLITTER_BYTES))
        # One text goes through the shuffle: the carried one, or the normalised one.
        .drop("n_runs", *(("norm",) if carry else ("text",)))
        .repartitionByRange("head", "hash", "run")
    )
    if carry:
        ranged = ranged.withColumn("norm", normalised(F.col("text"))).drop("text")
    equal = Window.partitionBy("head", "hash", "norm", "run")
    best_first = equal.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"), "row")
    runs = ranged.select(
        "doc_id",
        *(["carried"] if carry else []),
        "n_chars",
        "row",
        "spread",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(best_first).alias("place"),
        F.first("doc_id").over(best_first).alias("run_keep"),
        F.count(F.lit(1)).over(equal).alias("run_size"),
    )
    if carry:  # the first of each run is the only one that may stay
        runs = runs.where("place = 1")
    runs = materialize(runs, "content-sort")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *(["carried"] if carry else [])]
    # The window has decided on a text that lies in one run.
    alone = runs.where("not spread").withColumns({"keep_id": F.col("run_keep"), "group_size": F.col("run_size"), "kept": F.col("place") == 1})
    # The runs of a frequent text meet in an aggregate of one row per run, as few as frequent texts are.
    # The order of this struct is the order of preference: longest, then an id, the smallest, one row.
    rank = F.struct((-F.col("n_chars")).alias("len"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = runs.where("spread and place = 1").groupBy("text_sha256").agg(F.min(rank).alias("best"), F.sum("run_size").alias("group_size"))
    groups = groups.select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    apart = runs.where("spread").join(F.broadcast(groups), "text_sha256").withColumn("kept", F.col("row") == F.col("keep_row"))
    both = alone.select(columns).unionByName(apart.select(columns))
    return both.where("kept") if carry else both


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
