"""Scans of the fixture tables by explicit schema, and readers for the other input formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; no schema is inferred from rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped, lines that are no object fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_plan(spark: SparkSession, path: str, schema: T.StructType | str, budgets: list[str], divisor: int = 1) -> DataFrame:
    """A multi-line JSON plan whose token budgets are divided by ``divisor``, rounded down."""
    plan = spark.read.schema(schema).option("multiLine", True).json(path)
    return plan.withColumns({c: F.floor(F.col(c) / divisor).cast("long") for c in budgets})


def text_lines(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """lang, line_no and line of (gzipped) text files named ``<lang>.txt`` or ``<lang>.txt.gz``, at most ``first`` lines of each."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    lines = lines.withColumn("lang", F.regexp_extract("file", r"^([^.]+)\.", 1)).withColumn("line_no", F.monotonically_increasing_id())
    if first is None:
        return lines.select("lang", "line_no", F.col("value").alias("line"))
    from pyspark.sql import Window

    ranked = lines.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("line_no")))
    return ranked.where(F.col("place") <= first).select("lang", F.col("place").alias("line_no"), F.col("value").alias("line"))


def text_column(spark: SparkSession, path: str) -> DataFrame:
    """The column ``text`` of a Parquet file, or else its last column."""
    df = spark.read.parquet(path)
    return df.select(F.col("text" if "text" in df.columns else df.columns[-1]).cast("string").alias("text"))


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and text of files, the plain copy going before a gzipped one of the same name."""
    files = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    plain = F.regexp_replace("path", r"\.gz$", "")
    best = files.groupBy(plain.alias("name")).agg(F.min_by("value", F.length("path")).alias("text"), F.min_by("path", F.length("path")).alias("path"))
    return best.select("path", "text")


def xml_entries(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The ``entry`` elements of an Atom feed."""
    return spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)


def code_files(spark: SparkSession, path: str, byte_budget: int, least: int = 500, seed: str = "0") -> DataFrame:
    """Source files in an order fixed by the seed, short ones skipped, up to a byte budget."""
    from corpusloom.operators.prefix import running_sums

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).load(path)
    files = files.where(F.col("length") >= least).withColumn("rank", F.sha2(F.concat_ws(":", F.lit(seed), "path"), 256))
    # Path and length are ordered; contents meet those that are taken.
    slim = files.select("path", "length", "rank", F.lit(0).alias("all"))
    upto = running_sums(slim, "all", ["rank", "path"], {"upto": F.col("length")}, F.substring("rank", 1, 2))
    taken = upto.where(F.col("upto") - F.col("length") < byte_budget).select("path")
    return files.join(taken, "path", "left_semi").select("path", "length", F.col("content").cast("string").alias("text"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
