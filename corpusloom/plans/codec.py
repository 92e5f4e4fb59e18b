"""Byte-level codecs of words: labels, occupancy, floors and edit distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.functions.hashing import byte_bigram_cell
from corpusloom.plans.registry import query
from corpusloom.plans.statistics import WORD_COUNTS_SQL, word_counts
from corpusloom.plans.text import words_sql
from corpusloom.sources.tables import table

POSITIONS = 32


def byte_labels(word: Column) -> Column:
    """The word's bytes as numbers from 1 to 256."""
    pairs = F.filter(F.split(F.hex(F.encode(word, "UTF-8")), "(?<=\\G..)"), lambda b: b != "")
    return F.transform(pairs, lambda b: F.conv(b, 16, 10).cast("int") + 1)


def padded(labels: Column, n: int = POSITIONS) -> Column:
    """Exactly ``n`` labels, cut or filled up with 0."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit(0), n)), 1, n)


def decoded(labels: Column) -> Column:
    """The text up to the first pad; what a cut left of a character is replaced."""
    used = F.filter(labels, lambda x: x > 0)
    return F.try_validate_utf8(F.decode(F.unhex(F.array_join(F.transform(used, lambda x: F.lpad(F.hex((x - 1).cast("long")), 2, "0")), "")), "UTF-8"))


LABELS_SQL = "list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda b: CAST('0x' || b AS INTEGER) + 1)"


@query(
    f"""WITH {WORD_COUNTS_SQL}, l AS (SELECT lang, word, n, {LABELS_SQL} AS b FROM c)
SELECT lang, count(*)::BIGINT AS types, count(*) FILTER (WHERE len(b) > {POSITIONS})::BIGINT AS cut_types, sum(n) FILTER (WHERE len(b) > {POSITIONS})::BIGINT AS cut_tokens, round(avg(len(b)), 4) AS mean_bytes, max(len(b))::BIGINT AS longest FROM l GROUP BY lang"""
)
def byte_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = word_counts(spark, sf_dir).select("lang", "n", F.octet_length("word").alias("b"))
    cut = F.col("b") > POSITIONS
    return b.groupBy("lang").agg(
        F.count(F.lit(1)).alias("types"), F.count_if(cut).alias("cut_types"), F.sum(F.when(cut, F.col("n"))).alias("cut_tokens"), F.round(F.avg("b"), 4).alias("mean_bytes"), F.max("b").cast("long").alias("longest")
    )


@query(
    f"""WITH {WORD_COUNTS_SQL}, l AS (SELECT lang, {LABELS_SQL} AS b FROM c), e AS (SELECT lang, unnest(b[1:{POSITIONS}]) AS byte, unnest(range(0, least(len(b), {POSITIONS}))) AS pos FROM l)
SELECT lang, count(*)::BIGINT AS cells_used, count(DISTINCT byte * {POSITIONS} + pos)::BIGINT AS distinct_cells, max(pos)::BIGINT AS last_pos FROM e GROUP BY lang"""
)
def cell_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (byte, position) cells that word types reach; flat index byte * positions + position."""
    cells = word_counts(spark, sf_dir).select("lang", F.posexplode(F.slice(byte_labels(F.col("word")), 1, POSITIONS)).alias("pos", "byte"))
    return cells.groupBy("lang").agg(F.count(F.lit(1)).alias("cells_used"), F.count_distinct(F.col("byte") * POSITIONS + F.col("pos")).alias("distinct_cells"), F.max("pos").cast("long").alias("last_pos"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, d(width) AS (VALUES (16), (31), (64), (128), (256)) SELECT lang, width::BIGINT AS width, sum(n * CAST(ceil(octet_length(encode(word)) / CAST(width AS DOUBLE)) AS BIGINT))::BIGINT AS floor_tokens,
 round(sum(n * ceil(octet_length(encode(word)) / CAST(width AS DOUBLE))) / sum(n), 4) AS per_word FROM c CROSS JOIN d GROUP BY lang, width"""
)
def width_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least tokens per language for several byte widths: one scan, the widths being an explode of the grouped sizes."""
    sizes = word_counts(spark, sf_dir).groupBy("lang", F.octet_length("word").alias("b")).agg(F.sum("n").alias("n"))
    wide = sizes.select("lang", "b", "n", F.explode(F.array(*(F.lit(w).cast("long") for w in (16, 31, 64, 128, 256)))).alias("width"))
    tokens = F.col("n") * F.ceil(F.col("b") / F.col("width"))
    return wide.groupBy("lang", "width").agg(F.sum(tokens).alias("floor_tokens"), F.round(F.sum(tokens) / F.sum("n"), 4).alias("per_word"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, s AS (SELECT lang, word, CASE WHEN regexp_matches(word, '^[A-Za-z\\x{{00C0}}-\\x{{024F}}]+$') THEN 'latin' WHEN regexp_matches(word, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]') THEN 'mixed' ELSE 'nonalpha' END AS script, n FROM c)
SELECT lang, script, count(*)::BIGINT AS types, sum(n)::BIGINT AS tokens FROM s GROUP BY lang, script"""
)
def word_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = r"[A-Za-z\x{00C0}-\x{024F}]"
    script = F.when(F.col("word").rlike(f"^{latin}+$"), "latin").when(F.col("word").rlike(latin), "mixed").otherwise("nonalpha")
    return word_counts(spark, sf_dir).groupBy("lang", script.alias("script")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, a AS (SELECT word, {LABELS_SQL} AS b FROM (SELECT DISTINCT word FROM c)), p AS (SELECT unnest(list_zip(b[1:len(b) - 1], b[2:len(b)])) AS z FROM a WHERE len(b) > 1)
SELECT ((((z[1] - 1)::BIGINT * 257 + (z[2] - 1)::BIGINT * 1013904223) & 2147483647) % 8192)::BIGINT AS cell, count(*)::BIGINT AS n FROM p GROUP BY 1"""
)
def bigram_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(spark, sf_dir).select("word").distinct().select(byte_labels(F.col("word")).alias("b")).where(F.size("b") > 1)
    n = F.size("b") - 1
    pairs = words.select(F.explode(F.zip_with(F.slice("b", F.lit(1), n), F.slice("b", F.lit(2), n), lambda x, y: byte_bigram_cell(x - 1, y - 1))).alias("cell"))
    return pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"
)
def name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distances of the names within a region."""
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    pair = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, pair).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").alias("distance"))


@query(
    f"""WITH w AS (SELECT doc_id, lang, unnest({words_sql('text')}) AS word FROM documents), p AS (SELECT lang, len(regexp_extract_all(word, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+')) AS pieces FROM w)
SELECT lang, count(*)::BIGINT AS words, sum(pieces)::BIGINT AS pieces, round(avg(pieces), 4) AS per_word, max(pieces)::BIGINT AS worst FROM p GROUP BY lang"""
)
def pieces_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(fx.words("text")).alias("word"))
    p = words.select("lang", F.regexp_count("word", F.lit("[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")).alias("pieces"))
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("words"), F.sum("pieces").alias("pieces"), F.round(F.avg("pieces"), 4).alias("per_word"), F.max("pieces").cast("long").alias("worst"))


@query("SELECT label, vec_id, e1::BIGINT AS first_expert, e2::BIGINT AS second_expert, round(m, 5) AS margin FROM (SELECT label, vec_id, list_transform(list_sort(list_transform(range(1, 9), lambda i: {'s': -embedding[i], 'i': i}))[1:3], lambda x: x) AS t FROM embeddings) , LATERAL (SELECT t[1].i AS e1, t[2].i AS e2, CAST(t[2].s AS DOUBLE) - CAST(t[1].s AS DOUBLE) AS m)")
def expert_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two of eight experts with the highest scores, and how far apart they are."""
    scored = F.transform(F.slice("embedding", 1, 8), lambda x, i: F.struct((-x).alias("s"), (i + 1).alias("i")))
    t = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.array_sort(scored).alias("t"))
    first, second = F.col("t")[0], F.col("t")[1]
    return t.select("label", "vec_id", first["i"].cast("long").alias("first_expert"), second["i"].cast("long").alias("second_expert"), F.round(second["s"].cast("double") - first["s"], 5).alias("margin"))


@query(
    "WITH r AS (SELECT (list_position(embedding[1:8], list_max(embedding[1:8])))::BIGINT AS expert FROM embeddings) SELECT expert, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY expert"
)
def expert_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.slice("embedding", 1, 8)
    from pyspark.sql import Window

    r = table(spark, sf_dir, "embeddings").select(F.array_position(head, F.array_max(head)).alias("expert")).groupBy("expert").agg(F.count(F.lit(1)).alias("n"))
    return r.select("expert", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # a row an expert
