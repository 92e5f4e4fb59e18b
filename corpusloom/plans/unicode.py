"""Bytes and characters: normal forms, safe cuts, byte alphabets, language scores, common substrings, hashed cells."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.functions.arrow_bytes import slices
from corpusloom.plans.codec import WORD_COUNTS_SQL, word_counts
from corpusloom.plans.registry import query
from corpusloom.plans.text import words_sql
from corpusloom.sources.tables import table

POSITIONS = 8


def in_arrow(df: DataFrame, column: str, f, out: str, kind: str) -> DataFrame:  # noqa: ANN001
    """``df`` with ``f`` of each value of a string column, null for null, in slices of Arrow batches, so that strings of one slice are held."""
    arrow = {"string": pa.string(), "long": pa.int64()}[kind]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, column):
                values = [None if v is None else f(v) for v in b.column(column).to_pylist()]
                yield pa.record_batch([*b.columns, pa.array(values, arrow)], names=[*b.schema.names, out])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInArrow(apply, f"{fields}, {out} {kind}")


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256, nfc_normalize(text) = text AS was_normal FROM documents")
def normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical composition of whole texts; what is normal already, as most is, is not built again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = in_arrow(d, "text", lambda t: t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t), "nfc", "string")
    return made.select("doc_id", F.sha2("nfc", 256).alias("nfc_sha256"), (F.col("nfc") == F.col("text")).alias("was_normal"))


def safe_cut(text: Column, n_bytes: int) -> Column:
    """The longest start of whole code points in at most ``n_bytes`` bytes."""
    points = F.split(F.substring(text, 1, n_bytes), "")
    step = lambda s, c: F.struct((s["used"] + F.octet_length(c)).alias("used"), (s["kept"] + F.when(s["used"] + F.octet_length(c) <= n_bytes, 1).otherwise(0)).alias("kept"))
    kept = F.aggregate(points, F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept")), step, lambda s: s["kept"])
    return F.substring(text, F.lit(1), kept)


@query(
    f"""WITH {WORD_COUNTS_SQL}, p AS (SELECT lang, word, list_sum([1 FOR i IN range(1, length(word) + 1) IF octet_length(encode(substr(word, 1, i))) <= {POSITIONS}]) AS k FROM c)
SELECT lang, word, substr(word, 1, coalesce(k, 0)::BIGINT) AS cut, octet_length(encode(substr(word, 1, coalesce(k, 0)::BIGINT)))::BIGINT AS cut_bytes FROM p"""
)
def safe_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = safe_cut(F.col("word"), POSITIONS)
    return word_counts(spark, sf_dir).select("lang", "word", cut.alias("cut")).withColumn("cut_bytes", F.octet_length("cut").cast("long"))


#: Printable bytes stand for themselves, the others for the code points from 256 on, in order.
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
ALPHABET = [chr(b) if b in PRINTABLE else chr(256 + [x for x in range(256) if x not in PRINTABLE].index(b)) for b in range(256)]
ALPHABET_SQL = """al AS (SELECT b, chr(CASE WHEN p THEN b ELSE 256 + (sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (ORDER BY b) - 1) END::INTEGER) AS c
 FROM (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS p FROM range(256) r(b)))"""


@query(
    f"""WITH {WORD_COUNTS_SQL}, {ALPHABET_SQL}, x AS (SELECT CAST('0x' || unnest(regexp_extract_all(hex(encode(word)), '..')) AS INTEGER) AS b, n FROM c)
SELECT al.b::BIGINT AS byte, al.c AS shown, sum(x.n)::BIGINT AS n FROM x JOIN al ON al.b = x.b GROUP BY al.b, al.c"""
)
def byte_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that the table's words have, the printable character that stands for each, and how often it occurs."""
    alphabet = F.broadcast(spark.createDataFrame(list(enumerate(ALPHABET)), "byte long, shown string"))
    pairs = F.filter(F.split(F.hex(F.encode("word", "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    each = word_counts(spark, sf_dir).select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    return each.withColumn("byte", F.conv("pair", 16, 10).cast("long")).join(alphabet, "byte").select("byte", "shown", "n")


@query(
    f"""WITH {WORD_COUNTS_SQL}, {ALPHABET_SQL}, m AS (SELECT list(c ORDER BY b) AS a FROM al)
SELECT lang, word, array_to_string(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: a[CAST('0x' || h AS INTEGER) + 1]), '') AS token, lower(hex(encode(word))) AS raw FROM c, m"""
)
def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as tokens of the byte alphabet, and their bytes back from the tokens."""
    alphabet = F.array(*map(F.lit, ALPHABET))
    back = F.map_from_arrays(alphabet, F.array(*(F.lit(f"{b:02x}") for b in range(256))))
    pairs = F.filter(F.split(F.hex(F.encode("word", "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    tokens = word_counts(spark, sf_dir).select("lang", "word", F.array_join(F.transform(pairs, lambda h: F.get(alphabet, F.conv(h, 16, 10).cast("int"))), "").alias("token"))
    raw = F.array_join(F.transform(F.filter(F.split("token", ""), lambda c: c != ""), lambda c: F.element_at(back, c)), "")
    return tokens.withColumn("raw", raw)


@query(
    f"""WITH w AS (SELECT doc_id, lang, {words_sql('text')} AS w FROM documents), p AS (SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM (SELECT lang, unnest(w) AS word FROM w) GROUP BY lang, word) WHERE k <= 40),
u AS (SELECT word, min(lang) AS lang FROM p GROUP BY word HAVING count(*) = 1), e AS (SELECT doc_id, unnest(w) AS word FROM w), s AS (SELECT e.doc_id, u.lang AS guess, count(*) AS n FROM e JOIN u ON u.word = e.word GROUP BY 1, 2),
b AS (SELECT doc_id, guess, n, sum(n) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, guess) AS k FROM s)
SELECT w.doc_id, CASE WHEN b.n / b.total > 0.5 THEN guess END AS language, round(b.n / b.total, 6) AS confidence FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND b.k = 1"""
)
def language_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each text by profiles learned from the table: the forty most common words of a language that no other one has among its own.

    The share of a text's profile words that speak for its best language is the confidence, and at least half must.
    Profiles are at most forty words a language, so they go to where the words are.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", fx.words("text").alias("w"))
    counts = d.select("lang", F.explode("w").alias("word")).groupBy("lang", "word").count()
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where("k <= 40")
    profile = top.groupBy("word").agg(F.min("lang").alias("guess"), F.count(F.lit(1)).alias("n")).where("n = 1").select("word", "guess")
    hits = d.select("doc_id", F.explode("w").alias("word")).join(F.broadcast(profile), "word").groupBy("doc_id", "guess").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "guess")).alias("b"), F.sum("n").alias("total"))
    share = -F.col("b.less") / F.col("total")
    best = best.select("doc_id", F.when(share > 0.5, F.col("b.guess")).alias("language"), F.round(share, 6).alias("confidence"))
    return d.select("doc_id").join(best, "doc_id", "left")


def common_substring(a: str, b: str) -> tuple[int, int, int]:
    """Length of the longest common stretch of bytes, and where it first starts in each."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    best, row = (0, 0, 0), np.zeros(len(y) + 1, dtype=np.int64)
    for i, c in enumerate(x):
        row[1:] = np.where(y == c, row[:-1] + 1, 0)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1 - int(row[j]), j - int(row[j]))
    return best


@query(
    """WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
s AS (SELECT a, b, x, y, unnest(range(1, length(x) + 1)) AS i FROM p), t AS (SELECT a, b, y, i, unnest([substr(x, i, k) FOR k IN range(1, length(x) - i + 2)]) AS z FROM s),
m AS (SELECT a, b, length(z) AS n, i - 1 AS start_a, strpos(y, z) - 1 AS start_b FROM t WHERE contains(y, z)), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, start_a, start_b) AS k FROM m)
SELECT p.a, p.b, coalesce(n, 0)::BIGINT AS n, coalesce(start_a, 0)::BIGINT AS start_a, coalesce(start_b, 0)::BIGINT AS start_b FROM p LEFT JOIN k ON k.a = p.a AND k.b = p.b AND k.k = 1"""
)
def common_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common stretch of each two names and its offsets."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))), F.col("a") < F.col("b"))  # 25 nations

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            best = [common_substring(x, y) for x, y in zip(f["x"], f["y"], strict=True)]
            yield pd.DataFrame({"a": f["a"], "b": f["b"], **{c: [v[i] for v in best] for i, c in enumerate(("n", "start_a", "start_b"))}})

    return p.mapInPandas(found, "a long, b long, n long, start_a long, start_b long")


FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv(word: str) -> int:
    h = FNV_OFFSET
    for byte in word.encode():
        h = (h ^ byte) * FNV_PRIME & (1 << 64) - 1
    return h


@query(
    f"""WITH RECURSIVE {WORD_COUNTS_SQL}, t AS (SELECT DISTINCT word FROM c), f(word, i, h) AS (SELECT word, 0, {FNV_OFFSET}::HUGEINT FROM t
 UNION ALL SELECT word, i + 1, (xor(h, CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS HUGEINT)) * {FNV_PRIME}) & 18446744073709551615::HUGEINT FROM f WHERE i < octet_length(encode(word)))
SELECT word, lower(lpad(printf('%x', (h // 4294967296)::BIGINT), 8, '0') || lpad(printf('%x', (h % 4294967296)::BIGINT), 8, '0')) AS hash FROM f WHERE i = octet_length(encode(word))"""
)
def word_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit hash of each word type by xor and multiplication, byte by byte."""
    words = word_counts(spark, sf_dir).select("word").distinct()
    return in_arrow(words, "word", lambda w: f"{fnv(w):016x}", "hash", "string")


@query(
    f"""WITH {WORD_COUNTS_SQL}, g AS (SELECT lang, word, list_distinct([w[i] || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM (SELECT lang, word, regexp_extract_all(hex(encode(word)), '..') AS w FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM c) WHERE k <= 30))
SELECT a.lang, a.word AS a, b.word AS b, round(len(list_intersect(a.g, b.g)) / sqrt(len(a.g) * len(b.g)), 6) AS cosine FROM g a JOIN g b ON a.lang = b.lang AND a.word < b.word WHERE len(list_intersect(a.g, b.g)) > 0"""
)
def cell_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the byte-pair cells of each language's thirty most common words: shared cells by the root of the product of their numbers."""
    top = word_counts(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where("k <= 30")
    pairs = F.filter(F.split(F.hex(F.encode("word", "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    n = F.size("p")
    cells = F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at("p", i), F.element_at("p", i + 1))))).otherwise(F.array().cast("array<string>"))
    g = top.select("lang", "word", pairs.alias("p")).select("lang", "word", cells.alias("g"))
    a, b = g.select("lang", F.col("word").alias("a"), F.col("g").alias("ga")), g.select("lang", F.col("word").alias("b"), F.col("g").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    return a.join(b, "lang").where("a < b").where(shared > 0).select("lang", "a", "b", F.round(shared / F.sqrt(F.size("ga") * F.size("gb")), 6).alias("cosine"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, b AS (SELECT lang, word, regexp_extract_all(hex(encode(word)), '..')[1:{POSITIONS}] AS h FROM c), e AS (SELECT lang, word, len(h) AS n, unnest([(CAST('0x' || h[i] AS INTEGER) + 1) * {POSITIONS} + i - 1 FOR i IN range(1, len(h) + 1)]) AS cell FROM b)
SELECT lang, word, string_agg(cell::VARCHAR, ',' ORDER BY cell) AS cells, string_agg(((cell % {POSITIONS}) * 257 + cell // {POSITIONS})::VARCHAR, ',' ORDER BY cell) AS transposed, round(1 / sqrt(max(n)), 6) AS value FROM e GROUP BY lang, word"""
)
def encoded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word as a sparse vector: one cell for each byte and its position, each one over the root of the length, in both layouts of the grid."""
    pairs = F.filter(F.split(F.hex(F.encode("word", "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    cell = F.transform(F.slice(pairs, 1, POSITIONS), lambda h, i: ((F.conv(h, 16, 10).cast("long") + 1) * POSITIONS + i).cast("long"))
    w = word_counts(spark, sf_dir).select("lang", "word", F.array_sort(cell).alias("c"))
    shown = lambda a: F.array_join(a.cast("array<string>"), ",")
    flat = F.transform("c", lambda x: (x % POSITIONS) * 257 + F.floor(x / POSITIONS))
    return w.where("size(c) > 0").select("lang", "word", shown(F.col("c")).alias("cells"), shown(flat).alias("transposed"), F.round(1 / F.sqrt(F.size("c")), 6).alias("value"))


@query(
    f"""WITH {WORD_COUNTS_SQL}, p AS (SELECT lang, word, unnest(string_split(word, '')) AS ch, unnest(range(0, length(word))) AS pos FROM c)
SELECT lang, word, string_agg((unicode(ch) // 128) || ':' || (unicode(ch) % 128), ' ' ORDER BY pos) AS blocks FROM p GROUP BY lang, word"""
)
def char_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code point as its block of 128 and its offset there."""
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    shown = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.concat_ws(":", F.floor(point(c) / 128).cast("string"), (point(c) % 128).cast("string")))
    return word_counts(spark, sf_dir).select("lang", "word", F.array_join(shown, " ").alias("blocks"))


@query(f"WITH {WORD_COUNTS_SQL}, v AS (SELECT DISTINCT word FROM c WHERE n >= 5) SELECT lang, count(*)::BIGINT AS types, count(*) FILTER (WHERE word IN (SELECT word FROM v))::BIGINT AS reachable, sum(n)::BIGINT AS tokens, sum(n) FILTER (WHERE word IN (SELECT word FROM v))::BIGINT AS reached_tokens FROM c GROUP BY lang")
def reachable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a vocabulary of those seen five times in one language reaches."""
    c = word_counts(spark, sf_dir)
    v = c.where("n >= 5").select("word").distinct().withColumn("known", F.lit(True))
    k = F.coalesce("known", F.lit(False))
    return c.join(v, "word", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("types"), F.count_if(k).alias("reachable"), F.sum("n").alias("tokens"), F.sum(F.when(k, F.col("n"))).alias("reached_tokens"))
