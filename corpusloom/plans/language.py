"""Language of texts by a linear model over hashed character n-grams, and scripts of words by the names of their letters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrow_bytes import LOWER, WindowHash, buffers, slices
from corpusloom.functions.scripts import scripts
from corpusloom.plans.registry import query
from corpusloom.plans.statistics import WORD_COUNTS_SQL, word_counts
from corpusloom.sources.tables import table

#: Bytes of the longest n-gram, buckets, labelled texts that the model is fitted on (at most), steps of the fit, shortest text that is no short one (bytes), confidence below which no language is given.
GRAMS, BUCKETS, SAMPLE, STEPS, SHORT, CONFIDENT = 4, 1 << 12, 2000, 300, 50, 0.6
#: Texts that are described at once, each by BUCKETS numbers (16 KB), however short they are.
DESCRIBED = 256


def features(column: pa.Array) -> np.ndarray:
    """One row for each text: square roots of the counts of its byte n-grams (A-Z lower-cased) by bucket, to length one; zeros for an empty text."""
    data, offsets = buffers(column)
    data = LOWER[data]
    out = np.zeros((len(offsets) - 1, BUCKETS), dtype=np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in range(1, GRAMS + 1):
        starts = np.flatnonzero(np.arange(len(data)) + n <= offsets[1:][row])
        bucket = WindowHash(data, seed=n)(starts, starts + n) % np.uint64(BUCKETS)
        out += np.bincount(row[starts] * BUCKETS + bucket.astype(np.int64), minlength=out.size).reshape(out.shape).astype(np.float32)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], steps: int = STEPS, rate: float = 8.0, decay: float = 1e-4) -> LanguageModel:
        """Softmax regression by gradient steps with momentum over all of the sample."""
        languages, at = np.unique(np.array(y, dtype=object), return_inverse=True)
        want = np.eye(len(languages), dtype=np.float32)[at]
        w, b = np.zeros((x.shape[1], len(languages)), np.float32), np.log(want.mean(axis=0))
        step = np.zeros_like(w)
        for _ in range(steps):
            off = _softmax(x @ w + b) - want
            step = 0.9 * step - rate * 0.1 * (x.T @ off / len(x) + decay * w)
            w += step
        return cls(list(languages), w, b)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = _softmax(x @ self.weights + self.bias)
        best = p.argmax(axis=1)
        return [self.languages[k] for k in best], p[np.arange(len(p)), best]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def drawn(id_col: str = "doc_id") -> Column:
    """Place of a row in the order in which rows are drawn for the sample."""
    return F.sha2(F.concat(F.lit("language:"), F.col(id_col).cast("string")), 256)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[LanguageModel, str | None]:
    """A model fitted on at most ``sample`` labelled texts, those of the smallest hashes of their ids, and the largest of these hashes.

    Rows behind that hash were not seen. Rows without id, text or language are not drawn. Texts travel as features.
    """
    fit = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.col(text_col) != ""))
    slim = fit.select(drawn(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).orderBy("key").limit(sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_rows=DESCRIBED):
                yield pa.record_batch([part.column("key"), part.column("lang"), pa.array([r.tobytes() for r in features(part.column("text"))], pa.binary())], names=["key", "lang", "x"])

    rows = slim.mapInArrow(describe, "key string, lang string, x binary").collect()
    rows.sort(key=lambda r: r.key)
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32)), None
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    return LanguageModel.fit(x, [r.lang for r in rows]), rows[-1].key


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """doc_id, language, confidence and short of every row.

    A text whose best language is less probable than ``confident`` has none; a null or empty text has
    neither language nor confidence and is short. Repeated rows and null ids are kept as they come.
    """

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_rows=DESCRIBED):
                x = features(part.column("text"))
                some = x.any(axis=1) if model.languages else np.zeros(len(x), dtype=bool)
                best, p = model.predict(x) if model.languages else ([None] * len(x), np.zeros(len(x)))
                sure = [b if s and c >= confident else None for b, c, s in zip(best, p, some, strict=True)]
                confidence = pa.array([float(c) if s else None for c, s in zip(p, some, strict=True)], pa.float64())
                yield pa.record_batch([part.column("doc_id"), pa.array(sure, pa.string()), confidence, part.column("short")], names=["doc_id", "language", "confidence", "short"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (F.octet_length(text) < SHORT).alias("short"))
    return slim.mapInArrow(guess, "doc_id long, language string, confidence double, short boolean")


@query()
def language_by_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, none where the model is not confident."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model, _ = train(docs)
    return identify(docs, model).withColumn("confidence", F.round("confidence", 6))


@query()
def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the labelled documents that the model was not fitted on: how many were named right, wrong and not at all, short texts apart.

    Where the table has no more than twice SAMPLE documents, the model is fitted on half of them.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("lang is not null and doc_id is not null")
    model, last = train(docs, sample=min(SAMPLE, max(1, docs.count() // 2)))
    held = docs.where(drawn() > F.lit(last or ""))
    found = identify(held, model).join(held.select("doc_id", "lang"), "doc_id")
    right = F.col("language") == F.col("lang")
    return found.groupBy("lang", "short").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"), F.count_if(F.col("language").isNull()).alias("rejected"))


# -- scripts by name

#: Bytes of a word that its beginning has.
CUT = 5


def with_script(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` plus the script of a binary or string column."""
    from pyspark.sql import types as T

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, scripts(batch.column(column))], names=[*batch.schema.names, out])

    return df.mapInArrow(add, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


@query(
    rf"""WITH {WORD_COUNTS_SQL}, b AS (SELECT *, octet_length(encode(word)) AS size FROM c),
k AS (SELECT *, list_max(list_filter(list_transform(range(0, {CUT} + 1), lambda k: CASE WHEN octet_length(encode(word[1:k])) <= {CUT} THEN k END), lambda k: k IS NOT NULL)) AS whole FROM b),
s AS (SELECT lang, n, CASE WHEN regexp_matches(word, '\p{{L}}') THEN 'LATIN' ELSE 'nonalpha' END AS script,
 CASE WHEN size > {CUT} AND octet_length(encode(word[1:whole])) < {CUT} THEN 'partial' WHEN regexp_matches(word[1:whole], '\p{{L}}') THEN 'LATIN' ELSE 'nonalpha' END AS beginning FROM k)
SELECT lang, script, beginning, count(*)::BIGINT AS types, sum(n)::BIGINT AS tokens FROM s GROUP BY ALL"""
)
def name_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of words and of their first five bytes, which may end within a character."""
    words = word_counts(spark, sf_dir).select("lang", "n", F.encode("word", "UTF-8").alias("raw"))
    named = with_script(with_script(words, "raw", "script").withColumn("cut", F.substring("raw", 1, CUT)), "cut", "beginning")
    return named.groupBy("lang", "script", "beginning").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"))
