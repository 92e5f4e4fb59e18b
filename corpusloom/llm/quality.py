"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds turn the score into
the probability of each grade. A bounded sample of labelled rows is fitted on the driver; scoring
reads every whole text in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._bytes import LOWER, NARROW_BYTES, SPACE, WindowHash, buffers, per_row, slices, spans

#: Hash buckets, labelled rows that are fitted (at most), steps, step size, ridge penalty.
BUCKETS, SAMPLE, STEPS, RATE, RIDGE = 1 << 17, 3000, 600, 0.05, 1e-5
#: Labelled texts that a feature must be in (or as many as the rarest grade has, if fewer), and how often a row of the toxic grade counts.
MIN_TEXTS, TOXIC_GRADE, TOXIC_WEIGHT = 5, 1, 3.0
#: A document stays when the probability of at least this grade is at least this high.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5

#: The grade of good documents that are not toxic, how probable it must be for a document to be clean, and the columns that scoring adds.
CLEAN_GRADE, CLEAN_PROBABILITY = 2, 0.65
SCORES = ("expected_grade", "tail_probability", "kept", "clean_probability", "clean")

#: What a byte looks like: upper case, lower case, digit, beyond ASCII; other bytes look like themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B], SHAPE[0x61:0x7B], SHAPE[0x30:0x3A], SHAPE[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a column of texts and each row's bounds among them.

    For each word [^\\x20\\x09-\\x0D]+: the lower-cased word, its shape with runs of one class
    shortened to one, and whether it repeats the word before it.
    """
    data, offsets = buffers(column)
    starts, ends = spans(~SPACE[data], offsets)
    bounds = per_row(starts, offsets)
    if not len(starts):
        return np.zeros((0, 3), np.int64), bounds
    words = WindowHash(LOWER[data], seed=1)(starts, ends)
    shape = SHAPE[data]
    change = np.ones(len(data), dtype=bool)
    change[1:] = shape[1:] != shape[:-1]
    change[starts] = True
    place = np.concatenate(([0], np.cumsum(change)))
    shapes = WindowHash(shape[change], seed=2)(place[starts], place[ends])
    again = np.zeros(len(words), dtype=np.uint64)
    again[1:] = words[1:] == words[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    again[first] = 0
    # Bucket 0 and 1 tell whether a word repeats the one before; the other features share the rest.
    rest = np.uint64(BUCKETS - 2)
    return np.stack([(words % rest).astype(np.int64) + 2, (shapes % rest).astype(np.int64) + 2, again.astype(np.int64)], axis=1), bounds


def weighted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every distinct feature of every text, in the order of rows.

    A value is the logarithm of one more than the feature's count, over the square root of the text's
    words, so that a few decisive words are not lost among many others.
    """
    found, bounds = features(column)
    words = np.diff(bounds)
    row = np.repeat(np.arange(len(words)), words)
    key, counts = np.unique((row[:, None] * BUCKETS + found).ravel(), return_counts=True)
    row = key // BUCKETS
    return row, key % BUCKETS, np.log1p(counts) / np.sqrt(words[row])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled text as its distinct buckets and their values, so that long texts cost the driver no more than the buckets."""
    for batch in batches:
        for part in slices(batch, "text", NARROW_BYTES):
            row, bucket, value = weighted(part.column("text"))
            edges = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, kind)) for x, kind in ((bucket, pa.int32()), (value, pa.float32()))]
            yield pa.record_batch([part.column("grade").cast(pa.int32()), *lists], names=["grade", "bucket", "share"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class OrdinalModel:
    """P(grade > k) = sigmoid(score - threshold[k]); thresholds ascend."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, index: np.ndarray, share: np.ndarray, rows: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray | None = None) -> OrdinalModel:
        """Maximum likelihood by Adam over the sparse values (index, share, rows), the same for the same sample; ``weight`` says how often a row counts."""
        n = len(grade)
        weight = np.ones(n) if weight is None else weight
        total = weight.sum()
        w = np.zeros(BUCKETS)
        tail = np.array([weight[grade > k].sum() / total for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
        start = np.log((1 - tail) / tail)
        # Thresholds as the first one and the logarithms of the gaps, so that they stay ordered.
        t = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 0.05))))
        x = np.concatenate((w, t))
        m, v = np.zeros_like(x), np.zeros_like(x)
        for step in range(1, STEPS + 1):
            w, t = x[:BUCKETS], x[BUCKETS:]
            theta = np.cumsum(np.concatenate((t[:1], np.exp(t[1:]))))
            score = np.bincount(rows, share * w[index], minlength=n)
            # P(grade = g) = P(> g - 1) - P(> g), with P(> -1) = 1 and P(> last) = 0.
            over = np.concatenate((np.ones((n, 1)), _sigmoid(score[:, None] - theta), np.zeros((n, 1))), axis=1)
            slope = over * (1 - over)
            at = np.arange(n)
            p = np.maximum(over[at, grade] - over[at, grade + 1], 1e-12)
            p = p * total / weight
            by_score = (slope[at, grade] - slope[at, grade + 1]) / p
            by_theta = np.array([(slope[at, k + 1] * ((grade == k) * 1.0 - (grade == k + 1)) / p).sum() for k in range(grades - 1)])
            # theta[k] = t[0] + exp(t[1]) + ... + exp(t[k])
            down = np.cumsum(by_theta[::-1])[::-1]
            by_t = np.concatenate((down[:1], down[1:] * np.exp(t[1:])))
            g = -np.concatenate((np.bincount(index, share * by_score[rows], minlength=BUCKETS) - RIDGE * w, by_t))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        w, t = x[:BUCKETS], x[BUCKETS:]
        return cls(w.astype(np.float32), np.cumsum(np.concatenate((t[:1], np.exp(t[1:])))))

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) of each text for each k."""
        row, bucket, value = weighted(column)
        score = np.bincount(row, value * self.weights[bucket], minlength=len(column))
        return _sigmoid(score[:, None] - self.thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 for low quality, 1 for good but toxic, 2 for good and clean; the lowest of contradicting labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on at most ``sample`` rated documents, chosen by a hash of their ids; None where fewer than two grades are rated."""
    rated = ratings.select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # Of rows that repeat an id, the first text in their order, whichever comes first.
    rows = texts.join(F.broadcast(rated), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    table = rows.mapInArrow(_sparse, "grade int, bucket array<int>, share array<float>").toArrow()
    grade = np.asarray(table["grade"], dtype=np.int64)
    known, level = np.unique(grade, return_inverse=True)
    if len(known) < 2:
        return None
    bucket = table["bucket"].combine_chunks()
    lengths = np.diff(np.asarray(bucket.offsets))
    index = np.asarray(bucket.flatten(), dtype=np.int64)
    share = np.asarray(table["share"].combine_chunks().flatten(), dtype=np.float64)
    # Rows arrive in any order; sums over rows are made in one order.
    order = np.lexsort((lengths, share[np.minimum(np.cumsum(lengths) - lengths, max(0, len(share) - 1))], level))
    begin = np.cumsum(lengths) - lengths
    take = np.concatenate([np.arange(begin[r], begin[r] + lengths[r]) for r in order]) if len(index) else np.zeros(0, np.int64)
    index, share, at, level = index[take], share[take], np.repeat(np.arange(len(order)), lengths[order]), level[order]
    # What hardly any text has tells one text from others, not a grade.
    often = np.bincount(index, minlength=BUCKETS)[index] >= min(MIN_TEXTS, np.bincount(level).min())
    weight = np.where(known[level] == TOXIC_GRADE, TOXIC_WEIGHT, 1.0)
    model = OrdinalModel.fit(index[often], share[often], at[often], level, len(known), weight)
    # Grades nobody rated share the threshold of the next one that somebody did.
    top = int(max(known.max(), KEEP_GRADE))
    thresholds = [model.thresholds[min(int(np.searchsorted(known, k, side="right")), len(known) - 1) - 1] if k >= known[0] else -np.inf for k in range(top)]
    return OrdinalModel(model.weights, np.array(thresholds))


def _score(batches: Iterator[pa.RecordBatch], model: OrdinalModel | None, keep_grade: int, keep_probability: float, clean_probability: float, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text_col, NARROW_BYTES):
            n = part.num_rows
            if model is None:
                expected = tail = clean_p = pa.nulls(n, pa.float64())
                kept, clean = pa.array([True] * n), pa.nulls(n, pa.bool_())
            else:
                tails = model.tails(part.column(text_col))
                expected, p = pa.array(np.round(tails.sum(axis=1), 6)), np.round(tails[:, keep_grade - 1], 6)
                tail, kept = pa.array(p), pa.array(p >= keep_probability)
                clean_p, clean = pa.nulls(n, pa.float64()), pa.nulls(n, pa.bool_())
                if tails.shape[1] >= CLEAN_GRADE:
                    p = np.round(tails[:, CLEAN_GRADE - 1], 6)
                    clean_p, clean = pa.array(p), pa.array(p >= clean_probability)
            yield pa.record_batch([*part.columns, expected, tail, kept, clean_p, clean], names=[*part.schema.names, *SCORES])


def score_quality(
    docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY, clean_probability: float = CLEAN_PROBABILITY
) -> DataFrame:
    """``docs`` plus expected_grade, tail_probability (of at least ``keep_grade``), kept, clean_probability (of CLEAN_GRADE) and clean.

    ``clean`` decides on toxicity too: CLEAN_GRADE must be as probable as ``clean_probability``; both of
    its columns are null where no rating tells. A null text is empty; a text without words has score 0. Without a model (no or one grade rated)
    the probabilities are null and every row is kept. Repeated rows and null ids are scored like
    others. Columns of ``docs`` with the new names are replaced.
    """
    rest = docs.drop(*SCORES)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(
        lambda b: _score(b, model, keep_grade, keep_probability, clean_probability, text_col),
        f"{schema}, expected_grade double, tail_probability double, kept boolean, clean_probability double, clean boolean",
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_quality(docs, model).drop("text")
