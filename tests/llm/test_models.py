"""Quality classifier by held-out accuracy, exact top-k by brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality, topk

SF = "/root/testdata/sf0.01"


def test_features_by_hand():
    found, bounds = quality.features(pa.array(["Ab ab  AB\n7x", None, "ab", "", "ab ab"]))
    assert np.diff(bounds).tolist() == [4, 0, 1, 0, 2]
    words, shapes, again = found.T
    assert words[0] == words[1] == words[2] == words[4] and words[3] != words[0]
    assert shapes[1] == shapes[4] and len({shapes[0], shapes[1], shapes[2], shapes[3]}) == 4
    assert again.tolist() == [0, 1, 1, 0, 0, 0, 1]


def test_ordered_thresholds_and_probabilities():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    index = np.where(rng.random(600) < 0.9, grade, rng.integers(0, 3, 600)) + 10
    model = quality.OrdinalModel.fit(index, np.ones(600), np.arange(600), grade, 3)
    assert model.thresholds[0] < model.thresholds[1]
    scores = model.weights[[10, 11, 12]]
    assert scores[0] < scores[1] < scores[2]


def test_scores_against_a_plain_sum(spark):
    """Expected grade and tails from the weights of each word, its shape and its repeat, one word at a time."""
    from corpusloom.llm._bytes import WindowHash

    texts = ["Ab ab  AB\n7x", None, "", " \t", "ab", "the THE the cat--sat 12,345 é" * 50, "x" * 300_000 + " y", "w " * 100_000]
    rng = np.random.default_rng(4)
    model = quality.OrdinalModel(rng.normal(size=quality.BUCKETS).astype(np.float32), np.array([-0.3, 0.4]))

    def bucket(data, seed):
        raw = np.frombuffer(data, np.uint8)
        return int(WindowHash(raw, seed=seed)(np.array([0]), np.array([len(raw)]))[0] % np.uint64(quality.BUCKETS - 2)) + 2

    known = {}

    def plain(text):
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
        counts, before = Counter(), None
        for w in words:
            if w not in known:
                shape = re.sub(rb"(A+|a+|0+|(.)\2*)", lambda m: m.group()[:1], bytes(quality.SHAPE[b] for b in w), flags=re.S)
                known[w] = bucket(w.lower(), 1), bucket(shape, 2)
            counts.update((*known[w], int(w.lower() == before)))
            before = w.lower()
        score = sum(float(model.weights[k]) * math.log(1 + n) for k, n in counts.items()) / math.sqrt(max(1, len(words)))
        return [1 / (1 + math.exp(-(score - t))) for t in model.thresholds]

    docs = spark.createDataFrame([(i, t, "kept as it is") for i, t in enumerate(texts)], "doc_id long, body string, text string")
    for r in quality.score_quality(docs, model, text_col="body").collect():
        tails = plain(texts[r.doc_id])
        assert r.text == "kept as it is" and r.body == texts[r.doc_id]
        assert abs(r.expected_grade - sum(tails)) < 1e-4 and abs(r.tail_probability - tails[0]) < 1e-4 and abs(r.clean_probability - tails[1]) < 1e-4
        assert r.kept == (r.tail_probability >= 0.5) and r.clean == (r.clean_probability >= quality.CLEAN_PROBABILITY)


def test_held_out_accuracy(spark):
    """On the largest of the three scales: a third of the smaller one's ratings holds two dozen bad documents only."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratings = quality.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    model = quality.train(docs, ratings.where(~held))
    rows = quality.score_quality(docs, model).join(ratings.where(held), "doc_id").select("grade", "kept", "expected_grade", "tail_probability").collect()
    assert len(rows) > 80
    good = [r for r in rows if r.grade > 0]
    assert np.mean([r.kept for r in good]) > 0.97
    assert np.mean([r.kept for r in rows if r.grade == 0]) < 0.1
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    mean = {g: np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]


def test_toxicity_decision(spark):
    """The held-out rows of the accuracy test: most toxic documents are found, next to no clean one is taken for one, and clean implies kept."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratings = quality.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    model = quality.train(docs, ratings.where(~held))
    rows = quality.score_quality(docs, model).join(ratings.where(held), "doc_id").select("grade", "kept", "clean_probability", "clean").collect()
    counts = {g: (sum(r.clean for r in rows if r.grade == g), sum(r.grade == g for r in rows)) for g in (0, 1, 2)}
    print("clean of each grade", counts)
    assert all(r.kept for r in rows if r.clean)
    mean = {g: np.mean([r.clean_probability for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    assert counts[1][0] <= 0.4 * counts[1][1] and counts[2][0] >= 0.98 * counts[2][1] and counts[0][0] <= 0.05 * counts[0][1]


def test_fit_is_the_same_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ratings = quality.graded(spark.read.parquet(f"{SF}/labels.parquet"))
    a, b = quality.train(docs, ratings), quality.train(docs.repartition(5), ratings)
    assert np.allclose(a.thresholds, b.thresholds, atol=1e-3)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, "fine words here", 2.0), (1, "fine words here", 1.0), (2, None, None), (None, "", 0.0)], "doc_id long, text string, expected_grade double")
    for labels in ([], [(1, 1, 0)], [(1, None, None), (None, 1, 0)]):
        ratings = quality.graded(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert quality.train(docs, ratings) is None
    scored = quality.score_quality(docs, None).collect()
    assert len(scored) == 4 and all(r.kept and r.expected_grade is None for r in scored)
    two = quality.graded(spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    more = docs.unionByName(spark.createDataFrame([(2, "bad### bad###", 0.0)], docs.schema))
    model = quality.train(more, two)
    rows = quality.score_quality(more, model).collect()
    assert len(rows) == 5 and {r.kept for r in rows if r.doc_id == 1} == {True}
    assert quality.score_quality(docs.where("false"), model).count() == 0


def brute(rows, every, k):
    def fit(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)

    vectors = [(i, n, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and fit(v)]
    out = []
    for qi, qn, q in vectors:
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, n, v in vectors if n != qn and len(v) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [3, 256])
def test_top_k_with_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # one very common vector: ties
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(10, rows[3][1]), (205, [0.0] * 4), (300, [1.0, 2.0]), (310, [3.0, 1.0]), (320, [1.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, pivot int")
    assert found(topk.exact_top_k(vectors, "vec_id % 10 = 0", 5)) == brute(rows, 10, 5)


def test_top_k_of_many_lengths(spark):
    rng = np.random.default_rng(2)
    lengths = [n for n in range(1, 91) for _ in range(5)] + [7] * 700 + [40] * 300
    rows = [(i, rng.normal(size=n).round(2).tolist()) for i, n in enumerate(lengths)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(topk.exact_top_k(vectors, "vec_id % 3 = 0", 5)) == brute(rows, 3, 5)


def test_top_k_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(topk.op9_top_k(spark, sf_dir)) == brute(rows, 50, 5)


def test_top_k_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(empty, "vec_id % 50 = 0").count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert topk.exact_top_k(one, "vec_id % 50 = 0").count() == 0


def test_large_products_are_exact():
    q, x = np.array([[1 << 30, 3]], dtype=np.int64), np.array([[1 << 30, 5]], dtype=np.int64)
    assert topk._products(q, x).tolist() == [[(1 << 60) + 15]]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-200, 200, (300, 6)).astype(float)
    pivots = topk.choose_pivots(x, 8)
    far = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2))
    pivot, dist = far.argmin(axis=1), far.min(axis=1)
    ring = (dist // 40).astype(int)
    cells = sorted(set(zip(pivot.tolist(), ring.tolist(), strict=True)))
    pick = [np.flatnonzero((pivot == p) & (ring == r)) for p, r in cells]
    norm = np.sqrt((x**2).sum(axis=1))
    directory = {
        "pivots": pivots,
        "pivot": np.array([p for p, _ in cells]),
        "low": np.array([dist[i].min() for i in pick]),
        "high": np.array([dist[i].max() for i in pick]),
        "norm": np.array([norm[i].max() for i in pick]),
    }
    q = rng.integers(-200, 200, (40, 6))
    bound = topk.bounds(q, directory)
    for k, i in enumerate(pick):
        assert ((q @ x[i].T).max(axis=1) <= bound[:, k]).all()
