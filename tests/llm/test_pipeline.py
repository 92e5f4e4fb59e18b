"""The corpus pipeline's stages against plain Python, and its registration."""

import re
from collections import defaultdict

import corpus_pipeline as cp
from pyspark.sql import functions as F

from corpusloom.llm import quality
from corpusloom.llm._store import materialize
from tests.llm.test_jaccard import brute
from tests.llm.test_scans import brute_secret

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = rows_of(docs)
    labels = {r.doc_id: r.quality if not r.toxic else -1 for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0 or toxic is not null").collect()}

    good = cp.quality_classifier(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r[0] for r in rows_of(good)}
    assert sum(d in kept for d, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(d in kept for d, q in labels.items() if q == -1) <= 0.7 * max(1, sum(q == -1 for q in labels.values()))
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.1 * max(1, sum(q == 0 for q in labels.values()))

    unique = cp.exact_dedup_stage(spark, docs, SF)
    groups = defaultdict(list)
    for r in start:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append((-len(r[1]), r[0], r))
    assert rows_of(unique) == sorted(min(g)[2] for g in groups.values())

    apart = cp.near_dedup_stage(spark, docs, SF)
    heads = {d for d, _, c in brute([(r[0], r[1]) for r in start]) if d == c}
    assert rows_of(apart) == [r for r in start if r[0] in heads]

    clean = cp.secret_scans(spark, docs, SF)
    assert len(rows_of(clean)) == len(start) and clean.columns == docs.columns
    for (_, before, *_), (_, after, *_, n) in zip(start, rows_of(clean), strict=True):
        assert brute_secret(after)[:3] == (0, 0, 0) and n == len(after)
        assert after == before or sum(brute_secret(before)[:3]) or "[SECRET]" in after


def test_run_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    pieces = cp.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == left
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id] += p.length
    assert all(total[p.doc_id] == p.doc_tokens for p in pieces)


def test_stages_on_empty_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert quality.score_quality(docs.where("false"), None).count() == 0
    some = docs.limit(20)
    assert rows_of(cp.exact_dedup_stage(spark, some.unionByName(some), SF)) == rows_of(cp.exact_dedup_stage(spark, some, SF))


def test_stages_on_odd_rows(spark):
    """Nulls in any column, a very long text, repeated rows and ids, and columns with the names that stages use inside."""
    long = " ".join(f"w{k}" for k in range(60_000))
    near = [f"n{k}" for k in range(80)]
    rows = [
        (1, long, None, "s", None),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (None, " ".join(near), "en", None, 1),
        (None, " ".join([*near[:-1], "other"]), "en", "s", 1),
        (7, " ".join(["first", *near[1:]]), "en", "s", 1),
        (7, "another text of the same id as one more", "en", "s", 1),
        (8, "the key AKIAABCDEFGHIJKLMN is here", "en", "s", 1),
        (8, "the key AKIAABCDEFGHIJKLMN is here", "en", "s", 1),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, hash string, kept double")
    keyed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert cp.quality_classifier(spark, docs, SF).columns == list(cp.COLUMNS)
    unique = cp.exact_dedup_stage(spark, docs, SF)
    assert unique.columns == list(cp.COLUMNS)
    # The null and the empty text are one, and the smaller id stays; the repeated row stays once.
    assert keyed(unique) == sorted([(d, t) for d, t, *_ in rows[:2] + rows[3:8]], key=str)
    apart = cp.near_dedup_stage(spark, docs, SF)
    # The three near copies link, and the one with an id stays; rows without words stay alone.
    assert keyed(apart) == sorted([(d, t) for d, t, *_ in (rows[0], rows[1], rows[2], rows[5], rows[6], rows[7])], key=str)
    clean = cp.secret_scans(spark, docs, SF)
    assert len(keyed(clean)) == len(rows) and sum(t == "the key [SECRET] is here" for _, t in keyed(clean)) == 2
    pieces = cp.packing_stage(spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r[0] for r in rows}


def test_arrow_batches_are_bounded_by_bytes(spark):
    """Tasks get about 2 MB at once, however long texts are, whether a stage writes a table or its caller does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    measured = texts.mapInArrow(sizes, "n long, bytes long")
    spark.conf.set(key, "64m")
    got = materialize(measured, "sizes").collect()
    assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 3 << 20
    assert spark.conf.get(key) == "64m"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    try:
        for stage in (cp.quality_classifier, cp.packing_stage):
            spark.conf.set(key, "64m")
            stage(spark, docs, SF)
            got = measured.collect()
            assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 3 << 20
    finally:
        spark.conf.unset(key)


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {"pipeline", *(n for n in names if re.match(r"op\d+_", n))} <= set(names)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
