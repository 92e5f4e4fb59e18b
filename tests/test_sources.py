"""Readers and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.hashing import content_hash, le_uint32
from corpusloom.sources import sinks, tables


def test_text_lines_of_gzipped_files(spark, tmp_path):
    for lang, n in (("en", 5), ("hi", 2)):
        with gzip.open(tmp_path / f"{lang}.txt.gz", "wt") as f:
            f.writelines(f"{lang} {i}\n" for i in range(n))
    got = tables.text_lines(spark, str(tmp_path), first=3).collect()
    assert sorted((r.lang, r.line_no, r.line) for r in got) == [("en", 1, "en 0"), ("en", 2, "en 1"), ("en", 3, "en 2"), ("hi", 1, "hi 0"), ("hi", 2, "hi 1")]


def test_json_plan_and_lines(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps({"plan": "p", "budget": 1005}, indent=1))
    assert tables.json_plan(spark, str(tmp_path / "plan.json"), "plan string, budget long", ["budget"], 10).first().budget == 100
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in tables.json_lines(spark, str(tmp_path / "log.jsonl"), "a long").collect()) == [1, 2]


def test_column_fallback_and_preferred_copy(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a long, body string").write.parquet(str(tmp_path / "p"))
    assert tables.text_column(spark, str(tmp_path / "p")).first().text == "x"
    (tmp_path / "b.txt").write_text("plain")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("zipped")
    assert [r.text for r in tables.whole_files(spark, [str(tmp_path / "b.txt"), str(tmp_path / "b.txt.gz")]).collect()] == ["plain"]


def test_code_scan_and_manifest(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"m{i}.py").write_text("x = 1\n" * (200 if i else 2))
    got = tables.code_files(spark, str(tmp_path), byte_budget=3000).collect()
    assert len(got) == 3 and all(r.length == 1200 for r in got)
    assert tables.file_manifest(spark, str(tmp_path)).count() == 6


def test_xml_entries(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<feed><entry><id>a</id><published>2020-01-02</published></entry><entry><id>b</id><published>2021-01-02</published></entry></feed>")
    assert sorted(r.id for r in tables.xml_entries(spark, str(tmp_path / "feed.xml"), "id string, published date").collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "at long, body string")
    sinks.json_lines(df, str(tmp_path / "log"), "at")
    lines = [json.loads(x) for f in sorted((tmp_path / "log").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [{"at": 1, "body": "a"}, {"at": 2, "body": "b"}, {"at": 3, "body": "c"}]
    sinks.learning_tables(spark.createDataFrame([("r", 0.12345678)], "branch_id string, loss double"), spark.createDataFrame([("r", 1.0)], "branch_id string, x double"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l/tokens")).first().loss == pytest.approx(0.123457)
    sinks.shard_files(spark.createDataFrame([("s1", [1, 258], "en")], "shard_id string, tokens array<int>, languages string"), str(tmp_path / "s"))
    assert bytes(spark.read.parquet(str(tmp_path / "s/tokens")).first().blob) == b"\x01\x00\x00\x00\x02\x01\x00\x00"
    sinks.evidence(df, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e/markdown")).count() == 3


def test_hashes(spark):
    import hashlib

    row = spark.range(1).select(content_hash(b=F.lit(1), a=F.lit("x")).alias("h"), F.hex(le_uint32(F.array(F.lit(1), F.lit(70000)))).alias("t")).first()
    assert row.h == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()
    assert row.t == "0100000070110100"


def test_token_hashes_of_null_empty_and_wide_texts(spark, tmp_path):
    import hashlib

    from corpusloom.plans import registry

    texts = [None, "", "a", "é" * 700_000, "x\x00y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["shard_token_hash"](spark, str(tmp_path))
    want = {i: (None, None) if t is None else (hashlib.sha256(b"".join(bytes([b, 0, 0, 0]) for b in t.encode())).hexdigest(), len(t.encode())) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.token_sha, r.n_tokens) for r in got.collect()} == want


def test_slices_hold_few_rows_of_short_texts():
    import pyarrow as pa

    from corpusloom.functions.arrow_bytes import slices
    from corpusloom.plans import language

    batch = pa.record_batch([pa.array([str(i) for i in range(1000)])], names=["text"])
    parts = list(slices(batch, "text", max_rows=language.DESCRIBED))
    assert [p.num_rows for p in parts] == [256, 256, 256, 232]
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in slices(batch, "text", max_bytes=100)][0] == 55


def test_strings_are_made_slice_by_slice(spark, tmp_path, monkeypatch):
    """Whole Arrow batches were turned into strings at once."""
    from corpusloom.plans import unicode

    seen = []
    text = "a" * 400_000

    class Frame:
        schema = spark.createDataFrame([], "text string").schema

        def mapInArrow(self, f, schema):  # noqa: N802
            import pyarrow as pa

            seen.extend(b.num_rows for b in f(iter([pa.record_batch([pa.array([text] * 10)], names=["text"])])))

    unicode.in_arrow(Frame(), "text", lambda t: t, "same", "string")
    assert sum(seen) == 10 and max(seen) <= 2


def test_configurations_are_dealt_over_cores(spark, sf_dir):
    from corpusloom.plans import configs

    assert configs.configurations(spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_chained_entries_bring_their_bodies(spark):
    from corpusloom.plans.ledger import chained

    e = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "user_id long, step long, payload string")
    got = chained(e, "user_id", "step", "payload", with_body=True).collect()
    assert sorted((r.user_id, r.step, r.payload) for r in got) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_checks_of_the_same_units_are_one_pass(spark):
    from corpusloom.plans.evidence import held

    rows = held(spark.createDataFrame([(1,), (2,), (None,)], "x int"), small=F.col("x") < 2, given=F.col("x").isNotNull())
    assert sorted(map(tuple, rows.collect())) == [("given", 3, 1), ("small", 3, 2)]
