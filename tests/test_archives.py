"""Crawl archives and arrays: framing, ranges, damage, projection."""

import gzip
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.sources import arrays, wet


def record(i, body, length=True, kind="conversion"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://x/{i}\r\n" + (f"Content-Length: {len(body)}\r\n" if length else "")
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def read(path, split):
    reader = wet.WetReader({"path": str(path), "splitBytes": str(split)})
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def bodies(n, seed=1):
    r = random.Random(seed)
    out = [b"", b"\r\n\r\n", b"WARC/1.0\r\nWARC-Type: conversion\r\n\r\nquoted", wet.MEMBER * 40, gzip.compress(record(999, b"inner")), "é漢😀".encode() * 50]
    return out + [r.randbytes(r.choice([0, 1, 10, 1000, 200_000])).hex().encode() for _ in range(n)]


@pytest.mark.parametrize("split", [1, 7, 300, 65_536, 1 << 30])
def test_every_record_is_read_once_whatever_the_ranges(tmp_path, split):
    want = bodies(6 if split < 10 else 60)
    with open(tmp_path / "a.warc.wet.gz", "wb") as f:
        for i, b in enumerate(want):
            f.write(gzip.compress(record(i, b), compresslevel=0 if i % 5 == 3 else 6))
    if split < 10:
        want = want[:5]
        (tmp_path / "a.warc.wet.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in enumerate(want)))
    got = read(tmp_path, split)
    assert sorted((int(r["record_id"][10:-1]), r["text"], r["length"], r["truncated"]) for r in got) == [(i, b.decode("utf-8", "replace"), len(b), False) for i, b in enumerate(want)]


def test_blocks_border_members_anywhere(tmp_path, monkeypatch):
    want = [bytes([65 + i % 26]) * (i * 3) for i in range(40)]
    (tmp_path / "a.warc.wet.gz").write_bytes(b"".join(gzip.compress(record(i, b)) for i, b in enumerate(want)))
    size = (tmp_path / "a.warc.wet.gz").stat().st_size
    for block in (3, 5, 17, 64):
        with open(tmp_path / "a.warc.wet.gz", "rb") as f:
            members = wet.Members(f, size, block)
            got = [r for k in range(0, size, 101) for content, whole in members.within(k, min(k + 101, size)) for r in wet.records(content) if whole]
        assert [r[5] for r in got] == want


def test_truncated_and_damaged_members(tmp_path):
    rng = np.random.default_rng(0)
    parts = [gzip.compress(record(i, rng.integers(97, 123, 5000).astype(np.uint8).tobytes())) for i in range(4)]
    damaged = bytearray(parts[1])
    damaged[len(damaged) // 2 : len(damaged) // 2 + 40] = bytes(40)
    (tmp_path / "a.wet.gz").write_bytes(parts[0] + bytes(damaged) + parts[2] + b"\0" * 64 + parts[3][: len(parts[3]) // 2])
    for split in (100, 4000, 1 << 20):
        got = {int(r["record_id"][10:-1]): r for r in read(tmp_path, split) if r["record_id"]}
        assert [got[i]["truncated"] for i in (0, 2, 3)] == [False, False, True]
        assert len(got[2]["text"]) == 5000 and 0 < len(got[3]["text"]) < 5000 and got[3]["length"] == 5000
        assert got[1]["truncated"]


def test_many_records_in_a_member_and_odd_heads(tmp_path):
    data = record(0, b"info", kind="warcinfo") + record(1, b"one") + record(2, b"no length here", length=False) + record(3, b"") + b"WARC/1.1\r\nWARC-Type: conversion"
    (tmp_path / "a.wet.gz").write_bytes(gzip.compress(data))
    (tmp_path / "_staging-1").mkdir()
    (tmp_path / "_staging-1" / "no.gz").write_bytes(b"")
    got = read(tmp_path, 1 << 20)
    assert [(r["type"], r["text"].strip(), r["truncated"]) for r in got] == [("warcinfo", "info", False), ("conversion", "one", False), ("conversion", "no length here", False), ("conversion", "", False), ("conversion", "", True)]


def test_round_trip_of_rows(spark, tmp_path):
    rows = [(f"<id:{i}>", None if i % 5 == 0 else f"http://h/{i}\nInjected: x", None if i % 7 == 0 else "té\r\n\r\nxt " * (i % 50)) for i in range(300)]
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, "record_id string, url string, text string").repartition(3)
    wet.write_wet(df, folder)
    wet.write_wet(df.where("false"), folder)
    scan = wet.scan_wet(spark, folder, split_bytes=2000)
    assert scan.rdd.getNumPartitions() > 6
    got = wet.conversions(scan).select("record_id", "url", "text", "truncated").collect()
    assert sorted(map(tuple, got)) == sorted(((i, u and u.replace("\n", "%0A"), t or "", False) for i, u, t in rows), key=lambda r: r)
    assert scan.where("type = 'warcinfo'").count() == 3
    with pytest.raises(PySparkException):
        df.write.format("wet").mode("overwrite").save(folder)


# -- arrays


def test_npy_of_every_order_and_projection(spark, tmp_path):
    x = np.arange(5000 * 7, dtype=">f4").reshape(5000, 7) / 3
    np.save(tmp_path / "a.npy", x[:3000])
    np.save(tmp_path / "b.npy", np.asfortranarray(x[3000:]))
    scan = arrays.scan_arrays(spark, str(tmp_path), "file string, row long, value array<float>", partition_rows=700)
    assert scan.rdd.getNumPartitions() == 8
    got = sorted((r.file[-5], r.row, r.value) for r in scan.collect())
    assert np.array_equal(np.array([g[2] for g in got], np.float32), x.astype(np.float32)) and [g[1] for g in got] == [*range(3000), *range(2000)]
    some = arrays.scan_arrays(spark, str(tmp_path), "file string, row long, value array<double>", columns=[6, 0], partition_rows=999).collect()
    assert np.array_equal(np.array([r.value for r in sorted(some, key=lambda r: (r.file, r.row))], np.float32), x[:, [6, 0]].astype(np.float32))
    assert arrays.scan_arrays(spark, str(tmp_path / "a.npy")).schema.simpleString() == "struct<file:string,row:bigint,value:array<float>>"


def test_only_the_asked_columns_of_a_column_order_are_read():
    class Counted:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.read_bytes += n
            self.at += n
            return self.data[self.at - n : self.at]

    x = np.asfortranarray(np.random.default_rng(0).normal(size=(1000, 50)))
    raw = Counted(b"head" + x.tobytes(order="F"))
    got = arrays.rows_of(raw, arrays.Stored("value", 4, "<f8", x.shape, True), 200, 300, [3, 49])
    assert np.array_equal(got, x[200:300][:, [3, 49]]) and raw.read_bytes == 2 * 100 * 8


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_side_by_side(spark, tmp_path, save):
    ids, vec, flag = np.arange(900, dtype=np.int64), np.random.default_rng(1).normal(size=(900, 3)), np.arange(900) % 3 == 0
    save(tmp_path / "x.npz", ids=ids, vec=vec, flag=flag, small=ids.astype(np.uint8))
    got = arrays.scan_arrays(spark, str(tmp_path), partition_rows=100).orderBy("ids").collect()
    assert [r.row for r in got] == ids.tolist() and [r.vec for r in got] == vec.tolist() and [r.flag for r in got] == flag.tolist() and got[255].small == 255
    one = arrays.scan_arrays(spark, str(tmp_path), "flag boolean")
    assert one.columns == ["flag"] and one.where("flag").count() == 300


def test_refusals_and_empties(spark, tmp_path):
    np.savez(tmp_path / "x.npz", a=np.zeros(3), b=np.zeros(4))
    for schema in ("a double, b double", "a double, missing int"):
        with pytest.raises(PySparkException):
            arrays.scan_arrays(spark, str(tmp_path), schema).collect()
    assert arrays.scan_arrays(spark, str(tmp_path), "b double").count() == 4
    (tmp_path / "none").mkdir()
    assert arrays.scan_arrays(spark, str(tmp_path / "none"), "a double").count() == 0
    np.save(tmp_path / "none" / "zero.npy", np.zeros((0, 4)))
    assert arrays.scan_arrays(spark, str(tmp_path / "none"), "value array<double>").count() == 0
    np.save(tmp_path / "none" / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(PySparkException):
        arrays.scan_arrays(spark, str(tmp_path / "none"), "value array<double>").collect()
    target = str(tmp_path / "written")
    for rows in ([(1, [1.0]), (2, None)], [(1, [1.0]), (2, [1.0, 2.0])], [(None, [1.0])], [(1, [None])]):
        with pytest.raises(PySparkException):
            arrays.write_arrays(spark.createDataFrame(rows, "id long, v array<double>").coalesce(1), target)
    assert not list((tmp_path / "written").glob("part-*"))
    whole = spark.range(1000).select("id", F.array(F.col("id") * 0.5, F.lit(1.0)).alias("v"))
    arrays.write_arrays(whole.repartition(3), target, file_rows=100)
    assert len(list((tmp_path / "written").glob("part-*.npz"))) >= 10
    assert sorted(map(tuple, arrays.scan_arrays(spark, target, "id long, v array<double>").collect())) == [(i, [i * 0.5, 1.0]) for i in range(1000)]
