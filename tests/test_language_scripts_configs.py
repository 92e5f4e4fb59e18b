"""Language model, scripts by name, VARIANT walks and grid products against plain Python."""

import json
import random
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.scripts import scripts
from corpusloom.operators.grid import best_products
from corpusloom.plans import configs, language


def plain_script(raw):
    try:
        text = (raw or b"").decode("utf-8")
    except UnicodeDecodeError:
        return "partial"
    letters = {(unicodedata.name(c, "") or "UNK").split()[0] for c in text if c.isalpha()}
    return "nonalpha" if not letters else letters.pop() if len(letters) == 1 else "mixed"


def test_every_letter_has_the_script_of_its_name():
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    got = scripts(pa.array([chr(c) for c in points])).to_pylist()
    for c, script in zip(points, got, strict=True):
        ch = chr(c)
        assert script == ((unicodedata.name(ch, "") or "UNK").split()[0] if ch.isalpha() else "nonalpha"), hex(c)


def test_scripts_of_bytes_as_python_decodes_them():
    r = random.Random(4)
    parts = [b"a", "é".encode(), "д".encode(), "漢".encode(), "😀".encode(), "क".encode(), b"1 ", b"\x80", b"\xc0\x80", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf5", b"\xff", b"\xe0\x80\xaf", b"\xf0\x80\x80\xaf", b""]
    raw = [b"".join(r.choice(parts[: r.choice([4, 7, 19])]) for _ in range(r.randint(0, 5))) for _ in range(8000)] + [r.randbytes(r.randint(0, 6)) for _ in range(8000)] + [None, b""]
    assert scripts(pa.array(raw, pa.binary())).to_pylist() == [plain_script(b) for b in raw]
    assert scripts(pa.array(raw, pa.binary()).slice(5, 50)).to_pylist() == [plain_script(b) for b in raw[5:55]]
    assert scripts(pa.array([], pa.string())).to_pylist() == []


def test_scripts_in_a_table(spark):
    df = spark.createDataFrame([(1, "abc", 5), (2, "abд", 6), (3, None, 7)], "id long, t string, script_ int")
    got = language.with_script(df.withColumn("raw", F.encode("t", "UTF-8")), "raw", "script").select("id", "script").collect()
    assert {r.id: r.script for r in got} == {1: "LATIN", 2: "mixed", 3: "nonalpha"}


def test_languages_are_told_apart_on_texts_that_were_not_seen(spark):
    rows = language.language_accuracy(spark, "/root/testdata/sf0.01").collect()
    long = [r for r in rows if not r.short]
    assert {r.lang for r in long} == {"de", "en", "es", "fr"}
    assert sum(r.right for r in long) >= 0.97 * sum(r.n for r in long) and all(r.right >= 0.97 * r.n for r in long)
    assert all(r.right + r.wrong + r.rejected == r.n for r in rows)


def test_rejection_and_odd_rows(spark):
    sentence = {"en": "the house and the garden are by the river with other words ", "de": "das haus und der garten sind an dem fluss mit anderen ", "xx": "zqj kwx vvq pjz qqk xzw "}
    docs = spark.createDataFrame([(i, sentence[k] * (1 + i % 3), k) for i in range(40) for k in ("en", "de")] + [(900, None, "en"), (901, "", "de"), (902, "text", None), (None, "text", "en")], "doc_id long, text string, lang string")
    model, last = language.train(docs, sample=50)
    assert model.languages == ["de", "en"] and last
    asked = spark.createDataFrame([(1, "the river and the words", 0), (2, None, 0), (3, "", 0), (4, sentence["de"] * 2, 0), (None, "the garden", 0), (5, "the " * 50_000, 0), (5, "und " * 20, 0)], "doc_id long, text string, language int")
    got = sorted(((r.doc_id, r.language, r.confidence is None, r.short) for r in language.identify(asked, model, confident=0.5).collect()), key=str)
    assert got == sorted([(1, "en", False, True), (2, None, True, True), (3, None, True, True), (4, "de", False, False), (None, "en", False, True), (5, "en", False, False), (5, "de", False, False)], key=str)
    unsure = language.identify(asked, model, confident=1.01).collect()
    assert all(r.language is None for r in unsure)
    empty, last = language.train(docs.where("false"))
    assert last is None and {r.language for r in language.identify(asked, empty).collect()} == {None}
    assert language.identify(docs.where("false"), model).count() == 0


def nested(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice([1, 2.5, "text", "", True, None, [], {}])
    if kind < 0.6:
        return [nested(r, depth - 1) for _ in range(r.randint(0, 4))]
    return {k: nested(r, depth - 1) for k in r.sample(["a", "b", "pattern", "Regex", "type", "x y"], r.randint(0, 4))}


def plain_walk(value, path="$", name=None):
    yield path, name
    if isinstance(value, dict):
        for k, v in value.items():
            yield from plain_walk(v, f"{path}.{k}", k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain_walk(v, f"{path}[{i}]", name)


def test_walks_of_random_configurations(spark):
    r = random.Random(6)
    trees = [nested(r, r.randint(0, 6)) for _ in range(60)]
    table = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(99, None)], "key long, text string").select("key", F.parse_json("text").alias("value"))
    got = sorted((x.key, x.path, x.name or "") for x in configs.walk(table, "key", "value").select("key", "path", "name").collect())
    assert got == sorted((i, p, n or "") for i, t in enumerate(trees) for p, n in plain_walk(t))
    deep = spark.createDataFrame([(1, '{"a":' * 40 + "1" + "}" * 40)], "id long, text string").select("id", F.parse_json("text").alias("cfg"))
    assert configs.walk(deep, "id", "cfg").count() == 41
    with pytest.raises(ValueError, match="more than 5 levels"):
        configs.walk(deep, "id", "cfg", most=5)
    assert configs.walk(table.where("false"), "key", "value").count() == 0


def test_products_on_a_grid(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-3, 4, 5).tolist()) for i in range(300)] + [(300, [1, 2]), (301, None), (302, []), (303, [1, 2, 3]), (7, [3] * 5)]
    words = [(k, r.integers(-3, 4, 5).tolist()) for k in range(70)] + [(70, [2, 2]), (71, None), (72, rows[0][1]), (73, rows[0][1])]
    kind = "vec_id long, embedding array<float>"
    v, w = (spark.createDataFrame([(i, None if e is None else [float(x) for x in e]) for i, e in t], kind) for t in (rows, words))
    want = []
    for i, e in rows:
        scored = [(-float(np.dot(e, y)), k) for k, y in words if e and y and len(e) == len(y)]
        if scored:
            want.append((i, min(scored)[1], -min(scored)[0]))
    for high, wide in ((1 << 15, 1 << 13), (40, 9)):
        assert sorted(map(tuple, best_products(v, w, high, wide).collect())) == sorted(want)
    assert best_products(v, w.where("false")).count() == 0 and best_products(v.where("false"), w).count() == 0
