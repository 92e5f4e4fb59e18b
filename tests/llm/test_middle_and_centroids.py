"""Fill-in-the-middle and annulus clustering against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import centroids, fill_middle

PLAIN_UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"(?s:.)"}
PIECES = ["\n", "\n\n", "a", "é", "😀", " ", "\t", "\r\n", "<", "<P", "<P>", "<S>", "<M>", "P>", "漢字", "word", "\x85", " "]


def texts(n, seed=2):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES[: r.choice([4, 9, 10, 18])]) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_units_and_ranks(unit):
    scan = fill_middle.UnitScan(unit)
    for t in texts(1500):
        want = re.findall(PLAIN_UNITS[unit], t)
        units, marked = scan(t)
        assert units.count == len(want) and marked == any(s in t for s in ("<P>", "<S>", "<M>"))
        edges = np.cumsum([0] + [len(w) for w in want]).tolist()
        assert [units.place(k) for k in range(len(want) + 1)] == edges
        assert [units.rank(p) for p in range(len(t) + 1)] == [sum(e <= p for e in edges) - 1 for p in range(len(t) + 1)]


def plain_fim(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(PLAIN_UNITS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("word", 40, 100), ("char", 70, 0)])
def test_rows_and_exact_restoring(spark, unit, rate, spm):
    rows = [(i, t) for i, t in enumerate(texts(400))] + [(None, "no\nid"), (9, None), (10, ""), (5, "again\n"), (5, "again\n"), (11, "x" * 200_000), (12, "ab c\n" * 100_000), (-3, "a\nb")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, output string, n int")
    got = fill_middle.restore(fill_middle.fill_in_middle(docs, unit, rate=rate, spm=spm)).collect()
    assert all(r.restored == t for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.restored)), [t or "" for _, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))], strict=True))
    want = Counter((d, *plain_fim(d, t, unit, 7, rate, spm)) for d, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert len({r.form for r in got}) == (3 if spm == 50 else 2)


def test_own_sentinels_and_empty_tables(spark):
    marks = ("[[pre|", "{suf$", "(mid\\E")
    docs = spark.createDataFrame([(i, f"line {i}\nand <P> more\nend") for i in range(30)] + [(99, "has {suf$ in it\n")], "doc_id long, text string")
    got = fill_middle.restore(fill_middle.fill_in_middle(docs, sentinels=marks), marks).collect()
    assert {r.doc_id: r.restored for r in got} == {r.doc_id: r.text for r in docs.collect()}
    assert [r.form for r in got if r.doc_id == 99] == ["plain"] and all(r.form != "plain" for r in got if r.doc_id < 99)
    assert fill_middle.restore(fill_middle.fill_in_middle(docs.where("false"))).count() == 0
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.UnitScan("line", bad)
    with pytest.raises(ValueError):
        fill_middle.UnitScan("verse")


# -- clustering


def plain_lloyd(rows, clusters, rounds, dim):
    kept = [(i, [int(np.floor(float(x) * 1024)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for k in range(len(cents)):
            mine = [v for (_, v), (_, c, _) in zip(kept, at, strict=True) if c == k]
            if mine:
                cents[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), cents


def test_annulus_finds_the_nearest_with_ties():
    r = np.random.default_rng(3)
    for k, spread in ((1, 5), (2, 3), (8, 3), (40, 60), (300, 2000)):
        c = r.integers(-spread, spread + 1, (k, 4)) + (r.integers(0, 9, (k, 1)) * spread)
        v = r.integers(-spread, spread + 1, (500, 4)) + (r.integers(0, 9, (500, 1)) * spread)
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        for home in (None, r.integers(0, k, 500), d.argmin(axis=1)):
            best, least, compared = centroids.Annuli(c).nearest(v, home)
            assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        if k == 300:  # with the nearest as home, norms leave most centroids out
            assert compared < 0.5 * d.size


@pytest.mark.parametrize("clusters,rounds", [(8, 10), (3, 1), (40, 4), (1, 2)])
def test_clusters_against_plain_lloyd(spark, clusters, rounds):
    r = np.random.default_rng(7)
    rows = [(i, (r.normal(size=6) / 50 + (i % 5)).tolist()) for i in range(200)]
    rows += [(7, rows[7][1]), (7, [9.0] * 6), (None, [0.5] * 6), (300, None), (301, [1.0] * 5), (302, []), (303, [None] + [1.0] * 5), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, [-0.0001] * 6)]
    table = spark.createDataFrame([(i, e, 1, "clash") for i, e in rows], "vec_id long, embedding array<double>, cluster int, home string").repartition(5)
    found, cents = centroids.cluster(table, clusters, rounds, dim=6)
    want, want_cents = plain_lloyd(rows, clusters, rounds, 6)
    assert cents.tolist() == want_cents
    assert Counter((x.vec_id, x.cluster, x.distance) for x in found.collect()) == Counter(want)


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(None, [1.0] * 64)]):
        found, cents = centroids.cluster(spark.createDataFrame(rows, schema))
        assert found.count() == 0 and not len(cents)
    huge = [(1, [1e30] * 64), (2, [-1e5] * 64), (3, [1e5] * 64), (4, [2.0] * 64)]
    found, _ = centroids.cluster(spark.createDataFrame(huge, schema))
    assert sorted((r.vec_id, r.distance) for r in found.collect()) == [(2, 0), (3, 0), (4, 0)]
    same, _ = centroids.cluster(spark.createDataFrame([(i, [0.25] * 64) for i in range(20)], schema))
    assert {(r.cluster, r.distance) for r in same.collect()} == {(0, 0)}
