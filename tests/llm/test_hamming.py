"""The multi-index Hamming join against brute force: keys, signatures and whole components."""

import re

import numpy as np
import pyarrow as pa

from corpusloom.llm import hamming_join as hj
from tests.llm.test_jaccard import made_documents


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_every_pair_within_the_threshold_shares_a_key():
    rng = np.random.default_rng(0)
    p = rng.integers(0, 1 << 16, (4000, hj.SYMBOLS)).astype(np.uint16)
    q = p.copy()
    for k in range(len(p)):
        errors = int(rng.integers(0, 2 * hj.THRESHOLD))
        at = rng.choice(hj.SYMBOLS, errors, replace=False)
        if k % 3 == 0:  # the hardest case: errors dealt evenly over chunks
            at = (np.arange(errors) % hj.CHUNKS) * hj.WIDTH + (np.arange(errors) // hj.CHUNKS + rng.integers(0, hj.WIDTH)) % hj.WIDTH
        q[k, at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
    shared = hj.chunk_keys(p) == hj.chunk_keys(q)
    far, first = hj.first_key(p, q)
    assert (far == (p != q).sum(axis=1)).all()
    assert shared[far <= hj.THRESHOLD].any(axis=1).all() and (far == hj.THRESHOLD).any()
    some = shared.any(axis=1)
    assert (first[some] == shared[some].argmax(axis=1)).all() and (first[~some] == shared.shape[1]).all()
    assert hj.missed() < 5e-6 and hj.missed(0.95) < 1e-14


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        own = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        a, b = np.unique(base), np.unique(np.concatenate((base, own)))
        sig = hj.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b), len(a) + len(b)]))
        assert not sig[2].any()
        same.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(same) - 0.75) < 0.02 and abs(np.std(same) - np.sqrt(0.75 * 0.25 / hj.SYMBOLS)) < 0.02


def test_bitmaps_never_leave_too_little_room():
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(universe, int(rng.choice([0, 1, 5, 40, 300, 3000])))) for _ in range(60)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    maps = hj.Bitmaps(*hj.bitmaps(np.concatenate(sets), bounds))
    i, j = np.triu_indices(len(sets), 1)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    most = maps.most(np.diff(bounds), i, j)
    assert (most >= both).all() and (most < np.minimum(*(np.diff(bounds)[k] for k in (i, j)))).any()


def test_equal_sets_are_told_by_their_sums():
    texts = [" ".join(np.random.default_rng(k % 40).choice(["a", "B", "c"], k % 7)) for k in range(400)]
    batch = pa.record_batch([pa.array(range(400), pa.int64()), pa.array(range(400), pa.int64()), pa.array(texts)], names=["row", "doc_id", "text"])
    (out,) = hj._describe([batch])
    keys = list(zip(out.column("n").to_pylist(), out.column("key_a").to_pylist(), out.column("key_b").to_pylist(), strict=True))
    for i in range(400):
        for j in range(0, i, 7):
            assert (keys[i] == keys[j]) == (shingles(texts[i]) == shingles(texts[j]))


def test_components_match_brute_force(spark, monkeypatch):
    for seed, rounds, block, sent in ((3, hj.ROUNDS, 16, 64), (4, 1, 8, 2), (5, 0, 5, 64), (6, 2, 512, 64)):
        monkeypatch.setattr(hj, "BLOCK", block)
        monkeypatch.setattr(hj, "SENT", sent)
        rows = made_documents(seed)
        docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, node int, comp string, kept boolean")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in hj.near_duplicates(docs, rounds=rounds).collect()), key=str)
        assert got == brute(rows)


def test_one_row_of_each_component_stays(spark):
    rows = made_documents(6)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, number long")
    got = hj.near_duplicates(docs, row_col="number").collect()
    assert sorted(r.row for r in got) == list(range(len(rows)))
    least = {}
    for k, _, c, _ in brute([(k, t) for k, (_, t) in enumerate(rows)]):
        least.setdefault(c, []).append((rows[k][0] is None, rows[k][0] or 0, k))
    assert {r.row for r in got if r.stays} == {min(v)[2] for v in least.values()}


def test_empty_and_very_long(spark):
    assert hj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(str(k % 70_001) for k in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "x" * 500_000), (4, "x" * 500_001), (5, None)]
    got = {r.doc_id: (r.component_id, r.kept) for r in hj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}
