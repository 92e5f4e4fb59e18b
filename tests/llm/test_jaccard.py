"""The Jaccard join against brute force: trees, sets and whole components."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa

from corpusloom.llm import jaccard_join as jj
from corpusloom.llm import quality


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


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
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_sets_match_plain_python():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "B", "c\t", "\né", "dd"], rng.integers(0, 40))) for _ in range(300)] + [None, "", " \n", "x" * 10_000, "ab " * 900 + "y" * 3000]
    tokens, bounds = jj.shingle_sets(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = tokens[bounds[i] : bounds[i + 1]]
        want = shingles(t)
        assert len(own) == len(want) and (np.diff(own.view(np.int64)) != 0).all()
        assert seen.setdefault(frozenset(want), tuple(own)) == tuple(own)
    assert len(set(seen.values())) == len(seen)


def test_memory_of_text_passes_is_bounded(monkeypatch):
    """A batch of 4 MB takes far less than the 40 MB that arrays over slices of 1 MB took, and gives the same rows."""
    rng = np.random.default_rng(7)
    words = np.array([f"word{k}" for k in range(5000)])
    texts = pa.array([" ".join(rng.choice(words, 400)) for _ in range(1200)])
    number = pa.array(np.arange(len(texts)))
    batch = pa.record_batch([number, number, number, number, texts], names=["row", "doc_id", "node", "grade", "text"])
    none = np.zeros(0, np.uint64)
    for work in (jj._describe, jj._token_sets, jj._sketches, lambda b: jj._prefixes(b, none, none), quality._sparse):
        tracemalloc.start()
        for _ in work([batch]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20e6
        parts = pa.Table.from_batches(work([batch]))
        with monkeypatch.context() as m:
            m.setattr(jj, "NARROW_BYTES", 1 << 30)
            m.setattr(quality, "NARROW_BYTES", 1 << 30)
            whole = pa.Table.from_batches(work([batch]))
        # Keys of sets are left out: they are rounded by where a text stands in its slice, so some equal sets are nodes apart until they link.
        same = [c for c in parts.column_names if c not in ("key_a", "key_b")]
        assert parts.select(same).combine_chunks().equals(whole.select(same).combine_chunks())


def test_dual_walk_loses_no_link():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = []
        for _ in range(int(rng.integers(1, 90))):
            keep = base[rng.random(60) < rng.choice([0.3, 0.8, 0.95])]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 60, int(rng.integers(1, 12))).astype(np.uint64)))))
        size = np.array([len(s) for s in sets])
        bits = jj.bitmaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))), jj.BITMAP_WORDS)
        comp = rng.integers(0, 8, len(sets))
        both = lambda p, q: len(set(sets[p].tolist()) & set(sets[q].tolist()))  # noqa: B023, E731
        assert all(jj.overlap(sets[p], sets[q]) == both(p, q) for p in range(0, len(sets), 7) for q in range(len(sets)))
        links = {frozenset((p, q)) for p in range(len(sets)) for q in range(p) if 100 * both(p, q) >= 75 * (size[p] + size[q] - both(p, q))}
        apart = {p for p in links if len({comp[k] for k in p}) == 2}

        def walked(a, b, first=0, second=0):
            got = []
            jj.dual_walk(a, b, lambda i, j: got.extend(zip((i + first).tolist(), (j + second).tolist(), strict=True)))
            assert len({frozenset(p) for p in got}) == len(got) and all(len(set(p)) == 2 for p in got)
            return {frozenset(p) for p in got}

        whole = jj.SignatureTree(size, bits, comp)
        assert apart <= walked(whole, whole)
        cut = len(sets) // 2
        left, right = jj.SignatureTree(size[:cut], bits[:cut], comp[:cut]), jj.SignatureTree(size[cut:], bits[cut:], comp[cut:])
        assert {p for p in apart if min(p) < cut <= max(p)} <= walked(left, right, 0, cut)

        def roots(pairs, start):
            label = list(start)
            for p, q in pairs:
                label = [label[p] if x == label[q] else x for x in label]
            return [label.index(x) for x in label]

        for start in (comp, np.arange(len(sets))):
            found, label = jj.bucket_links(sets, start)
            assert roots([], label.tolist()) == roots(found, start)
            assert {frozenset(p) for p in found} <= links and len(found) < len(sets)
            assert roots(found, start) == roots([tuple(p) for p in links], start)


def made_documents(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choice(words, 30))
    rows, k = [], 0
    for _ in range(25):
        text = rng.choice(words, int(rng.integers(3, 120))).tolist()
        for _ in range(int(rng.integers(1, 12))):
            copy = list(text)
            for _ in range(int(rng.integers(0, max(1, len(copy) // 25) + 1))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(words))
            rows.append((k, " ".join(copy) + (" " + passage if rng.random() < 0.4 else "")))
            k += 1
    original = rng.choice(words, 100).tolist()
    for _ in range(60):  # a star: copies link with the original more than with each other
        copy = list(original)
        for at in rng.choice(100, 2, replace=False):
            copy[at] = str(rng.choice(words))
        rows.append((k, " ".join(copy)))
        k += 1
    rows += [(k, " ".join(original)), (k + 1, None), (k + 2, ""), (k + 3, "  \n"), (k + 4, "One two"), (k + 5, "one  TWO"), (k + 5, "one two"), (None, "one two three"), (None, None), (0, rows[40][1])]
    return rows


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)
    monkeypatch.setattr(jj, "FREQUENT", 20)
    for seed, rounds, earlier in ((3, jj.ROUNDS, jj.EARLIER), (4, 1, 2), (5, 0, 0)):
        monkeypatch.setattr(jj, "EARLIER", earlier)
        monkeypatch.setattr(jj, "SENT", 64 if rounds else 2)
        rows = made_documents(seed)
        docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, comp string")
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(docs, rounds=rounds).collect()), key=str)
        assert got == brute(rows)


def test_one_row_of_each_component_stays(spark):
    rows = made_documents(6)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, number long")
    got = jj.near_duplicates(docs, row_col="number").collect()
    assert sorted(r.row for r in got) == list(range(len(rows)))
    least = {}
    for k, _, c in brute([(k, t) for k, (_, t) in enumerate(rows)]):
        least.setdefault(c, []).append((rows[k][0] is None, rows[k][0] or 0, k))
    assert {r.row for r in got if r.stays} == {min(v)[2] for v in least.values()}


def test_empty_table(spark):
    assert jj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
