"""Operators without a SQL twin, against plain Python, and controls that break an input on purpose."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import packing as ops
from corpusloom.operators import prefix, shards, similarity
from corpusloom.operators.graph import resolve_in_order
from corpusloom.plans.admission import HARD_FIELDS, blockers
from corpusloom.plans.ledger import chained, first_breaks, select_in_rank_order
from corpusloom.plans.learning import quadrant
from corpusloom.plans.mixture import water_fill
from corpusloom.plans.text import longest_repeat
from corpusloom.plans.windows import spikes


def direct_repeat(tokens, largest=13):
    best = (0, 0, -1)
    for n in range(1, largest + 1):
        if len(tokens) < 2 * n:
            break
        for i in range(len(tokens) - n + 1):
            run = 1
            while tokens[i : i + n] == tokens[i + run * n : i + (run + 1) * n] and i + (run + 1) * n <= len(tokens):
                run += 1
            if run > best[0]:
                best = (run, n, i)
    return best


def test_longest_repeat_matches_a_direct_scan():
    r = random.Random(1)
    for _ in range(3000):
        tokens = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 40))]
        assert longest_repeat(np.array([ord(t) for t in tokens])) == direct_repeat(tokens), tokens


def test_resolution_in_order(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(2)
    nodes, pairs, want, base = [], [], {}, 0
    for _ in range(60):
        n = r.randint(1, 15)
        edges = {(i, j) for j in range(n) for i in range(j) if r.random() < 0.25}
        originals = []
        for j in range(n):
            first = next((i for i in originals if (i, j) in edges), None)
            want[base + j] = None if first is None else base + first
            if first is None:
                originals.append(j)
        nodes += [(base + j,) for j in range(n)]
        pairs += [(base + i, base + j) for i, j in edges]
        base += n
    got = resolve_in_order(spark.createDataFrame(nodes, "id long"), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {x.id: x.original for x in got} == want


def direct_bins(lengths, ctx, policy):
    order = sorted(lengths, key=lambda u: (-u[1], u[0])) if policy == "best_fit" else lengths
    used = []
    for _, n in order:
        if n > ctx and policy != "whole":
            used += [min(ctx, n - o) for o in range(0, n, ctx)]
            continue
        n = min(n, ctx)
        fits = [i for i, u in enumerate(used) if u + n <= ctx]
        if not fits:
            used.append(n)
        else:
            used[min(fits, key=lambda i: (ctx - used[i] - n, i)) if policy == "best_fit" else fits[0]] += n
    return used


@pytest.mark.parametrize("policy", ["greedy", "best_fit", "whole"])
def test_bins(spark, policy):
    r = random.Random(3)
    units = [("s", i, i, r.randint(1, 150)) for i in range(2000)]
    pieces = ops.binned(spark.createDataFrame(units, "shard string, id long, seq long, length long"), 64, policy).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.win, []).append((p.offset, p.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    want = direct_bins([(u[1], u[3]) for u in units], 64, policy)
    assert sorted(sum(n for _, n in w) for w in windows.values()) == sorted(want)


def test_shards_match_a_direct_fold(spark):
    """Whatever the chunk, and with documents longer than the budget."""
    r = random.Random(5)
    docs = [(lane, i * 3 + k, r.choice((1, r.randint(1, 40), r.randint(1, 200), 150))) for k, lane in enumerate("ab") for i in range(400)]
    want = []
    for lane in "ab":
        shard, fill = 0, 0
        for _, ident, n in sorted(d for d in docs if d[0] == lane):
            if fill and fill + n > 100:
                shard, fill = shard + 1, 0
            want.append((lane, shard, ident, fill, fill + n))
            fill += n
    for chunk in (7, 64, 5000):
        got = shards.build(spark.createDataFrame(docs, "lane string, id long, length long"), 100, chunk).collect()
        assert sorted((x.lane, x.shard_no, x.id, x.start, x.stop) for x in got) == sorted(want)


def test_running_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNK", 8)
    r = random.Random(6)
    rows = [(r.choice("ab"), i, r.randint(-5, 5)) for i in r.sample(range(1000), 300)]
    got = prefix.running_sums(spark.createDataFrame(rows, "k string, at long, v long"), "k", ["at"], {"total": F.col("v"), "place": F.lit(1)}).collect()
    for x in got:
        before = [v for k, at, v in rows if k == x.k and at <= x.at]
        assert (x.total, x.place) == (sum(before), len(before))
    assert prefix.row_numbers(spark.createDataFrame([], "k string, at long"), "k", ["at"], "place").count() == 0


def test_similar_pairs_without_a_miss(spark):
    r = random.Random(7)
    rows = []
    for i in range(250):
        base = r.sample(range(1 << 40), 30) if i % 5 == 0 else base
        own = sorted({x if r.random() < 0.85 else r.randrange(1 << 40) for x in base} | set(range(r.choice((0, 3)))))
        rows.append((i, len(own), own))
    rows += [(1000, 0, []), (1001, 0, [])]
    sets = spark.createDataFrame(rows, "id long, n_grams long, grams array<bigint>")
    for least in (0.55, 0.8):
        want = {}
        for a, _, x in rows:
            for b, _, y in rows:
                both = len(set(x) & set(y))
                if a < b and both and both / (len(x) + len(y) - both) >= least:
                    want[a, b] = both / (len(x) + len(y) - both)
        assert {(p.a, p.b): pytest.approx(p.jaccard) for p in similarity.self_pairs(sets, least).collect()} == want
    want = {k for k in want}
    banded = {(p.a, p.b) for p in similarity.banded_pairs(sets).collect()}
    assert len(want & banded) >= 0.99 * len(want)


def test_a_missing_hard_field_blocks(spark):
    good = dict.fromkeys(HARD_FIELDS, "known") | {"shard": "s"}
    fields = ", ".join(f"{k} string" for k in good)
    assert spark.createDataFrame([tuple(good.values())], fields).select(blockers(spark.createDataFrame([tuple(good.values())], fields)).alias("b")).first().b == []
    for gone in HARD_FIELDS:
        rest = {k: v for k, v in good.items() if k != gone}
        frame = spark.createDataFrame([tuple(rest.values())], ", ".join(f"{k} string" for k in rest))
        assert frame.select(blockers(frame).alias("b")).first().b == [f"missing_or_unsafe:{gone}"]
        unknown = spark.createDataFrame([tuple((good | {gone: "unknown"}).values())], fields)
        assert unknown.select(blockers(unknown).alias("b")).first().b == [f"missing_or_unsafe:{gone}"]


def test_null_texts_are_decided(spark, tmp_path):
    from corpusloom.plans import registry

    docs = [(1, None), (2, ""), (3, "some words of a text"), (4, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    q = registry.queries()
    admitted = {r.doc_id: r.reasons for r in q["document_admission"](spark, str(tmp_path)).collect()}
    assert admitted == {1: "too_short", 2: "duplicate,too_short", 3: "too_short", 4: "duplicate,too_short"}
    assert {r.doc_id: r.status for r in q["exact_duplicate_status"](spark, str(tmp_path)).collect()} == {1: "unique", 2: "exact_duplicate", 3: "unique", 4: "exact_duplicate"}
    assert {r.doc_id: r.status for r in q["dedup_status"](spark, str(tmp_path)).collect()} == {1: "unique", 2: "exact_duplicate", 3: "unique", 4: "exact_duplicate"}


def test_concat_chop_covers_every_token(spark):
    units = [("a", 1, 1, 70), ("a", 2, 2, 10), ("b", 3, 3, 5), ("a", 4, 4, 0)]
    pieces = ops.concat_chop(spark.createDataFrame(units, "shard string, id long, seq long, length long"), 32).collect()
    assert sorted((p.shard, p.win, p.id, p.start, p.length, p.offset) for p in pieces) == [
        ("a", 0, 1, 0, 32, 0),
        ("a", 1, 1, 32, 32, 0),
        ("a", 2, 1, 64, 6, 0),
        ("a", 2, 2, 0, 10, 6),
        ("b", 0, 3, 0, 5, 0),
    ]


def test_an_edited_entry_breaks_the_chain_there(spark):
    rows = [(1, i, f"payload {i}") for i in range(5)]
    events = spark.createDataFrame(rows, "k long, step long, body string")
    ledger = chained(events, "k", "step", "body").join(events, ["k", "step"])
    assert first_breaks(ledger, "k", "step", "body").first().first_break is None
    edited = ledger.withColumn("body", F.when(F.col("step") == 2, "changed").otherwise(F.col("body")))
    assert first_breaks(edited, "k", "step", "body").first().first_break == 2
    dropped = ledger.where("step <> 1")
    assert first_breaks(dropped, "k", "step", "body").first().first_break == 2


def test_one_spike_in_a_flat_series(spark):
    series = [(1, i, 9.0 if i == 14 else 6.0 + (i % 2) * 0.01) for i in range(30)]
    found = spikes(spark.createDataFrame(series, "user_id long, step long, value double")).collect()
    assert [r.step for r in found] == [14]


def test_selection_is_bounded_and_floors_come_first():
    pool = [(i, "web" if i < 8 else "rare", 1.0 - i / 100) for i in range(12)]
    out = {i: (d, r) for i, d, r in select_in_rank_order(pool, 6, {"web": 5, "rare": 5}, {"rare": 2})}
    assert sum(d in ("accepted", "protected") for d, _ in out.values()) == 6
    assert [i for i, (d, _) in out.items() if d == "protected"] == [8, 9]
    assert out[7] == ("deferred", "batch_full")


def test_water_fill_respects_caps_and_budget(spark):
    supply = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", 1000.0)], "lane string, amount double")
    rows = {r.lane: r for r in water_fill(supply, "lane", "amount", 0.3, 4.0, 500.0).collect()}
    assert rows["a"].capped and rows["a"].allocated == 4.0
    assert rows["b"].capped and rows["b"].allocated == 40.0
    assert rows["c"].allocated == pytest.approx(456.0)


def test_quadrants(spark):
    rows = [(8.0, 7.0), (8.0, 8.0), (6.0, 6.0), (5.0, 6.0)]
    got = spark.createDataFrame(rows, "loss double, ref double").select(quadrant(F.col("loss"), F.col("ref"), F.lit(7.0)).alias("q"))
    assert [r.q for r in got.collect()] == ["learnable_hard", "irreducible_hard", "already_learned", "saturating"]


def test_personal_data_and_cleaning(spark):
    text = "Write to  a.b@mail.example\tor 9876543210 at 12 Gandhi Road\n\n\n\nend\x07 "
    row = spark.createDataFrame([(text,)], "t string").select(fx.clean_text("t").alias("c"), fx.pii_kinds(F.col("t")).alias("k"), fx.redact_pii(F.col("t")).alias("r")).first()
    assert row.c == "Write to a.b@mail.example or 9876543210 at 12 Gandhi Road\n\nend"
    assert row.k == ["email", "phone_in", "street_address"]
    assert "@" not in row.r and "9876543210" not in row.r and "Gandhi" not in row.r


def test_streaming_late_data_and_restart(spark, sf_dir, tmp_path):
    from corpusloom.streaming import events as ev

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(source)
    stream = ev.deduplicated(ev.read_events(spark, source), "30 days")
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(ev.append_ledger(out)).start().awaitTermination()
    # Later files bring the other half, which is older in part, and the first half again.
    events.coalesce(1).write.mode("append").parquet(source)
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(ev.append_ledger(out)).start().awaitTermination()
    ledger = spark.read.parquet(out)
    assert ledger.count() == ledger.select("event_id").distinct().count() == events.count()


def test_streaming_ledger_of_shuffled_files(spark, sf_dir, tmp_path):
    """The registered job over files that are not in time order, one batch each, gives what its SQL gives."""
    from pyspark.sql import functions as F

    from corpusloom.plans import registry

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ids = [r.event_id for r in events.orderBy(F.desc("ts")).collect()]
    for k, part in enumerate((ids[:300], ids[500:], ids[200:600])):  # the newest first, some events twice
        events.where(F.col("event_id").isin(part)).coalesce(1).write.parquet(str(tmp_path / f"events{k}.parquet"))
    unknown = events.where("event_id < 5").withColumn("event_id", F.lit(None).cast("long"))
    unknown.coalesce(1).write.parquet(str(tmp_path / "events3.parquet"))
    got = {r.event_type: (r.n, r.total) for r in registry.queries()["stream_dedup_ledger"](spark, str(tmp_path)).collect()}
    want = events.unionByName(unknown).groupBy("event_type").agg(F.count_distinct("event_id").alias("n"), F.round(F.sum("value"), 3).alias("total")).collect()
    assert got == {r.event_type: (r.n, r.total) for r in want}


def test_rank_of_the_embeddings(spark, sf_dir):
    from corpusloom.plans import registry

    x = np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], dtype=np.float64)
    e = np.linalg.eigvalsh(x.T @ x).clip(0)
    p = e[e > 0] / e.sum()
    row = registry.queries()["matrix_rank"](spark, sf_dir).first()
    assert (row.n, row.width, row["rank"]) == (*x.shape, np.linalg.matrix_rank(x))
    assert row.effective_rank == pytest.approx(float(np.exp(-(p * np.log(p)).sum())), abs=1e-3)


def test_bands_that_miss_lose_no_pair(spark, tmp_path, monkeypatch):
    from corpusloom.plans import registry
    from corpusloom.plans import similarity as plans

    base = [f"w{i}" for i in range(40)]
    texts = [base, base[:30] + ["x", "y"], base, [f"z{i}" for i in range(20)], base[4:], [w.upper() for w in base]]
    spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    shingles = [{tuple(w.lower() for w in t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in enumerate(shingles) for b, y in enumerate(shingles) if a < b and len(x & y) / len(x | y) >= 0.55}
    assert len(want) == 10
    monkeypatch.setattr(plans, "banded_pairs", lambda sets: spark.createDataFrame([], "a long, b long"))
    assert {(p.a, p.b): p.jaccard for p in registry.queries()["minhash_bands"](spark, str(tmp_path)).collect()} == want
    # Classes and the pairs of their first documents hold the same links.
    rows = registry.queries()["near_duplicate_pairs"](spark, str(tmp_path)).collect()
    first = {p.b: p.a for p in rows if p.copy}
    near = {(p.a, p.b): p.jaccard for p in rows if not p.copy}
    of = [first.get(i, i) for i in range(len(texts))]
    assert {(a, b): j for a in range(len(texts)) for b in range(a + 1, len(texts)) if (j := 1.0 if of[a] == of[b] else near.get((min(of[a], of[b]), max(of[a], of[b]))))} == want


def _documents(spark, folder, texts):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def _sql_rows(folder, name):
    import duckdb

    from corpusloom.plans import registry

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = c.sql(registry.oracle_sql()[name])
    return found.columns, sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", ["minhash_bands", "near_duplicate_pairs", "dedup_status"])
def test_groups_of_near_copies_are_compared_in_place(spark, tmp_path, monkeypatch, name):
    """Only a few pairs of a group's sets are sent with their grams, and the rows are those of the SQL."""
    from corpusloom.plans import registry

    r = random.Random(11)
    base = [[f"w{k}x{i}" for i in range(120)] for k in range(2)]
    texts = [" ".join(f"n{r.random()}" if r.random() < 0.012 else w for w in base[k % 2]) for k in range(80)]
    # Copies, other letters of the same lower case, white space and personal data, and what is no similar text.
    texts += [texts[0], texts[1].upper(), texts[2].replace(" ", " \t "), None, "", "one", "two words", "One", "a@b.c+x@y.z İstanbul Σας", "a@b.c+x@y.z istanbul σας"]
    texts += [" ".join(f"v{k}y{i}" for i in range(50)) for k in range(5)]
    _documents(spark, tmp_path, texts)
    sent, scored = [], similarity.scored_pairs

    def counted(pairs, *rest):
        sent.append(pairs.count())
        return scored(pairs, *rest)

    monkeypatch.setattr(similarity, "scored_pairs", counted)
    got = registry.queries()[name](spark, str(tmp_path))
    columns, want = _sql_rows(tmp_path, name)
    assert sorted((tuple(x) for x in got.select(*columns).collect()), key=str) == want
    assert len(want) > (90 if name == "dedup_status" else 900)
    assert sum(sent) < 800


def test_blocks_of_sets_and_keys_lose_no_pair(spark, monkeypatch):
    r = random.Random(12)
    base = r.sample(range(1 << 40), 40)
    rows = [(i, sorted({x if r.random() < 0.93 else r.randrange(1 << 40) for x in base})) for i in range(60)]
    sets = spark.createDataFrame([(i, len(x), x) for i, x in rows], "id long, n_grams long, grams array<bigint>")
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in rows for b, y in rows if a < b}
    want = {k: j for k, j in want.items() if j >= 0.55}
    nothing = lambda held: spark.createDataFrame([], "a long, b long")
    for cell, block, propose in ((7, 1 << 13, None), (1 << 10, 5, nothing), (3, 4, similarity.banded_pairs)):
        monkeypatch.setattr(similarity, "CELL", cell)
        monkeypatch.setattr(similarity, "BLOCK", block)
        assert {(p.a, p.b): pytest.approx(p.jaccard) for p in similarity.self_pairs(sets, 0.55, propose).collect()} == want


def test_order_of_duplicates(spark):
    from corpusloom.operators.graph import resolve_in_order

    r = random.Random(13)
    pairs = sorted({(min(p), max(p)) for p in ((r.randrange(60), r.randrange(60)) for _ in range(90)) if p[0] != p[1]})
    want = {}
    for b in range(70):
        before = [a for a, c in pairs if c == b and want[a] is None]
        want[b] = min(before, default=None)
    nodes, frame = spark.createDataFrame([(i,) for i in range(70)], "id long"), spark.createDataFrame(pairs, "a long, b long")
    assert {x.id: x.original for x in resolve_in_order(nodes, frame).collect()} == want
