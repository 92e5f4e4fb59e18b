"""Shards of documents: building, integrity, and joins from spans back to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import shards as ops
from corpusloom.plans.registry import query
from corpusloom.plans.text import words_sql
from corpusloom.sources.tables import table

BUDGET = 2048

#: The same fold as a recursive query: the next document goes on or starts a shard.
BUILT_SQL = f"""u AS (SELECT source AS lane, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, (len({words_sql('text')}) + 1)::BIGINT AS length, lang, text FROM documents),
b(lane, k, shard_no, start, stop) AS (SELECT lane, k, 0::BIGINT, 0::BIGINT, length FROM u WHERE k = 1
 UNION ALL SELECT u.lane, u.k, CASE WHEN b.stop + u.length > {BUDGET} THEN b.shard_no + 1 ELSE b.shard_no END, CASE WHEN b.stop + u.length > {BUDGET} THEN 0 ELSE b.stop END,
  CASE WHEN b.stop + u.length > {BUDGET} THEN u.length ELSE b.stop + u.length END FROM b JOIN u ON u.lane = b.lane AND u.k = b.k + 1),
s AS (SELECT b.lane, b.shard_no, u.id, b.start, b.stop, u.lang, u.text FROM b JOIN u ON u.lane = b.lane AND u.k = b.k)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is its words and one end token, a source is a lane."""
    length = (F.size(fx.words("text")) + 1).cast("long").alias("length")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("lane"), F.col("doc_id").alias("id"), length)
    return ops.build(docs, BUDGET)


@query(f"WITH RECURSIVE {BUILT_SQL} SELECT lane, shard_no, id, start, stop, id || ':' || start || '-' || stop AS span_id FROM s")
def shard_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies in its lane's shards, with the offset that starts anew in each shard."""
    return spans(spark, sf_dir).withColumn("span_id", F.concat(F.col("id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string")))


@query(
    f"""WITH RECURSIVE {BUILT_SQL} SELECT lane, shard_no, count(*)::BIGINT AS n_docs, max(stop)::BIGINT AS token_count, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages,
 sha256(string_agg(id || ':' || sha256(text), ',' ORDER BY id)) AS content_hash, max(stop) > {BUDGET} AS oversize FROM s GROUP BY lane, shard_no"""
)
def built_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest fields of each built shard; a shard holds at most the budget, or one document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.sha2("text", 256).alias("digest"))
    member = F.struct("id", F.concat(F.col("id").cast("string"), F.lit(":"), "digest").alias("entry"))
    m = spans(spark, sf_dir).join(d, "id").groupBy("lane", "shard_no").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("stop").alias("token_count"), F.sort_array(F.collect_list(member)).alias("m"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages")
    )
    return m.select(
        "lane", "shard_no", "n_docs", "token_count", F.array_join(F.col("m.id").cast("array<string>"), ",").alias("members"), "languages",
        F.sha2(F.array_join("m.entry", ","), 256).alias("content_hash"), (F.col("token_count") > BUDGET).alias("oversize"),
    )


@query(
    f"""WITH RECURSIVE {BUILT_SQL}, h AS (SELECT lane, shard_no, sha256(string_agg(id || ':' || sha256(text), ',' ORDER BY id)) AS stored, sha256(string_agg(id || ':' || sha256(text || CASE WHEN id % 97 = 0 THEN '!' ELSE '' END), ',' ORDER BY id)) AS found FROM s GROUP BY 1, 2)
SELECT lane, count(*)::BIGINT AS n_shards, count(*) FILTER (WHERE stored = found)::BIGINT AS intact, min(shard_no) FILTER (WHERE stored <> found)::BIGINT AS first_broken FROM h GROUP BY lane"""
)
def shard_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored content hashes against those of texts of which every 97th was edited after the build."""
    edited = F.concat("text", F.when(F.col("doc_id") % 97 == 0, "!").otherwise(""))
    entry = lambda t: F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2(t, 256))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), entry(F.col("text")).alias("stored"), entry(edited).alias("found"))
    m = spans(spark, sf_dir).join(d, "id").groupBy("lane", "shard_no").agg(F.sort_array(F.collect_list(F.struct("id", "stored", "found"))).alias("m"))
    h = m.select("lane", "shard_no", *(F.sha2(F.array_join(f"m.{c}", ","), 256).alias(c) for c in ("stored", "found")))
    same = F.col("stored") == F.col("found")
    return h.groupBy("lane").agg(F.count(F.lit(1)).alias("n_shards"), F.count_if(same).alias("intact"), F.min(F.when(~same, F.col("shard_no"))).alias("first_broken"))


@query(f"WITH RECURSIVE {BUILT_SQL} SELECT s.id AS doc_id, s.stop - s.start AS token_count, x.n_chars, x.lang FROM s JOIN documents x ON x.doc_id = s.id")
def span_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of documents from the spans that the manifests hold, exploded and joined with what is known of the documents."""
    s = spans(spark, sf_dir)
    held = s.groupBy("lane", "shard_no").agg(F.collect_list(F.struct("id", "start", "stop")).alias("token_spans"))  # as a manifest stores them
    each = held.select(F.inline("token_spans"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return each.join(d, "id").select(F.col("id").alias("doc_id"), (F.col("stop") - F.col("start")).alias("token_count"), "n_chars", "lang")


FIRST_SQL = f"""{BUILT_SQL}, m AS (SELECT lane, shard_no, list(id ORDER BY id) AS members FROM s GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {FIRST_SQL} SELECT m.lane, m.shard_no, x.lang AS language, CASE WHEN x.n_chars < 500 THEN 'B0' WHEN x.n_chars < 1500 THEN 'B1' WHEN x.n_chars < 5000 THEN 'B2' ELSE 'B3' END AS band FROM m JOIN documents x ON x.doc_id = m.members[1]")
def first_member_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed shard goes by the language and band of its first member."""
    first = spans(spark, sf_dir).groupBy("lane", "shard_no").agg(F.min("id").alias("doc_id"))
    n = F.col("n_chars")
    band = F.when(n < 500, "B0").when(n < 1500, "B1").when(n < 5000, "B2").otherwise("B3")
    return first.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lane", "shard_no", F.col("lang").alias("language"), band.alias("band"))


@query(
    """WITH o AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter(roles, lambda r, i: list_position(roles, r) = i), ',') AS lanes_in_order FROM o"""
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct members of a list, each where it first stood."""
    o = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return o.select("conv_id", F.array_join(F.array_distinct("t.role"), ",").alias("lanes_in_order"))


@query(
    f"""WITH RECURSIVE {BUILT_SQL}, m AS (SELECT lane, shard_no, max(stop) AS tokens, count(*)::BIGINT AS n_docs FROM s GROUP BY 1, 2),
e AS (SELECT s.lane, s.shard_no, count(*)::BIGINT AS exposures, count(DISTINCT v.user_id)::BIGINT AS branches FROM s JOIN events v ON v.event_id = s.id WHERE v.event_type <> 'error' GROUP BY 1, 2),
c AS (SELECT s.lane, s.shard_no, max(v.event_id)::BIGINT AS last_batch FROM s JOIN events v ON v.event_id = s.id WHERE v.event_type = 'purchase' GROUP BY 1, 2)
SELECT m.lane, m.shard_no, m.tokens, m.n_docs, coalesce(exposures, 0)::BIGINT AS exposures, coalesce(branches, 0)::BIGINT AS branches, last_batch FROM m LEFT JOIN e ON e.lane = m.lane AND e.shard_no = m.shard_no LEFT JOIN c ON c.lane = m.lane AND c.shard_no = m.shard_no"""
)
def shard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three sources say of a shard: its manifest, the exposures of its documents (an event is a batch that served one), the last batch."""
    s = spans(spark, sf_dir)
    key = ["lane", "shard_no"]
    served = s.join(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type"), "id")
    m = s.groupBy(*key).agg(F.max("stop").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    e = served.where("event_type <> 'error'").groupBy(*key).agg(F.count(F.lit(1)).alias("exposures"), F.count_distinct("user_id").alias("branches"))
    c = served.where("event_type = 'purchase'").groupBy(*key).agg(F.max("id").alias("last_batch"))
    return m.join(e, key, "left").join(c, key, "left").na.fill(0, ["exposures", "branches"]).select(*key, "tokens", "n_docs", "exposures", "branches", "last_batch")


# -- masks of packed windows

CTX = 64
#: A window holds the turns of a conversation, cut at CTX tokens; a token is a word, and its role says whether it bears loss.
MASK_SQL = f"""t AS (SELECT conv_id, turn, role, len({words_sql('text')}) AS n FROM conversations),
x AS (SELECT conv_id, turn, role, unnest(range(0, n)) AS a0 FROM t),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, a0) - 1 AS k, turn AS seg, a0 AS pos, role, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask FROM x),
c AS (SELECT conv_id, k // {CTX} AS win, k % {CTX} AS i, seg, role, CASE WHEN mask = 1 AND first THEN 0 ELSE mask END AS mask FROM (SELECT *, k % {CTX} = 0 OR pos = 0 AS first FROM p)),
q AS (SELECT conv_id, win, i, seg, role, mask, i - min(i) OVER (PARTITION BY conv_id, win, seg) AS pos FROM c)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, win and the parallel arrays of each window: segment, position in it, role and mask, without padding.

    Position, segment and mask come from arrays of one conversation each: no token is shuffled. A
    token bears loss when its role does and the one before it stands in the same segment.
    """
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.size(fx.words("text")).alias("n"), "role"))).alias("t"))
    tokens = F.flatten(F.transform(F.filter("t", lambda x: x["n"] > 0), lambda x: F.array_repeat(F.struct(x["turn"].alias("seg"), x["role"].alias("role")), x["n"])))
    each = t.select("conv_id", tokens.alias("k")).where("size(k) > 0")
    cut = each.select("conv_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("k") - 1) / CTX).cast("int")), lambda w: F.slice("k", w * CTX + 1, F.lit(CTX)))).alias("win", "k"))
    same = lambda i: (i > 0) & (F.get("k", i - 1)["seg"] == F.get("k", i)["seg"])
    return cut.select(
        "conv_id",
        "win",
        F.transform("k", lambda x: x["seg"]).alias("segment"),
        F.transform("k", lambda x, i: i - F.array_position(F.transform("k", lambda y: y["seg"]), x["seg"]).cast("int") + 1).alias("position"),
        F.transform("k", lambda x: x["role"]).alias("role"),
        F.transform("k", lambda x, i: F.when((x["role"] == "assistant") & same(i), 1).otherwise(0)).alias("mask"),
    )


def padded(w: DataFrame) -> DataFrame:
    """Every array as long as a window: padding has segment -1, role pad, no mask, and positions that go on."""
    rest = CTX - F.size("segment")
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), rest)).alias(c)
    counted = F.when(rest > 0, F.sequence(F.lit(0), rest - 1)).otherwise(F.array().cast("array<int>"))
    return w.select("conv_id", "win", fill("segment", -1), F.concat("position", counted).alias("position"), fill("role", "pad"), fill("mask", 0), rest.alias("padding"))


@query(
    f"""WITH {MASK_SQL}, w AS (SELECT conv_id, win, list(seg ORDER BY i) AS s, list(pos ORDER BY i) AS p, list(mask ORDER BY i) AS m, count(*) AS n FROM q GROUP BY 1, 2)
SELECT conv_id, win::BIGINT AS win, ({CTX} - n)::BIGINT AS padding, array_to_string(list_concat(s, list_transform(range(0, {CTX} - n), lambda i: -1)), ' ') AS segments, array_to_string(list_concat(p, range(0, {CTX} - n)), ' ') AS positions, list_sum(m)::BIGINT AS loss_bearing FROM w"""
)
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c, to: F.array_join(F.col(c).cast("array<string>"), " ").alias(to)
    total = F.aggregate("mask", F.lit(0), lambda a, b: a + b).cast("long")
    return padded(windows(spark, sf_dir)).select("conv_id", F.col("win").cast("long").alias("win"), F.col("padding").cast("long").alias("padding"), shown("segment", "segments"), shown("position", "positions"), total.alias("loss_bearing"))


#: Edits of a window that the validator must find, by a window's number: none, a shifted role, a wrong position, loss on padding.
FAULTS = ("none", "role", "position", "padding")


@query(
    f"""WITH {MASK_SQL}, w AS (SELECT conv_id, win, max(i) + 1 AS n, bool_or(mask = 1) AS loss, bool_or(mask = 1 AND i > 0) AS inner_loss FROM q GROUP BY 1, 2),
f AS (SELECT conv_id, win, n, CASE (conv_id + win) % 4 WHEN 1 THEN 'role' WHEN 2 THEN 'position' WHEN 3 THEN 'padding' ELSE 'none' END AS fault, inner_loss, loss FROM w)
SELECT conv_id, win::BIGINT AS win, fault, CASE WHEN fault = 'role' AND loss THEN 'role' WHEN fault = 'position' THEN 'position' WHEN fault = 'padding' AND n < {CTX} THEN 'padding' ELSE '' END AS errors FROM f"""
)
def mask_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural rules of packed windows, on windows of which three of four were edited: equal lengths, padding without segment, role and loss,
    loss only under supervised roles, and positions that start anew in each segment."""
    p = padded(windows(spark, sf_dir)).withColumn("fault", F.element_at(F.array(*map(F.lit, FAULTS)), (F.pmod(F.col("conv_id") + F.col("win"), F.lit(4)) + 1).cast("int")))
    fault = F.col("fault")
    p = p.withColumns(
        {
            "role": F.when(fault == "role", F.transform("role", lambda r: F.when(r == "assistant", "user").otherwise(r))).otherwise(F.col("role")),
            "position": F.when(fault == "position", F.transform("position", lambda x: x + 1)).otherwise(F.col("position")),
            "mask": F.when((fault == "padding") & (F.col("padding") > 0), F.concat(F.slice("mask", F.lit(1), F.lit(CTX - 1)), F.array(F.lit(1)))).otherwise(F.col("mask")),
        }
    )
    rows = F.transform(F.arrays_zip("segment", "position", "role", "mask"), lambda x, i: F.struct(x["segment"].alias("s"), x["position"].alias("p"), x["role"].alias("r"), x["mask"].alias("m"), F.get("segment", i - 1).alias("b"), F.get("position", i - 1).alias("q")))
    pad = lambda x: x["s"] < 0
    wrong = {
        "length": ~F.forall(F.array(*(F.size(c) for c in ("position", "role", "mask"))), lambda n: n == F.size("segment")),
        "padding": F.exists(rows, lambda x: pad(x) & ((x["m"] != 0) | (x["r"] != "pad"))),
        "role": F.exists(rows, lambda x: ~pad(x) & (x["m"] == 1) & (x["r"] != "assistant")),
        "position": F.exists(rows, lambda x: x["p"] != F.when(x["b"].eqNullSafe(x["s"]), x["q"] + 1).otherwise(0)),
    }
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in wrong.items())))
    return p.select("conv_id", F.col("win").cast("long").alias("win"), "fault", F.array_join(named, ",").alias("errors"))


@query(
    f"""WITH {MASK_SQL}, g AS (SELECT conv_id, win, seg, count(*) AS n FROM q GROUP BY 1, 2, 3)
SELECT conv_id, win::BIGINT AS win, 0::BIGINT AS crossings_kept_apart, ((sum(n) * sum(n) - sum(n * n)) / 2)::BIGINT AS crossings_without_mask FROM g GROUP BY conv_id, win"""
)
def attention_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tokens of different segments that a mask lets through: none by the block-diagonal mask, which is made from positions, all by a causal one.

    The mask allows a token as many earlier ones as its position says; what it reaches is then held
    against the segments.
    """
    w = windows(spark, sf_dir)
    reach = F.transform("position", lambda p, i: F.size(F.filter(F.slice("segment", F.greatest(i - p + 1, F.lit(1)), p), lambda s: s != F.get("segment", i))))
    causal = F.transform("segment", lambda s, i: F.size(F.filter(F.slice("segment", F.lit(1), i), lambda t: t != s)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y).cast("long")
    return w.select("conv_id", F.col("win").cast("long").alias("win"), total(reach).alias("crossings_kept_apart"), total(causal).alias("crossings_without_mask"))


@query(
    f"""WITH {MASK_SQL}, w AS (SELECT conv_id, win, list(mask ORDER BY i) AS m, list(role ORDER BY i) AS r FROM q GROUP BY 1, 2)
SELECT conv_id, win::BIGINT AS win, sha256('[' || array_to_string(m, ',') || ']') AS mask_hash, sha256('["' || array_to_string(r, '","') || '"]') AS role_hash FROM w"""
)
def mask_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate hashes of mask and roles: what annotates a sample is not its identity."""
    return windows(spark, sf_dir).select("conv_id", F.col("win").cast("long").alias("win"), F.sha2(F.to_json("mask"), 256).alias("mask_hash"), F.sha2(F.to_json("role"), 256).alias("role_hash"))


REPEATS = 3


@query(
    f"""WITH w AS (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations),
k AS (SELECT conv_id, turn, w, list_transform(range(1, len(w) + 1), lambda i: i > {REPEATS} AND list_position([w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] FOR j IN range(1, i - {REPEATS} + 1)], w[i - 2] || ' ' || w[i - 1] || ' ' || w[i]) IS NOT NULL) AS m FROM w)
SELECT conv_id, turn, len(w)::BIGINT AS n, len(list_filter(m, lambda x: x))::BIGINT AS masked FROM k"""
)
def repeat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that end a three-word run which ended before in the same turn; the trainer masks them."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", fx.words("text").alias("w"))
    n = F.size("w")
    runs = F.when(n >= REPEATS, F.transform(F.sequence(F.lit(1), n - REPEATS + 1), lambda i: F.array_join(F.slice("w", i, F.lit(REPEATS)), " "))).otherwise(F.array().cast("array<string>"))
    return w.select("conv_id", "turn", n.cast("long").alias("n"), runs.alias("runs")).select("conv_id", "turn", "n", (F.size("runs") - F.size(F.array_distinct("runs"))).cast("long").alias("masked"))


@query(
    f"""WITH {MASK_SQL}, b AS (SELECT conv_id, win, string_agg(seg::VARCHAR, ',' ORDER BY i) AS spans, '[' || string_agg(mask::VARCHAR, ',' ORDER BY i) || ']' AS m FROM q GROUP BY 1, 2),
h AS (SELECT conv_id // 8 AS batch, string_agg(conv_id || '/' || win || ':' || sha256(spans) || ':' || sha256(m), '|' ORDER BY conv_id, win) AS t, count(*)::BIGINT AS samples FROM b GROUP BY 1)
SELECT batch::BIGINT AS batch, samples, sha256(t) AS batch_hash FROM h"""
)
def batch_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a batch over its samples, their spans and the hashes of their masks; a batch is eight conversations."""
    w = windows(spark, sf_dir)
    entry = F.concat_ws(":", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("win").cast("string")), F.sha2(F.array_join(F.col("segment").cast("array<string>"), ","), 256), F.sha2(F.to_json("mask"), 256))
    each = w.select(F.floor(F.col("conv_id") / 8).alias("batch"), F.struct("conv_id", "win", entry.alias("entry")).alias("e"))
    return each.groupBy("batch").agg(F.count(F.lit(1)).alias("samples"), F.sha2(F.array_join(F.sort_array(F.collect_list("e"))["entry"], "|"), 256).alias("batch_hash"))
