"""Packing policies over documents, and masks over conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.functions.arrow_bytes import SLICE_BYTES, buffers, slices
from corpusloom.functions.hashing import content_hash
from corpusloom.operators import packing as ops
from corpusloom.plans.registry import query
from corpusloom.plans.text import words_sql
from corpusloom.sources.tables import table

CTX = 128
UNITS_SQL = f"u AS (SELECT source AS shard, doc_id AS id, doc_id AS seq, len({words_sql('text')})::BIGINT AS length FROM documents)"
SUMMARY_SQL = f"""s AS (SELECT shard, count(DISTINCT win)::BIGINT AS windows, sum(length)::BIGINT AS tokens FROM p GROUP BY shard),
k AS (SELECT shard, count(*) FILTER (WHERE n > 1)::BIGINT AS split_units FROM (SELECT shard, id, count(DISTINCT win) AS n FROM p GROUP BY 1, 2) GROUP BY shard)
SELECT s.shard, windows, tokens, (windows * {CTX} - tokens)::BIGINT AS padding, round(tokens / (windows * {CTX}), 4) AS used, split_units FROM s JOIN k ON s.shard = k.shard"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a unit of its words, a source is a shard."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("shard"), F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.size(fx.words("text")).cast("long").alias("length"))


@query(f"WITH {UNITS_SQL}, p AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY seq) - 1 AS win, id, least(length, {CTX}) AS length FROM u), {SUMMARY_SQL}")
def pack_pad_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(ops.pad_only(units(spark, sf_dir), CTX), CTX)


@query(
    f"""WITH {UNITS_SQL}, c AS (SELECT shard, id, length, unnest(range(0, greatest(length, 1), {CTX})) AS start FROM u WHERE length > 0),
p AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY id, start) - 1 AS win, id, least(length - start, {CTX}) AS length FROM c), {SUMMARY_SQL}"""
)
def pack_long_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(ops.long_context(units(spark, sf_dir), CTX), CTX)


@query(
    f"""WITH {UNITS_SQL}, o AS (SELECT *, CAST(sum(length) OVER (PARTITION BY shard ORDER BY seq) AS BIGINT) AS fin FROM u WHERE length > 0), c AS (SELECT shard, id, fin - length AS lo, fin, unnest(range((fin - length) // {CTX}, (fin - 1) // {CTX} + 1)) AS win FROM o),
p AS (SELECT shard, win, id, least(fin, (win + 1) * {CTX}) - greatest(lo, win * {CTX}) AS length FROM c), {SUMMARY_SQL}"""
)
def pack_concat_chop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(ops.concat_chop(units(spark, sf_dir), CTX), CTX)


def binned_sql(policy: str) -> str:
    """The policy as a fold over a shard's units: a list of fills, into which each unit goes or which it makes longer."""
    order = "length DESC, seq" if policy == "best_fit" else "seq"
    size = f"least(u.length, {CTX})"
    fits = f"list_filter(b.used, lambda x: x + {size} <= {CTX})"
    at = f"list_position(b.used, list_max({fits}))" if policy == "best_fit" else f"list_position(list_transform(b.used, lambda x: x + {size} <= {CTX}), true)"
    put = f"CASE WHEN len({fits}) = 0 THEN list_append(b.used, {size}) ELSE list_concat(b.used[:{at} - 1], [b.used[{at}] + {size}], b.used[{at} + 1:]) END"
    cut = f"list_concat(b.used, list_transform(range(0, u.length, {CTX}), lambda s: least({CTX}, u.length - s)))"
    step = put if policy == "whole" else f"CASE WHEN u.length > {CTX} THEN {cut} ELSE {put} END"
    split = "0" if policy == "whole" else f"CASE WHEN u.length > {CTX} THEN 1 ELSE 0 END"
    tokens = size if policy == "whole" else "u.length"
    return f"""o_{policy} AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {order}) AS k FROM u WHERE length > 0),
b_{policy}(shard, k, used, tokens, split) AS (SELECT DISTINCT shard, 0::BIGINT, []::BIGINT[], 0::BIGINT, 0::BIGINT FROM o_{policy} UNION ALL SELECT u.shard, u.k, {step}, b.tokens + {tokens}, b.split + {split} FROM b_{policy} b JOIN o_{policy} u ON u.shard = b.shard AND u.k = b.k + 1),
s_{policy} AS (SELECT shard, len(arg_max(used, k))::BIGINT AS windows, max(tokens)::BIGINT AS tokens, (len(arg_max(used, k)) * {CTX} - max(tokens))::BIGINT AS padding, round(max(tokens) / (len(arg_max(used, k)) * {CTX}), 4) AS used, max(split)::BIGINT AS split_units FROM b_{policy} GROUP BY shard)"""


@query(f"WITH RECURSIVE {UNITS_SQL}, {binned_sql('greedy')} SELECT * FROM s_greedy")
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(ops.binned(units(spark, sf_dir), CTX, "greedy"), CTX)


@query(f"WITH RECURSIVE {UNITS_SQL}, {binned_sql('best_fit')} SELECT * FROM s_best_fit")
def pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(ops.binned(units(spark, sf_dir), CTX, "best_fit"), CTX)


@query(f"WITH RECURSIVE {UNITS_SQL}, {binned_sql('whole')} SELECT * FROM s_whole")
def pack_structure_preserving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.summary(ops.binned(units(spark, sf_dir), CTX, "whole"), CTX)


COMPARED = f"""n AS (SELECT 'pad_only' AS policy, count(*)::BIGINT AS windows, sum(least(length, {CTX}))::BIGINT AS tokens, 0::BIGINT AS split_units FROM u
UNION ALL SELECT 'long_context', sum(ceil(length / {CTX}))::BIGINT, sum(length)::BIGINT, count(*) FILTER (WHERE length > {CTX})::BIGINT FROM u WHERE length > 0
UNION ALL SELECT 'concat_chop', sum(ceil(t / {CTX}))::BIGINT, sum(t)::BIGINT, sum(k)::BIGINT FROM (SELECT shard, sum(length) AS t, count(*) FILTER (WHERE (fin - length) // {CTX} <> (fin - 1) // {CTX}) AS k FROM (SELECT *, CAST(sum(length) OVER (PARTITION BY shard ORDER BY seq) AS BIGINT) AS fin FROM u WHERE length > 0) GROUP BY shard)
UNION ALL SELECT 'greedy', sum(windows)::BIGINT, sum(tokens)::BIGINT, sum(split_units)::BIGINT FROM s_greedy UNION ALL SELECT 'best_fit', sum(windows)::BIGINT, sum(tokens)::BIGINT, sum(split_units)::BIGINT FROM s_best_fit UNION ALL SELECT 'whole', sum(windows)::BIGINT, sum(tokens)::BIGINT, sum(split_units)::BIGINT FROM s_whole)
SELECT policy, windows, tokens, (windows * {CTX} - tokens)::BIGINT AS padding, split_units, round(tokens / (windows * {CTX}), 4) AS used FROM n"""


@query(f"WITH RECURSIVE {UNITS_SQL}, {binned_sql('greedy')}, {binned_sql('best_fit')}, {binned_sql('whole')}, {COMPARED}")
def packing_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies side by side."""
    u = units(spark, sf_dir)
    named = {
        "pad_only": ops.pad_only(u, CTX),
        "long_context": ops.long_context(u, CTX),
        "concat_chop": ops.concat_chop(u, CTX),
        **{p: ops.binned(u, CTX, p) for p in ("greedy", "best_fit", "whole")},
    }
    out = None
    for name, pieces in named.items():
        one = ops.summary(pieces, CTX).agg(F.sum("windows").alias("windows"), F.sum("tokens").alias("tokens"), F.sum("padding").alias("padding"), F.sum("split_units").alias("split_units"))
        one = one.select(F.lit(name).alias("policy"), "*", F.round(F.col("tokens") / (F.col("windows") * CTX), 4).alias("used"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {UNITS_SQL}, r AS (SELECT id % 4 AS rank, count(*)::BIGINT AS n, sum(length)::BIGINT AS tokens, sum(length * length)::BIGINT AS attention FROM u GROUP BY 1)
SELECT rank, n, tokens, attention, round(100 * (max(attention) OVER () - min(attention) OVER ()) / avg(attention) OVER (), 2) AS skew FROM r"""
)
def rank_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and attention cost of four ranks, and the spread of the cost in percent."""
    r = units(spark, sf_dir).groupBy(F.pmod("id", F.lit(4)).alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"), F.sum(F.col("length") * F.col("length")).alias("attention"))
    spread = r.agg((100 * (F.max("attention") - F.min("attention")) / F.avg("attention")).alias("s"))
    return r.crossJoin(F.broadcast(spread)).select("rank", "n", "tokens", "attention", F.round("s", 2).alias("skew"))  # one row a rank


def supervised(role: Column) -> Column:
    """Whether tokens of a role bear loss: what the assistant says does, context does not; an unknown role is an error."""
    return F.when(role == "assistant", 1).when(role.isin("user", "system"), 0).otherwise(F.raise_error(F.concat(F.lit("unknown role "), role)))


TURNS_SQL = f"t AS (SELECT conv_id, turn, role, len({words_sql('text')}) AS n, CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS mask FROM conversations)"


@query(f"WITH {TURNS_SQL} SELECT conv_id, sum(n)::BIGINT AS tokens, sum(n * mask)::BIGINT AS loss_bearing, round(sum(n * mask) / greatest(sum(n), 1), 4) AS useful FROM t GROUP BY conv_id")
def conversation_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", F.size(fx.words("text")).alias("n"), supervised(F.col("role")).alias("mask"))
    loss = F.sum(F.col("n") * F.col("mask"))
    return t.groupBy("conv_id").agg(F.sum("n").alias("tokens"), loss.alias("loss_bearing"), F.round(loss / F.greatest(F.sum("n"), F.lit(1)), 4).alias("useful"))


@query(
    f"""WITH {TURNS_SQL}, o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS fin, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
SELECT conv_id, turn, (fin - n)::BIGINT AS start, fin::BIGINT AS stop, (mask = 1 AND before IS NOT NULL AND before <> role)::BOOLEAN AS first_token_crosses FROM o"""
)
def role_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of each turn in the concatenated conversation, and whether its first supervised token follows another role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(fx.words("text")).cast("long").alias("n"), supervised(F.col("role")).alias("mask"))
    o = t.withColumns({"stop": F.sum("n").over(w), "before": F.lag("role").over(w)})
    crosses = (F.col("mask") == 1) & F.col("before").isNotNull() & (F.col("before") != F.col("role"))
    return o.select("conv_id", "turn", (F.col("stop") - F.col("n")).alias("start"), "stop", F.coalesce(crosses, F.lit(False)).alias("first_token_crosses"))


@query(
    f"""WITH {UNITS_SQL}, o AS (SELECT *, CAST(sum(length) OVER (PARTITION BY shard ORDER BY seq) AS BIGINT) AS fin FROM u WHERE length > 0), c AS (SELECT shard, id, fin - length AS lo, fin, unnest(range((fin - length) // {CTX}, (fin - 1) // {CTX} + 1)) AS win FROM o),
p AS (SELECT shard, win, id, least(fin, (win + 1) * {CTX}) - greatest(lo, win * {CTX}) AS length FROM c)
SELECT shard, win::BIGINT AS win, ((sum(length) * sum(length) - sum(length * length)) / 2)::BIGINT AS blocked_pairs FROM p GROUP BY shard, win"""
)
def blocked_attention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of positions of different documents in a window, which a block-diagonal mask keeps apart: a closed form of the lengths."""
    p = ops.concat_chop(units(spark, sf_dir), CTX)
    n = F.sum("length")
    return p.groupBy("shard", "win").agg(((n * n - F.sum(F.col("length") * F.col("length"))) / 2).cast("long").alias("blocked_pairs"))


@query(
    """SELECT doc_id, sha256(unhex(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: b || '000000'), ''))) AS token_sha,
 octet_length(encode(text))::BIGINT AS n_tokens FROM documents"""
)
def shard_token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over little-endian 32-bit tokens; here a token is a byte."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                digests = []
                for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    digest = hashlib.sha256()
                    for at in range(start, end, SLICE_BYTES):
                        digest.update(data[at : min(end, at + SLICE_BYTES)].astype("<u4"))
                    digests.append(digest.hexdigest())
                given = part.column("text").is_valid()
                hashes, sizes = pa.array(digests, pa.string()), pa.array(np.diff(offsets), pa.int64())
                yield pa.record_batch([part.column("doc_id"), pc.if_else(given, hashes, None), pc.if_else(given, sizes, None)], names=["doc_id", "token_sha", "n_tokens"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(hashed, "doc_id long, token_sha string, n_tokens long")


@query("SELECT conv_id, substr(sha256('{\"conv_id\":' || conv_id || ',\"n\":' || count(*) || '}'), 1, 16) AS sample_id FROM conversations GROUP BY conv_id")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sixteen digits of the hash of canonical JSON."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("conv_id", F.substring(content_hash(conv_id="conv_id", n="n"), 1, 16).alias("sample_id"))
