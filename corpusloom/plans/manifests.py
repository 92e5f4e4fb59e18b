"""Whole manifests of shards, feature cells of words, lags, and a ledger read back from its lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import GENESIS
from corpusloom.operators.prefix import row_numbers
from corpusloom.plans.admission import SCREENED_SQL, screened
from corpusloom.plans.ledger import CHAIN_SQL, chained, payload
from corpusloom.plans.registry import query
from corpusloom.plans.runs import LICENSE_SQL
from corpusloom.plans.statistics import WORD_COUNTS_SQL, word_counts
from corpusloom.plans.windows import steps
from corpusloom.sources import sinks
from corpusloom.sources.store import shared_dir
from corpusloom.sources.tables import json_lines, table

#: Documents of a shard (by id), so that its lists are bounded; languages that are validated; versions of tokenizer and cleaning.
SHARD, LANGUAGES, TOKENIZER, CLEANING = 32, ("de", "en", "es", "fr"), "words/1", "screen/1"

FACTS_SQL = f"""{SCREENED_SQL}, q AS (SELECT s.doc_id, s.source, s.n_words, s.reasons, x.lang, coalesce(x.text, '') AS text, s.doc_id // {SHARD} AS part, {LICENSE_SQL.replace("text", "x.text")} AS tier,
  CASE WHEN s.n_words < 50 THEN 'B0' WHEN s.n_words < 200 THEN 'B1' WHEN s.n_words < 1000 THEN 'B2' ELSE 'B3' END AS band FROM s JOIN documents x ON x.doc_id = s.doc_id),
h AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY source, part ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q),
b AS (SELECT source, part, lang, round(sum(octet_length(encode(text))) / greatest(sum(n_words), 1), 4) AS f FROM q GROUP BY 1, 2, 3),
l AS (SELECT source, part, string_agg(lang || '=' || printf('%.4f', f), ',' ORDER BY lang) AS fertility FROM b GROUP BY 1, 2)"""


@query(
    f"""WITH {FACTS_SQL} SELECT h.source || '-' || h.part AS shard_id, CASE WHEN bool_or(list_contains(reasons, 'eval_overlap')) THEN 'held' ELSE 'train' END AS split, h.source AS capability_lane, h.source AS source_ids,
 string_agg(doc_id, ',' ORDER BY doc_id) AS document_ids, count(*)::BIGINT AS n_documents, sum(n_words)::BIGINT AS token_count, sha256('{TOKENIZER}') AS tokenizer_hash, '{TOKENIZER}' AS tokenizer_version,
 sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS content_hash, sha256('{CLEANING}') AS cleaning_pipeline_hash, CASE WHEN bool_or(list_contains(reasons, 'duplicate')) THEN 'contains_duplicates' ELSE 'unique' END AS dedup_status,
 count(*) FILTER (WHERE list_contains(reasons, 'duplicate'))::BIGINT AS duplicates, CASE WHEN bool_or(len(list_distinct(string_split(text, chr(10)))) < 0.7 * len(string_split(text, chr(10)))) THEN 'contains_repeats' ELSE 'screened' END AS repeat_ngram_status,
 CASE WHEN bool_or(list_contains(reasons, 'personal_data')) THEN 'missing' ELSE 'screened' END AS pii_screen_status, bool_and(lang IN {LANGUAGES}) AS language_validated,
 CASE WHEN bool_or(list_contains(reasons, 'eval_overlap')) THEN 'blocked_or_unknown' ELSE 'clear' END AS eval_overlap_status, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages,
 CASE WHEN bool_or(regexp_matches(text, '\\p{{L}}')) THEN 'LATIN' ELSE '' END AS scripts, string_agg(DISTINCT band, ',' ORDER BY band) AS difficulty_bands,
 CASE WHEN bool_or(tier = 'unsafe') THEN 'unsafe' WHEN bool_or(tier = 'review') THEN 'review' ELSE 'safe' END AS license_tier, CASE WHEN bool_and(tier = 'safe') THEN 'audited' ELSE 'needs_review' END AS provenance_tier,
 any_value(l.fertility) AS fertility_by_language, string_agg(doc_id || ':' || start || '-' || (start + n_words), ' ' ORDER BY doc_id) AS token_spans, '' AS parent_shard_ids
FROM h JOIN l ON l.source = h.source AND l.part = h.part GROUP BY h.source, h.part"""
)
def full_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of shards of a few dozen documents with all their fields: members and spans, hashes, the worst status of any member, languages, bands and costs."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text"))
    low, lines = F.lower("text"), F.split("text", "\n")
    words = F.col("n_words")
    facts = screened(spark, sf_dir).join(docs, "doc_id").select(
        "doc_id",
        "source",
        "lang",
        "n_words",
        "reasons",
        F.floor(F.col("doc_id") / SHARD).alias("part"),
        F.octet_length("text").alias("bytes"),
        F.sha2("text", 256).alias("digest"),
        (F.size(F.array_distinct(lines)) < 0.7 * F.size(lines)).alias("repeats"),
        F.col("text").rlike(r"\p{L}").alias("letters"),
        F.when(low.rlike("all rights reserved|confidential"), "unsafe").when(low.rlike("cc by-nc|noncommercial|non-commercial"), "review").otherwise("safe").alias("tier"),
        F.when(words < 50, "B0").when(words < 200, "B1").when(words < 1000, "B2").otherwise("B3").alias("band"),
    )
    before = Window.partitionBy("source", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("start", F.coalesce(F.sum("n_words").over(before), F.lit(0)))
    costs = facts.groupBy("source", "part", "lang").agg(F.round(F.sum("bytes") / F.greatest(F.sum("n_words"), F.lit(1)), 4).alias("f"))
    costs = costs.groupBy("source", "part").agg(F.array_join(F.array_sort(F.collect_list(F.concat("lang", F.lit("="), F.format_string("%.4f", "f")))), ",").alias("fertility_by_language"))
    has = lambda r: F.bool_or(F.array_contains("reasons", r))
    ordered = lambda x: F.array_sort(F.collect_list(F.struct("doc_id", x.alias("x"))))["x"]
    text_of = lambda c: F.col(c).cast("string")
    spans = F.concat(text_of("doc_id"), F.lit(":"), text_of("start"), F.lit("-"), (F.col("start") + F.col("n_words")).cast("string"))
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    m = facts.groupBy("source", "part").agg(
        F.when(has("eval_overlap"), "held").otherwise("train").alias("split"),
        F.array_join(ordered(text_of("doc_id")), ",").alias("document_ids"),
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("n_words").alias("token_count"),
        F.sha2(F.array_join(ordered(F.col("digest")), ","), 256).alias("content_hash"),
        F.when(has("duplicate"), "contains_duplicates").otherwise("unique").alias("dedup_status"),
        F.count_if(F.array_contains("reasons", "duplicate")).alias("duplicates"),
        F.when(F.bool_or("repeats"), "contains_repeats").otherwise("screened").alias("repeat_ngram_status"),
        F.when(has("personal_data"), "missing").otherwise("screened").alias("pii_screen_status"),
        F.bool_and(F.col("lang").isin(*LANGUAGES)).alias("language_validated"),
        F.when(has("eval_overlap"), "blocked_or_unknown").otherwise("clear").alias("eval_overlap_status"),
        distinct("lang").alias("languages"),
        F.when(F.bool_or("letters"), "LATIN").otherwise("").alias("scripts"),
        distinct("band").alias("difficulty_bands"),
        F.when(F.bool_or(F.col("tier") == "unsafe"), "unsafe").when(F.bool_or(F.col("tier") == "review"), "review").otherwise("safe").alias("license_tier"),
        F.array_join(ordered(spans), " ").alias("token_spans"),
    )
    fixed = {"tokenizer_hash": F.sha2(F.lit(TOKENIZER), 256), "tokenizer_version": F.lit(TOKENIZER), "cleaning_pipeline_hash": F.sha2(F.lit(CLEANING), 256), "parent_shard_ids": F.lit("")}
    named = {"shard_id": F.concat("source", F.lit("-"), text_of("part")), "capability_lane": F.col("source"), "source_ids": F.col("source"), "provenance_tier": F.when(F.col("license_tier") == "safe", "audited").otherwise("needs_review")}
    return m.join(costs, ["source", "part"]).withColumns({**fixed, **named}).drop("source", "part")


#: Positions of a word that have cells, digits of an index-factored cell.
POSITIONS, DIGITS = 32, 2
CELLS_SQL = f"""w AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS v FROM c),
ch AS (SELECT lang, unicode(ch) AS cp, ch, pos FROM (SELECT lang, unnest(string_split(word, '')) AS ch, unnest(range(0, length(word))) AS pos FROM w) WHERE pos < {POSITIONS}),
by_ AS (SELECT lang, CAST('0x' || unnest(regexp_extract_all(hex(encode(word)), '..')) AS INTEGER) AS b, unnest(range(0, octet_length(encode(word)))) AS pos FROM w),
x AS (SELECT lang, 'byte' AS kind, b * {POSITIONS} + pos AS cell FROM by_ WHERE pos < {POSITIONS}
 UNION ALL SELECT lang, 'char', (cp >> 7) * {POSITIONS} + pos FROM ch UNION ALL SELECT lang, 'char', 8706 * {POSITIONS} + (cp & 127) * {POSITIONS} + pos FROM ch
 UNION ALL SELECT lang, 'phoneme', (cp & 127) * {POSITIONS} + pos FROM ch WHERE cp BETWEEN 2304 AND 3455 UNION ALL SELECT lang, 'phoneme', 128 * {POSITIONS} + ((cp - 2304) >> 7) FROM ch WHERE cp BETWEEN 2304 AND 3455
 UNION ALL SELECT lang, 'phoneme', 128 * {POSITIONS} + 16 + CAST('0x' || unnest(regexp_extract_all(hex(encode(ch)), '..')) AS INTEGER) * {POSITIONS} + pos FROM ch WHERE cp NOT BETWEEN 2304 AND 3455
 UNION ALL SELECT lang, 'factored', idx % ceil(sqrt(v))::BIGINT FROM w UNION ALL SELECT lang, 'factored', ceil(sqrt(v))::BIGINT + idx // ceil(sqrt(v))::BIGINT FROM w)"""


@query(f"WITH {WORD_COUNTS_SQL}, {CELLS_SQL} SELECT lang, kind, count(*)::BIGINT AS used, count(DISTINCT cell)::BIGINT AS different FROM x GROUP BY lang, kind")
def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every word under four codes: bytes by place; blocks and offsets of code points by place; sounds shared by related scripts, with the script apart; and digits of the word's number."""
    words = word_counts(spark, sf_dir).select("lang", "word")
    numbered = row_numbers(words, "lang", ["word"], "place", F.coalesce(F.ascii("word"), F.lit(0)))
    base = F.ceil(F.sqrt("v"))
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))  # a row a language
    digits = numbered.join(F.broadcast(sizes), "lang").withColumn("idx", F.col("place") - 1)
    factored = digits.select("lang", F.lit("factored").alias("kind"), F.explode(F.array(F.col("idx") % base, base + F.floor(F.col("idx") / base))).alias("cell"))

    hexes = lambda c: F.filter(F.split(F.hex(F.encode(c, "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    number = lambda h: F.conv(h, 16, 10).cast("long")
    point = lambda c: number(F.hex(F.encode(c, "UTF-32")))
    byte = words.select("lang", F.posexplode(F.slice(hexes(F.col("word")), 1, POSITIONS)).alias("pos", "h")).select("lang", F.lit("byte").alias("kind"), (number(F.col("h")) * POSITIONS + F.col("pos")).alias("cell"))
    chars = words.select("lang", F.posexplode(F.slice(F.filter(F.split("word", ""), lambda c: c != ""), 1, POSITIONS)).alias("pos", "ch")).withColumn("cp", point(F.col("ch")))
    cp, pos = F.col("cp"), F.col("pos")
    offset = cp.bitwiseAND(F.lit(127))
    char = chars.select("lang", F.lit("char").alias("kind"), F.explode(F.array(F.shiftright(cp, 7) * POSITIONS + pos, (8706 + offset) * POSITIONS + pos)).alias("cell"))
    shared = F.array(offset * POSITIONS + pos, F.lit(128 * POSITIONS).cast("long") + F.shiftright(cp - 2304, 7))
    other = F.transform(hexes(F.col("ch")), lambda h: 128 * POSITIONS + 16 + number(h) * POSITIONS + pos)
    phoneme = chars.select("lang", F.lit("phoneme").alias("kind"), F.explode(F.when(cp.between(2304, 3455), shared).otherwise(other)).alias("cell"))
    cells = byte.unionByName(char).unionByName(phoneme).unionByName(factored)
    return cells.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("used"), F.count_distinct("cell").alias("different"))


@query(
    """WITH f AS (SELECT l_orderkey, min(l_shipdate) AS shipped, arg_min(l_linestatus, (l_shipdate, l_linenumber)) AS class_ FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderpriority, o_orderkey, class_, date_diff('day', o_orderdate, shipped) AS lag FROM orders JOIN f ON l_orderkey = o_orderkey WHERE class_ <> 'F' AND shipped IS NOT NULL)
SELECT o_orderpriority, place::BIGINT AS place, o_orderkey, class_ AS adoption_class, lag::BIGINT AS lag FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY lag DESC, o_orderkey) AS place FROM r) WHERE place <= 25"""
)
def lag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest lags from order to first shipment in each group, without the excluded class and without what never shipped: a report of twenty-five a group.

    The first twenty-five of a group are found in each task before anything is shuffled.
    """
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"), F.min_by("l_linestatus", F.struct("l_shipdate", "l_linenumber")).alias("adoption_class"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    lag = F.date_diff(F.col("shipped").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    r = o.join(first, F.col("o_orderkey") == F.col("l_orderkey")).where("adoption_class <> 'F' and shipped is not null").withColumn("lag", lag)
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("lag"), "o_orderkey"))
    return r.withColumn("place", place.cast("long")).where("place <= 25").select("o_orderpriority", "place", "o_orderkey", "adoption_class", "lag")


def reloaded(spark: SparkSession, path: str) -> DataFrame:
    """A ledger from its JSON lines, which may stand in any order and file: its entries, and whether each follows from the one before."""
    lines = json_lines(spark, path, "user_id long, ledger_offset long, payload string, prev_hash string, entry_hash string")
    w = Window.partitionBy("user_id").orderBy("ledger_offset")
    follows: Column = F.col("prev_hash") == F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))
    follows &= F.col("ledger_offset") == F.coalesce(F.lag("ledger_offset").over(w) + 1, F.lit(0))
    return lines.withColumn("sound", follows & (F.sha2(F.concat("payload", "prev_hash"), 256) == F.col("entry_hash")))


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT user_id, count(*)::BIGINT AS entries, arg_max(entry_hash, step) AS head, TRUE AS sound FROM c GROUP BY user_id")
def ledger_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's ledger written as JSON lines, read back in the order of its offsets, and verified from what was read."""
    s = steps(spark, sf_dir).withColumn("payload", payload()).withColumn("step", F.col("step").cast("long"))
    ledger = chained(s, "user_id", "step", "payload").join(s.select("user_id", "step", "payload"), ["user_id", "step"]).withColumnRenamed("step", "ledger_offset")
    folder = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    sinks.json_lines(ledger, folder, "ledger_offset")
    return reloaded(spark, folder).groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.max_by("entry_hash", "ledger_offset").alias("head"), F.bool_and("sound").alias("sound"))
