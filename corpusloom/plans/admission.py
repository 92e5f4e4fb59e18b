"""Admission of documents and shards, with every reason that speaks against one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import grams as fg
from corpusloom.functions import text as fx
from corpusloom.plans.registry import query
from corpusloom.plans.similarity import CLEANED_SQL, grams_sql
from corpusloom.plans.text import words_sql
from corpusloom.sources.store import materialize
from corpusloom.sources.tables import table

#: Manifest fields that must be known, and what counts as unknown.
HARD_FIELDS = ("tokenizer_hash", "cleaning_pipeline_hash", "dedup_status", "pii_screen_status", "eval_overlap_status", "repeat_ngram_status")
UNKNOWN = ("", "missing", "unknown", "blocked_or_unknown")
#: Texts with copies that are sent to all tasks, at most; a hundred bytes each.
COPIES_SENT = 1_000_000


def reasons(**conditions: Column) -> Column:
    """Sorted names of the conditions that hold; a condition that is not known does not hold."""
    return F.array_compact(F.array(*(F.when(conditions[k], F.lit(k)) for k in sorted(conditions))))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_words and the reasons against admission; a null text is the empty one.

    Each text is cleaned once: what is asked of it, the benchmark's runs of words too, is answered in
    the same scan. A copy's first document is found by a partial aggregate over digests.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", fx.redact_pii(fx.clean_text(F.coalesce("text", F.lit("")))).alias("text"))
    facts = docs.select(
        "doc_id", "source", F.sha2("text", 256).alias("digest"), F.size(fx.words("text")).alias("n_words"), (F.size(fx.pii_kinds(F.col("text"))) > 0).alias("pii"), F.lower("text").alias("text")
    )
    items = fg.postings(table(spark, sf_dir, "benchmark"), "item_id", "text", fx.CONTAINMENT_WORDS, False)
    facts = fg.flagged(facts, "text", items, fx.CONTAINMENT_WORDS, "leak", "doc_id").drop("text")
    facts = materialize(facts, "screened")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = materialize(first, "copies")
    # A text that very many rows have is one row here; where these are few, they go to where the rows are.
    joined = facts.join(F.broadcast(first) if first.count() <= COPIES_SENT else first, "digest", "left")
    against = reasons(
        duplicate=F.col("doc_id") != F.col("first_id"), eval_overlap=F.col("leak"), personal_data=F.col("pii"), too_short=F.col("n_words") < 20
    )
    return joined.select("doc_id", "source", "n_words", against.alias("reasons"))


SCREENED_SQL = f"""d AS ({CLEANED_SQL}), i AS ({grams_sql('benchmark', 'item_id', 13, False)}), g AS ({grams_sql('d', 'doc_id', 13, False)}),
leaked AS (SELECT DISTINCT g.id FROM g WHERE g.gram IN (SELECT gram FROM i)),
f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id, len({words_sql('text')}) AS n_words,
  regexp_matches(text, '{fx.PII_PATTERNS[0][1]}') OR regexp_matches(text, '{fx.PII_PATTERNS[1][1]}') OR regexp_matches(text, '{fx.PII_PATTERNS[2][1]}') AS pii FROM d),
s AS (SELECT f.doc_id, x.source, n_words, list_filter([CASE WHEN f.doc_id <> first_id THEN 'duplicate' END, CASE WHEN f.doc_id IN (SELECT id FROM leaked) THEN 'eval_overlap' END,
  CASE WHEN pii THEN 'personal_data' END, CASE WHEN n_words < 20 THEN 'too_short' END], lambda r: r IS NOT NULL) AS reasons FROM f JOIN documents x ON x.doc_id = f.doc_id)"""


@query(f"WITH {SCREENED_SQL} SELECT CASE WHEN len(reasons) = 0 THEN 'admitted' ELSE array_to_string(reasons, '+') END AS decision, count(*)::BIGINT AS n_docs, sum(n_words)::BIGINT AS n_words FROM s GROUP BY 1")
def admission_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.size("reasons") == 0, "admitted").otherwise(F.array_join("reasons", "+"))
    return screened(spark, sf_dir).groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


@query(f"WITH {SCREENED_SQL} SELECT doc_id, len(reasons) = 0 AS admitted, array_to_string(reasons, ',') AS reasons FROM s")
def document_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).select("doc_id", (F.size("reasons") == 0).alias("admitted"), F.array_join("reasons", ",").alias("reasons"))


GATES = ("duplicate", "eval_overlap", "personal_data", "too_short")


@query(
    f"""WITH {SCREENED_SQL}, gates(gate) AS (VALUES {', '.join(f"('{g}')" for g in GATES)})
SELECT gate, count(*) FILTER (WHERE list_contains(reasons, gate))::BIGINT AS stopped, count(*) FILTER (WHERE len(reasons) = 1 AND list_contains(reasons, gate))::BIGINT AS stopped_by_it_alone FROM s CROSS JOIN gates GROUP BY gate"""
)
def gate_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each gate stops, and what would pass if it alone were switched off; an explode of the reasons, beside the list of gates."""
    gates = spark.createDataFrame([(g,) for g in GATES], "gate string")
    stopped = screened(spark, sf_dir).select(F.explode("reasons").alias("gate"), (F.size("reasons") == 1).alias("alone")).groupBy("gate").agg(
        F.count(F.lit(1)).alias("stopped"), F.count_if("alone").alias("stopped_by_it_alone")
    )
    return gates.join(stopped, "gate", "left").na.fill(0)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per shard (a source): the worst status of its members, and its roll-ups."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    m = screened(spark, sf_dir).join(docs, "doc_id").groupBy(F.col("source").alias("shard_id"))
    has = lambda r: F.bool_or(F.array_contains("reasons", r))
    return m.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_words").alias("token_count"),
        F.when(has("duplicate"), "contains_duplicates").otherwise("unique").alias("dedup_status"),
        F.when(has("eval_overlap"), "blocked_or_unknown").otherwise("clear").alias("eval_overlap_status"),
        F.when(has("personal_data"), "found").otherwise("clean").alias("pii_screen_status"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
        F.sha2(F.array_join(F.array_sort(F.collect_set("digest")), ""), 256).alias("content_hash"),
    )


MANIFEST_SQL = """m AS (SELECT s.source AS shard_id, count(*)::BIGINT AS n_docs, sum(n_words)::BIGINT AS token_count,
 CASE WHEN bool_or(list_contains(reasons, 'duplicate')) THEN 'contains_duplicates' ELSE 'unique' END AS dedup_status,
 CASE WHEN bool_or(list_contains(reasons, 'eval_overlap')) THEN 'blocked_or_unknown' ELSE 'clear' END AS eval_overlap_status,
 CASE WHEN bool_or(list_contains(reasons, 'personal_data')) THEN 'found' ELSE 'clean' END AS pii_screen_status,
 string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, sha256(string_agg(DISTINCT sha256(coalesce(text, '')), '' ORDER BY sha256(coalesce(text, '')))) AS content_hash
 FROM s JOIN documents x ON x.doc_id = s.doc_id GROUP BY s.source)"""


@query(f"WITH {SCREENED_SQL}, {MANIFEST_SQL} SELECT * FROM m")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir)


#: Statuses that block, by field.
BLOCKING = {
    "dedup_status": ("contains_duplicates", "exact_duplicate"),
    "pii_screen_status": ("missing", "found"),
    "eval_overlap_status": ("blocked_or_unknown", "overlap"),
    "repeat_ngram_status": ("contains_repeats",),
    "license_tier": ("unsafe",),
}


def blockers(fields: DataFrame) -> Column:
    """Why a manifest is refused: hard fields that are missing, also from the table as a whole, or unknown, and values that block."""
    absent = {f"missing_or_unsafe:{f}": F.coalesce(F.col(f).isin(*UNKNOWN), F.lit(True)) if f in fields.columns else F.lit(True) for f in HARD_FIELDS}
    values = {f"{f}={v}": F.col(f) == v for f, vs in BLOCKING.items() if f in fields.columns for v in vs}
    return reasons(**absent, **values)


@query(
    f"""WITH {SCREENED_SQL}, {MANIFEST_SQL}, p AS (SELECT *, CASE WHEN n_docs % 2 = 0 THEN 'hash-1' ELSE 'unknown' END AS tokenizer_hash, CASE WHEN n_docs % 3 = 0 THEN 'contains_repeats' ELSE 'screened' END AS repeat_ngram_status, CASE WHEN n_docs % 5 = 0 THEN 'unsafe' ELSE 'safe' END AS license_tier FROM m)
SELECT shard_id, array_to_string(list_sort(list_filter([CASE WHEN dedup_status = 'contains_duplicates' THEN 'dedup_status=contains_duplicates' END,
 CASE WHEN pii_screen_status = 'found' THEN 'pii_screen_status=found' END, CASE WHEN eval_overlap_status = 'blocked_or_unknown' THEN 'eval_overlap_status=blocked_or_unknown' END,
 CASE WHEN repeat_ngram_status = 'contains_repeats' THEN 'repeat_ngram_status=contains_repeats' END, CASE WHEN license_tier = 'unsafe' THEN 'license_tier=unsafe' END,
 CASE WHEN eval_overlap_status = 'blocked_or_unknown' THEN 'missing_or_unsafe:eval_overlap_status' END, CASE WHEN tokenizer_hash = 'unknown' THEN 'missing_or_unsafe:tokenizer_hash' END,
 'missing_or_unsafe:cleaning_pipeline_hash'], lambda r: r IS NOT NULL)), ',') AS blockers FROM p"""
)
def shard_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard gate over the manifest. The manifest of the fixture has no pipeline hash, and a hard field that is not there blocks."""
    n = F.col("n_docs")
    p = manifest(spark, sf_dir).withColumns(
        {"tokenizer_hash": F.when(n % 2 == 0, "hash-1").otherwise("unknown"), "repeat_ngram_status": F.when(n % 3 == 0, "contains_repeats").otherwise("screened"), "license_tier": F.when(n % 5 == 0, "unsafe").otherwise("safe")}
    )
    return p.select("shard_id", F.array_join(blockers(p), ",").alias("blockers"))


STAGES = (("warm", 0, 1500, 200, "B0,B1"), ("main", 1500, 6000, 800, "B1,B2"), ("anneal", 6000, 10000, 10**9, "B2,B3"))


@query(
    f"""WITH st(stage, t0, t1, win, bands) AS (VALUES {', '.join(map(str, STAGES))}),
d AS (SELECT doc_id, source, n_chars, CASE WHEN n_chars < 500 THEN 'B0' WHEN n_chars < 1500 THEN 'B1' WHEN n_chars < 5000 THEN 'B2' ELSE 'B3' END AS band FROM documents)
SELECT source, stage, bool_or(list_contains(string_split(bands, ','), band)) AS eligible, count(*) FILTER (WHERE list_contains(string_split(bands, ','), band) AND n_chars <= win)::BIGINT AS n_fit FROM d CROSS JOIN st GROUP BY source, stage"""
)
def stage_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages a shard's difficulty bands allow, and how many of its documents fit the stage's window."""
    stages = spark.createDataFrame(STAGES, "stage string, t0 long, t1 long, win long, bands string")
    n = F.col("n_chars")
    band = F.when(n < 500, "B0").when(n < 1500, "B1").when(n < 5000, "B2").otherwise("B3")
    allowed = F.array_contains(F.split("bands", ","), F.col("band"))
    d = table(spark, sf_dir, "documents").select("source", "n_chars", band.alias("band")).crossJoin(F.broadcast(stages))  # the plan's three stages
    return d.groupBy("source", "stage").agg(F.bool_or(allowed).alias("eligible"), F.count_if(allowed & (n <= F.col("win"))).alias("n_fit"))


def requirement(name: str, ok: Column, shown: Column) -> Column:
    return F.struct(F.lit(name).alias("requirement"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), shown.cast("string").alias("shown"))


@query(
    f"""WITH {SCREENED_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE len(reasons) = 0) AS k, count(DISTINCT doc_id) AS u FROM s)
SELECT 'every document decided once' AS requirement, CASE WHEN n = u THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS VARCHAR) AS shown FROM c
UNION ALL SELECT 'something is admitted', CASE WHEN k > 0 THEN 'PASS' ELSE 'FAIL' END, CAST(k AS VARCHAR) FROM c
UNION ALL SELECT 'something is stopped', CASE WHEN k < n THEN 'PASS' ELSE 'FAIL' END, CAST(n - k AS VARCHAR) FROM c"""
)
def admission_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = screened(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("reasons") == 0).alias("k"), F.count_distinct("doc_id").alias("u"))
    n, k, u = F.col("n"), F.col("k"), F.col("u")
    rows = F.array(requirement("every document decided once", n == u, n), requirement("something is admitted", k > 0, k), requirement("something is stopped", k < n, n - k))
    return c.select(F.inline(rows))
