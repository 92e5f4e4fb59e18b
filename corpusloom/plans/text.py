"""Cleaning, screens and text measures over documents, pages and conversations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.functions.arrow_bytes import SPACE, WindowHash, buffers, per_row, slices, spans
from corpusloom.plans.registry import query
from corpusloom.sources.tables import table

EMAIL, PHONE_IN, STREET = (p for _, p in fx.PII_PATTERNS)


def clean_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    return rf"trim(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


def redact_sql(x: str) -> str:
    for kind, pattern in fx.PII_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '<redacted:{kind}>', 'g')"
    return x


def words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[\t\n\x0B\f\r ]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, length(c) AS n_clean, sha256(c) AS clean_sha FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", fx.clean_text("text").alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n_clean"), F.sha2("c", 256).alias("clean_sha"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '{EMAIL}') THEN 'email' END,
 CASE WHEN regexp_matches(text, '{PHONE_IN}') THEN 'phone_in' END, CASE WHEN regexp_matches(text, '{STREET}') THEN 'street_address' END], lambda k: k IS NOT NULL), ',') AS kinds,
 sha256({redact_sql('text')}) AS redacted_sha FROM documents"""
)
def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(fx.pii_kinds(text), ",").alias("kinds"), F.sha2(fx.redact_pii(text), 256).alias("redacted_sha")
    )


@query(
    f"""SELECT source, sum(len(regexp_extract_all(text, '{EMAIL}')))::BIGINT AS emails, sum(len(regexp_extract_all(text, '{fx.URL}')))::BIGINT AS urls,
 sum(len(regexp_extract_all(regexp_replace(regexp_replace(text, '{fx.URL}', '[URL]', 'g'), '{EMAIL}', '[EMAIL]', 'g'), '{fx.PHONE}')))::BIGINT AS phones
 FROM documents GROUP BY source"""
)
def typed_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "documents").select("source", fx.typed_redaction(F.col("text")).alias("t"), "text")
    count = lambda mark: F.sum(F.regexp_count("t", F.lit(rf"\[{mark}\]")) - F.regexp_count("text", F.lit(rf"\[{mark}\]"))).cast("long")
    return marked.groupBy("source").agg(count("EMAIL").alias("emails"), count("URL").alias("urls"), count("PHONE").alias("phones"))


@query(
    rf"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, {words_sql('text')} AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_words,
 round(length(regexp_replace(text, '[A-Za-z0-9\s]', '', 'g')) / greatest(length(text), 1), 4) AS symbol_ratio,
 round(1 - len(list_distinct(lines)) / len(lines), 4) AS duplicate_lines,
 round(len(list_filter(lines, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) <= 3)) / len(lines), 4) AS short_lines
FROM l"""
)
def quality_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"), fx.words("text").alias("w"))
    n = F.size("lines")
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.round(F.length(F.regexp_replace("text", r"[A-Za-z0-9\s]", "")) / F.greatest(F.length("text"), F.lit(1)), 4).alias("symbol_ratio"),
        F.round(1 - F.size(F.array_distinct("lines")) / n, 4).alias("duplicate_lines"),
        F.round(F.size(F.filter("lines", lambda x: F.size(fx.words(x)) <= 3)) / n, 4).alias("short_lines"),
    )


@query(
    """WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS place FROM l)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE place = 1)::BIGINT AS kept_lines,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE place = 1), '')) AS kept_sha FROM f GROUP BY doc_id"""
)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each line in the corpus stays.

    The first place is a partial aggregate, so a very common line is one row per task in the shuffle;
    a document keeps the lines whose first place it holds.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    first = lines.groupBy("line").agg(F.min(F.struct("doc_id", "at")).alias("first")).select("first.*", "line")
    kept = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("kept"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return docs.join(kept, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("kept_lines"),
        F.sha2(F.coalesce(F.array_join("kept.line", "\n"), F.lit("")), 256).alias("kept_sha"),
    )


@query(
    r"""SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '<\|im_start\|>\s*(user|assistant|system)\s*', '<|\1|> ', 'g'), '\s*<\|im_end\|>', '', 'g'),
 '\[(USER|INST)\]\s*', '<|user|> ', 'g'), '\[(ASSISTANT|/INST)\]\s*', '<|assistant|> ', 'g')) AS unified_sha
 FROM (SELECT conv_id, turn, '[' || upper(role) || '] ' || text AS m FROM conversations)"""
)
def chat_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(fx.unified_markers(marked), 256).alias("unified_sha"))


@query(
    r"""SELECT page_id, length(s)::BIGINT AS n_chars, sha256(s) AS stripped_sha FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM pages)"""
)
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "pages").select("page_id", fx.tag_stripped(F.col("html")).alias("s"))
    return s.select("page_id", F.length("s").cast("long").alias("n_chars"), F.sha2("s", 256).alias("stripped_sha"))


@query(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(*)::BIGINT AS n_links, count(DISTINCT page_id)::BIGINT AS n_pages FROM l WHERE href NOT IN (SELECT DISTINCT '/' || split_part(url, '/', 4) FROM pages WHERE url IS NOT NULL) GROUP BY href"""
)
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that no page of the table answers to: an anti join."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = pages.where("url is not null").select(F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("href")).distinct()
    return links.join(known, "href", "left_anti").groupBy("href").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


@query(
    r"""SELECT doc_id, CASE WHEN n = 0 THEN TRUE ELSE l / n >= 0.5 END AS latin_valid, n::BIGINT AS n_letters FROM (SELECT doc_id,
 length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(regexp_replace(text, '[^\p{L}]', '', 'g'), '[^\x{0000}-\x{024F}]', '', 'g')) AS l FROM documents)"""
)
def script_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.length(letters).alias("n"), F.length(F.regexp_replace(letters, r"[^\x{0000}-\x{024F}]", "")).alias("l"))
    return d.select("doc_id", F.when(F.col("n") == 0, True).otherwise(F.col("l") / F.col("n") >= 0.5).alias("latin_valid"), F.col("n").cast("long").alias("n_letters"))


@query(
    r"""SELECT lang, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars,
 round(sum(octet_length(encode(text)) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / sum(octet_length(encode(text))), 4) AS multibyte_share
 FROM documents GROUP BY lang"""
)
def multibyte_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_chars = F.length(F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.sum(F.octet_length("text")).alias("n_bytes"),
        F.sum(F.length("text")).alias("n_chars"),
        F.round(F.sum(F.octet_length("text") - ascii_chars) / F.sum(F.octet_length("text")), 4).alias("multibyte_share"),
    )


@query(
    rf"""WITH w AS (SELECT lang, regexp_replace(x, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g') AS word FROM (SELECT lang, unnest({words_sql('text')}) AS x FROM documents)),
a AS (SELECT lang, count(*)::BIGINT AS n_words, sum(octet_length(encode(word))) / count(*) AS bpw, sum(ceil(octet_length(encode(word)) / 31.0)) / count(*) AS floor31,
 count(*) FILTER (WHERE octet_length(encode(word)) > 31) / count(*) AS over31 FROM w WHERE word <> '' GROUP BY lang)
SELECT a.lang, a.n_words, round(a.bpw, 4) AS bytes_per_word, round(a.bpw / e.bpw, 4) AS ratio_to_english, round(a.floor31, 4) AS fertility_floor, round(a.over31, 6) AS share_over_31 FROM a CROSS JOIN (SELECT bpw FROM a WHERE lang = 'en') e"""
)
def byte_cost_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(fx.words("text")).alias("x"))
    size = F.octet_length("word")
    a = (
        words.select("lang", fx.trimmed_word(F.col("x")).alias("word"))
        .where("word <> ''")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n_words"), F.avg(size).alias("bpw"), F.avg(F.ceil(size / 31)).alias("floor31"), F.avg((size > 31).cast("int")).alias("over31"))
    )
    english = a.where("lang = 'en'").select(F.col("bpw").alias("en"))  # one row
    return a.crossJoin(F.broadcast(english)).select(
        "lang",
        "n_words",
        F.round("bpw", 4).alias("bytes_per_word"),
        F.round(F.col("bpw") / F.col("en"), 4).alias("ratio_to_english"),
        F.round("floor31", 4).alias("fertility_floor"),
        F.round("over31", 6).alias("share_over_31"),
    )


@query(
    """SELECT lang, count(*)::BIGINT AS n_docs, sum(n_chars)::BIGINT AS n_chars, round(avg(n_chars), 4) AS mean_chars, median(n_chars) AS median_chars,
 max(n_chars)::BIGINT AS max_chars, list_sort(list(n_chars))[CAST(floor(0.9 * count(*)) AS INTEGER) + 1]::BIGINT AS p90_chars FROM documents GROUP BY lang"""
)
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, maximum and the value at nine tenths of the sorted list, which is not interpolated.

    Documents of one length are one row before anything is sorted, so the order goes over lengths.
    """
    k = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("k")).where("n_chars is not null")
    of = Window.partitionBy("lang")
    ranked = k.withColumns({"upto": F.sum("k").over(of.orderBy("n_chars")), "n": F.sum("k").over(of)})
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("n_chars")))  # noqa: E731  the value at a place of the sorted list, from one
    n = F.col("n")
    return ranked.groupBy("lang").agg(
        F.first("n").alias("n_docs"),
        F.sum(F.col("k") * F.col("n_chars")).alias("n_chars"),
        F.round(F.sum(F.col("k") * F.col("n_chars")) / F.first("n"), 4).alias("mean_chars"),
        ((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2).alias("median_chars"),
        F.max("n_chars").alias("max_chars"),
        at(F.floor(n * 0.9) + 1).alias("p90_chars"),
    )


@query(
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS place FROM c)
SELECT CASE WHEN place <= 12 THEN source ELSE 'other' END AS bucket, sum(n)::BIGINT AS n_docs FROM r GROUP BY 1"""
)
def top_twelve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").count()
    ranked = counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "source")))  # one row per source
    return ranked.groupBy(F.when(F.col("place") <= 12, F.col("source")).otherwise("other").alias("bucket")).agg(F.sum("count").alias("n_docs"))


@query(
    rf"""SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$')))::BIGINT AS n_numbers,
 coalesce(list_sum(list_transform(regexp_extract_all(text, '([0-9]{{1,9}}) (?:times|items|words)', 1), lambda x: CAST(x AS BIGINT))), 0)::BIGINT AS stated_total
 FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents)"""
)
def stated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.regexp_extract_all("text", F.lit(r"([0-9]{1,9}) (?:times|items|words)"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(F.filter(fx.words("text"), lambda x: x.rlike(r"^[0-9]+$"))).cast("long").alias("n_numbers"),
        F.aggregate(stated, F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("stated_total"),
    )


def longest_repeat(codes: np.ndarray, largest: int = fx.REPEAT_LARGEST) -> tuple[int, int, int]:
    """Longest run of an n-gram repeated back to back, for n up to ``largest``: (run, n, start); equal words have equal codes.

    Words that equal the word n places on form stretches; a stretch of r of them holds r // n + 1
    copies. The longest run counts, then the smallest n, then the earliest start.
    """
    if len(codes) < 2:
        return 0, 0, -1
    best = (1, 1, 0)
    for n in range(1, min(largest, len(codes) // 2) + 1):
        equal = codes[n:] == codes[:-n]
        if not equal.any():
            continue
        same = np.concatenate(([False], equal, [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        run = sizes // n + 1
        if run.max() > best[0]:
            best = (int(run.max()), n, int(starts[run.argmax()]))
    return best


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = buffers(part.column("text"))
            starts, ends = spans(~SPACE[data], offsets)
            bounds = per_row(starts, offsets)
            codes = WindowHash(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
            rows = [longest_repeat(codes[low:high]) for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
            run, n, start = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
            flagged = pa.array([r[0] >= fx.REPEAT_RUN for r in rows], pa.bool_())
            yield pa.record_batch([part.column("doc_id"), run, n, start, flagged], names=["doc_id", "run", "n", "start", "flagged"])


@query(
    rf"""WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS len, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
q AS (SELECT p.doc_id, n, pos, word = lead(word, n) OVER (PARTITION BY doc_id, n ORDER BY pos) AS same FROM p CROSS JOIN (SELECT unnest(range(1, 14)) AS n) WHERE p.len >= 2 * n),
g AS (SELECT doc_id, n, pos, pos - row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS island FROM q WHERE same),
r AS (SELECT doc_id, n, min(pos) - 1 AS start, count(*) // n + 1 AS run FROM g GROUP BY doc_id, n, island),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run DESC, n, start) AS place FROM r WHERE run > 1)
SELECT d.doc_id, CASE WHEN len(w) < 2 THEN 0 ELSE coalesce(run, 1) END::BIGINT AS run, CASE WHEN len(w) < 2 THEN 0 ELSE coalesce(n, 1) END::BIGINT AS n,
 CASE WHEN len(w) < 2 THEN -1 ELSE coalesce(start, 0) END::BIGINT AS start, coalesce(run, 0) >= 32 AS flagged FROM d LEFT JOIN (SELECT * FROM b WHERE place = 1) b ON b.doc_id = d.doc_id"""
)
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_repeats, "doc_id long, run long, n long, start long, flagged boolean")


@query(
    rf"""WITH s AS (SELECT 1 AS stage, 'all' AS name, count(*)::BIGINT AS docs, sum(len({words_sql('text')}))::BIGINT AS words FROM documents
UNION ALL SELECT 2, 'twenty words', count(*)::BIGINT, sum(len(w))::BIGINT FROM (SELECT {words_sql('text')} AS w FROM documents) WHERE len(w) >= 20
UNION ALL SELECT 3, 'two hundred characters', count(*)::BIGINT, sum(len(w))::BIGINT FROM (SELECT {words_sql('text')} AS w, text FROM documents) WHERE len(w) >= 20 AND length(trim(text)) >= 200)
SELECT stage, name, docs, words FROM s"""
)
def corpus_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words after each filter, from one scan: later stages are conditions of one aggregate."""
    d = table(spark, sf_dir, "documents").select(F.size(fx.words("text")).cast("long").alias("w"), F.length(F.trim("text")).alias("n"))
    two = F.col("w") >= 20
    three = two & (F.col("n") >= 200)
    one = d.agg(
        F.count(F.lit(1)).alias("d1"), F.sum("w").alias("w1"), F.count_if(two).alias("d2"), F.sum(F.when(two, F.col("w"))).alias("w2"), F.count_if(three).alias("d3"), F.sum(F.when(three, F.col("w"))).alias("w3")
    )
    return one.selectExpr("stack(3, 1, 'all', d1, w1, 2, 'twenty words', d2, w2, 3, 'two hundred characters', d3, w3) as (stage, name, docs, words)")
