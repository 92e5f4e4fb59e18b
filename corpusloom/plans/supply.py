"""Supply planning: usable supply, overlaps of tags, sweeps, staging by row and column totals, and costs across languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.plans.registry import query
from corpusloom.plans.text import words_sql
from corpusloom.sources.tables import table

#: Supply of a language: labelled good documents are verified, unlabelled ones are not, bad ones are gone; half of a copy counts.
SUPPLY_SQL = """s AS (SELECT d.lang, count(*) FILTER (WHERE l.quality = 1)::BIGINT AS verified, count(*) FILTER (WHERE l.quality IS NULL)::BIGINT AS unverified, count(*) FILTER (WHERE l.toxic = 1)::BIGINT AS synthetic,
 sum(d.n_chars)::BIGINT AS chars, sum(octet_length(encode(d.text)))::BIGINT AS bytes FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang)"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return d.groupBy("lang").agg(
        F.count_if(F.col("quality") == 1).alias("verified"),
        F.count_if(F.col("quality").isNull()).alias("unverified"),
        F.count_if(F.col("toxic") == 1).alias("synthetic"),
        F.sum("n_chars").alias("chars"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )


@query(f"WITH {SUPPLY_SQL} SELECT lang, verified + unverified + 0.5 * synthetic AS usable, round(bytes / chars, 4) AS bytes_per_char FROM s")
def usable_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).select("lang", (F.col("verified") + F.col("unverified") + 0.5 * F.col("synthetic")).alias("usable"), F.round(F.col("bytes") / F.col("chars"), 4).alias("bytes_per_char"))


@query(
    f"""WITH {SUPPLY_SQL}, t AS (SELECT lang, verified AS before, (verified + unverified)::BIGINT AS after FROM s)
SELECT lang, before, after, round(after / nullif(before, 0), 4) AS uplift, 4 * after AS most_at_four_epochs FROM t
UNION ALL SELECT 'total', sum(before)::BIGINT, sum(after)::BIGINT, round(sum(after) / nullif(sum(before), 0), 4), (4 * sum(after))::BIGINT FROM t"""
)
def tail_remeasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply after the second measurement, with a total row."""
    s = supply(spark, sf_dir).select("lang", F.col("verified").alias("before"), (F.col("verified") + F.col("unverified")).alias("after"))
    total = s.agg(F.lit("total").alias("lang"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    both = s.unionByName(total)
    return both.select("lang", "before", "after", F.round(F.col("after") / F.nullif("before", F.lit(0)), 4).alias("uplift"), (4 * F.col("after")).alias("most_at_four_epochs"))


@query(
    """WITH t AS (SELECT doc_id, 'lang:' || lang AS tag FROM documents UNION ALL SELECT doc_id, 'source:' || source FROM documents UNION ALL SELECT doc_id, 'size:' || CASE WHEN n_chars < 1500 THEN 'short' ELSE 'long' END FROM documents),
n AS (SELECT tag, count(*)::BIGINT AS supply FROM t GROUP BY tag), p AS (SELECT a.tag AS a, b.tag AS b, count(*)::BIGINT AS shared FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.tag < b.tag GROUP BY 1, 2)
SELECT p.a, p.b, shared, least(x.supply, y.supply)::BIGINT AS smaller, round(shared / least(x.supply, y.supply), 6) AS overlap FROM p JOIN n x ON x.tag = p.a JOIN n y ON y.tag = p.b"""
)
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that two tags share, against the smaller supply. A document's own three tags make its pairs, so nothing is joined by document."""
    d = table(spark, sf_dir, "documents")
    tags = F.array_sort(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("size:"), F.when(F.col("n_chars") < 1500, "short").otherwise("long"))))
    t = d.select(tags.alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    supply = t.select(F.explode("t").alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("supply"))
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    shared = t.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("shared"))
    side = lambda x: supply.select(F.col("tag").alias(x), F.col("supply").alias(f"supply_{x}"))
    both = shared.join(side("a"), "a").join(side("b"), "b").withColumn("smaller", F.least("supply_a", "supply_b"))
    return both.select("a", "b", "shared", "smaller", F.round(F.col("shared") / F.col("smaller"), 6).alias("overlap"))


#: Exponents of a sweep, and slots to share out.
ALPHAS, SLOTS = (0.0, 0.25, 0.5, 0.75, 1.0), 10_000


@query(
    f"""WITH {SUPPLY_SQL}, a(alpha) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in ALPHAS)}), w AS (SELECT alpha, lang, pow(verified + unverified, alpha) * (bytes / chars) AS w, 4 * (verified + unverified) AS cap FROM s CROSS JOIN a)
SELECT alpha, lang, round({SLOTS} * w / sum(w) OVER (PARTITION BY alpha), 3) AS share, {SLOTS} * w / sum(w) OVER (PARTITION BY alpha) <= cap AS within_cap FROM w"""
)
def content_weighted_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by supply to a power times bytes per character, for each power, and whether four epochs of the supply allow them."""
    a = spark.createDataFrame([(x,) for x in ALPHAS], "alpha double")
    s = supply(spark, sf_dir).withColumn("n", F.col("verified") + F.col("unverified"))
    w = s.crossJoin(F.broadcast(a)).withColumn("w", F.pow("n", "alpha") * (F.col("bytes") / F.col("chars")))  # languages by five powers
    total = w.groupBy("alpha").agg(F.sum("w").alias("total"))
    share = SLOTS * F.col("w") / F.col("total")
    return w.join(F.broadcast(total), "alpha").select("alpha", "lang", F.round(share, 3).alias("share"), (share <= 4 * F.col("n")).alias("within_cap"))


@query(
    f"""WITH {SUPPLY_SQL}, a(alpha) AS (VALUES {', '.join(f'({x / 20}::DOUBLE)' for x in range(21))}), w AS (SELECT alpha, lang, pow(verified + unverified, alpha) AS w, verified + unverified AS n FROM s CROSS JOIN a),
r AS (SELECT alpha, lang, w / sum(w) OVER (PARTITION BY alpha) / (n / sum(n) OVER (PARTITION BY alpha)) AS epochs FROM w), m AS (SELECT alpha, round(max(epochs), 6) AS epochs, arg_max(lang, epochs) AS lang FROM r GROUP BY alpha)
SELECT alpha, lang AS weakest, epochs FROM m WHERE alpha = (SELECT max(alpha) FROM m WHERE epochs >= 1.05)"""
)
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest power at which the weakest language is still repeated at least 1.05 times as often as its share asks."""
    a = spark.createDataFrame([(x / 20,) for x in range(21)], "alpha double")
    w = supply(spark, sf_dir).select("lang", (F.col("verified") + F.col("unverified")).alias("n")).crossJoin(F.broadcast(a)).withColumn("w", F.pow("n", "alpha"))  # languages by 21 powers
    total = w.groupBy("alpha").agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    epochs = F.col("w") / F.col("tw") / (F.col("n") / F.col("tn"))
    m = w.join(F.broadcast(total), "alpha").withColumn("e", epochs).groupBy("alpha").agg(F.round(F.max("e"), 6).alias("epochs"), F.max_by("lang", "e").alias("weakest"))
    return m.where("epochs >= 1.05").orderBy(F.desc("alpha")).limit(1).select("alpha", "weakest", "epochs")


@query(
    f"""WITH {SUPPLY_SQL}, g AS (SELECT lang, greatest(600 - verified, 0)::BIGINT AS gap, chars / (verified + unverified + synthetic + 1) AS mean FROM s)
SELECT lang, gap, ceil(gap / 1.25)::BIGINT AS samples, round(gap * mean)::BIGINT AS chars_needed FROM g"""
)
def synthesis_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is short of 600 verified documents, and how many samples close the gap when every fourth makes one more."""
    s = supply(spark, sf_dir)
    g = s.select("lang", F.greatest(600 - F.col("verified"), F.lit(0)).alias("gap"), (F.col("chars") / (F.col("verified") + F.col("unverified") + F.col("synthetic") + 1)).alias("mean"))
    return g.select("lang", "gap", F.ceil(F.col("gap") / 1.25).alias("samples"), F.round(F.col("gap") * F.col("mean")).cast("long").alias("chars_needed"))


FERTILITY_SQL = f"f AS (SELECT lang, sum(len({words_sql('text')}))::BIGINT AS words, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang)"


def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(fx.words("text"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes"))


@query(f"WITH {FERTILITY_SQL} SELECT round(sum(words * (bytes / words)) / sum(words), 6) AS weighted, round(avg(bytes / words), 6) AS plain, count(*)::BIGINT AS languages FROM f")
def weighted_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes per word over all languages: weighted by words, and each language alike."""
    each = F.col("bytes") / F.col("words")
    return fertility(spark, sf_dir).agg(F.round(F.sum(F.col("words") * each) / F.sum("words"), 6).alias("weighted"), F.round(F.avg(each), 6).alias("plain"), F.count(F.lit(1)).alias("languages"))


@query(
    f"""WITH {FERTILITY_SQL}, p AS (SELECT a.lang AS from_lang, b.lang AS to_lang, a.words AS words, a.bytes / a.words AS fa, b.bytes / b.words AS fb FROM f a JOIN f b ON a.lang <> b.lang)
SELECT from_lang, to_lang, round(words * fa / 4)::BIGINT AS tokens_original, round(words * fb / 4 + words * fa / 16)::BIGINT AS tokens_translated, round((words * fb / 4 + words * fa / 16) / (words * fa / 4), 6) AS ratio FROM p"""
)
def cross_lingual_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs of a language as it is, and translated into another with a quarter of the original kept beside; four bytes make a token."""
    f = fertility(spark, sf_dir).withColumn("f", F.col("bytes") / F.col("words"))
    a, b = f.select(F.col("lang").alias("from_lang"), "words", F.col("f").alias("fa")), f.select(F.col("lang").alias("to_lang"), F.col("f").alias("fb"))
    p = a.crossJoin(F.broadcast(b)).where("from_lang <> to_lang")  # one row a language on either side
    one, two = F.col("words") * F.col("fa") / 4, F.col("words") * F.col("fb") / 4 + F.col("words") * F.col("fa") / 16
    return p.select("from_lang", "to_lang", F.round(one).cast("long").alias("tokens_original"), F.round(two).cast("long").alias("tokens_translated"), F.round(two / one, 6).alias("ratio"))


@query(
    f"""WITH {SUPPLY_SQL}, c(coverage) AS (VALUES (1.0::DOUBLE), (0.75), (0.5), (0.25)) SELECT coverage, lang, ceil(coverage * unverified)::BIGINT AS covered, round((verified + ceil(coverage * unverified)) / (verified + unverified), 6) AS share FROM s CROSS JOIN c WHERE verified + unverified > 0"""
)
def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([(1.0,), (0.75,), (0.5,), (0.25,)], "coverage double")
    covered = F.ceil(F.col("coverage") * F.col("unverified"))
    all_ = F.col("verified") + F.col("unverified")
    return supply(spark, sf_dir).crossJoin(F.broadcast(c)).where(all_ > 0).select("coverage", "lang", covered.alias("covered"), F.round((F.col("verified") + covered) / all_, 6).alias("share"))  # four coverages


@query(
    """WITH n AS (SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2), b(lang, source) AS (VALUES ('de', 'src3'), ('fr', 'nowhere')),
m AS (SELECT lang, max({'n': n, 's': source}).s AS largest FROM n GROUP BY lang)
SELECT m.lang, coalesce(k.source, m.largest) AS choice, k.source IS NOT NULL AS by_benchmark FROM m LEFT JOIN (SELECT n.lang, n.source FROM n JOIN b ON b.lang = n.lang AND b.source = n.source) k ON k.lang = m.lang"""
)
def script_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a language's variants (here its sources) the benchmark's where there is supply of it, else the largest."""
    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame([("de", "src3"), ("fr", "nowhere")], "lang string, source string")
    largest = n.groupBy("lang").agg(F.max(F.struct("n", "source"))["source"].alias("largest"))
    known = n.join(F.broadcast(asked), ["lang", "source"]).select("lang", "source")
    return largest.join(known, "lang", "left").select("lang", F.coalesce("source", "largest").alias("choice"), F.col("source").isNotNull().alias("by_benchmark"))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'reviewed' ELSE source END AS lane, source FROM documents)
SELECT lane, count(*)::BIGINT AS n, count(*) FILTER (WHERE lane <> source)::BIGINT AS moved FROM r GROUP BY lane"""
)
def relabelled_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a list of ids moves to another lane; the list is joined, whatever its length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    moves = d.where("doc_id % 50 = 7").select("doc_id", F.lit("reviewed").alias("to"))
    r = d.join(moves, "doc_id", "left").withColumn("lane", F.coalesce("to", "source"))
    return r.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lane") != F.col("source")).alias("moved"))


@query(
    f"""WITH w AS (SELECT source, regexp_matches(text, '[0-9]{{3}}') AS code, n_chars FROM documents), t AS (SELECT source AS lane, sum(n_chars) AS by_tag FROM w GROUP BY 1), c AS (SELECT CASE WHEN code THEN 'figures' ELSE source END AS lane, sum(n_chars) AS by_content FROM w GROUP BY 1)
SELECT coalesce(t.lane, c.lane) AS lane, round(coalesce(by_tag, 0) / (SELECT sum(n_chars) FROM w), 6) AS share_by_tag, round(coalesce(by_content, 0) / (SELECT sum(n_chars) FROM w), 6) AS share_by_content FROM t FULL OUTER JOIN c ON t.lane = c.lane"""
)
def mixed_or_pure_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of lanes by the tag of a document and by what it holds; one aggregate, two views of it."""
    w = table(spark, sf_dir, "documents").groupBy("source", F.col("text").rlike("[0-9]{3}").alias("code")).agg(F.sum("n_chars").alias("n"))
    t = w.groupBy(F.col("source").alias("lane")).agg(F.sum("n").alias("by_tag"))
    c = w.groupBy(F.when(F.col("code"), "figures").otherwise(F.col("source")).alias("lane")).agg(F.sum("n").alias("by_content"))
    total = w.agg(F.sum("n").alias("total"))
    share = lambda x: F.round(F.coalesce(x, F.lit(0)) / F.col("total"), 6)
    return t.join(c, "lane", "full_outer").crossJoin(F.broadcast(total)).select("lane", share("by_tag").alias("share_by_tag"), share("by_content").alias("share_by_content"))  # one row


#: Rounds of scaling of rows and columns.
ROUNDS = 40


@query(
    f"""WITH RECURSIVE n AS (SELECT lang, source, count(*)::DOUBLE AS x FROM documents GROUP BY 1, 2), k AS (SELECT count(DISTINCT lang)::DOUBLE AS r, count(DISTINCT source)::DOUBLE AS c FROM n),
m(i, lang, source, x) AS (SELECT 0, lang, source, x FROM n
 UNION ALL SELECT i + 1, lang, source, y / sum(y) OVER (PARTITION BY source) / k.c FROM (SELECT i, lang, source, x / sum(x) OVER (PARTITION BY lang) / k.r AS y FROM m, k WHERE i < {ROUNDS}), k)
SELECT lang, source, round(x, 6) AS share FROM m WHERE i = {ROUNDS}"""
)
def balanced_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of (language, source) whose rows and columns have equal totals: counts scaled in turn by row and by column.

    The table has a row for each language and source; the scaling runs where its rows meet, in one group of them.
    """
    import pandas as pd

    rounds = ROUNDS

    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="lang", columns="source", values="n").fillna(0.0)
        for _ in range(rounds):
            m = m.div(m.sum(axis=1), axis=0) / len(m.index)
            m = m.div(m.sum(axis=0), axis=1) / len(m.columns)
        out = m.stack().rename("share").reset_index()
        return pdf[["lang", "source"]].merge(out, on=["lang", "source"])

    n = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    scaled = n.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(scale, "lang string, source string, share double")
    return scaled.select("lang", "source", F.round("share", 6).alias("share"))
