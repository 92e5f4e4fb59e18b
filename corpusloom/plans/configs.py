"""Nested configurations as VARIANT values, walked to any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources.store import materialize
from corpusloom.sources.tables import table


def walk(configs: DataFrame, key: str, value: str, most: int = 1000) -> DataFrame:
    """(key, path, name, kind, value) of every node of every configuration: the root, each field of each object, each entry of each array.

    ``value`` is a VARIANT column. A level is one explode over the nodes of the level before, so there
    are as many rounds as the deepest configuration has levels, whatever their number; a level is
    written, and nothing is collected. ``name`` is the field's, or that of the field that holds the
    array; paths read like ``$.a[0].b``. A null configuration has no node. More than ``most`` levels are refused.
    """
    spark = configs.sparkSession
    level = configs.where(F.col(value).isNotNull()).select(F.col(key).alias("node_of"), F.lit("$").alias("at"), F.lit(None).cast("string").alias("named"), F.col(value).alias("held"))
    levels = []
    while True:
        level = materialize(level.withColumn("kind", F.schema_of_variant("held")), "level")
        levels.append(level)
        if len(levels) > most:
            raise ValueError(f"a configuration has more than {most} levels")
        inner = level.where("kind like 'OBJECT<%' or kind like 'ARRAY<%'")
        if inner.isEmpty():
            nodes = reduce(DataFrame.unionByName, levels)
            return nodes.select(F.col("node_of").alias(key), F.col("at").alias("path"), F.col("named").alias("name"), "kind", F.col("held").alias("value"))
        below = inner.select("node_of", "at", "named", "held").lateralJoin(spark.tvf.variant_explode(F.col("held").outer()))
        path = F.when(F.col("key").isNull(), F.concat("at", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("at", F.lit("."), "key"))
        level = below.select("node_of", path.alias("at"), F.coalesce("key", "named").alias("named"), F.col("value").alias("held"))


def text(value: str) -> Column:
    """The string of a VARIANT value; null where it is none."""
    return F.try_variant_get(value, "$", "string")


#: A configuration of a splitter for each part: a sequence of rules, within as many wrappers as its size says.
CONFIG_SQL = """concat(repeat('{"inner":[{"type":"Sequence","pretokenizers":[', CAST(p_size % 4 AS INTEGER)),
 concat('{"type":"Split","pattern":{"Regex":"', p_name, '+"},"invert":false,"next":{"type":"ByteLevel","pattern":"plain"}}'),
 repeat(concat(',{"type":"Split","pattern":{"String":"', p_brand, '"}}]}]}'), CAST(p_size % 4 AS INTEGER)))"""


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each part, dealt over all cores: the scanned file is small beside the nodes that are made of it."""
    dealt = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return dealt.select("p_partkey", F.parse_json(F.expr(CONFIG_SQL)).alias("cfg"))


@query(
    f"""WITH t AS (SELECT p_partkey, CAST({CONFIG_SQL} AS JSON) AS cfg FROM part), w AS (SELECT p_partkey, j.fullkey AS spot, j.key, j.type, j.atom, j.path FROM t, json_tree(t.cfg) j)
SELECT p_partkey, replace(spot, '"', '') AS path, key AS kind, json_extract_string(atom, '$') AS pattern FROM w WHERE key IN ('Regex', 'String') AND type = 'VARCHAR' AND replace(path, '"', '') LIKE '%.pattern'"""
)
def splitter_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern in the configurations, at whatever depth, with its path: what a field ``pattern`` holds under Regex or String."""
    t = configurations(spark, sf_dir)
    nodes = walk(t, "p_partkey", "cfg")
    held = nodes.where(F.col("name").isin("Regex", "String") & F.col("path").rlike(r"\.pattern\.(Regex|String)$"))
    return held.select("p_partkey", "path", F.col("name").alias("kind"), text("value").alias("pattern")).where("pattern is not null")


@query(
    f"""WITH t AS (SELECT p_partkey, CAST({CONFIG_SQL} AS JSON) AS cfg FROM part), w AS (SELECT p_partkey, j.fullkey AS spot, j.key, j.type, j.atom FROM t, json_tree(t.cfg) j)
SELECT p_partkey, count(*)::BIGINT AS nodes, max(len(string_split(replace(replace(spot, '[', '.['), '"', ''), '.')) - 1)::BIGINT AS depth, count(*) FILTER (WHERE key = 'type' AND type = 'VARCHAR')::BIGINT AS types,
 count(DISTINCT CASE WHEN key = 'type' AND type = 'VARCHAR' THEN json_extract_string(atom, '$') END)::BIGINT AS kinds FROM w GROUP BY p_partkey"""
)
def splitter_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, depth and kinds of rules of each configuration."""
    t = configurations(spark, sf_dir)
    nodes = walk(t, "p_partkey", "cfg").withColumn("depth", F.regexp_count("path", F.lit(r"[.\[]")))
    kind = F.when(F.col("name") == "type", text("value"))
    return nodes.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("long").alias("depth"), F.count(kind).alias("types"), F.count_distinct(kind).alias("kinds"))
