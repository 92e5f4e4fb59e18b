"""Secret scan with multipart credential linking, in DataFrame operations only.

A credential often stands in parts: an identifier, a secret and an endpoint. Parts that say little
on their own are weak; they are reported only where a complementary part stands in the same scope.
The parts of a text are intervals in one sorted array, and one pass in each direction joins every
weak interval with the nearest part of each role, so nothing is shuffled and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base kinds in their order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, SHORT_LEAST = 12, 8
#: Greedy runs: one of at least n characters is found exactly where the open-ended pattern finds it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: a bare 40-character secret, a named account, an address with a scheme.
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ACCOUNT = r"""(?<![A-Za-z0-9_])(?i:account|client_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})"""
ENDPOINT = r"(?<![A-Za-z0-9_])[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9@:._-]+"

#: Kinds in the order that ties of a start are reported in; the method's own follow the base kinds.
KINDS = ("assign", "access", "hex", "short", "bare", "account", "endpoint")
#: Code points between two parts of one scope, at most.
SCOPE = 300
REDACTED = "[SECRET]"
#: Items of a fold that stand in one array, and code points of a stretch of text that is cut at once.
FOLD, STRETCH = 512, 4096

_SPAN = "struct<start:int,rank:int,end:int,kind:string,role:string,weak:boolean>"


def _folded(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` appends to the array ``out`` of its state, over all items in order.

    Appending copies the array, so items are folded in blocks, and an array never outgrows one.
    """
    none = start["out"]
    size = F.lit(FOLD)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / size).cast("int")), lambda k: F.slice(items, k * size + 1, size))
    # An array of one element holds the block's state, so that it is computed once.
    close = lambda closed: lambda s: F.struct(s.withField("out", none).alias("state"), F.concat(closed, F.array(s["out"])).alias("closed"))
    by_block = lambda s, block: F.transform(F.array(F.aggregate(block, s["state"], step)), close(s["closed"]))[0]
    begin = F.struct(start.alias("state"), F.slice(F.array(none), F.lit(1), F.lit(0)).alias("closed"))
    return F.aggregate(blocks, begin, by_block, lambda s: F.flatten(s["closed"]))


def _hits(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost matches that do not overlap, as (start, end, value) in code points; empty for most texts by one search."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(
        F.transform(found, F.length).alias("size"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.transform(value, F.length).alias("value")
    )
    none = F.array().cast("array<struct<start:int,end:int,value:int>>")
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))).alias("out"),
    )
    return F.when(text.rlike(pattern), _folded(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step)).otherwise(none)


def _parts(hits: Column, kind: str, role: str, weak: bool) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(weak).alias("weak")
        ),
    )


def _nearest(parts: Column, backwards: bool) -> Column:
    """The parts, each with the edge of the nearest earlier (or later) part of each role; in reverse order when backwards."""
    far = F.lit(None).cast("int")
    step = lambda s, p: F.struct(
        *(
            F.when(p["role"] == role, F.least(s[role], p["start"]) if backwards else F.greatest(s[role], p["end"])).otherwise(s[role]).alias(role)
            for role in ("id", "key", "place")
        ),
        F.concat(s["out"], F.array(F.struct(p.alias("part"), *(s[r].alias(r) for r in ("id", "key", "place"))))).alias("out"),
    )
    start = F.struct(
        *(far.alias(r) for r in ("id", "key", "place")), F.array().cast(f"array<struct<part:{_SPAN},id:int,key:int,place:int>>").alias("out")
    )
    return _folded(F.reverse(parts) if backwards else parts, start, step)


def _linked(parts: Column) -> Column:
    """Weak parts that share a scope with a complementary part: a key with an id, an id with a key, a place with both."""
    before, after = _nearest(parts, False), F.reverse(_nearest(parts, True))
    both = F.zip_with(before, after, lambda b, a: F.struct(b["part"].alias("part"), b.alias("b"), a.alias("a")))

    def near(x: Column, role: str) -> Column:
        return F.coalesce(x["part"]["start"] - x["b"][role] <= SCOPE, F.lit(False)) | F.coalesce(x["a"][role] - x["part"]["end"] <= SCOPE, F.lit(False))

    def kept(x: Column) -> Column:
        role = x["part"]["role"]
        return x["part"]["weak"] & (
            ((role == "key") & near(x, "id")) | ((role == "id") & near(x, "key")) | ((role == "place") & near(x, "id") & near(x, "key"))
        )

    return F.transform(F.filter(both, kept), lambda x: x["part"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``secret_parts``: base spans and linked weak spans by start, then kind.

    A span has start and end (code points, end exclusive), kind, role and weak. A null text is empty
    and has no spans; repeated rows and null ids are scanned like any others. A column of ``docs``
    named secret_parts is replaced.
    """
    work = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "secret_parts")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    # One projection per step: each array is computed once, and a text without weak parts is not joined.
    scanned = work.withColumns(
        {
            "assign": _hits(text, ASSIGN, 1),
            "access": _hits(text, ACCESS),
            "hex": _hits(text, HEX),
            "bare": _hits(text, BARE),
            "account": _hits(text, ACCOUNT, 1),
            "endpoint": _hits(text, ENDPOINT),
        }
    )
    assign = F.col("assign")
    base = F.concat(
        _parts(F.filter(assign, lambda h: h["value"] >= ASSIGN_LEAST), "assign", "key", False),
        _parts(F.col("access"), "access", "id", False),
        _parts(F.col("hex"), "hex", "key", False),
    )
    weak = F.concat(
        _parts(F.filter(assign, lambda h: (h["value"] >= SHORT_LEAST) & (h["value"] < ASSIGN_LEAST)), "short", "key", True),
        _parts(F.filter(F.col("bare"), lambda h: ~F.exists(assign, lambda a: (a["start"] <= h["start"]) & (h["end"] <= a["end"]))), "bare", "key", True),
        _parts(F.col("account"), "account", "id", True),
        _parts(F.col("endpoint"), "endpoint", "place", True),
    )
    both = scanned.withColumns({"base": base, "weak": weak})
    linked = F.when(F.size("weak") > 0, _linked(F.array_sort(F.concat("base", "weak")))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return both.select("row.*", F.array_sort(F.concat("base", linked)).alias("secret_parts"))


def _stretch(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text that lies in chunks of STRETCH."""
    first = F.floor(start / STRETCH).cast("int")
    joined = F.array_join(F.slice(chunks, first + 1, F.floor(end / STRETCH).cast("int") - first + 1), "")
    return F.substring(joined, start - first * STRETCH + 1, end - start)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each found stretch of the text replaced by a mark; all columns stay, other texts stay as they are.

    Overlapping findings make one mark. A null text stays null; a column named secret_parts is dropped.
    """
    columns = [c for c in docs.columns if c != "secret_parts"]
    found = scan_secrets(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = found.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), text.alias("text"), "secret_parts")
    some = F.size("secret_parts") > 0
    cut = cut.withColumn("chunks", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))
    chunks = F.col("chunks")
    step = lambda s, p: F.when(p["end"] <= s["at"], s).otherwise(
        F.struct(
            p["end"].alias("at"),
            F.when(p["start"] >= s["at"], F.concat(s["out"], F.array(_stretch(chunks, s["at"], p["start"]), F.lit(REDACTED)))).otherwise(s["out"]).alias("out"),
        )
    )
    pieces = _folded(F.col("secret_parts"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    rest = _stretch(chunks, F.array_max(F.transform("secret_parts", lambda p: p["end"])), F.length("text"))
    marked = cut.withColumn("marked", F.when(some, F.concat(F.array_join(pieces, ""), rest)))
    return marked.select(*(F.coalesce("marked", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    parts = F.col("secret_parts")
    count = lambda kind: F.size(F.filter(parts, lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(parts, lambda p: p["rank"] < 3)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(parts).alias("spans"))
