"""Fill-in-the-middle transformation by an Aho-Corasick scan for events.

One automaton finds, in a single pass over a text, the characters at which the class of units
changes (the newline for lines, white space for words, none for characters) and the sentinels. Only
these events are kept. What lies between two of them, a gap, holds a number of units that follows
from its length alone, so counts add up by arithmetic and the place of a unit is found by a binary
search among the counts at the events.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._bytes import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters at which each kind of unit changes its class.
BREAKS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
SEED, RATE, SPM = 7, 100, 50


class UnitScan:
    """Events of a text, and from them its units: lines with their newline, words with the white space behind them, or characters."""

    def __init__(self, unit: str = "line", sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)):
        import ahocorasick

        if unit not in BREAKS:
            raise ValueError(f"units are {', '.join(BREAKS)}, not {unit}")
        for a in sentinels:
            for b in sentinels:
                # One that could begin inside another would be found where none was set.
                if not a or (a is not b and a in b) or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                    raise ValueError(f"sentinels {a!r} and {b!r} are empty or can overlap")
        self._unit = unit
        self._automaton = ahocorasick.Automaton()
        for c in BREAKS[unit]:
            self._automaton.add_word(c, 0)
        for s in sentinels:
            self._automaton.add_word(s, 1)
        self._automaton.make_automaton()

    def __call__(self, text: str) -> tuple[Units, bool]:
        """Units, and whether a sentinel occurs."""
        at: list[int] = []
        marked = False
        for end, sentinel in self._automaton.iter(text):
            if sentinel:
                marked = True
            else:
                at.append(end)
        return Units(self._unit, len(text), np.array(at, dtype=np.int64)), marked


class Units:
    """Counts of units at the events of one text of ``size`` characters."""

    def __init__(self, unit: str, size: int, breaks: np.ndarray):
        self._each, self._size = unit == "char", size
        # White space right behind white space goes on with its unit, so only the last of a run ends one.
        last = np.ones(len(breaks), dtype=bool)
        if unit == "word" and len(breaks):
            last[:-1] = np.diff(breaks) > 1
        ends = breaks[last] + 1
        # A gap behind the last event is one more unit if it is not empty.
        open_ = not len(ends) or ends[-1] < size
        self._ends = np.append(ends, size) if open_ and size and not self._each else ends

    @property
    def count(self) -> int:
        return self._size if self._each else len(self._ends)

    def place(self, rank: int) -> int:
        """Characters before the unit of this rank (the text's length behind the last one)."""
        if self._each or not rank:
            return rank
        return int(self._ends[rank - 1])

    def rank(self, place: int) -> int:
        """Units that end at or before this character."""
        return place if self._each else int(np.searchsorted(self._ends, place, side="right"))


def drawn(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def cut(units: Units, key: str, seed: int) -> tuple[int, int]:
    """Characters before the middle and before the suffix."""
    one, two, *_ = drawn(key, seed)
    n = units.count + 1
    low, high = sorted((one % n, two % n))
    return units.place(low), units.place(high)


def _transform(batches: Iterator[pa.RecordBatch], unit: str, seed: int, rate: int, spm: int, sentinels: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    scan = UnitScan(unit, sentinels)
    prefix, suffix, middle = sentinels
    for batch in batches:
        for part in slices(batch, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                text = text or ""
                units, marked = scan(text)
                key = "" if doc_id is None else str(doc_id)
                *_, chance, order = drawn(key, seed)
                row = (units.count, "plain", None, None, text)
                if text and not marked and chance % 100 < rate:
                    a, b = cut(units, key, seed)
                    if order % 100 < spm:
                        row = (units.count, "spm", a, b - a, "".join((suffix, text[b:], prefix, text[:a], middle, text[a:b])))
                    else:
                        row = (units.count, "psm", a, b - a, "".join((prefix, text[:a], suffix, text[b:], middle, text[a:b])))
                for held, value in zip(out, row, strict=True):
                    held.append(value)
            n, form, before, within, texts = out
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(texts, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(
    docs: DataFrame,
    unit: str = "line",
    seed: int = SEED,
    rate: int = RATE,
    spm: int = SPM,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every whole text.

    ``rate`` documents of a hundred are rearranged, ``spm`` of a hundred of these with the suffix
    first. Cuts and forms depend on the seed and the id alone, so rows that repeat an id and have as
    many units are cut alike; a null id draws like an empty one. Null and empty texts, and texts that hold a
    sentinel, stay plain. A text without a break is one unit. An empty table gives an empty result;
    other columns are not read. Memory follows the longest text.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return slim.mapInArrow(lambda b: _transform(b, unit, seed, rate, spm, tuple(sentinels)), schema)


def restore(made: DataFrame, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Adds ``restored``, the exact text, from output and form alone; a null output or form restores to null."""
    parts = F.split("output", "|".join(map(re.escape, sentinels)), -1)
    joined = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col("form") == "spm", F.concat(parts[2], parts[3], parts[1]))
    return made.withColumn("restored", joined)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
),
r AS (
  SELECT *, len(units) AS n,
         CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM d
),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS low, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS high FROM r),
p AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[1:low], ''), '') AS prefix,
         coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
