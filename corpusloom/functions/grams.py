"""Word n-grams of whole texts as 64-bit hashes, made in Arrow batches without a string for each gram."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrow_text
from corpusloom.functions.arrow_bytes import SPACE, WindowHash, buffers, per_row, slices, spans

#: Hashes of a list that is looked up where the texts are read, at most (8 bytes each).
LOOKED_UP = 8 << 20


def gram_sets(column: pa.Array, n: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word n-grams of each row, ascending, and each row's bounds; a shorter text is one gram, or none."""
    data, offsets = buffers(column)
    inside = ~SPACE[data]
    starts, ends = spans(inside, offsets)
    bounds = per_row(starts, offsets)
    count = np.diff(bounds)
    if not len(starts):
        return np.zeros(0, np.int64), bounds
    keep = inside.copy()
    keep[ends[ends < len(data)]] = True  # one space after each word
    place = np.concatenate(([0], np.cumsum(keep)))
    hashed = WindowHash(np.where(inside, data, np.uint8(0x20))[keep], seed=n)
    row = np.repeat(np.arange(len(count)), count)
    width = np.minimum(n, count)[row] if short_whole else np.full(len(row), n)
    first = np.flatnonzero(np.arange(len(starts)) - bounds[row] + width <= count[row])
    tokens = hashed(place[starts[first]], place[ends[first + width[first] - 1]]).view(np.int64)
    row = row[first]
    edges = np.searchsorted(row, np.arange(len(count) + 1)).tolist()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        tokens[low:high].sort()
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    return tokens[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def sets(df: DataFrame, id_col: str, text: str, n: int, short_whole: bool, known: np.ndarray | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_grams, grams): the distinct n-grams of each lower-cased text, ascending; with ``known``, an ascending array, only those in it. Columns in ``keep`` follow."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = gram_sets(part.column("text"), n, short_whole)
                size = np.diff(bounds)
                if known is not None:
                    at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                    hit = known[at] == tokens if len(known) else np.zeros(len(tokens), dtype=bool)
                    bounds = np.concatenate(([0], np.cumsum(hit)))[bounds]
                    tokens = tokens[hit]
                grams = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens, pa.int64()))
                yield pa.record_batch([part.column("id"), pa.array(size, pa.int64()), grams, *(part.column(c) for c in keep)], names=["id", "n_grams", "grams", *keep])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"), *keep)
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(apply, f"id long, n_grams long, grams array<bigint>{kept}")


def cleaned_sets(df: DataFrame, id_col: str, text: str, n: int, *wanted: str) -> DataFrame:
    """(id, n_grams) and the wanted columns of each cleaned text (null: empty), in one pass.

    ``grams`` are its lower-cased distinct n-grams (a shorter text is one), ascending, 8 bytes each; ``same`` is a
    digest of them, so equal for equal sets; ``digest`` is the SHA-256 of the cleaned text.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                clean = arrow_text.cleaned(arrow_text.valid(part.column("text")))
                tokens, bounds = gram_sets(pc.utf8_lower(clean), n, True)
                raw, at = tokens.tobytes(), (8 * bounds).tolist()
                grams = [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                made = {
                    "grams": lambda grams=grams: grams,
                    "same": lambda grams=grams: [hashlib.blake2b(x, digest_size=16).digest() for x in grams],
                    "digest": lambda clean=clean: [hashlib.sha256(x).digest() for x in clean.cast(pa.binary()).to_pylist()],
                }
                yield pa.record_batch([part.column("id"), pa.array(np.diff(bounds), pa.int64()), *(pa.array(made[c](), pa.binary()) for c in wanted)], names=["id", "n_grams", *wanted])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(apply, ", ".join(["id long, n_grams long", *(f"{c} binary" for c in wanted)]))


def postings(df: DataFrame, id_col: str, text: str, n: int, short_whole: bool) -> DataFrame:
    """(id, n_grams, gram), one row for each distinct n-gram of each text."""
    return sets(df, id_col, text, n, short_whole).select("id", "n_grams", F.explode("grams").alias("gram"))


def hits(df: DataFrame, id_col: str, text: str, registry: DataFrame, n: int, short_whole: bool) -> DataFrame:
    """(id, n_grams, grams) of every text, with those of its n-grams alone that ``registry`` (with a column gram) holds.

    A registry of up to LOOKED_UP grams is searched where the texts are read; a longer one is joined.
    """
    distinct = registry.select("gram").distinct()
    some = distinct.limit(LOOKED_UP + 1).toArrow()
    if some.num_rows <= LOOKED_UP:
        return sets(df, id_col, text, n, short_whole, np.sort(np.asarray(some["gram"], dtype=np.int64)))
    all_ = sets(df, id_col, text, n, short_whole)
    found = all_.select("id", F.explode("grams").alias("gram")).join(distinct, "gram").groupBy("id").agg(F.collect_list("gram").alias("found"))
    return all_.select("id", "n_grams").join(found, "id", "left").select("id", "n_grams", F.coalesce("found", F.array().cast("array<bigint>")).alias("grams"))


def flagged(df: DataFrame, text: str, registry: DataFrame, n: int, flag: str, key: str) -> DataFrame:
    """``df`` plus ``flag``: whether the lower-cased ``text`` has an n-gram of the registry. ``key`` names a row where it must be joined."""
    distinct = registry.select("gram").distinct()
    some = distinct.limit(LOOKED_UP + 1).toArrow()
    if some.num_rows > LOOKED_UP:
        found = postings(df, key, text, n, False).join(distinct, "gram", "left_semi").select(F.col("id").alias(key)).distinct()
        return df.join(found.withColumn(flag, F.lit(True)), key, "left").na.fill(False, [flag])
    known = np.sort(np.asarray(some["gram"], dtype=np.int64))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                tokens, bounds = gram_sets(part.column(text), n, False)
                at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                hit = known[at] == tokens if len(known) else np.zeros(len(tokens), dtype=bool)
                seen = np.concatenate(([0], np.cumsum(hit)))[bounds]
                yield pa.record_batch([*part.columns, pa.array(np.diff(seen) > 0)], names=[*part.schema.names, flag])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(apply, f"{fields}, {flag} boolean")
