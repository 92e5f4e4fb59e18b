"""URL filter by a sorted digest array.

Rules and blocked hosts are keys in a sorted array of 64-bit xxhash digests. Tasks memory-map the
array, probe it with vectorised binary search for those host suffixes and path prefixes of a URL
that rules may have, and confirm each hit against the stored full string. A long list makes several
arrays, each of one range of digests.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import materialize

#: Host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hosts that are blocked with their subdomains where no rule fits, unless the caller names others.
BLOCKED_HOSTS = (
    "ads-track.example.com",
    "adult-x.example.net",
    "casino-win.example.com",
    "cheap-pills.example.com",
    "free-bets.example.com",
    "spam-farm.example.com",
)
#: Bytes of keys in one array, about; longer lists make more arrays, each of one range of digests.
ARRAY_BYTES = 64 << 20

RESULT = "page_id long, host string, path string, rule string, verdict string"
#: What a key says: whether it blocks, and whether it is a listed rule.
BLOCK, LISTED = 1, 2


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def suffixes(host: str, depths: dict[int, list[int]]) -> Iterator[tuple[str, int]]:
    """The host and its parent domains whose number of labels is among ``depths``, with that number."""
    depth = host.count(".") + 1
    ends = {depth: 0} if depth in depths else {}
    at, deepest = len(host), max(depths, default=0)
    for n in range(1, min(depth - 1, deepest) + 1):
        at = host.rfind(".", 0, at)
        if n in depths:
            ends[n] = at + 1
    return ((host[begin:], n) for n, begin in ends.items())


class DigestArray:
    """Sorted digests of unique strings, what each says, their places and the strings, as one block of bytes."""

    def __init__(self, blob: np.ndarray):
        n = int(blob[:8].view("<u8")[0])
        self.digests = blob[8 : 8 + 8 * n].view("<u8")
        self._ends = blob[8 + 8 * n : 8 + 16 * n].view("<u8")
        self.says = blob[8 + 16 * n : 8 + 17 * n]
        self._text = blob[8 + 17 * n :]

    @staticmethod
    def build(keys: dict[str, int], digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> bytes:
        """Keys are stored by digest, then string; equal digests lie side by side."""
        rows = sorted((digest(k.encode()), k.encode(), says) for k, says in keys.items())
        ends = np.cumsum([len(k) for _, k, _ in rows], dtype="<u8") if rows else np.zeros(0, "<u8")
        heads = np.array([d for d, _, _ in rows], dtype="<u8").tobytes() + ends.tobytes() + bytes(says for _, _, says in rows)
        return np.uint64(len(rows)).tobytes() + heads + b"".join(k for _, k, _ in rows)

    def key(self, i: int) -> bytes:
        low = int(self._ends[i - 1]) if i else 0
        return self._text[low : int(self._ends[i])].tobytes()

    def find(self, keys: list[bytes], digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each key, or -1; a digest that fits is confirmed by the full string."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests):
            return found
        digests = np.fromiter(map(digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == digests[i]:
                if self.key(j) == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found

    @classmethod
    def mapped(cls, blob: bytes) -> DigestArray:
        """The array as a memory map of a file in the task's own temp folder, shared by the tasks of one machine.

        The file is made from the broadcast bytes wherever it is missing, so a lost machine loses nothing.
        """
        path = os.path.join(tempfile.gettempdir(), f"digests-{xxhash.xxh64_hexdigest(blob)}-{len(blob)}")
        if not os.path.exists(path) or os.path.getsize(path) != len(blob):
            fd, own = tempfile.mkstemp(dir=tempfile.gettempdir())
            with os.fdopen(fd, "wb") as f:
                f.write(blob)
            os.replace(own, path)
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper 32 bits of each key's digest."""
    for batch in batches:
        high = [xxhash.xxh64_intdigest(k.encode()) >> 32 for k in batch.column("key").to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(high, pa.int64())], names=[*batch.schema.names, "high"])


def _judge(batches: Iterator[pa.RecordBatch], blobs: list, depths: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    arrays = [DigestArray.mapped(b.value) for b in blobs]
    for batch in batches:
        hosts, paths, keys, owner = [], [], [], []
        for i, url in enumerate(batch.column("url").to_pylist()):
            host, path = split_url(url)
            hosts.append(host)
            paths.append(path)
            for suffix, depth in suffixes(host, depths) if host else ():
                for n in depths[depth]:
                    if n <= len(path):
                        keys.append((suffix + "\0" + path[:n]).encode())
                        owner.append(i)
        rule: list[str | None] = [None] * len(hosts)
        verdict = ["allow"] * len(hosts)
        best: list[tuple[bool, int, int]] = [(False, -1, -1)] * len(hosts)
        for array in arrays:
            places = array.find(keys)
            for k in np.flatnonzero(places >= 0):
                i, says = owner[k], int(array.says[places[k]])
                host, _, path = keys[k].decode().partition("\0")
                listed = bool(says & LISTED)
                # A listed rule goes before a blocked host, then the longest rule, then the longest host.
                rank = (listed, len(host) + len(path), len(host))
                if rank > best[i]:
                    best[i], verdict[i], rule[i] = rank, "block" if says & BLOCK else "allow", host + path if listed else None
        yield pa.record_batch(
            [batch.column("page_id").cast(pa.int64()), *(pa.array(c, pa.string()) for c in (hosts, paths, rule, verdict))],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def filter_urls(
    pages: DataFrame, rules: DataFrame | None = None, blocked: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", array_bytes: int = ARRAY_BYTES
) -> DataFrame:
    """Host, path, deciding rule and verdict of every row's URL.

    A rule fits its host with all subdomains where the path starts with the rule's path; the longest
    rule decides, between equally long ones that with the longer host. Without a rule the verdict is
    block for a blocked host or a subdomain of one, else allow. A null URL or one without ``://``
    has empty host and path and is allowed. Repeated rows and null ids are kept; other columns are
    not read. ``rules`` has host, path and verdict, block or allow (the same host and path twice:
    block decides), and ``blocked`` has host; rows with a null say nothing. Lists of any length are
    cut by digest into arrays of about ``array_bytes``, which are made one after the other and are
    mapped, not loaded, where the tasks run.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    if blocked is None:
        blocked = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    says = F.when(F.col("verdict") == "block", BLOCK).otherwise(0) + F.lit(LISTED)
    listed = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", says.alias("says"))
    hosts = blocked.where("host is not null").select("host", F.lit("").alias("path"), F.lit(BLOCK).alias("says"))
    table = listed.unionByName(hosts).groupBy("host", "path").agg(F.max("says").alias("says"))
    table = table.select(F.concat("host", F.lit("\0"), "path").alias("key"), (F.length("host") - F.length(F.replace("host", F.lit("."))) + 1).alias("depth"), F.length("path").alias("n"), "says")
    table = materialize(table.mapInArrow(_digests, "key string, depth int, n int, says int, high long"), "rules")
    depths: dict[int, list[int]] = {}
    for r in table.select("depth", "n").distinct().orderBy("depth", "n").collect():  # as many as rules have shapes
        depths.setdefault(r.depth, []).append(r.n)
    size = table.agg(F.coalesce(F.sum(F.octet_length("key") + 17), F.lit(0))).first()[0]
    shards, blobs = max(1, -(-size // max(1, array_bytes))), []
    for k in range(shards):
        part = table.where(F.floor(F.col("high") * shards / (1 << 32)) == k).select("key", "says").collect()
        blobs.append(spark.sparkContext.broadcast(DigestArray.build({r.key: r.says for r in part})))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return pages.mapInArrow(lambda batches: _judge(batches, blobs, depths), RESULT)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


OP10_SQL = rf"""
WITH rules(rhost, rpath, says) AS (VALUES {_values(list(RULES))}),
blocked(bhost) AS (VALUES {_values([(h,) for h in BLOCKED_HOSTS])}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/]*(.*)$', 1) AS path
  FROM cut
)
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1) AS rule,
  coalesce(
    (SELECT says FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
     ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1),
    (SELECT 'block' FROM blocked WHERE host = bhost OR ends_with(host, '.' || bhost) LIMIT 1),
    'allow') AS verdict
FROM parts
"""
