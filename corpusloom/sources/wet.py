"""Crawl archives (WET): a data source whose tasks share one archive by ranges of bytes.

An archive is a row of gzip members, each with one or more records. A task reads the members that
begin in its range, to the end of the last one, wherever that is. It finds the first of them by the
marks of a gzip header behind which a record unfolds, so no index and no pass over the file is needed.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.sources.files import Staged, listed, opened

#: Bytes of an archive for one task, bytes that are read at once, records of a batch, bytes of text after which a batch is handed on.
SPLIT, BLOCK, ROWS, BATCH_BYTES = 32 << 20, 1 << 16, 512, 8 << 20
SCHEMA = "file string, record_id string, type string, url string, date string, length long, text string, truncated boolean"

#: Fixed values of the format: a gzip member's first bytes, a record's first line.
MEMBER, RECORD = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r?\n")
FIELDS = ("WARC-Record-ID", "WARC-Type", "WARC-Target-URI", "WARC-Date")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    staged: str | None
    records: int


def records(data: bytes) -> Iterator[tuple]:
    """The records of a member's content: header fields, stated length, body, and whether the body ends before it should."""
    at = 0
    while m := RECORD.search(data, at):
        end = re.compile(rb"\r?\n\r?\n").search(data, m.end())
        head = data[m.end() : end.start() if end else len(data)]
        fields = {}
        for line in head.decode("utf-8", "replace").splitlines():
            name, colon, value = line.partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
        start = end.end() if end else len(data)
        stated = fields.get("content-length", "")
        length = int(stated) if stated.isdigit() else None
        # Without a length a record goes to the next one's first line.
        following = None if length is not None else RECORD.search(data, start)
        stop = start + length if length is not None else following.start() if following else len(data)
        yield *(fields.get(f.lower()) for f in FIELDS), length, data[start:stop], end is None or stop > len(data)
        at = max(stop, m.end())


class Members:
    """Gzip members of one archive, read block by block."""

    def __init__(self, file: pa.NativeFile, size: int, block: int = BLOCK):
        self._file, self._size, self._block = file, size, block

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        return self._file.read(min(n, max(0, self._size - at)))

    def _unfolds(self, at: int) -> bool:
        """Whether what begins here is a member with a record."""
        unzip, out, place = zlib.decompressobj(31), b"", at
        try:
            while len(out) < 16 and place < self._size and not unzip.eof:
                raw = self._read(place, self._block)
                out += unzip.decompress(raw, 64)
                place += len(raw)
        except zlib.error:
            return False
        return bool(RECORD.match(out.lstrip(b"\r\n")))

    def first(self, start: int, stop: int) -> int | None:
        """The first place in a range where a member begins."""
        at = start
        while at < stop:
            raw = self._read(at, self._block + len(MEMBER) - 1)
            k = raw.find(MEMBER)
            while k >= 0 and at + k < stop:
                if self._unfolds(at + k):
                    return at + k
                k = raw.find(MEMBER, k + 1)
            at += self._block
        return None

    def member(self, at: int) -> tuple[bytes, int | None]:
        """Content of the member that begins here, and where it ends; no end where it is cut off or damaged."""
        unzip, parts, place = zlib.decompressobj(31), [], at
        while not unzip.eof:
            raw = self._read(place, self._block)
            if not raw:
                return b"".join(parts), None
            try:
                parts.append(unzip.decompress(raw))
            except zlib.error:
                return self._until_damage(at), None
            place += len(raw)
        return b"".join(parts), place - len(unzip.unused_data)

    def _until_damage(self, at: int) -> bytes:
        """What unfolds before the first byte that does not fit."""
        unzip, parts = zlib.decompressobj(31), []
        try:
            while raw := self._read(at, 1 << 12):
                for k in range(len(raw)):
                    parts.append(unzip.decompress(raw[k : k + 1]))
                at += len(raw)
        except zlib.error:
            pass
        return b"".join(parts)

    def within(self, start: int, stop: int) -> Iterator[tuple[bytes, bool]]:
        """Content of each member that begins in a range, and whether it is whole."""
        at = self.first(start, stop)
        while at is not None and at < stop:
            content, end = self.member(at)
            yield content, end is not None
            # Behind a damaged member the next sound one is looked for; between members there may be padding.
            at = self.first(at + 1 if end is None else end, stop)


class WetReader(DataSourceReader):
    def __init__(self, options: dict):
        self._uri, self._split = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return [Range(path, k, min(k + self._split, size)) for path, size in listed(self._uri, (".gz",)) for k in range(0, size, self._split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self._uri)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            for content, whole in Members(file, file.size()).within(partition.start, partition.stop):
                for ident, kind, url, date, length, body, short in records(content):
                    text = body.decode("utf-8", "replace")
                    rows.append((partition.path, ident, kind, url, date, length, text, short or not whole))
                    held += len(body)
                    if len(rows) >= ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WetWriter(DataSourceArrowWriter):
    """One archive for each task, one member for each record; columns record_id, type, url, date and text, of which those that are missing or null leave no field."""

    def __init__(self, options: dict):
        self._uri, self._job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        file, path, n = None, None, 0
        for batch in iterator:
            columns = {c.lower(): batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if file is None:
                    path, file = Staged(self._uri, self._job).new(".warc.wet.gz")
                    file.write(_zipped([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")], b"format: WET\r\n"))
                field = lambda name: (columns.get(name) or [None] * batch.num_rows)[i]  # noqa: B023, E731
                named = [("WARC-Type", field("type") or "conversion"), ("WARC-Target-URI", field("url")), ("WARC-Date", field("date")), ("WARC-Record-ID", field("record_id"))]
                file.write(_zipped([(k, v) for k, v in named if v is not None], (field("text") or "").encode()))
                n += 1
        if file is not None:
            file.close()
        return Written(path, n)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m.staged for m in messages if m and m.staged]
        Staged(self._uri, self._job).publish([(p, f"part-{i:05d}-{self._job[:8]}.warc.wet.gz") for i, p in enumerate(done)])

    def abort(self, messages: list[Written | None]) -> None:
        Staged(self._uri, self._job).clear()


def _zipped(fields: list[tuple[str, str]], body: bytes) -> bytes:
    # A field is one line; what would end it stands percent-encoded.
    lines = [f"{k}: {re.sub('[\r\n]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in fields]
    head = f"WARC/1.0\r\n{''.join(lines)}Content-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n"
    zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipper.compress(head.encode() + body + b"\r\n\r\n") + zipper.flush()


class WetSource(DataSource):
    """Option splitBytes: how many bytes of an archive one task reads."""

    @classmethod
    def name(cls) -> str:
        return "wet"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return WetReader(self.options)

    def writer(self, schema, overwrite: bool) -> WetWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("archives are added to a folder, never replaced: use append")
        return WetWriter(self.options)


def scan_wet(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """file, record_id, type, url, date, length, text and truncated of every record below a path.

    A record without a field has null there. A body that is cut off is there as far as it goes, and
    ``truncated`` says so; behind a damaged member reading goes on with the next sound one. Bytes that
    are no UTF-8 are replaced. Memory follows the largest member. A folder without archives gives no rows.
    """
    spark.dataSource.register(WetSource)
    return spark.read.format("wet").option("splitBytes", split_bytes).load(path)


def write_wet(df: DataFrame, path: str) -> None:
    """Add archives with one conversion record for each row."""
    df.sparkSession.dataSource.register(WetSource)
    df.write.format("wet").mode("append").save(path)


def conversions(records: DataFrame) -> DataFrame:
    """The records that hold the text of a page."""
    return records.where(F.col("type") == "conversion")
