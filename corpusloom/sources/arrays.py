"""Numeric arrays in npy and npz files: a data source that reads rows by their offset and only the arrays, or columns of one, that are asked for.

All arrays of an npz file have one row for each entry of their first dimension and stand side by
side; an npy file has one array, named ``value``. A header is parsed once, when the scan is planned,
and a task seeks to its rows.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.sources.files import Staged, listed, opened

#: Rows of a partition, of a batch, and of a written file.
ROWS, BATCH, FILE_ROWS = 1 << 18, 4096, 1 << 16
SUFFIXES = (".npy", ".npz")


@dataclass
class Stored:
    """Where an array stands: bytes before its first value in the file (none where it is compressed), type, shape, order."""

    name: str
    at: int | None
    dtype: str
    shape: tuple[int, ...]
    by_column: bool


@dataclass
class Rows(InputPartition):
    path: str = ""
    start: int = 0
    stop: int = 0
    arrays: dict[str, Stored] = field(default_factory=dict)


@dataclass
class Written(WriterCommitMessage):
    staged: list[str]


def _header(file, name: str, at: int | None) -> Stored:  # noqa: ANN001
    version = npy.read_magic(file)
    shape, by_column, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(file)
    if dtype.kind not in "biuf" or len(shape) not in (1, 2):
        raise ValueError(f"{name}: arrays of {dtype} with {len(shape)} dimensions are not read; they are numbers in one or two")
    return Stored(name, None if at is None else at + file.tell(), dtype.str, tuple(shape), by_column and len(shape) == 2)


def described(fs, path: str) -> dict[str, Stored]:  # noqa: ANN001
    """The arrays of a file, from its headers alone."""
    with fs.open_input_file(path) as raw:
        if path.endswith(".npy"):
            return {"value": _header(raw, "value", 0)}
        found = {}
        with zipfile.ZipFile(pa.PythonFile(raw, mode="r") if not raw.seekable() else raw) as z:
            for entry in z.infolist():
                name = entry.filename.removesuffix(".npy")
                at = None
                if entry.compress_type == zipfile.ZIP_STORED:
                    raw.seek(entry.header_offset + 26)
                    lengths = raw.read(4)
                    at = entry.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
                with z.open(entry) as member:
                    found[name] = _header(member, name, at)
        return found


def rows_of(raw, array: Stored, start: int, stop: int, columns: list[int] | None) -> np.ndarray:  # noqa: ANN001
    """Rows of one array; of an array kept by columns only the bytes of the columns that are asked for are read."""
    dtype = np.dtype(array.dtype)
    if len(array.shape) == 1:
        raw.seek(array.at + start * dtype.itemsize)
        return np.frombuffer(raw.read((stop - start) * dtype.itemsize), dtype)
    n, width = array.shape
    if not array.by_column:
        raw.seek(array.at + start * width * dtype.itemsize)
        values = np.frombuffer(raw.read((stop - start) * width * dtype.itemsize), dtype).reshape(stop - start, width)
        return values if columns is None else values[:, columns]
    out = np.empty((stop - start, width if columns is None else len(columns)), dtype)
    for k, c in enumerate(range(width) if columns is None else columns):
        raw.seek(array.at + (c * n + start) * dtype.itemsize)
        out[:, k] = np.frombuffer(raw.read((stop - start) * dtype.itemsize), dtype)
    return out


def _arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    values = values.astype(values.dtype.newbyteorder("="))
    if values.ndim == 1:
        return pa.array(values).cast(kind)
    edges = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(values).ravel()).cast(kind.value_type))


#: Spark's type for each numpy type; unsigned ones go to the next wider type.
TYPES = {"b1": T.BooleanType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType()}


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self._uri, self._rows = options["path"], int(options.get("partitionRows", ROWS))
        self._columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else None
        self._schema = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        fs, _ = opened(self._uri)
        found: list[InputPartition] = []
        for path, _ in listed(self._uri, SUFFIXES):
            arrays = described(fs, path)
            missing = [n for n in self._schema.names if n not in arrays and n not in ("file", "row")]
            if missing:
                raise ValueError(f"{path} has no array {', '.join(missing)}; it has {', '.join(arrays)}")
            wanted = {n: a for n, a in arrays.items() if n in self._schema.names}
            lengths = {a.shape[0] for a in (wanted or arrays).values()}
            if len(lengths) != 1:
                raise ValueError(f"{path}: arrays side by side have one length, not {sorted(lengths)}")
            n = lengths.pop()
            # Compressed arrays cannot be read from within.
            step = max(1, n) if any(a.at is None for a in wanted.values()) else self._rows
            found += [Rows(path, k, min(n, k + step), wanted) for k in range(0, n, step)]
        return found or [Rows()]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self._uri)
        with fs.open_input_file(partition.path) as raw:
            whole = {}
            if any(a.at is None for a in partition.arrays.values()):
                with zipfile.ZipFile(raw) as z:
                    for name, a in partition.arrays.items():
                        if a.at is None:
                            whole[name] = npy.read_array(io.BytesIO(z.read(f"{name}.npy")), allow_pickle=False)
            for k in range(partition.start, partition.stop, BATCH):
                stop = min(k + BATCH, partition.stop)
                out = []
                for kind in self._schema:
                    if kind.name == "file":
                        out.append(pa.array([partition.path] * (stop - k), pa.string()))
                    elif kind.name == "row":
                        out.append(pa.array(np.arange(k, stop), pa.int64()))
                    elif kind.name in whole:
                        values = whole[kind.name][k:stop]
                        out.append(_arrow(values if self._columns is None or values.ndim == 1 else values[:, self._columns], kind.type))
                    else:
                        out.append(_arrow(rows_of(raw, partition.arrays[kind.name], k, stop, self._columns), kind.type))
                yield pa.record_batch(out, schema=self._schema)


class ArrayWriter(DataSourceArrowWriter):
    """Uncompressed npz files of at most ``fileRows`` rows with one array for each column."""

    def __init__(self, options: dict):
        self._uri, self._job, self._rows = options["path"], uuid.uuid4().hex, int(options.get("fileRows", FILE_ROWS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        staged, held, n = [], [], 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, self._rows - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == self._rows:
                    staged.append(self._file(held))
                    held, n = [], 0
        if n:
            staged.append(self._file(held))
        return Written(staged)

    def _file(self, batches: list[pa.RecordBatch]) -> str:
        table = pa.Table.from_batches(batches).combine_chunks()
        path, out = Staged(self._uri, self._job).new(".npz")
        with out:
            np.savez(out, **{name: _numbers(name, table.column(name).combine_chunks()) for name in table.schema.names})
        return path

    def commit(self, messages: list[Written | None]) -> None:
        done = [p for m in messages if m for p in m.staged]
        Staged(self._uri, self._job).publish([(p, f"part-{i:05d}-{self._job[:8]}.npz") for i, p in enumerate(done)])

    def abort(self, messages: list[Written | None]) -> None:
        Staged(self._uri, self._job).clear()


def _numbers(name: str, column: pa.Array) -> np.ndarray:
    """A column as an array; arrays have no nulls, and rows of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    if column.null_count:
        raise ValueError(f"{name} has nulls, which an array cannot hold")
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    flat, lengths = column.flatten(), set(column.value_lengths().to_pylist())
    if flat.null_count or len(lengths) > 1:
        raise ValueError(f"{name} has rows of several lengths or with nulls, which an array cannot hold")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), lengths.pop() if lengths else 0)


class ArraySource(DataSource):
    """Options: partitionRows; columns, the places of the columns to read from two-dimensional arrays; fileRows of written files."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> T.StructType:
        """That of the first file: file, row and every array."""
        uri = self.options["path"]
        fs, _ = opened(uri)
        fields = [T.StructField("file", T.StringType()), T.StructField("row", T.LongType())]
        for path, _ in listed(uri, SUFFIXES)[:1]:
            for name, a in described(fs, path).items():
                kind = TYPES[np.dtype(a.dtype).str[1:]]
                fields.append(T.StructField(name, T.ArrayType(kind) if len(a.shape) == 2 else kind))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        if overwrite:
            raise ValueError("arrays are added to a folder, never replaced: use append")
        return ArrayWriter(self.options)


def scan_arrays(spark: SparkSession, path: str, schema: str | None = None, columns: list[int] | None = None, partition_rows: int = ROWS) -> DataFrame:
    """The rows of npy and npz files below a path.

    ``schema`` names the arrays to read (and ``file`` and ``row`` where wanted), the others are not
    touched; ``columns`` picks places of two-dimensional arrays. A folder without files, or arrays
    without rows, give no rows; an array that a file does not have, or of another length than those beside it, is an error.
    """
    spark.dataSource.register(ArraySource)
    reader = spark.read.format("arrays").option("partitionRows", partition_rows)
    if columns is not None:
        reader = reader.option("columns", ",".join(map(str, columns)))
    return (reader.schema(schema) if schema else reader).load(path)


def write_arrays(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Add npz files with the numeric columns of ``df``; nulls and rows of several lengths are refused before anything is published."""
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("arrays").option("fileRows", file_rows).mode("append").save(path)
