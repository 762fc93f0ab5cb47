"""Raw little-endian float16 matrices as a Spark data source.

A matrix of a field is one file or several, each of consecutive rows and of
exactly rows x dims x 2 bytes. Reading makes a partition of each stretch of
SPAN rows, that is of a byte range, and checks every file's size first. Writing
takes rows (field, idx, v) that are sorted by field and number in each task,
writes a file for each stretch of consecutive numbers (``step`` at most) beside
the target, and commits on the driver: the stretches of every field must cover the stated rows
without gap or overlap, files are renamed into place, and a listing of them
(field, first, rows, sha256) is published last. A task that is repeated leaves
a file that nobody lists, which goes with the staging folder.
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import places

#: Rows of a partition; bytes that are read or written at a time; bytes of a number.
SPAN, PIECE, WIDTH = 65_536, 4 << 20, 2
LISTING = "listing.json"


@dataclass
class Stretch(InputPartition):
    field: str
    uri: str
    skip: int
    first: int
    rows: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.dims, self.span = int(options["dims"]), int(options.get("span", SPAN))
        self.files = json.loads(options["files"])

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for field, uri, first, rows in self.files:
            system, path = places.place(uri)
            found, need = system.get_file_info(path).size, rows * self.dims * WIDTH
            if found != need:
                raise ValueError(f"{uri} has {found} bytes, not {need}")
            out += [Stretch(field, uri, at, first + at, min(self.span, rows - at)) for at in range(0, rows, self.span)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, path = places.place(partition.uri)
        step = max(1, PIECE // (self.dims * WIDTH))
        with system.open_input_file(path) as source:
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                raw = source.read_at(n * self.dims * WIDTH, (partition.skip + at) * self.dims * WIDTH)
                numbers = np.frombuffer(raw, "<f2").astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.dims + 1, self.dims, dtype=np.int32)), pa.array(numbers))
                first = partition.first + at
                yield pa.RecordBatch.from_arrays([pa.array([partition.field] * n, pa.string()), pa.array(np.arange(first, first + n)), lists], names=["field", "idx", "v"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int, str, str]]


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.dims, self.rows = options["path"].rstrip("/"), int(options["dims"]), int(options["rows"])
        self.fields, self.first, self.step = json.loads(options["fields"]), int(options.get("first", 0)), int(options["step"])
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, staging = places.place(self.staging)
        system.create_dir(staging, recursive=True)
        done: list[tuple[str, int, int, str, str]] = []
        out, field, first, following, digest, name = None, None, 0, 0, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                done.append((field, first, following - first, name, digest.hexdigest()))

        for batch in iterator:
            if not batch.num_rows:
                continue
            fields, idx, vectors = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != self.dims).any():
                raise ValueError(f"a vector has not {self.dims} components")
            numbers = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f2").reshape(-1, self.dims)
            if not np.isfinite(numbers).all():
                raise ValueError("a vector has a component that float16 cannot hold")
            cuts = np.flatnonzero((fields[1:] != fields[:-1]) | (idx[1:] != idx[:-1] + 1) | ((idx[1:] - self.first) % self.step == 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(idx)], strict=True):
                if out is None or fields[a] != field or idx[a] != following or (idx[a] - self.first) % self.step == 0:
                    close()
                    field, first, following, digest = fields[a], int(idx[a]), int(idx[a]), hashlib.sha256()
                    name = f"{self.staging}/{uuid.uuid4().hex}.f16"
                    system, path = places.place(name)
                    out = system.open_output_stream(path)
                raw = numbers[a:b].tobytes()
                out.write(raw)
                digest.update(raw)
                following += b - a
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        for field in self.fields:
            at = self.first
            for _, first, rows, _, _ in (f for f in files if f[0] == field):
                if first != at:
                    raise ValueError(f"{field} has a gap or an overlap at row {min(first, at)}")
                at += rows
            if at != self.first + self.rows:
                raise ValueError(f"{field} has {at - self.first} rows, not {self.rows}")
        if strange := {f[0] for f in files} - set(self.fields):
            raise ValueError(f"unknown fields: {', '.join(sorted(strange))}")
        listed = []
        for field, first, rows, name, sha256 in files:
            system, source = places.place(name)
            if (size := system.get_file_info(source).size) != rows * self.dims * WIDTH:
                raise ValueError(f"{name} has {size} bytes")
            inner = f"{field}/part-{first:012d}-{rows}.f16"
            _, target = places.place(f"{self.path}/{inner}")
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            places.move_over(system, source, target)
            listed.append({"field": field, "file": inner, "first": first, "rows": rows, "sha256": sha256})
        system, beside = places.place(f"{self.path}/{LISTING}.partial")
        with system.open_output_stream(beside) as out:
            out.write(json.dumps({"dims": self.dims, "dtype": "float16", "files": listed}, indent=1, sort_keys=True).encode())
        places.move_over(system, beside, places.place(f"{self.path}/{LISTING}")[1])
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        import pyarrow.fs as fs

        system, staging = places.place(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class HalfMatrix(DataSource):
    """``float16_matrix``: options dims, and files (reading) or path, rows, first, step and fields (writing)."""

    @classmethod
    def name(cls) -> str:
        return "float16_matrix"

    def schema(self) -> str:
        return "field string, idx long, v array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(dict(self.options))


def _registered(spark: SparkSession) -> None:
    from pyspark import cloudpickle

    for module in (sys.modules[__name__], places):  # the planner's Python has no files of the session's
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(HalfMatrix)


def read(spark: SparkSession, files: list[tuple[str, str, int, int]], dims: int, span: int = SPAN) -> DataFrame:
    """(field, idx, v) of files (field, path, first row, rows)."""
    _registered(spark)
    named = [(field, places.qualified(spark, path), first, rows) for field, path, first, rows in files]
    return spark.read.format("float16_matrix").option("files", json.dumps(named)).option("dims", dims).option("span", span).load()


def write(vectors: DataFrame, path: str, fields: Sequence[str], rows: int, dims: int, step: int = SPAN, first: int = 0) -> None:
    """Rows (field, idx, v) as files of ``step`` rows a field; a task writes one of them."""
    _registered(vectors.sparkSession)
    stretch = F.floor((F.col("idx") - first) / step).alias("__stretch")
    numbered = vectors.select("field", F.col("idx").cast("long").alias("idx"), F.col("v").cast("array<float>").alias("v"), stretch)
    dealt = numbered.repartition(max(1, -(-rows // step)) * len(fields), "field", "__stretch").sortWithinPartitions("field", "idx").drop("__stretch")
    options = {"path": places.qualified(vectors.sparkSession, path), "fields": json.dumps(list(fields)), "rows": rows, "dims": dims, "first": first, "step": step}
    dealt.write.format("float16_matrix").options(**options).mode("append").save()


def listing(spark: SparkSession, path: str) -> dict:
    return json.loads(places.read_text(spark, f"{path.rstrip('/')}/{LISTING}"))


def read_listed(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(field, idx, v) of a folder that ``write`` has committed."""
    found = listing(spark, path)
    return read(spark, [(f["field"], f"{path.rstrip('/')}/{f['file']}", f["first"], f["rows"]) for f in found["files"]], found["dims"], span)
