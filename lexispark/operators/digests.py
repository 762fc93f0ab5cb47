"""Digests of files and trees, and checks of artifacts against a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from ..sources import places


#: Bytes of a file that are read at a time.
BLOCK = 8 << 20


def file_digests(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path relative to root, size, sha256) of all files below ``root``, of any size and number.

    Executors list the folders of ``root``, each with all that is below it, and
    read the files, which are dealt anew, block by block. The driver lists nothing.
    """
    hadoop, held = places.hadoop(spark, root)
    if not hadoop.exists(held):
        raise FileNotFoundError(root)
    base, only = places.qualified(spark, root).rstrip("/"), None
    if hadoop.getFileStatus(held).isFile():
        base, only = base.rsplit("/", 1)
    listing = "path string, size long, folder boolean"

    def entry(top: str, info) -> tuple[str, int, bool]:
        return info.path.rstrip("/")[len(top.rstrip("/")) + 1 :], info.size or 0, not info.is_file

    def rows(entries: list[tuple[str, int, bool]]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(entries), 4_096):
            part = entries[at : at + 4_096]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.string()), pa.array([e[1] for e in part], pa.int64()), pa.array([e[2] for e in part], pa.bool_())], names=["path", "size", "folder"])

    def wanted(path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return not name.startswith((".", "_")) and (not glob or fnmatch(name, glob))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        for batch in batches:
            if batch.num_rows:
                system, top = places.place(base)
                infos = [system.get_file_info(f"{top.rstrip('/')}/{only}")] if only else system.get_file_info(fs.FileSelector(top))
                found = [entry(top, i) for i in infos]
                yield from rows([e for e in found if e[2] or wanted(e[0])])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        system, top = places.place(base)
        for batch in batches:
            out = []
            for path, size, folder in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not folder:
                    out.append((path, size, False))
                    continue
                found = [entry(top, i) for i in system.get_file_info(fs.FileSelector(f"{top.rstrip('/')}/{path}", recursive=True))]
                out += [e for e in found if not e[2] and wanted(e[0])]
            yield from rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = places.place(base)
        for batch in batches:
            digests_ = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with system.open_input_stream(f"{top.rstrip('/')}/{path}") as source:
                    while block := source.read(BLOCK):
                        digest.update(block)
                digests_.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests_, pa.string())], names=["path", "size", "sha256"])

    ship(spark)
    deals = 4 * spark.sparkContext.defaultParallelism
    files = spark.range(1, numPartitions=1).mapInArrow(first, listing).repartition(deals, "path").mapInArrow(below, listing)
    return files.select("path", "size").repartition(deals, "path").mapInArrow(run, "path string, size long, sha256 string")


def tree_digest(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a tree (``by``): SHA-256 over path NUL digest of its files by path component, their number and bytes.

    The digest runs over the files in order, so a tree is one task's; it streams
    over sorted rows, which are sorted on disk if they are many.
    """
    by = by or []
    ship(files.sparkSession)
    kinds = files.select(*by).schema
    schema = T.StructType([*kinds.fields, T.StructField("sha256", T.StringType()), T.StructField("files", T.LongType()), T.StructField("bytes", T.LongType())])
    width = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, count, size, out = None, None, 0, 0, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if digest is None or row[:width] != key:
                    if digest is not None:
                        out.append((*key, digest.hexdigest(), count, size))
                    key, digest, count, size = row[:width], hashlib.sha256(), 0, 0
                digest.update(row[width].encode() + b"\0" + row[width + 1].encode())
                count, size = count + 1, size + row[width + 2]
        if digest is not None:
            out.append((*key, digest.hexdigest(), count, size))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], to_arrow_schema(schema))

    rows = files.select(*by, "path", "sha256", F.col("size").cast("long").alias("size"))
    dealt = rows.repartition(*by) if by else rows.repartition(1)
    return dealt.sortWithinPartitions(*by, F.split("path", "/")).mapInArrow(run, schema)


def verify_artifacts(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Each artifact with the first reason it fails: missing, size, file count, digest; null if it is right.

    manifest: (id, path, size, sha256, file_count); found: (path, size, sha256, files).
    """
    joined = manifest.join(found.withColumnsRenamed({"size": "__size", "sha256": "__sha", "files": "__files"}), "path", "left")
    reason = (
        F.when(F.col("__sha").isNull(), "missing")
        .when(F.col("__size") != F.col("size"), "size differs")
        .when(F.col("file_count").isNotNull() & (F.col("__files") != F.col("file_count")), "file count differs")
        .when(F.col("__sha") != F.col("sha256"), "digest differs")
    )
    return joined.select("id", "path", reason.alias("reason"))


def hash_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Names whose pinned and actual digests differ, or that one side lacks (name, sha256)."""
    both = expected.withColumnRenamed("sha256", "expected").join(actual.withColumnRenamed("sha256", "actual"), "name", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def path_problems(files: DataFrame, limit: int) -> DataFrame:
    """Files that are too large, or lie where a repository should hold none."""
    bad = F.when(F.col("size") > limit, "too large").when(F.rlike("path", F.lit(r"(^|/)(__pycache__|node_modules|\.venv|dist|build)/")), "generated path").when(F.rlike("path", F.lit(r"(^|/)\.env(\.|$)")), "environment file")
    return files.withColumn("problem", bad).where("problem IS NOT NULL").select("path", "problem")
