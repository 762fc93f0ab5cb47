"""Point reads of Parquet row groups: only the groups that are asked for are opened and decoded."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import integrity
from ..session import ship
from . import places

#: Rows of a row group that are decoded at a time.
BATCH = 1_024
OFFSETS = "file string, row_group long, first_row long, rows long"


def _listed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    names = [(p.rsplit("/", 1)[-1], p) for p in paths]
    listed = spark.createDataFrame(names, "file string, uri string")
    return listed.repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, row_group, first_row, rows) of Parquet files; executors read the footers, many files at a time."""
    if not paths:
        return spark.createDataFrame([], OFFSETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for name, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = places.place(uri)
                with system.open_input_file(path) as source:
                    footer, first = pq.ParquetFile(source).metadata, 0
                    for g in range(footer.num_row_groups):
                        n = footer.row_group(g).num_rows
                        rows.append({"file": name, "row_group": g, "first_row": first, "rows": n})
                        first += n
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("row_group", pa.int64()), ("first_row", pa.int64()), ("rows", pa.int64())]))

    ship(spark)
    return _listed(spark, paths).mapInArrow(run, OFFSETS)


def _picked(uri: str, group: int, wanted: list[tuple[int, str]], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The wanted rows (row, reference; ascending) of one group, with their reference."""
    import pyarrow.parquet as pq

    system, path = places.place(uri)
    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        if not 0 <= group < file.num_row_groups:
            raise IndexError(f"{uri} has {file.num_row_groups} row groups, not one of number {group}")
        rows = file.metadata.row_group(group).num_rows
        if wanted[0][0] < 0 or wanted[-1][0] >= rows:
            raise IndexError(f"row group {group} of {uri} has {rows} rows, not one of number {wanted[-1][0]}")
        there = [c for c in columns if c in file.schema_arrow.names]
        first, at = 0, 0
        for batch in file.iter_batches(batch_size=BATCH, row_groups=[group], columns=there):
            here = []
            while at < len(wanted) and wanted[at][0] < first + batch.num_rows:
                here.append(wanted[at])
                at += 1
            if here:
                took = batch.take(pa.array([r - first for r, _ in here]))
                arrays = [took.column(c).cast(schema.field(c).type) if c in there else pa.nulls(len(here), schema.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([d for _, d in here], pa.string())], schema=schema)
            if at == len(wanted):
                return
            first += batch.num_rows


def point_read(references: DataFrame, corpus: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Corpus rows of distinct references (doc_ref, file, row_group, row), and doc_ref.

    ``corpus`` is a Parquet scan; ``columns`` are all of its columns or those
    named. The references are dealt by row group and sorted, so a group is
    opened by one task, once, and its rows are decoded BATCH at a time; groups
    without a reference are not read. A file that is not there, a group or a row
    out of range is an error.
    """
    spark = corpus.sparkSession
    paths = corpus.inputFiles()
    names = [p.rsplit("/", 1)[-1] for p in paths]
    if len(set(names)) < len(names):
        raise integrity.IntegrityError("two files of the corpus have one name")
    fields = [f for f in corpus.schema.fields if columns is None or f.name in columns]
    out = T.StructType([*fields, T.StructField("doc_ref", T.StringType())])
    schema, picked = to_arrow_schema(out), [f.name for f in fields]
    wanted = references.select("doc_ref", "file", F.col("row_group").cast("long").alias("row_group"), F.col("row").cast("long").alias("row")).dropDuplicates(["doc_ref"])
    known = wanted.join(_listed(spark, paths) if paths else spark.createDataFrame([], "file string, uri string"), "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for file, uri, group, row, doc_ref in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if uri is None or group is None or row is None:
                    raise FileNotFoundError(f"{doc_ref} names no row of the corpus (file {file})")
                if (uri, group) != key:
                    if held:
                        yield from _picked(*key, held, picked, schema)
                    key, held = (uri, group), []
                held.append((row, doc_ref))
        if held:
            yield from _picked(*key, held, picked, schema)

    ship(spark)
    dealt = known.select("file", "uri", "row_group", "row", "doc_ref").repartition("uri", "row_group").sortWithinPartitions("uri", "row_group", "row", "doc_ref")
    return dealt.mapInArrow(run, out)
