"""Sinks: JSON lines, JSON documents, submissions, indexes, manifests, event streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from ..session import ship
from . import places


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines with sorted keys and nulls kept, written beside and renamed when complete."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.partial"
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(staged, compression=compression)
    places.replace_folder(spark, staged, path)


def write_files(rows: DataFrame, root: str) -> int:
    """A file below ``root`` for each row (folder, name, text), written by the executors; how many there are.

    Names must differ within a folder. A task that is repeated writes its files again.
    """
    spark = rows.sparkSession
    ship(spark)
    base = places.qualified(spark, root).rstrip("/")

    def run(batches):
        system, top = places.place(base)
        made = set()
        for batch in batches:
            for folder, name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if folder not in made:
                    system.create_dir(f"{top}/{folder}", recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{folder}/{name}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    texts = rows.select(F.col("folder").cast("string").alias("folder"), "name", F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartition(4 * spark.sparkContext.defaultParallelism, "folder")
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file: written beside, synced, then renamed over the old one, which stays whole until then."""
    places.write_file(spark, path, text.encode())


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """An indented document with sorted keys; numbers that are no JSON are an error."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n")


def write_documents(rows: DataFrame, root: str) -> int:
    """A file for each row (path below ``root``, text), written by the executors beside and renamed; returns how many. Paths must differ."""
    base = places.qualified(rows.sparkSession, root).rstrip("/")
    integrity.require(integrity.duplicates(rows, ["path"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = places.place(f"{base}/{name}")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                beside = f"{path}.{uuid.uuid4().hex}.partial"
                with system.open_output_stream(beside) as out:
                    out.write(text.encode())
                places.move_over(system, beside, path)
            yield batch.select(["path"])

    ship(rows.sparkSession)
    return rows.select("path", "text").mapInArrow(run, "path string").count()


def refuse_non_empty(spark: SparkSession, path: str, allowed: tuple[str, ...] = ()) -> None:
    """An output folder must be new or empty, or hold names that a resumed run may find."""
    fs, place = _fs(spark, path)
    if fs.exists(place):
        strange = sorted({s.getPath().getName() for s in fs.listStatus(place)} - set(allowed))
        if strange:
            raise FileExistsError(f"{path} holds {', '.join(strange[:5])}")


def submission_rows(queries: DataFrame, predictions: DataFrame) -> DataFrame:
    """(query_id, predicted_citations) of every query in order; sorted distinct citations joined by ``;``."""
    own = predictions.select("query_id", F.array_join(F.array_sort(F.array_distinct("citations")), ";").alias("predicted_citations"))
    return queries.select("query_id", "ordinal").join(own, "query_id", "left").fillna("", ["predicted_citations"]).orderBy("ordinal").select("query_id", "predicted_citations")


def write_submission(queries: DataFrame, predictions: DataFrame, path: str) -> None:
    """The submission as one CSV with a byte-order mark. It has a row a query, which the driver streams through."""

    def quoted(value: str) -> str:
        return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\r\n') else value

    lines = ["query_id,predicted_citations"]
    lines += [f"{quoted(r[0])},{quoted(r[1])}" for r in submission_rows(queries, predictions).toLocalIterator()]
    write_text(queries.sparkSession, path, "﻿" + "\n".join(lines) + "\n")


def write_index(vectors: DataFrame, metadata: DataFrame, manifest: dict, path: str) -> None:
    """An index of (field, idx, v) as Parquet by field, its metadata, and the manifest last."""
    from ..functions.vectors import vector_problem

    spark = vectors.sparkSession
    refuse_non_empty(spark, path)
    bad = vectors.select("field", "idx", vector_problem(F.col("v"), manifest["dims"]).alias("message")).where("message IS NOT NULL")
    integrity.require(bad.select(F.lit("vector").alias("rule"), F.concat_ws("::", "field", F.col("idx").cast("string")).alias("key"), "message"))
    vectors.write.partitionBy("field").parquet(f"{path}/vectors")
    metadata.write.parquet(f"{path}/metadata")
    write_json(spark, f"{path}/manifest.json", manifest)


def resumable(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no committed row covers."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def nonempty_map(columns: list[str]) -> Column:
    """map(view, whether it has text) of a document's views."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.coalesce(F.trim(F.col(c)) != "", F.lit(False)))])


def row_offsets(metadata: DataFrame) -> DataFrame:
    """(view_file, first, rows) of an index's rows."""
    return metadata.groupBy("view_file").agg(F.min("global_idx").alias("first"), F.count(F.lit(1)).alias("rows"))


def sse_frames(kind: Column, payload: Column) -> Column:
    """A server-sent event: its type and its payload as JSON."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def relative_path(path: Column, root: str) -> Column:
    """A path below ``root`` as it is from there; of any other path only the name is told."""
    below = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(below)), F.substring(path, len(below) + 1, 1 << 30)).otherwise(F.concat(F.lit("<external>/"), F.element_at(F.split(path, "/"), -1)))


def provenance(files: DataFrame) -> dict:
    """What a manifest says of its inputs (name, path, sha256, bytes, files); a row an input."""
    return {r["name"]: {"path": r["path"].rsplit("/", 1)[-1], "sha256": r["sha256"], "bytes": r["bytes"], "files": r["files"]} for r in files.collect()}


def markdown_report(title: str, sections: dict[str, list[tuple[str, object]]]) -> str:
    """A report of figures; floats have six decimals."""
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    parts = [f"# {title}"]
    for name, rows in sections.items():
        parts += [f"\n## {name}\n", "| Measure | Value |", "|---|---|", *[f"| {k} | {show(v)} |" for k, v in rows]]
    return "\n".join(parts) + "\n"
