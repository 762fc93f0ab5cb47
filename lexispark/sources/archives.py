"""Members of ZIP archives (wheels and the like) as rows, from their central directories."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import places

MEMBERS = "archive string, member string, size long, crc32 long"


def members(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(archive, member, size, crc32) of all archives; executors read the directories at the files' ends, not what is packed."""
    if not paths:
        return spark.createDataFrame([], MEMBERS)
    listed = spark.createDataFrame([(places.qualified(spark, p),) for p in paths], "uri string").repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = places.place(uri)
                with system.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
                    rows = [{"archive": uri.rsplit("/", 1)[-1], "member": m.filename, "size": m.file_size, "crc32": m.CRC} for m in archive.infolist() if not m.is_dir()]
                yield pa.RecordBatch.from_pylist(rows, schema)

    ship(spark)
    return listed.mapInArrow(run, MEMBERS)


def member_problems(found: DataFrame, required: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """(archive, member, problem): members that an archive lacks (``required``, by name), and those it must not hold (``forbidden``, LIKE patterns)."""
    wanted = F.array(*map(F.lit, required)).cast("array<string>")
    lacks = found.groupBy("archive").agg(F.collect_set(F.when(F.col("member").isin(list(required)), F.col("member"))).alias("held")).select("archive", F.explode(F.array_except(wanted, "held")).alias("member"), F.lit("missing").alias("problem"))
    bad = reduce(lambda a, b: a | b, [F.col("member").like(p) for p in forbidden], F.lit(False))
    return lacks.unionByName(found.where(bad).select("archive", "member", F.lit("forbidden").alias("problem")).distinct())
