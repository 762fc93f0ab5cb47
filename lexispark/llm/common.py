"""What several operators share: the shared folder, written intermediate tables, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..session import ship as ship_code

#: A word, for every operator that counts or compares words.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/lexispark-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage in a way that survives lost executors, and the
    reader knows the size, so the planner broadcasts what is small only.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start like ``names`` and that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a Parquet scan and nothing else, so that file and row number find a row again."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower()


def located(docs: DataFrame, label: str = "input", path: str | None = None) -> DataFrame:
    """struct ``row`` with all columns of ``docs``, and ``file`` and ``at`` that find a row again.

    They are the file and row number of a Parquet scan; what is not such a scan
    (or where a ``path`` to keep it is given) is written first.
    """
    if path or not is_scan(docs):
        docs = written(docs.select(F.struct("*").alias("row")), label, path).select("row", "_metadata")
        return docs.select("row", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.select(F.struct("*").alias("row"), docs.metadataColumn("_metadata").alias("__m")).select("row", F.col("__m.file_path").alias("file"), F.col("__m.row_index").alias("at"))


def drop(*tables: DataFrame) -> None:
    """Remove written tables that no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of finished steps' shuffle files.

    Executors delete them when the driver's garbage collector finds their
    handles dead; with a large heap that is hours later, so disks would hold
    every step's exchange at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_bits(text: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of an md5 text from ``start`` (1-based) as a long."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("long")


#: Bitmaps of ``maybe_in``: BUCKETS rows of 4 KB at most, whatever the corpus.
BUCKETS, _BITS = 1_024, 32_768


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str | list[str], other: bool = False) -> DataFrame:
    """The rows whose ``key`` may be among those of ``wanted``, so that a join need not deal out the rest.

    The filter is a broadcast bitmap of bounded size: it never loses a row, and
    with many more keys than bits it only lets more rows pass. ``other``: the
    rows that are surely not among them, null keys included.
    """
    keys = [key] if isinstance(key, str) else key
    place = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * _BITS))
    bucket = lambda p: (p / _BITS).cast("int").alias("__bucket")
    bitmaps = wanted.select(place.alias("p")).groupBy(bucket(F.col("p"))).agg(F.bitmap_construct_agg((F.col("p") % _BITS).cast("long")).alias("__bits"))
    bit = F.col("__place") % _BITS
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("__place", place).withColumn("__bucket", bucket(F.col("__place")))
    found = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    for k in keys:
        found &= F.col(k).isNotNull()
    return placed.join(F.broadcast(bitmaps), "__bucket", "left").where(~found if other else found).drop("__place", "__bucket", "__bits")


#: Most rows and bytes of an Arrow batch between the JVM and Python: texts may be long, and each batch is held on both sides.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers: importable code, and Arrow batches bounded in rows and bytes.

    The bounds are the session's settings, as Spark reads them when a query
    runs; lower ones are left as they are.
    """
    ship_code(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        size = re.fullmatch(r"(\d+)b?", str(spark.conf.get(key)).lower())
        if not size or not 0 < int(size[1]) <= most:
            spark.conf.set(key, str(most))


def tidied(run):
    """A function over a task's batches that tidies up when the task has read its last one."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        tidy()

    return wrapped


def tidy() -> None:
    """Give memory that a task's Python code has freed back to the system.

    Workers outlive their tasks and share a container with the JVM, which
    kills the executor if a worker keeps the most it ever held.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
