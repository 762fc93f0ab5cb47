"""Session defaults for local runs and tests; on a cluster the submitter's configuration wins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings the package expects everywhere (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexispark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (local tests), each application gets a fresh folder; on
    anything but a local master a machine-local folder would be wrong, so that
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        application = spark.sparkContext.applicationId
        if application not in _own_dirs:
            _own_dirs[application] = "file://" + tempfile.mkdtemp(prefix="lexispark-")
        found = _own_dirs[application]
    return found.rstrip("/")


def kept(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder and read again, for plans that need costly rows several times."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/lexispark-{label}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def dealt(rows: DataFrame, *keys: str, each: int = 500_000) -> DataFrame:
    """Rows dealt by keys over as many tasks as keep a task's rows near ``each``, whatever the session's number of partitions."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(tasks, *keys)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions within remove their shuffle files when they end; otherwise these stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless their PYTHONPATH has it already."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(package.parent) in known or getattr(context, "_lexispark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lexispark-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._lexispark_shipped = True
