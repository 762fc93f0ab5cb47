"""Stateful streaming exact deduplication (DataFrame operations only).

Arrivals (digest, doc_id, content locator) are a stream. Its keyed state, on
disk in RocksDB and never expired, holds for each digest the row that stays
(largest doc_id, then locator) and how many rows came. Each micro-batch
combines rows before the shuffle, so a hot digest costs one row per task. The
state is read back with the state data source and kept as a written table.

With a ``state`` folder the stream goes on where it ended: the folder keeps
arrivals, contents and the stream's checkpoint, and each call's rows are new
arrivals that are also compared with all earlier ones. A call's rows are a
batch with a name, its own or the digest of its ids and texts. A batch is
committed by the rename of its arrivals; the stream reads committed batches
only. A call that repeats a committed batch (after a failure, say) goes on with
what is staged and adds nothing; one that repeats an uncommitted batch stages
it anew. Without a folder, a call's state is its own.

On hits, digests that came more than once, the full bytes are compared: each
row's text with that of the row its digest points to, fetched by locator and
dealt by (digest, salt). Rows whose bytes differ under one digest are grouped
again by their text, so a collision cannot drop a document.

The locator is the file and row of a Parquet scan; what is no such scan (or is
to be kept with the state) is written first.

Defined results: a null text equals the empty text; a null doc_id is smaller
than any other, and a group of such rows has a null keep_id; of repeated rows
with the largest doc_id one stays, the one whose locator is last; texts of any
length are digested and compared whole, one or two of them held at a time; an
empty table gives an empty result; extra columns are not read, and ``drop_exact``
keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, maybe_in, new_path, release, written

#: Rows of one group that are compared with one copy of the group's text.
SALT_ROWS = 2_000
#: Micro-batches into which the arrivals are cut.
BATCHES = 2
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEEPER = ("doc_id", "file", "at")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def _state(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Runs the stream over the arrivals that it has not seen, and returns its state: digest, keeper, group_size."""
    arrivals, checkpoint = f"{folder}/arrivals", f"{folder}/checkpoint"
    settings = {
        "spark.sql.streaming.stateStore.providerClass": _ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.numRecentProgressUpdates": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        files = spark.read.schema(schema).parquet(f"{arrivals}/*").inputFiles()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-len(files) // BATCHES))).parquet(f"{arrivals}/*")
        seen = stream.groupBy("digest").agg(F.max(F.struct(*_KEEPER)).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        if files:
            seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if not files or spark.read.schema(schema).parquet(f"{arrivals}/*").isEmpty():
            return spark.createDataFrame([], seen.schema)
        state = spark.read.format("statestore").load(checkpoint)
        value = [F.col("value").getField(n) for n in state.schema["value"].dataType.fieldNames()]
        return state.select(F.col("key.digest").alias("digest"), value[0].alias("keeper"), value[1].alias("group_size"))
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _text(row: str = "row") -> Column:
    return F.coalesce(F.col(row).getField("text").cast("string"), F.lit(""))


class _Folder:
    """Batches in a state folder: ``contents/<batch>`` and, once it is committed, ``arrivals/<batch>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.path = spark, root, spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self.files.exists(self.path(f"{self.root}/arrivals/{batch}"))

    def commit(self, arrivals: DataFrame, batch: str) -> None:
        arrivals.write.mode("overwrite").parquet(f"{self.root}/staged/{batch}")
        self.files.mkdirs(self.path(f"{self.root}/arrivals"))
        if not self.files.rename(self.path(f"{self.root}/staged/{batch}"), self.path(f"{self.root}/arrivals/{batch}")):
            raise OSError(f"cannot commit batch {batch}")

    def contents(self, schema, batches: list[str] | None = None) -> DataFrame:
        """Located rows of these batches, or of all committed ones."""
        names = batches or [s.getPath().getName() for s in self.files.listStatus(self.path(f"{self.root}/arrivals"))]
        kept = self.spark.read.schema(schema).parquet(*[f"{self.root}/contents/{n}" for n in names])
        return kept.select("row", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def batch_name(docs: DataFrame) -> str:
    """A name for rows that are the same whenever they come: their number and a sum over their ids and texts."""
    own = F.xxhash64(docs["doc_id"], docs["text"]).cast("decimal(20,0)")
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(own), F.lit(0)).cast("string").alias("sum")).first()
    return f"{found['n']}x{found['sum']}"


def _decided(docs: DataFrame, digest: Callable[[Column], Column], state: str | None, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """Located rows of ``docs``; and (doc_id, file, at, text_sha256, keeper, group_size) of each."""
    spark = docs.sparkSession
    root = state.rstrip("/") if state else new_path(spark, "dedup-state")
    folder, batch = _Folder(spark, root), (batch or batch_name(docs)) if state else "all"
    schema = docs.select(F.struct("*").alias("row")).schema
    if state:
        if not folder.committed(batch):
            docs.select(F.struct("*").alias("row")).write.mode("overwrite").parquet(f"{root}/contents/{batch}")
        base = folder.contents(schema, [batch])
    else:
        base = located(docs, "dedup-input")
    doc_id = F.col("row").getField("doc_id").alias("doc_id")
    slim = written(base.select(doc_id, "file", "at", digest(_text()).alias("digest"), F.sha2(F.encode(_text(), "utf-8"), 256).alias("text_sha256")), "dedup-slim")
    arrivals = slim.select("digest", "doc_id", "file", "at")
    if not folder.committed(batch):
        folder.commit(arrivals, batch)
    every = folder.contents(schema) if state else base
    groups = written(_state(spark, root, arrivals.schema), "dedup-groups")
    hits = written(groups.where("group_size > 1"), "dedup-hits")
    if state:
        hits = written(hits.join(slim.select("digest").distinct(), "digest", "left_semi"), "dedup-hits")
    members = written(
        maybe_in(every.select(doc_id, "file", "at", _text().alias("text"), digest(_text()).alias("digest")), hits, "digest")
        .join(hits.hint("merge"), "digest")
        .withColumn("salts", F.ceil(F.col("group_size") / SALT_ROWS).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("file", "at"), F.col("salts")).cast("int")),
        "dedup-members",
    )
    stays = (F.col("keeper.file") == F.col("file")) & (F.col("keeper.at") == F.col("at"))
    kept = members.where(stays).select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    differ = written(members.join(kept, ["digest", "salt"]).where(F.col("text") != F.col("kept_text")).select("digest").distinct(), "dedup-collisions")
    rows = slim.join(groups, "digest")
    if not differ.isEmpty():
        apart = members.join(differ, "digest", "left_semi")
        by_text = apart.groupBy("digest", "text").agg(F.max(F.struct(*_KEEPER)).alias("k2"), F.count(F.lit(1)).alias("n2"))
        again = written(apart.select("digest", "text", "file", "at").join(by_text, ["digest", "text"]).select("file", "at", "k2", "n2"), "dedup-regrouped")
        rows = rows.join(again, ["file", "at"], "left").withColumn("keeper", F.coalesce("k2", "keeper")).withColumn("group_size", F.coalesce("n2", "group_size"))
    return base, rows.select("doc_id", "file", "at", "text_sha256", "keeper", "group_size")


def _stays() -> Column:
    return (F.col("keeper.file") == F.col("file")) & (F.col("keeper.at") == F.col("at"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and its locator.

    With a ``state`` folder, groups hold all arrivals so far; an earlier arrival
    may have been decided otherwise when it came.
    """
    _, rows = _decided(docs, digest, state, batch)
    return rows.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", _stays().alias("kept"), "text_sha256", F.col("file").alias("locator_file"), F.col("at").alias("locator_row"))


def drop_exact(docs: DataFrame, state: str | None = None, batch: str | None = None) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger doc_id has."""
    base, rows = _decided(docs, sha256, state, batch)
    gone = written(rows.where(~_stays()).select("file", "at"), "dedup-dropped")
    release(docs.sparkSession)
    return base.join(gone, ["file", "at"], "left_anti").select("row.*")
