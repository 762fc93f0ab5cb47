"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

A line's key is the line without white space at its ends, A-Z lower-cased; its
hash is 128 bits of the key's SHA-256. Documents come in batches, those with
larger doc_ids first. The store keeps sorted runs of (hash, documents, top): in
how many documents a key has been seen and the largest doc_id among them. A new
batch's keys are merge-anti-joined with the keys that the runs have settled
(seen in ``at_least`` documents or more, so nothing about them can change);
what is left is added as a run of level 0. FANOUT runs of a level are compacted
into one of the next, so a key lies in few runs and the store is rewritten a
logarithmic number of times. A common line therefore costs one row per batch
before the shuffle and none once it is settled.

When all batches are in, the runs are compacted once more. A line goes if its
key was seen in ``at_least`` documents and its doc_id is not the key's top.
The lines of a hot key are joined with its one row by a plain merge join, whose
skewed partitions Spark splits; what is gathered belongs to one document.

``LineStore`` keeps its runs in a folder, so later calls continue it: each
``add`` names its batch, is written aside and committed by a rename, and a
batch that was added before is not added again.

Defined results: a null text is one empty line; a null doc_id is smaller than
any other; rows that share the largest doc_id all keep their lines, and each
row counts as a document; a line that a document holds several times counts
once and goes or stays as a whole; keys shorter than ``shortest`` code points
are never dropped; texts of any length are read whole, a document's distinct
keys being held in one row; an empty table gives an empty result; extra columns
are not read, and ``drop_lines`` keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, located, maybe_in, new_path, written

#: Least code points of a key, least documents that hold it.
SHORTEST, AT_LEAST = 20, 3
#: Batches of a table, runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 4, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"
_ROW = ["part", "at"]
_RUN = "hash binary, documents long, top long"


def lines(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def key_hash(line: Column, shortest: int = SHORTEST) -> Column:
    """128 bits for a line that may be dropped; null for a shorter one."""
    long = F.length(F.btrim(line, F.lit(_SPACE))) >= shortest
    return F.when(long, F.substring(F.unhex(F.sha2(F.encode(key(line), "utf-8"), 256)), 1, 16))


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


class LineStore:
    """Sorted runs of line hashes in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str | None = None, at_least: int = AT_LEAST, fanout: int = FANOUT):
        self.spark, self.folder, self.at_least, self.fanout = spark, (folder or new_path(spark, "line-store")).rstrip("/"), at_least, fanout
        place = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self._path(self.folder))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self._path(self.folder)))

    def runs(self) -> list[tuple[int, str, tuple[str, ...]]]:
        """(level, name, batches) of the committed runs; a run whose batches a higher one holds is left out."""
        found = [(int(level), n, tuple(batches.split("+"))) for n in self._names() if n.startswith("run-") for level, batches in [n.removeprefix("run-").split("-", 1)]]
        out: list[tuple[int, str, tuple[str, ...]]] = []
        for level, name, batches in sorted(found, reverse=True):
            if not any(set(batches) <= set(b) for _, _, b in out):
                out.append((level, name, batches))
        return out[::-1]

    def batches(self) -> set[str]:
        return {b for _, _, batches in self.runs() for b in batches}

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.range(0).selectExpr("cast(null as binary) AS hash", "id AS documents", "id AS top")
        return self.spark.read.schema(_RUN).parquet(*[f"{self.folder}/{n}" for n in names])

    def _commit(self, rows: DataFrame, level: int, batches: tuple[str, ...]) -> None:
        """Write a run aside, sorted by hash, and rename it: a run is there whole or not at all."""
        aside = f"{self.folder}/aside-{level}-{'+'.join(batches)}"
        rows.sortWithinPartitions("hash").write.mode("overwrite").parquet(aside)
        self.files.rename(self._path(aside), self._path(f"{self.folder}/run-{level}-{'+'.join(batches)}"))

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hash").agg(F.sum("documents").alias("documents"), F.max("top").alias("top"))

    def state(self) -> DataFrame:
        """hash, documents, top over all runs."""
        return self.merged(self._read([n for _, n, _ in self.runs()]))

    def settled(self) -> DataFrame:
        return self.state().where(F.col("documents") >= self.at_least)

    def add(self, seen: DataFrame, batch: str) -> None:
        """Add a batch of (hash, top), a row for each document and distinct key. A batch of this name is added once.

        Batches whose doc_ids are larger have to come first: keys that are
        settled are not looked at again.
        """
        if not batch.isalnum():
            raise ValueError("a batch is named by letters and digits")
        if batch in self.batches():
            return
        mine = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("documents"), F.max("top").alias("top"))
        known = self.runs()
        new = mine.join(self.settled().select("hash").hint("merge"), "hash", "left_anti") if known else mine
        self._commit(new, 0, (batch,))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(same := [(n, b) for lv, n, b in self.runs() if lv == level]) >= self.fanout:
            self._commit(self.merged(self._read([n for n, _ in same])), level + 1, tuple(x for _, b in same for x in b))
            for name, _ in same:
                self.files.delete(self._path(f"{self.folder}/{name}"), True)
            level += 1

    def drop(self) -> None:
        self.files.delete(self._path(self.folder), True)


def _bounds(ids: DataFrame, batches: int) -> list[float]:
    """Doc_ids that cut the table into about equal batches; which ones they are changes no result."""
    inner = [] if batches < 2 or ids.isEmpty() else ids.approxQuantile("top", [i / batches for i in range(1, batches)], 0.01)
    return [float("-inf"), *sorted(set(inner)), float("inf")]


def gone_lines(rows: DataFrame, shortest: int = SHORTEST, at_least: int = AT_LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(part, at, gone): the numbers of the lines that a row loses, in order; from (part, at, doc_id, text)."""
    store = LineStore(rows.sparkSession, None, at_least, fanout)
    hashes = F.transform(lines(F.col("text")), lambda x: key_hash(x, shortest)).alias("hashes")
    slim = written(rows.select(*_ROW, _order(F.col("doc_id")).alias("top"), hashes).where(F.exists("hashes", lambda h: h.isNotNull())), "line-hashes")
    cuts = _bounds(slim, batches)
    for i in range(len(cuts) - 2, -1, -1):
        some = slim.where((F.col("top") >= cuts[i]) & (F.col("top") < cuts[i + 1]))
        store.add(some.select(F.explode(F.array_distinct("hashes")).alias("hash"), "top").where("hash is not null"), f"b{i}")
    settled = written(store.settled().select("hash", F.col("top").alias("keeper")), "line-settled")
    each = slim.select(*_ROW, "top", F.posexplode("hashes").alias("line", "hash"))
    found = maybe_in(each, settled, "hash").join(settled.hint("merge"), "hash").where("top < keeper")
    out = written(found.groupBy(*_ROW).agg(F.array_sort(F.collect_list("line")).alias("gone")), "line-gone")
    drop(slim, settled)
    store.drop()
    return out


def stay(text: Column, gone: Column) -> Column:
    """The lines whose numbers are not in ``gone`` (ascending), in time linear in both."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.size(gone) - 1))
    marks = F.encode(F.array_join(F.zip_with(gone, before, lambda p, q: F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1"))), ""), "utf-8")
    return F.filter(lines(text), lambda _, i: F.substring(marks, i + 1, F.lit(1)) != F.lit(b"1"))


def _judged(docs: DataFrame, shortest: int, at_least: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may lose lines, with ``gone``; and the others."""
    located_rows = located(docs, "line-input").withColumn("part", F.xxhash64("file"))
    clash = located_rows.groupBy("part").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b")
    if not clash.isEmpty():
        raise ValueError("two file names share a hash; write the input under other names")
    rows = located_rows.select(*_ROW, "row", F.col("row").getField("doc_id").cast("long").alias("doc_id"), F.col("row").getField("text").cast("string").alias("text"))
    found = gone_lines(rows.drop("row"), shortest, at_least)
    return maybe_in(rows, found, _ROW).join(found.hint("merge"), _ROW, "left"), maybe_in(rows, found, _ROW, other=True)


def line_table(docs: DataFrame, shortest: int = SHORTEST, at_least: int = AT_LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs``."""
    some, rest = _judged(docs, shortest, at_least)
    kept = F.when(F.col("gone").isNull(), lines(F.col("text"))).otherwise(stay(F.col("text"), F.col("gone")))
    counted = some.select("doc_id", F.size(lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.array_join(kept, "\n"), 256).alias("kept_sha256"))
    whole = rest.select("doc_id", F.size(lines(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return counted.union(whole)


def drop_lines(docs: DataFrame, shortest: int = SHORTEST, at_least: int = AT_LEAST) -> DataFrame:
    """``docs`` without the repeated lines; texts that lose none stay as they are."""
    some, rest = _judged(docs, shortest, at_least)
    text = next(c for c in docs.columns if c.lower() == "text")
    shorter = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay(F.col("text"), F.col("gone")), "\n"))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return some.select(*[shorter.alias(c) if c == text else x for c, x in zip(docs.columns, columns, strict=True)]).union(rest.select(*columns))
