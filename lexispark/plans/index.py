"""Building a five-view dense index: plan, document views, encoding in committed ranges, publication."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonrepair import repair_json
from ..functions.text import CITATION_FIELDS, FULLTEXT_FIELDS, clean, document_citations, encoder_text, fulltext_view, join_list
from ..operators import candidates, digests, integrity
from ..operators.fusion import VIEWS
from ..session import ship
from ..sources import matrices, places, readers, rowgroups, sinks

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class EncodingConfig:
    """Settings of an encoder; a model without a fixed revision would give an index that cannot be made again."""

    model: str
    model_revision: str
    batch_size_short: int = 256
    batch_size_fulltext: int = 32
    max_length_short: int = 1_024
    max_length_fulltext: int = 8_192
    checkpoint_rows: int = 10_000

    def __post_init__(self):
        if not self.model.strip():
            raise ValueError("the model must not be blank")
        if not self.model_revision.strip() or self.model_revision == "SET_IMMUTABLE_REVISION":
            raise ValueError("an immutable model revision is needed")
        sizes = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("model", "model_revision")}
        if bad := [name for name, value in sizes.items() if value <= 0]:
            raise ValueError("must be positive: " + ", ".join(bad))


def plan(spark: SparkSession, corpus: str, views: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Numbered view records, row-group offsets and input digests, all checked before anything is encoded."""
    offsets = candidates.row_group_offsets(spark, spark.read.parquet(corpus).inputFiles())
    records = readers.document_views(spark, views, limit)
    integrity.require(readers.view_record_violations(records, offsets))
    return records, offsets, _digests(spark, corpus, views)


def document_texts(records: DataFrame, corpus: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """(global_idx, five views) of the records' corpus rows, read by row group, and generated fields."""
    wanted = records.select(candidates.locator(F.col("source_file"), F.col("row_group"), F.col("row_index")).alias("doc_ref"), F.col("source_file").alias("file"), "row_group", F.col("row_index").alias("row"), "global_idx", "content")
    rows = rowgroups.point_read(wanted, corpus)
    for c in FULLTEXT_FIELDS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    joined = rows.join(wanted.select("doc_ref", "global_idx", "content"), "doc_ref").withColumn("__g", repair_json("content"))
    declared = [join_list(F.col(c)) if dict(rows.dtypes)[c].startswith("array") else clean(F.col(c)) for c in CITATION_FIELDS if c in rows.columns]
    return joined.select(
        "global_idx",
        clean(F.col("__g.normal_query")).alias("normal_query"),
        clean(F.col("__g.meta_searchterm_de")).alias("meta_searchterm"),
        F.concat_ws(" ; ", F.nullif(join_list(F.col("__g.keywords_de")), F.lit("")), F.nullif(join_list(F.col("__g.keywords_en")), F.lit(""))).alias("keywords"),
        fulltext_view().alias("fulltext"),
        document_citations(declared).alias("citations"),
    )


def encoded(texts: DataFrame, make_encoder: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """(field, idx, v) of all views; an encoder is made once a worker and sees ``batch`` texts at a time."""
    ship(texts.sparkSession)
    views = F.array(*[F.struct(F.lit(v).alias("field"), encoder_text(F.col(v)).alias("text")) for v in VIEWS])
    long = texts.select(F.col("global_idx").alias("idx"), F.explode(views).alias("x")).select("x.field", "idx", "x.text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for rows in batches:
            vectors = []
            for at in range(0, len(rows), batch):
                vectors += [[float(x) for x in v] for v in encoder(rows["text"].iloc[at : at + batch].tolist())]
            yield pd.DataFrame({"field": rows["field"], "idx": rows["idx"], "v": vectors})

    return long.mapInPandas(run, "field string, idx long, v array<float>")


#: Of the build ledger's form, and of the text that the views of a document make.
LEDGER_VERSION, TEXT_CONTRACT = 1, "document_views_v1"


@dataclass
class Ledger:
    """What a build has committed: one small document, rewritten in one step after each range.

    ``committed`` holds inclusive stretches of range numbers, so it stays short
    however many ranges there are.
    """

    schema_version: int
    fingerprint: str
    rows: int
    dimensions: int
    step: int
    staged: bool
    committed: list[list[int]]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ledger:
        try:
            found = json.loads(places.read_text(spark, path))
            ledger = cls(**found)
        except Exception as error:
            raise integrity.IntegrityError(f"invalid build ledger: {path}") from error
        if ledger.schema_version != LEDGER_VERSION:
            raise integrity.IntegrityError(f"unknown version of a build ledger: {ledger.schema_version}")
        last = -(-ledger.rows // ledger.step) - 1
        ends = [x for pair in ledger.committed for x in pair]
        if ends != sorted(ends) or any(not 0 <= x <= last for x in ends) or (ledger.committed and not ledger.staged):
            raise integrity.IntegrityError("the build ledger commits ranges that the index does not have")
        return ledger

    def save(self, spark: SparkSession, path: str) -> None:
        sinks.write_json(spark, path, asdict(self))

    def has(self, number: int) -> bool:
        return any(a <= number <= b for a, b in self.committed)

    def commit(self, number: int) -> None:
        merged: list[list[int]] = []
        for a, b in sorted([*self.committed, [number, number]]):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        self.committed = merged


def fingerprint(pinned: dict, rows: int, manifest: dict, dimensions: int, step: int) -> str:
    """Digest of everything that a resumed build must have in common with the one it goes on with."""
    payload = {"inputs": pinned, "rows": rows, "encoding": manifest, "dimensions": dimensions, "step": step, "fields": list(VIEWS), "dtype": "float16", "text_contract": TEXT_CONTRACT}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def encoder_dimensions(spark: SparkSession, make_encoder: Callable[[], Encoder]) -> int:
    """Components of the encoder's vectors, as a worker makes them; all views must agree."""
    probe = spark.range(1).select(F.lit(0).cast("long").alias("global_idx"), *[F.lit("").alias(v) for v in VIEWS])
    sizes = {r["n"] for r in encoded(probe, make_encoder).select(F.size("v").alias("n")).collect()}
    if len(sizes) != 1 or min(sizes) <= 0:
        raise integrity.IntegrityError(f"the encoder's vectors have {sorted(sizes)} components")
    return sizes.pop()


def _digests(spark: SparkSession, corpus: str, views: str) -> dict:
    return {name: digests.tree_digest(digests.file_digests(spark, root)).first().asDict() for name, root in (("corpus", corpus), ("views", views))}


def build(spark: SparkSession, corpus: str, views: str, output: str, make_encoder: Callable[[], Encoder], manifest: dict, step: int = 10_000, resume: bool = False, sitting: int | None = None) -> dict:
    """Encodes ranges of ``step`` rows, each committed on its own, and publishes the manifest last.

    Records are numbered and joined to their documents once and staged by range,
    so a range reads its own rows only. The ledger is written before the first
    range and after each one. ``resume`` goes on with a build that was
    interrupted: its ledger must carry the fingerprint of these inputs, settings
    and dimensions, and there must be no manifest; ranges that are not in the
    ledger are made anew, whatever was left of them. ``sitting`` ends a call
    after so many ranges; the next one resumes. Inputs are digested again before
    publication. The matrices are files of raw float16, ``step`` rows each.
    """
    ledger_path, texts_path = f"{output}/_state/ledger.json", f"{output}/_state/texts"
    if resume:
        if places.exists(spark, f"{output}/manifest.json"):
            raise FileExistsError(f"{output} is published")
        readers.exists(spark, ledger_path, "build ledger")
    else:
        sinks.refuse_non_empty(spark, output)
    if step <= 0:
        raise ValueError("step must be positive")
    records, offsets, pinned = plan(spark, corpus, views)
    total, dimensions = records.count(), encoder_dimensions(spark, make_encoder)
    if manifest.get("dims", dimensions) != dimensions:
        raise integrity.IntegrityError(f"the encoder makes {dimensions} components, the manifest says {manifest['dims']}")
    own = fingerprint(pinned, total, manifest, dimensions, step)
    if resume:
        ledger = Ledger.load(spark, ledger_path)
        if (ledger.fingerprint, ledger.rows, ledger.dimensions, ledger.step) != (own, total, dimensions, step):
            raise integrity.IntegrityError("the build was begun with other inputs or settings")
    else:
        ledger = Ledger(LEDGER_VERSION, own, total, dimensions, step, False, [])
        ledger.save(spark, ledger_path)
    if not ledger.staged:
        texts = document_texts(records, spark.read.parquet(corpus), offsets)
        flags = sinks.nonempty_map(list(VIEWS)).alias("nonempty")
        ranged = records.drop("content").join(texts.select("*", flags), "global_idx").withColumn("range", F.floor(F.col("global_idx") / step))
        ranged.repartition("range").sortWithinPartitions("range", "global_idx").write.mode("overwrite").partitionBy("range").parquet(texts_path)
        ledger.staged = True
        ledger.save(spark, ledger_path)
    staged = spark.read.parquet(texts_path)
    left = [number for number in range(-(-total // step)) if not ledger.has(number)]
    for number in left[:sitting]:
        rows = spark.read.parquet(f"{texts_path}/range={number}")
        encoded(rows.select("global_idx", *VIEWS), make_encoder).write.mode("overwrite").partitionBy("field").parquet(f"{output}/parts/from={number * step}")
        ledger.commit(number)
        ledger.save(spark, ledger_path)
    if sitting is not None and sitting < len(left):
        return asdict(ledger)
    if _digests(spark, corpus, views) != pinned:
        raise integrity.IntegrityError("the inputs changed while the index was built")
    vectors = spark.read.parquet(f"{output}/parts").select("field", "idx", "v")
    matrices.write(vectors, f"{output}/matrices", VIEWS, total, dimensions, step)
    staged.drop("range", *VIEWS).write.mode("overwrite").parquet(f"{output}/metadata")
    files = matrices.listing(spark, f"{output}/matrices")["files"]
    full = manifest | {"rows": total, "dims": dimensions, "fields": list(VIEWS), "dtype": "float16", "inputs": pinned, "fingerprint": own, "matrices": files}
    sinks.write_json(spark, f"{output}/manifest.json", full)
    return full
