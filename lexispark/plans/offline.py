"""The offline run: saved rankings or an index, documents, sparse support, scores, gate, submission, metrics.

One lazy plan from end to end; actions happen at integrity checks, at sinks,
and where scores come from outside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import all_citations, with_citations
from ..functions.text import query_views, split_citations
from ..operators import candidates, fusion, gate, integrity, metrics, support, verify
from ..session import dealt, kept, shuffles_removed
from ..sources import readers, sinks


@dataclass(frozen=True)
class Settings:
    """What a run is configured by; 0 or missing values in a file mean these defaults."""

    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.VIEW_WEIGHTS))
    rrf_k: int = fusion.RRF_K
    per_view: int = fusion.PER_VIEW
    fused: int = fusion.FUSED
    top_n: int = 10
    batch: int = 5
    policy: gate.Policy = gate.Policy()
    model: str = ""

    @classmethod
    def from_config(cls, config: dict) -> Settings:
        retrieval, reranking, rules = (config.get(n) or {} for n in ("retrieval", "reranking", "citation_gate"))
        number = readers.positive
        weights = retrieval.get("weights") or dict(fusion.VIEW_WEIGHTS)
        if set(weights) != set(fusion.VIEWS):
            raise ValueError(f"weights must name exactly {', '.join(fusion.VIEWS)}")
        policy = gate.Policy(
            number(rules, "candidate_top_k", 10), number(rules, "minimum_dense_votes", 4), number(rules, "anchor_top_k", 3), float(rules.get("anchor_minimum_score") or 8.5), number(rules, "minimum_bm25_votes", 2), number(rules, "bm25_top_k", 5)
        )
        return cls(weights, number(retrieval, "rrf_k", 60), number(retrieval, "per_view_top_k", 1000), number(retrieval, "fusion_top_k", 1000), number(reranking, "top_n", 10), number(reranking, "batch_size", 5), policy, str(reranking.get("model") or ""))


@dataclass
class Result:
    """Tables of a run."""

    retrieved: DataFrame
    prepared: DataFrame
    support: DataFrame
    scores: DataFrame
    decisions: DataFrame
    predictions: DataFrame
    metrics: DataFrame | None


def retrieve_saved(queries: DataFrame, rankings: DataFrame, settings: Settings) -> DataFrame:
    """Fused candidates of saved rankings, after their rules: rank, score, per-view details and metadata.

    The rules and the fusion read the rankings several times, so costly ones are kept before.
    """
    with shuffles_removed(rankings.sparkSession):
        integrity.require(fusion.saved_ranking_violations(rankings, queries))
    views = F.array(*map(F.lit, fusion.VIEWS))
    hits = rankings.select("query_id", F.array_position(views, F.col("field")).cast("byte").alias("view"), F.col("rank").alias("position"), F.col("doc_id").alias("doc_ref"), "score", "metadata")
    # Dealt once by query, which groups and ranks need; a document has one metadata object, so its own hits have it.
    hits = dealt(hits, "query_id", each=1_000_000).withColumn("source", F.element_at(views, F.col("view").cast("int")))
    also = {"hits": fusion.packed_hits(), "metadata": F.max("metadata")}
    fused = fusion.fuse_views(hits, settings.weights, settings.rrf_k, settings.fused, also)
    return fused.withColumnRenamed("doc_ref", "doc_id").withColumn("global_idx", F.lit(None).cast("long"))


def retrieve_index(query_vectors: DataFrame, index: DataFrame, metadata: DataFrame, settings: Settings) -> DataFrame:
    """Fused candidates of a dense index: (query_id, field, q) against (field, idx, v), with complete metadata."""
    top = fusion.vector_top_k(query_vectors, index, settings.per_view)
    hits = top.select("query_id", F.col("field").alias("source"), "position", F.col("idx").alias("doc_ref"), "score")
    fused = fusion.hit_details(fusion.fuse_views(hits, settings.weights, settings.rrf_k, settings.fused), hits).withColumnRenamed("doc_ref", "global_idx")
    found, incomplete = integrity.complete_join(fused, readers.wanted_rows(metadata, fused), ["global_idx"])
    integrity.require(integrity.missing(fused, metadata, ["global_idx"], "index metadata"))
    reference = candidates.index_reference(F.col("doc_id"), F.col("source_file"), F.col("row_group"), F.col("row_index"))
    return found.withColumn("doc_id", reference)


def run(queries: DataFrame, retrieved: DataFrame, documents: DataFrame, traces: DataFrame, laws: DataFrame, courts: DataFrame, saved: DataFrame, settings: Settings, prompts: tuple[str, str] | None = None) -> Result:
    """From fused candidates to decisions and, with gold citations in ``queries``, metrics.

    ``prompts`` (version, system prompt) checks saved scores by their inputs' digests.
    """
    own = retrieved.withColumn("ordinal", F.col("rank"))
    summary = query_views(queries).select("query_id", F.col("normal_query").alias("query"), F.col("meta_searchterm").alias("meta_query"), F.col("keywords").alias("keywords_query"))
    prepared = candidates.batches(candidates.prepare(queries, own, documents, summary, settings.top_n), settings.batch)
    integrity.require(integrity.record_rules(prepared, ["candidate_id"], integrity.verifier_input_rules()), integrity.duplicates(prepared, ["candidate_id"]), integrity.non_empty(prepared))
    cited = with_citations(documents, "full_document_text", "__found").select("doc_id", all_citations(F.col("__found")).alias("citations"))
    wanted = support.discovered_citations(traces, settings.policy.support_top).union(cited.select(F.explode("citations").alias("citation"))).distinct()
    vocabulary = support.targeted_vocabulary(laws, courts, wanted)
    counts, _ = support.sparse_support(traces, vocabulary, settings.policy.support_top)
    if prompts:
        ready = verify.fingerprinted(prepared, settings.model, *prompts)
        scores, violations = verify.replay(ready, saved, settings.model)
        integrity.require(violations)
    else:
        scores, incomplete = integrity.complete_join(prepared.select("query_id", "candidate_id", "doc_id", "rank"), saved.drop("query_id", "rank"), ["candidate_id"])
        integrity.require(incomplete)
    decided, _, _ = gate.select_citations(prepared, scores, cited, counts, vocabulary, settings.policy)
    predicted = gate.predictions(queries.select("query_id", "ordinal"), decided)
    measured = None
    if "gold_citations" in queries.columns:
        gold = queries.select("query_id", split_citations(F.col("gold_citations")).alias("gold"))
        measured = metrics.per_query(gold, predicted.select("query_id", F.col("citations").alias("predicted")))
    return Result(retrieved, prepared, counts, scores, decided, predicted, measured)


def run_files(spark: SparkSession, config_path: str, output: str, base: str | None = None) -> dict:
    """A run configured by a TOML file: reads its paths, writes submission, decisions, metrics and manifest."""
    config = readers.config(config_path)
    folder = base or config_path.rsplit("/", 1)[0]
    path = lambda name: readers.exists(spark, f"{folder}/{config['paths'][name]}", name)
    settings = Settings.from_config(config)
    sinks.refuse_non_empty(spark, output)
    header = spark.read.option("header", True).csv(path("queries")).columns
    queries = readers.query_table(spark, path("queries"), gold="gold_citations" in header)
    retrieved = retrieve_saved(queries, kept(readers.saved_rankings(spark, path("rankings")), "rankings"), settings)
    result = run(
        queries, retrieved, readers.documents(spark, path("documents")), readers.sparse_traces(spark, path("traces")), readers.citation_table(spark, path("laws")), readers.citation_table(spark, path("courts")), readers.json_lines(spark, path("scores"), readers.REPLAY), settings
    )
    sinks.write_submission(queries, result.predictions, f"{output}/submission.csv")
    sinks.write_json_lines(result.decisions, f"{output}/decisions")
    summary = {"policy": settings.policy.describe()}
    if result.metrics is not None:
        sinks.write_json_lines(result.metrics, f"{output}/metrics")
        summary["metrics"] = metrics.macro(result.metrics).first().asDict()
    sinks.write_json(spark, f"{output}/manifest.json", summary)
    return summary
