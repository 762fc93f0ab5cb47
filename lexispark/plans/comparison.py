"""Replays of saved verifier runs and comparisons of fresh ones, each pinned to its inputs and its result."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import all_citations, with_citations
from ..functions.text import split_citations
from ..operators import candidates, digests, gate, integrity, metrics, support, verify


@dataclass(frozen=True)
class ComparisonConfig:
    """Settings of a run against an endpoint."""

    base_url: str
    model: str
    api_key_env: str = "API_KEY"
    max_tokens: int = 4_096
    temperature: float = 0.0
    timeout_seconds: float = 120.0
    max_attempts: int = 3
    retry_delay_seconds: float = 1.0
    document_char_limit: int = 0
    limit_batches: int | None = None
    batches: int = 20

    def __post_init__(self):
        rules = {
            "base_url uses HTTPS": self.base_url.startswith("https://"),
            "model is not blank": bool(self.model.strip()),
            "api_key_env is a variable's name": re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.api_key_env.strip()) is not None,
            "limit_batches is one of the batches": self.limit_batches is None or 1 <= self.limit_batches <= self.batches,
            "timeout, attempts and tokens are positive": min(self.timeout_seconds, self.max_attempts, self.max_tokens) > 0,
            "delay and character limit are not negative": self.retry_delay_seconds >= 0 and self.document_char_limit >= 0,
            "temperature is in [0, 2]": 0.0 <= self.temperature <= 2.0,
        }
        if bad := [name for name, ok in rules.items() if not ok]:
            raise ValueError("settings break: " + "; ".join(bad))


@dataclass(frozen=True)
class Expected:
    """What a replay must find: digests by input, counts, missing identities, and the macro F1."""

    digests: Mapping[str, str]
    prepared: int
    scored: int
    batches: int
    missing: Collection[str]
    macro_f1: float | None = None
    tolerance: float = 1e-12


def pinned(spark, expected: Mapping[str, str], actual: Mapping[str, str]) -> None:
    """An error that names the inputs whose digests differ."""
    table = lambda d: spark.createDataFrame(sorted(d.items()), "name string, sha256 string")
    differ = digests.hash_differences(table(expected), table(actual))
    integrity.require(differ.select(F.lit("pinned input").alias("rule"), F.col("name").alias("key"), F.concat_ws(" is not ", F.coalesce("actual", F.lit("nothing")), F.coalesce("expected", F.lit("pinned"))).alias("message")))


def evaluated(queries: DataFrame, prepared: DataFrame, scores: DataFrame, documents: DataFrame, traces: DataFrame, laws: DataFrame, courts: DataFrame, policy: gate.Policy) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, predictions and metrics per query of scored candidates."""
    cited = with_citations(documents, "full_document_text", "__found").select("doc_id", all_citations(F.col("__found")).alias("citations"))
    wanted = support.discovered_citations(traces, policy.support_top).union(cited.select(F.explode("citations").alias("citation"))).distinct()
    vocabulary = support.targeted_vocabulary(laws, courts, wanted)
    counts, _ = support.sparse_support(traces, vocabulary, policy.support_top)
    decided, _, _ = gate.select_citations(prepared, scores, cited, counts, vocabulary, policy)
    predicted = gate.predictions(queries.select("query_id"), decided)
    gold = queries.select("query_id", split_citations(F.col("gold_citations")).alias("gold"))
    return decided, predicted, metrics.per_query(gold, predicted.select("query_id", F.col("citations").alias("predicted")))


def historical_replay(
    queries: DataFrame, prepared: DataFrame, lines: DataFrame, documents: DataFrame, traces: DataFrame, laws: DataFrame, courts: DataFrame, model_key: str, expected: Expected, actual: Mapping[str, str], policy: gate.Policy = gate.Policy()
) -> tuple[DataFrame, DataFrame, dict]:
    """Decisions, predictions and figures of a saved run that may be incomplete, in exactly the known way.

    prepared: (query_id, candidate_id, doc_id, rank, global_idx); lines: saved
    batches (model_key, ok, batch_id, scores) under old identities. Inputs,
    counts, the missing identities and the macro F1 must be the expected ones.
    """
    pinned(queries.sparkSession, expected.digests, actual)
    scores, failed = verify.historical_scores(lines, model_key)
    integrity.require(failed, integrity.duplicates(scores, ["candidate_id"]))
    old = prepared.withColumn("old", candidates.legacy_id(F.col("query_id"), F.col("rank"), F.col("global_idx")))
    integrity.require(integrity.missing(scores.select(F.col("candidate_id").alias("old")), old, ["old"], "unknown score"))
    lost = {r["key"] for r in integrity.missing(old, scores.select(F.col("candidate_id").alias("old")), ["old"], "score").limit(len(expected.missing) + 1).collect()}
    joined = old.join(scores.select(F.col("candidate_id").alias("old"), "score", "confidence"), "old")
    found = {"prepared": prepared.count(), "scored": joined.count(), "batches": scores.select("batch_id").distinct().count(), "missing": sorted(lost)}
    if found != {"prepared": expected.prepared, "scored": expected.scored, "batches": expected.batches, "missing": sorted(expected.missing)}:
        raise integrity.IntegrityError(f"the saved run has another shape: {found}")
    decided, predicted, measured = evaluated(queries, joined.select("query_id", "candidate_id", "doc_id", "rank"), joined.select("query_id", "candidate_id", "score", "confidence"), documents, traces, laws, courts, policy)
    figures = metrics.macro(measured).first().asDict()
    if expected.macro_f1 is not None and abs(figures["f1"] - expected.macro_f1) > expected.tolerance:
        raise integrity.IntegrityError(f"macro F1 is {figures['f1']!r}, not {expected.macro_f1!r}")
    return decided, predicted, found | {"metrics": figures, "model_key": model_key}


def model_comparison(
    queries: DataFrame, batched: DataFrame, scores: DataFrame, documents: DataFrame, traces: DataFrame, laws: DataFrame, courts: DataFrame, digests_: tuple[Mapping[str, str], Mapping[str, str]], shape: tuple[int, int, int], policy: gate.Policy = gate.Policy()
) -> tuple[DataFrame, dict]:
    """Metrics per query and figures of a fresh run over a pinned input of exactly this shape (queries, batches, candidates).

    scores: (candidate_id, query_id, batch, score, confidence, model); every
    candidate is scored, by one model.
    """
    pinned(queries.sparkSession, *digests_)
    integrity.require(verify.batch_shape(batched, *shape), integrity.one_value(scores, "model"), integrity.duplicates(scores, ["candidate_id"]))
    joined, incomplete = integrity.complete_join(batched.select("query_id", "candidate_id", "doc_id", "rank"), scores.select("candidate_id", "score", "confidence"), ["candidate_id"])
    integrity.require(incomplete)
    _, _, measured = evaluated(queries, joined.select("query_id", "candidate_id", "doc_id", "rank"), joined.select("query_id", "candidate_id", "score", "confidence"), documents, traces, laws, courts, policy)
    return measured, metrics.macro(measured).first().asDict()
