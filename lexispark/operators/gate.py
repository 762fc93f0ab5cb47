"""The fixed-vote evidence gate and the selection of citations with its audit.

A citation is accepted if enough of the top candidates carry it, or one of the
leading candidates with a high score does, or enough sparse hits support it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import one_decimal
from ..functions.text import citation_kind


@dataclass(frozen=True)
class Policy:
    """Thresholds of the gate."""

    candidates: int = 10
    dense_votes: int = 4
    anchor_top: int = 3
    anchor_score: float = 8.5
    support_votes: int = 2
    support_top: int = 5

    def __post_init__(self):
        if min(self.candidates, self.dense_votes, self.anchor_top, self.support_votes, self.support_top) <= 0:
            raise ValueError("counts of the policy must be positive")
        if not 0 <= self.anchor_score <= 10:
            raise ValueError("the anchor score must be in [0, 10]")

    def describe(self) -> str:
        return (
            f"dense votes >= {self.dense_votes} of top {self.candidates}; or rank <= {self.anchor_top} with score >= {self.anchor_score:g}; "
            f"or support >= {self.support_votes} of top {self.support_top}"
        )


def verifier_order(candidates: DataFrame) -> DataFrame:
    """Adds position: by score, number of citations, both descending, then rank and reference."""
    keys = (F.desc("score"), F.desc(F.size("citations")), F.col("rank"), F.col("doc_ref"))
    return candidates.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*keys)))


def online_order(candidates: DataFrame) -> DataFrame:
    """New ranks by score descending, old rank, reference."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "doc_ref")))


def dense_votes(ordered: DataFrame, policy: Policy) -> DataFrame:
    """(query_id, citation, votes, best_position, best_score) over the top candidates.

    As positions follow the score, the best score's first position is the least.
    """
    top = ordered.where(F.col("position") <= policy.candidates)
    long = top.select("query_id", "position", "score", F.explode(F.array_distinct("citations")).alias("citation"))
    return long.groupBy("query_id", "citation").agg(F.count(F.lit(1)).alias("votes"), F.min("position").alias("best_position"), F.max("score").alias("best_score"))


def evidence(votes: DataFrame, support: DataFrame, policy: Policy) -> DataFrame:
    """Votes and support of every citation, and which of the three rules accept it."""
    joined = votes.join(support.select("query_id", "citation", "support"), ["query_id", "citation"], "full")
    joined = joined.withColumns({"votes": F.coalesce("votes", F.lit(0)), "support": F.coalesce("support", F.lit(0))})
    by_votes = F.col("votes") >= policy.dense_votes
    by_anchor = F.coalesce((F.col("best_position") <= policy.anchor_top) & (F.col("best_score") >= policy.anchor_score), F.lit(False))
    by_support = F.col("support") >= policy.support_votes
    return joined.withColumns({"by_votes": by_votes, "by_anchor": by_anchor, "by_support": by_support, "accepted": by_votes | by_anchor | by_support})


def decisions(decided: DataFrame, policy: Policy, score_text: Column | None = None) -> DataFrame:
    """Decision rows: query_id, citation, kind, accepted, reason and the votes' wording."""
    score = score_text if score_text is not None else one_decimal(F.col("best_score"))
    dense = F.concat(F.lit("dense vote "), F.col("votes").cast("string"), F.lit(f"/{policy.candidates}"))
    backing = F.concat(F.lit("BM25 support "), F.col("support").cast("string"), F.lit(f"/{policy.support_top}"))
    anchor = F.concat(F.lit("top-"), F.col("best_position").cast("string"), F.lit(" score "), score)
    said = F.concat_ws(" + ", F.when(F.col("by_votes"), dense), F.when(F.col("by_anchor"), anchor), F.when(F.col("by_support"), backing))
    reason = F.when(F.col("accepted"), "selected by the configured evidence gate").otherwise("extracted but below every evidence threshold")
    return decided.select(
        "query_id", "citation", citation_kind(F.col("citation")).alias("kind"), "accepted", reason.alias("reason"),
        F.when(F.col("accepted"), said).otherwise(F.concat_ws("; ", dense, backing)).alias("votes_text"), "votes", "support",
    )


def gate(candidates: DataFrame, support: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Evidence of every citation of the ranked candidates (query_id, doc_ref, rank, score, citations)."""
    return evidence(dense_votes(verifier_order(candidates), policy), support, policy)


def predictions(queries: DataFrame, decided: DataFrame) -> DataFrame:
    """(query_id, citations) with the sorted accepted citations of every query, empty if none."""
    kept = decided.where("accepted").groupBy("query_id").agg(F.array_sort(F.collect_list("citation")).alias("citations"))
    return queries.join(kept, "query_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def select_citations(prepared: DataFrame, scores: DataFrame, documents: DataFrame, support: DataFrame, entries: DataFrame, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, ranked candidates and out-of-vocabulary citations of scored candidates.

    prepared and scores share (query_id, candidate_id); documents gives each
    doc_id's found citations as an array. Citations outside the vocabulary do
    not reach the gate.
    """
    scored = prepared.select("query_id", "candidate_id", "doc_id", "rank").join(scores.select("query_id", "candidate_id", "score", "confidence"), ["query_id", "candidate_id"])
    long = scored.join(documents.select("doc_id", F.explode_outer("citations").alias("citation")), "doc_id", "left")
    known = long.join(entries.select("citation", F.lit(True).alias("__known")), "citation", "left")
    ranked = known.groupBy("query_id", "candidate_id", "doc_id", "rank", "score", "confidence").agg(
        F.array_sort(F.collect_set(F.when(F.col("__known"), F.col("citation")))).alias("citations"), F.array_sort(F.collect_set(F.when(F.col("__known").isNull(), F.col("citation")))).alias("outside")
    )
    ranked = verifier_order(ranked.withColumn("doc_ref", F.col("candidate_id")))
    decided = evidence(dense_votes(ranked, policy), support, policy)
    return decisions(decided, policy), ranked.drop("outside"), ranked.where(F.size("outside") > 0).select("query_id", "candidate_id", "outside")


def evidence_documents(candidates: DataFrame, accepted: DataFrame, n: int) -> DataFrame:
    """The first n candidates of each query that carry an accepted citation; without any, the first n."""
    own = accepted.groupBy("query_id").agg(F.collect_set("citation").alias("__accepted"))
    marked = candidates.join(own, "query_id", "left").withColumn("__good", F.coalesce(F.arrays_overlap("citations", "__accepted"), F.lit(False)))
    marked = marked.withColumn("__any", F.max("__good").over(Window.partitionBy("query_id"))).where(F.col("__good") | ~F.col("__any"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return marked.withColumn("__place", place).where(F.col("__place") <= n).drop("__accepted", "__good", "__any", "__place")


def union_support(counts: DataFrame) -> DataFrame:
    """Support from ranked documents (query_id, doc_ref, citations): in how many a citation is."""
    return counts.select("query_id", "doc_ref", F.explode(F.array_distinct("citations")).alias("citation")).groupBy("query_id", "citation").agg(F.count_distinct("doc_ref").alias("support"))
