"""The online request's stages as batch operators over many requests at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import all_citations, validate_answers, with_citations
from ..functions.text import clean, html_escape, query_views
from ..operators import candidates, fusion, gate, integrity, support, verify


def understand(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Explicit citations of each query, and key concepts (issues, then keywords) of strict JSON replies.

    requests: (query_id, query); replies: (query_id, response). ``problem`` tells
    why a reply is refused.
    """
    keys = ("issues", "keywords", "language")
    parsed = verify.strict_object(F.col("response"), keys)
    texts = lambda name: F.try_variant_get(parsed, f"$.{name}", "array<string>")
    lists = F.coalesce(texts("issues").isNotNull() & texts("keywords").isNotNull(), F.lit(False))
    said = with_citations(requests, "query", "__found").join(replies.select("query_id", "response"), "query_id", "left")
    return said.select("query_id", all_citations(F.col("__found")).alias("explicit_citations"), F.when(lists, F.concat(texts("issues"), texts("keywords"))).alias("key_concepts"), F.when(parsed.isNull(), "reply is no object with exactly the expected keys").when(~lists, "a list is no list of texts").alias("problem"))


def changed_views(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Queries whose regenerated views differ from the stored ones in any byte, and which."""
    made = query_views(requests)
    both = made.alias("a").join(stored.alias("b"), "query_id", "left")
    differs = F.filter(F.array(*[F.when(~F.encode(F.col(f"a.{v}"), "utf-8").eqNullSafe(F.encode(F.col(f"b.{v}"), "utf-8")), F.lit(v)) for v in fusion.VIEWS]), lambda v: v.isNotNull())
    return both.select("query_id", differs.alias("fields")).where(F.size("fields") > 0)


def retrieve(dense: DataFrame, bm25: DataFrame, documents: DataFrame, k: int = fusion.RRF_K, limit: int = 100) -> DataFrame:
    """Fused public hits of two rankings (query_id, doc_ref, position); every document must exist."""
    hits = dense.withColumn("source", F.lit("dense")).unionByName(bm25.withColumn("source", F.lit("bm25")))
    integrity.require(integrity.missing(hits, documents, ["doc_ref"], "document of ranking"))
    fused = fusion.weighted_rrf(hits, fusion.ONLINE_WEIGHTS, k, limit)
    return fused.join(documents, "doc_ref").select("query_id", "doc_ref", "rank", "sources", "citations", "court", *candidates.public_hit(F.col("text"), F.col("fusion_score")))


def score_documents(scored: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked single-document replies (query_id, doc_ref, rank, citations, response), and the violations."""
    reply = verify.strict_object(F.col("response"), ("score", "confidence", "rationale_de"))
    get = lambda name, kind: F.try_variant_get(reply, f"$.{name}", kind)
    rows = scored.withColumns({"score": get("score", "double"), "confidence": get("confidence", "double"), "rationale": clean(get("rationale_de", "string"))})
    number = lambda name: verify.strict_number(F.try_variant_get(reply, f"$.{name}", "variant"))
    rules = {"reply": reply.isNotNull(), "score": number("score") & F.col("score").between(0, 10), "confidence": number("confidence") & F.col("confidence").between(0, 1), "rationale": F.col("rationale") != ""}
    broken = integrity.record_rules(rows, ["query_id", "doc_ref"], rules)
    long = scored.select("query_id", "doc_ref", F.explode("citations").alias("citation"))
    unknown = support.outside(long, vocabulary).select(F.lit("closed vocabulary").alias("rule"), F.concat_ws("::", "query_id", "doc_ref").alias("key"), F.col("citation").alias("message"))
    return rows.drop("response"), integrity.all_of(broken, unknown)


def control(scored: DataFrame, bm25: DataFrame, documents: DataFrame, policy: gate.Policy = gate.Policy()) -> DataFrame:
    """Gate decisions over re-ranked candidates and the citations of the leading sparse documents."""
    leading = bm25.where(F.col("position") <= policy.support_top).join(documents.select("doc_ref", "citations"), "doc_ref")
    decided = gate.gate(gate.online_order(scored), gate.union_support(leading), policy)
    return gate.decisions(decided, policy)


def answer_evidence(scored: DataFrame, decided: DataFrame, n: int) -> DataFrame:
    return gate.evidence_documents(gate.verifier_order(gate.online_order(scored)), decided.where("accepted"), n)


def evidence_prompt(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, prompt): the evidence documents as escaped elements in order of position."""
    rows = evidence.select("query_id", "position", "doc_ref").join(documents.select("doc_ref", "text"), "doc_ref")
    item = F.concat(F.lit('<document ref="'), html_escape(F.col("doc_ref")), F.lit('">'), html_escape(F.col("text")), F.lit("</document>"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))), lambda s: s["item"]), "\n").alias("prompt"))


def check_answers(answers: DataFrame, decided: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Answers (query_id, answer) against what the gate accepted."""
    accepted = decided.where("accepted").groupBy("query_id").agg(F.collect_set("citation").alias("accepted"))
    rows = answers.join(accepted, "query_id", "left").select(F.col("query_id").alias("answer_id"), "answer", F.coalesce("accepted", F.array().cast("array<string>")).alias("accepted"))
    return validate_answers(rows, vocabulary)


def usage(responses: DataFrame) -> DataFrame:
    """Tokens of each run (run_id, total_tokens)."""
    return responses.groupBy("run_id").agg(F.sum("total_tokens").alias("total_tokens"))


def listing(queries: DataFrame, dense: DataFrame, split: str | None = None) -> DataFrame:
    """Public queries in order of id, and whether each has a dense ranking."""
    has = dense.select("query_id").distinct().withColumn("has_dense", F.lit(True))
    shown: Column = F.lit(split) if split else F.col("split")
    return queries.join(has, "query_id", "left").select("query_id", "query", shown.alias("split"), F.coalesce("has_dense", F.lit(False)).alias("has_dense")).orderBy("query_id")


def check_settings(top_select: int, rerank_n: int, retrieve_k: int, base_url: str, origins: Sequence[str], token: str) -> None:
    """Rules of a service's settings."""
    rules = {"0 < top_select <= rerank_n <= retrieve_k": 0 < top_select <= rerank_n <= retrieve_k, "HTTPS": base_url.startswith("https://"), "no wildcard origin": "*" not in origins, "token of 16 characters": len(token) >= 16}
    if bad := [name for name, ok in rules.items() if not ok]:
        raise ValueError("settings break: " + "; ".join(bad))
