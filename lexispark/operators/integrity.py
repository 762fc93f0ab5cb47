"""Integrity as data: rules give rows (rule, key, message), and sinks ask for none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt

VIOLATION = "rule string, key string, message string"


class IntegrityError(ValueError):
    """A table breaks its rules."""


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("::", *[F.col(c).cast("string") for c in columns]) if columns else F.lit("")


def record_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row for each record and rule that is not true (null counts as broken); one pass over ``df``."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(_key(keys).alias("key"), F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule")).select("rule", "key", F.concat(F.lit("broken: "), "rule").alias("message"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str = "unique") -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return counted.select(F.lit(rule).alias("rule"), _key(keys).alias("key"), F.concat(F.col("__n").cast("string"), F.lit(" rows")).alias("message"))


def contiguous(df: DataFrame, groups: Sequence[str], rank: str) -> DataFrame:
    """Groups whose ranks are not exactly 1..n."""
    seen = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count_distinct(rank).alias("d"))
    return seen.where("NOT (lo = 1 AND hi = n AND d = n)").select(F.lit("contiguous ranks").alias("rule"), _key(groups).alias("key"), F.lit("ranks are not 1..n").alias("message"))


def ranks(df: DataFrame, groups: Sequence[str], rank: str) -> DataFrame:
    """``duplicates`` of a rank and ``contiguous`` ranks of the same groups; rows are dealt once, by the first column of ``groups``."""
    counted = dealt(df.select(*groups, rank), groups[0], each=1_000_000).groupBy(*groups, rank).agg(F.count(F.lit(1)).alias("__n"))
    twice = counted.where("__n > 1").select(F.lit("unique").alias("rule"), _key([*groups, rank]).alias("key"), F.concat(F.col("__n").cast("string"), F.lit(" rows")).alias("message"))
    seen = counted.groupBy(*groups).agg(F.sum("__n").alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count(rank).alias("d"))
    gaps = seen.where("NOT (lo = 1 AND hi = n AND d = n)").select(F.lit("contiguous ranks").alias("rule"), _key(groups).alias("key"), F.lit("ranks are not 1..n").alias("message"))
    return twice.unionByName(gaps)


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    gone = left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")
    return gone.select(F.lit(rule).alias("rule"), _key(keys).alias("key"), F.lit("no partner").alias("message"))


def complete_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the violations of either side's completeness."""
    inner = left.join(right, list(keys))
    return inner, all_of(missing(left, right, keys, "right side is missing"), missing(right, left, keys, "left side is missing"))


def equal_sets(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that only one side has, with the side."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def non_empty(df: DataFrame, rule: str = "non-empty") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(rule).alias("rule"), F.lit("").alias("key"), F.lit("no rows").alias("message"))


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def require(*violations: DataFrame, show: int = 10) -> None:
    """Raises with the first violations; the only action in this module."""
    if found := all_of(*violations).limit(show).collect():
        raise IntegrityError("; ".join(f"{r['rule']} [{r['key']}]: {r['message']}" for r in found))


def one_value(df: DataFrame, column: str) -> DataFrame:
    """A violation unless the column has exactly one distinct value."""
    return df.agg(F.count_distinct(column).alias("n")).where("n <> 1").select(F.lit("exactly one value").alias("rule"), F.lit(column).alias("key"), F.concat(F.col("n").cast("string"), F.lit(" values")).alias("message"))


# Rules of the records; each maps a rule's name to what must hold.
def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def _unique_list(c: str) -> Column:
    return F.coalesce((F.size(F.array_distinct(c)) == F.size(c)) & ~F.exists(c, lambda v: F.coalesce(F.trim(v) == "", F.lit(True))), F.lit(False))


def _trimmed(c: str) -> Column:
    return _text(c) & (F.trim(F.col(c)) == F.col(c))


def chat_rules() -> dict[str, Column]:
    return {"role": F.col("role").isin("user", "assistant", "system"), "content": _text("content")}


def query_rules() -> dict[str, Column]:
    return {c: _text(c) for c in ("query_id", "query", "split")}


def document_rules() -> dict[str, Column]:
    return {"doc_ref": _text("doc_ref"), "text": _text("text"), "citations": _unique_list("citations")}


def hit_rules() -> dict[str, Column]:
    return {"doc_ref": _text("doc_ref"), "rank": F.col("rank") > 0}


def candidate_rules() -> dict[str, Column]:
    return {"doc_ref": _text("doc_ref"), "rank": F.col("rank") > 0, "score": F.col("score").between(0, 10), "confidence": F.col("confidence").between(0, 1), "citations": _unique_list("citations")}


def support_rules() -> dict[str, Column]:
    return {"citation": _text("citation"), "count": F.col("support") >= 0}


def gold_rules(column: str) -> dict[str, Column]:
    return {"query_id": _trimmed("query_id"), column: _unique_list(column)}


def gate_candidate_rules() -> dict[str, Column]:
    finite = ~F.exists(F.map_values("features"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return {"query_id": _trimmed("query_id"), "citation": _trimmed("citation"), "accepted": F.col("accepted").isNotNull(), "features": (F.size("features") > 0) & finite}


def perturbation_rules() -> dict[str, Column]:
    names = F.transform("ablations", lambda a: a["feature"])
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    evidence = F.size(F.filter("ablations", lambda a: a["is_evidence"]))
    return {
        "query_id": _trimmed("query_id"),
        "full_score": ~bad(F.col("full_score")),
        "ablations": (F.size("ablations") > 0) & (F.size(F.array_distinct(names)) == F.size(names)),
        "scores": ~F.exists("ablations", lambda a: bad(a["score_without_feature"]) | a["is_evidence"].isNull()),
        "evidence": evidence >= 1,
        "controls": F.size("ablations") - evidence >= evidence,
    }


def surrogate_table_rules(df: DataFrame) -> DataFrame:
    """At least two rows, both outcomes, unique (query, citation), the same feature names everywhere."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("accepted").alias("o"), F.count_distinct(F.array_sort(F.map_keys("features"))).alias("f"))
    rules = {"two rows": F.col("n") >= 2, "both outcomes": F.col("o") == 2, "same features": F.col("f") == 1}
    return all_of(record_rules(facts, [], rules), duplicates(df, ["query_id", "citation"]))


def verifier_input_rules() -> dict[str, Column]:
    return {"candidate_id": _text("candidate_id"), "query": _text("query"), "document_text": _text("document_text"), "rank": F.col("rank") > 0}
