"""Queries of record rules, integrity checks and scores, over test tables with planted faults; and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonrepair, numbers, text
from ..operators import analysis, candidates, digests, fusion, gate, integrity, metrics, support, verify
from ..sources import providers, sinks
from . import online, tables
from .registry import query
from .tables import table

SQL: dict[str, str] = {}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _string(c: str):
    return F.col(c).cast("string")


@query
def record_violations(spark, sf):
    """Rules of queries, documents, hits, candidates, support counts, gold lists and verifier inputs: broken ones by kind."""
    t, d, o, p = (table(spark, sf, n) for n in ("conversations", "documents", "orders", "part"))
    blank = lambda bad, good: F.when(bad, F.lit("  ")).otherwise(good)
    key = F.col("o_orderkey")
    kinds = {
        "query": (t.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), blank(F.col("turn") % 5 == 4, F.col("text")).alias("query"), blank(F.col("conv_id") % 7 == 0, F.col("role")).alias("split")), integrity.query_rules()),
        "document": (d.select(_string("doc_id").alias("doc_ref"), blank(F.col("doc_id") % 11 == 0, F.lit("text")).alias("text"), F.when(F.col("doc_id") % 13 == 0, F.array("lang", "lang")).otherwise(F.array("lang")).alias("citations")), integrity.document_rules()),
        "hit": (o.select(blank(key % 9 == 0, F.col("o_orderstatus")).alias("doc_ref"), (key % 10).alias("rank")), integrity.hit_rules()),
        "candidate": (o.select(_string("o_orderkey").alias("doc_ref"), (key % 10).alias("rank"), (key % 13).cast("double").alias("score"), (key % 12 / 10.0).alias("confidence"), F.when(key % 17 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("citations")), integrity.candidate_rules()),
        "support": (p.select(blank(F.col("p_partkey") % 8 == 0, F.col("p_name")).alias("citation"), (F.col("p_size") - 3).alias("support")), integrity.support_rules()),
        "gold": (p.select(F.when(F.col("p_partkey") % 6 == 0, F.concat(F.col("p_name"), F.lit(" "))).otherwise(F.col("p_name")).alias("query_id"), F.when(F.col("p_size") % 4 == 0, F.array("p_brand", "p_brand")).otherwise(F.array("p_brand")).alias("gold")), integrity.gold_rules("gold")),
        "verifier": (o.select(_string("o_orderkey").alias("candidate_id"), blank(key % 14 == 0, F.lit("q")).alias("query"), blank(key % 15 == 0, F.lit("d")).alias("document_text"), (key % 10).alias("rank")), integrity.verifier_input_rules()),
    }
    found = _union([integrity.record_rules(df, [df.columns[0]], rules).withColumn("kind", F.lit(kind)) for kind, (df, rules) in kinds.items()])
    return found.groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("n"))


SQL["record_violations"] = """
WITH v AS (
  SELECT 'query' AS kind, unnest(list_filter([CASE WHEN turn % 5 = 4 OR trim(text) = '' THEN 'query' END, CASE WHEN conv_id % 7 = 0 THEN 'split' END], lambda x: x IS NOT NULL)) AS rule FROM conversations
  UNION ALL SELECT 'document', unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'text' END, CASE WHEN doc_id % 13 = 0 OR lang IS NULL THEN 'citations' END], lambda x: x IS NOT NULL)) FROM documents
  UNION ALL SELECT 'hit', unnest(list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'doc_ref' END, CASE WHEN o_orderkey % 10 = 0 THEN 'rank' END], lambda x: x IS NOT NULL)) FROM orders
  UNION ALL SELECT 'candidate', unnest(list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'rank' END, CASE WHEN o_orderkey % 13 > 10 THEN 'score' END, CASE WHEN o_orderkey % 12 > 10 THEN 'confidence' END, CASE WHEN o_orderkey % 17 = 0 THEN 'citations' END], lambda x: x IS NOT NULL)) FROM orders
  UNION ALL SELECT 'support', unnest(list_filter([CASE WHEN p_partkey % 8 = 0 THEN 'citation' END, CASE WHEN p_size < 3 THEN 'count' END], lambda x: x IS NOT NULL)) FROM part
  UNION ALL SELECT 'gold', unnest(list_filter([CASE WHEN p_partkey % 6 = 0 THEN 'query_id' END, CASE WHEN p_size % 4 = 0 THEN 'gold' END], lambda x: x IS NOT NULL)) FROM part
  UNION ALL SELECT 'verifier', unnest(list_filter([CASE WHEN o_orderkey % 14 = 0 THEN 'query' END, CASE WHEN o_orderkey % 15 = 0 THEN 'document_text' END, CASE WHEN o_orderkey % 10 = 0 THEN 'rank' END], lambda x: x IS NOT NULL)) FROM orders)
SELECT kind, rule, count(*) AS n FROM v GROUP BY 1, 2"""


@query
def analysis_record_violations(spark, sf):
    """Rules of gate candidates (with the table's own) and of perturbation cases."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    gates = c.select(
        F.when(k % 10 == 0, F.concat(_string("c_custkey"), F.lit(" "))).otherwise(_string("c_custkey")).alias("query_id"), F.lit("Art. 1 OR").alias("citation"), F.when(k % 7 > 0, k % 2 == 0).alias("accepted"),
        F.when(k % 9 == 0, F.create_map(F.lit("balance"), F.lit(float("nan")))).when(k % 8 == 0, F.create_map(F.lit("other"), F.lit(1.0))).otherwise(F.create_map(F.lit("balance"), "c_acctbal")).alias("features"),
    )
    first = integrity.record_rules(gates, ["query_id", "citation"], integrity.gate_candidate_rules()).unionByName(integrity.surrogate_table_rules(gates)).withColumn("kind", F.lit("gate"))
    ablation = lambda name, score, evidence: F.struct(F.lit(name).alias("feature"), score.cast("double").alias("score_without_feature"), F.lit(evidence).alias("is_evidence"))
    cases = c.select(
        _string("c_custkey").alias("query_id"), F.when(k % 6 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("full_score"),
        F.when(k % 5 == 0, F.array(ablation("a", k, True))).when(k % 5 == 1, F.array(ablation("a", k, False))).when(k % 5 == 2, F.array(ablation("a", k, True), ablation("a", k, False))).otherwise(F.array(ablation("a", k, True), ablation("b", k, False))).alias("ablations"),
    )
    second = integrity.record_rules(cases, ["query_id"], integrity.perturbation_rules()).withColumn("kind", F.lit("perturbation"))
    return first.unionByName(second).groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("n"))


SQL["analysis_record_violations"] = """
WITH v AS (
  SELECT 'gate' AS kind, unnest(list_filter([CASE WHEN c_custkey % 10 = 0 THEN 'query_id' END, CASE WHEN c_custkey % 7 = 0 THEN 'accepted' END, CASE WHEN c_custkey % 9 = 0 THEN 'features' END], lambda x: x IS NOT NULL)) AS rule FROM customer
  UNION ALL SELECT 'gate', 'same features' WHERE (SELECT count(DISTINCT c_custkey % 9 > 0 AND c_custkey % 8 = 0) FROM customer) > 1
  UNION ALL SELECT 'perturbation', unnest(list_filter([CASE WHEN c_custkey % 6 = 0 THEN 'full_score' END, CASE WHEN c_custkey % 5 = 2 THEN 'ablations' END, CASE WHEN c_custkey % 5 = 1 THEN 'evidence' END, CASE WHEN c_custkey % 5 = 0 THEN 'controls' END], lambda x: x IS NOT NULL)) FROM customer)
SELECT kind, rule, count(*) AS n FROM v GROUP BY 1, 2"""


def _prepared(spark, sf) -> DataFrame:
    """Ten orders at most of each customer as verifier input, with a digest of their identity."""
    c = tables.candidates(spark, sf).where("rank <= 10")
    rows = c.select("query_id", F.concat_ws("::", "query_id", F.concat(F.lit("gi"), "doc_ref")).alias("candidate_id"), F.col("doc_ref").alias("doc_id"), "rank", "score")
    return rows.withColumn("input_sha256", F.sha2(F.col("candidate_id").cast("binary"), 256))


def _batched(spark, sf) -> DataFrame:
    """``_prepared`` in batches of five, written and read again, for plans that need them several times."""
    path = tables.scratch(spark, "batched")
    candidates.batches(_prepared(spark, sf), 5).write.parquet(path)
    return spark.read.parquet(path)


_PREPARED = """
prep AS (SELECT o_custkey::VARCHAR AS query_id, o_custkey || '::gi' || o_orderkey AS candidate_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, (o_orderkey * 7919) % 101 / 10.0::DOUBLE AS score FROM orders),
prepared AS (SELECT *, sha256(candidate_id) AS input_sha256, (row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1) // 5 AS batch FROM prep WHERE rank <= 10 AND o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query
def replayed_scores(spark, sf):
    """Saved scores joined to their inputs: model, rank, digest and range must agree, both sides be complete."""
    prepared = _prepared(spark, sf)
    i = F.col("doc_id").cast("long")
    saved = prepared.where(i % 19 > 0).select(
        "candidate_id", (F.col("rank") + F.when(i % 23 == 0, 1).otherwise(0)).alias("rank"), (F.col("score") + F.when(i % 29 == 0, 20).otherwise(0)).alias("score"), F.lit(0.5).alias("confidence"), F.lit("why").alias("rationale"),
        F.when(i % 31 == 0, F.lit("other")).otherwise(F.lit("m")).alias("model"), F.when(i % 37 == 0, F.lit("")).otherwise(F.col("input_sha256")).alias("input_sha256"),
    )
    inner, violations = verify.replay(prepared.drop("score"), saved, "m")
    kept = inner.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total")).select(F.lit("scored").alias("rule"), "query_id", "n", "total")
    return kept.unionByName(violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select("rule", F.lit("").alias("query_id"), "n", F.lit(0.0).alias("total")))


SQL["replayed_scores"] = f"""WITH {_PREPARED},
inn AS (SELECT * FROM prepared WHERE o_orderkey % 19 > 0),
vio AS (SELECT unnest(list_filter([CASE WHEN o_orderkey % 31 = 0 THEN 'model' END, CASE WHEN o_orderkey % 23 = 0 THEN 'rank' END, CASE WHEN o_orderkey % 37 = 0 THEN 'input digest' END, CASE WHEN o_orderkey % 29 = 0 THEN 'score' END], lambda x: x IS NOT NULL)) AS rule FROM inn
        UNION ALL SELECT 'right side is missing' FROM prepared WHERE o_orderkey % 19 = 0)
SELECT 'scored' AS rule, query_id, count(*) AS n, round(sum(score + CASE WHEN o_orderkey % 29 = 0 THEN 20 ELSE 0 END), 6) AS total FROM inn GROUP BY query_id
UNION ALL SELECT rule, '', count(*), 0 FROM vio GROUP BY rule"""


@query
def checkpoint_checks(spark, sf):
    """Saved batches that are stale, repeated or incomplete against the current ones."""
    b = candidates.batches(_prepared(spark, sf), 5)
    now = b.select("query_id", "batch", F.sha2(F.concat_ws("|", "query_id", "batch").cast("binary"), 256).alias("batch_sha256"), "candidate_id")
    q = F.col("query_id").cast("long")
    saved = now.where((q % 5 > 0) | (F.col("batch") > 0)).withColumn("batch_sha256", F.when((q % 7 == 0) & (F.col("batch") == 0), F.lit("old")).otherwise(F.col("batch_sha256"))).where(~((q % 11 == 0) & F.endswith("candidate_id", F.lit("7"))))
    twice = saved.unionByName(saved.where(q % 13 == 0))
    return verify.checkpoint_violations(twice, now).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SQL["checkpoint_checks"] = f"""WITH {_PREPARED},
b AS (SELECT *, query_id::BIGINT AS q FROM prepared),
s AS (SELECT *, CASE WHEN q % 7 = 0 AND batch = 0 THEN 'old' ELSE 'now' END AS sha FROM b WHERE (q % 5 > 0 OR batch > 0) AND NOT (q % 11 = 0 AND candidate_id LIKE '%7')),
v AS (SELECT DISTINCT 'stale batch' AS rule, query_id, batch, '' AS candidate_id FROM s WHERE sha = 'old'
      UNION ALL SELECT 'unique', query_id, batch, candidate_id FROM s WHERE q % 13 = 0
      UNION ALL SELECT 'incomplete batch', b.query_id, b.batch, b.candidate_id FROM b
        WHERE (b.query_id, b.batch) IN (SELECT query_id, batch FROM s WHERE sha = 'now') AND (b.query_id, b.batch, b.candidate_id) NOT IN (SELECT query_id, batch, candidate_id FROM s WHERE sha = 'now'))
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


@query
def batch_counts(spark, sf):
    """The shape that a comparison expects: queries, batches, candidates, ranks 1..n, one provider model."""
    prepared = _prepared(spark, sf)
    batched = candidates.batches(prepared, 5)
    shape = verify.batch_shape(batched, 100, 20, 100)
    models = batched.select(F.when(F.col("rank") % 2 == 0, "a").otherwise("b").alias("model"))
    gaps = integrity.contiguous(prepared.where("rank <> 2"), ["query_id"], "rank")
    return _union([x.select("rule", "key") for x in (shape, integrity.one_value(models, "model"), gaps, integrity.non_empty(prepared.limit(0)))]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SQL["batch_counts"] = f"""WITH {_PREPARED},
f AS (SELECT count(DISTINCT query_id) AS q, count(DISTINCT query_id || '-' || batch) AS b, count(*) AS c FROM prepared),
g AS (SELECT query_id, list_sort(list(rank)) AS ranks FROM prepared GROUP BY 1),
v AS (SELECT 'queries' AS rule FROM f WHERE q <> 100 UNION ALL SELECT 'batches' FROM f WHERE b <> 20 UNION ALL SELECT 'candidates' FROM f WHERE c <> 100
      UNION ALL SELECT 'contiguous ranks' FROM g WHERE ranks <> range(1, len(ranks) + 1)
      UNION ALL SELECT 'contiguous ranks' FROM (SELECT list_sort(list(rank)) AS ranks FROM prepared WHERE rank <> 2 GROUP BY query_id) WHERE ranks <> range(1, len(ranks) + 1)
      UNION ALL SELECT 'exactly one value' UNION ALL SELECT 'non-empty')
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


@query
def historical_batches(spark, sf):
    """Scores of one model in saved batch records; failed batches are violations; missing scores are told by old identities."""
    prepared = _prepared(spark, sf)
    b = candidates.batches(prepared, 5).withColumn("old", candidates.legacy_id(F.col("query_id"), F.col("rank"), F.col("doc_id")))
    lines = b.groupBy(F.concat_ws("-", "query_id", "batch").alias("batch_id")).agg(F.collect_list(F.struct(F.col("old").alias("candidate_id"), "score")).alias("scores"), F.min("doc_id").cast("long").alias("i"))
    lines = lines.select("batch_id", F.when(F.col("i") % 3 == 0, "other").otherwise("m").alias("model_key"), (F.col("i") % 4 > 0).alias("ok"), "scores")
    scores, failed = verify.historical_scores(lines, "m")
    lost = integrity.missing(b.select(F.col("old").alias("candidate_id")), scores, ["candidate_id"], "no score")
    told = failed.unionByName(lost).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select("rule", F.col("n").cast("double").alias("value"))
    return told.unionByName(scores.agg(F.round(F.sum("score"), 6).alias("value")).select(F.lit("total").alias("rule"), "value"))


SQL["historical_batches"] = f"""WITH {_PREPARED},
b AS (SELECT query_id, batch, min(o_orderkey::VARCHAR)::BIGINT AS i, count(*) AS n, sum(score) AS s FROM prepared GROUP BY 1, 2)
SELECT 'batch ok' AS rule, count(*)::DOUBLE AS value FROM b WHERE i % 3 <> 0 AND i % 4 = 0
UNION ALL SELECT 'no score', sum(n)::DOUBLE FROM b WHERE i % 3 = 0
UNION ALL SELECT 'total', round(sum(s), 6) FROM b WHERE i % 3 <> 0"""


def _reply(rows: list[dict]) -> str:
    """A scripted verifier: whole replies, and each way in which one can be refused, by the first candidate."""
    import json

    case = int(rows[0]["doc_id"]) % 9
    scores = [{"candidate_id": r["candidate_id"], "score": int(r["doc_id"]) % 11, "confidence": 0.5, "rationale" if case % 2 else "rationale_de": " ok "} for r in rows]
    if case == 0:
        return "no json"
    if case == 2:
        scores[0]["score"] = 10.5
    if case == 3:
        scores[0]["confidence"] = True
    if case == 4:
        scores[0]["rationale_de"] = " "
    if case == 5:
        scores = scores + scores[:1]
    if case == 6:
        scores[0]["candidate_id"] = "other"
    if case == 7:
        return json.dumps({"scores": {}})
    return json.dumps({"scores": scores})


@query
def scored_batches(spark, sf):
    """A provider asked batch by batch, its replies checked; batches that an earlier run has done are skipped."""
    batched = _batched(spark, sf)
    done = batched.where(F.col("query_id").cast("long") % 4 == 0).select("query_id", "batch")
    found = verify.score_batches(batched, lambda: _reply, attempts=2, pause=0.0, done=done)
    return found.groupBy(F.coalesce("problem", F.lit("scored")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))


SQL["scored_batches"] = f"""WITH {_PREPARED},
b AS (SELECT *, first_value(o_orderkey) OVER (PARTITION BY query_id, batch ORDER BY rank) % 9 AS k FROM prepared WHERE query_id::BIGINT % 4 > 0),
o AS (SELECT CASE k WHEN 0 THEN 'not JSON' WHEN 2 THEN 'score is out of range' WHEN 3 THEN 'confidence is no number' WHEN 4 THEN 'rationale is empty' WHEN 5 THEN 'candidate_id is empty or repeated' WHEN 6 THEN 'candidate ids differ' WHEN 7 THEN 'no scores array' ELSE 'scored' END AS outcome,
             query_id, batch, (o_orderkey % 11)::DOUBLE AS score FROM b)
SELECT outcome, CASE WHEN outcome = 'scored' THEN count(*) ELSE count(DISTINCT query_id || '-' || batch) END AS n, CASE WHEN outcome = 'scored' THEN round(sum(score), 6) END AS total FROM o GROUP BY outcome"""


@query
def strict_replies(spark, sf):
    """Single-document replies with exactly the expected keys; scores and confidences are JSON numbers in range; citations are in the vocabulary."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("query_id"), F.col("o_orderkey").cast("string").alias("doc_ref"), F.col("o_orderkey").alias("k"))
    said = F.concat(F.lit('{"score": '), F.when(F.col("k") % 5 == 0, '"7"').when(F.col("k") % 5 == 1, "11").otherwise("7.5"), F.lit(', "confidence": '), F.when(F.col("k") % 3 == 0, "true").otherwise("0.5"), F.lit(', "rationale_de": "'), F.when(F.col("k") % 7 == 0, " ").otherwise("gut"), F.lit('"'), F.when(F.col("k") % 11 == 0, ', "more": 1').otherwise(""), F.lit("}"))
    scored = o.withColumn("response", said).withColumn("citations", F.array(F.concat(F.lit("Art. "), (F.col("k") % 6).cast("string"), F.lit(" OR"))))
    vocabulary = spark.range(1, 6).select(F.concat(F.lit("Art. "), F.col("id").cast("string"), F.lit(" OR")).alias("citation"))
    rows, violations = online.score_documents(scored, vocabulary)
    return violations.select("rule").unionByName(rows.select(F.lit("rows").alias("rule"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


SQL["strict_replies"] = """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS bad FROM orders),
v AS (SELECT unnest(list_filter([CASE WHEN bad THEN 'reply' END, CASE WHEN bad OR k % 5 < 2 THEN 'score' END, CASE WHEN bad OR k % 3 = 0 THEN 'confidence' END, CASE WHEN bad OR k % 7 = 0 THEN 'rationale' END, CASE WHEN k % 6 = 0 THEN 'closed vocabulary' END,
        'rows'], lambda x: x IS NOT NULL)) AS rule FROM o)
SELECT rule, count(*) AS n FROM v GROUP BY rule"""


@query
def repaired_json(spark, sf):
    """Generated fields of whole, embedded and truncated JSON."""
    from ..session import ship

    ship(spark)
    p = table(spark, sf, "part")
    shape = F.col("p_partkey") % 4
    body = F.concat(F.lit('{"normal_query": "'), "p_name", F.lit('", "keywords_de": ["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]'))
    said = F.when(shape == 0, F.concat(body, F.lit("}"))).when(shape == 1, F.concat(F.lit("Here: "), body, F.lit("} done"))).when(shape == 2, F.concat(body, F.lit(',\n "keywords_en": ["x", "cut'))).otherwise(F.col("p_name"))
    found = p.select("p_partkey", jsonrepair.repair_json(said).alias("r"))
    return found.select("p_partkey", "r.normal_query", F.array_join("r.keywords_de", "|").alias("keywords_de"), F.array_join("r.keywords_en", "|").alias("keywords_en"))


SQL["repaired_json"] = """
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS normal_query, CASE WHEN p_partkey % 4 < 3 THEN p_brand || '|' || p_type END AS keywords_de, CASE WHEN p_partkey % 4 = 2 THEN 'x' END AS keywords_en FROM part"""


@query
def digest_differences(spark, sf):
    """Pinned digests against actual ones, by name; provenance rows; paths that a tree should not hold."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    name = F.concat(F.lit("f"), _string("s_suppkey"))
    pinned = s.where(k % 5 > 0).select(name.alias("name"), F.sha2(F.col("s_name").cast("binary"), 256).alias("sha256"))
    actual = s.where(k % 7 > 0).select(name.alias("name"), F.when(k % 3 == 0, F.lit("0")).otherwise(F.sha2(F.col("s_name").cast("binary"), 256)).alias("sha256"))
    differ = digests.hash_differences(pinned, actual).select(F.when(F.col("expected").isNull(), "unpinned").when(F.col("actual").isNull(), "gone").otherwise("differs").alias("finding"))
    paths = s.select(F.when(k % 4 == 0, F.concat(F.lit("a/dist/"), name)).when(k % 9 == 0, F.concat(F.lit("b/.env."), name)).otherwise(name).alias("path"), (k * 10).alias("size"))
    bad = digests.path_problems(paths, 900).select(F.col("problem").alias("finding"))
    return differ.unionByName(bad).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


SQL["digest_differences"] = """
WITH f AS (SELECT CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 7 > 0 THEN 'unpinned' WHEN s_suppkey % 5 > 0 AND s_suppkey % 7 = 0 THEN 'gone' WHEN s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 AND s_suppkey % 3 = 0 THEN 'differs' END AS finding FROM supplier
  UNION ALL SELECT CASE WHEN s_suppkey * 10 > 900 THEN 'too large' WHEN s_suppkey % 4 = 0 THEN 'generated path' WHEN s_suppkey % 9 = 0 THEN 'environment file' END FROM supplier)
SELECT finding, count(*) AS n FROM f WHERE finding IS NOT NULL GROUP BY finding"""


@query
def set_differences(spark, sf):
    """Rows that one side lacks, and prepared rows restricted to scored identities."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id")).where("query_id % 3 > 0")
    sides = integrity.equal_sets(o, c, ["query_id"])
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("query_id").alias("total"))


SQL["set_differences"] = """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0),
d AS (SELECT 'left' AS side, k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'right', k FROM b WHERE k NOT IN (SELECT k FROM a))
SELECT side, count(*) AS n, sum(k)::BIGINT AS total FROM d GROUP BY side"""


@query
def vocabulary_kinds(spark, sf):
    """Kinds of citations by lookup, and the vocabulary that documents themselves give."""
    cited = tables.candidates(spark, sf).select(F.explode("citations").alias("citation"))
    known = spark.range(1, 31).select(F.concat(F.lit("Art. "), F.col("id").cast("string"), F.lit(" OR")).alias("citation"), F.when(F.col("id") % 2 == 0, "law").otherwise("court").alias("kind"))
    looked = support.kinds(cited, known).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("lookup"))
    docs = tables.candidates(spark, sf).select(F.when(F.col("rank") % 2 == 0, F.transform("citations", lambda c: F.replace(c, F.lit("Art. "), F.lit("BGE ")))).otherwise(F.col("citations")).alias("citations"))
    own = support.corpus_vocabulary(docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.lit("corpus"))
    return looked.unionByName(own)


SQL["vocabulary_kinds"] = """
WITH cited AS (SELECT l_orderkey, l_partkey % 40 + 1 AS a FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2),
ranked AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
docs AS (SELECT DISTINCT a, rank % 2 = 0 AS court FROM cited JOIN ranked ON l_orderkey = o_orderkey)
SELECT CASE WHEN a > 30 THEN 'unknown' WHEN a % 2 = 0 THEN 'law' ELSE 'court' END AS kind, count(*) AS n, 'lookup' AS of FROM cited GROUP BY 1
UNION ALL SELECT CASE WHEN court THEN 'court' ELSE 'law' END, count(*), 'corpus' FROM docs GROUP BY 1"""


@query
def figures(spark, sf):
    """Reciprocal scores, token sums of runs, the strict mean, and a report's formatted lines."""
    o = table(spark, sf, "orders")
    ranked = tables.candidates(spark, sf).select("query_id", "rank").withColumnRenamed("rank", "position")
    scores = fusion.reciprocal_scores(ranked).groupBy(F.col("position").cast("string").alias("name")).agg(F.round(F.sum("score"), 6).alias("value")).withColumn("of", F.lit("reciprocal"))
    used = online.usage(o.select(_string("o_custkey").alias("run_id"), F.col("o_orderkey").alias("total_tokens"))).select(F.col("run_id").alias("name"), F.col("total_tokens").cast("double").alias("value"), F.lit("tokens").alias("of"))
    mean = metrics.strict_mean(o.withColumn("k", F.col("o_orderkey").cast("double")), "k")
    report = sinks.markdown_report("Run", {"Scores": [("mean", round(mean, 3)), ("orders", 5)]})
    lines = spark.createDataFrame([("report", float(len(report.split("\n"))), "report"), ("mean", round(mean, 6), "mean")], "name string, value double, of string")
    return scores.unionByName(used).unionByName(lines)


SQL["figures"] = """
WITH r AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, o_orderkey FROM orders)
SELECT p::VARCHAR AS name, round(sum(1.0::DOUBLE / p), 6) AS value, 'reciprocal' AS of FROM r WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY p
UNION ALL SELECT o_custkey::VARCHAR, sum(o_orderkey)::DOUBLE, 'tokens' FROM orders GROUP BY 1
UNION ALL SELECT 'report', 9, 'report' UNION ALL SELECT 'mean', round(avg(o_orderkey), 6), 'mean' FROM orders"""


@query
def fixture_script(spark, sf):
    """Scripted replies by purpose and, where the script names one, document."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "score").otherwise("understand").alias("purpose"), (F.col("o_orderkey") % 50).cast("string").alias("doc_ref"))
    exact = spark.range(0, 50, 5).select(F.lit("score").alias("purpose"), F.col("id").cast("string").alias("doc_ref"), F.concat(F.lit("own "), F.col("id").cast("string")).alias("response"))
    plain = spark.createDataFrame([("score", None, "any")], "purpose string, doc_ref string, response string")
    return verify.fixture_replies(o, exact.unionByName(plain)).select("o_orderkey", "purpose", "response")


SQL["fixture_script"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'score' ELSE 'understand' END AS purpose,
       CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 50 % 5 = 0 THEN 'own ' || (o_orderkey % 50) ELSE 'any' END END AS response FROM orders"""


@query
def batch_prompts(spark, sf):
    """Digests of each batch's prompt and settings, canonical JSON with sorted keys."""
    p = table(spark, sf, "supplier")
    key = _string("s_suppkey")
    rows = p.select(key.alias("query_id"), F.lit(0).alias("batch"), F.lit(0).alias("slot"), F.concat(F.lit("c"), key).alias("candidate_id"), F.lit("ask").alias("query"), (F.col("s_suppkey") % 2).alias("rank"), F.col("s_name").alias("document_text"))
    return verify.batch_digests(rows, providers.batch_prompt("Head", "Ids:"), {"model": "m", "max_tokens": 5}).select("query_id", "batch_sha256")


SQL["batch_prompts"] = r"""
SELECT s_suppkey::VARCHAR AS query_id, sha256('{"max_tokens":5,"model":"m","user_prompt":"Head\nask\n\n\n\n\n---\ncandidate_id: c' || s_suppkey || '\nrank: ' || (s_suppkey % 2) || '\nfusion_score: None\nhits: []\n' || s_name || '\nIds:\n[\"c' || s_suppkey || '\"]"}') AS batch_sha256 FROM supplier"""


@query
def input_fingerprints(spark, sf):
    """Digests of the canonical JSON that saved scores are bound to."""
    p = table(spark, sf, "part").select(_string("p_partkey").alias("query_id"), F.col("p_name").alias("query"), F.lit("").alias("meta_query"), F.lit("").alias("keywords_query"), _string("p_partkey").alias("doc_id"), F.col("p_size").alias("rank"), F.col("p_partkey").alias("global_idx"), F.lit(0.5).alias("fusion_score"), F.col("p_type").alias("document_text"))
    return verify.fingerprinted(p, "m", "v1", "system", 6).select("query_id", "input_sha256")


SQL["input_fingerprints"] = r"""
SELECT p_partkey::VARCHAR AS query_id, sha256('{"doc_id":"' || p_partkey || '","document_char_limit":6,"effective_document":"' || CASE WHEN length(p_type) > 6 THEN substr(p_type, 1, 6) || ' …[truncated]' ELSE p_type END || '","fusion_score":0.5,"global_idx":' || p_partkey
  || ',"hits":[],"keywords_query":"","meta_query":"","model":"m","prompt_version":"v1","query":"' || p_name || '","query_id":"' || p_partkey || '","rank":' || p_size || ',"system_prompt_sha256":"' || sha256('system') || '"}') AS input_sha256 FROM part"""


@query
def macro_perturbation(spark, sf):
    """Means of the targeted effects over all cases, and how many cases each policy description covers."""
    from .catalog import _cases

    found = analysis.perturbation_effects(_cases(spark, sf))
    described = F.lit(gate.Policy().describe())
    return found.agg(F.round(F.avg("targeted_aopc"), 6).alias("targeted_aopc"), F.count(F.lit(1)).alias("queries")).withColumn("policy", described)


SQL["macro_perturbation"] = """
WITH e AS (SELECT user_id, floor(value * 4) / 4.0::DOUBLE AS effect, event_type = 'purchase' AS ev FROM events),
c AS (SELECT avg(effect) FILTER (ev) AS a FROM e GROUP BY user_id HAVING count(*) FILTER (ev) > 0 AND count(*) FILTER (NOT ev) >= count(*) FILTER (ev))
SELECT round(avg(a), 6) AS targeted_aopc, count(*) AS queries, 'dense votes >= 4 of top 10; or rank <= 3 with score >= 8.5; or support >= 2 of top 5' AS policy FROM c"""


@query
def sigmoid_and_views(spark, sf):
    """The stable sigmoid, lists joined, blank encoder texts, and document citations."""
    p = table(spark, sf, "part")
    x = (F.col("p_size") - 25) * 40.0
    docs = p.withColumns({"full_text": F.concat(F.lit("Gemäss Art. "), _string("p_size"), F.lit(" OR und BGE 140 III 1 gilt.")), **{c: F.lit(None).cast("string") for c in text.FULLTEXT_FIELDS if c != "full_text"}})
    return docs.select(
        "p_partkey", F.round(numbers.sigmoid(x), 9).alias("sigmoid"), text.join_list(F.array(F.concat(F.lit(" "), "p_name"), F.lit(" "), "p_brand")).alias("joined"),
        text.encoder_text(F.when(F.col("p_size") % 2 == 0, "   ").otherwise(F.col("p_name"))).alias("encoder"), text.document_citations([F.lit("Art. 1 OR")]).alias("citations"),
    )


SQL["sigmoid_and_views"] = """
SELECT p_partkey, round(CASE WHEN p_size >= 25 THEN 1 / (1 + exp(-(p_size - 25) * 40.0::DOUBLE)) ELSE exp((p_size - 25) * 40.0::DOUBLE) / (1 + exp((p_size - 25) * 40.0::DOUBLE)) END, 9) AS sigmoid, p_name || ' ; ' || p_brand AS joined,
  CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_name END AS encoder, 'Art. 1 OR' || CASE WHEN p_size <> 1 THEN ' ; Art. ' || p_size || ' OR' ELSE '' END || ' ; BGE 140 III 1' AS citations FROM part"""


@query
def envelope_faults(spark, sf):
    """Completions whose usage, reasoning or content break the envelope's rules, and ones with reasoning apart."""
    c = table(spark, sf, "conversations")
    shape = F.col("turn") % 9
    usage = (
        F.when(shape == 0, '"usage": {"total_tokens": "12"}').when(shape == 1, '"usage": {"total_tokens": 1.5}').when(shape == 2, '"usage": {"prompt_tokens": true}').when(shape == 3, '"usage": {"total_tokens": -1}')
        .when(shape == 4, '"usage": {"completion_tokens_details": {"reasoning_tokens": 3}, "total_tokens": 9}').when(shape == 5, '"usage": [1]').otherwise('"usage": null')
    )
    message = F.when(shape == 6, '"content": "yes", "reasoning_content": " why "').when(shape == 7, '"content": "<think> a </think> yes", "reasoning_content": 5').otherwise('"content": "<think> a </think> yes"')
    body = F.concat(F.lit('{"model": "m", "choices": [{"message": {'), message, F.lit('}, "finish_reason": "stop"}], '), usage, F.lit("}"))
    found = c.select("conv_id", "turn", verify.envelope(body, F.lit("asked")).alias("e"))
    return found.select("conv_id", "turn", "e.content", "e.model", "e.reasoning", "e.total_tokens", "e.reasoning_tokens", "e.problem")


SQL["envelope_faults"] = """
WITH c AS (SELECT conv_id, turn, turn % 9 AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN s IN (4, 6, 8) THEN 'yes' END AS content, 'm' AS model, CASE WHEN s = 6 THEN 'why' ELSE 'a' END AS reasoning,
  CASE s WHEN 3 THEN -1 WHEN 4 THEN 9 ELSE 0 END::BIGINT AS total_tokens, CASE WHEN s = 4 THEN 3 ELSE 0 END::BIGINT AS reasoning_tokens,
  CASE WHEN s IN (0, 1, 2, 3, 5) THEN 'invalid usage' WHEN s = 7 THEN 'invalid reasoning' END AS problem FROM c"""


@query
def required_lists(spark, sf):
    """Closed-vocabulary lists as they must be: sorted and distinct, with every unknown entry named."""
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    known = spark.createDataFrame([(w,) for w in ("part", "item")], "citation string")
    long = p.select("p_partkey", F.explode(support.required(F.col("words"))).alias("citation"))
    unknown = support.outside(long, known).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("citation")), "|").alias("unknown"))
    return p.select("p_partkey", F.array_join(support.required(F.col("words")), "|").alias("needed")).join(unknown, "p_partkey", "left")


SQL["required_lists"] = """
WITH w AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part)
SELECT p_partkey, array_to_string(w, '|') AS needed, nullif(array_to_string(list_filter(w, lambda x: x NOT IN ('part', 'item')), '|'), '') AS unknown FROM w"""
