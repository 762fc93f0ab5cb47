"""Verifier scores: fingerprints, replay of saved scores, parsing of replies, live batches with resume."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, split_reasoning, truncated
from ..session import ship
from ..sources import places
from . import integrity

SCORE = "candidate_id string, score double, confidence double, rationale string, problem string"


def canonical(value: object) -> bytes:
    """JSON with sorted keys, no spaces and non-ASCII letters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()


def _plain(value):
    """Rows, arrays and missing numbers as plain values."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value


_INPUT = ("query_id", "query", "meta_query", "keywords_query", "doc_id", "rank", "global_idx", "fusion_score", "hits", "effective_document")


def input_payload(row: dict, model: str, prompt_version: str, system_prompt: str, limit: int) -> dict:
    """What a cached score is bound to. Text is cleaned but for the document."""
    return {k: row.get(k) for k in _INPUT} | {"prompt_version": prompt_version, "system_prompt_sha256": hashlib.sha256(system_prompt.encode()).hexdigest(), "model": model, "document_char_limit": limit, "hits": row.get("hits") or []}


def fingerprinted(prepared: DataFrame, model: str, prompt_version: str, system_prompt: str, limit: int = 0) -> DataFrame:
    """Adds input_sha256. Python writes the JSON, as its numbers' text is part of the digest."""
    ready = prepared.withColumns({c: clean(F.col(c)) for c in ("query", "meta_query", "keywords_query")}).withColumn("effective_document", truncated(F.col("document_text"), limit))
    columns = [F.col(c) if c in ready.columns else F.lit(None).cast("string").alias(c) for c in _INPUT]

    ship(prepared.sparkSession)

    @F.pandas_udf("string")
    def digest(rows: pd.DataFrame) -> pd.Series:
        out = []
        for record in rows.to_dict("records"):
            record = _plain(record)
            if isinstance(record.get("global_idx"), float):
                record["global_idx"] = int(record["global_idx"])
            out.append(hashlib.sha256(canonical(input_payload(record, model, prompt_version, system_prompt, limit))).hexdigest())
        return pd.Series(out)

    own = ready.withColumn("input_sha256", digest(F.struct(*columns)))
    return own.drop("effective_document")


def batch_digests(batched: DataFrame, prompt: Callable[[list[dict]], str], settings: dict) -> DataFrame:
    """(query_id, batch, batch_sha256) of each batch's prompt and the settings; rows go by slot."""
    ship(batched.sparkSession)
    if "user_prompt" in settings:
        raise ValueError("the prompt is made here")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("slot").to_dict("records")
        payload = settings | {"user_prompt": prompt([_plain(r) for r in ordered])}
        return pd.DataFrame({"query_id": [ordered[0]["query_id"]], "batch": [ordered[0]["batch"]], "batch_sha256": [hashlib.sha256(canonical(payload)).hexdigest()]})

    return batched.groupBy("query_id", "batch").applyInPandas(run, "query_id string, batch int, batch_sha256 string")


def replay(prepared: DataFrame, saved: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Saved scores joined to the inputs they were made for, and the violations.

    Both sides must be complete; model, rank and input digest must agree.
    """
    inner, incomplete = integrity.complete_join(prepared, saved.withColumnsRenamed({"rank": "saved_rank", "input_sha256": "saved_sha256"}), ["candidate_id"])
    rules = {"model": F.col("model") == model, "rank": F.col("rank") == F.col("saved_rank"), "input digest": F.col("input_sha256") == F.col("saved_sha256"), "score": F.col("score").between(0, 10), "confidence": F.col("confidence").between(0, 1)}
    violations = integrity.all_of(incomplete, integrity.duplicates(saved, ["candidate_id"]), integrity.record_rules(inner, ["candidate_id"], rules))
    return inner.select("query_id", "candidate_id", "doc_id", "rank", "score", "confidence", "rationale"), violations


def parse_scores(reply: str | None, expected: Sequence[str]) -> list[tuple]:
    """Rows of SCORE from a verifier's JSON reply; on any problem one row that tells it."""
    bad = lambda why, who=None: [(who, None, None, None, why)]
    try:
        payload = json.loads(reply or "")
    except ValueError:
        return bad("not JSON")
    if not isinstance(payload, dict) or not isinstance(payload.get("scores"), list):
        return bad("no scores array")
    out: dict[str, tuple] = {}
    for item in payload["scores"]:
        if not isinstance(item, dict):
            return bad("score is no object")
        who = str(item.get("candidate_id") or "")
        if not who or who in out:
            return bad("candidate_id is empty or repeated", who)
        numbers = []
        for field, top in (("score", 10.0), ("confidence", 1.0)):
            v = item.get(field)
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                return bad(f"{field} is no number", who)
            if not 0 <= v <= top:  # NaN fails too
                return bad(f"{field} is out of range", who)
            numbers.append(float(v))
        said = " ".join(str(item.get("rationale") or item.get("rationale_de") or "").split())
        if not said:
            return bad("rationale is empty", who)
        out[who] = (who, *numbers, said, None)
    if set(out) != set(expected):
        return bad("candidate ids differ")
    return [out[w] for w in expected]


#: Folders of a store; a task reads one of them at a time.
BUCKETS = 512


class BatchStore:
    """Scores that have been paid for: a line for each batch, in a folder that all executors share.

    Batches are dealt over BUCKETS folders by query and number. Whoever scores a
    bucket reads what it holds and appends to a file of its own, a line as soon
    as a batch is scored, so the number of files does not grow with the batches.
    A line names the digest of the batch's rows and settings.
    """

    def __init__(self, root: str):
        self.root, self.number, self.kept, self.lines = root.rstrip("/"), None, {}, None

    def open(self, number: int | None) -> None:
        """Close the bucket that is open and read another one, if any."""
        if number != self.number:
            if self.lines:
                self.lines.close()
            self.number, self.kept, self.lines = number, {}, None
            if number is not None:
                folder = f"{self.root}/{number:04d}"
                self.lines = places.Lines(folder)
                for line in places.read_lines(folder):
                    self.kept[json.loads(line)["batch_sha256"]] = line

    def get(self, digest: str, expected: Sequence[str]) -> list[tuple] | None:
        if digest not in self.kept:
            return None
        rows = [(s["candidate_id"], s["score"], s["confidence"], s["rationale"], None) for s in json.loads(self.kept[digest])["scores"]]
        if [r[0] for r in rows] != list(expected):
            raise integrity.IntegrityError(f"{self.root}/{self.number:04d} holds another batch as {digest}")
        return rows

    def put(self, digest: str, query_id: str, batch: int, rows: list[tuple]) -> None:
        scores = [dict(zip(("candidate_id", "score", "confidence", "rationale"), r[:4], strict=True)) for r in rows]
        line = canonical({"batch_sha256": digest, "query_id": query_id, "batch": batch, "scores": scores})
        self.lines.add(line)
        self.kept[digest] = line


def stored_scores(spark: SparkSession, store: str) -> DataFrame:
    """(query_id, batch, batch_sha256, slot, candidate_id, score, confidence, rationale) of a store, as far as it came.

    A batch that two copies of a task have asked counts once; what an
    interrupted task left of its last line does not count.
    """
    score = "struct<candidate_id:string,score:double,confidence:double,rationale:string>"
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED")
    lines = read.schema(f"query_id string, batch int, batch_sha256 string, scores array<{score}>").json(store).dropDuplicates(["batch_sha256"])
    return lines.select("query_id", "batch", "batch_sha256", F.posexplode("scores").alias("slot", "s")).select("query_id", "batch", "batch_sha256", "slot", "s.*")


def _grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[list[dict]]:
    """Stretches of rows with equal keys, some rows at a time."""
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if held and any(row[k] != held[0][k] for k in keys):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def score_batches(
    batched: DataFrame,
    make_provider: Callable[[], Callable[[list[dict]], str]],
    attempts: int = 3,
    pause: float = 1.0,
    done: DataFrame | None = None,
    store: str | None = None,
    settings: dict | None = None,
) -> DataFrame:
    """Asks a provider for each batch's scores, with retries; batches in ``done`` (query_id, batch) are skipped.

    With a ``store``, a batch's scores are kept under the digest of its rows and
    of ``settings`` (model, prompt and the like) before the next batch is asked,
    and a batch that is kept is not asked again: not by a task that is repeated,
    not by another action on the same rows, not by a later run. (Two copies of a
    task that run at once may still both ask; leave speculation off.) A batch
    that fails at last gives rows with a problem and is not kept, so the caller
    can use what succeeded and resume. Batches are dealt out and sorted; a task
    goes through them one after the other.
    """
    ship(batched.sparkSession)
    root = places.qualified(batched.sparkSession, store) if store else None
    left = batched if done is None else batched.join(done.select("query_id", "batch").distinct(), ["query_id", "batch"], "left_anti")
    keys = ["query_id", "batch"]
    schema = f"query_id string, batch int, {SCORE}"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([("query_id", pa.string()), ("batch", pa.int32()), ("candidate_id", pa.string()), ("score", pa.float64()), ("confidence", pa.float64()), ("rationale", pa.string()), ("problem", pa.string())])

    def scored(ordered: list[dict], kept: BatchStore | None) -> list[tuple]:
        expected = [r["candidate_id"] for r in ordered]
        if kept:
            digest = hashlib.sha256(canonical({"settings": settings or {}, "rows": ordered})).hexdigest()
            if result := kept.get(digest, expected):
                return result
        result, provider = [], make_provider()
        for attempt in range(attempts):
            try:
                result = parse_scores(provider(ordered), expected)
            except Exception as error:  # a provider may fail in any way; the text is kept
                result = [(None, None, None, None, f"provider: {error}")]
            if result[0][4] is None:
                break
            if attempt + 1 < attempts:
                time.sleep(pause * (attempt + 1))
        if kept and result[0][4] is None:
            kept.put(digest, ordered[0]["query_id"], ordered[0]["batch"], result)
        return result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, out = BatchStore(root) if root else None, []
        for rows in _grouped(batches, keys):
            if kept:
                kept.open(rows[0]["__bucket"])
            ordered = [{k: _plain(v) for k, v in r.items() if k != "__bucket"} for r in rows]
            out += [(ordered[0]["query_id"], ordered[0]["batch"], *r) for r in scored(ordered, kept)]
            if len(out) >= 4_096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds)
                out = []
        if kept:
            kept.open(None)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds)

    dealt = left.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")) if store else left
    by = ["__bucket"] if store else keys
    return dealt.repartition(*by).sortWithinPartitions(*by, *(keys if store else []), "slot").mapInArrow(run, schema)


def strict_number(value: Column) -> Column:
    """Whether a VARIANT holds a JSON number (true and false are none)."""
    return F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")


def strict_object(text: Column, keys: Sequence[str]) -> Column:
    """Null unless the text is one JSON object with exactly these keys; then the VARIANT."""
    parsed = F.try_parse_json(text)
    names = F.json_object_keys(text)
    exact = F.array_sort(names) == F.array_sort(F.array(*map(F.lit, keys)))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT") & exact, parsed)


def envelope(body: Column, requested_model: Column) -> Column:
    """struct(content, model, finish_reason, reasoning, four token counts, problem) of a chat completion's JSON.

    Content is the final answer; a separate ``reasoning_content`` and a leading
    ``<think>`` block are the reasoning, two line breaks apart. Counts are whole
    numbers of JSON, 0 where they are missing; null, texts, fractions, true and
    negative numbers are a problem.
    """
    # Each step's value is bound once, so the expression stays small.
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    return let(F.try_parse_json(body), lambda parsed: let(_message(parsed), lambda m: let(split_reasoning(m["raw"]), lambda split: _normalised(m, split, requested_model))))


def _message(parsed: Column) -> Column:
    """struct of what a parsed completion holds, and of the rules that it breaks by its types."""
    get = lambda path, kind="string": F.try_variant_get(parsed, path, kind)
    kind = lambda path: F.schema_of_variant(get(path, "variant"))
    is_ = lambda path, name: F.coalesce(F.startswith(kind(path), F.lit(name)), F.lit(False))
    message, usage = "$.choices[0].message", "$.usage"
    details = f"{usage}.completion_tokens_details"
    raw = F.when(is_(f"{message}.content", "STRING"), get(f"{message}.content"))
    provider = f"{message}.reasoning_content"
    given = lambda path: F.coalesce(kind(path) != "VOID", F.lit(False))
    # An empty value of any kind counts as missing, anything else must be an object.
    empty = lambda path: ~given(path) | get(path).isin("", "0", "false", "[]", "{}")
    places = {"total_tokens": usage, "prompt_tokens": usage, "completion_tokens": usage, "reasoning_tokens": details}
    tokens = {n: F.when(is_(f"{at}.{n}", "BIGINT"), get(f"{at}.{n}", "bigint")) for n, at in places.items()}
    broken = [get(f"{at}.{n}", "variant").isNotNull() & ~F.coalesce(tokens[n] >= 0, F.lit(False)) for n, at in places.items()]
    broken += [~empty(at) & ~is_(at, "OBJECT") for at in (usage, details)]
    return F.struct(
        raw.alias("raw"), get("$.model").alias("model"), get("$.choices[0].finish_reason").alias("finish"), F.when(is_(provider, "STRING"), get(provider)).alias("reasoning"), *[t.alias(n) for n, t in tokens.items()],
        (parsed.isNull() | ~is_(message, "OBJECT")).alias("no_message"), (given(provider) & ~is_(provider, "STRING")).alias("bad_reasoning"), reduce(lambda a, b: a | b, broken).alias("bad_usage"),
    )


def _normalised(m: Column, split: Column, requested_model: Column) -> Column:
    problem = (
        F.when(m["no_message"], F.lit("invalid envelope"))
        .when(F.coalesce(m["finish"] == "length", F.lit(False)), F.lit("truncated"))
        .when(m["raw"].isNull() | (clean(m["raw"]) == ""), F.lit("no content"))
        .when(split["problem"].isNotNull(), F.concat(F.lit("reasoning is "), split["problem"]))
        .when(m["bad_reasoning"], F.lit("invalid reasoning"))
        .when(m["bad_usage"], F.lit("invalid usage"))
    )
    reasoning = F.nullif(F.concat_ws("\n\n", F.nullif(F.trim(m["reasoning"]), F.lit("")), split["reasoning"]), F.lit(""))
    counts = [F.coalesce(m[n], F.lit(0)).alias(n) for n in ("total_tokens", "prompt_tokens", "completion_tokens", "reasoning_tokens")]
    return F.struct(
        F.when(problem.isNull(), split["answer"]).alias("content"), F.coalesce(F.nullif(m["model"], F.lit("")), requested_model).alias("model"), m["finish"].alias("finish_reason"), reasoning.alias("reasoning"), *counts, problem.alias("problem"),
    )


def fixture_replies(requests: DataFrame, script: DataFrame) -> DataFrame:
    """Scripted replies by purpose and, where the script names one, document."""
    exact = requests.join(script.where("doc_ref IS NOT NULL"), ["purpose", "doc_ref"], "left").withColumnRenamed("response", "__exact")
    plain = script.where("doc_ref IS NULL").select("purpose", F.col("response").alias("__plain"))
    return exact.join(plain, "purpose", "left").withColumn("response", F.coalesce("__exact", "__plain")).drop("__exact", "__plain")


def historical_scores(lines: DataFrame, model_key: str) -> tuple[DataFrame, DataFrame]:
    """Scores of a model in saved batch records (model_key, ok, batch_id, scores array), and failed batches as violations."""
    own = lines.where(F.col("model_key") == model_key)
    failed = own.where(~F.coalesce("ok", F.lit(False))).select(F.lit("batch ok").alias("rule"), F.col("batch_id").cast("string").alias("key"), F.lit("batch failed").alias("message"))
    return own.select("batch_id", F.explode("scores").alias("s")).select("batch_id", "s.*"), failed


def checkpoint_violations(saved: DataFrame, batches: DataFrame) -> DataFrame:
    """Saved batches (query_id, batch, batch_sha256, candidate_id) that are no current batch, or whose rows differ."""
    keys = ["query_id", "batch", "batch_sha256"]
    stale = integrity.missing(saved, batches, keys, "stale batch")
    own = batches.join(saved.select(*keys).distinct(), keys, "left_semi")
    rows = [*keys, "candidate_id"]
    return integrity.all_of(stale, integrity.duplicates(saved, ["candidate_id"]), integrity.missing(own, saved, rows, "incomplete batch"))


def batch_shape(batched: DataFrame, queries: int, batches: int, candidates: int) -> DataFrame:
    """Violations unless the batches have exactly these counts and each query's ranks are 1..n."""
    facts = batched.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("query_id", "batch").alias("b"), F.count(F.lit(1)).alias("c"))
    counts = {"queries": F.col("q") == queries, "batches": F.col("b") == batches, "candidates": F.col("c") == candidates}
    return integrity.all_of(integrity.record_rules(facts, [], counts), integrity.contiguous(batched, ["query_id"], "rank"))


def same_settings(saved: dict, now: dict) -> None:
    """A run may only be resumed with the settings and inputs it was begun with."""
    changed = sorted(k for k in {*saved, *now} if saved.get(k) != now.get(k))
    if changed:
        raise integrity.IntegrityError("resumed with other settings: " + ", ".join(changed))
