"""Analyses of saved results: error attribution, context metrics, gate surrogate, perturbations."""

from __future__ import annotations

import random
import statistics
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import harmonic
from ..session import ship
from . import metrics

CATEGORIES = ("correct", "retrieval_miss", "gate_miss", "selected_false_positive", "unsupported_false_positive", "unsupported_correct")


def error_attribution(joined: DataFrame) -> DataFrame:
    """Six categories of citations for each query (query_id, gold, retrieved, predicted arrays); order is kept."""
    has = lambda name: lambda c: F.array_contains(F.col(name), c)
    g, r, p = has("gold"), has("retrieved"), has("predicted")
    pick = lambda source, keep: F.filter(F.col(source), keep)
    return joined.select(
        "query_id",
        pick("gold", p).alias("correct"),
        pick("gold", lambda c: ~r(c)).alias("retrieval_miss"),
        pick("gold", lambda c: r(c) & ~p(c)).alias("gate_miss"),
        pick("predicted", lambda c: r(c) & ~g(c)).alias("selected_false_positive"),
        pick("predicted", lambda c: ~r(c) & ~g(c)).alias("unsupported_false_positive"),
        pick("predicted", lambda c: ~r(c) & g(c)).alias("unsupported_correct"),
        metrics.analysis_recall("gold", "retrieved").alias("retrieval_recall"),
        metrics.analysis_recall("gold", "predicted").alias("prediction_recall"),
    )


def macro_attribution(attributed: DataFrame) -> DataFrame:
    """Total counts of the categories, and the two mean recalls."""
    counts = [F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(c) for c in CATEGORIES]
    return attributed.agg(*counts, F.avg("retrieval_recall").alias("retrieval_recall"), F.avg("prediction_recall").alias("prediction_recall"))


def context_metrics(joined: DataFrame, k: int = 10) -> DataFrame:
    """Six metrics a query over its first k retrieved citations."""
    context = F.slice("retrieved", 1, k)
    df = joined.withColumn("__context", context)
    df = df.select(
        "query_id",
        metrics.context_precision("gold", F.col("__context")).alias("context_precision"),
        metrics.analysis_recall("gold", "__context").alias("context_recall"),
        metrics.faithfulness(F.col("__context"), "predicted").alias("faithfulness"),
        metrics.analysis_precision("gold", "predicted").alias("answer_precision"),
        metrics.analysis_recall("gold", "predicted").alias("answer_recall"),
    )
    return df.withColumn("answer_f1", harmonic(F.col("answer_precision"), F.col("answer_recall")))


def macro_means(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(c) for c in names])


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale) with the population deviation, 1 for a constant feature."""
    stats = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")).alias(c) for c in columns])
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["deviation"].alias("deviation")) for c in columns])).alias("s"))
    return rows.select("s.feature", "s.mean", F.when(F.col("s.deviation") > 0, F.col("s.deviation")).otherwise(1.0).alias("scale"))


def _stable_sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


SURROGATE = "query_id string, citation string, accepted boolean, probability double, prediction boolean, intercept double, contributions map<string,double>, log_odds double, raw_coefficients map<string,double>, accuracy double, brier double, log_loss double"


#: Rows of a task of the surrogate's fit.
SURROGATE_ROWS = 50_000


def _matrix(frames: list[pd.DataFrame]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the features, and a task's rows as numbers."""
    maps = [dict(f) for rows in frames for f in rows["features"]]
    names = sorted(maps[0]) if maps else []
    y = np.concatenate([rows["accepted"].to_numpy(float) for rows in frames]) if frames else np.zeros(0)
    return names, np.array([[m[n] for n in names] for m in maps], float).reshape(len(maps), len(names)), y


def _descend(total: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray], iterations: int, rate: float, l2: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Means, scales, intercept and coefficients by full-batch steps from zero; only coefficients are penalised.

    ``total`` sums a function of (rows, labels) over all rows.
    """
    n, *sums = total(lambda x, y: np.concatenate([[len(y)], x.sum(axis=0)]))
    means = np.array(sums) / n
    deviations = np.sqrt(total(lambda x, y: ((x - means) ** 2).sum(axis=0)) / n)
    scales = np.where(deviations > 0, deviations, 1.0)
    bias, weights = 0.0, np.zeros(len(means))
    for _ in range(iterations):

        def gradient(x: np.ndarray, y: np.ndarray, bias: float = bias, weights: np.ndarray = weights) -> np.ndarray:
            z = (x - means) / scales
            off = _stable_sigmoid(bias + z @ weights) - y
            return np.concatenate([[off.sum()], z.T @ off])

        step = total(gradient) / n
        bias, weights = bias - rate * step[0], weights - rate * (step[1:] + l2 * weights)
    return means, scales, float(bias), weights


def _fit_in_one_task(rows: DataFrame, iterations: int, rate: float, l2: float) -> tuple | None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, x, y = _matrix(list(batches))
        if len(y):
            means, scales, bias, weights = _descend(lambda f: f(x, y), iterations, rate, l2)
            yield pd.DataFrame({"names": [names], "means": [means.tolist()], "scales": [scales.tolist()], "bias": [bias], "weights": [weights.tolist()]})

    found = rows.mapInPandas(run, "names array<string>, means array<double>, scales array<double>, bias double, weights array<double>").collect()
    return (list(found[0]["names"]), np.array(found[0]["means"]), np.array(found[0]["scales"]), found[0]["bias"], np.array(found[0]["weights"])) if found else None


def _fit_over_tasks(rows: DataFrame, iterations: int, rate: float, l2: float) -> tuple | None:
    """Rows stay with their tasks as matrices; a step sends the weights and gets a sum a task, added in the tasks' order."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, x, y = _matrix(list(batches))
        if len(y):
            yield pd.DataFrame({"names": [names], "x": [x.tobytes()], "y": [y.tobytes()]})

    packed = rows.mapInPandas(pack, "names array<string>, x binary, y binary").persist()
    try:
        known = packed.select("names").distinct().collect()
        if not known:
            return None
        if len(known) > 1:
            raise ValueError("rows have different features")

        def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for held in batches:
                    yield pd.DataFrame({"s": [f(np.frombuffer(x).reshape(len(y) // 8, -1), np.frombuffer(y)).tolist() for x, y in zip(held["x"], held["y"], strict=True)]})

            parts = [np.array(r["s"]) for r in packed.select("x", "y").mapInPandas(run, "s array<double>").collect()]
            return sum(parts[1:], parts[0])

        return (list(known[0]["names"]), *_descend(total, iterations, rate, l2))
    finally:
        packed.unpersist()


def gate_surrogate(candidates: DataFrame, iterations: int = 2_000, rate: float = 0.1, l2: float = 0.01, threshold: float = 0.5, tasks: int | None = None) -> DataFrame:
    """A linear logistic surrogate of the gate, explained row by row.

    candidates: (query_id, citation, accepted, features map). Contributions sum
    to the log-odds. The fit is a fixed number of full-batch steps from zero and
    runs when this is called, as do the three measures: in one task up to
    SURROGATE_ROWS rows, else with a job for each step over ``tasks`` partitions.
    The explanation is a plan over all rows.
    """
    if iterations <= 0 or rate <= 0 or l2 < 0 or not 0 < threshold < 1:
        raise ValueError("iterations and rate must be positive, l2 non-negative, the threshold in (0, 1)")
    spark = candidates.sparkSession
    ship(spark)
    order = ["query_id", "citation"]
    tasks = tasks or max(1, -(-candidates.count() // SURROGATE_ROWS))
    given = candidates.select(*order, "accepted", "features")
    dealt = (given.repartition(1) if tasks == 1 else given.repartitionByRange(tasks, *order)).sortWithinPartitions(*order)
    fitted = (_fit_in_one_task if tasks == 1 else _fit_over_tasks)(dealt, iterations, rate, l2)
    if fitted is None:
        return spark.createDataFrame([], SURROGATE)
    names, means, scales, bias, weights = fitted

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own, x, _ = _matrix([rows])
            if own and own != names:
                raise ValueError("rows have different features")
            parts = (x - means) / scales * weights
            odds = bias + parts.sum(axis=1)
            p = _stable_sigmoid(odds)
            yield pd.DataFrame(
                {
                    "query_id": rows["query_id"], "citation": rows["citation"], "accepted": rows["accepted"], "probability": p, "prediction": p >= threshold, "intercept": bias,
                    "contributions": [dict(zip(names, map(float, row), strict=True)) for row in parts], "log_odds": odds,
                    "raw_coefficients": [dict(zip(names, map(float, weights / scales), strict=True))] * len(rows),
                }
            )

    plain = SURROGATE.split(", accuracy")[0]
    told = dealt.mapInPandas(explain, plain)
    hit, p = F.col("accepted").cast("double"), F.col("probability")
    clip = lambda q: F.log(F.greatest(q, F.lit(1e-15)))
    measures = told.agg(
        F.avg((F.col("prediction") == F.col("accepted")).cast("double")).alias("accuracy"),
        F.avg((p - hit) * (p - hit)).alias("brier"),
        F.avg(-(hit * clip(p) + (1 - hit) * clip(1 - p))).alias("log_loss"),
    )
    return told.withColumns({name: F.lit(value) for name, value in measures.first().asDict().items()})


def perturbation_effects(cases: DataFrame) -> DataFrame:
    """Mean drop of the score over evidence and over control ablations (query_id, full_score, ablations)."""
    effect = F.transform("ablations", lambda a: F.struct(a["feature"].alias("feature"), (F.col("full_score") - a["score_without_feature"]).alias("effect"), a["is_evidence"].alias("is_evidence")))
    df = cases.withColumn("__effects", effect)
    side = lambda want: F.filter("__effects", lambda e: e["is_evidence"] == want)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, e: s + e["effect"]) / F.size(xs)
    return df.select("query_id", "full_score", F.size(side(True)).alias("evidence"), F.size(side(False)).alias("controls"), mean(side(True)).alias("targeted_aopc"), mean(side(False)).alias("control_mean"))


PERTURBED = "query_id string, targeted_aopc double, random_aopc double, random_std double, gap double"


def perturbation_faithfulness(cases: DataFrame, seed: int = 17, trials: int = 1_000) -> DataFrame:
    """Targeted drop against random control samples of the same size, drawn with a seed of the query's own."""
    import hashlib

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query_id, full, ablations in zip(rows["query_id"], rows["full_score"], rows["ablations"], strict=True):
            drops: dict[bool, list[float]] = {True: [], False: []}
            for a in ablations:
                drops[bool(a["is_evidence"])].append(full - a["score_without_feature"])
            draw = random.Random(int.from_bytes(hashlib.sha256(f"{seed}\0{query_id}".encode()).digest()[:8], "big"))
            size = len(drops[True])
            means = [sum(s) / size for s in (draw.sample(drops[False], k=size) for _ in range(trials))]
            targeted, baseline = sum(drops[True]) / size, sum(means) / trials
            out.append((query_id, targeted, baseline, statistics.pstdev(means), targeted - baseline))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PERTURBED.split(", ")])

    return cases.groupBy("query_id").applyInPandas(run, PERTURBED)
