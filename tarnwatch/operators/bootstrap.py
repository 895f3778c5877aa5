"""Stratified bootstrap of the differences between two models, without multiplying a row.

Resampling rows of one class that have the same scores is resampling their number: how often a cell of equal rows is drawn is
multinomial over the cells of the class. So rows are first counted in cells (class, score step of the candidate, score step of
the champion), natively and in one aggregation; a group has at most 2 * (resolution + 2) ** 2 of them, whatever its size. Each
replicate then draws the weights of all cells, class by class by conditional binomials, so that every class keeps its size, and takes
all metrics from sums over score steps. Replicates are dealt in blocks over the cluster; each has a random stream of its own, from
seed and number, so that the result depends neither on the layout nor on lost tasks.

Decision thresholds are ends of steps: precision, recall and F1 are those of the rows. Brier score and calibration error use the
means of a cell, ranking metrics treat scores of one step as ties; `resolution` says how fine the steps are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.config import GatePolicy
from tarnwatch.operators.gates import input_verdict
from tarnwatch.operators.metrics import full_metrics, grouped, ungrouped

METRICS = ("average_precision", "recall", "precision", "f1", "roc_auc", "brier_score", "expected_calibration_error")
MODELS = ("candidate", "champion")
BLOCK = 200             # replicates of one task
PACKS = 16              # rows that the cells of a group are packed into


def score_steps(resolution: int, thresholds: Sequence[float]) -> list[float]:
    """Inner ends of the steps: equal ones over [0, 1], and the decision thresholds."""
    return sorted({k / resolution for k in range(1, resolution)} | {float(t) for t in thresholds if 0 < t < 1})


def comparison_cells(
    df: DataFrame, label: str, candidate: str, champion: str, steps: Sequence[float], by: Sequence[str] = (),
) -> DataFrame:
    """(by..., y, candidate, champion, n, candidate_sum, candidate_error, champion_sum, champion_error): rows of one class and one
    step of both scores, with the sums of scores and squared errors."""
    base = df.select(*by, F.col(label).cast("int").alias("y"), F.col(candidate).cast("double").alias("__candidate"),
                     F.col(champion).cast("double").alias("__champion"))
    placed = Bucketizer(splitsArray=[[-math.inf, *steps, math.inf]] * 2, inputCols=["__candidate", "__champion"], outputCols=list(MODELS),
                        handleInvalid="skip").transform(base)
    sums: list[Column] = []
    for model in MODELS:
        gap = F.col(f"__{model}") - F.col("y")
        sums += [F.sum(f"__{model}").alias(f"{model}_sum"), F.sum(gap * gap).alias(f"{model}_error")]
    return placed.groupBy(*by, "y", *[F.col(m).cast("int").alias(m) for m in MODELS]).agg(F.count(F.lit(1)).alias("n"), *sums)


def resampled(n: np.ndarray, y: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    """How often each cell is drawn in a replicate; every class keeps its number of rows."""
    out = np.zeros(len(n), np.int64)
    for stratum in (0, 1):
        rows = np.flatnonzero(y == stratum)
        if len(rows):
            stream = np.random.Generator(np.random.PCG64([seed, replicate, stratum]))
            size = n[rows].sum()
            out[rows] = stream.multinomial(size, n[rows] / size)
    return out


def weighted_metrics(
    step: np.ndarray, y: np.ndarray, weight: np.ndarray, mean: np.ndarray, error: np.ndarray, first_hit: int, bins: int,
) -> tuple[float, ...]:
    """The METRICS of cells drawn `weight` times; `mean` and `error` are a cell's mean score and squared error, rows in steps from
    `first_hit` on are predicted positive."""
    size = int(step.max()) + 1
    n, pos, score = (np.bincount(step, x, size) for x in (weight, weight * y, weight * mean))
    total, positive = n.sum(), pos.sum()
    above_n, above_pos = n[::-1].cumsum()[::-1], pos[::-1].cumsum()[::-1]
    some = above_n > 0
    precision_at = np.divide(above_pos, above_n, out=np.zeros(size), where=some)
    ap = float((pos / positive * precision_at).sum())
    wins = float(((n - pos) * (above_pos - pos / 2)).sum())
    auc = wins / (positive * (total - positive))
    tp, hits = pos[first_hit:].sum(), n[first_hit:].sum()
    ends = np.linspace(0, total, bins + 1)
    place = np.concatenate(([0], n.cumsum()))
    gap = [np.diff(np.interp(ends, place, np.concatenate(([0], x.cumsum())))) for x in (score, pos)]
    return (ap, float(tp / positive), float(tp / hits) if hits else 0.0, float(2 * tp / (hits + positive)), float(auc),
            float((weight * error).sum() / total), float(np.abs(gap[0] - gap[1]).sum() / total))


def replicate_metrics(cells: pa.Table, replicates: Sequence[int], seed: int, first_hits: Sequence[int], bins: int) -> list[tuple]:
    """Per replicate its number and the metrics of both models."""
    table = {c: cells[c].to_numpy() for c in ("y", "n", *(f"{m}{part}" for m in MODELS for part in ("", "_sum", "_error")))}
    order = np.lexsort((table["champion"], table["candidate"], table["y"]))
    table = {c: x[order] for c, x in table.items()}
    y, n = table["y"], table["n"]
    out = []
    for replicate in replicates:
        weight = resampled(n, y, seed, replicate)
        row: list[float] = [replicate]
        for model, first in zip(MODELS, first_hits):
            row += weighted_metrics(table[model], y, weight, table[f"{model}_sum"] / n, table[f"{model}_error"] / n, first, bins)
        out.append(tuple(row))
    return out


def bootstrap_replicates(
    cells: DataFrame, steps: Sequence[float], thresholds: Sequence[float], replicates: int, seed: int, bins: int, by: Sequence[str] = (),
) -> DataFrame:
    """(by..., replicate, candidate_<metric>..., champion_<metric>...) of the groups that have both classes."""
    first_hits = [int(np.searchsorted(steps, t, "right")) if t > 0 else 0 for t in thresholds]
    names = [f"{model}_{metric}" for model in MODELS for metric in METRICS]
    blocks = [list(range(k, min(k + BLOCK, replicates))) for k in range(0, replicates, BLOCK)]

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        held = pa.Table.from_struct_array(table["__cells"].chunk(0).flatten())
        own = blocks[table["__block"][0].as_py()] if len(np.unique(held["y"].to_numpy())) == 2 else []
        rows = replicate_metrics(held, own, seed, first_hits, bins)
        first = pa.array([0] * len(rows), pa.int64())
        columns = {c: table[c].take(first) for c in by}
        columns["replicate"] = pa.array([r[0] for r in rows], pa.int32())
        columns |= {name: pa.array([r[k + 1] for r in rows], pa.float64()) for k, name in enumerate(names)}
        return pa.table(columns)

    # Every block needs all cells of its group: they travel as a few packed rows, not as one row for each cell and block.
    drawn = [c for c in cells.columns if c not in by]
    pack = F.pmod(F.xxhash64("y", *MODELS), F.lit(PACKS)).alias("__pack")
    packed = cells.groupBy(*by, pack).agg(F.collect_list(F.struct(*drawn)).alias("__cells")).drop("__pack")
    dealt = packed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))
    schema = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by), "replicate int", *(f"{n} double" for n in names)])
    return dealt.groupBy(*by, "__block").applyInArrow(work, schema)


def regression_evidence(
    df: DataFrame, label: str, candidate: str, champion: str, key: str, candidate_threshold: float, champion_threshold: float,
    policy: GatePolicy = GatePolicy(), by: Sequence[str] = (), replicates: int = 2000, seed: int = 42, confidence: float = 0.95,
    resolution: int = 500,
) -> DataFrame:
    """(by..., metric, candidate, champion, delta, low, high, tolerance, failed, replicates, verdict), one row per gated metric.

    candidate, champion and delta are measured on the rows; low and high bound the middle `confidence` of the replicates' deltas. A
    gate fails by its delta alone, the interval is evidence. A group that cannot be compared has its reason as
    verdict (as in `gates.input_verdict`) and no numbers.
    """
    verdict = input_verdict(df, label, candidate, candidate_threshold, by, champion, champion_threshold)
    verdict = grouped(verdict, by)[0].withColumn("verdict", F.coalesce("verdict", "champion_verdict"))
    rows, group = grouped(df, by)
    fit = rows.join(verdict.where("verdict is null").select(*group), group, "left_semi")
    thresholds = (candidate_threshold, champion_threshold)
    observed = verdict.select(*group, "verdict")
    for model, score, threshold in zip(MODELS, (candidate, champion), thresholds):
        found = full_metrics(fit, label, score, threshold, key, policy.ece_bins, group)
        observed = observed.join(found.select(*group, *[F.col(m).alias(f"{model}_{m}") for m in METRICS]), group, "left")
    steps = score_steps(resolution, thresholds)
    cells = comparison_cells(fit, label, candidate, champion, steps, group)
    drawn = bootstrap_replicates(cells, steps, thresholds, replicates, seed, policy.ece_bins, group)
    tail = (1 - confidence) / 2
    delta = {m: F.col(f"candidate_{m}") - F.col(f"champion_{m}") for m in METRICS}
    # A group has as many values as replicates.
    interval = drawn.groupBy(*group).agg(*[
        F.percentile(delta[m], F.array(F.lit(tail), F.lit(1 - tail))).alias(f"interval_{m}") for m in METRICS])
    wide = observed.join(interval, group, "left")
    rows_of = [F.struct(
        F.lit(m).alias("metric"), F.col(f"candidate_{m}").alias("candidate"), F.col(f"champion_{m}").alias("champion"),
        delta[m].alias("delta"), F.col(f"interval_{m}")[0].alias("low"), F.col(f"interval_{m}")[1].alias("high"),
        F.lit(policy.regression[m]).alias("tolerance"),
        ((delta[m] if m in policy.lower_is_better else -delta[m]) > policy.regression[m]).alias("failed")) for m in METRICS]
    found = wide.select(*group, F.inline(F.array(*rows_of)), "verdict").withColumn(
        "replicates", F.when(F.col("low").isNotNull(), F.lit(replicates)))
    return ungrouped(found, by)
