"""One monitoring run over many windows, from the check of its prerequisites to a result stored once.

The reference of scores is a histogram over fixed bins, so it is kept without any score, and those of parts of a population
add up. A window whose values cannot be read or scored fails by itself; the others are measured together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tarnwatch.config import DriftPolicy, PolicyError, as_dict
from tarnwatch.operators.drift import bounded_sample, caused_by_values, histogram_drift, monitor, run_status, window_problems
from tarnwatch.operators.profile import PROBABILITY_EDGES, Profile, check_profile, prediction_histogram
from tarnwatch.plans.freeze import freeze
from tarnwatch.sources.results import StoredResult, write_once

REFERENCE_VERSION = "scores/v1"
HASH_BITS = 60


@dataclass(frozen=True)
class ScoreReference:
    """Counts of a reference population's scores over fixed bins, with the decision and bands they were taken for."""

    counts: tuple[int, ...]
    n: int
    total: float
    n_positive: int
    threshold: float
    low: float
    high: float
    edges: tuple[float, ...] = tuple(PROBABILITY_EDGES)

    def __add__(self, other: ScoreReference) -> ScoreReference:
        if (self.edges, self.threshold, self.low, self.high) != (other.edges, other.threshold, other.low, other.high):
            raise PolicyError("score references of unlike bins, thresholds or bands don't add up")
        return ScoreReference(
            tuple(a + b for a, b in zip(self.counts, other.counts)), self.n + other.n, self.total + other.total,
            self.n_positive + other.n_positive, self.threshold, self.low, self.high, self.edges)


def build_score_reference(
    scored: DataFrame, probability: str, *, threshold: float, low: float, high: float, edges: Sequence[float] = PROBABILITY_EDGES,
) -> ScoreReference:
    """Histogram of all scores of a reference population; scores that are no probabilities are refused."""
    row = prediction_histogram(scored, probability, threshold=threshold, low=low, high=high, edges=edges).first()
    if row is None or not row["n"]:
        raise PolicyError("the reference population has no scores")
    if row["n_invalid"]:
        raise PolicyError(f"{row['n_invalid']} scores of the reference population are no probabilities")
    return ScoreReference(
        tuple(int(c) for c in row["counts"]), row["n"], row["mean"] * row["n"], round(row["positive_rate"] * row["n"]),
        threshold, low, high, tuple(edges))


def save_score_reference(spark: SparkSession, reference: ScoreReference, folder: str) -> StoredResult:
    """Write once under the key of its own content."""
    content = {"version": REFERENCE_VERSION, **asdict(reference)}
    return write_once(spark, folder, content, lambda: spark.createDataFrame(
        [Row(version=REFERENCE_VERSION, **{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(reference).items()})]).coalesce(1))


def load_score_reference(stored: DataFrame) -> ScoreReference:
    row = stored.first().asDict()
    if row.pop("version") != REFERENCE_VERSION:
        raise PolicyError("score reference version is not supported")
    return ScoreReference(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})


def score_drift(
    scored: DataFrame, probability: str, reference: ScoreReference, *, by: Sequence[str] = ("window_id",), policy: DriftPolicy = DriftPolicy(),
) -> DataFrame:
    """PSI of scores per window against a kept reference; no score of the reference is read."""
    now = prediction_histogram(
        scored, probability, threshold=reference.threshold, low=reference.low, high=reference.high, by=by, edges=reference.edges)
    return histogram_drift(now.withColumn("reference", F.lit(list(reference.counts))), by, policy)


# --- windows that fail -----------------------------------------------------------

def _computes(df: DataFrame) -> bool:
    try:
        df.write.format("noop").mode("overwrite").save()
        return True
    except PySparkException as error:
        if caused_by_values(error):
            return False
        raise


def failing_windows(windows: DataFrame, probe: Callable[[DataFrame], DataFrame], by: Sequence[str] = ("window_id",)) -> list[Row]:
    """Keys of the windows for which `probe` fails on their values.

    One scan if nothing fails. Else windows are halved by their hash as long as a half fails, so each failing window costs about
    twice as many scans as the number of windows has binary digits.
    """
    code = F.xxhash64(*by)
    failing, open_ = [], [(0, 0)]
    while open_:
        depth, value = open_.pop()
        part = windows.where(F.pmod(code, F.lit(1 << depth)) == value)
        if _computes(probe(part)):
            continue
        keys = part.select(*by).distinct()
        if depth == HASH_BITS or len(keys.limit(2).collect()) < 2:
            failing += keys.collect()
        else:
            open_ += [(depth + 1, value), (depth + 1, value + (1 << depth))]
    return failing


def _is_one_of(keys: Sequence[Row], by: Sequence[str]) -> Column:
    found = F.lit(False)
    for key in keys:
        same = F.lit(True)
        for name in by:
            same = same & F.col(name).eqNullSafe(F.lit(key[name]))
        found = found | same
    return found


# --- the run ---------------------------------------------------------------------

def window_identity(windows: DataFrame) -> str:
    """Checksum of the windows' rows in any order and layout; for callers that have no dataset manifest."""
    code = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(windows.columns)])
    row = windows.select(code.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


def _failed(windows: DataFrame, by: Sequence[str], reason: str) -> DataFrame:
    sizes = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("sample_size"))
    return sizes.select(*by, "sample_size", F.lit("unknown").alias("run_status"), F.lit(reason).alias("error_class"))


def _scores(sample: DataFrame, score: Callable[[DataFrame], DataFrame], probability: str, by: Sequence[str]) -> tuple[DataFrame, list[Row]]:
    """Scores of all windows that can be scored, and the keys of the others."""
    scored = lambda rows: score(rows).select(*by, probability)
    try:
        return freeze(scored(sample), "scores"), []
    except PySparkException as error:
        if not caused_by_values(error):
            raise
    bad = failing_windows(sample, scored, by)
    return freeze(scored(sample.where(~_is_one_of(bad, by))), "scores"), bad


def _with_scores(runs: DataFrame, features: DataFrame, drift: DataFrame, by: Sequence[str], policy: DriftPolicy) -> DataFrame:
    sizes = runs.select(*by, F.col("sample_size").alias("n"))
    wrong = drift.where("n_invalid > 0").select(F.struct(*by).alias("__key"), F.lit(True).alias("__wrong"))
    rows = run_status(features, sizes, policy, by, drift).withColumn("__key", F.struct(*by)).join(wrong, "__key", "left")
    refused = (F.col("run_status") != "insufficient_data") & F.coalesce("__wrong", F.lit(False))
    return rows.select(
        *by, "sample_size", F.when(refused, "unknown").otherwise(F.col("run_status")).alias("run_status"),
        F.when(refused, "current_window_incompatible").alias("error_class"))


def monitoring_run(
    folder: str, windows: DataFrame, profile: Profile, *, profile_id: str, identity: str, lineage: Mapping[str, str] | None = None,
    features: Sequence[str] | None = None, score: Callable[[DataFrame], DataFrame] | None = None, reference: ScoreReference | None = None,
    key: Sequence[str] = ("id",), probability: str = "probability", most_scored: int = 100_000, seed: int = 0,
    by: Sequence[str] = ("window_id",), policy: DriftPolicy = DriftPolicy(),
) -> StoredResult:
    """One row per window (by..., sample_size, run_status, error_class), computed once for equal inputs and read back after that.

    `identity` names the windows' content (a manifest's checksum or `window_identity`); with profile, lineage, policy and score
    reference it is the key of the result. `score` adds `probability` to rows; at most `most_scored` rows of a window are scored,
    drawn by `key`, which must be unique within a window. A group of windows with null keys is a window as well.

    error_class: `baseline_incompatible` if the profile is not what lineage, features and id say, `current_window_incompatible` if
    columns don't fit the profile (all windows) or scores are no probabilities (that window), `monitoring_failure` if a window's
    values cannot be read or scored. What else fails (a lost executor, a folder that cannot be written) is raised and stores nothing.
    """
    if (score is None) != (reference is None):
        raise PolicyError("scores need a reference, and a reference needs scores")
    if score is not None and most_scored < policy.minimum_sample_size:
        raise PolicyError("most_scored is below the least number of rows of a window")
    spark = windows.sparkSession
    expected = dict(profile.lineage if lineage is None else lineage)
    order = list(profile.features if features is None else features)
    inputs = {
        "profile_id": profile_id, "identity": identity, "lineage": expected, "features": order, "policy": as_dict(policy), "by": list(by),
        "scores": None if reference is None else {**asdict(reference), "most": most_scored, "seed": seed, "key": list(key)}}

    def compute() -> DataFrame:
        if check_profile(profile, profile_id, lineage=expected, features=order):
            return _failed(windows, by, "baseline_incompatible")
        allowed = [c for c in windows.columns if c not in key]
        if window_problems(windows.select(*allowed), profile, by):
            return _failed(windows, by, "current_window_incompatible")

        bad = failing_windows(windows, lambda part: part.select(*by, *profile.features), by)
        fit = windows.where(~_is_one_of(bad, by))
        run = monitor(fit, profile, by=by, policy=policy)
        rows = run.runs.withColumn("error_class", F.lit(None).cast("string"))
        if score is not None:
            # The window is part of the key, so each window draws a sample of its own.
            sample = bounded_sample(fit, [*by, *[c for c in key if c not in by]], cap=most_scored, seed=seed, by=by)
            scores, unscored = _scores(freeze(sample, "scored_sample"), score, probability, by)
            bad = [*bad, *unscored]
            rows = _with_scores(run.runs, run.features, score_drift(scores, probability, reference, by=by, policy=policy), by, policy)
            rows = rows.where(~_is_one_of(unscored, by))
        return rows.unionByName(_failed(windows.select(*by).where(_is_one_of(bad, by)), by, "monitoring_failure"))

    return write_once(spark, folder, inputs, compute)
