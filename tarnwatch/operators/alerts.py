"""From evidence rows to alerts: qualify, persist, open, follow up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwatch.config import ALERT_DOMAINS, DATA_ORIGINS, STATUSES, AlertPolicy, as_dict
from tarnwatch.functions.expressions import DAY_MICROS, content_key
from tarnwatch.operators.contract import Rule, between, not_empty, one_of
from tarnwatch.plans.freeze import freeze

FAMILY = ("domain", "signal", "model_version", "baseline_id", "config_version", "data_origin")
# --- fixed values: statuses that count and pairs that alert at once ---
QUALIFYING = ("warning", "critical", "unknown")
IMMEDIATE = (("operational", "unknown"), ("data_quality", "critical"), ("performance", "critical"))
ACTIONS = {"acknowledge": "acknowledged", "resolve": "resolved", "suppress": "suppressed"}
# ----------------------------------------------------------------------

EVIDENCE_RULES: tuple[Rule, ...] = (
    *[not_empty(c) for c in ("source_result_id", "signal", "window_id", "model_version", "config_version")],
    one_of("domain", ALERT_DOMAINS), one_of("source_status", STATUSES), one_of("data_origin", DATA_ORIGINS),
    between("sample_size", 0),
    Rule("label_coverage", "range", "label_coverage IS NULL OR label_coverage BETWEEN 0 AND 1"),
    Rule("window_end", "present", "window_end IS NOT NULL"),
)


def qualifying(evidence: DataFrame) -> DataFrame:
    return evidence.where(F.col("source_status").isin(*QUALIFYING))


def with_family(evidence: DataFrame, family: Sequence[str] = FAMILY) -> DataFrame:
    return evidence.withColumn("family", content_key(*[F.col(c) for c in family]))


def immediate(domain: Column, status: Column) -> Column:
    hit = F.lit(False)
    for d, s in IMMEDIATE:
        hit = hit | ((domain == d) & (status == s))
    return hit


def tail_runs(rows: DataFrame, key: Sequence[str], at: str, gap_days: int) -> DataFrame:
    """Rows of the last unbroken run per key: (key..., run_length, run_start, run_end).

    A run breaks where consecutive times are more than `gap_days` apart. Time is
    cut into slots as long as the allowed gap, so nothing can break inside a slot:
    a slot is its count, first and last time, taken map-side, and only slots (at
    most lifetime / gap per key) are put in order.
    """
    gap = gap_days * DAY_MICROS
    micros = F.unix_micros(at)
    slots = rows.groupBy(*key, F.floor(micros / gap).alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    ordered = Window.partitionBy(*key).orderBy("slot")
    previous = F.lag("last_at").over(ordered)
    broken = F.coalesce(F.unix_micros("first_at") - F.unix_micros(previous) > gap, F.lit(True))
    start = F.max(F.when(F.col("broken"), F.col("slot"))).over(Window.partitionBy(*key))
    return (
        slots.withColumn("broken", broken).withColumn("start", start).where(F.col("slot") >= F.col("start"))
        .groupBy(*key).agg(
            F.sum("n").alias("run_length"), F.min("first_at").alias("run_start"), F.max("last_at").alias("run_end"))
    )


def latest_evidence(rows: DataFrame, key: Sequence[str] = ("family",)) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct("window_end", "source_result_id"))
    return rows.groupBy(*key).agg(newest.alias("e")).select(*key, "e.*")


def open_alerts(evidence: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """At most one open alert per family, from its latest window."""
    rows = with_family(qualifying(evidence))
    runs = tail_runs(rows, ["family"], "window_end", policy.maximum_gap_days).select("family", "run_length")
    now = immediate(F.col("domain"), F.col("source_status"))
    settings = "|".join(f"{k}={v}" for k, v in sorted(as_dict(policy).items()))
    return (
        latest_evidence(rows).join(runs, "family")
        .withColumn("immediate", now)
        .where(F.col("immediate") | (F.col("run_length") >= policy.persistence_windows))
        .select(
            F.sha2(F.concat_ws("|", "family", F.lit(settings)), 256).alias("alert_id"), "domain",
            F.when(F.col("immediate"), "critical").otherwise("warning").alias("severity"), F.lit("open").alias("state"),
            "signal", F.concat_ws(":", "domain", "source_status").alias("reason"), "source_result_id", "window_id",
            "window_end", "sample_size", "label_coverage", "model_version", "baseline_id", "config_version",
            "data_origin", F.col("run_length").alias("persistence_count"), F.lit(policy.version).alias("policy_version"))
    )


def recommendations(alerts: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """Retraining candidates: critical performance alerts with enough evidence behind them."""
    enough = (
        (F.col("domain") == "performance") & (F.col("severity") == "critical")
        & (F.col("sample_size") >= policy.minimum_sample_size)
        & (F.coalesce("label_coverage", F.lit(0.0)) >= policy.minimum_coverage))
    return alerts.where(enough).select(
        F.sha2(F.concat_ws("|", "alert_id", "policy_version", "source_result_id"), 256).alias("recommendation_id"),
        F.lit("candidate").alias("status"), "alert_id", "source_result_id", "data_origin", "model_version",
        "baseline_id", "sample_size", "label_coverage", F.lit(False).alias("promotion_approved"))


def evidence_key(evidence: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """Content key of an evaluation, whatever the order of its evidence."""
    settings = "|".join(f"{k}={v}" for k, v in sorted(as_dict(policy).items()))
    h = evidence.select(F.xxhash64(*[F.col(c) for c in sorted(evidence.columns)]).alias("h"))
    return h.agg(F.sha2(F.concat_ws(
        "|", F.count(F.lit(1)).cast("string"), F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string"), F.lit(settings)), 256).alias("evidence_key"))


# --- lifecycle -------------------------------------------------------------------

def _first(order: Column, condition: Column) -> Column:
    return F.min(F.when(condition, order))


def accepted_actions(actions: DataFrame, key: str = "alert_id") -> DataFrame:
    """The moves that took effect: (key, total, first_ack, first_suppress, first_resolve, ...).

    Only the first acknowledgement or suppression can act on an open alert, and
    only the first resolution or suppression after it on an acknowledged one, so
    minima decide everything and no action list is ever gathered.
    """
    complete = (
        F.col("action").isin(*ACTIONS) & (F.coalesce(F.length("actor_id"), F.lit(0)) > 0)
        & (F.coalesce(F.length("reason"), F.lit(0)) > 0))
    order = F.struct("at", "action_id")
    valid = actions.withColumn("ok", complete).withColumn("ord", order)
    firsts = valid.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        _first(F.col("ord"), F.col("ok") & (F.col("action") == "acknowledge")).alias("ack"),
        _first(F.col("ord"), F.col("ok") & (F.col("action") == "suppress")).alias("suppress"))
    resolves = valid.where(F.col("ok") & (F.col("action") == "resolve")).join(
        firsts.where(F.col("ack").isNotNull()).select(key, "ack"), key)
    after = resolves.where(F.col("ord") > F.col("ack")).groupBy(key).agg(F.min("ord").alias("resolve"))
    return firsts.join(after, key, "left")


def lifecycle(actions: DataFrame, key: str = "alert_id") -> DataFrame:
    """Final state per alert: (key, state, accepted, rejected, changed_at)."""
    moves = accepted_actions(actions, key)
    ack, suppress, resolve = F.col("ack"), F.col("suppress"), F.col("resolve")
    direct = suppress.isNotNull() & (ack.isNull() | (suppress < ack))
    ending = F.least(suppress, resolve)  # null when neither came
    state = (
        F.when(direct, "suppressed").when(ack.isNull(), "open").when(ending.isNull(), "acknowledged")
        .when(ending == resolve, "resolved").otherwise("suppressed"))
    accepted = F.when(direct, 1).when(ack.isNull(), 0).when(ending.isNull(), 1).otherwise(2)
    changed = F.when(direct, suppress["at"]).when(ending.isNull(), ack["at"]).otherwise(ending["at"])
    return moves.select(
        key, state.alias("state"), accepted.cast("long").alias("accepted"),
        (F.col("total") - accepted).alias("rejected"), changed.alias("changed_at"))


def action_history(actions: DataFrame, key: str = "alert_id") -> DataFrame:
    """Append-only history: the accepted actions of every alert, in order."""
    moves = accepted_actions(actions, key)
    ack, suppress, resolve = F.col("ack"), F.col("suppress"), F.col("resolve")
    direct = suppress.isNotNull() & (ack.isNull() | (suppress < ack))
    ids = F.when(direct, F.array(suppress["action_id"])).otherwise(F.array(ack["action_id"], F.least(suppress, resolve)["action_id"]))
    taken = moves.select(key, F.posexplode(F.filter(ids, lambda i: i.isNotNull())).alias("step", "action_id"))
    return actions.join(taken, [key, "action_id"])


# --- follow-up policies -------------------------------------------------------------

def clean_tail(evidence: DataFrame, windows: int = 2, gap_days: int = 1) -> DataFrame:
    """Families whose latest `windows` windows are all clean and follow each other, so an open alert may resolve.

    Results are collapsed per window first: a window is clean when all its results are, however many there are."""
    rows = with_family(evidence)
    per_window = rows.groupBy("family", "window_id").agg(
        F.max("window_end").alias("window_end"), F.min((F.col("source_status") == "stable").cast("int")).alias("clean"))
    newest = Window.partitionBy("family").orderBy(F.col("window_end").desc(), F.col("window_id").desc())
    # row_number() <= k is cut to k rows per family before the shuffle.
    last = per_window.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= windows)
    span = F.unix_micros(F.max("window_end")) - F.unix_micros(F.min("window_end"))
    return last.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("clean").alias("clean"), span.alias("span")
    ).where((F.col("n") == windows) & (F.col("clean") == windows) & (F.col("span") <= (windows - 1) * gap_days * DAY_MICROS)).select("family")


def delivery_decisions(
    emissions: DataFrame, key: Sequence[str], at: str, order: str, severity: Column | None = None, hours: int = 24,
) -> DataFrame:
    """Adds `delivered`: the first emission of a key, then each first one that comes `hours` after the last delivery or has a
    higher severity than it. All others are recorded as suppressed.

    Which emission follows a delivery depends on that one emission only, so each gets a pointer to its follower, and the
    delivered ones are those that the pointers lead to from a key's first. Time is cut into slots of `hours`: a
    follower by time lies in the next slot, not before the same offset, or begins a later slot; a follower by severity lies
    later in its own slot or in a later one. So no task holds more of a key than a slot. The pointers are followed by doubling.
    """
    pause = hours * 3_600_000_000
    rank = F.lit(0) if severity is None else F.coalesce(severity.cast("int"), F.lit(0))
    rows = emissions.select("*", F.unix_micros(at).alias("__t"), rank.alias("__s"))
    rows = freeze(rows.withColumns({"__slot": F.floor(F.col("__t") / pause), "__o": F.struct("__t", order)}), "emissions")
    me = F.col("__o")
    levels = [r[0] for r in rows.select("__s").distinct().orderBy("__s").collect()]     # a handful of severities
    ahead = Window.partitionBy(*key, "__slot")
    # "All that follow" is asked from the end: a frame that only grows is one pass, one that shrinks is taken anew for every row.
    later = Window.partitionBy(*key).orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(*key, "__slot").agg(F.min("__o").alias("first"), *[
        F.min(F.when(F.col("__s") > s, me)).alias(f"over{k}") for k, s in enumerate(levels)])
    after = firsts.select(
        *key, "__slot", F.min("first").over(later).alias("next1"),
        F.min("first").over(later.rowsBetween(Window.unboundedPreceding, -2)).alias("next2"),
        F.lead("__slot").over(Window.partitionBy(*key).orderBy("__slot")).alias("follower"),
        *[F.min(f"over{k}").over(later).alias(f"later{k}") for k in range(len(levels))])
    # In the next slot: emissions and, a slot later, the offsets they are asked from; the first emission not before each.
    asked = rows.select(*key, (F.col("__slot") + 1).alias("__slot"), (F.col("__t") + pause).alias("t"), F.lit(0).alias("kind"), me.alias("o"))
    own = rows.select(*key, "__slot", F.col("__t").alias("t"), F.lit(1).alias("kind"), me.alias("o"))
    order_in = ahead.orderBy(F.desc("t"), F.desc("kind"), F.desc("o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(own).withColumn("hit", F.min(F.when(F.col("kind") == 1, F.col("o"))).over(order_in)).where("kind = 0")
    found = found.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("o").alias("__from"), "hit")
    higher = F.lit(None).cast(rows.schema["__o"].dataType)
    down = ahead.orderBy(F.desc("__o")).rowsBetween(Window.unboundedPreceding, -1)
    for k, s in enumerate(levels):
        inside = F.min(F.when(F.col("__s") > s, me)).over(down)
        higher = F.when(F.col("__s") == s, F.coalesce(inside, F.col(f"later{k}"))).otherwise(higher)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    slots = after.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("__slot").alias("__at"), *after.columns[len(key) + 1:])
    nodes = rows.join(slots, [*same, F.col("__slot") == F.col("__at")]).drop("__at", *[f"__{c}" for c in key])
    nodes = nodes.withColumn("higher", higher)
    nodes = nodes.join(found, [*same, F.col("__o") == F.col("__from")], "left")
    # Without a hit there, the first emission behind that slot.
    behind = F.when(F.col("follower") == F.col("__slot") + 1, F.col("next2")).otherwise(F.col("next1"))
    nodes = nodes.withColumn("next", F.least(F.coalesce("hit", behind), "higher")).select(*key, me.alias("id"), "next")
    nodes = freeze(nodes, "followers")

    starts = nodes.groupBy(*key).agg(F.min("id").alias("id"))
    jumps = [nodes.where("next IS NOT NULL")]
    while True:     # every table jumps twice as far as the one before
        last = jumps[-1]
        far = _follow(last, last, key)
        far = freeze(far, "jumps")
        if far.isEmpty():
            break
        jumps.append(far)
    reached = starts
    for jump in reversed(jumps):
        ends = _follow(reached.withColumn("next", F.col("id")), jump, key).select(*key, F.col("next").alias("id"))
        reached = freeze(reached.unionByName(ends).distinct(), "delivered")
    marks = reached.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("id").alias("__hit"))
    out = rows.join(marks, [*same, F.col("__o") == F.col("__hit")], "left").withColumn("delivered", F.col("__hit").isNotNull())
    return out.drop("__t", "__s", "__slot", "__o", "__hit", *[f"__{c}" for c in key])


def _follow(start: DataFrame, jump: DataFrame, key: Sequence[str]) -> DataFrame:
    """`next` of every row of start, moved on by one jump."""
    other = jump.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("id").alias("__id"), F.col("next").alias("__next"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return start.join(other, [*same, F.col("next") == F.col("__id")]).select(*key, "id", F.col("__next").alias("next"))


def lifted_status(rows: DataFrame, alpha: float = 0.05) -> Column:
    """A significant chi-square lifts watch to warning, never further."""
    return F.when(
        (F.col("distribution_status") == "watch") & (F.col("adjusted_p_value") < alpha), "warning"
    ).otherwise(F.col("distribution_status"))
