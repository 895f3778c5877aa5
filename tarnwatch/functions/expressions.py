"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from tarnwatch.config import RISK_BANDS, SEVERITY

# --- fixed values: text patterns ---
DECIMAL_TEXT = r"^\d+(\.\d+)?$"
NUMBER_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)$"
TRACE_PARENT = r"^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}$"
SHA256_HEX = r"^[0-9a-fA-F]{64}$"
# -----------------------------------


def ladder(value: Column, thresholds: Sequence[float]) -> Column:
    """Status reached by a measure; null and NaN reach nothing."""
    watch, warning, critical = thresholds
    v = F.when(~F.isnan(value), value)
    return (
        F.when(v >= critical, "critical").when(v >= warning, "warning").when(v >= watch, "watch").otherwise("stable")
    )


def severity(status: Column) -> Column:
    level = F.lit(None).cast("int")
    for name, value in SEVERITY.items():
        level = F.when(status == name, value).otherwise(level)
    return level


def worst_of(*statuses: Column) -> Column:
    """Most severe of several status columns in one row; nulls do not count."""
    ranked = [F.when(s.isNotNull(), F.struct(severity(s).alias("level"), s.alias("status"))) for s in statuses]
    return (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["status"]


def worst(status: Column) -> Column:
    """Most severe status of a group."""
    return F.max_by(status, severity(status))


def number_from_text(text: Column) -> Column:
    """Number or null. Type suffixes such as 1.5d and the word NaN are no numbers."""
    trimmed = F.trim(text)
    return F.when(F.lower(trimmed).rlike(NUMBER_TEXT), trimmed.try_cast("double"))



def safe_ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def right_closed_labels(value: Column, edges: Sequence[float], labels: Sequence[str], outside: str = "nan") -> Column:
    """(a, b] bins; the first one also holds its lower edge."""
    picked = F.when((value < edges[0]) | (value > edges[-1]) | value.isNull() | F.isnan(value.cast("double")), outside)
    for upper, label in zip(edges[1:], labels):
        picked = picked.when(value <= upper, label)
    return picked


def left_closed_labels(value: Column, uppers: Sequence[float], labels: Sequence[str]) -> Column:
    """[a, b) bins below each of `uppers`; the last label takes the rest."""
    picked = F.when(value.isNull(), F.lit(None).cast("string"))
    for upper, label in zip(uppers, labels):
        picked = picked.when(value < upper, label)
    return picked.otherwise(labels[-1])


def risk_band(probability: Column, low: float | Column, threshold: float | Column, high: float | Column) -> Column:
    safe, lowest, medium, highest = RISK_BANDS
    return (
        F.when(probability >= high, highest).when(probability >= threshold, medium)
        .when(probability >= low, lowest).otherwise(safe)
    )


def valid_probability(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks. A rule that cannot be decided is broken."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*marks), lambda name: name.isNotNull())


def trace_id(traceparent: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(traceparent), TRACE_PARENT, 1), F.lit(""))


def keyed_pseudonym(reference: Column, secret: bytes) -> Column:
    """HMAC-SHA256 in hex. The secret's pads are constants, the rest is native sha2."""
    if not secret:
        raise ValueError("a secret is required")
    if len(secret) > 64:
        from hashlib import sha256

        secret = sha256(secret).digest()
    block = secret.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(reference, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def content_key(*columns: Column) -> Column:
    """Stable id of a row's content: nulls and field borders count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def forbidden_key(json_text: Column, fragments: Sequence[str]) -> Column:
    """Does any key, at any depth, contain a forbidden fragment?"""
    keys = F.regexp_extract_all(json_text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    return F.coalesce(F.exists(keys, lambda k: F.lower(k).rlike("|".join(fragments))), F.lit(False))


def month_index(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000
