"""Declarative table contracts: one pass, every failure reported, bad rows set aside."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tarnwatch.config import FORBIDDEN_KEY_FRAGMENTS, PolicyError
from tarnwatch.functions.expressions import DECIMAL_TEXT, SHA256_HEX, failed_rules, forbidden_key


@dataclass(frozen=True)
class Rule:
    """`ok` is a SQL predicate. A row it does not hold for, or that leaves it undecided, fails."""

    column: str
    check: str
    ok: str

    @property
    def name(self) -> str:
        return f"{self.column}:{self.check}"

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.ok), F.lit(False))

    def on(self, column: str) -> Rule:
        """The same predicate, reported under another column."""
        return Rule(column, self.check, self.ok)


RAW = "__raw_"


def _quote(value: object) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return repr(value)


def one_of(column: str, values: Sequence[object]) -> Rule:
    return Rule(column, "domain", f"`{column}` IN ({', '.join(_quote(v) for v in values)})")


def between(column: str, low: float | None = None, high: float | None = None) -> Rule:
    parts = [f"NOT isnan(CAST(`{column}` AS double))"]
    if low is not None:
        parts.append(f"`{column}` >= {low!r}")
    if high is not None:
        parts.append(f"`{column}` <= {high!r}")
    return Rule(column, "range", " AND ".join(parts))


def castable(column: str, sql_type: str) -> Rule:
    return Rule(column, "type", f"`{column}` IS NULL OR try_cast(`{column}` AS {sql_type}) IS NOT NULL")


def blank_or_decimal_text(column: str) -> Rule:
    pattern = _quote(DECIMAL_TEXT)
    return Rule(column, "decimal_text", f"trim(`{column}`) = '' OR trim(`{column}`) RLIKE {pattern}")


def text_length(column: str, low: int, high: int) -> Rule:
    return Rule(column, "length", f"char_length(`{column}`) BETWEEN {low} AND {high}")


def not_empty(column: str) -> Rule:
    return Rule(column, "not_empty", f"char_length(CAST(`{column}` AS string)) > 0")


def sha256_hex(column: str) -> Rule:
    return Rule(column, "sha256", f"`{column}` RLIKE {_quote(SHA256_HEX)}")


def implies(name: str, condition: str, consequence: str) -> Rule:
    return Rule("row", name, f"NOT coalesce({condition}, false) OR coalesce({consequence}, false)")


@dataclass(frozen=True)
class Contract:
    version: str
    columns: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    types: Mapping[str, str] = field(default_factory=dict)


def column_problems(df: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    """Missing and unexpected columns. Reads no rows."""
    have = set(df.columns)
    return {"missing": sorted(set(expected) - have), "unexpected": sorted(have - set(expected))}


def coerced(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()})


def uniqueness(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: keys met more than once and the rows that carry them.

    Counted map-side first, so a key that holds a third of the table is a few
    partial counts when it reaches the shuffle.
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count_if(F.col("n") > 1).alias("n_keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_fail"),
    )


def violation_report(df: DataFrame, contract: Contract, only_failed: bool = True) -> DataFrame:
    """(column, check, n_fail) of every rule, from a single aggregate over the table."""
    casts = [castable(RAW + c, t).on(c) for c, t in contract.types.items()]
    checked = [*casts, *contract.rules]
    report = None
    if checked:
        # Rules see the declared types, so text that is no number fails its rules instead of the job.
        typed = coerced(df.withColumns({RAW + c: F.col(f"`{c}`") for c in contract.types}), contract.types)
        sums = typed.agg(*[F.count_if(~r.holds()).alias(f"f{i}") for i, r in enumerate(checked)])
        rows = F.array(*[
            F.struct(F.lit(r.column).alias("column"), F.lit(r.check).alias("check"), F.col(f"f{i}").alias("n_fail"))
            for i, r in enumerate(checked)])
        report = sums.select(F.inline(rows))
    for key in contract.unique:
        row = uniqueness(df, key).select(
            F.lit(",".join(key)).alias("column"), F.lit("unique").alias("check"), F.col("n_fail").cast("long").alias("n_fail"))
        report = row if report is None else report.unionByName(row)
    if report is None:
        raise PolicyError("the contract has no rules")
    return report.where("n_fail > 0") if only_failed else report


def with_failed_rules(df: DataFrame, rules: Sequence[Rule], out: str = "failed_rules") -> DataFrame:
    return df.withColumn(out, failed_rules({r.name: r.holds() for r in rules}))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good, bad); bad rows keep the names of the rules they break."""
    marked = with_failed_rules(df, rules)
    good = marked.where(F.size("failed_rules") == 0).drop("failed_rules")
    return good, marked.where(F.size("failed_rules") > 0)


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows by the exact set of rules they break."""
    marked = with_failed_rules(df, rules).withColumn("failed", F.array_join(F.array_sort("failed_rules"), ","))
    return marked.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


def require(df: DataFrame, contract: Contract) -> DataFrame:
    """The table with declared types, or an error that names every violation."""
    wrong = column_problems(df, contract.columns)
    if wrong["missing"] or wrong["unexpected"]:
        raise PolicyError(f"contract failed: columns {wrong}")
    failed = violation_report(df, contract).orderBy("column", "check").collect()  # one row per rule
    if failed:
        detail = ", ".join(f"{r['column']}:{r['check']}={r['n_fail']}" for r in failed)
        raise PolicyError(f"contract failed: {detail}")
    return coerced(df, contract.types)


def select_without(df: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    return df.drop(*identifiers)


# --- privacy -----------------------------------------------------------------

def forbidden_columns(schema: T.StructType, fragments: Sequence[str] = FORBIDDEN_KEY_FRAGMENTS, prefix: str = "") -> list[str]:
    """Paths of schema fields, at any depth, whose name contains a forbidden fragment."""
    found = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if any(fragment in f.name.lower() for fragment in fragments):
            found.append(path)
        inner = f.dataType
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if isinstance(inner, T.MapType):
            inner = inner.valueType
        if isinstance(inner, T.StructType):
            found += forbidden_columns(inner, fragments, f"{path}.")
    return found


def leaks_identifier(json_text: Column, fragments: Sequence[str] = FORBIDDEN_KEY_FRAGMENTS) -> Column:
    return forbidden_key(json_text, fragments)


def map_leaks_identifier(values: Column, fragments: Sequence[str] = FORBIDDEN_KEY_FRAGMENTS) -> Column:
    return F.coalesce(F.exists(F.map_keys(values), lambda k: F.lower(k).rlike("|".join(fragments))), F.lit(False))


def allowed_only(values: Column, kind: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """Map entries that are on the allow-list of the row's kind."""
    lists = F.create_map(*[
        x for k, names in allowed.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    mine = F.coalesce(F.element_at(lists, kind), F.array().cast("array<string>"))
    return F.map_filter(values, lambda k, _: F.array_contains(mine, k))
