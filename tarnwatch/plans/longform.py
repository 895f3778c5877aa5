"""Wide columns to (feature, cell) rows, through Expand, no self-join or loop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def melt(df: DataFrame, ids: Sequence[str], cells: Mapping[str, Column]) -> DataFrame:
    """One row per input row and entry of `cells`: (ids..., feature, <cell fields>).

    Every cell must be a struct of the same type.
    """
    names = list(cells)
    wide = df.select(*ids, *[cells[name].alias(name) for name in names])
    quoted = [F.col(f"`{name}`") for name in names]
    long = wide.unpivot([F.col(i) for i in ids], quoted, "feature", "cell")
    return long.select(*ids, "feature", "cell.*")
