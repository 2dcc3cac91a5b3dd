"""Attaching bounded side values to every row without a join.

* ``with_scalars``: the columns of a one-row aggregate become uncorrelated scalar
  subqueries. Spark runs the subquery once, merges sibling subqueries over the same
  plan into one job and inlines the values into the projection, so the plan holds no
  join at all (no cross product, no broadcast nested loop).
* ``expand_values``: a bounded parameter grid (fractions, class ids, ...) as a generator
  over a literal array, instead of joining with a literal table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``df`` plus every column of ``one_row`` (an aggregate without grouping keys).

    An empty ``one_row`` yields NULLs, as a scalar subquery does.
    """
    cs = list(cols or one_row.columns)
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in cs])


def scalar_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One row holding the columns of several one-row aggregates side by side."""
    out = first
    for o in others:
        out = with_scalars(out, o)
    return out


def expand_values(df: DataFrame, name: str, values: Sequence, dtype: str) -> DataFrame:
    """One copy of every row per literal value, as column ``name``."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v).cast(dtype) for v in values])))


# Fixed value: largest dictionary-like table broadcast to every task (class maps, class
# weights, per (silo, class) weights: classes x silos rows in practice).
MAX_LOOKUP_ROWS = 100_000


def small_table(table: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame | None:
    """``table`` as a local relation when it has at most ``max_rows`` rows, else None.

    At most ``max_rows + 1`` rows are fetched to check the bound, so the check itself is
    bounded; the local copy is not recomputed by the join that uses it.
    """
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return table.sparkSession.createDataFrame(rows, table.schema)


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str] | str, how: str = "left",
                max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """Attach a dictionary-like table to the rows of ``df`` without shuffling the rows.

    Within the checked size bound the table is broadcast (the rows, hot keys included,
    stay where they are); beyond it the join is a shuffle join whose skewed partitions
    AQE splits.
    """
    small = small_table(table, max_rows)
    if small is None:
        return df.join(table, on=on, how=how)
    return df.join(F.broadcast(small), on=on, how=how)
