"""Leakage and coverage checks between splits and silos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.functions.attach import scalar_row, with_scalars
from rampart.session import materialize

SPLITS = ("train", "val", "test")


def id_overlap(df: DataFrame, id_col: str = "row_id", split_col: str = "split",
               splits: Sequence[str] = SPLITS) -> DataFrame:
    """Pairwise id overlap between splits, in one shuffle on the id.

    Returns ``(split_a, split_b, n_shared)`` for every pair a < b in ``splits`` order.
    """
    flags = df.groupBy(id_col).agg(*[F.max((F.col(split_col) == s).cast("int")).alias(f"_in_{s}") for s in splits])
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    agg = flags.agg(*[F.count_if((F.col(f"_in_{a}") == 1) & (F.col(f"_in_{b}") == 1)).alias(f"{a}__{b}")
                      for a, b in pairs])
    parts = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return agg.selectExpr(f"stack({len(pairs)}, {parts}) AS (split_a, split_b, n_shared)")


def assert_no_leak(overlap: DataFrame) -> None:
    """Raise when any two splits share an id (action on a <= 3-row table)."""
    bad = overlap.where(F.col("n_shared") > 0).collect()
    if bad:
        desc = ", ".join(f"{r['split_a']}/{r['split_b']}: {r['n_shared']}" for r in bad)
        raise ValueError(f"row-id leak between splits ({desc})")


def fingerprint(cols: Sequence[str]) -> list[Column]:
    """128-bit content fingerprint (two independent 64-bit hashes) of the given columns; an is-null
    flag next to each value keeps NULLs of different positions apart."""
    flagged = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*flagged).alias("_fp1"), F.xxhash64(F.lit("rampart"), *flagged).alias("_fp2")]


def duplicate_vectors(df: DataFrame, feature_cols: Sequence[str], split_col: str = "split",
                      probe: str = "test", base: str = "train", fingerprints: Sequence[Column] | None = None) -> DataFrame:
    """Rows of ``probe`` whose feature vector also occurs in ``base``: ``(n_probe, n_dup, share)``.

    Rows are reduced to one per 128-bit fingerprint (map-side partial aggregation, so a vector
    copied into a third of all rows is a single row by the time it is shuffled) holding its count
    in ``probe`` and whether ``base`` has it. Every group carries a witness of equality, the least
    and largest value and the number of values of each column; the vectors of a fingerprint that
    the witness refutes are counted by the columns themselves, so the result is exact. NULL equals
    NULL and NaN equals NaN, as in the fingerprint.
    """
    cols = list(feature_cols)
    marks = list(fingerprints) if fingerprints is not None else fingerprint(cols)
    fp = df.select(split_col, *marks, *[F.col(c) for c in cols])
    keys = [c for c in fp.columns if c not in (split_col, *cols)]
    held = [F.count_if(F.col(split_col) == probe).alias("_c"), F.max(F.coalesce(F.col(split_col) == base, F.lit(False))).alias("_in")]
    rows = F.count(F.lit(1))
    differ = F.lit(False)
    for c in cols:
        some = F.count(F.col(c))
        differ = differ | ~F.min(c).eqNullSafe(F.max(c)) | ((some != 0) & (some != rows))
    one = materialize(fp.groupBy(*keys).agg(*held, differ.alias("_differ")), "vector-prints")
    mixed = one.where("_differ")
    exact = one.where("not _differ").select("_c", "_in")
    if not mixed.isEmpty():
        exact = exact.unionByName(fp.join(mixed.select(*keys), keys, "left_semi").groupBy(*cols).agg(*held).select("_c", "_in"))
    return exact.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_probe"),
                     F.coalesce(F.sum(F.when(F.col("_in"), F.col("_c"))), F.lit(0)).alias("n_dup")).withColumn(
        "share", F.coalesce(F.try_divide(F.col("n_dup").cast("double"), F.col("n_probe")), F.lit(0.0)))


def unseen_labels(df: DataFrame, label: str = "label", split_col: str = "split", base: str = "train") -> DataFrame:
    """Labels present outside ``base`` but never in it."""
    seen = df.where(F.col(split_col) == base).select(label).distinct()
    return df.where(F.col(split_col) != base).select(label).distinct().join(seen, on=label, how="left_anti")


def class_counts(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def class_coverage(df: DataFrame, silo_col: str = "silo_id", label: str = "label_id") -> DataFrame:
    """(silo, class) pairs with no row: every silo x every known class, minus observed pairs.

    The silo ids are one array (as many entries as silos, a run parameter; the partial
    aggregate keeps only distinct ids per task); every distinct class expands over it.
    """
    silos = df.agg(F.array_sort(F.collect_set(silo_col)).alias("_silos"))
    classes = df.select(label).distinct()
    pairs = classes.select(F.explode(silos.select("_silos").scalar()).alias(silo_col), label)
    observed = df.select(silo_col, label).distinct()
    return pairs.join(observed, on=[silo_col, label], how="left_anti")


def partition_check(df: DataFrame, expected_rows: DataFrame, id_col: str = "row_id",
                    silo_col: str = "silo_id") -> DataFrame:
    """Per silo sizes plus totals: assigned rows, distinct ids, expected rows."""
    sizes = df.groupBy(silo_col).agg(F.count(F.lit(1)).alias("n_rows"))
    tot = df.agg(F.count(F.lit(1)).alias("assigned"), F.count_distinct(id_col).alias("distinct_ids"))
    exp = expected_rows.agg(F.count(F.lit(1)).alias("expected"))
    return with_scalars(with_scalars(sizes, tot), exp)


def label_union(frames: Sequence[DataFrame], label: str = "label") -> DataFrame:
    out = frames[0].select(label)
    for f in frames[1:]:
        out = out.union(f.select(label))
    return out.distinct()
