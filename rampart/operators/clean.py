"""Cleaning and profiling of raw flow tables (one pass each, all built-in expressions)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rampart.functions.attach import expand_values, scalar_row
from rampart.functions.scalar import finite_or_null, finite_or_zero, is_finite, non_negative, repair_label, to_double
from rampart.session import materialize


def _stack(wide: DataFrame, names: Sequence[str], suffixes: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Unpivot ``<name>__<suffix>`` columns of a one-row table into ``(column, *out)`` rows."""
    parts = ", ".join(
        f"'{n}', " + ", ".join(f"`{n}__{s}`" for s in suffixes) for n in names)
    return wide.selectExpr(f"stack({len(names)}, {parts}) AS (column, {', '.join(out)})")


def clean_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, repair_label(label))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text cells to double, bad text -> NULL ('Infinity'/'NaN' parse to inf/NaN)."""
    return df.withColumns({c: to_double(c) for c in cols})


def strict_clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and +-inf -> NULL."""
    return df.withColumns({c: finite_or_null(c) for c in cols})


def lenient_clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL, NaN and +-inf -> 0 (rate columns)."""
    return df.withColumns({c: finite_or_zero(c) for c in cols})


def repair_negative(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative values -> 0, each column independently."""
    return df.withColumns({c: non_negative(c) for c in cols})


def _defects(cols: Sequence[str]) -> list[Column]:
    """Rows, and missing, infinite and negative cells over all of ``cols``, as aggregates."""
    def cells(test) -> Column:
        return F.coalesce(F.sum(sum((F.coalesce(test(c), F.lit(False)).cast("long") for c in cols), F.lit(0).cast("long"))), F.lit(0).cast("long"))

    return [F.count(F.lit(1)).alias("n_rows"), cells(lambda c: F.col(c).isNull() | F.isnan(c)).alias("n_missing"),
            cells(lambda c: F.abs(F.col(c)) == F.lit(float("inf"))).alias("n_infinite"), cells(lambda c: F.col(c) < 0).alias("n_negative")]


def cleaned_with_counts(df: DataFrame, cols: Sequence[str], clean: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """``clean(df)``, written, and the rows and defective cells of ``cols`` before and after it
    (``{"before": {n_rows, n_missing, n_infinite, n_negative}, "after": ..}``), observed by the job
    that writes: one scan."""
    before, after = Observation("before"), Observation("after")
    out = materialize(clean(df.observe(before, *_defects(cols))).observe(after, *_defects(cols)), "cleaned")
    return out, {"before": before.get, "after": after.get}


def zero_nonfinite_with_count(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Non-finite cells -> 0 on every column, plus one row with the cells replaced and the rows
    used. The counts come from the scan that writes the cleaned rows."""
    out, counts = cleaned_with_counts(df, cols, lambda d: lenient_clean(d, cols))
    b = counts["before"]
    return out, df.sparkSession.createDataFrame([(b["n_missing"] + b["n_infinite"], counts["after"]["n_rows"])], "n_replaced long, rows_used long")


def defect_totals(df: DataFrame, cols: Sequence[str], clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two rows (stage before, after): rows and missing, infinite and negative cells over ``cols``."""
    _, counts = cleaned_with_counts(df, cols, clean)
    names = ("n_rows", "n_missing", "n_infinite", "n_negative")
    return df.sparkSession.createDataFrame([(k, *(counts[k][n] for n in names)) for k in ("before", "after")], "stage string, " + ", ".join(f"{n} long" for n in names))


def inspect_rows(df: DataFrame, predicate, cols: Sequence[str], n: int = 20, order_by: str = "row_id") -> DataFrame:
    """Preview of the first ``n`` rows (by ``order_by``) matching a predicate, selected columns only."""
    return df.where(predicate).select(*dict.fromkeys([order_by, *cols])).orderBy(order_by).limit(n)


def top_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """Most frequent values of a column, NULL counted as a value (ties: smaller value first)."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(n)


def per_file_distribution(df: DataFrame, label: str = "label", file_col: str = "source_file") -> DataFrame:
    """Rows per source file and label, with the file's total."""

    g = df.groupBy(file_col, label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("file_rows", F.sum("n").over(Window.partitionBy(file_col)))


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL or NaN in any of ``cols``."""
    return df.dropna(subset=list(cols))


def cleaning_funnel(df: DataFrame, cols: Sequence[str], dedup_cols: Sequence[str], label: str | None = None,
                    sample_frac: float = 1.0, min_rows: int = 20) -> DataFrame:
    """Row counts through the cleaning steps: raw, with a non-finite cell, after dropna, after dedup,
    and, with ``label`` (one of ``dedup_cols``), the rows that the stratified sample uses."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | ~is_finite(c)
    raw = df.agg(F.count(F.lit(1)).alias("rows_raw"), F.count_if(bad).alias("rows_bad"))
    after = drop_incomplete(strict_clean(df, cols), cols)
    one = after.groupBy(*dedup_cols).agg(F.count(F.lit(1)).alias("_n"))
    if label is None:
        kept = one.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_after_dropna"), F.count(F.lit(1)).alias("rows_dedup"))
        return scalar_row(raw, kept)
    per = one.groupBy(label).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    used = F.col("_d") if sample_frac >= 1 else F.least(F.col("_d"), F.greatest(F.bround(F.col("_d") * sample_frac, 0), F.lit(min_rows))).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return scalar_row(raw, per.agg(total("_n").alias("rows_after_dropna"), total("_d").alias("rows_dedup"), total(used).alias("rows_used")))


def missing_infinite_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: NULL/NaN count and +-inf count; only columns with any are listed."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"{c}__missing"),
                 F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))).alias(f"{c}__inf")]
    s = _stack(df.agg(*aggs), cols, ["missing", "inf"], ["n_missing", "n_inf"])
    return s.where((F.col("n_missing") > 0) | (F.col("n_inf") > 0))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and percent of total per label, count-descending (ties by label).

    The total is a window over the grouped rows (one row per label): one pass over the rows.
    """
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.select(label, "n", (F.col("n") * 100.0 / total).alias("pct")).orderBy(
        F.desc("n"), label)


def zero_duration_profile(df: DataFrame, duration: str, rate_cols: Sequence[str], label: str = "label") -> DataFrame:
    """Per label among zero-duration rows: count and NULL/inf rates of the rate columns."""
    z = df.where(F.col(duration) == 0)
    aggs = [F.count(F.lit(1)).alias("n_zero")]
    for c in rate_cols:
        aggs += [F.avg((F.col(c).isNull() | F.isnan(c)).cast("double")).alias(f"{c}_null_rate"),
                 F.avg(F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False)).cast("double"))
                 .alias(f"{c}_inf_rate")]
    return z.groupBy(label).agg(*aggs)


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows and duplicates (NaN equals NaN, -0 equals 0)."""
    sel = df.select(*(cols or df.columns))
    one = sel.groupBy(*sel.columns).agg(F.count(F.lit(1)).alias("_n"))
    return one.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")) \
        .withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, max per column (quartiles: see ``exact_quantiles``)."""
    aggs = []
    for c in cols:
        x = F.when(~F.isnan(c), F.col(c))  # NaN is a missing value, as NULL is
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    return _stack(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"], ["count", "mean", "std", "min", "max"])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
                    buckets: int = 256, max_sort_rows: int = 1_000_000, max_levels: int = 64) -> DataFrame:
    """Exact linear-interpolated quantiles per column, never gathering a column in one task.

    Level 1: approximate cut points (``percentile_approx``, ``buckets`` per column) put every
    value into a value-ordered bucket (binary search in ``Bucketizer``); bucket counts give
    each bucket's rank offset. While a bucket that holds a needed rank is larger than
    ``max_sort_rows``, only that bucket's rows are cut again the same way (each level
    divides the candidates by ~``buckets``). Finally the target buckets are reduced to
    ``(value, count)`` pairs and a running count picks the value at each needed rank, so
    heavy ties cost no more than distinct values. Returns ``(column, prob, value)``; the value
    of a column without values is NULL.
    """
    from pyspark.ml.feature import Bucketizer

    cuts_p = [i / buckets for i in range(1, buckets)]
    inf = float("inf")
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts_p, 10 * buckets).alias(c) for c in cols]).head()
    inner = [sorted({x for x in (row[c] or []) if x is not None and x == x and abs(x) != inf}) for c in cols]
    splits = [[-inf, *(x or [0.0]), inf] for x in inner]  # a column without values still needs one cut
    bz = Bucketizer(splitsArray=splits, inputCols=list(cols), outputCols=[f"{c}__b" for c in cols],
                    handleInvalid="keep")
    wide = bz.transform(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), F.array(F.col(f"{c}__b").cast("int")).alias("path"))
        for c in cols])).alias("s")).select("s.column", "s.v", "s.path").where(F.col("v").isNotNull() & ~F.isnan("v"))

    counts = long.groupBy("column", "path").agg(F.count(F.lit(1)).alias("cnt"))
    # targets: 1-based global positions floor(h)+1 and ceil(h)+1, h = (n - 1) * prob
    n = counts.groupBy("column").agg(F.sum("cnt").alias("n"))
    tg = expand_values(n, "prob", [float(p) for p in probs], "double").withColumn("h", (F.col("n") - 1) * F.col("prob"))
    tg = tg.select("column", "prob", "h", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), (F.floor("h") + 1).alias("r")),
        F.struct(F.lit("hi").alias("side"), (F.ceil("h") + 1).alias("r")))).alias("t")).select(
        "column", "prob", "h", "t.side", "t.r")

    def locate(targets: DataFrame, cnts: DataFrame, parent_len: int | None) -> DataFrame:
        """Move each target into the child bucket holding its rank; r becomes the rank inside it."""
        if parent_len is None:
            c = cnts.withColumn("_parent", F.array().cast("array<int>"))
            tgt = targets.withColumn("_parent", F.array().cast("array<int>"))
        else:
            c = cnts.withColumn("_parent", F.slice("path", 1, parent_len))
            tgt = targets.withColumnRenamed("path", "_parent")
        w = Window.partitionBy("column", "_parent").orderBy(F.element_at("path", -1))
        off = c.withColumn("_off", F.sum("cnt").over(w) - F.col("cnt"))
        j = tgt.join(off, ["column", "_parent"])
        j = j.where((F.col("r") > F.col("_off")) & (F.col("r") <= F.col("_off") + F.col("cnt")))
        return j.select("column", "prob", "h", "side", "path", (F.col("r") - F.col("_off")).alias("r"), "cnt")

    tg = locate(tg, counts, None)
    for level in range(1, max_levels):
        # tiny (<= columns x probs x 2 rows) but derived from a full pass: written once to the
        # shared checkpoint folder (an RDD checkpoint would compute that pass twice)
        tg = materialize(tg, "quantile-targets")
        biggest = tg.agg(F.max("cnt")).head()[0] or 0
        if biggest <= max_sort_rows:
            break
        need = tg.select("column", "path").distinct()
        long = long.join(F.broadcast(need), ["column", "path"], "left_semi")
        cuts = long.groupBy("column", "path").agg(F.percentile_approx("v", cuts_p, 10 * buckets).alias("_cuts"))
        long = long.join(F.broadcast(cuts), ["column", "path"]).select(
            "column", "v", F.concat("path", F.array(F.size(F.filter("_cuts", lambda x: x < F.col("v"))))).alias("path"))
        counts = long.groupBy("column", "path").agg(F.count(F.lit(1)).alias("cnt"))
        new = locate(tg.drop("cnt"), counts, level)
        if new.agg(F.max("cnt")).head()[0] >= biggest:   # only ties left in the bucket
            tg = new
            break
        tg = new
    need = tg.select("column", "path").distinct()
    vals = long.join(F.broadcast(need), ["column", "path"], "left_semi").groupBy("column", "path", "v").agg(
        F.count(F.lit(1)).alias("vc"))
    w = Window.partitionBy("column", "path").orderBy("v")
    vals = vals.withColumn("_cum", F.sum("vc").over(w))
    hit = tg.join(vals, ["column", "path"]).where(
        (F.col("r") > F.col("_cum") - F.col("vc")) & (F.col("r") <= F.col("_cum")))
    piv = hit.groupBy("column", "prob", "h").agg(
        F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("vlo"),
        F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("vhi"))
    frac = F.col("h") - F.floor("h")
    got = piv.select("column", "prob", (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * frac).alias("value"))
    asked = df.sparkSession.createDataFrame([(c, float(p)) for c in cols for p in probs], "column string, prob double")
    return asked.join(got, ["column", "prob"], "left")
