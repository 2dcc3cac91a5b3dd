"""Seeded sampling, splitting and silo partitioning by hash order (``operators/rank.py``)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rampart.functions.attach import lookup_join, with_scalars
from rampart.functions.scalar import hash_unit, unit_of_hex
from rampart.operators.rank import first_n, hash_rank, rank_tag
from rampart.session import materialize


# ------------------------------------------------------------------ stratified samples
def stratified_sample_min(df: DataFrame, id_col: str, label: str, frac: float, min_rows: int = 20,
                          seed: str | int = 42) -> DataFrame:
    """Per label keep ``min(len, max(round(len*frac), min_rows))`` rows (half-even round)."""
    return first_n(df, id_col, seed, [label],
                   lambda size: F.least(size, F.greatest(F.bround(size * frac, 0), F.lit(min_rows))))


def stratified_sample_frac(df: DataFrame, id_col: str, label: str, frac: float, seed: str | int = 42,
                           strata: Sequence[str] = ()) -> DataFrame:
    """Per label (and extra strata, e.g. split) keep ``max(1, round(len*frac))`` rows."""
    return first_n(df, id_col, seed, list(strata) + [label], lambda size: F.greatest(F.lit(1), F.bround(size * frac, 0)))


def uniform_sample(df: DataFrame, id_col: str, n: int, seed: str | int = 42) -> DataFrame:
    """Fixed-size uniform sample: the n rows first in hash order (one cutoff, no rank, no shuffle)."""
    return first_n(df, id_col, seed, [], lambda size: F.lit(int(n)))


# ------------------------------------------------------------------ splits
def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = 0.2, seed: str | int = 42,
                     attack_col: str = "is_attack") -> DataFrame:
    """Adds ``split`` in {train, test}: per stratum the first ``round(size*test_size)`` rows are test.

    Stratum = label when every class has >= 2 rows, else the attack flag (decided in-plan
    from a one-row aggregate, no driver round trip).
    """
    min_count = df.groupBy(label).count().agg(F.min("count").alias("_minc"))
    j = with_scalars(df, min_count)
    j = j.withColumn("_stratum", F.when(F.col("_minc") >= 2, F.col(label).cast("string"))
                     .otherwise(F.col(attack_col).cast("string"))).drop("_minc")
    tagged = rank_tag(j, id_col, seed, ["_stratum"], lambda sizes: sizes.select(
        "*", F.lit(0).alias("_tag"), F.bround(F.col("_size") * test_size, 0).alias("_r")), "_test")
    return tagged.withColumn("split", F.when(F.col("_test").isNotNull(), "test").otherwise("train")).drop(
        "_test", "_stratum")


def group_aware_split(df: DataFrame, content: Column | str, train: float = 0.6, val: float = 0.2,
                      seed: str | None = None) -> DataFrame:
    """Split by a hash of the row *content*: identical feature vectors always share a split."""
    c = F.col(content) if isinstance(content, str) else content
    key = c if seed is None else F.concat(c, F.lit(f":{seed}"))
    u = unit_of_hex(F.md5(key))
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def hash_split(df: DataFrame, id_col: str, seed: str | int, train: float = 0.75, val: float = 0.125) -> DataFrame:
    """Row-level split by hash unit of the id."""
    u = hash_unit(id_col, seed)
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def undersample_benign(df: DataFrame, id_col: str, label_id: str = "label_id", ratio: float = 3.0,
                       seed: str | int = 42) -> DataFrame:
    """Keep all attack rows and ``min(benign, int(ratio * attacks))`` benign rows; ratio <= 0 keeps
    all. Rows with a NULL label are neither and stay. One pass tags the rows in place."""
    if ratio <= 0:
        return df
    kind = F.when(F.col(label_id) == 0, 0).when(F.col(label_id).isNotNull(), 1).otherwise(2)

    def targets(sizes):
        attacks = sizes.where("_kind = 1").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_att"))
        cap = F.floor(F.lit(float(ratio)) * F.col("_att"))
        return with_scalars(sizes, attacks).select("*", F.lit(0).alias("_tag"), F.when(F.col("_kind") == 0, cap).otherwise(F.col("_size")).alias("_r"))

    out = rank_tag(df.withColumn("_kind", kind), id_col, seed, ["_kind"], targets, "_keep")
    return out.where(F.col("_keep").isNotNull()).drop("_keep", "_kind")


# ------------------------------------------------------------------ silo partitions
def iid_partition(df: DataFrame, id_col: str, n_silos: int, seed: str | int = 42,
                  silo_col: str = "silo_id") -> DataFrame:
    """Shuffle by hash and cut into ``n_silos`` contiguous parts whose sizes differ by <= 1, larger first.

    Silo s ends at rank ``(s+1)*q + min(s+1, rem)`` (q, rem: size divided by the silo count); a
    row's silo is the first whose end is at or after its rank (cutoffs, no rank per row).
    """
    def targets(sizes):
        q = F.floor(F.col("_size") / n_silos)
        rem = F.col("_size") - q * n_silos
        s = F.col("_tag")
        return sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_silos - 1))).alias("_tag")).select(
            "*", ((s + 1) * q + F.least(s + 1, rem)).alias("_r"))
    return rank_tag(df, id_col, seed, [], targets, silo_col).withColumn(silo_col, F.col(silo_col).cast("int"))


def dirichlet_proportions(n_classes: int, n_silos: int, alpha: float, seed: int = 42,
                          class_counts: dict[int, int] | None = None, min_rows: int = 100,
                          tries: int = 50) -> list[tuple[int, int, float]]:
    """(class, silo, share): one Dirichlet(alpha) row over silos per class, from class counts only.

    With ``class_counts`` the matrix is drawn anew (up to ``tries`` times, the last one stands)
    while some silo would get fewer than ``min_rows`` rows.
    """
    rng = np.random.default_rng(seed)
    draws = (rng.dirichlet(np.full(n_silos, alpha), size=n_classes) for _ in range(max(1, tries)))
    share = next(draws)
    if class_counts:
        n = np.array([class_counts.get(c, 0) for c in range(n_classes)])
        while _smallest_silo(share, n) < min_rows and (another := next(draws, None)) is not None:
            share = another
    return [(c, s, float(share[c, s])) for c, s in np.ndindex(n_classes, n_silos)]


def _smallest_silo(share: np.ndarray, n: np.ndarray) -> int:
    """Rows of the smallest silo when class c of n[c] rows is cut at floor(cumulative share * n[c])."""
    ends = np.floor(np.cumsum(share, axis=1) * n[:, None]).astype(np.int64)
    ends[:, -1] = n
    return int(np.diff(ends, axis=1, prepend=0).sum(axis=0).min())


def dirichlet_cuts(spark: SparkSession, proportions: list[tuple[int, int, float]]) -> DataFrame:
    """Cut table ``(label_id, silo_id, cum_lo, cum_hi, last_silo)`` with numpy's cumulative sums.

    Silo s takes class ranks in ``(floor(cum_lo * n), floor(cum_hi * n)]`` (first silo from 0,
    last silo up to n). Classes x silos rows, built on the driver.
    """
    by_class: dict[int, list[tuple[int, float]]] = {}
    for c, s, p in proportions:
        by_class.setdefault(int(c), []).append((int(s), float(p)))
    rows = []
    for c, items in sorted(by_class.items()):
        items.sort()
        cum = np.cumsum([p for _, p in items])
        last = items[-1][0]
        for k, (s, _) in enumerate(items):
            rows.append((c, s, float(cum[k - 1]) if k else 0.0, float(cum[k]), last))
    return spark.createDataFrame(rows, "label_id int, silo_id int, cum_lo double, cum_hi double, last_silo int")


def dirichlet_partition(df: DataFrame, id_col: str, proportions: list[tuple[int, int, float]],
                        label_id: str = "label_id", seed: str | int = 42, silo_col: str = "silo_id") -> DataFrame:
    """Non-IID partition: per class, rows in hash order are cut at ``floor(cumsum(p) * n_class)``.

    Silo s of a class ends at rank ``floor(cum_s * n)`` (the last silo at n); the cut table has
    classes x silos rows (a local table) and meets the per-class sizes
    only. A row's silo is the first whose end is at or after its rank. A row whose class has
    no cuts is an error (it would silently vanish from every silo).
    """
    spark = df.sparkSession
    cuts = dirichlet_cuts(spark, proportions).withColumnRenamed("label_id", "_cls")

    def targets(sizes):
        j = sizes.join(cuts, sizes[label_id] == F.col("_cls"))
        hi = F.when(F.col("silo_id") == F.col("last_silo"), F.col("_size")).otherwise(
            F.floor(F.col("cum_hi") * F.col("_size")))
        return j.select("*", F.col("silo_id").alias("_tag"), hi.alias("_r"))
    out = rank_tag(df, id_col, seed, [label_id], targets, silo_col)
    missing = F.raise_error(F.concat(F.lit("no silo proportions for class "), F.coalesce(F.col(label_id).cast("string"), F.lit("NULL")))).cast("int")
    return out.withColumn(silo_col, F.coalesce(F.col(silo_col).cast("int"), missing))


def silo_validation_split(df: DataFrame, id_col: str, silo_col: str = "silo_id", val_fraction: float = 0.2,
                          seed: str | int = "42:val") -> DataFrame:
    """Per silo the first ``max(1, int(n * val_fraction))`` rows in hash order are validation."""
    tagged = rank_tag(df, id_col, seed, [silo_col], lambda sizes: sizes.select(
        "*", F.lit(0).alias("_tag"), F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(float(val_fraction)))).alias("_r")),
        "_val")
    return tagged.withColumn("part", F.when(F.col("_val").isNotNull(), "val").otherwise("train")).drop("_val")


def oversample_weights(df: DataFrame, silo_col: str = "silo_id", label_id: str = "label_id") -> DataFrame:
    """Per (silo, class): count, target (largest class of the silo) and weight ``target / count``.

    Training with these weights has the same expected gradient as random oversampling
    without materialising any copies.
    """
    c = df.groupBy(silo_col, label_id).agg(F.count(F.lit(1)).alias("cnt"))
    t = F.max("cnt").over(Window.partitionBy(silo_col))
    return c.withColumn("target", t).withColumn("weight", F.col("target") / F.col("cnt"))


#: expected copies of a row from which a normal draw stands for the Poisson one (fixed value)
_NORMAL_FROM = 32.0


def _poisson_draw(id_col: str, seed: str) -> Column:
    """Hash-seeded Poisson number with mean ``_rate`` (its cumulative terms are in ``_cdf``)."""
    u = F.coalesce(hash_unit(id_col, f"{seed}:k"), F.lit(0.5))
    v = F.coalesce(hash_unit(id_col, f"{seed}:z"), F.lit(0.25))

    def number(x: Column) -> Column:
        z = F.sqrt(-2.0 * F.log(F.greatest(x["u"], F.lit(1e-18)))) * F.cos(2.0 * np.pi * x["v"])
        large = F.greatest(F.lit(0.0), F.floor(F.col("_rate") + F.sqrt("_rate") * z + 0.5))
        small = F.size(F.filter("_cdf", lambda t: t <= x["u"]))
        return F.when(F.col("_rate") < _NORMAL_FROM, small).otherwise(large).cast("bigint")

    # the hashes as elements of an array: the inner lambda would work them out anew for each term
    return F.element_at(F.transform(F.array(F.struct(u.alias("u"), v.alias("v"))), number), 1)


def _poisson_terms(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0 .. 99."""
    start = F.exp(-rate)
    step = lambda a, i: F.struct((a["p"] * rate / i).alias("p"), (a["s"] + a["p"] * rate / i).alias("s"),
                                 F.concat(a["c"], F.array(a["s"] + a["p"] * rate / i)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(99)), F.struct(start.alias("p"), start.alias("s"), F.array(start).alias("c")), step, lambda a: a["c"])


def random_oversample(df: DataFrame, id_col: str, silo_col: str = "silo_id", label_id: str = "label_id",
                      seed: str | int = "42:over", chunk: int = 65536) -> DataFrame:
    """Materialised oversampling: each local class raised to the silo's largest class count.

    Originals are kept (``copy = 0``); E extras are drawn with replacement. Every row of a class
    decides by the hash of its id how many copies it offers, a Poisson number whose mean is a
    little above its share of E; of all copies offered, the E first in hash order stay
    (``rank_tag``). A uniform choice of E among independent Poisson offers is a multinomial
    draw, so no row needs to know any other: the rows are not ranked, joined on an id or shuffled,
    and ids may be NULL or repeated (rows that share an id offer alike; rows equal in every
    column are counted). Should a class offer fewer than E copies, every row offers as many more
    as that takes. ``copy`` numbers a row's offers from 1, those that do not stay leave gaps.
    A row that offers more than ``chunk`` copies is dealt out in pieces first, so its copies are
    made by several tasks. Rows without a silo or class are kept as they are.
    """
    strata, seed = [silo_col, label_id], str(seed)
    classed = df.where(F.col(silo_col).isNotNull() & F.col(label_id).isNotNull())
    sizes = classed.groupBy(*strata).agg(F.count(F.lit(1)).alias("_cnt"))
    extra = F.max("_cnt").over(Window.partitionBy(silo_col)) - F.col("_cnt")
    rate = (F.col("_extra") + 6.0 * F.sqrt(F.col("_extra").cast("double")) + 20.0) / F.col("_cnt")
    need = sizes.withColumn("_extra", extra).where("_extra > 0").withColumn("_rate", rate) \
        .withColumn("_cdf", F.when(F.col("_rate") < _NORMAL_FROM, _poisson_terms(F.col("_rate"))))
    need = materialize(need, "oversample-need")
    offered = lookup_join(classed, need, strata, how="inner").groupBy(*strata).agg(F.sum(_poisson_draw(id_col, seed)).alias("_all"))
    short = F.greatest(F.lit(0), F.col("_extra") - F.col("_all"))
    need = materialize(need.join(offered, strata).withColumn("_more", F.ceil(short / F.col("_cnt"))), "oversample-need")

    rows = lookup_join(classed, need.select(*strata, "_rate", "_cdf", "_more"), strata, how="inner") \
        .withColumn("_k", _poisson_draw(id_col, seed) + F.col("_more")).drop("_rate", "_cdf", "_more").where("_k > 0")
    few = rows.where(F.col("_k") <= chunk).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_k"))))
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_k") - 1) / chunk).cast("bigint")))
    many = rows.where(F.col("_k") > chunk).withColumn("_piece", piece).repartition(*strata, id_col, "_piece") \
        .withColumn("copy", F.explode(F.sequence(F.col("_piece") * chunk + 1, F.least(F.col("_k"), (F.col("_piece") + 1) * chunk)))).drop("_piece")
    offers = few.unionByName(many).drop("_k").withColumn("_pick", F.concat_ws("#", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))

    def targets(sizes):
        return sizes.join(need.select(*strata, "_extra"), strata).select(sizes["*"], F.lit(0).alias("_tag"), F.col("_extra").alias("_r"))

    offers = materialize(offers, "oversample-offers")  # read once a level of the boundary search
    stay = rank_tag(offers, "_pick", f"{seed}:keep", strata, targets, "_stays").where(F.col("_stays").isNotNull()).drop("_stays", "_pick")
    return df.withColumn("copy", F.lit(0).cast("bigint")).unionByName(stay)
