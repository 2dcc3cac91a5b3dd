"""Poisoning-resilient aggregation of client updates, as Spark SQL over long-form tables.

Input shape (long form, one row per client and coordinate)::

    updates(<keys...>, client_id, pos, value)
    clients(<keys...>, client_id, num_examples, train_loss, malicious)

``keys`` are optional grouping columns (round, config_id, ...) so that many
aggregations run in one job. Every rule reduces per ``(keys, pos)``; a group holds
one value per client, so group sizes are bounded by the client count, never by the
number of flow rows. Krum's pairwise distances are a self-join of coordinate blocks on
``(keys, block)`` with ``a.client_id < b.client_id`` followed by a partial (map-side) sum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.functions.attach import with_scalars

# Names of the aggregation rules and attacks.
METHODS = ("fedavg", "median", "trimmed_mean", "krum", "multikrum")
ATTACKS = ("none", "label_flip", "model_poison")

PAIR_BLOCK = 64   # coordinates per packed block in Krum's pairwise distances
CLIENT_BUCKET = 128   # clients whose pairs one key of Krum's distances may hold


def _keys(keys: Sequence[str] | None) -> list[str]:
    return list(keys or [])


def _param(df: DataFrame, p: float | int | str | None, keys: list[str], name: str) -> DataFrame:
    """Attach an argument as a column: literal, or an existing column name."""
    if isinstance(p, str):
        return df.withColumn(name, F.col(p))
    return df.withColumn(name, F.lit(p))


def _join(a: DataFrame, b: DataFrame, ks: list[str], how: str = "inner") -> DataFrame:
    """Join on the key columns; with no keys ``b`` is a one-row aggregate attached as scalars."""
    return a.join(b, on=ks, how=how) if ks else with_scalars(a, b)


def client_count(updates: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    ks = _keys(keys)
    return updates.groupBy(*ks).agg(F.countDistinct("client_id").alias("n_clients"))


# ------------------------------------------------------------------ argument rules
def num_malicious(fraction: Column, n: Column) -> Column:
    """``round(fraction * n)`` with Python's half-even rounding."""
    return F.bround(fraction * n, 0).cast("int")


def clamp_f(n: Column, f: Column) -> Column:
    """Krum needs ``n >= 2f + 3``: clamp f into ``[0, (n-3) // 2]``."""
    return F.greatest(F.lit(0), F.least(f.cast("int"), F.floor((n - 3) / 2).cast("int")))


def trim_count(n: Column, ratio: Column) -> Column:
    """``k = min(floor(ratio*n + 1e-9), (n-1)//2)``."""
    return F.least(F.floor(ratio * n + F.lit(1e-9)).cast("int"), F.floor((n - 1) / 2).cast("int"))


# ------------------------------------------------------------------ aggregation rules
def fedavg(updates: DataFrame, clients: DataFrame, keys: Sequence[str] | None = None,
           weight_col: str = "num_examples") -> DataFrame:
    """Example-weighted mean per coordinate."""
    ks = _keys(keys)
    w = clients.select(*ks, "client_id", F.col(weight_col).cast("double").alias("_w"))
    j = updates.join(w, on=ks + ["client_id"], how="inner")
    return j.groupBy(*ks, "pos").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))


def coordinate_median(updates: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Exact median per coordinate (even count: mean of the middle two)."""
    ks = _keys(keys)
    return updates.groupBy(*ks, "pos").agg(F.median("value").alias("value"))


def trimmed_mean(updates: DataFrame, trim_ratio: float | str = 0.0,
                 keys: Sequence[str] | None = None) -> DataFrame:
    """Drop the k smallest and k largest values per coordinate, then average.

    ``trim_ratio`` is a number or the name of a column constant per key group.
    """
    ks = _keys(keys)
    u = _param(updates, trim_ratio, ks, "_ratio")
    w = Window.partitionBy(*ks, "pos")
    ranked = (
        u.withColumn("_rn", F.row_number().over(w.orderBy("value", "client_id")))
        .withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_k", F.greatest(F.lit(0), trim_count(F.col("_n"), F.col("_ratio"))))
    )
    kept = ranked.where((F.col("_rn") > F.col("_k")) & (F.col("_rn") <= F.col("_n") - F.col("_k")))
    return kept.groupBy(*ks, "pos").agg(F.avg("value").alias("value"))


def pairwise_sq_distances(updates: DataFrame, keys: Sequence[str] | None = None,
                          block: int = PAIR_BLOCK, bucket: int = CLIENT_BUCKET) -> DataFrame:
    """Squared L2 distance between every pair of clients, both directions, self excluded.

    Each client's update is packed into blocks of ``block`` coordinates (one
    ``pos -> value`` map per (keys, client, block), bounded by ``block``), so client pairs
    are formed once per block rather than once per coordinate. Clients are dealt to buckets of
    about ``bucket``, whose pairs (a, b) with a <= b are the triangle of all pairs: an equi-join
    on (keys, block, a, b), where no key holds more than about ``bucket`` squared pairs, however
    many clients there are. Per-block sums of squared differences (>= 0 by construction, no
    Gram-matrix cancellation) are summed per pair, partially before the shuffle, then
    mirrored. A coordinate missing on one side is skipped.
    """
    ks = _keys(keys)
    packed = updates.groupBy(*ks, "client_id", F.floor(F.col("pos") / block).alias("_blk")).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_m"))
    n_buckets = F.ceil(F.col("n_clients") / bucket).cast("int")
    dealt = _join(packed, client_count(updates, ks), ks).withColumn("_top", n_buckets - 1).withColumn("_own", F.pmod(F.xxhash64("client_id"), n_buckets).cast("int"))
    a = dealt.select(*ks, "_blk", F.col("_own").alias("_a"), F.explode(F.sequence("_own", "_top")).alias("_b"), F.col("client_id").alias("c1"), F.col("_m").alias("_m1"))
    b = dealt.select(*ks, "_blk", F.explode(F.sequence(F.lit(0), "_own")).alias("_a"), F.col("_own").alias("_b"), F.col("client_id").alias("c2"), F.col("_m").alias("_m2"))
    sq = F.map_zip_with("_m1", "_m2", lambda _, x, y: F.coalesce((x - y) * (x - y), F.lit(0.0)))
    part = F.aggregate(F.map_values(sq), F.lit(0.0), lambda acc, v: acc + v)
    half = (
        a.join(b, on=[*ks, "_blk", "_a", "_b"], how="inner")
        .where((F.col("_a") < F.col("_b")) | (F.col("c1") < F.col("c2")))
        .groupBy(*ks, "c1", "c2")
        .agg(F.sum(part).alias("d"))
    )
    mirror = half.select(*ks, F.col("c2").alias("c1"), F.col("c1").alias("c2"), "d")
    return half.unionByName(mirror)


def krum_scores(updates: DataFrame, f: int | str = 0, keys: Sequence[str] | None = None) -> DataFrame:
    """Krum score per client: sum of its ``max(1, n - f' - 2)`` smallest squared distances.

    Returns ``(keys, client_id, n_clients, f_used, score)``.
    """
    ks = _keys(keys)
    fv = F.max(f).cast("int") if isinstance(f, str) else F.lit(int(f))
    fcol = (
        updates.groupBy(*ks)
        .agg(F.countDistinct("client_id").alias("n_clients"), fv.alias("_f"))
        .withColumn("f_used", clamp_f(F.col("n_clients"), F.col("_f")))
        .withColumn("_k", F.greatest(F.lit(1), F.col("n_clients") - F.col("f_used") - 2))
        .drop("_f")
    )
    d = _join(pairwise_sq_distances(updates, ks), fcol, ks)
    w = Window.partitionBy(*ks, "c1").orderBy("d", "c2")
    near = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_k"))
    return near.groupBy(*ks, F.col("c1").alias("client_id"), "n_clients", "f_used").agg(F.sum("d").alias("score"))


def krum_select(updates: DataFrame, f: int | str = 0, multi: bool = False,
                keys: Sequence[str] | None = None) -> DataFrame:
    """Clients chosen by Krum (m=1) or Multi-Krum (m = n - f').

    With fewer than 3 clients every client is selected. Ties on score go to the
    lower client id. Returns ``(keys, client_id, score, selected)``.
    """
    ks = _keys(keys)
    scores = krum_scores(updates, f, ks)
    m = (F.col("n_clients") - F.col("f_used")) if multi else F.lit(1)
    m = F.greatest(F.lit(1), F.least(m, F.col("n_clients")))
    w = Window.partitionBy(*ks).orderBy("score", "client_id")
    ranked = scores.withColumn("_r", F.row_number().over(w))
    sel = (F.col("n_clients") < 3) | (F.col("_r") <= m)
    scored = ranked.select(*ks, "client_id", "score", sel.alias("selected"))
    # a lone client has no distances at all: select it explicitly
    small_rows = _join(updates.select(*ks, "client_id").distinct(), client_count(updates, ks), ks).where(
        F.col("n_clients") < 2).select(
        *ks, "client_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("selected"))
    return scored.unionByName(small_rows)


def krum(updates: DataFrame, f: int | str = 0, multi: bool = False,
         keys: Sequence[str] | None = None) -> DataFrame:
    """Unweighted mean of the Krum-selected clients' updates, per coordinate."""
    ks = _keys(keys)
    chosen = krum_select(updates, f, multi, ks).where("selected").select(*ks, "client_id")
    return (
        updates.join(chosen, on=ks + ["client_id"], how="left_semi")
        .groupBy(*ks, "pos")
        .agg(F.avg("value").alias("value"))
    )


def aggregate(method: str, updates: DataFrame, clients: DataFrame | None = None, f: int | str = 0,
              trim_ratio: float | str = 0.0, keys: Sequence[str] | None = None) -> DataFrame:
    """Dispatch by rule name; unknown names raise ``ValueError``."""
    rules: dict[str, Callable[[], DataFrame]] = {
        "fedavg": lambda: fedavg(updates, clients, keys),
        "median": lambda: coordinate_median(updates, keys),
        "trimmed_mean": lambda: trimmed_mean(updates, trim_ratio, keys),
        "krum": lambda: krum(updates, f, False, keys),
        "multikrum": lambda: krum(updates, f, True, keys),
    }
    if method not in rules:
        raise ValueError(f"no rule named {method!r}; known: {', '.join(METHODS)}")
    if method == "fedavg" and clients is None:
        raise ValueError("fedavg needs the clients table (example counts)")
    return rules[method]()


# ------------------------------------------------------------------ round statistics
def weighted_train_loss(clients: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    ks = _keys(keys)
    w = F.col("num_examples").cast("double")
    return clients.groupBy(*ks).agg((F.sum(F.col("train_loss") * w) / F.sum(w)).alias("train_loss"))


def round_stats(updates: DataFrame, clients: DataFrame, selection: DataFrame | None = None,
                keys: Sequence[str] | None = None) -> DataFrame:
    """clients, malicious_in_round, bytes_up/down (8 bytes per value), kept counts for Krum runs."""
    ks = _keys(keys)
    n_params = updates.groupBy(*ks).agg(F.countDistinct("pos").alias("_p"))
    c = clients.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("clients"),
        F.sum(F.col("malicious").cast("bigint")).alias("malicious_in_round"),
    )
    out = _join(c, n_params, ks)
    out = out.select(
        *ks, "clients", "malicious_in_round",
        (F.col("clients") * F.col("_p") * 8).cast("bigint").alias("bytes_up"),
        (F.col("clients") * F.col("_p") * 8).cast("bigint").alias("bytes_down"),
    )
    if selection is None:
        return out.withColumn("kept_clients", F.lit(None).cast("bigint")).withColumn(
            "malicious_kept", F.lit(None).cast("bigint"))
    kept = selection.where("selected").join(clients.select(*ks, "client_id", "malicious"), on=ks + ["client_id"])
    kept = kept.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("kept_clients"),
        F.sum(F.col("malicious").cast("bigint")).alias("malicious_kept"),
    )
    return _join(out, kept, ks, "left")


# ------------------------------------------------------------------ attacks
def flip_labels(df: DataFrame, n_classes: int, label_col: str = "label_id",
                malicious_col: str = "malicious", out_col: str = "train_label") -> DataFrame:
    """Label-flip poison: class c becomes ``n_classes - 1 - c`` on malicious rows only."""
    lab = F.col(label_col)
    return df.withColumn(out_col, F.when(F.col(malicious_col) == 1, F.lit(n_classes - 1) - lab).otherwise(lab))


def poison_updates(updates: DataFrame, global_params: DataFrame, clients: DataFrame, scale: float = 3.0,
                   keys: Sequence[str] | None = None) -> DataFrame:
    """Model poison ``g - scale * (l - g)`` for malicious clients; honest rows pass through."""
    ks = _keys(keys)
    g = global_params.select(*ks, "pos", F.col("value").alias("_g"))
    m = clients.select(*ks, "client_id", "malicious")
    j = updates.join(g, on=ks + ["pos"], how="inner").join(m, on=ks + ["client_id"], how="inner")
    poisoned = F.col("_g") - F.lit(float(scale)) * (F.col("value") - F.col("_g"))
    return j.select(*[c for c in updates.columns if c != "value"],
                    F.when(F.col("malicious") == 1, poisoned).otherwise(F.col("value")).alias("value"))


def mark_malicious(clients: DataFrame, fraction: float | str, keys: Sequence[str] | None = None) -> DataFrame:
    """Clients with ``client_id < round(fraction * n)`` are malicious."""
    ks = _keys(keys)
    fr = F.col(fraction) if isinstance(fraction, str) else F.lit(float(fraction))
    n = clients.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    out = _join(clients, n, ks)
    return out.withColumn("malicious", (F.col("client_id") < num_malicious(fr, F.col("_n"))).cast("int")).drop("_n")


# ------------------------------------------------------------------ parameter layout
def flatten_params(coef: DataFrame, intercept: DataFrame, n_features: int, n_classes: int) -> DataFrame:
    """``coef(class, feature, value)`` + ``intercept(class, value)`` -> ``params(pos, value)``.

    Row-major coefficients first (``pos = class*F + feature``), intercepts after (``C*F + class``).
    """
    a = coef.select((F.col("class") * n_features + F.col("feature")).alias("pos"), "value")
    b = intercept.select((F.lit(n_classes * n_features) + F.col("class")).alias("pos"), "value")
    return a.unionByName(b)


def unflatten_params(params: DataFrame, n_features: int, n_classes: int) -> tuple[DataFrame, DataFrame]:
    cut = n_classes * n_features
    coef = params.where(F.col("pos") < cut).select(
        F.floor(F.col("pos") / n_features).cast("int").alias("class"),
        (F.col("pos") % n_features).cast("int").alias("feature"), "value")
    intercept = params.where(F.col("pos") >= cut).select((F.col("pos") - cut).cast("int").alias("class"), "value")
    return coef, intercept
