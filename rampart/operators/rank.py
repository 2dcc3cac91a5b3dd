"""Hash-order ranks and rank boundaries, found coarse to fine.

Rows are ordered by ``md5(id ':' seed)``, then the id. ``rank_tag`` needs only the rows at a
few boundary ranks per stratum: row counts of two-digit prefixes of the key (256 groups, so
tasks combine almost everything before the shuffle) locate the bucket of each boundary, only
those buckets are counted two digits finer, and so on until a bucket is small; its keys are
then read to find the boundary itself. Rows meet the boundaries of their own leading two
digits through a small written table, so a row compares with few boundaries however many
there are. Nothing is gathered on the driver but one maximum per level.

A boundary can fall inside a group of rows that are equal in every column. Such rows cannot be
told apart, but they can be counted: the group is cut by quotas and made anew from one of its
rows, so every boundary holds exactly, however often a row is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, NumericType

from rampart.functions.scalar import hash_key
from rampart.session import materialize

BUCKET_HEX = 5
LEAF_ROWS = 16_384  # a bucket this small is read row by row
COPY_ROWS = 65_536  # equal rows that one task makes at once
_STEP = 2  # hex digits per level
_HEX = 32  # digits of a key


def stratum_keys(df: DataFrame, strata: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Per stratum column a non-null pair (value or a typed default, is-null flag), so that
    plain equality on the pairs is null-safe equality: a NULL stratum is its own stratum."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols: dict[str, Column] = {}
    for i, c in enumerate(strata):
        t = types[c]
        if isinstance(t, NumericType):
            v = F.coalesce(F.col(c), F.lit(0).cast(t))
        elif isinstance(t, BooleanType):
            v = F.coalesce(F.col(c), F.lit(False))
        else:
            v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        cols[f"_sv{i}"] = v
        cols[f"_sn{i}"] = F.col(c).isNull()
    return df.withColumns(cols), list(cols)


def _key(id_col: str, seed: str | int) -> Column:
    """The order key; rows with a NULL id share one key of their own."""
    return F.coalesce(hash_key(id_col, seed), F.md5(F.lit(f"null:{seed}")))


def _content(df: DataFrame) -> Column:
    """Hash of a whole row: orders rows that repeat an id."""
    return F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def hash_rank(df: DataFrame, id_col: str, seed: str | int, strata: Sequence[str] = (),
              bucket_hex: int = BUCKET_HEX, rank_col: str = "rank", size_col: str | None = "stratum_size") -> DataFrame:
    """Exact 1-based rank of each row in ``md5(id:seed), id`` order within its stratum.

    Row counts per (stratum, ``bucket_hex`` digits) give each bucket's offset through two
    levels of running sums (no window holds more than 16^3 or 16^(bucket_hex - 3) counts);
    ``row_number`` inside the bucket completes the rank. NULL ids share one key and are
    ranked; rows that repeat an id are ordered by a hash of their content.
    """
    keyed, sk = stratum_keys(df.withColumn("_tie", _content(df)), list(strata))
    coarse = min(3, bucket_hex)
    keyed = keyed.withColumn("_key", _key(id_col, seed)).withColumn("_bkt", F.substring("_key", 1, bucket_hex))
    counts = keyed.groupBy(*sk, "_bkt").agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_top", F.substring("_bkt", 1, coarse))
    tops = counts.groupBy(*sk, "_top").agg(F.sum("_cnt").alias("_n"))
    tops = tops.select(*sk, "_top", F.coalesce(F.sum("_n").over(Window.partitionBy(*sk).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                       F.sum("_n").over(Window.partitionBy(*sk)).alias("_size"))
    inside = F.coalesce(F.sum("_cnt").over(Window.partitionBy(*sk, "_top").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_in", inside).join(tops, on=[*sk, "_top"]).select(*sk, "_bkt", (F.col("_base") + F.col("_in")).alias("_off"), "_size")
    j = keyed.join(offsets, on=[*sk, "_bkt"], how="inner")
    order = Window.partitionBy(*sk, "_bkt").orderBy("_key", id_col, "_tie")
    out = j.withColumn(rank_col, (F.row_number().over(order) + F.col("_off")).cast("bigint"))
    out = out.withColumnRenamed("_size", size_col) if size_col else out.drop("_size")
    return out.drop("_key", "_bkt", "_off", "_tie", *sk)


def _boundaries(keyed: DataFrame, sk: list[str], targets: DataFrame) -> tuple[DataFrame, int]:
    """Narrow every target (strata, _tag, _r) to a key prefix whose bucket is small; returns the
    targets with _p, the rank left inside the bucket, and the prefix length."""
    active = materialize(targets.select(*sk, "_tag", "_r", F.lit("").alias("_p"), F.col("_size").alias("_n")), "rank-targets")
    digits = 0
    while digits < _HEX and (active.agg(F.max("_n")).first()[0] or 0) > LEAF_ROWS:
        here, up = digits + _STEP, digits
        rows = keyed.select(*sk, "_key").withColumn("_p", F.substring("_key", 1, up) if up else F.lit(""))
        rows = rows.join(active.select(*sk, "_p").distinct(), on=[*sk, "_p"], how="left_semi")
        fine = rows.groupBy(*sk, "_p", F.substring("_key", 1, here).alias("_q")).agg(
            F.count(F.lit(1)).alias("_c"), (F.min(F.xxhash64("_key")) == F.max(F.xxhash64("_key"))).alias("_one"))
        run = F.sum("_c").over(Window.partitionBy(*sk, "_p").orderBy("_q").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        fine = fine.select(*sk, "_p", "_q", "_c", "_one", (run - F.col("_c")).alias("_off"))
        hit = active.join(fine, on=[*sk, "_p"]).where("_r > _off and _r <= _off + _c")
        left = F.when(F.col("_one"), 0).otherwise(F.col("_c"))  # a bucket of one key gets no smaller
        active = materialize(hit.select(*sk, "_tag", (F.col("_r") - F.col("_off")).alias("_r"), F.col("_q").alias("_p"), left.alias("_n")), "rank-targets")
        digits = here
    return active, digits


def _cutoffs(df: DataFrame, keyed: DataFrame, sk: list[str], id_col: str, targets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(strata, _key, id, _tie, _tag): a row is at or before a boundary when its (key, id,
    content hash) is not greater. _tie is NULL where a boundary falls between different ids.

    Also the boundaries inside rows of one content hash, if any: (strata, _key, _tie, _tag, _r,
    the rows up to the boundary). The cutoff of such a boundary lies before these rows."""
    active, digits = _boundaries(keyed, sk, targets)
    prefix = F.substring("_key", 1, digits) if digits else F.lit("")
    rows = keyed.withColumn("_p", prefix).join(active.select(*sk, "_p").distinct(), on=[*sk, "_p"], how="left_semi")
    ids = rows.groupBy(*sk, "_p", "_key", id_col).agg(F.count(F.lit(1)).alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*sk, "_p").orderBy("_key", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ids = ids.select(*sk, "_p", "_key", id_col, "_c", (run - F.col("_c")).alias("_off"))
    cuts = active.join(ids, on=[*sk, "_p"]).where("_r > _off and _r <= _off + _c")
    cuts = materialize(cuts.select(*sk, "_key", id_col, "_tag", (F.col("_r") - F.col("_off")).alias("_r"), "_c"), "rank-cuts")
    parted = cuts.where("_r < _c")
    whole = cuts.where("_r = _c").select(*sk, "_key", id_col, F.lit(None).cast("long").alias("_tie"), "_tag")
    if parted.isEmpty():
        return whole, None
    # a boundary inside the rows of one id: order them by content
    sid = F.col(id_col)
    at = parted.select(*sk, F.col("_key"), "_tag", "_r").withColumnRenamed("_key", "_at")
    rows = keyed.withColumn("_tie", _content(df)).select(*sk, "_key", sid, "_tie").join(at.select(*sk, F.col("_at").alias("_key")).distinct(), on=[*sk, "_key"], how="left_semi")
    ties = rows.groupBy(*sk, "_key", id_col, "_tie").agg(F.count(F.lit(1)).alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*sk, "_key", id_col).orderBy("_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ties = ties.select(*sk, F.col("_key").alias("_at"), sid.alias("_id"), "_tie", "_c", (run - F.col("_c")).alias("_off"))
    fine = at.join(ties, on=[*sk, "_at"]).where("_r > _off and _r <= _off + _c") \
        .select(*sk, F.col("_at").alias("_key"), F.col("_id").alias(id_col), "_tie", "_tag", (F.col("_r") - F.col("_off")).alias("_r"), "_c")
    fine = materialize(fine, "rank-ties")
    before = F.when((F.col("_r") < F.col("_c")) & (F.col("_tie") > -2**63), F.col("_tie") - 1).otherwise(F.col("_tie"))
    return (whole.unionByName(fine.select(*sk, "_key", id_col, before.alias("_tie"), "_tag")),
            fine.where("_r < _c").select(*sk, "_key", "_tie", "_tag", "_r"))


def _by_quota(tagged: DataFrame, sk: list[str], inside: DataFrame, out_col: str, cols: list[str]) -> DataFrame:
    """``tagged`` (with the internal columns _key and _tie) where the rows of the boundaries
    ``inside`` are counted by their content and made anew: each boundary's tag for its quota of
    the rows, in the order of their content, and the tag they have here for the rest."""
    on = [*sk, "_key", "_tie"]
    inside = materialize(inside, "rank-inside")
    rest = tagged.join(inside.select(*on).distinct(), on=on, how="left_anti").select(*cols)
    whole = F.struct(*[F.col(f"`{c}`") for c in cols])
    equal = tagged.join(inside.select(*on).distinct(), on=on, how="left_semi").groupBy(*on, F.to_json(whole).alias("_json")) \
        .agg(F.count(F.lit(1)).alias("_c"), F.first(whole).alias("_row"))
    upto = F.sum("_c").over(Window.partitionBy(*on).orderBy("_json").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    equal = equal.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    group = Window.partitionBy(*on).orderBy("_r")
    spans = inside.select(*on, F.coalesce(F.lag("_r").over(group), F.lit(0)).alias("_lo"), F.col("_r").alias("_hi"), "_tag")
    last = inside.groupBy(*on).agg(F.max("_r").alias("_lo")).select(*on, "_lo", F.lit(2**62).alias("_hi"), F.lit(None).alias("_tag"))
    pieces = equal.join(spans.withColumn("_inner", F.lit(True)).unionByName(last.withColumn("_inner", F.lit(False))), on=on) \
        .withColumn("_n", F.least("_to", "_hi") - F.greatest("_from", "_lo")).where("_n > 0")
    made = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPY_ROWS).cast("bigint"))).alias("_piece")) \
        .repartition(*on, "_json", "_hi", "_piece") \
        .withColumn("_i", F.explode(F.sequence(F.col("_piece") * COPY_ROWS + 1, F.least(F.col("_n"), (F.col("_piece") + 1) * COPY_ROWS))))
    tag = F.when(F.col("_inner"), F.col("_tag")).otherwise(F.col("_row").getField(out_col))
    made = made.select(*[(tag if c == out_col else F.col("_row").getField(c)).alias(c) for c in cols])
    return rest.unionByName(made)


def rank_tag(df: DataFrame, id_col: str, seed: str | int, strata: Sequence[str], targets, out_col: str) -> DataFrame:
    """``out_col`` = the smallest tag whose target rank is >= the row's rank in its stratum (rank
    in ``md5(id:seed), id`` order, as ``hash_rank``); NULL when no target is that high.

    ``targets(sizes)`` gets one row per stratum (the strata columns, their internal key columns
    and ``_size``) and returns those rows expanded with ``_tag`` and ``_r`` (a 1-based target
    rank; keep every input column). "rank <= n" is one tag; silo cuts are one tag per silo.

    NULL ids take part (one key for all). Rows that repeat an id are told apart by a hash of
    their content, and rows equal in every column are cut by count, so every boundary holds
    exactly. The rows themselves are never ranked or shuffled.
    """
    st = list(strata)
    keyed, sk = stratum_keys(df, st)
    keyed = keyed.withColumn("_key", _key(id_col, seed))
    sizes = materialize(keyed.groupBy(*sk, *st).agg(F.count(F.lit(1)).alias("_size")), "rank-sizes")
    wanted = targets(sizes).select(*sk, "_tag", F.least(F.col("_r"), F.col("_size")).cast("bigint").alias("_r"), "_size").where("_r >= 1")
    # several tags can end at the same rank (an empty silo): the smallest one decides
    wanted = wanted.groupBy(*sk, "_r", "_size").agg(F.min("_tag").alias("_tag"))
    cuts, inside = _cutoffs(df, keyed, sk, id_col, wanted)
    cuts = materialize(cuts, "rank-cutoffs")
    ties = not cuts.where("_tie is not null").isEmpty()
    # per stratum and leading digits: the boundaries there, in order, and the tag beyond them
    digits = F.substring("_key", 1, _STEP)
    item = F.struct(F.col("_key").alias("k"), F.col(id_col).alias("i"), F.coalesce("_tie", F.lit(2**63 - 1)).alias("c"), F.col("_tag").alias("t"))
    groups = cuts.groupBy(*sk, digits.alias("_p")).agg(F.sort_array(F.collect_list(item)).alias("_at"), F.min("_tag").alias("_lo"))
    every = F.transform(F.sequence(F.lit(0), F.lit(16**_STEP - 1)), lambda x: F.lower(F.lpad(F.hex(x.cast("long")), _STEP, "0")))
    grid = sizes.select(*sk, F.explode(every).alias("_p")).join(groups, on=[*sk, "_p"], how="left")
    later = Window.partitionBy(*sk).orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    table = materialize(grid.select(*sk, "_p", "_at", F.min("_lo").over(later).alias("_next")), "rank-table")
    me = F.struct(F.col("_key").alias("k"), F.col(id_col).alias("i"), (_content(df) if ties else F.lit(-2**63)).alias("c"))
    near = F.filter("_at", lambda x: F.struct(x["k"].alias("k"), x["i"].alias("i"), x["c"].alias("c")) >= me)
    tag = F.coalesce(F.array_min(F.transform(near, lambda x: x["t"])), F.col("_next"))
    # the written table's file size decides: small ones are broadcast, larger ones are a shuffle join
    cols = [*[c for c in df.columns if c != out_col], out_col]
    tagged = keyed.withColumn("_p", digits).join(table, on=[*sk, "_p"], how="left").withColumn(out_col, tag)
    if inside is None or inside.isEmpty():
        return tagged.select(*cols)
    return _by_quota(tagged.withColumn("_tie", _content(df)), sk, inside, out_col, cols)


def first_n(df: DataFrame, id_col: str, seed: str | int, strata: Sequence[str], n_of_size) -> DataFrame:
    """Rows whose rank in their stratum is <= ``n_of_size(_size)`` (a Column expression of the
    stratum size): samples and splits without ranking or shuffling the rows."""
    def targets(sizes):
        return sizes.select("*", F.lit(0).alias("_tag"), n_of_size(F.col("_size")).alias("_r"))
    return rank_tag(df, id_col, seed, strata, targets, "_first").where(F.col("_first").isNotNull()).drop("_first")
