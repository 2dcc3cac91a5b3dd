"""Registered queries: split leakage, duplicates, label coverage, partition checks (F-splits, F-flows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rampart.operators import quality as Q
from rampart.operators import sampling as S
from rampart.plans import registry_sampling as RS
from rampart.plans.oracle_fixtures import with_fixtures
from rampart.plans.sqlbits import FLOWS_ENC, LABEL_MAP, key, unit_of
from rampart.sources import tables as T


def q_id_overlap(spark, sf):
    return Q.id_overlap(T.splits(spark, sf))


def q_id_overlap_planted(spark, sf):
    """Every 17th training row also occurs in val, every 34th in test as well."""
    s = T.splits(spark, sf)
    more = s.where((F.col("split") == "train") & (F.col("row_id") % 17 == 0))
    both = s.unionByName(more.withColumn("split", F.lit("val"))).unionByName(
        more.where(F.col("row_id") % 34 == 0).withColumn("split", F.lit("test")))
    return Q.id_overlap(both)


def q_unseen_planted(spark, sf):
    s = T.splits(spark, sf)
    lab = F.when(F.col("row_id") % 100 == 7, "rare").when(F.col("row_id") % 100 == 9, "new").otherwise(F.col("label"))
    return Q.unseen_labels(s.withColumn("label", lab))


def q_dup_nulls(spark, sf):
    """Two columns with NULLs in changing positions: (NULL, 1) and (1, NULL) differ."""
    s, i = T.splits(spark, sf), F.col("row_id")
    m = F.floor(i / 10)
    pair = s.select("row_id", "split", F.when(m % 3 != 0, m % 4).alias("a"), F.when(m % 5 != 0, m % 7).alias("b"))
    d = Q.duplicate_vectors(pair.where((F.col("split") != "train") | (F.col("row_id") % 4 == 0)), ["a", "b"])
    return d.select("n_probe", "n_dup", F.round("share", 6).alias("share"))


def q_dup_collisions(spark, sf):
    """Fingerprints of one bit, so that different vectors share them: the count stays exact."""
    g = S.hash_split(T.splits(spark, sf).drop("split"), "row_id", "again")
    d = Q.duplicate_vectors(g.select("split", "feats", "label"), ["feats", "label"],
                            fingerprints=[F.pmod(F.xxhash64("feats", "label"), F.lit(2)).alias("_fp")])
    return d.select("n_probe", "n_dup", F.round("share", 6).alias("share"))


def q_dup_plain(spark, sf):
    d = Q.duplicate_vectors(T.splits(spark, sf), ["feats"])
    return d.select("n_probe", "n_dup", F.round("share", 6).alias("share"))


def q_dup_group(spark, sf):
    g = S.group_aware_split(T.splits(spark, sf).drop("split"), "feats")
    d = Q.duplicate_vectors(g, ["feats"])
    return d.select("n_probe", "n_dup", F.round("share", 6).alias("share"))


def q_unseen(spark, sf):
    return Q.unseen_labels(T.splits(spark, sf))


def q_class_counts(spark, sf):
    return Q.class_counts(T.splits(spark, sf), ["split"])


def q_coverage(spark, sf):
    return Q.class_coverage(RS.dirichlet(spark, sf))


def q_partition_check(spark, sf):
    return Q.partition_check(RS.iid(spark, sf), T.flows(spark, sf))


def q_label_union(spark, sf):
    sp = T.splits(spark, sf)
    return Q.label_union([sp.where(F.col("split") == s) for s in Q.SPLITS])


QUERIES = {
    "quality_dup_vectors_collisions": q_dup_collisions,
    "quality_id_overlap": q_id_overlap,
    "quality_id_overlap_planted": q_id_overlap_planted,
    "quality_unseen_labels_planted": q_unseen_planted,
    "quality_dup_vectors_nulls": q_dup_nulls,
    "quality_dup_vectors_plain": q_dup_plain,
    "quality_dup_vectors_group_aware": q_dup_group,
    "quality_unseen_labels": q_unseen,
    "quality_class_counts": q_class_counts,
    "quality_class_coverage": q_coverage,
    "quality_partition_check": q_partition_check,
    "quality_label_union": q_label_union,
}

_DUP = """
SELECT count(*) AS n_probe, count(*) FILTER (WHERE feats IN (SELECT feats FROM {src} WHERE split = 'train')) AS n_dup,
       round(coalesce(CAST(count(*) FILTER (WHERE feats IN (SELECT feats FROM {src} WHERE split = 'train')) AS DOUBLE)
                      / nullif(count(*), 0), 0.0e0), 6) AS share
FROM {src} WHERE split = 'test'"""

_GA = ("ga", f"""SELECT row_id, feats, label, CASE WHEN {unit_of('md5(feats)')} < 0.6e0 THEN 'train'
 WHEN {unit_of('md5(feats)')} < 0.8e0 THEN 'val' ELSE 'test' END AS split FROM splits""")

ORACLE = {
    "quality_dup_vectors_collisions": with_fixtures("splits", f"""
SELECT count(*) AS n_probe, count(*) FILTER (WHERE hit) AS n_dup, round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 6) AS share
FROM (SELECT EXISTS (SELECT 1 FROM again t WHERE t.part = 'train' AND t.feats = p.feats AND t.label = p.label) AS hit FROM again p WHERE part = 'test') x""", [
        ("again", f"""SELECT feats, label, CASE WHEN {unit_of(key('row_id', 'again'))} < 0.75e0 THEN 'train'
  WHEN {unit_of(key('row_id', 'again'))} < 0.875e0 THEN 'val' ELSE 'test' END AS part FROM splits""")]),
    "quality_id_overlap": with_fixtures("splits", """
SELECT a.s AS split_a, b.s AS split_b,
       (SELECT count(*) FROM (SELECT row_id FROM splits WHERE split = a.s
                              INTERSECT SELECT row_id FROM splits WHERE split = b.s) x) AS n_shared
FROM (VALUES ('train', 1), ('val', 2), ('test', 3)) a(s, o), (VALUES ('train', 1), ('val', 2), ('test', 3)) b(s, o)
WHERE a.o < b.o"""),
    "quality_id_overlap_planted": with_fixtures("splits", """
SELECT a.s AS split_a, b.s AS split_b,
       (SELECT count(*) FROM (SELECT row_id FROM more WHERE split = a.s
                              INTERSECT SELECT row_id FROM more WHERE split = b.s) x) AS n_shared
FROM (VALUES ('train', 1), ('val', 2), ('test', 3)) a(s, o), (VALUES ('train', 1), ('val', 2), ('test', 3)) b(s, o)
WHERE a.o < b.o""", [("more", """SELECT row_id, split FROM splits
UNION ALL SELECT row_id, 'val' FROM splits WHERE split = 'train' AND row_id % 17 = 0
UNION ALL SELECT row_id, 'test' FROM splits WHERE split = 'train' AND row_id % 34 = 0""")]),
    "quality_unseen_labels_planted": with_fixtures("splits", """
SELECT DISTINCT label FROM lab WHERE split <> 'train'
EXCEPT SELECT DISTINCT label FROM lab WHERE split = 'train'""", [("lab", """
SELECT split, CASE WHEN row_id % 100 = 7 THEN 'rare' WHEN row_id % 100 = 9 THEN 'new' ELSE label END AS label FROM splits""")]),
    "quality_dup_vectors_nulls": with_fixtures("splits", """
SELECT count(*) AS n_probe, count(*) FILTER (WHERE hit) AS n_dup,
       round(coalesce(CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / nullif(count(*), 0), 0.0e0), 6) AS share
FROM (SELECT EXISTS (SELECT 1 FROM ab t WHERE t.split = 'train' AND t.row_id % 4 = 0
                     AND t.a IS NOT DISTINCT FROM p.a AND t.b IS NOT DISTINCT FROM p.b) AS hit
      FROM ab p WHERE p.split = 'test') x""", [("ab", """
SELECT row_id, split, CASE WHEN (row_id // 10) % 3 <> 0 THEN (row_id // 10) % 4 END AS a,
       CASE WHEN (row_id // 10) % 5 <> 0 THEN (row_id // 10) % 7 END AS b FROM splits""")]),
    "quality_dup_vectors_plain": with_fixtures("splits", _DUP.format(src="splits")),
    "quality_dup_vectors_group_aware": with_fixtures("splits", _DUP.format(src="ga"), [_GA]),
    "quality_unseen_labels": with_fixtures("splits", """
SELECT DISTINCT label FROM splits WHERE split <> 'train'
EXCEPT SELECT DISTINCT label FROM splits WHERE split = 'train'"""),
    "quality_class_counts": with_fixtures("splits", "SELECT split, label, count(*) AS n FROM splits GROUP BY split, label"),
    "quality_class_coverage": with_fixtures("flows", """
SELECT s.silo_id, c.label_id FROM (SELECT DISTINCT silo_id FROM dir) s, (SELECT DISTINCT label_id FROM dir) c
EXCEPT SELECT silo_id, label_id FROM dir""", [LABEL_MAP, FLOWS_ENC, RS._cuts_sql(), RS._DIR]),
    "quality_partition_check": with_fixtures("flows", """
SELECT silo_id, count(*) AS n_rows, (SELECT count(*) FROM iid) AS assigned,
       (SELECT count(DISTINCT row_id) FROM iid) AS distinct_ids, (SELECT count(*) FROM flows) AS expected
FROM iid GROUP BY silo_id""", [LABEL_MAP, FLOWS_ENC, RS._IID]),
    "quality_label_union": with_fixtures("splits", "SELECT DISTINCT label FROM splits"),
}
