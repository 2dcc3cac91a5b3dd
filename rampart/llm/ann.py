"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop test.

Largest inner product becomes smallest distance: every vector gets one more coordinate that
brings it to the common norm M, queries are scaled to norm M. A Gaussian (2-stable) projection
to m dimensions gives |proj|^2 / dist^2 a chi-square distribution with m degrees. Projected
points are split into cells by the top of a kd-tree; a cell's task continues the tree and
visits its leaves in order of projected distance, verifying true inner products, until the
next leaf is so far that a better neighbour there has probability at most 1 - confidence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.session import materialize

M_DIMS = 8
LEAF = 64
HITS = "query_id long, vec_id long, score double"


def chi2_cdf(x: float, m: int) -> float:
    """Chi-square distribution for an even number of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, m) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def _matrix(col) -> np.ndarray:
    """Rows of a binary column of 64-bit floats."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    raw = [np.frombuffer(x, np.float64) for x in col.to_pylist()]
    return np.stack(raw) if raw else np.zeros((0, 0))


def clean_vectors(vectors: DataFrame, vec_id: str, column: str) -> DataFrame:
    """(vec_id, vec as 64-bit floats, dim, norm2) of the vectors that take part."""
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")) \
        .where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")

    def run(batches):
        for b in batches:
            keep, raw, dim, norm = [], [], [], []
            lists = b.column(b.schema.get_field_index("v"))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.asarray(lists.value_lengths())
            for i, (a, n) in enumerate(zip((np.cumsum(size) - size).tolist(), size.tolist())):
                v = flat[a:a + n]
                s = float(v @ v)
                if np.isfinite(v).all() and v.any() and math.isfinite(s) and s > 0:
                    keep.append(i)
                    raw.append(v.tobytes())
                    dim.append(n)
                    norm.append(s)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("vec_id")).take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary()),
                                              pa.array(dim, pa.int32()), pa.array(norm, pa.float64())], names=["vec_id", "vec", "dim", "norm2"])

    return src.mapInArrow(run, "vec_id long, vec binary, dim int, norm2 double")


class Space:
    """The projection, and the cells that the top of the kd-tree cuts projected space into."""

    def __init__(self, dim: int, norm2: float, seed: int = 3):
        self.norm2 = norm2
        self.gauss = np.random.default_rng(seed).normal(size=(dim + 1, M_DIMS))
        self.cells = 1
        self.axis, self.cut, self.lo, self.hi = [], [], np.full((1, M_DIMS), -np.inf), np.full((1, M_DIMS), np.inf)

    def points(self, x: np.ndarray, n2: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.norm2 - n2, 0))
        return x @ self.gauss[:-1] + extra[:, None] * self.gauss[-1]

    def queries(self, x: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return (x * np.sqrt(self.norm2 / n2)[:, None]) @ self.gauss[:-1]

    def split(self, sample: np.ndarray, cells: int) -> None:
        """Cut the widest axis of every cell at the sample's median, level by level."""
        where = np.zeros(len(sample), np.int64)
        while self.cells < cells:
            axis, cut = np.zeros(self.cells, np.int64), np.zeros(self.cells)
            for c in range(self.cells):
                own = sample[where == c]
                if len(own):
                    axis[c] = np.argmax(own.max(axis=0) - own.min(axis=0))
                    cut[c] = np.median(own[:, axis[c]])
            self.axis.append(axis)
            self.cut.append(cut)
            lo, hi = np.repeat(self.lo, 2, axis=0), np.repeat(self.hi, 2, axis=0)
            hi[np.arange(0, 2 * self.cells, 2), axis] = np.minimum(hi[np.arange(0, 2 * self.cells, 2), axis], cut)
            lo[np.arange(1, 2 * self.cells, 2), axis] = np.maximum(lo[np.arange(1, 2 * self.cells, 2), axis], cut)
            self.lo, self.hi, self.cells = lo, hi, 2 * self.cells
            where = 2 * where + (sample[np.arange(len(sample)), axis[where]] > cut[where])

    def cell(self, p: np.ndarray) -> np.ndarray:
        where = np.zeros(len(p), np.int64)
        for axis, cut in zip(self.axis, self.cut):
            where = 2 * where + (p[np.arange(len(p)), axis[where]] > cut[where])
        return where

    def box_dist2(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance from one query to every cell."""
        gap = np.maximum(np.maximum(self.lo - q, q - self.hi), 0)
        return (gap * gap).sum(axis=1)


class Leaves:
    """A kd-tree over projected points, held as its leaves and their bounding boxes."""

    def __init__(self, p: np.ndarray):
        order, todo, spans = np.arange(len(p)), [(0, len(p))], []
        while todo:
            a, b = todo.pop()
            own = p[order[a:b]]
            wide = own.max(axis=0) - own.min(axis=0)
            if b - a <= LEAF or not wide.any():
                spans.append((a, b))
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(wide)], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.order = order
        self.span = np.array(spans, np.int64)
        self.lo = np.array([p[order[a:b]].min(axis=0) for a, b in spans])
        self.hi = np.array([p[order[a:b]].max(axis=0) for a, b in spans])


def _best(ids: np.ndarray, score: np.ndarray, k: int):
    """The k best ids, each with its best score, best first, ties to the smaller id."""
    o = np.lexsort((ids, -score))
    first = np.unique(ids[o], return_index=True)[1]
    o = o[np.sort(first)[:k]]
    return ids[o], score[o]


def search_cell(ids: np.ndarray, x: np.ndarray, p: np.ndarray, leaves: Leaves, q_id: int, q: np.ndarray, qp: np.ndarray,
                norm: float, k: int, stop: float, known: float):
    """The k best (vec_id, inner product) of one cell, an id once. ``known``: the k-th best
    inner product seen elsewhere (-inf: none); worse ones need not be returned."""
    gap = np.maximum(np.maximum(leaves.lo - qp, qp - leaves.hi), 0)
    near = (gap * gap).sum(axis=1)
    way = np.argsort(near, kind="stable")
    scale = norm / math.sqrt(float(q @ q))  # inner products with the scaled query
    best_ids, best, kth, at, take = np.zeros(0, np.int64), np.zeros(0), known, 0, 4
    while at < len(way):
        if kth > -np.inf and near[way[at]] > stop * max(0.0, 2 * norm * norm - 2 * kth * scale):
            break
        spans = leaves.span[way[at:at + take]]
        at, take = at + take, min(64, 2 * take)
        size = spans[:, 1] - spans[:, 0]
        rows = leaves.order[np.repeat(spans[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        rows = rows[ids[rows] != q_id]
        rough = x[rows] @ q
        slack = 1e-9 * (1 + abs(kth)) if kth > -np.inf else 0
        rows = rows[rough >= kth - slack] if kth > -np.inf else rows
        # the same order of additions for every row, so that equal vectors tie exactly
        best_ids = np.concatenate([best_ids, ids[rows]])
        best = np.concatenate([best, (x[rows] * q).sum(axis=1)])
        if len(best) >= k:
            best_ids, best = _best(best_ids, best, k)
            if len(best) == k:
                kth = max(known, float(best[-1]))
    return _best(best_ids, best, k)


def nearest_neighbours(vectors: DataFrame, is_query: str, k: int = 20, vec_id: str = "vec_id", column: str = "embedding",
                       confidence: float = 0.98, cell_rows: int = 20_000, sample_rows: int = 8192,
                       block_queries: int = 20_000, max_cells: int = 4096) -> DataFrame:
    """For every vec_id that satisfies the SQL condition ``is_query`` (over vec_id): its ``k``
    nearest other vec_ids by inner product, found with the given confidence.

    Returns query_id, rank (from 1), vec_id, score (inner product in double precision), nearest
    first, ties to the smaller vec_id; all candidates if there are fewer. The tree's cuts come
    from a sample of ``sample_rows`` rows; every row is indexed. Vectors that are null, zero,
    or hold null or non-finite components take no part, nor do null ids and vectors whose
    length is not the commonest one. A row is never its own neighbour, nor are rows that
    repeat its id. A vec_id counts once: its equal rows are one row, and if its rows hold several
    vectors, each is searched for and found, and a pair of ids has its best inner product. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    clean = materialize(clean_vectors(vectors, vec_id, column).distinct(), "ann-vectors")
    stats = clean.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("m")).orderBy(F.desc("n"), "dim").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if stats is None:
        return empty
    clean = clean.where(F.col("dim") == stats["dim"])
    space = Space(stats["dim"], stats["m"])
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    space.split(space.points(np.stack([np.frombuffer(r["vec"], np.float64) for r in sample]), np.array([r["norm2"] for r in sample])),
                min(max_cells, max(1, stats["n"] // cell_rows)))
    stop, norm = chi2_quantile(confidence, M_DIMS), math.sqrt(stats["m"])

    def to_cells(batches):
        for b in batches:
            x, n2 = _matrix(b.column(1)), np.asarray(b.column(3))
            cell = space.cell(space.points(x, n2)) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(cell, pa.int64())], names=["vec_id", "vec", "norm2", "cell"])

    points = materialize(clean.mapInArrow(to_cells, "vec_id long, vec binary, norm2 double, cell long"), "ann-points")
    # crowded cells (many equal vectors) are dealt to several tasks
    subs = points.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * cell_rows)).alias("subs"))
    points = points.join(subs, "cell").withColumn("sub", F.pmod(F.xxhash64("vec_id"), "subs")).drop("subs")
    queries = clean.where(is_query)
    blocks = max(1, -(-queries.count() // block_queries))
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"), F.col("norm2").alias("q_norm2"),
                             F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))

    def home(batches):
        for b in batches:
            x, n2 = _matrix(b.column(1)), np.asarray(b.column(2))
            cell = space.cell(space.queries(x, n2)) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), -np.inf)), pa.array(cell, pa.int64())],
                                             names=["query_id", "q", "q_norm2", "block", "known", "cell"])

    def others(batches):
        for b in batches:
            x, n2, known = _matrix(b.column(1)), np.asarray(b.column(2)), np.asarray(b.column(4).fill_null(-np.inf))
            rows, cells = [], []
            if len(b):
                qp = space.queries(x, n2)
                mine = space.cell(qp)
                for i in range(len(b)):
                    far = np.inf if known[i] == -np.inf else stop * max(0.0, 2 * norm * norm - 2 * known[i] * norm / math.sqrt(n2[i]))
                    c = np.flatnonzero(space.box_dist2(qp[i]) <= far)
                    c = c[c != mine[i]]
                    rows += [i] * len(c)
                    cells += c.tolist()
            some = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cells, pa.int64())], names=["query_id", "q", "q_norm2", "block", "known", "cell"])

    def answer(pts: pa.Table, qs: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(pts) and len(qs):
            x, ids = _matrix(pts.column("vec")), np.asarray(pts.column("vec_id"))
            p = space.points(x, np.asarray(pts.column("norm2")))
            leaves = Leaves(p)
            q = _matrix(qs.column("q"))
            qp = space.queries(q, np.asarray(qs.column("q_norm2")))
            for i, (qid, known) in enumerate(zip(qs.column("query_id").to_pylist(), qs.column("known").to_pylist())):
                got, score = search_cell(ids, x, p, leaves, qid, q[i], qp[i], norm, k, stop, known)
                out.append((np.full(len(got), qid), got, score))
        return pa.table({n: pa.array(np.concatenate([o[j] for o in out])) for j, n in enumerate(("query_id", "vec_id", "score"))})

    routed = "query_id long, q binary, q_norm2 double, block long, known double, cell long"

    def ask(qs: DataFrame) -> DataFrame:
        """Each (cell, part of the cell, block of queries) is one task's work."""
        met = qs.select("cell", "block").distinct()
        pts = points.join(met, "cell")
        to = qs.join(points.select("cell", "sub").distinct(), "cell") \
            .select("query_id", "q", "q_norm2", "known", F.col("cell").alias("to_cell"), F.col("sub").alias("to_sub"), F.col("block").alias("to_block"))
        return pts.groupBy("cell", "sub", "block").cogroup(to.groupBy("to_cell", "to_sub", "to_block")).applyInArrow(answer, HITS)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(hits: DataFrame) -> DataFrame:
        """The k best ids of a query; an id found by several rows counts once, before any is cut."""
        once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = materialize(ranked(ask(queries.mapInArrow(home, routed))), "ann-first")
    known = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("known"))
    rest = ask(queries.join(known, "query_id", "left").select("query_id", "q", "q_norm2", "block", "known").mapInArrow(others, routed))
    return ranked(first.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def op4_projected_neighbours(spark, sf_dir: str) -> DataFrame:
    """Thin query: every 20th vector of the whole embeddings table against all others."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
