"""Hard-negative mining by rotated one-bit codes.

Every vector of whole numbers is rotated, and the signs of its components are its code; its norm
and its alignment (the cosine between vector and code) are stored with it. A query's rotated
vector is cut to a few bits, so that its product with a code is a sum of popcounts. What the code
leaves out is orthogonal to it, so by Cauchy-Schwarz the true product lies in a known interval.
Rows whose interval cannot reach the answer are dropped; the rest are scored in whole numbers.
Query blocks meet row blocks: every anchor meets every row, in blocks of a fixed size.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.session import materialize

INDEX = "rid long, vec_id long, label int, dim int, norm double, align double, code binary, v binary, is_anchor boolean"
_QUERY_BITS = 6
_PAIRS = 1 << 20  # pairs of a query and a row whose intervals are held at once
_LAST = 2**63 - 1


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words), norms and alignments of vectors of one length."""
    x = v.astype(np.float64) @ rotation(v.shape[1]).T
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    align = np.abs(x).sum(axis=1) / np.sqrt(v.shape[1]) / np.where(norm > 0, norm, 1)
    bits = np.zeros((len(v), -(-v.shape[1] // 64) * 64), np.uint8)
    bits[:, :v.shape[1]] = x >= 0
    return np.packbits(bits, axis=1).view(np.uint64), norm, np.where(norm > 0, np.clip(align, 0, 1), 1.0)


class Queries:
    """Bit planes of rotated query vectors, and what cutting them to planes can change."""

    def __init__(self, v: np.ndarray):
        self.dim = v.shape[1]
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        x = v.astype(np.float64) @ rotation(self.dim).T / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.low = x.min(axis=1)
        self.step = np.maximum((x.max(axis=1) - self.low) / (2**_QUERY_BITS - 1), 1e-300)
        k = np.clip(np.rint((x - self.low[:, None]) / self.step[:, None]), 0, 2**_QUERY_BITS - 1).astype(np.int64)
        self.error = np.sqrt(((self.low[:, None] + self.step[:, None] * k - x) ** 2).sum(axis=1))
        self.total = k.sum(axis=1)
        bits = np.zeros((_QUERY_BITS, len(v), -(-self.dim // 64) * 64), np.uint8)
        for b in range(_QUERY_BITS):
            bits[b, :, :self.dim] = k >> b & 1
        self.planes = np.packbits(bits, axis=2).view(np.uint64)

    def intervals(self, i: slice, code: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), queries x rows: bounds of the inner products."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        met = np.zeros((len(self.norm[i]), len(code)), np.int64)
        for b, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                met += np.bitwise_count(plane[i, w][:, None] & code[:, w]).astype(np.int64) << b
        low, step, total, error = (x[i][:, None] for x in (self.low, self.step, self.total, self.error))
        # the cut query times the code, whose components are plus and minus 1 / sqrt(dim)
        c = (low * (2 * ones - self.dim) + step * (2 * met - total)) / np.sqrt(self.dim)
        least = np.maximum(np.abs(c) - error, 0)
        slack = align * error + np.sqrt(np.maximum(1 - align**2, 0)) * np.sqrt(np.maximum(1 - least**2, 0)) + 1e-9
        size = self.norm[i][:, None] * norm
        return size * (align * c - slack) - 1e-6, size * (align * c + slack) + 1e-6


def integer_scores(a: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows a[i] and v[j]; beyond 64 bits they are cut to the ends."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(v).max(initial=0)) * a.shape[1]
    if most < 2**53 and len(i) * 50 > len(a) * len(v):  # whole numbers that doubles hold exactly
        return (a.astype(np.float64) @ v.astype(np.float64).T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 15):
        s = slice(k, k + (1 << 15))
        if most < 2**63:
            out[s] = np.einsum("ij,ij->i", a[i[s]], v[j[s]])
        else:
            out[s] = [max(-2**63, min(_LAST, sum(map(int.__mul__, x, y)))) for x, y in zip(a[i[s]].tolist(), v[j[s]].tolist())]
    return out


class Block:
    """Rows of the index as arrays."""

    def __init__(self, t: pa.Table):
        self.rid, self.vec_id, self.label, self.norm, self.align = (np.asarray(t.column(c)) for c in ("rid", "vec_id", "label", "norm", "align"))
        n = len(t)
        read = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(n, -1)
        self.code, self.v = read("code", np.uint64), read("v", np.int64)


def _slices(n_queries: int, n_rows: int):
    step = max(1, _PAIRS // max(n_rows, 1))
    return (slice(k, min(k + step, n_queries)) for k in range(0, n_queries, step))


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row (-inf if there are fewer)."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return -np.partition(-low, k - 1, axis=1)[:, k - 1]


def best_positives(a: Block, r: Block, k: int) -> list[tuple[int, int, int, int]]:
    """(anchor rid, row rid, vec_id, score) of each anchor's k best other rows of its label."""
    q, out = Queries(a.v), []
    for s in _slices(len(a.rid), len(r.rid)):
        low, high = q.intervals(s, r.code, r.norm, r.align)
        other = (a.label[s][:, None] == r.label) & (a.rid[s][:, None] != r.rid)
        need = _kth(np.where(other, low, -np.inf), k)
        i, j = np.nonzero(other & (high >= need[:, None]))
        score = integer_scores(a.v[s], r.v, i, j)
        cut = np.searchsorted(i, np.arange(len(need) + 1))
        for n, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            best = x + np.lexsort((r.vec_id[j[x:y]], ~score[x:y]))[:k]
            out += zip([int(a.rid[s][n])] * len(best), r.rid[j[best]].tolist(), r.vec_id[j[best]].tolist(), score[best].tolist())
    return out


def best_negatives(a: Block, score_of: np.ndarray, real: np.ndarray, r: Block, k: int, low_pct: int, high_pct: int) -> list[tuple[int, int, int, int]]:
    """(anchor rid, place of the positive, vec_id, score): for the scores of every anchor's
    positives (a column a place, ``real`` where there is one) the k best rows of another label
    in the window of the score."""
    q, out = Queries(a.v), []
    # whole-number windows: low_pct * p <= 100 * n <= high_pct * p
    least = [[-(-low_pct * p // 100) for p in row] for row in score_of.tolist()]
    most = [[high_pct * p // 100 for p in row] for row in score_of.tolist()]
    for s in _slices(len(a.rid), len(r.rid)):
        low, high = q.intervals(s, r.code, r.norm, r.align)
        other = a.label[s][:, None] != r.label
        keep = []
        for place in range(real.shape[1]):
            lo = np.array([x[place] for x in least[s]], np.float64)[:, None]
            hi = np.array([x[place] for x in most[s]], np.float64)[:, None]
            ok = other & (high >= lo - 1) & (low <= hi + 1) & real[s, place][:, None]
            sure = ok & (low >= lo + 1) & (high <= hi - 1)
            need = _kth(np.where(sure, low, -np.inf), k)
            keep.append(ok & (high >= need[:, None]))
        i, j = np.nonzero(np.logical_or.reduce(keep)) if keep else (np.zeros(0, np.int64),) * 2
        score = integer_scores(a.v[s], r.v, i, j)
        cut = np.searchsorted(i, np.arange(len(other) + 1)).tolist()
        for n, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
            if x == y:
                continue
            order = x + np.lexsort((r.vec_id[j[x:y]], ~score[x:y]))
            sorted_ = score[order]
            for place in np.flatnonzero(real[s.start + n]).tolist():
                ok = order[(sorted_ >= least[s.start + n][place]) & (sorted_ <= most[s.start + n][place])][:k]
                out += zip([int(a.rid[s.start + n])] * len(ok), [place] * len(ok), r.vec_id[j[ok]].tolist(), score[ok].tolist())
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)


def _index(rows: DataFrame) -> DataFrame:
    """Codes of the cleaned rows, written once; ``rid`` numbers them."""

    def run(batches):
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            flat, size = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            off = np.append(0, np.cumsum(size))
            norm, align = np.zeros(len(b)), np.zeros(len(b))
            code, raw = [b""] * len(b), [flat[x:y].tobytes() for x, y in zip(off[:-1], off[1:])]
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                c, norm[at], align[at] = encode(flat[off[at][:, None] + np.arange(dim)])
                for i, x in zip(at.tolist(), c):
                    code[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), b.column("label"), pa.array(size, pa.int32()), pa.array(norm), pa.array(align),
                                              pa.array(code, pa.binary()), pa.array(raw, pa.binary()), b.column("is_anchor")],
                                             names=[c.split()[0] for c in INDEX.split(", ")])

    return rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, INDEX)


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low_pct: int = 30, high_pct: int = 90,
                   scale: int = 256, row_block: int = 8192, anchor_block: int = 8192, vec_id: str = "vec_id",
                   vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its ``positives`` best other rows of its label, the
    ``negatives`` best rows of other labels with low_pct * p <= 100 * n <= high_pct * p.

    Components x become floor(scale * x); scores are whole inner products (cut to 64 bits), higher
    first, ties by smaller vec_id. ``is_anchor`` is a SQL condition on vec_id. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Rows with a null id, label or
    vector, an empty vector or a null or non-finite component take no part; rows equal in id,
    label and vector count once; vectors of different lengths are not compared; rows that repeat
    an id with another vector or label are rows of their own. Other columns are ignored; an
    empty table gives no rows.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), x.alias("x"), fine.alias("fine")) \
        .where("vec_id is not null and label is not null and x is not null and size(x) > 0 and fine") \
        .select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).distinct()
    index = materialize(_index(src.withColumn("is_anchor", F.expr(is_anchor))), "negatives-index")
    n, n_anchors = index.agg(F.count("*"), F.count_if("is_anchor")).first()
    row_blocks, anchor_blocks = max(1, -(-n // row_block)), max(1, -(-n_anchors // anchor_block))
    block = lambda k: F.pmod(F.xxhash64("rid"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    r = index.withColumn("rb", block(row_blocks)).withColumn("ab", every(anchor_blocks))
    a = index.where("is_anchor").toDF(*index.columns).withColumn("ab", block(anchor_blocks)).withColumn("rb", every(row_blocks))
    keys = ("dim", "rb", "ab")

    def meet(anchors: DataFrame, fn, schema: str) -> DataFrame:
        return r.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(fn, schema)

    def near(t: pa.Table, u: pa.Table) -> pa.Table:
        got = best_positives(Block(u), Block(t), positives) if len(t) and len(u) else []
        return _table(got, ["rid", "prid", "positive_id", "positive_score"])

    first = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id", "prid")
    found = meet(a, near, "rid long, prid long, positive_id long, positive_score long")
    best = materialize(found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives), "negatives-positives")
    wanted = best.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "positive_score"))).alias("p")) \
        .select("rid", F.transform("p", lambda z: z["positive_score"]).alias("p"))

    def hard(t: pa.Table, u: pa.Table) -> pa.Table:
        rows_ = []
        if len(t) and len(u):
            score = u.column("p").to_pylist()
            wide = np.array([[*p, *[0] * (positives - len(p))] for p in score], np.int64)
            real = np.arange(positives) < np.array([len(p) for p in score])[:, None]
            rows_ = best_negatives(Block(u), wide, real, Block(t), negatives, low_pct, high_pct)
        return _table(rows_, ["rid", "place", "negative_id", "negative_score"])

    got = meet(a.join(wanted, "rid"), hard, "rid long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), "negative_id")
    top = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = top.join(best.select("rid", (F.col("k") - 1).cast("long").alias("place"), "positive_id", "positive_score"), ["rid", "place"]) \
        .join(index.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Thin query: anchors are the vec_ids divisible by 100; every seventh label is moved on."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")


ORACLE_SQL = """
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as aid, b.vec_id as bid, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
      from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
p as (select aid, bid, score from s where same
      qualify row_number() over (partition by aid order by score desc, bid) <= 5),
n as (select p.aid as anchor_id, p.bid as positive_id, row_number() over (partition by p.aid, p.bid order by s.score desc, s.bid) as rank,
             s.bid as negative_id, p.score as positive_score, s.score as negative_score
      from p join s on s.aid = p.aid and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
