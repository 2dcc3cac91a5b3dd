"""Tree models on binned features, grown by histograms that tasks sum.

Features are cut at quantiles into at most 256 bins, so a row is a short byte string. A level of
all trees that grow together takes one job: every task assigns its rows to the open nodes and adds
up their statistics by node, feature and bin; the sums (the size of the model, not of the data)
give the splits. Histograms of one job are bounded by memory: more nodes take more jobs.

* Boosting: one tree a class and iteration on the gradients of the softmax loss; of two siblings
  the one with fewer rows is counted, the other one follows by subtraction.
* Forest: Poisson bootstraps by hash, class weights balanced within each bootstrap, trees without
  a depth limit. Rows of equal bins and label are one cell with its draws; a node whose cells a task can
  hold is finished by that task, a level of its subtree at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.operators.vectorsum import pieces, total
from rampart.session import discard, materialize

MAX_BINS = 256
#: bytes of histograms a task adds up in one job
HISTOGRAM_BYTES = 64 << 20
#: rows that boosting fits in one task
LOCAL_ROWS = 20_000
#: cells (over its bootstrap) that one task of a forest's last step grows subtrees from, about
SUBTREE_ROWS = 5_000
#: bytes of the cells of a node that one task finishes
SUBTREE_BYTES = 128 << 20
#: rows below which a forest's rows are not combined over tasks
SMALL_ROWS = 1_000
#: bytes of cells that meet in one task, about
CELL_BYTES = 8 << 20
#: bytes of trees a task is handed at once when a forest predicts
FOREST_BYTES = 64 << 20
#: bytes of a block of rows while boosting, about
BLOCK_BYTES = 1 << 20
#: rows of a file of blocks, at most
FILE_ROWS = 2_000_000


# ------------------------------------------------------------------ bins
def bin_edges(rows: DataFrame, n_features: int, bins: int = MAX_BINS, features: str = "features") -> list[np.ndarray]:
    """Ascending cut points of every feature: its distinct values' quantiles. A value belongs to
    the first bin whose edge is not smaller, the last bin has none."""
    q = [float(i) / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col(features)[i], q, 10_000).alias(f"q{i}") for i in range(n_features)]).first()
    return [np.unique(np.array([x for x in (got[i] or []) if x is not None and np.isfinite(x)], np.float64)) for i in range(n_features)]


def binned(rows: DataFrame, edges: list[np.ndarray], features: str = "features", keep: Iterable[str] = ("label_id",)) -> DataFrame:
    """The kept columns, ``rid`` and ``bins``, a byte a feature; written once. NaN and NULL values
    fall into the last bin."""
    keep, n = list(keep), len(edges)

    def run(batches):
        for b in batches:
            col = b.column(len(keep))
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            out = np.stack([np.searchsorted(e, np.where(np.isnan(x[:, i]), np.inf, x[:, i])).astype(np.uint8) for i, e in enumerate(edges)], axis=1) \
                if n else np.zeros((len(b), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], b.column(len(keep) + 1), pa.array([r.tobytes() for r in out], pa.binary())],
                                             names=[*keep, "rid", "bins"])

    types = dict(rows.dtypes)
    src = rows.select(*keep, F.transform(features, lambda v: v.cast("double")).alias("x"), F.monotonically_increasing_id().alias("rid"))
    src = src.select(*keep, "x", "rid")
    schema = ", ".join([*(f"{c} {types[c]}" for c in keep), "rid long", "bins binary"])
    return materialize(src.mapInArrow(run, schema), "binned-rows")


def _matrix(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n)


# ------------------------------------------------------------------ one tree
@dataclass
class Tree:
    """Nodes as arrays in the making; ``value`` is a number or a distribution a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    made: tuple | None = None
    open_leaves: tuple | None = None

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        kids = len(self.feature), len(self.feature) + 1
        self.left[node], self.right[node] = kids
        for _ in kids:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
        return kids

    def arrays(self):
        """The nodes as arrays, made anew when nodes have been added."""
        if self.made is None or len(self.made[0]) != len(self.feature):
            self.made = (np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.right))
        return self.made

    def node_of(self, x: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        return _walk(x, *self.arrays())

    def node_of_columns(self, x: np.ndarray) -> np.ndarray:
        """As ``node_of``, of bins [features, rows]. Every leaf has a bit: a feature's table has, for each bin,
        the leaves that its cuts leave open, and the tables of all features have one leaf in common."""
        if self.open_leaves is None or self.open_leaves[0] != len(self.feature):
            self.open_leaves = len(self.feature), *self._tables()
        _, tables, leaves = self.open_leaves
        if tables is None:
            return self.node_of(x.T)
        left = np.full(x.shape[1], 1, np.uint64) if not tables else None
        for f, t in tables.items():
            left = t.take(x[f]) if left is None else left & t.take(x[f])
        return leaves.take((left.astype(np.float64).view(np.int64) >> 52) - 1023)  # the exponent of a power of two

    def _tables(self) -> tuple[dict[int, np.ndarray] | None, np.ndarray]:
        tables: dict[int, np.ndarray] = {}
        leaves = [n for n, f in enumerate(self.feature) if f < 0]
        if len(leaves) > 64:
            return None, np.array(leaves)
        below = [0] * len(self.feature)  # the leaves below a node; children have larger numbers
        for i, n in enumerate(leaves):
            below[n] = 1 << i
        for n in reversed(range(len(below))):
            if (f := self.feature[n]) >= 0:
                low, high = below[self.left[n]], below[self.right[n]]
                below[n] = low | high
                t = tables.setdefault(f, np.full(MAX_BINS, (1 << len(leaves)) - 1, np.uint64))
                t[:self.cut[n] + 1] &= ~np.uint64(high)
                t[self.cut[n] + 1:] &= ~np.uint64(low)
        return tables, np.array(leaves)


def _walk(x: np.ndarray, f: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    live = np.flatnonzero(f[at] >= 0)
    while len(live):
        n = at[live]
        at[live] = np.where(x[live, f[n]] <= cut[n], left[n], right[n])
        live = live[f[at[live]] >= 0]
    return at


@dataclass
class Packed:
    """A grown tree of distributions as few bytes: nodes as arrays, and of the leaves' distributions
    (most leaves hold one class) each once. ``link`` is a node's left child, which the right one
    follows, or a leaf's distribution."""

    feature: np.ndarray
    cut: np.ndarray
    link: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, t: Tree) -> Packed:
        return cls.made(np.array(t.feature), np.array(t.cut), np.array(t.left), np.array(t.value, np.float64).reshape(len(t.feature), -1))

    @classmethod
    def made(cls, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray) -> Packed:
        leaf = feature < 0
        shares, kind = distinct_rows(np.where(leaf[:, None], value, 0.0))
        return cls(feature.astype(np.int16 if feature.max() < 1 << 15 else np.int32), cut.astype(np.uint8), np.where(leaf, kind, left).astype(np.int32), shares)

    @property
    def value(self) -> np.ndarray:
        return np.where((self.feature < 0)[:, None], self.shares[np.where(self.feature < 0, self.link, 0)], 0.0)

    def node_of(self, x: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        out = np.zeros(len(x), np.int64)
        if self.feature[0] < 0 or not len(x):
            return out
        flat, wide = np.ascontiguousarray(x).ravel(), x.shape[1]
        live = np.arange(len(x))
        at, f, row = out, np.full(len(x), self.feature[0], np.int64), live * wide
        while len(live):
            at = self.link.take(at) + (flat.take(row + f) > self.cut.take(at))
            f = self.feature.take(at)
            inner = f >= 0
            if not inner.all():
                out[live[~inner]] = at[~inner]
                live, at, f, row = live[inner], at[inner], f[inner], row[inner]
        return out

    def share_of(self, x: np.ndarray) -> np.ndarray:
        """The distribution of each row's leaf."""
        return self.shares.take(self.link.take(self.node_of(x)), axis=0)

    def grafted(self, subs: list[tuple[int, Packed]]) -> Packed:
        """The tree with each subtree in its node's place."""
        feature, cut, link = [self.feature.astype(np.int32)], [self.cut.copy()], [self.link.copy()]
        at, seen, shares = len(self.feature), len(self.shares), [self.shares]
        for node, sub in subs:
            moved = np.where(sub.feature < 0, sub.link + seen, sub.link + (at - 1))  # a subtree's node i > 0 becomes i + at - 1
            for whole, part in ((feature, sub.feature), (cut, sub.cut), (link, moved)):
                whole[0][node] = part[0]
                whole.append(part[1:])
            at += len(sub.feature) - 1
            seen += len(sub.shares)
            shares.append(sub.shares)
        feature, cut, link = (np.concatenate(c) for c in (feature, cut, link))
        every, kind = distinct_rows(np.concatenate(shares))
        leaf = feature < 0
        return Packed(feature.astype(np.int16 if feature.max() < 1 << 15 else np.int32), cut, np.where(leaf, kind[np.where(leaf, link, 0)], link).astype(np.int32), every)


# ------------------------------------------------------------------ histograms
def add_counts(h: np.ndarray, slot: np.ndarray, x: np.ndarray, stats: np.ndarray) -> bool:
    """Add rows' statistics to [statistics, slots * features * bins]; whether any row has a slot."""
    on = np.flatnonzero(slot >= 0)
    if not len(on):
        return False
    n = x.shape[1]
    first, last = int(slot[on].min()), int(slot[on].max()) + 1  # the slots these rows fill
    at = (((slot[on] - first) * n)[:, None] + np.arange(n)) * MAX_BINS + x[on]
    a, b = (i * n * MAX_BINS for i in (first, last))
    for k in range(len(h)):
        h[k, a:b] += np.bincount(at.ravel(), np.repeat(stats[on, k], n), b - a)
    return True


def histograms(rows: DataFrame, slots: int, n_features: int, n_stats: int, parts: int,
               stats_of: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> np.ndarray:
    """[slots, features, bins, statistics]: ``stats_of`` gives for a batch any number of (slot of
    each row or -1, bins of the rows, statistics of the rows)."""
    size = slots * n_features * MAX_BINS * n_stats

    def run(batches):
        h = np.zeros((n_stats, slots * n_features * MAX_BINS))
        seen = False
        for b in batches:
            for slot, x, stats in stats_of(b):
                seen |= add_counts(h, slot, x, stats)
        if seen:
            part = TaskContext.get().partitionId()
            got = pieces(h.T)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(got), pa.int64()), pa.array([i for i, _ in got], pa.int64()), pa.array([v for _, v in got], pa.binary())],
                                             names=["part", "piece", "v"])

    return total(rows.mapInArrow(run, "part long, piece long, v binary"), size, parts).reshape(slots, n_features, MAX_BINS, n_stats)


# ------------------------------------------------------------------ boosting
@dataclass
class BoostParams:
    """The reference learner's settings (fixed values): rounds, shrinkage, leaves and rows of a
    leaf; early stopping on a tenth of the rows when there are more than 10,000."""

    iterations: int = 100
    learning_rate: float = 0.1
    max_leaves: int = 31
    max_depth: int = 5  # level by level: at most 2^5 leaves, of which max_leaves are opened
    min_rows: int = 20
    l2: float = 0.0
    min_hessian: float = 1e-3
    patience: int = 10
    tolerance: float = 1e-7
    stop_above: int = 10_000


def best_splits(h: np.ndarray, p: BoostParams) -> list[tuple[float, int, int] | None]:
    """For every slot of [slots, features, bins, (g, h, rows)]: (gain, feature, bin) of the best
    split, ties to the first feature, then the lowest bin."""
    left = np.cumsum(h, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + p.l2 + 1e-15)
    gain = score(left) + score(right) - score(whole)
    ok = (left[..., 2] >= p.min_rows) & (right[..., 2] >= p.min_rows) & (left[..., 1] >= p.min_hessian) & (right[..., 1] >= p.min_hessian)
    gain = np.where(ok, gain, -np.inf).reshape(len(h), -1)
    top = gain.max(axis=1, keepdims=True)  # sums of another order differ in their last digits: such gains tie
    at = (gain >= np.where(top > 0, top * (1 - 1e-10), top)).argmax(axis=1)
    return [(float(gain[i, a]), int(a) // MAX_BINS, int(a) % MAX_BINS) if gain[i, a] > 1e-12 else None for i, a in enumerate(at.tolist())]


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Boosted:
    base: np.ndarray  # class log shares
    rounds: list[list[Tree]] = field(default_factory=list)

    def raw(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Scores that the rounds from ``first`` add to the base."""
        return _add_rounds(np.zeros((len(self.base), len(x))), np.ascontiguousarray(x.T), self.rounds[first:]).T


def _add_rounds(score: np.ndarray, x: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """Scores [classes, rows] after more rounds, of bins [features, rows]."""
    score = score.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            score[k] += np.array(t.value)[t.node_of_columns(x)]
    return score


def fit_boosted(rows: DataFrame, n_features: int, n_classes: int, params: BoostParams = BoostParams(), refresh: int = 10) -> Boosted:
    """Softmax boosting over ``binned`` rows with label_id; one job a level of all classes' trees, of which
    a round's first also measures the held-out loss. A table of at most LOCAL_ROWS rows is not worth
    hundreds of jobs: one task runs all rounds.

    The rows lie in blocks with their scores, which a round's trees move on and Spark keeps for its jobs (in
    memory or on disk); every ``refresh`` rounds they are written, so that a lost executor's blocks follow from
    few trees. Rows whose label is NULL or outside the classes take no part; no rows give the base model alone.
    """
    known = rows.where((F.col("label_id") >= 0) & (F.col("label_id") < n_classes))
    counts = {r["label_id"]: r["n"] for r in known.groupBy("label_id").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    share = np.array([counts.get(k, 0) for k in range(n_classes)], np.float64)
    model = Boosted(np.log(np.maximum(share, 1e-9) / max(n, 1)))
    if not n:
        return model
    stop = n > params.stop_above
    known = known.withColumn("held", (F.pmod(F.xxhash64("rid"), F.lit(10)) == 0) & F.lit(stop))
    if n <= LOCAL_ROWS:
        return _fit_small(known, model, n_features, n_classes, params)
    cores = known.sparkSession.sparkContext.defaultParallelism
    parts = min(cores * -(-n // (cores * FILE_ROWS)), -(-n // 20_000))  # as many tasks as cores, or as many for each; few for a small table
    scored = materialize(_blocks(known, model.base, n_features).repartition(parts), "boost-scores")
    kept = _kept(scored, n_features)
    done, losses, before = 0, [], None
    for it in range(params.iterations):
        if it - done >= refresh:
            fresh = materialize(_with_scores(scored, model.rounds[done:], n_features), "boost-scores")
            discard(scored)
            scored, done = fresh, it
            before, kept = kept, _kept(scored, n_features)
        elif it:
            before, kept = kept, _moved_on(kept, model.rounds[-1])
        judged = len(losses)

        def counted(trees, slot_of, slots, blocks=kept, judged=judged):
            judge = stop and len(losses) == judged  # the round's first job
            h, loss = _block_histograms(blocks, trees, slot_of, slots, n_features, parts, judge)
            if judge:
                losses.append(loss)
                if _stopped(losses, params):
                    return None
            return h

        trees = _grow_round(counted, n_features, n_classes, params)
        if before is not None:
            before.unpersist()
        if all(len(t.feature) == 1 for t in trees):
            break
        model.rounds.append(trees)
    kept.unpersist()
    discard(scored)
    return model


def _blocks(rows: DataFrame, base: np.ndarray, n_features: int) -> DataFrame:
    """The rows in blocks, held-out ones last: how many there are and how many train, their bins [features,
    rows], labels and scores [classes, rows]. Passes read whole arrays, not a row at a time."""
    size = max(1, BLOCK_BYTES // (n_features + 8 * len(base) + 4))

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), size):
                y, held, bins = b.slice(lo, size).columns
                held = held.to_numpy(zero_copy_only=False).astype(bool)
                order = np.argsort(held, kind="stable")
                x = np.ascontiguousarray(_matrix(bins, n_features)[order].T)
                yield _block(len(held), len(held) - int(held.sum()), x.tobytes(), np.asarray(y)[order].astype("<i4").tobytes(),
                             np.repeat(base, len(held)).astype("<f8").tobytes())

    return rows.select("label_id", "held", "bins").mapInArrow(run, "n long, train long, bins binary, label binary, score binary")


def _block(n: int, train: int, bins, label, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([train], pa.int64()), *(pa.array([v], pa.binary()) for v in (bins, label, score))],
                                      names=["n", "train", "bins", "label", "score"])


def _arrays(n: int, train: int, bins, label, score, n_features: int):
    """(train, bins [features, rows], labels, scores [classes, rows]) of a block."""
    return train, np.frombuffer(bins, np.uint8).reshape(n_features, n), np.frombuffer(label, "<i4"), np.frombuffer(score, "<f8").reshape(-1, n)


def _kept(blocks: DataFrame, n_features: int) -> RDD:
    return blocks.rdd.map(lambda r: _arrays(*r, n_features)).persist(StorageLevel.MEMORY_AND_DISK)


def _moved_on(kept: RDD, trees: list[Tree]) -> RDD:
    """The blocks with their scores after one more round."""
    return kept.map(lambda b: (*b[:3], _add_rounds(b[3], b[1], [trees]))).persist(StorageLevel.MEMORY_AND_DISK)


def _with_scores(blocks: DataFrame, rounds: list[list[Tree]], n_features: int) -> DataFrame:
    """The blocks with their scores after these rounds."""
    def run(batches):
        for b in batches:
            for n, train, *raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *b.columns[2:]):
                bins, label, score = (v.as_buffer() for v in raw)
                _, x, _, s = _arrays(n, train, bins, label, score, n_features)
                yield _block(n, train, bins.to_pybytes(), label.to_pybytes(), _add_rounds(s, x, rounds).tobytes())

    return blocks.mapInArrow(run, blocks.schema)


def _block_histograms(blocks: RDD, trees: list[Tree], slot_of: list[np.ndarray], slots: int, n_features: int, parts: int,
                      judge: bool) -> tuple[np.ndarray, float]:
    """Histograms [slots, features, bins, (g, h, rows)] of the training rows in the nodes that have a slot (a
    class's slots follow each other); and the mean loss of the held-out rows, if asked."""
    span = {k: (int(on.min()), int(on.max()) + 1) for k, slot in enumerate(slot_of) if len(on := slot[slot >= 0])}

    def run(part, blocks):
        h, loss = np.zeros((3, n_features, slots * MAX_BINS)), np.zeros(2)
        seen = False
        for train, x, y, s in blocks:
            seen = True
            if not judge:
                x, y, s = np.ascontiguousarray(x[:, :train]), y[:train], s[:, :train]
            prob = softmax(s.T)
            if judge:
                loss += -np.log(np.maximum(prob[np.arange(train, len(y)), y[train:]], 1e-300)).sum(), len(y) - train
                x, y, prob = np.ascontiguousarray(x[:, :train]), y[:train], prob[:train]
            for k, (first, last) in span.items():
                slot = slot_of[k].take(trees[k].node_of_columns(x))
                on = np.flatnonzero(slot >= 0) if len(slot_of[k]) > 1 else slice(None)
                p = prob[:, k][on]
                g, w = p - (y[on] == k), p * (1 - p)
                at, a, b = (slot[on] - first) * MAX_BINS, first * MAX_BINS, last * MAX_BINS
                for f in range(n_features):
                    cell = at + x[f, on]
                    h[0, f, a:b] += np.bincount(cell, g, b - a)
                    h[1, f, a:b] += np.bincount(cell, w, b - a)
                    h[2, f, a:b] += np.bincount(cell, minlength=b - a)
        if seen:
            whole = np.concatenate([h.reshape(3, n_features, slots, MAX_BINS).transpose(2, 1, 3, 0).ravel(), loss])
            yield from ((part, i, bytearray(v)) for i, v in pieces(whole))

    size = slots * n_features * MAX_BINS * 3
    v = total(blocks.mapPartitionsWithIndex(run), size + 2, parts)
    return v[:size].reshape(slots, n_features, MAX_BINS, 3), float(v[size] / max(v[size + 1], 1))


def _stopped(losses: list[float], p: BoostParams) -> bool:
    """Whether none of the last ``patience`` losses is below the one before them."""
    return len(losses) > p.patience and min(losses[-p.patience:]) > losses[-p.patience - 1] - p.tolerance


def _fit_small(rows: DataFrame, model: Boosted, n_features: int, n_classes: int, p: BoostParams) -> Boosted:
    """All rounds in one task, with the rows as arrays."""
    import pickle

    def run(batches):
        x, y, held = np.zeros((0, n_features), np.uint8), np.zeros(0, np.int64), np.zeros(0, bool)
        parts = [(_matrix(b.column(2), n_features), np.asarray(b.column(0)).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(bool)) for b in batches]
        if parts:
            x, y, held = (np.concatenate(c) for c in zip(*parts))
        raw, losses, rounds = np.tile(model.base, (len(y), 1)), [], []
        on = np.flatnonzero(~held)
        xt, yt = x[on], y[on]
        for _ in range(p.iterations):
            prob = softmax(raw)
            if held.any():
                losses.append(-float(np.log(np.maximum(prob[held, y[held]], 1e-300)).mean()))
                if _stopped(losses, p):
                    break
            prob = prob[on]

            def counted(trees, slot_of, slots, prob=prob):
                h = np.zeros((3, slots * n_features * MAX_BINS))
                for k, t in enumerate(trees):
                    if (slot_of[k] >= 0).any():
                        g = prob[:, k] - (yt == k)
                        add_counts(h, slot_of[k][t.node_of(xt)], xt, np.stack([g, prob[:, k] * (1 - prob[:, k]), np.ones(len(yt))], axis=1))
                return h.T.reshape(slots, n_features, MAX_BINS, 3)

            trees = _grow_round(counted, n_features, n_classes, p)
            if all(len(t.feature) == 1 for t in trees):
                break
            rounds.append(trees)
            for k, t in enumerate(trees):
                raw[:, k] += np.array(t.value)[t.node_of(x)]
        yield pa.RecordBatch.from_pydict({"rounds": pa.array([pickle.dumps(rounds)], pa.binary())})

    got = rows.select("label_id", "held", "bins").coalesce(1).mapInArrow(run, "rounds binary").first()
    return Boosted(model.base, pickle.loads(bytes(got["rounds"])))


def _grow_round(counted: Callable[[list[Tree], list[np.ndarray], int], np.ndarray], n_features: int, n_classes: int, p: BoostParams) -> list[Tree]:
    """One tree a class. ``counted`` gives the histograms [slots, features, bins, (g, h, rows)] of the
    nodes that have a slot, or None when no more trees are wanted."""
    trees = [Tree() for _ in range(n_classes)]
    sums: dict[tuple[int, int], np.ndarray] = {}  # (class, node) -> histogram of an open node
    count = {(k, 0): None for k in range(n_classes)}  # nodes to count, with the sibling that follows
    leaves = [1] * n_classes
    room = max(1, HISTOGRAM_BYTES // (n_features * MAX_BINS * 3 * 8))
    for _ in range(p.max_depth):
        todo = sorted(count)
        for lo in range(0, len(todo), room):
            some = todo[lo:lo + room]
            slot_of = [np.full(len(t.feature), -1, np.int64) for t in trees]
            for i, (k, node) in enumerate(some):
                slot_of[k][node] = i

            got = counted(trees, slot_of, len(some))
            if got is None:
                return []
            for i, key in enumerate(some):
                sums[key] = got[i]
        for (k, node), sibling in count.items():
            if sibling is not None:  # the larger child: its parent less the counted one
                parent, other = sibling
                sums[k, other] = sums[k, parent] - sums[k, node]
        for k, parent in {(k, s[0]) for (k, _), s in count.items() if s is not None}:
            del sums[k, parent]
        open_ = sorted(sums)
        found = best_splits(np.stack([sums[key] for key in open_]), p)
        order = sorted((i for i, s in enumerate(found) if s), key=lambda i: (-found[i][0], open_[i]))
        count, kept = {}, {}
        for i in order:
            k, node = open_[i]
            if leaves[k] == p.max_leaves:
                continue
            _, f, cut = found[i]
            leaves[k] += 1
            h = sums[k, node]
            left, right = trees[k].split(node, f, cut)
            low = h[f, :cut + 1].sum(axis=0)
            all_ = h[f].sum(axis=0)
            for kid, s in ((left, low), (right, all_ - low)):
                trees[k].value[kid] = -p.learning_rate * s[0] / (s[1] + p.l2 + 1e-15)
            small, large = (left, right) if low[2] <= all_[2] - low[2] else (right, left)
            count[k, small] = (node, large)
            kept[k, node] = h
        sums = kept
        if not count:
            break
    return trees


def predict_boosted(rows: DataFrame, model: Boosted, edges: list[np.ndarray], features: str = "features") -> DataFrame:
    """All columns of ``rows`` with ``prediction``, the class of the largest score (ties: the first)."""
    return _predict(rows, edges, features, lambda x: (model.base + model.raw(x)).argmax(axis=1))


def _predict(rows: DataFrame, edges: list[np.ndarray], features: str, classify) -> DataFrame:
    names, n = rows.columns, len(edges)

    def run(batches):
        for b in batches:
            x = b.column(names.index(features)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            bins = np.stack([np.searchsorted(e, np.where(np.isnan(x[:, i]), np.inf, x[:, i])).astype(np.uint8) for i, e in enumerate(edges)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(classify(bins).astype(np.int32))], names=[*names, "prediction"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), "prediction int"]))


# ------------------------------------------------------------------ forest
@dataclass
class ForestParams:
    """The reference forest (fixed values): trees, features tried at a node (the root of their
    number), a node of one class is a leaf."""

    trees: int = 100
    seed: int = 42
    balanced: bool = True


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) if k else np.exp(-1.0) for k in range(12)])


def bootstrap_counts(rid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row occurs in a tree's bootstrap: Poisson(1) by hash."""
    x = rid.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) / 2.0**53)


def feature_order(seed: int, tree: int, path: str, n: int) -> np.ndarray:
    """The order in which a node looks at features, from its path of left and right turns."""
    d = hashlib.blake2b(f"{seed}:{tree}:{path}".encode(), digest_size=8).digest()
    return np.random.default_rng(int.from_bytes(d, "little")).permutation(n)


def feature_orders(seed: int, tree: int, paths: list[bytes], n: int) -> np.ndarray:
    """``feature_order`` of many nodes, a row each: numpy's generator for all of them at once."""
    head = f"{seed}:{tree}:".encode()
    raw = np.frombuffer(b"".join([hashlib.blake2b(head + p, digest_size=8).digest() for p in paths]), "<u8")
    out = np.tile(np.arange(n), (len(raw), 1))
    (hi, lo), inc = _seeded(raw)
    rest, has = np.zeros(len(raw), np.uint64), np.zeros(len(raw), bool)  # the upper half of a word serves the next draw
    for i in range(n - 1, 0, -1):
        mask, live, j = np.uint64((1 << i.bit_length()) - 1), np.arange(len(raw)), np.zeros(len(raw), np.int64)
        while len(live):  # drawn again until it is at most i
            fresh = live[~has[live]]
            hi[fresh], lo[fresh] = _step(hi[fresh], lo[fresh], inc[0][fresh], inc[1][fresh])
            x, turn = hi[fresh] ^ lo[fresh], hi[fresh] >> np.uint64(58)
            x = (x >> turn) | (x << ((np.uint64(64) - turn) & np.uint64(63)))
            draw = rest[live]
            draw[~has[live]] = x & _LOW
            has[live] = ~has[live]
            rest[fresh] = x >> np.uint64(32)
            draw &= mask
            j[live] = draw
            live = live[draw > i]
        at = np.arange(len(raw))
        out[at, j], out[at, i] = out[at, i], out[at, j]
    return out


_LOW = np.uint64(0xFFFFFFFF)
_PCG = (np.uint64(0x2360ED051FC65DA4), np.uint64(0x4385DF649FCCF645))


def _step(hi: np.ndarray, lo: np.ndarray, inc_hi: np.ndarray, inc_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A step of the 128-bit congruential generator (PCG64) whose state is two words."""
    half = np.uint64(32)
    a, b, c, d = lo >> half, lo & _LOW, _PCG[1] >> half, _PCG[1] & _LOW
    low, mid = b * d, a * d
    mid2 = (low >> half) + (mid & _LOW) + b * c
    high = a * c + (mid >> half) + (mid2 >> half) + hi * _PCG[1] + lo * _PCG[0]
    low = lo * _PCG[1] + inc_lo
    return high + inc_hi + (low < inc_lo), low


def _seeded(raw: np.ndarray):
    """(state, increment) of ``np.random.PCG64`` seeded with each number, each as two words."""
    n32, shift = np.uint32, np.uint32(16)
    const = 0x43B0D7E5

    def mixed(v):
        nonlocal const
        v = v ^ n32(const)
        const = const * 0x931E8875 & 0xFFFFFFFF
        v = v * n32(const)
        return v ^ (v >> shift)

    zero = np.zeros(len(raw), n32)
    pool = [mixed(v) for v in ((raw & _LOW).astype(n32), (raw >> np.uint64(32)).astype(n32), zero, zero)]
    for src in range(4):
        for dst in range(4):
            if src != dst:
                v = pool[dst] * n32(0xCA01F9DD) - mixed(pool[src]) * n32(0x4973F715)
                pool[dst] = v ^ (v >> shift)
    words, const = [], 0x8B51F9DD
    for i in range(8):
        v = pool[i % 4] ^ n32(const)
        const = const * 0x58F38DED & 0xFFFFFFFF
        v = v * n32(const)
        words.append((v ^ (v >> shift)).astype(np.uint64))
    hi, lo, inc_hi, inc_lo = (words[i] | (words[i + 1] << np.uint64(32)) for i in (0, 2, 4, 6))
    inc = (inc_hi << np.uint64(1)) | (inc_lo >> np.uint64(63)), (inc_lo << np.uint64(1)) | np.uint64(1)
    low = lo + inc[1]
    return _step(hi + inc[0] + (low < lo), low, *inc), inc


def gini_split(h: np.ndarray, order: np.ndarray, tried: int) -> tuple[int, int] | None:
    """(feature, bin) of the largest weighted purity from [features, bins, classes + rows]: the
    first ``tried`` features of the order that can split at all; ties to the first of them, then
    to the lowest bin."""
    best, seen = None, 0
    for f in order.tolist():
        left = np.cumsum(h[f], axis=0)
        right = left[-1] - left
        ok = (left[:, -1] > 0) & (right[:, -1] > 0)
        if not ok.any():
            continue
        a, b = left[ok, :-1], right[ok, :-1]
        score = (a**2).sum(axis=1) / a.sum(axis=1) + (b**2).sum(axis=1) / b.sum(axis=1)
        i = int(np.argmax(score >= score.max() * (1 - 1e-10)))
        if best is None or score[i] > best[0] * (1 + 1e-10):
            best = (float(score[i]), f, int(np.flatnonzero(ok)[i]))
        seen += 1
        if seen == tried:
            break
    return best and best[1:]


def best_cuts(x, draws, rows, node, total_, weight, order, tried: int) -> tuple[np.ndarray, np.ndarray]:
    """``gini_split`` of many nodes at once, from the cells themselves: (feature or -1, bin) of each. ``rows``
    are the nodes' cells, ``node`` whose they are, ``total_`` the nodes' draws by class."""
    n = len(total_)
    score, feature, cut, seen = np.full(n, -np.inf), np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n, np.int64)
    for j in range(x.shape[1]):
        want = seen < tried
        if not want.any():
            break
        r, k = rows, node
        if not want.all():
            on = want[node]
            r, k = rows[on], node[on]
        both = np.sort((((k << 8) | x[r, order[k, j]]) << 32) | r)  # by node, then bin
        key = both >> 32
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = key[head]
        sums = np.add.reduceat(draws[both & 0xFFFFFFFF], head, axis=0)
        k = key >> 8
        lead = np.append(True, k[1:] != k[:-1])
        can = np.flatnonzero(~np.append(lead[1:], True))  # all but a node's last bin
        if not len(can):
            continue
        left = np.cumsum(sums, axis=0)
        left = (left - (left - sums)[np.flatnonzero(lead)][np.cumsum(lead) - 1])[can]
        k = k[can]
        right = (total_[k] - left) * weight
        left *= weight
        got = (left**2).sum(axis=1) / left.sum(axis=1) + (right**2).sum(axis=1) / right.sum(axis=1)
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        top = np.maximum.reduceat(got, first)
        near = np.flatnonzero(got >= np.repeat(top * (1 - 1e-10), np.diff(np.append(first, len(k)))))
        near = near[np.append(True, k[near[1:]] != k[near[:-1]])]  # a node's lowest bin
        nodes = k[near]
        seen[nodes] += 1
        better = got[near] > score[nodes] * (1 + 1e-10)
        near, nodes = near[better], nodes[better]
        score[nodes], feature[nodes], cut[nodes] = got[near], order[nodes, j], key[can[near]] & 0xFF
    return feature, cut


def grow_cells(x: np.ndarray, draws: np.ndarray, weight: np.ndarray, path: str, seed: int, number: int) -> Packed:
    """The whole subtree of a node from its cells: distinct rows of bins and their draws by class. All
    nodes of a level are split at once, so a node costs no step of its own."""
    tried = max(1, int(np.sqrt(x.shape[1])))
    rows, size, paths = np.arange(len(x)), np.array([len(x)]), [path.encode()]
    levels, made = [], 1
    while len(size):
        sums = np.add.reduceat(draws[rows], np.cumsum(size) - size, axis=0)
        share = sums * weight
        value = share / share.sum(axis=1, keepdims=True)
        feature, cut, left = np.full(len(size), -1, np.int32), np.zeros(len(size), np.uint8), np.full(len(size), -1, np.int32)
        levels.append((feature, cut, left, value))
        mixed = (np.count_nonzero(share, axis=1) > 1) & (size > 1)
        open_ = np.flatnonzero(mixed)
        if not len(open_):
            break
        rows = rows[np.repeat(mixed, size)]
        node = np.repeat(np.arange(len(open_)), size[open_])
        order = feature_orders(seed, number, [paths[i] for i in open_.tolist()], x.shape[1])
        f, c = best_cuts(x, draws, rows, node, sums[open_], weight, order, tried)
        cuts = np.flatnonzero(f >= 0)
        at = open_[cuts]
        feature[at], cut[at], left[at] = f[cuts], c[cuts], made + 2 * np.arange(len(cuts))
        made += 2 * len(cuts)
        if len(cuts) < len(f):
            rows, node = rows[f[node] >= 0], (np.cumsum(f >= 0) - 1)[node[f[node] >= 0]]
            f, c = f[cuts], c[cuts]
        kid = 2 * node + (x[rows, f[node]] > c[node])
        rows = np.sort((kid << 32) | rows) & 0xFFFFFFFF
        size = np.bincount(kid, minlength=2 * len(cuts))
        paths = [paths[i] + turn for i in at.tolist() for turn in (b"L", b"R")]
    return Packed.made(*(np.concatenate(c) for c in zip(*levels)))


def distinct_rows(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of doubles and which of them each row is."""
    words = np.ascontiguousarray(value + 0.0).view("<u8").reshape(len(value), -1)
    _, first, kind = np.unique(_row_hash(words), return_index=True, return_inverse=True)
    if not (words[first][kind] == words).all():
        _, first, kind = np.unique(words, axis=0, return_index=True, return_inverse=True)
    return value[first], kind.reshape(-1).astype(np.int32)


def _row_hash(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def same_cells(x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, where in it other bins (or another label) begin, and the rows' hashes. Equal
    rows whose hashes meet another row's may begin twice; different rows are never joined."""
    n, wide = x.shape
    words = np.zeros((n, -(-(wide + 4) // 8) * 8), np.uint8)
    words[:, 4:4 + wide] = x
    if y is not None:
        words[:, :4] = y.astype("<i4").reshape(n, 1).view(np.uint8)
    words = words.view("<u8")
    h = _row_hash(words)
    order = np.argsort(h)
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(new), h


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    top = int(counts.max()) if counts.size else 0
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<i8")


def _widened(raw: bytes, n: int) -> np.ndarray:
    """``n`` counts as ``_narrow`` made them."""
    return np.frombuffer(raw, {1: "<u1", 2: "<u2", 8: "<i8"}[len(raw) // n])


def _batch(found: list[tuple], names: str) -> pa.RecordBatch:
    """Rows of a schema of long, int and binary columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    cols = list(zip(*found)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], names=[f for f, _ in fields])


CELLS = "n long, bins binary, label binary, draws binary"


def forest_cells(known: DataFrame, n_rows: int, n_features: int, params: ForestParams) -> DataFrame:
    """Blocks of cells, written. Rows of equal bins and label go the same way in every tree: they are one cell
    with its draws, how often each bootstrap holds it. A block has n cells: bins [n, features],
    labels and draws [trees, n].

    Tasks combine the rows they scan; pieces meet by the hash of their content, a common cell once a
    piece. A table of few rows is not worth the exchange."""
    trees, seed = range(params.trees), params.seed
    wide = n_features + 4 + params.trees
    buckets = max(1, -(-n_rows * wide // CELL_BYTES))
    some = max(1, 4 * CELL_BYTES // (wide + 8 * params.trees))

    def packed(x, y, draws):
        return len(y), x.tobytes(), y.astype("<i4").tobytes(), _narrow(draws).tobytes()

    def pieces_of(held):
        x = np.concatenate([_matrix(b.column(2), n_features) for b in held])
        rid, y = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in (0, 1))
        order, first, h = same_cells(x, y)
        draws = np.stack([np.add.reduceat(bootstrap_counts(rid, t, seed)[order], first) for t in trees])
        keep = order[first]
        x, y, to = x[keep], y[keep], ((h[keep] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        place = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.append(True, to[place][1:] != to[place][:-1])).tolist()
        for lo, hi in zip(cut, [*cut[1:], len(place)]):
            at = place[lo:hi]
            yield int(to[at[0]]), *packed(x[at], y[at], draws[:, at])

    def scan(batches):
        held = []
        for b in batches:
            for lo in range(0, len(b), some):
                held.append(b.slice(lo, some))
                if sum(map(len, held)) >= some:
                    yield _batch([*pieces_of(held)], f"bucket long, {CELLS}")
                    held = []
        if held:
            yield _batch([*pieces_of(held)], f"bucket long, {CELLS}")

    def merge(t: pa.Table) -> pa.Table:
        parts = [_cell_arrays(*r, n_features, params.trees) for r in zip(*(t.column(c).to_pylist() for c in ("n", "bins", "label", "draws")))]
        x, y = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order, first, _ = same_cells(x, y)
        draws = np.stack([np.add.reduceat(np.concatenate([p[2][i] for p in parts])[order], first, dtype=np.int64) for i in trees])
        return pa.Table.from_batches([_batch([packed(x[order[first]], y[order[first]], draws)], CELLS)])

    got = known.select("rid", "label_id", "bins").mapInArrow(scan, f"bucket long, {CELLS}")
    if n_rows < SMALL_ROWS:
        return materialize(got.drop("bucket"), "forest-cells")
    return materialize(got.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, CELLS), "forest-cells")


def _cell_arrays(n: int, bins: bytes, label: bytes, draws: bytes, n_features: int, trees: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins [n, features], labels, draws [trees, n]) of a block."""
    return np.frombuffer(bins, np.uint8).reshape(n, n_features), np.frombuffer(label, "<i4"), _widened(draws, n * trees).reshape(trees, n)


def fit_forest(rows: DataFrame, n_features: int, n_classes: int, params: ForestParams = ForestParams(), local_rows: int | None = None) -> DataFrame:
    """(tree, bytes, nodes): the pickled trees of a forest over ``binned`` rows with label_id, written.

    Trees grow from cells (``forest_cells``). Nodes of more than ``local_rows`` cells (as many as a task
    can hold, unless given) are split by histograms, all trees' together; then the cells of each
    remaining node meet in one task, which finishes its subtree. Rows whose label is NULL or outside
    the classes take no part.
    """
    import pickle

    local_rows = max(1, SUBTREE_BYTES // (n_features + 16 * n_classes + 100)) if local_rows is None else local_rows
    known = rows.where((F.col("label_id") >= 0) & (F.col("label_id") < n_classes))
    seed, numbers = params.seed, list(range(params.trees))
    cells = forest_cells(known, known.count(), n_features, params)
    parts = max(1, cells.rdd.getNumPartitions())

    def blocks(batches):
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                yield _cell_arrays(*r, n_features, params.trees)

    def counts(batches):
        out = np.zeros((params.trees, n_classes, 2))
        for _, y, draws in blocks(batches):
            for t in numbers:
                out[t, :, 0] += np.bincount(y, draws[t], n_classes)
                out[t, :, 1] += np.bincount(y, draws[t] > 0, n_classes)
        part = TaskContext.get().partitionId()
        yield _batch([(part, i, v) for i, v in pieces(out)], "part long, piece long, v binary")

    drawn = total(cells.mapInArrow(counts, "part long, piece long, v binary"), params.trees * n_classes * 2, parts).reshape(params.trees, n_classes, 2)
    present = (drawn[:, :, 0] > 0).sum(axis=1, keepdims=True)
    weight = np.where(drawn[:, :, 0] > 0, drawn[:, :, 0].sum(axis=1, keepdims=True) / (np.maximum(present, 1) * np.maximum(drawn[:, :, 0], 1)), 0.0)
    if not params.balanced:
        weight = np.ones_like(weight)
    tried = max(1, int(np.sqrt(n_features)))
    tops = [Tree() for _ in numbers]
    for t in numbers:
        share = drawn[t, :, 0] * weight[t]
        tops[t].value[0] = share / share.sum() if share.sum() else np.full(n_classes, 1.0 / n_classes)
    # (tree, node) -> path; nodes of many cells of several classes
    big = {(t, 0): "" for t in numbers if drawn[t, :, 1].sum() > local_rows and np.count_nonzero(drawn[t, :, 1]) > 1}
    small = {(t, 0): "" for t in numbers if (t, 0) not in big and np.count_nonzero(drawn[t, :, 1]) > 1}
    room = max(1, HISTOGRAM_BYTES // (n_features * MAX_BINS * (n_classes + 1) * 8))
    while big:
        todo, big = sorted(big.items()), {}
        found = []
        for lo in range(0, len(todo), room):
            some = todo[lo:lo + room]
            slot_of = {t: np.full(len(tops[t].feature), -1, np.int64) for (t, _), _ in some}
            for i, ((t, node), _) in enumerate(some):
                slot_of[t][node] = i

            def stats(b, slot_of=slot_of):
                for x, y, draws in blocks([b]):
                    one = np.eye(n_classes)[y]
                    for t, slots in slot_of.items():
                        k = draws[t]
                        slot = np.where(k > 0, slots[tops[t].node_of(x)], -1)
                        yield slot, x, np.concatenate([one * (k * weight[t][y])[:, None], np.ones((len(y), 1))], axis=1)

            h = histograms(cells, len(some), n_features, n_classes + 1, parts, stats)
            found += [(key, path, h[i], gini_split(h[i], feature_order(seed, key[0], path, n_features), tried)) for i, (key, path) in enumerate(some)]
        for (t, node), path, h, got in found:
            if got is None:
                continue
            left = h[got[0], :got[1] + 1].sum(axis=0)
            right = h[got[0]].sum(axis=0) - left
            for kid, turn, s in zip(tops[t].split(node, *got), "LR", (left, right)):
                share = s[:-1]
                tops[t].value[kid] = share / share.sum()
                if np.count_nonzero(share > 1e-9 * share.sum()) > 1:
                    (big if s[-1] > local_rows else small)[t, kid] = path + turn

    dealt_as = "tree int, node long, n long, bins binary, label binary, draws binary"

    def deal(batches):
        """Every cell once a bootstrap that holds it, with the node where its subtree starts."""
        mine: dict[int, list[int]] = {}
        for t, node in small:
            mine.setdefault(t, []).append(node)
        for x, y, draws in blocks(batches):
            for t, nodes in mine.items():
                at = tops[t].node_of(x)
                on = np.flatnonzero((draws[t] > 0) & np.isin(at, nodes))
                on = on[np.argsort(at[on], kind="stable")]
                at = at[on]
                cut = np.flatnonzero(np.append(len(at) > 0, at[1:] != at[:-1])).tolist()
                found = [(t, int(at[lo]), hi - lo, x[on[lo:hi]].tobytes(), y[on[lo:hi]].tobytes(), _narrow(draws[t][on[lo:hi]]).tobytes())
                         for lo, hi in zip(cut, [*cut[1:], len(at)])]
                if found:
                    yield _batch(found, dealt_as)

    def finish(t: pa.Table) -> pa.Table:
        number, node = t.column("tree")[0].as_py(), t.column("node")[0].as_py()
        x = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, n_features)
        y = np.frombuffer(b"".join(t.column("label").to_pylist()), "<i4")
        k = np.concatenate([_widened(raw, n) for raw, n in zip(t.column("draws").to_pylist(), t.column("n").to_pylist())])
        order, first, _ = same_cells(x)
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        draws = np.bincount(of * n_classes + y, k, len(first) * n_classes).reshape(-1, n_classes)
        sub = grow_cells(x[order[first]], draws, weight[number], small[number, node], seed, number)
        return pa.Table.from_batches([_batch([(number, node, pickle.dumps(sub))], "tree int, node long, sub binary")])

    def join(t: pa.Table) -> pa.Table:
        number = t.column("tree")[0].as_py()
        subs = sorted(((n, raw) for n, raw in zip(t.column("node").to_pylist(), t.column("sub").to_pylist()) if n >= 0), key=lambda r: r[0])
        whole = Packed.of(tops[number]).grafted([(n, pickle.loads(raw)) for n, raw in subs])
        raw = pickle.dumps(whole)
        return pa.table({"tree": pa.array([number], pa.int32()), "model": pa.array([raw], pa.binary()), "size": pa.array([len(raw)], pa.int64()),
                         "nodes": pa.array([len(whole.feature)], pa.int64())})

    # a number of tasks by the cells to grow trees from: few bytes of cells are much work
    tasks = max(1, min(len(small), int(drawn[:, :, 1].sum()) // SUBTREE_ROWS))
    dealt = cells.mapInArrow(deal, dealt_as).repartition(tasks, "tree", "node")
    subs = dealt.groupBy("tree", "node").applyInArrow(finish, "tree int, node long, sub binary")
    every = known.sparkSession.range(params.trees).select(F.col("id").cast("int").alias("tree"), F.lit(-1).cast("long").alias("node"), F.lit(None).cast("binary").alias("sub"))
    forest = materialize(subs.unionByName(every).groupBy("tree").applyInArrow(join, "tree int, model binary, size long, nodes long"), "forest")
    discard(cells)
    return forest


def predict_forest(rows: DataFrame, forest: DataFrame, edges: list[np.ndarray], n_classes: int, features: str = "features") -> DataFrame:
    """All columns of ``rows`` with ``prediction``: the class of the largest mean probability (ties:
    the first). Trees are handed to the tasks in groups of at most about FOREST_BYTES; between
    groups the sums so far are written."""
    import pickle

    sizes = forest.select("tree", "size").orderBy("tree").collect()
    groups: list[list[int]] = [[]]
    held = 0
    for r in sizes:
        if held and held + r["size"] > FOREST_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(r["tree"])
        held += r["size"]
    names, n = rows.columns, len(edges)
    out = rows.withColumn("_votes", F.lit(None).cast("binary"))
    for last, group in ((g is groups[-1], g) for g in groups):
        trees = [pickle.loads(bytes(r["model"])) for r in forest.where(F.col("tree").isin(group)).orderBy("tree").select("model").collect()]
        shared = rows.sparkSession.sparkContext.broadcast(trees)

        def run(batches, shared=shared):
            for b in batches:
                x = b.column(names.index(features)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                bins = np.stack([np.searchsorted(e, np.where(np.isnan(x[:, i]), np.inf, x[:, i])).astype(np.uint8) for i, e in enumerate(edges)], axis=1)
                old = b.column(len(names)).to_pylist()
                votes = np.frombuffer(b"".join(old), "<f8").reshape(len(x), n_classes).copy() if old and old[0] is not None else np.zeros((len(x), n_classes))
                for tree in shared.value:
                    votes += tree.share_of(bins)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array([v.tobytes() for v in votes], pa.binary())], names=[*names, "_votes"])

        types = dict(rows.dtypes)
        out = out.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), "_votes binary"]))
        if not last:
            out = materialize(out, "forest-votes")

    def decide(batches):
        for b in batches:
            raw = b.column(len(names)).to_pylist()
            best = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), n_classes).argmax(axis=1) if raw else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(best.astype(np.int32))], names=[*names, "prediction"])

    return out.mapInArrow(decide, ", ".join([*(f"`{c}` {dict(rows.dtypes)[c]}" for c in names), "prediction int"]))
