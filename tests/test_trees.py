"""Tree models against plain versions on the same bins, and the vector sums below them."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampart.operators import trees as TR
from rampart.operators import vectorsum as VS


def data(spark, n=600, seed=1, classes=3, parts=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, 4)), 1)
    y = ((x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.standard_normal(n)) * 1.3).astype(int).clip(0, classes - 1)
    df = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)], "label_id int, features array<double>").repartition(parts)
    edges = TR.bin_edges(df, 4)
    return df, edges, TR.binned(df, edges)


def local(binned):
    rows = binned.orderBy("rid").collect()
    x = np.frombuffer(b"".join(bytes(r.bins) for r in rows), np.uint8).reshape(len(rows), -1)
    return x, np.array([r.label_id for r in rows]), np.array([r.rid for r in rows])


def plain_boost_tree(x, g, h, p):
    """One class's tree grown level by level over whole arrays: a function from rows to values."""
    leaves, nodes, done = 1, {"": np.arange(len(x))}, {}
    cuts = {}
    for _ in range(p.max_depth):
        found = []
        for path, at in nodes.items():
            best = None
            for f in range(x.shape[1]):
                for b in range(TR.MAX_BINS):
                    low = x[at, f] <= b
                    n = int(low.sum())
                    if n < p.min_rows or len(at) - n < p.min_rows:
                        continue
                    s = [(g[at][m].sum(), h[at][m].sum()) for m in (low, ~low)]
                    if min(s[0][1], s[1][1]) < p.min_hessian:
                        continue
                    gain = sum(a * a / b_ for a, b_ in s) - g[at].sum() ** 2 / h[at].sum()
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-10)):
                        best = (gain, f, b)
            if best:
                found.append((-best[0], path, best[1:]))
        fresh = {}
        for _, path, (f, b) in sorted(found):
            if leaves == p.max_leaves:
                break
            leaves += 1
            at = nodes[path]
            cuts[path] = (f, b)
            for turn, m in (("L", x[at, f] <= b), ("R", x[at, f] > b)):
                fresh[path + turn] = at[m]
                done[path + turn] = -p.learning_rate * g[at[m]].sum() / h[at[m]].sum()
        nodes = fresh

    def value(row):
        path = ""
        while path in cuts:
            path += "L" if row[cuts[path][0]] <= cuts[path][1] else "R"
        return done.get(path, 0.0)

    return value


@pytest.mark.parametrize("local_rows", [20_000, 0])
def test_boosting_equals_a_plain_version(spark, local_rows, monkeypatch):
    """In one task, and with a job a level."""
    monkeypatch.setattr(TR, "LOCAL_ROWS", local_rows)
    _, _, b = data(spark)
    p = TR.BoostParams(iterations=2, max_leaves=6)
    model = TR.fit_boosted(b, 4, 3, p, refresh=1)
    x, y, _ = local(b)
    share = np.bincount(y, minlength=3) / len(y)
    raw = np.tile(np.log(share), (len(y), 1))
    for r in range(2):
        prob = TR.softmax(raw)
        step = np.zeros_like(raw)
        for k in range(3):
            tree = plain_boost_tree(x, prob[:, k] - (y == k), prob[:, k] * (1 - prob[:, k]), p)
            step[:, k] = [tree(row) for row in x]
        raw += step
        got = TR.Boosted(model.base, model.rounds[:r + 1])
        assert np.allclose(got.base + got.raw(x), raw)
    assert len(model.rounds) == 2


def test_boosting_learns_and_stops(spark, monkeypatch):
    df, edges, b = data(spark, n=1500)
    p = TR.BoostParams(iterations=60, stop_above=1000, patience=3)
    model = TR.fit_boosted(b, 4, 3, p)
    assert 5 < len(model.rounds) < 60  # the held-out tenth stopped it
    got = TR.predict_boosted(df, model, edges)
    assert got.where("prediction = label_id").count() > 0.8 * df.count()
    # a job a level, histograms in small batches and summed in two levels change nothing
    monkeypatch.setattr(TR, "LOCAL_ROWS", 0)
    monkeypatch.setattr(TR, "HISTOGRAM_BYTES", 1 << 17)
    monkeypatch.setattr(VS, "DRIVER_BYTES", 0)
    p = TR.BoostParams(iterations=1)
    a, c = (TR.fit_boosted(b, 4, 3, p) for _ in range(2))
    x, _, _ = local(b)
    monkeypatch.undo()
    assert np.allclose(TR.fit_boosted(b, 4, 3, p).raw(x), a.raw(x)) and np.allclose(a.raw(x), c.raw(x))


@pytest.mark.parametrize("refresh", [1, 2, 10])
def test_boosting_of_blocks(spark, refresh, monkeypatch):
    """With a held-out tenth, the blocks kept between jobs give the trees of one task, at a job a level and
    none more for the loss; nothing stays kept."""
    _, _, b = data(spark, n=1200, seed=6)
    p = TR.BoostParams(iterations=12, stop_above=1000, patience=3, learning_rate=0.4, max_depth=3)
    want = TR.fit_boosted(b, 4, 3, p)
    monkeypatch.setattr(TR, "LOCAL_ROWS", 0)
    monkeypatch.setattr(TR, "BLOCK_BYTES", 2_000)  # 62 rows
    sc = spark.sparkContext
    had, group = sc._jsc.getPersistentRDDs().size(), f"boost-{refresh}"
    sc.setJobGroup(group, group)
    try:
        got = TR.fit_boosted(b, 4, 3, p, refresh=refresh)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    x, _, _ = local(b)
    assert 3 < len(got.rounds) == len(want.rounds) and np.allclose(got.raw(x), want.raw(x))
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    assert jobs <= (3 + 2 / refresh) * (len(got.rounds) + 1) + 8  # writing the scores takes two
    assert sc._jsc.getPersistentRDDs().size() == had


@pytest.mark.parametrize("splits", [0, 1, 30, 63, 64, 120])
def test_nodes_by_columns(splits):
    """Trees of up to 64 leaves by tables, larger ones by steps."""
    rng = np.random.default_rng(splits)
    tree, leaves = TR.Tree(), [0]
    x = rng.integers(0, 256, (4, 3000)).astype(np.uint8)
    for _ in range(splits):
        leaves += tree.split(leaves.pop(int(rng.integers(len(leaves)))), int(rng.integers(4)), int(rng.integers(256)))
        if splits == 30:  # a grown tree's tables are made anew
            assert (tree.node_of_columns(x) == tree.node_of(x.T)).all()
    assert (tree.node_of_columns(x) == tree.node_of(np.ascontiguousarray(x.T))).all()


def plain_forest_tree(x, y, w, classes, seed, number):
    """One tree grown by recursion with every cut tried by itself."""
    def grow(at, path):
        share = np.bincount(y[at], w[at], classes)
        if np.count_nonzero(share) > 1:
            best, seen = None, 0
            for f in TR.feature_order(seed, number, path, x.shape[1]).tolist():
                cut = [(f, int(b)) for b in np.unique(x[at, f])[:-1]]
                for f_, b in cut:
                    low = x[at, f_] <= b
                    s = sum((q := np.bincount(y[at[m]], w[at[m]], classes)) @ q / q.sum() for m in (low, ~low))
                    if best is None or s > best[0] * (1 + 1e-10):
                        best = (s, f_, b)
                seen += bool(cut)
                if seen == max(1, int(np.sqrt(x.shape[1]))):
                    break
            if best:
                low = x[at, best[1]] <= best[2]
                return (best[1], best[2], grow(at[low], path + "L"), grow(at[~low], path + "R"))
        return share / share.sum()

    root = grow(np.arange(len(y)), "")

    def value(row):
        node = root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    return value


@pytest.mark.parametrize("local_rows,small_rows", [(100_000, 50), (40, 1_000)])
def test_forest_equals_a_plain_version(spark, local_rows, small_rows, monkeypatch):
    monkeypatch.setattr(TR, "SMALL_ROWS", small_rows)
    _, _, b = data(spark, n=400, seed=2)
    model = TR.fit_forest(b, 4, 3, TR.ForestParams(trees=3, seed=7), local_rows=local_rows)
    x, y, rid = local(b)
    got = {r.tree: pickle.loads(bytes(r.model)) for r in model.collect()}
    assert sorted(got) == [0, 1, 2]
    for t, tree in got.items():
        k = TR.bootstrap_counts(rid, t, 7)
        n = np.bincount(y, k, 3)
        w = (n.sum() / (np.count_nonzero(n) * n))[y] * k
        on = k > 0
        want = plain_forest_tree(x[on], y[on], w[on], 3, 7, t)
        assert np.allclose(np.array([v for v in tree.value])[tree.node_of(x)], [want(r) for r in x])


def test_forest_predicts_in_groups(spark, monkeypatch):
    df, edges, b = data(spark, n=500, seed=3)
    model = TR.fit_forest(b, 4, 3, TR.ForestParams(trees=5))
    one = [r.prediction for r in TR.predict_forest(df, model, edges, 3).orderBy("features", "label_id").collect()]
    monkeypatch.setattr(TR, "FOREST_BYTES", 1)
    two = [r.prediction for r in TR.predict_forest(df, model, edges, 3).orderBy("features", "label_id").collect()]
    assert one == two
    got = TR.predict_forest(df, model, edges, 3)
    assert got.columns == ["label_id", "features", "prediction"] and got.where("prediction = label_id").count() > 0.85 * 500


def test_bootstrap_is_poisson():
    k = TR.bootstrap_counts(np.arange(200_000), 5, 42)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and abs((k == 0).mean() - np.exp(-1)) < 0.005


def test_few_rows(spark):
    """No rows, one class, unknown labels, NULL and NaN values."""
    schema = "label_id int, features array<double>"
    df = spark.createDataFrame([(1, [float("nan"), 1.0]), (1, [None, 2.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0])], schema)
    edges = TR.bin_edges(df, 2)
    b = TR.binned(df, edges)
    assert TR.fit_boosted(b, 2, 3, TR.BoostParams(iterations=2)).rounds == []
    forest = TR.fit_forest(b, 2, 3, TR.ForestParams(trees=4))
    assert {r.prediction for r in TR.predict_forest(df, forest, edges, 3).collect()} <= {0, 1}
    none = TR.binned(df.limit(0), edges)
    assert TR.fit_boosted(none, 2, 3).rounds == [] and TR.fit_forest(none, 2, 3, TR.ForestParams(trees=2)).count() == 2


def test_vector_sums(spark):
    """Two levels give the sums of one, by key, whatever the number of partials."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 7))
    rows = [(i % 3 if i % 3 else None, i, p, bytearray(raw)) for i in range(90) for p, raw in VS.pieces(v[i], piece=3)]
    df = spark.createDataFrame(rows, "k int, part long, piece long, v binary")
    for parts in (1, 90):
        got = VS.sum_vectors(df, ["k"], parts).collect()
        assert len(got) == 9
        for k in (None, 1, 2):
            whole = np.frombuffer(b"".join(bytes(r.v) for r in sorted((r for r in got if r.k == k), key=lambda r: r.piece)), "<f8")
            assert np.allclose(whole, v[(k or 0)::3].sum(axis=0))
    assert VS.sum_vectors(df.limit(0), ["k"], 4).count() == 0 and (VS.total(df.limit(0).drop("k"), 5, 4) == 0).all()
    # a task of the first level reads about the square root of the partials
    plan = VS.sum_vectors(df.withColumn("part", F.col("part")), ["k"], 100)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 2


def test_forest_takes_few_bytes(spark):
    """A node of a stored forest is a few numbers and most leaves share their distribution; subtrees
    are grown by as many tasks as their rows ask for, however few bytes these are."""
    rng = np.random.default_rng(8)
    rows = [(int(y), [float(v) for v in x]) for x, y in zip(rng.standard_normal((2000, 4)), rng.integers(0, 3, 2000))]
    df = spark.createDataFrame(rows, "label_id int, features array<double>")
    edges = TR.bin_edges(df, 4)
    model = TR.fit_forest(TR.binned(df, edges), 4, 3, TR.ForestParams(trees=3)).collect()
    assert all(r["nodes"] > 400 and r["size"] < 30 * r["nodes"] + 2000 for r in model)


def test_subtrees_in_their_places():
    tree, subs = TR.Tree(), {}
    left, right = tree.split(0, 0, 5)
    for node in (left, right):
        sub = TR.Tree()
        a, b = sub.split(0, 1, node)
        sub.value = [np.zeros(2), np.array([1.0, 0.0]), np.array([0.25, 0.75])]
        subs[node] = TR.Packed.of(sub)
    tree.value = [np.zeros(2)] * 3
    got = TR.Packed.of(tree).grafted(sorted(subs.items()))
    x = np.array([[5, 1], [5, 2], [6, 2], [6, 3]], np.uint8)
    assert got.share_of(x).tolist() == [[1.0, 0.0], [0.25, 0.75]] * 2 and len(got.shares) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 8, 64])
def test_feature_orders_of_many_nodes(n):
    """The generator's permutations, for all nodes at once."""
    rng = np.random.default_rng(n)
    paths = ["".join(rng.choice(["L", "R"], int(k))) for k in rng.integers(0, 40, 500)]
    got = TR.feature_orders(42, 5, [p.encode() for p in paths], n)
    assert got.tolist() == [TR.feature_order(42, 5, p, n).tolist() for p in paths]


@pytest.mark.parametrize("small_rows,cell_bytes,local_rows", [(0, 8 << 20, None), (0, 4_000, None), (0, 4_000, 30), (10_000, 1_000, None)])
def test_forest_of_repeated_rows(spark, small_rows, cell_bytes, local_rows, monkeypatch):
    """A row that occurs often is one cell with the draws of all its copies, and the trees are those of the rows."""
    monkeypatch.setattr(TR, "SMALL_ROWS", small_rows)
    monkeypatch.setattr(TR, "CELL_BYTES", cell_bytes)
    rng = np.random.default_rng(9)
    some = [(int(y), [float(v) for v in x]) for x, y in zip(rng.integers(0, 12, (120, 3)), rng.integers(0, 3, 120))]
    rows = [r for i, r in enumerate(some) for _ in range(1 + i % 20)] + [some[0]] * 400 + [(None, [1.0, 1.0, 1.0]), (7, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "label_id int, features array<double>").repartition(5)
    b = TR.binned(df, TR.bin_edges(df, 3))
    p = TR.ForestParams(trees=4, seed=3)
    x, y, rid = local(b.where("label_id between 0 and 2"))
    draws = np.stack([TR.bootstrap_counts(rid, t, 3) for t in range(4)])
    blocks = [TR._cell_arrays(*r, 3, 4) for r in TR.forest_cells(b.where("label_id between 0 and 2"), len(x), 3, p).collect()]
    got: dict[tuple, np.ndarray] = {}
    for bx, by, bd in blocks:
        for i in range(len(by)):
            key = (*bx[i].tolist(), int(by[i]))
            assert small_rows or key not in got  # once, wherever its rows were
            got[key] = got.get(key, 0) + bd[:, i].astype(int)
    want: dict[tuple, np.ndarray] = {}
    for i in range(len(x)):
        key = (*x[i].tolist(), int(y[i]))
        want[key] = want.get(key, 0) + draws[:, i]
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    trees = {r.tree: pickle.loads(bytes(r.model)) for r in TR.fit_forest(b, 3, 3, p, local_rows=local_rows).collect()}
    for t, tree in trees.items():
        n = np.bincount(y, draws[t], 3)
        w, on = (n.sum() / (np.count_nonzero(n) * n))[y] * draws[t], draws[t] > 0
        plain = plain_forest_tree(x[on], y[on], w[on], 3, 3, t)
        assert np.allclose(tree.share_of(x), [plain(r) for r in x])


def test_distinct_rows_of_doubles():
    v = np.array([[0.0, 1.0], [0.5, 0.5], [-0.0, 1.0], [0.5, 0.5]])
    rows, kind = TR.distinct_rows(v)
    assert len(rows) == 2 and (rows[kind] == v).all()
