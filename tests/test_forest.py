"""The forest of unlimited depth: pure leaves, the same trees both ways, and splits by a search over all values."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from mailsift.operators import boosting, forest
from mailsift.operators.trees import Rows

FEATURES = 9


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, FEATURES)), 1) * (rng.random((400, FEATURES)) < 0.5)
    x[350:] = x[:50]  # repeated rows, some with the other label
    y = ((x[:, 0] > 0.1) ^ (x[:, 3] < 0) ^ (rng.random(400) < 0.2)).astype(float)
    return x, y


def table(spark, x, y, partitions=3):
    rows = [(Vectors.dense(r), float(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, ["features", "y"]).repartition(partitions)


def as_rows(x, trees):
    row, feature = np.nonzero(x)
    return Rows(trees.used_features(), len(x), row, feature, x[row, feature])


def one_block(bins, x, y):
    row, feature = np.nonzero(x)
    number = bins.numbers(feature, x[row, feature])
    order = np.argsort(number, kind="stable")
    return boosting.Block(("", 0, 0), y.astype(np.int8), row[order].astype(np.int32), number[order].astype(np.int32))


def fitted(spark, data, **options):
    rows = table(spark, *data)
    bins = boosting.find_bins(rows, FEATURES, bins=200)
    return bins, forest.fit(rows, bins, boosting.write_blocks(rows, bins, block_rows=48), **options)


def test_trees_are_the_same_with_and_without_passes(spark, data):
    _, whole = fitted(spark, data, trees=6, seed=3)
    for local_rows in (120, 1):
        _, passes = fitted(spark, data, trees=6, seed=3, local_rows=local_rows)
        for t in range(6):
            assert walk(whole.trees, whole.trees.root[t]) == walk(passes.trees, passes.trees.root[t])
    _, other = fitted(spark, data, trees=6, seed=4)
    assert any(walk(whole.trees, whole.trees.root[t]) != walk(other.trees, other.trees.root[t]) for t in range(6))


def walk(trees, node):
    if trees.left[node] < 0:
        return float(trees.value[node]), float(trees.cover[node])
    here = int(trees.feature[node]), float(trees.threshold[node]), pytest.approx(float(trees.gain[node]), abs=1e-9)
    return here, walk(trees, trees.left[node]), walk(trees, trees.right[node])


def test_leaves_are_pure_or_cannot_be_split(data):
    x, y = data
    bins = bins_of(x)
    weight = np.random.default_rng(1).poisson(1.0, len(y))
    tree = forest.finished(bins, one_block(bins, x, y), weight, key=7)
    model = forest.Forest(forest.Trees.from_tables([forest._table(tree, bins)]), FEATURES)
    leaf = model.trees.leaves_of(as_rows(x, model.trees))[:, 0]
    mixed = 0
    for node in np.unique(leaf[weight > 0]):
        held = (leaf == node) & (weight > 0)
        assert model.trees.value[node] == pytest.approx(np.average(y[held], weights=weight[held]))
        assert model.trees.cover[node] == weight[held].sum()
        if len(set(y[held])) > 1:
            mixed += 1
            assert len(np.unique(x[held], axis=0)) == 1
    assert mixed and max(tree.depth) > 5
    assert model.importance.sum() == pytest.approx(1.0)


def bins_of(x):
    own = [np.unique(np.append(x[:, f], 0.0)) for f in range(x.shape[1])]
    at = np.concatenate([[0], np.cumsum([len(b) for b in own])])
    return boosting.Bins(at, np.concatenate(own), np.array([at[f] + np.searchsorted(b, 0.0) for f, b in enumerate(own)]))


def test_splits_equal_a_search_over_all_values(data, monkeypatch):
    """With all features drawn, every split has the largest Gini decrease of all cuts."""
    x, y = data
    monkeypatch.setattr(forest, "draw_size", lambda features, attempt: features)
    bins = bins_of(x)
    weight = np.random.default_rng(2).poisson(1.0, len(y)).astype(float)
    tree = forest.finished(bins, one_block(bins, x, y), weight, key=7)

    def impurity(held):
        w, p = weight[held].sum(), (weight * y)[held].sum()
        return 2 * p * (w - p) / w

    def check(node, held):
        if tree.left[node] < 0:
            return 1
        best = max(
            impurity(held) - impurity(held & (x[:, f] <= cut)) - impurity(held & (x[:, f] > cut))
            for f in range(FEATURES) for cut in np.unique(np.append(x[held, f], 0.0))
            if (held & (x[:, f] <= cut)).any() and (held & (x[:, f] > cut)).any())
        f, cut = tree.feature[node], bins.bound[tree.bin[node]]
        left, right = held & (x[:, f] <= cut), held & (x[:, f] > cut)
        assert tree.gain[node] == pytest.approx(best, abs=1e-8)
        assert impurity(held) - impurity(left) - impurity(right) == pytest.approx(best, abs=1e-8)
        return check(tree.left[node], left) + check(tree.right[node], right)

    assert check(0, weight > 0) > 20


def test_splits_without_gain_are_taken():
    """Two features that tell the label only together."""
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    y = np.array([0.0, 1.0, 1.0, 0.0])
    bins = bins_of(x)
    for key in range(5):
        tree = forest.finished(bins, one_block(bins, x, y), np.ones(4), key)
        leaves = [t for t, left in zip(tree.total, tree.left) if left < 0]
        assert len(leaves) == 4 and all(p in (0, w) for p, w, _ in leaves)


def test_depth_bound_scores_storage_and_edge_cases(spark, data, tmp_path):
    x, y = data
    _, model = fitted(spark, data, trees=5, depth=3, seed=1)
    assert all(depth_of(model.trees, r) <= 3 for r in model.trees.root)
    _, passes = fitted(spark, data, trees=5, depth=3, seed=1, local_rows=30)
    rows = as_rows(x, model.trees)
    assert model.trees.sums(rows) == pytest.approx(passes.trees.sums(as_rows(x, passes.trees)))
    model.save(spark, str(tmp_path / "f"))
    again = forest.Forest.load(spark, str(tmp_path / "f"))
    assert again.trees.sums(rows) == pytest.approx(model.trees.sums(rows)) and np.allclose(again.importance, model.importance)
    scored = table(spark, x, y).withColumn("p", boosting.probability(model)).select("p").toPandas().p
    assert sorted(scored) == pytest.approx(sorted(model.trees.sums(rows) / 5))
    _, same = fitted(spark, (x[:20], np.ones(20)), trees=2)
    assert same.trees.left.tolist() == [-1, -1] and same.trees.value.tolist() == [1.0, 1.0]
    empty = table(spark, x, y).filter("y > 1")
    bins = boosting.find_bins(empty, FEATURES)
    none = forest.fit(empty, bins, boosting.write_blocks(empty, bins), trees=2)
    assert none.trees.value.tolist() == [0.5, 0.5]


def depth_of(trees, node):
    return 0 if trees.left[node] < 0 else 1 + max(depth_of(trees, trees.left[node]), depth_of(trees, trees.right[node]))


@pytest.mark.parametrize("depth", [None, 3])
def test_looked_up_codes_and_all_entries_give_the_same_tree(spark, data, depth):
    bins = boosting.find_bins(table(spark, *data), FEATURES, bins=200)
    block = one_block(bins, *data)
    weight = forest._bag(block, 3, 0)
    codes = forest.coded(bins, block)
    assert codes is not None and codes.shape == data[0].shape and ((codes > 0) == (data[0] != 0)).all()
    assert forest.finished(bins, block, weight, 77, depth=depth) == forest._finished_from_entries(bins, block, weight, 77, depth=depth)
    assert forest.finished(bins, block, weight, 77, depth=depth, codes=codes) == forest.finished(bins, block, weight, 77, depth=depth)


def test_a_feature_of_many_bins_has_no_codes():
    bins = boosting.Bins(np.array([0, 300]), np.arange(300.0), np.array([0]))
    block = boosting.Block(("", 0, 0), np.array([0, 1, 1], np.int8), np.array([1, 2], np.int32), np.array([260, 299], np.int32))
    assert forest.coded(bins, block) is None
    assert len(forest.finished(bins, block, np.ones(3, int), 5).left) == 3


def test_large_nodes_are_split_alike_from_cells_and_from_entries(data, monkeypatch):
    x, y = data
    own = [np.unique(np.append(x[:, f], 0.0)) for f in range(FEATURES)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in own])])
    bins = boosting.Bins(at, np.concatenate(own), np.array([a + np.searchsorted(b, 0.0) for a, b in zip(at, own)]))
    block, weight = one_block(bins, x, y), np.random.default_rng(2).poisson(1.0, len(y))
    grown, calls = [], []
    sums = forest.Columns.sums
    monkeypatch.setattr(forest.Columns, "sums", lambda self, *a: calls.append(1) or sums(self, *a))
    for cells in (1 << 60, 0):
        monkeypatch.setattr(forest, "LARGE_NODE", cells)
        grown.append(forest.finished(bins, block, weight, 7))
        assert bool(calls) == (cells == 0)
    grown.append(forest._finished_from_entries(bins, block, weight, 7))
    for other in grown[1:]:
        for name in ("feature", "bin", "left", "right", "total", "gain"):
            assert getattr(grown[0], name) == getattr(other, name)


def test_counts_that_do_not_fit_one_number_are_not_packed():
    assert forest.Columns.packed(np.array([[0.0], [float(1 << 21)], [1.0]])) is None
    packed = forest.Columns.packed(np.array([[2.0, 0.0], [3.0, 4.0], [1.0, 1.0]]))
    one, total = (1 << 21) - 1, int(packed.sum())
    assert [total & one, total >> 21 & one, total >> 42] == [2, 7, 2]


def test_blocks_are_not_shuffled_to_tasks_that_grow_whole_trees(spark, data, monkeypatch):
    from pyspark import RDD

    rows = table(spark, *data)
    bins = boosting.find_bins(rows, FEATURES)
    blocks = boosting.write_blocks(rows, bins, block_rows=48)
    monkeypatch.setattr(RDD, "partitionBy", None)
    model = forest.fit(rows, bins, blocks, trees=5)
    assert len(model.trees.root) == 5 and min(np.diff([*model.trees.root, len(model.trees.left)])) > 1


@pytest.mark.parametrize("cells", [1, 1 << 14])
def test_trees_that_grow_side_by_side_are_those_that_grow_alone(data, monkeypatch, cells):
    x, y = data
    bins = bins_of(x)
    block = one_block(bins, x, y)
    monkeypatch.setattr(forest, "LARGE_NODE", cells)
    # One that sees no row, and one that sees a single label.
    weights = [forest._bag(block, 1, t) for t in range(4)] + [np.zeros(len(y), int), (y > 0).astype(int)]
    alone = [forest.finished(bins, block, w, 70 + t) for t, w in enumerate(weights)]
    assert forest.side_by_side(bins, block, weights, list(range(70, 76))) == alone
    assert [len(tree.left) for tree in alone[4:]] == [1, 1]


@pytest.mark.parametrize("at_once", [1, 300, 1 << 22])
def test_rows_are_held_as_bits_and_bins(monkeypatch, at_once):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(70, 130)), 1) * (rng.random((70, 130)) < 0.1)
    x[[0, 33, 69]] = 0
    bins = bins_of(x)
    block = one_block(bins, x, np.zeros(70))
    monkeypatch.setattr(forest, "CODED_AT_ONCE", at_once)
    codes = forest.Codes.of(bins, block)
    row, feature = (a.ravel() for a in np.indices(x.shape))
    assert (codes.numbers(bins, row, feature) == bins.numbers(feature, x.ravel())).all()
    assert codes.words.nbytes + codes.before.nbytes + codes.place.nbytes < x.size // 2


def test_tasks_that_grow_whole_trees_hold_entries_once(spark, data, monkeypatch):
    """What they grow from are bits and columns; the blocks' entries are let go."""
    rows = table(spark, *data)
    bins = boosting.find_bins(rows, FEATURES, bins=200)
    alone = forest.side_by_side

    def watched(bins, block, weights, *rest, **more):
        assert not len(block.row) and len(block.y) == 400 and len(weights) <= forest.TREES_AT_ONCE
        return alone(bins, block, weights, *rest, **more)

    blocks = boosting.write_blocks(rows, bins, block_rows=48)
    before = forest.fit(rows, bins, blocks, trees=5, seed=3)
    monkeypatch.setattr(forest, "side_by_side", watched)
    after = forest.fit(rows, bins, blocks, trees=5, seed=3)
    assert before.trees.feature.tolist() == after.trees.feature.tolist()


def test_blocks_are_joined_by_bin_in_the_order_of_blocks(data):
    x, y = data
    bins = bins_of(x)
    parts = [one_block(bins, x[a:b], y[a:b]) for a, b in ((0, 150), (150, 150), (150, 390), (390, 400))]
    # Letting blocks go takes less memory than sorting all entries.
    row, number = np.concatenate([p.row + a for p, a in zip(parts, (0, 150, 150, 390))]), np.concatenate([p.bin for p in parts])
    order = np.argsort(number, kind="stable")
    found = boosting.joined(parts)
    assert not parts and (found.y == y).all() and found.row.dtype == found.bin.dtype == np.int32
    assert (found.row == row[order]).all() and (found.bin == number[order]).all()
    none = boosting.joined([one_block(bins, x[:0], y[:0]), one_block(bins, 0 * x[:3], y[:3])])
    assert len(none.y) == 3 and not len(none.row) and not len(none.bin)
