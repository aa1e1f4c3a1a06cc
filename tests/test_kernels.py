"""The loops in Java give the trees and values that the numpy code gives."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from mailsift.operators import boosting, forest, kernels, models, trees
from mailsift.operators.trees import BackgroundShapley, PathShapley, Rows

FEATURES = 40


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(900, FEATURES)), 1) * (rng.random((900, FEATURES)) < 0.3)
    x[:, 7] = np.abs(x[:, 7])
    x[800:] = x[:100]  # repeated rows, some with the other label
    y = ((x[:, 0] > 0.1) ^ (x[:, 3] < 0) ^ (x[:, 7] > 0.5) ^ (rng.random(900) < 0.1)).astype(float)
    return x, y


@pytest.fixture(scope="module")
def fitted(spark, data):
    x, y = data
    rows = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ["features", "y"]).repartition(3).persist()
    bins = boosting.find_bins(rows, FEATURES)
    return rows, bins, boosting.write_blocks(rows, bins, block_rows=128)


@pytest.fixture
def table(fitted, monkeypatch):
    rows, bins, blocks = fitted
    monkeypatch.setattr(kernels, "LEAST_ROWS", 1)
    found = kernels.table(blocks, bins, 900, 900 * FEATURES)
    assert found.rows == 900 and len(found.keys) > 3
    return found


@pytest.fixture
def java(spark):
    with kernels.Kernels(kernels.code(spark), 64 << 20) as running:
        yield running


@pytest.mark.parametrize("key", [0, 1, 12345, (1 << 32) - 1, 1 << 32, 0x9E3779B97F4A7C15, (1 << 64) - 1])
def test_draws_are_those_of_numpy(java, key):
    for attempt, features, size in [(0, 5012, 70), (1, 5012, 140), (6, 5012, 4480), (0, 9, 3), (2, 3, 2), (0, 10, 1)]:
        wanted = np.random.default_rng([key, attempt]).choice(features, size, replace=False)
        assert java.drawn(key, attempt, features, size).tolist() == sorted(wanted.tolist())


def same_trees(a, b):
    for name in ("root", "feature", "threshold", "left", "right"):
        assert getattr(a, name).tolist() == getattr(b, name).tolist(), name
    for name in ("value", "cover", "gain"):
        assert getattr(a, name) == pytest.approx(getattr(b, name), rel=1e-9, abs=1e-9), name


@pytest.mark.parametrize("depth", [None, 4])
def test_forest_is_the_same(fitted, table, depth):
    rows, bins, blocks = fitted
    same_trees(forest.fit(rows, bins, blocks, 12, depth, 3, table=table).trees, forest.fit(rows, bins, blocks, 12, depth, 3).trees)


@pytest.mark.parametrize("name", ["boosting_a", "boosting_b"])
def test_boosting_is_the_same(fitted, table, name):
    rows, bins, blocks = fitted
    growth = models.growths(models.TrainingOptions(rounds=12))[name]
    a, b = boosting.fit(rows, growth, bins, blocks, table=table), boosting.fit(rows, growth, bins, blocks)
    assert a.base == b.base and len(a.trees.root) == 12
    same_trees(a.trees, b.trees)


def test_explanations_are_the_same(spark, data, fitted, java):
    rows, bins, blocks = fitted
    x, _ = data

    def held(trees, part):
        row, feature = np.nonzero(part)
        return Rows(trees.used_features(), len(part), row, feature, part[row, feature])

    grown = forest.fit(rows, bins, blocks, 9, None, 5).trees
    model = BackgroundShapley(grown, held(grown, x[::47][:20]))
    part = held(grown, x[300:340])
    assert model.values(part, java) == pytest.approx(model.values(part), abs=1e-12)
    for growth in models.growths(models.TrainingOptions(rounds=8)).values():
        boosted = boosting.fit(rows, growth, bins, blocks)
        model = PathShapley(boosted.trees, boosted.base)
        part = held(boosted.trees, x[300:340])
        assert model.values(part, java) == pytest.approx(model.values(part), abs=1e-12)
        assert model.values(part, java) == pytest.approx(model.values(part), abs=1e-12)


def test_table_is_for_many_rows_that_a_task_can_hold(fitted, monkeypatch):
    _, bins, _ = fitted
    assert not kernels.fits(bins, kernels.LEAST_ROWS - 1, 1000)
    assert kernels.fits(bins, 460_000, 74_000_000)  # 1 GB of mails, about
    assert not kernels.fits(bins, 10**7, kernels.TABLE_BYTES // 3)
    monkeypatch.setattr(kernels, "java", lambda: None)
    assert not kernels.fits(bins, 460_000, 74_000_000)


def test_large_nodes_go_by_feature(spark, java):
    """Many rows of many features: nodes with most of the rows go through the entries of the drawn features."""
    rng = np.random.default_rng(4)
    rows, features = 3000, 300
    held = rng.random((rows, features)) < 0.1
    place = rng.integers(1, 4, (rows, features))
    y = (place[:, 0] * held[:, 0] > 1) ^ (rng.random(rows) < 0.3)
    row, feature = np.nonzero(held)
    bins = boosting.Bins(np.arange(features + 1) * 4, np.tile(np.arange(4.0), features), np.arange(features) * 4)
    number = (feature * 4 + place[row, feature]).astype(np.int32)
    order = np.argsort(number, kind="stable")
    block = boosting.Block(("", 0, 0), y.astype(np.int8), row[order].astype(np.int32), number[order])
    counts = [(rows, len(row))]
    table = kernels.Table(None, [(0, 0)], counts, 0, {}, None)
    java.feed(table, bins, iter([kernels.Rowwise((0, 0), block.y, held.sum(axis=1).astype(np.int32), feature.astype(np.uint16),
                                                 place[row, feature].astype(np.uint8))]))
    for key in (5, 6):
        weight = rng.poisson(1.0, rows)
        wanted = forest.finished(bins, block, weight, key)
        number, left, positive, whole, held_rows, depth, gain = java.forest_tree(weight, key, forest.draw_size(features, 0), None, boosting.TIE)
        assert left.tolist() == wanted.left and depth.tolist() == wanted.depth and max(depth) > 8
        inner = left >= 0
        assert number[inner].tolist() == np.array(wanted.bin)[inner].tolist()
        assert np.stack([positive, whole, held_rows], axis=1).tolist() == np.array(wanted.total).tolist()
        assert gain == pytest.approx(np.array(wanted.gain), abs=1e-9)


def test_nodes_are_saved_in_pieces(spark, fitted, tmp_path, monkeypatch):
    """More nodes than go to the tasks at once, read back as they were."""
    rows, bins, blocks = fitted
    made = forest.fit(rows, bins, blocks, 6, None, 2)
    monkeypatch.setattr(trees, "SAVED_AT_ONCE", 128)
    monkeypatch.setattr(trees, "PIECE", 32)
    made.save(spark, str(tmp_path / "forest"))
    same_trees(forest.Forest.load(spark, str(tmp_path / "forest")).trees, made.trees)
    assert len(made.trees.left) > 300 and made.trees.to_rows(5, 40).equals(made.trees.to_rows().slice(5, 35))
