"""Boosting and Shapley values against brute force on small trees and tables."""

import pickle
import weakref
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from mailsift.operators import boosting
from mailsift.operators import trees as trees_module
from mailsift.operators.trees import BackgroundShapley, PathShapley, Rows, Trees

FEATURES = 5


def random_tree(rng, depth):
    """A tree in which features repeat on paths; covers are rows that a random sample sends to the nodes."""
    t = {c: [] for c in ("feature", "threshold", "left", "right", "value", "cover", "gain")}

    def grow(level, cover):
        node = len(t["left"])
        leaf = level == depth or cover < 2 or (level and rng.random() < 0.2)
        for c, v in (("feature", int(rng.integers(FEATURES))), ("threshold", float(rng.normal())), ("left", -1), ("right", -1),
                     ("value", float(rng.normal())), ("cover", float(cover)), ("gain", 0.0)):
            t[c].append(v)
        if not leaf:
            part = int(rng.integers(1, cover))
            t["left"][node] = grow(level + 1, part)
            t["right"][node] = grow(level + 1, cover - part)
        return node

    grow(0, 60)
    return {c: np.array(v) for c, v in t.items()}


def as_rows(x, trees):
    row, feature = np.nonzero(x)
    return Rows(trees.used_features(), len(x), row, feature, x[row, feature])


def shapley(value, features):
    out = np.zeros(FEATURES)
    for f in features:
        rest = [g for g in features if g != f]
        for size in range(len(rest) + 1):
            for held in combinations(rest, size):
                weight = factorial(size) * factorial(len(features) - size - 1) / factorial(len(features))
                out[f] += weight * (value({*held, f}) - value(set(held)))
    return out


def expected(trees, node, x, held):
    """Value of a tree where features outside the coalition are averaged over by cover."""
    if trees.left[node] < 0:
        return trees.value[node]
    a, b, f = trees.left[node], trees.right[node], trees.feature[node]
    if f in held:
        return expected(trees, a if x[f] <= trees.threshold[node] else b, x, held)
    return (trees.cover[a] * expected(trees, a, x, held) + trees.cover[b] * expected(trees, b, x, held)) / trees.cover[node]


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    trees = Trees.from_tables([random_tree(rng, d) for d in (1, 3, 4, 6, 6)])
    return trees, rng.normal(size=(12, FEATURES)) * (rng.random((12, FEATURES)) < 0.7), rng.normal(size=(7, FEATURES))


def wide(explainer, values):
    out = np.zeros((len(values), FEATURES))
    out[:, explainer.features] = values
    return out


def test_path_dependent_values_equal_all_coalitions(small):
    trees, x, _ = small
    explainer = PathShapley(trees, base=0.25)
    found = wide(explainer, explainer.values(as_rows(x, trees)))
    for row, got in zip(x, found):
        value = lambda held, row=row: sum(expected(trees, r, row, held) for r in trees.root)
        assert got == pytest.approx(shapley(value, range(FEATURES)), abs=1e-10)
    assert explainer.base + found.sum(axis=1) == pytest.approx(0.25 + trees.sums(as_rows(x, trees)), abs=1e-10)


def test_interventional_values_equal_all_coalitions(small):
    trees, x, background = small
    explainer = BackgroundShapley(trees, as_rows(background, trees))
    explainer.ROWS_AT_ONCE = 5
    found = wide(explainer, explainer.values(as_rows(x, trees)))

    def value(held, row):
        mixed = background.copy()
        mixed[:, list(held)] = row[list(held)]
        return trees.sums(as_rows(mixed, trees)).mean() / len(trees.root)

    for row, got in zip(x, found):
        assert got == pytest.approx(shapley(lambda held, row=row: value(held, row), range(FEATURES)), abs=1e-10)
    assert explainer.base + found.sum(axis=1) == pytest.approx(trees.sums(as_rows(x, trees)) / len(trees.root), abs=1e-10)
    same = BackgroundShapley(trees, as_rows(x[:1], trees))
    assert np.abs(same.values(as_rows(x[:1], trees))).max() == 0


def test_stored_trees_come_back(spark, small, tmp_path):
    from mailsift.operators.trees import NODE_SCHEMA, save

    trees, x, _ = small
    save(trees, spark, str(tmp_path / "t"))
    again = Trees.from_rows(spark.read.schema(NODE_SCHEMA).parquet(str(tmp_path / "t")))
    assert all(np.array_equal(getattr(trees, c), getattr(again, c)) for c in vars(trees))


# --- boosting


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, FEATURES)), 1) * (rng.random((300, FEATURES)) < 0.6)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] < -0.1) ^ (rng.random(300) < 0.1)).astype(float)
    return x, y


def table(spark, x, y, partitions):
    rows = [(Vectors.sparse(FEATURES, {int(i): float(r[i]) for i in np.flatnonzero(r)}) if k % 2 else Vectors.dense(r), float(v))
            for k, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "y"]).repartition(partitions)


def grown_by_search(x, y, growth):
    """The same model by trying every value of every feature in every node; splits at the values themselves."""
    base = np.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), base)

    def best(rows, g, h):
        found = (1e-9, None)
        for f in range(FEATURES):
            for cut in np.unique(np.append(x[:, f], 0.0))[:-1]:
                a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(a), len(b)) < max(growth.least_rows, 1) or min(h[a].sum(), h[b].sum()) < growth.least_hessian:
                    continue
                part = lambda i: g[i].sum() ** 2 / (h[i].sum() + growth.l2)
                gain = part(a) + part(b) - part(rows)
                if gain > found[0] + 1e-9:
                    found = (gain, (f, cut, a, b))
        return found

    for _ in range(growth.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [(0, np.arange(len(y)), best(np.arange(len(y)), g, h))]
        while growth.leaves is None or len(leaves) < growth.leaves:
            open_ = [i for i, (d, _, b) in enumerate(leaves) if d < growth.depth and b[1]]
            if not open_:
                break
            i = max(open_, key=lambda i: leaves[i][2][0])
            d, _, (_, (f, cut, a, b)) = leaves.pop(i)
            leaves += [(d + 1, a, best(a, g, h)), (d + 1, b, best(b, g, h))]
        for _, rows, _ in leaves:
            margin[rows] -= growth.step * g[rows].sum() / (h[rows].sum() + growth.l2)
    return margin


@pytest.mark.parametrize("growth", [
    boosting.Growth(rounds=4, depth=3), boosting.Growth(rounds=3, depth=4, l2=0.0, least_hessian=1e-3, least_rows=20, leaves=6)])
@pytest.mark.parametrize("local_rows", [0, 1000])
def test_boosting_equals_a_search_over_all_splits(spark, data, growth, local_rows):
    x, y = data
    rows = table(spark, x, y, 3)
    bins = boosting.find_bins(rows, FEATURES, bins=200)
    assert all(set(np.unique(x[:, f])) <= set(bins.bound[bins.at[f] : bins.at[f + 1]]) for f in range(FEATURES))
    model = boosting.fit(rows, growth, bins, boosting.write_blocks(rows, bins, block_rows=64), local_rows)
    margins = model.base + model.trees.sums(as_rows(x, model.trees))
    assert margins == pytest.approx(grown_by_search(x, y, growth), abs=1e-8)
    scored = rows.withColumn("p", boosting.probability(model)).select("p").toPandas().p
    assert sorted(scored) == pytest.approx(sorted(boosting.sigmoid(margins)))
    assert model.importance.sum() == pytest.approx(1.0)


def test_boosting_does_not_depend_on_blocks(spark, data):
    growth = boosting.Growth(rounds=5, depth=4)
    fits = []
    for partitions, size in ((1, 1000), (4, 16)):
        rows = table(spark, *data, partitions)
        bins = boosting.find_bins(rows, FEATURES)
        fits.append(boosting.fit(rows, growth, bins, boosting.write_blocks(rows, bins, size), local_rows=0))
    fits.append(boosting.fit(rows, growth, bins, boosting.write_blocks(rows, bins, size)))
    x = as_rows(data[0], fits[0].trees)
    for other in fits[1:]:
        assert fits[0].trees.sums(x) == pytest.approx(other.trees.sums(as_rows(data[0], other.trees)), abs=1e-9)


def test_one_label_gives_a_constant(spark, data):
    model = boosting.fit(table(spark, data[0][:20], np.ones(20), 2), boosting.Growth(rounds=3))
    assert len(model.trees.root) == 0
    rows = table(spark, data[0][:5], np.ones(5), 1)
    assert all(r.p > 0.99 for r in rows.withColumn("p", boosting.probability(model)).collect())


def test_margins_are_the_same_when_a_worker_remembers_none(data):
    x, y = data
    bins = boosting.Bins(np.array([0, 2]), np.array([0.0, 1.0]), np.array([0]))
    block = boosting.Block(("run", 0, 0), np.zeros(4, np.int8), np.array([1, 3]), np.array([1, 1]))
    trees = [([0, 0, 0], [0, 0, 0], [1, -1, -1], [2, -1, -1], np.array([0.0, -0.5, 0.25]))] * 3
    first = boosting._margin(block, bins, 0.1, trees[:1])
    assert first == pytest.approx([-0.4, 0.35, -0.4, 0.35])
    step = boosting._margin(block, bins, 0.1, trees)
    boosting._margins.clear()
    assert np.array_equal(step, boosting._margin(block, bins, 0.1, trees))


def test_finding_nodes_of_rows_does_not_copy_the_block():
    import tracemalloc

    size = 1 << 20
    bins = boosting.Bins(np.array([0, 2, 4]), np.array([0.0, 1.0, 0.0, 1.0]), np.array([0, 2]))
    block = boosting.Block(("", 0, 0), np.zeros(100, np.int8), np.arange(size, dtype=np.int32) % 100, np.sort(np.arange(size, dtype=np.int32) % 4))
    tracemalloc.start()
    at = boosting.nodes_of(block, bins, [0, 0, 0], [0, 0, 0], [1, -1, -1], [2, -1, -1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(at.tolist()) <= {1, 2} and peak < 7 * size


def test_features_that_split_alike_are_a_tie_for_the_first():
    """Their gains differ only by how sums are rounded, whichever way they are added up."""
    bins = boosting.Bins(np.array([0, 2, 4]), np.array([0.0, 1.0, 0.0, 1.0]), np.array([0, 2]))
    sums = np.array([[-3.0, -3.0 * (1 + 1e-13)], [5.0, 5.0], [9.0, 9.0]])
    totals = np.array([[2.0], [20.0], [40.0]])
    (_, gain, feature, cut, _, _), = boosting.best_splits(np.array([1, 3]), sums, totals, bins, boosting.Growth())
    assert (feature, cut) == (0, 0) and gain > 0
    block = boosting.Block(("r", 0, 0), np.zeros(40, np.int8), np.arange(18) % 9, np.repeat([1, 3], 9).astype(np.int32))
    cells = boosting.Cells.of(bins, block)
    whole = np.zeros((3, 2, 2))
    whole[:, 1] = sums
    assert boosting._best_split(np.arange(2), whole, totals[:, 0], bins, cells, boosting.Growth())[1:3] == (0, 0)


def test_a_level_goes_through_the_rows_of_smaller_children_only(data, monkeypatch):
    x, y = data
    own = [np.unique(np.append(x[:, f], 0.0)) for f in range(FEATURES)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in own])])
    bins = boosting.Bins(at, np.concatenate(own), np.array([a + np.searchsorted(b, 0.0) for a, b in zip(at, own)]))
    row, feature = np.nonzero(x)
    number = bins.numbers(feature, x[row, feature])
    order = np.argsort(number, kind="stable")
    block = boosting.Block(("r", 0, 0), y.astype(np.int8), row[order], number[order].astype(np.int32))
    seen = []
    of_rows = boosting.Cells.of_rows
    monkeypatch.setattr(boosting.Cells, "of_rows", lambda self, rows, values: seen.append(len(rows)) or of_rows(self, rows, values))
    growth = boosting.Growth(depth=4, least_hessian=1e-3)
    grown = boosting._whole_tree(bins, growth, block, boosting.Cells.of(bins, block), np.zeros(len(y)))
    rows = [t[2] for t in grown.total]
    pairs = [(rows[a], rows[b]) for a, b in zip(grown.left, grown.right) if a >= 0 and grown.depth[a] < 4]
    assert len(seen) > 3 and seen == [min(pair) for pair in pairs if max(pair) > 1]
    leaf = boosting.nodes_of(block, bins, grown.feature, grown.bin, grown.left, grown.right)
    assert all(rows[n] == (leaf == n).sum() for n, left in enumerate(grown.left) if left < 0)


def test_tables_too_large_for_one_task_take_the_passes(spark, data, monkeypatch):
    x, y = data
    rows, growth = table(spark, x, y, 2), boosting.Growth(rounds=2, depth=3)
    monkeypatch.setattr(boosting, "_whole_tree", None)
    monkeypatch.setattr(boosting, "LOCAL_BYTES", 1)
    model = boosting.fit(rows, growth)
    assert len(model.trees.root) == 2


def test_bins_are_quantiles_however_rows_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3)) * (rng.random((3000, 3)) < (1.0, 0.3, 0.0))
    rows = [(Vectors.sparse(3, {int(f): float(r[f]) for f in np.flatnonzero(r)}),) for r in x]

    def bounds(partitions, bins):
        found = boosting.find_bins(spark.createDataFrame(rows, ["features"]).repartition(partitions), 3, bins)
        return [found.bound[a:b] for a, b in zip(found.at[:-1], found.at[1:])]

    exact = [np.sort(c[c != 0]) for c in x.T]
    for partitions in (1, 4):
        # Twenty values a bin are enough to keep all of them: the quantiles are exact.
        for found, own in zip(bounds(partitions, 150), exact):
            places = -(-np.arange(1, 151) * len(own) // 150) - 1
            assert found.tolist() == np.unique([0.0, *own[places[places >= 0]]]).tolist()
        # Fewer are kept, ranks are off by a share of 1 / (20 * bins) at most.
        monkeypatch.setattr(boosting, "SORTED_AT_ONCE", 500)
        few = bounds(partitions, 4)
        assert len(few[2]) == 1
        for found, own in zip(few[:2], exact):
            rank = np.searchsorted(own, found[found != 0], side="right") / len(own)
            assert len(rank) == 4 and np.abs(rank - np.arange(1, 5) / 4).max() <= 1 / 80 + 1 / len(own)


def test_all_rounds_are_one_job_where_one_task_grows_the_trees(spark, data):
    rows = table(spark, *data, 3)
    bins = boosting.find_bins(rows, FEATURES)
    blocks = boosting.write_blocks(rows, bins)
    context = spark.sparkContext
    context.setJobGroup("all rounds", "")
    try:
        model = boosting.fit(rows, boosting.Growth(rounds=60, depth=1), bins, blocks, size=boosting.sizes(blocks))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # One for the sizes, whose sums take a shuffle, and one for the rounds.
    assert len(model.trees.root) == 60
    assert len(context.statusTracker().getJobIdsForGroup("all rounds")) <= 3
    assert boosting.sizes(blocks) == (len(data[1]), int(data[1].sum()))


def test_blocks_are_put_together_with_their_entries_held_once(monkeypatch):
    rng = np.random.default_rng(2)
    blocks = [boosting.Block(("", 0, k), np.full(5, k % 2, np.int8), rng.integers(0, 5, 30).astype(np.int32), np.sort(rng.integers(0, 9, 30)).astype(np.int32))
              for k in range(3)]
    found = sorted((int(b), int(r) + 5 * k) for k, one in enumerate(blocks) for r, b in zip(one.row, one.bin))
    alive, sort = [weakref.ref(b) for b in blocks], np.argsort
    monkeypatch.setattr(boosting.np, "argsort", lambda *a, **k: sort(*a, **k) if not any(r() for r in alive) else pytest.fail("blocks are still held"))
    given = iter([blocks.pop(0) for _ in range(3)])
    block, = boosting._merged(given)
    assert sorted(zip(block.bin.tolist(), block.row.tolist())) == found and block.row.dtype == np.int32
    assert block.bin.tolist() == sorted(block.bin.tolist()) and block.y.tolist() == [0] * 5 + [1] * 5 + [0] * 5
    assert boosting.counted(block.bin, 9).tolist() == np.bincount(block.bin, minlength=9).tolist()


def test_scoring_follows_rows_only_until_they_reach_a_leaf():
    """One chain of 300 nodes: a row that leaves it at the first node is not looked at again."""
    n = 300
    node = np.arange(2 * n + 1)
    left = np.where(node % 2 == 0, node + 1, -1)
    left[-1] = -1
    table = {"feature": np.zeros(len(node)), "threshold": node / 2.0, "left": left, "right": np.where(left < 0, -1, node + 2),
             "value": node.astype(float), "cover": np.ones(len(node)), "gain": np.ones(len(node))}
    trees = Trees.from_tables([table, {c: v[-1:] for c, v in table.items()}])
    x = np.append(np.zeros(2000), n + 1.0)[:, None]
    rows = as_rows(x, trees)
    class Counted(np.ndarray):
        looked_up = 0

        def take(self, places, *a, **k):
            Counted.looked_up += np.size(places)
            return np.asarray(self).take(places, *a, **k)

        def __getitem__(self, places):
            Counted.looked_up += np.size(places)
            return np.asarray(self)[places]

    trees.threshold = trees.threshold.view(Counted)
    leaves = trees.leaves_of(rows)
    assert leaves[:-1].tolist() == [[1, 2 * n + 1]] * 2000 and leaves[-1].tolist() == [2 * n, 2 * n + 1]
    assert Counted.looked_up == 2000 + n


def test_a_model_is_sent_to_the_workers_once_without_what_scoring_does_not_need(spark, data):
    model = boosting.fit(table(spark, *data, 2), boosting.Growth(rounds=3, depth=2))
    sent = boosting.shared(model)
    first, again = (boosting.probability(model) for _ in range(2))
    assert boosting.shared(model) is sent and sent.value.model.trees is None and not len(sent.value.whole.trees.gain)
    assert len(model.trees.gain) and (sent.value.whole.importance == model.importance).all()
    assert all(r.p == r.q for r in table(spark, *data, 2).select(first.alias("p"), again.alias("q")).collect())


def test_packed_trees_score_alike_in_few_bytes(small):
    trees, x, _ = small
    rows = as_rows(x, trees)
    assert (trees.packed().unpacked().sums(rows) == trees.sums(rows)).all()
    # Children that do not stand side by side, as above, and a deep forest whose children do.
    assert len(trees.packed().children) == 2
    n = 20_000
    node = np.arange(2 * n + 1)
    left = np.where(node % 2 == 0, node + 1, -1)
    left[-1] = -1
    chain = Trees.from_tables([{
        "feature": node % 7, "threshold": node % 50 / 2.0, "left": left, "right": np.where(left < 0, -1, node + 2),
        "value": (node % 3).astype(float), "cover": np.ones(len(node)), "gain": np.ones(len(node))}])
    packed = chain.packed()
    assert len(pickle.dumps(packed)) * 6 < len(pickle.dumps(chain)) and len(packed.children) == 1
    again, leaf = packed.unpacked(), chain.left < 0
    for name in ("root", "left", "right"):
        assert (getattr(again, name) == getattr(chain, name)).all()
    assert (again.value[leaf] == chain.value[leaf]).all()
    assert (again.feature[~leaf] == chain.feature[~leaf]).all() and (again.threshold[~leaf] == chain.threshold[~leaf]).all()
    alone = Trees.from_tables([{c: v[-1:] for c, v in {"feature": node, "threshold": node, "left": left, "right": left, "value": node,
                                                        "cover": node, "gain": node}.items()}])
    assert alone.packed().unpacked().value.tolist() == alone.value.tolist()


def test_nodes_are_saved_some_at_a_time(spark, small, tmp_path, monkeypatch):
    trees, x, _ = small
    monkeypatch.setattr(trees_module, "SAVED_AT_ONCE", 7)
    trees_module.save(trees, spark, str(tmp_path / "nodes"))
    assert len(list((tmp_path / "nodes").glob("*.parquet"))) == -(-len(trees.left) // 7)
    again = Trees.from_rows(spark.read.parquet(str(tmp_path / "nodes")))
    assert all((getattr(again, c) == getattr(trees, c)).all() for c in ("root", "feature", "threshold", "left", "right", "value", "cover"))


def test_vectors_are_unpacked_some_rows_at_a_time(spark, data, monkeypatch):
    x, y = data
    rows = table(spark, x, y, 1)
    bins = boosting.find_bins(rows, FEATURES, bins=200)
    whole = boosting.write_blocks(rows, bins).collect()
    vectors = rows.select("features").toArrow().column("features").combine_chunks()
    sizes, unpack = [], boosting.entries
    monkeypatch.setattr(boosting, "entries", lambda part: sizes.append(len(part)) or unpack(part))
    monkeypatch.setattr(boosting, "UNPACKED_ROWS", 64)
    row, feature, value = map(np.concatenate, zip(*boosting.held_values(vectors)))
    assert max(sizes) == 64 and sum(sizes) == len(x)
    own = np.nonzero(x)
    assert sorted(zip(row, feature, value)) == sorted(zip(*own, x[own]))
    assert boosting.write_blocks(rows, bins).collect() == whole
