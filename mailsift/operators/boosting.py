"""Second-order gradient boosting on binned sparse features (M2, M3).

Rows are written once as blocks of bin numbers, sorted by bin within a block, with zeros left out. A level of
a tree is one pass: every task sums gradients and hessians of its rows by (node, bin), sends each range of
features to one task, and there the sums over all rows give the best split of every node in that range;
the driver sees one candidate per node and range. Leaves take Newton values with L2. Zeros are what a node holds
besides the entries. A tree's splits do not depend on the order in which its nodes are split, so
best-leaf-first growth picks from the same level-wise candidates, best gain first.

The passes are short and many (rounds times depth), which is why blocks are an RDD and not planned anew as SQL
each time. Where all rows fit one block of ``LOCAL_ROWS``, a pass costs more than its work, and all rounds are one task
that goes through the same levels by itself; different models are still fitted side by side. A row's margin follows from the trees so far. Workers remember the margins of blocks with
the number of trees in them and add what is missing; a worker that knows none starts from the first tree, with the
same result.
"""

from __future__ import annotations

import copy
import heapq
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators import kernels
from mailsift.operators.trees import NODE_SCHEMA, Packed, Trees, entries, rows_of, save
from mailsift.workspace import give_back, given_back, materialise, run_dir

BINS = 32
BLOCK_ROWS = 8192
# Up to so many rows are one block, whose trees are grown in one task each.
LOCAL_ROWS = 1 << 16
# Ranges of features whose splits are searched in different tasks.
RANGES = 8
# Ranges of features whose quantiles are found in different tasks, and values that are sorted at once, about.
BIN_RANGES, SORTED_AT_ONCE = 64, 1 << 19
# Rows whose vectors are unpacked at once.
UNPACKED_ROWS = 1 << 10
# Trees that travel with a pass before they are sent around once for all.
RECENT = 20
# Entries that it adds up at once, about.
RUN_ENTRIES = 1 << 16
# Sums of a level's nodes that such a task may hold, in bytes.
LOCAL_BYTES = 1 << 29
# Gains that differ by less than this share are equal.
TIE = 1e-9
# Margins that a worker remembers, in bytes.
REMEMBERED = 64 << 20


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` bounds them best first; None takes every split that gains."""

    rounds: int = 200
    depth: int = 6
    step: float = 0.1
    l2: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 1
    leaves: int | None = None
    least_gain: float = 1e-9


@dataclass(eq=False)
class Boosted:
    """A fitted model: base margin, trees whose values include the step."""

    base: float
    trees: Trees
    features: int
    importance: np.ndarray = field(init=False)

    def __post_init__(self):
        self.importance = self.trees.importance(self.features)

    def margins(self, vectors: pa.Array) -> np.ndarray:
        return self.base + self.trees.sums(rows_of(vectors, self.trees.used))

    def scores(self, vectors: pa.Array) -> np.ndarray:
        return sigmoid(self.margins(vectors))

    def save(self, spark: SparkSession, path: str) -> None:
        save(self.trees, spark, f"{path}/nodes")
        head = spark.createDataFrame([(self.base, self.features)], "base double, features int")
        head.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Boosted":
        head = spark.read.parquet(f"{path}/metadata").first()
        return cls(head.base, Trees.from_rows(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")), head.features)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Sent:
    """A model on its way to the workers, which unpack its trees once."""

    model: object  # without its trees
    trees: Packed

    @classmethod
    def of(cls, model) -> "Sent":
        rest = copy.copy(model)
        rest.trees = None
        return cls(rest, model.trees.packed())

    @cached_property
    def whole(self):
        out = copy.copy(self.model)
        out.trees = self.trees.unpacked()
        return out


# By the models themselves; an entry goes with its model.
_shared: "WeakKeyDictionary[object, tuple[str, Broadcast]]" = WeakKeyDictionary()


def shared(model) -> Broadcast:
    """What scoring needs of a model, sent around once for all tables that it scores; workers keep it between tasks."""
    context = SparkContext.getOrCreate()
    if _shared.get(model, (None,))[0] != context.applicationId:
        _shared[model] = context.applicationId, context.broadcast(Sent.of(model))
    return _shared[model][1]


def probability(model, column: str = "features"):
    """Column of the ``scores`` of a model, in Arrow batches."""
    rows_at_once, sent = 512, shared(model)

    def scored(vectors: pa.Array) -> pa.Array:
        whole = sent.value.whole
        parts = [whole.scores(vectors.slice(i, rows_at_once)) for i in range(0, len(vectors), rows_at_once)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(scored, "double")(column)


# --- bins


@dataclass
class Bins:
    """Upper bounds of the bins of every feature, end to end; feature f has those from ``at[f]`` to ``at[f + 1]``."""

    at: np.ndarray
    bound: np.ndarray
    zero: np.ndarray  # bin of the value 0, for each feature
    feature: np.ndarray = field(init=False)  # of each bin

    def __post_init__(self):
        self.feature = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def numbers(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Bins of values: in each feature the first whose bound is not below the value."""
        order = by_feature(feature, value)
        out = np.empty(len(value), np.int64)
        f, v = feature[order], value[order]
        cuts = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(f)]):
            low, high = self.at[f[a]], self.at[f[a] + 1]
            out[a:b] = low + np.minimum(np.searchsorted(self.bound[low:high], v[a:b]), high - low - 1)
        numbers = np.empty(len(value), np.int64)
        numbers[order] = out
        return numbers


def find_bins(rows: DataFrame, features: int, bins: int = BINS) -> Bins:
    """Quantiles of the values other than zero of each feature, and zero itself. Their ranks are off by a share of 1 / (20 * bins) at most.

    Tasks sort their values by feature and send at most 20 * bins of each feature, by ranges of features.
    """

    def summaries(batches):
        held, count = [], 0
        for batch in batches:
            for _, feature, value in held_values(batch.column("features")):
                held.append((feature, value))
                count += len(feature)
                if count >= SORTED_AT_ONCE:
                    yield from summary(held)
                    held, count = [], 0
        if count:
            yield from summary(held)

    def summary(held):
        feature, value, weight = thinned(*map(np.concatenate, zip(*held)), 20 * bins)
        cuts = np.searchsorted(feature, np.linspace(0, features, BIN_RANGES + 1).astype(int))
        ranges = [pa.array([a[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]) for a in (feature, value, weight)]
        yield pa.record_batch([pa.array(range(BIN_RANGES)), *ranges], ["part", "feature", "value", "weight"])

    def merged(table):
        whole = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in table.column(name).to_pylist()])
        feature, bounds = quantiles(whole("feature", np.int64), whole("value", np.float64), whole("weight", np.int64), bins)
        return pa.table({"feature": pa.array(feature), "bounds": pa.array(list(bounds), pa.list_(pa.float64()))})

    parts = rows.select("features").mapInArrow(lambda batches: given_back(summaries(batches)), "part bigint, feature binary, value binary, weight binary")
    found = parts.groupBy("part").applyInArrow(merged, "feature bigint, bounds array<double>").toArrow()
    bounds = dict(zip(found.column("feature").to_pylist(), found.column("bounds").to_pylist()))
    own = [np.unique([0.0, *bounds.get(f, [])]) for f in range(features)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in own])])
    bound = np.concatenate(own)
    zero = np.array([at[f] + np.searchsorted(b, 0.0) for f, b in enumerate(own)])
    return Bins(at, bound, zero)


def held_values(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, feature and value of what vectors hold besides zeros, for some rows at a time: workers keep the memory that a batch took."""
    for start in range(0, len(vectors), UNPACKED_ROWS):
        row, feature, value = entries(vectors.slice(start, UNPACKED_ROWS))
        keep = value != 0
        yield row[keep] + start, feature[keep], value[keep]


def by_feature(feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by feature and value."""
    order = np.argsort(value)
    # Numbers of 16 bits are sorted by radix.
    return order[np.argsort(feature[order].astype(np.uint16 if feature.max(initial=0) < 1 << 16 else np.int64), kind="stable")]


def thinned(feature: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By feature and value, at most so many values of each feature: the last of runs of equal length, and how many values each stands for."""
    order = by_feature(feature, value)
    feature, value = feature[order], value[order]
    size = np.diff(np.append(np.flatnonzero(np.append(True, feature[1:] != feature[:-1])), len(feature)))
    rank = np.arange(len(feature)) - np.repeat(np.cumsum(size) - size, size)
    size = np.repeat(size, size)
    kept = np.flatnonzero((rank + 1) * most // size > rank * most // size)
    return feature[kept], value[kept], np.diff(kept, prepend=-1)


def quantiles(feature: np.ndarray, value: np.ndarray, weight: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Features, and for each its values at the shares 1 / bins, 2 / bins, ..., 1."""
    order = by_feature(feature, value)
    feature, value, upto = feature[order], value[order], np.cumsum(weight[order])
    first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, np.int64)
    before = upto[first] - weight[order][first]
    size = np.diff(np.append(before, upto[-1:]))
    wanted = before[:, None] - size[:, None] * np.arange(1, bins + 1) // -bins
    return feature[first], value[np.searchsorted(upto, wanted)]


def write_blocks(rows: DataFrame, bins: Bins, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``n, positive, y, row, bin``: blocks of rows with the bins of their entries, by bin."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bins)

    def packed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                found = [(row.astype(np.int32), shared.value.numbers(feature, value).astype(np.int32))
                         for row, feature, value in held_values(part.column("features"))]
                row, number = map(np.concatenate, zip(*found))
                order = np.argsort(number, kind="stable")
                y = np.asarray(part.column("y")).astype(np.int8)
                yield pa.record_batch(
                    [pa.array([part.num_rows]), pa.array([int(y.sum())]), pa.array([y.tobytes()]),
                     pa.array([row[order].tobytes()]), pa.array([number[order].tobytes()])],
                    ["n", "positive", "y", "row", "bin"])

    blocks = rows.select("features", "y").mapInArrow(lambda batches: given_back(packed(batches)), "n bigint, positive bigint, y binary, row binary, bin binary")
    return materialise(blocks, f"{run_dir(spark, 'blocks')}/table")


# --- passes over the blocks


@dataclass
class Block:
    key: tuple
    y: np.ndarray
    row: np.ndarray
    bin: np.ndarray


@dataclass
class Grown:
    """A tree under growth: parallel lists, children -1 while a node is a leaf."""

    feature: list
    bin: list
    left: list
    right: list
    total: list  # (gradient, hessian, rows) of each node
    gain: list
    depth: list

    @classmethod
    def start(cls) -> "Grown":
        return cls([0], [0], [-1], [-1], [None], [0.0], [0])

    def split(self, node: int, feature: int, bin_: int, gain: float, left_total) -> None:
        self.feature[node], self.bin[node], self.gain[node] = feature, bin_, gain
        whole = self.total[node]
        for side, total in (("left", left_total), ("right", tuple(a - b for a, b in zip(whole, left_total)))):
            getattr(self, side)[node] = len(self.left)
            for name, value in (("feature", 0), ("bin", 0), ("left", -1), ("right", -1), ("total", total), ("gain", 0.0),
                                ("depth", self.depth[node] + 1)):
                getattr(self, name).append(value)


    def tree(self, growth: Growth) -> tuple:
        """Features, bins, children and leaf values, as margins are summed from."""
        total = np.array(self.total)
        leaf = -growth.step * total[:, 0] / (total[:, 1] + growth.l2)
        return self.feature, self.bin, self.left, self.right, np.where(np.array(self.left) < 0, leaf, 0.0)


def _send(block: Block, bins: Bins, at: np.ndarray, node: int, f: int, cut: int, left: int, right: int) -> None:
    """Move the rows that are at a node to its children."""
    # Keys of another type would have the whole block converted.
    a, b = np.searchsorted(block.bin, np.array((bins.at[f], bins.at[f + 1]), block.bin.dtype))
    here = at == node
    at[here] = left if bins.zero[f] <= cut else right
    held = block.row[a:b]
    mine = here[held]
    at[held[mine]] = np.where(block.bin[a:b][mine] <= cut, left, right)


def nodes_of(block: Block, bins: Bins, feature, bin_, left, right) -> np.ndarray:
    """Node that each row has reached; parents stand before their children."""
    at = np.zeros(len(block.y), np.int32)
    for node in range(len(left)):
        if left[node] >= 0:
            _send(block, bins, at, node, feature[node], bin_[node], left[node], right[node])
    return at


_margins: "OrderedDict[tuple, tuple[int, np.ndarray]]" = OrderedDict()


def _margin(block: Block, bins: Bins, base: float, trees: list) -> np.ndarray:
    """Margins of a block's rows under all trees, from what this worker remembers of it."""
    done, margin = _margins.pop(block.key, (0, None))
    if margin is None or done > len(trees):
        done, margin = 0, np.full(len(block.y), base)
    for feature, bin_, left, right, value in trees[done:]:
        margin = margin + value[nodes_of(block, bins, feature, bin_, left, right)]
    _margins[block.key] = len(trees), margin
    while len(_margins) > 1 and sum(m.nbytes for _, m in _margins.values()) > REMEMBERED:
        _margins.popitem(last=False)
    return margin


@dataclass
class _Pass:
    """What a pass over the blocks needs; ``slots`` numbers the nodes to be split, -1 for the others."""

    bins: object
    base: float
    older: object
    recent: list
    partial: tuple
    slots: np.ndarray
    edges: np.ndarray  # first bin of each range of features, and the end

    def sums(self, number: int, blocks):
        """(range, (task, totals, cells, sums)) of one task's blocks; a cell is slot * bins + bin, sums are three rows."""
        bins, trees = self.bins.value, [*(self.older.value if self.older else []), *self.recent]
        width, count = int(bins.at[-1]), int(self.slots.max()) + 1
        totals, cells, sums = np.zeros((3, count)), [], []
        for block in blocks:
            p = sigmoid(_margin(block, bins, self.base, trees))
            slot = self.slots[nodes_of(block, bins, *self.partial)]
            values = np.stack([p - block.y, p * (1 - p), np.ones(len(p))])
            own = slot >= 0
            for k in range(3):
                totals[k] += np.bincount(slot[own], values[k, own], count)
            # Entries come by bin, so a stable order by slot is one by cell.
            entry = slot[block.row]
            order = np.argsort(entry, kind="stable")
            order = order[np.searchsorted(entry[order], 0) :]
            cell = entry[order].astype(np.int64) * width + block.bin[order]
            cells.append(cell)
            sums.append(values[:, block.row[order]])
        if not cells:
            return
        cell, sums = added_up(np.concatenate(cells), np.concatenate(sums, axis=1), len(cells) == 1)
        if len(self.edges) == 2:
            yield 0, (number, totals, cell, sums)
            return
        where = cell % width
        for r in range(len(self.edges) - 1):
            part = (where >= self.edges[r]) & (where < self.edges[r + 1])
            yield r, (number, totals, cell[part], sums[:, part])

    def whole_trees(self, growth: Growth, block: Block, count: int) -> list[Grown]:
        """The next trees, grown in this task."""
        bins, trees, found = self.bins.value, [*(self.older.value if self.older else []), *self.recent], []
        cells = Cells.of(bins, block)
        give_back()
        for _ in range(count):
            found.append(_whole_tree(bins, growth, block, cells, _margin(block, bins, self.base, trees)))
            trees.append(found[-1].tree(growth))
        return found

    def best(self, growth: Growth, parts):
        """(slot, gain, feature, bin, left totals, totals): the best split of each node in a range."""
        by_range: dict[int, list] = {}
        for r, part in parts:
            by_range.setdefault(r, []).append(part)
        for _, found in sorted(by_range.items()):
            # In the order of the tasks, so that sums are always rounded alike.
            found.sort(key=lambda x: x[0])
            cell, sums = added_up(
                np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found], axis=1), len(found) == 1)
            yield from best_splits(cell, sums, sum(f[1] for f in found), self.bins.value, growth)


@dataclass
class Cells:
    """A block's entries for the task that grows whole trees. Cell ``place * features + feature`` is a bin by its place in its feature, so
    that sums over places are sums of whole rows of numbers."""

    places: int  # most bins of a feature
    features: int
    cell_of: np.ndarray  # of each bin
    zero: np.ndarray  # places x features: 1 from the bin of zero on
    runs: list  # of consecutive bins: their cells, their entries' first and last place, where those of each bin begin
    count: np.ndarray  # entries of each cell
    row: np.ndarray  # of each entry, by bin
    start: np.ndarray  # of each row's entries in ``cell``, and how many there are
    size: np.ndarray
    cell: np.ndarray  # of each entry, by row

    @classmethod
    def of(cls, bins: Bins, block: Block) -> "Cells":
        features, width = len(bins.at) - 1, int(bins.at[-1])
        places = int(np.diff(bins.at).max(initial=1))
        cell_of = (np.arange(width) - bins.at[bins.feature]) * features + bins.feature
        zero = (np.arange(places)[:, None] >= (bins.zero - bins.at[:-1])[None, :]).astype(float)
        held = counted(block.bin, width)
        entered = np.flatnonzero(held)
        count = np.zeros(places * features)
        count[cell_of] = held
        begin = np.append(np.cumsum(held[entered]) - held[entered], len(block.row))
        runs, first = [], 0
        while first < len(entered):
            end = max(first + 1, int(np.searchsorted(begin, begin[first] + RUN_ENTRIES, side="right")) - 1)
            runs.append((cell_of[entered[first:end]], int(begin[first]), int(begin[end]), begin[first:end] - begin[first]))
            first = end
        # Numbers of 16 bits are sorted by radix, and are less to read in each round.
        row = block.row.astype(np.uint16) if len(block.y) <= 1 << 16 else block.row
        order = np.argsort(row, kind="stable")
        size = counted(block.row, len(block.y))
        cell = cell_of.astype(np.int32).take(block.bin.take(order))
        return cls(places, features, cell_of, zero, runs, count, row, np.cumsum(size) - size, size, cell)

    def of_all(self, values: np.ndarray) -> np.ndarray:
        """Three sums of each cell over all rows, by place and feature. A run's numbers stay in the processor's cache."""
        sums = np.zeros((3, self.places * self.features))
        for cells, a, b, begin in self.runs:
            row = self.row[a:b].astype(np.intp)
            for k in range(2):
                sums[k, cells] = np.add.reduceat(values[k].take(row), begin)
        sums[2] = self.count
        return sums.reshape(3, self.places, self.features)

    def of_rows(self, row: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The same over some rows."""
        size = self.size[row]
        upto = np.cumsum(size)
        cell = self.cell[np.arange(upto[-1] if len(row) else 0) + np.repeat(self.start[row] - upto + size, size)].astype(np.intp)
        whole = self.places * self.features
        sums = [*[np.bincount(cell, np.repeat(v[row], size), whole) for v in values[:2]], np.bincount(cell, minlength=whole)]
        return np.stack(sums).reshape(3, self.places, self.features)


def counted(number: np.ndarray, length: int) -> np.ndarray:
    """How often each number occurs; some at a time, as they are made numbers of 64 bits."""
    out = np.zeros(length, np.int64)
    for i in range(0, len(number), RUN_ENTRIES << 4):
        out += np.bincount(number[i : i + (RUN_ENTRIES << 4)], minlength=length)
    return out


def _whole_tree(bins: Bins, growth: Growth, block: Block, cells: Cells, margin: np.ndarray) -> Grown:
    """A tree whose passes stay in one task. Of two children only the rows of the smaller one are gone through, the other is the rest."""
    p = sigmoid(margin)
    values = np.stack([p - block.y, p * (1 - p), np.ones(len(p))])
    total_of = {0: values.sum(axis=1)}
    held = {0: (np.arange(cells.features), cells.of_all(values))}  # features and their sums, of nodes that may be split
    at = np.zeros(len(p), np.int32)

    def divisible(node):
        _, hessian, rows = total_of[node]
        return hessian >= growth.least_hessian and rows >= 2 * growth.least_rows

    def children(grown, node, n):
        _send(block, bins, at, node, grown.feature[node], grown.bin[node], n, n + 1)
        total_of[n], total_of[n + 1] = np.array(grown.total[n]), np.array(grown.total[n + 1])
        feature, rest = held.pop(node)
        small, large = (n, n + 1) if grown.total[n][2] <= grown.total[n + 1][2] else (n + 1, n)
        if not divisible(small) and not divisible(large):
            return
        part = cells.of_rows(np.flatnonzero(at == small), values)
        if len(feature) < cells.features:
            part = part.take(feature, axis=2)
        if divisible(large):
            rest -= part
            held[large] = feature, rest
        if divisible(small):
            held[small] = feature, part

    def pass_over(grown, slots):
        level = np.flatnonzero(slots >= 0).tolist()
        if level != [0]:
            parent_of = {left: node for node, left in enumerate(grown.left) if left >= 0}
            for n in level[::2]:
                children(grown, parent_of[n], n)
        for slot, node in enumerate(level):
            found = None
            if node in held:
                held[node] = _enough(*held[node], growth)
                found = _best_split(*held[node], total_of[node], bins, cells, growth)
            if found is None:
                held.pop(node, None)
                found = 0.0, -1, -1, None
            gradient, hessian, rows = total_of[node].tolist()
            yield slot, *found, (gradient, hessian, float(np.round(rows)))

    return grow(growth, pass_over)


def _enough(feature: np.ndarray, sums: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray]:
    """The features that could split the node, or one below it: one side of a split holds no zeros, so what is not zero must be enough
    for a side, and below a node it is no more."""
    enough = (sums[1].sum(axis=0) >= growth.least_hessian) & (sums[2].sum(axis=0) >= growth.least_rows)
    return (feature, sums) if enough.all() else (feature[enough], sums.take(np.flatnonzero(enough), axis=2))


def _best_split(feature: np.ndarray, sums: np.ndarray, totals: np.ndarray, bins: Bins, cells: Cells, growth: Growth):
    """(gain, feature, bin, left totals) as ``best_splits`` gives them, of one node; None if nothing gains.

    A bin without rows is a tie with the one before.
    """
    if not len(feature):
        return None
    zero = cells.zero if len(feature) == cells.features else cells.zero.take(feature, axis=1)
    # Sums up to and with each bin within its feature; the rest of the node is in the bin of zero.
    run = sums.copy()
    for place in range(1, cells.places):
        run[:, place] += run[:, place - 1]
    for k in range(3):
        run[k] += zero * (totals[k] - run[k, -1])
    g, h, n = run
    gt, ht, nt = totals
    allowed = (h >= growth.least_hessian) & (h <= ht - growth.least_hessian)
    allowed &= n >= growth.least_rows
    allowed &= n <= nt - growth.least_rows
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g
        gain /= h + growth.l2
        other = gt - g
        other *= other
        other /= (ht + growth.l2) - h
        gain += other
    gain -= gt * gt / (ht + growth.l2)
    np.copyto(gain, -np.inf, where=~allowed)
    most = gain.max()
    if not most > growth.least_gain:
        return None
    place, column = np.nonzero(gain >= most - TIE * abs(most))
    first = np.lexsort((place, column))[0]
    place, column = int(place[first]), int(column[first])
    one = int(feature[column])
    left = float(g[place, column]), float(h[place, column]), float(np.round(n[place, column]))
    return float(gain[place, column]), one, int(bins.at[one]) + place, left


def added_up(cell: np.ndarray, sums: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, in order, with its values added up."""
    if not ordered:
        order = np.argsort(cell, kind="stable")
        cell, sums = cell[order], sums[:, order]
    if not len(cell):
        return cell, sums
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return cell[start], np.add.reduceat(sums, start, axis=1)


def _slots(cell: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and bin of cells in order."""
    slot = np.repeat(np.arange(count), np.diff(np.searchsorted(cell, np.arange(count + 1) * width)))
    return slot, cell - slot * width


def first_best(gain: np.ndarray) -> int:
    """The first of the highest gains. Features that split alike differ by how their sums were rounded, so that much counts as equal."""
    most = gain.max()
    return int(np.argmax(gain >= most - TIE * abs(most))) if np.isfinite(most) else 0


def best_splits(cell: np.ndarray, sums: np.ndarray, totals: np.ndarray, bins: Bins, growth: Growth):
    """The best split of each node among the features that its cells hold; ties go to the first feature and bin.

    A feature of which a node holds nothing but zeros cannot split it. Zeros are the rest of the node.
    """
    width, count = int(bins.at[-1]), totals.shape[1]
    slot, bin_ = _slots(cell, width, count)
    feature = bins.feature[bin_]
    start = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1]))) if len(cell) else np.zeros(0, int)
    if len(start):
        # One side of a split holds no zeros, so what is not zero must be enough for a side.
        full = np.add.reduceat(sums, start, axis=1)
        enough = (full[1] >= growth.least_hessian) & (np.round(full[2]) >= growth.least_rows)
        keep = np.repeat(enough, np.diff(np.append(start, len(cell))))
        cell, sums, slot, feature = cell[keep], sums[:, keep], slot[keep], feature[keep]
        size = np.diff(np.append(start, len(keep)))[enough]
        start, full = np.cumsum(size) - size, full[:, enough]
    if len(start):
        rest = totals[:, slot[start]] - full
        zero = slot[start].astype(np.int64) * width + bins.zero[feature[start]]
        at = np.searchsorted(cell, zero)
        held = (at < len(cell)) & (cell[np.minimum(at, len(cell) - 1)] == zero)
        sums[:, at[held]] += rest[:, held]
        cell, sums = np.insert(cell, at[~held], zero[~held]), np.insert(sums, at[~held], rest[:, ~held], axis=1)
        slot, bin_ = _slots(cell, width, count)
        feature = bins.feature[bin_]
        new = np.append(True, (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1]))
        run = np.cumsum(sums, axis=1)
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        # Sums up to and with each bin within its feature.
        g, h, n = run - (run - sums)[:, start][:, group]
    else:
        g = h = n = np.zeros(0)
    gt, ht, nt = totals[:, slot]
    allowed = (np.round(n) >= growth.least_rows) & (np.round(nt - n) >= growth.least_rows) & (
        h >= growth.least_hessian) & (ht - h >= growth.least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / (h + growth.l2) + (gt - g) ** 2 / (ht - h + growth.l2) - gt * gt / (ht + growth.l2)
    gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
    # The first of the highest gains of each node that has any.
    edges = np.searchsorted(slot, np.arange(count + 1))
    held = np.flatnonzero(edges[1:] > edges[:-1])
    most, best = np.full(count, -np.inf), np.zeros(count, np.int64)
    if len(held):
        most[held] = np.maximum.reduceat(gain, edges[held])
        equal = np.flatnonzero(gain >= (most - TIE * np.abs(most))[slot])
        best[held] = equal[np.searchsorted(equal, edges[held])]
    picked = best[held]
    most[held] = gain[picked]
    splits = np.flatnonzero(np.isfinite(most) & (most > growth.least_gain)).tolist()
    best = best[splits]
    found = dict(zip(splits, zip(gain[best].tolist(), feature[best].tolist(), bin_[best].tolist(),
                                 zip(g[best].tolist(), h[best].tolist(), np.round(n[best]).tolist()))))
    for s, total in enumerate(zip(totals[0].tolist(), totals[1].tolist(), np.round(totals[2]).tolist())):
        yield s, *found.get(s, (0.0, -1, -1, None)), total


def best_first(grown: Grown, leaves: int) -> Grown:
    """The tree of at most so many leaves that splits the leaf of the highest gain first."""
    out = Grown.start()
    out.total[0] = grown.total[0]
    waiting = [(-grown.gain[0], 0, 0)] if grown.left[0] >= 0 else []
    count = 1
    while waiting and count < leaves:
        _, old, new = heapq.heappop(waiting)
        out.split(new, grown.feature[old], grown.bin[old], grown.gain[old], grown.total[grown.left[old]])
        count += 1
        for side in ("left", "right"):
            child = getattr(grown, side)[old]
            if grown.left[child] >= 0:
                heapq.heappush(waiting, (-grown.gain[child], child, getattr(out, side)[new]))
    return out


def grow(growth: Growth, pass_over) -> Grown:
    """One tree; ``pass_over(grown, slots)`` gives the candidates that ``best_splits`` found."""
    grown, level = Grown.start(), [0]
    for depth in range(growth.depth):
        slots = np.full(len(grown.left), -1, np.int16)
        slots[level] = np.arange(len(level))
        best: dict[int, list] = {}
        for slot, gain, feature, bin_, left, total in pass_over(grown, slots):
            if depth == 0:
                grown.total[0] = total
            if feature >= 0:
                best.setdefault(slot, []).append((feature, bin_, gain, left))
        before = len(grown.left)
        for slot, found in sorted(best.items()):
            found.sort(key=lambda x: x[:2])
            feature, bin_, gain, left = found[first_best(np.array([x[2] for x in found]))]
            grown.split(level[slot], feature, bin_, gain, left)
        level = list(range(before, len(grown.left)))
        if not level:
            break
    return best_first(grown, growth.leaves) if growth.leaves else grown


def joined(blocks: list[Block]) -> Block:
    """Blocks as one, by bin as each of them is. Entries are put in their places block by block, and a block that is done is let go;
    the list is empty afterwards."""
    key, y = blocks[0].key, np.concatenate([b.y for b in blocks])
    width = 1 + max((int(b.bin[-1]) for b in blocks if len(b.bin)), default=-1)
    sizes = [counted(b.bin, width) for b in blocks]
    whole = sum(sizes)
    at, first = np.cumsum(whole) - whole, 0
    row, number = np.empty(int(whole.sum()), np.int32), np.repeat(np.arange(width, dtype=np.int32), whole)
    for size in sizes:
        block = blocks.pop(0)
        place = np.repeat(at - np.cumsum(size) + size, size)
        place += np.arange(len(place))
        row[place] = block.row + np.int32(first)
        at, first = at + size, first + len(block.y)
    return Block(key, y, row, number)


def _merged(blocks) -> list[Block]:
    """All blocks of a task as one."""
    blocks = list(blocks)
    return blocks if len(blocks) < 2 else [joined(blocks)]


def sizes(blocks: DataFrame) -> tuple[int, int]:
    """Rows of all blocks, and how many of them have label 1."""
    found = blocks.agg(F.sum("n"), F.sum("positive")).first()
    return found[0] or 0, found[1] or 0


def fit(rows: DataFrame, growth: Growth, bins: Bins | None = None, blocks: DataFrame | None = None,
        local_rows: int = LOCAL_ROWS, size: tuple[int, int] | None = None, table: kernels.Table | None = None) -> Boosted:
    """Fit to ``features`` and ``y`` (0 or 1). Nulls are not allowed; rows may repeat.

    ``bins``, ``blocks`` and their ``sizes`` may be shared by several fits. Without rows of both labels the model is a constant.
    A ``table`` of the blocks has all rounds in one task beside which Java runs, of whatever size the table is.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if bins is None:
        one = rows.select("features").first()
        bins = find_bins(rows, one.features.size if one else 0)
    if blocks is None:
        blocks = write_blocks(rows, bins)
    features = len(bins.at) - 1
    run = uuid.uuid4().hex

    def decoded(number, part):
        for i, r in enumerate(part):
            yield Block((run, number, i), np.frombuffer(r.y, np.int8), np.frombuffer(r.row, np.int32), np.frombuffer(r.bin, np.int32))

    n, positive = size or sizes(blocks)
    if table is not None and 0 < positive < n:
        return _fit_beside(table, growth, bins, _base(n, positive))
    held = blocks.rdd.mapPartitionsWithIndex(decoded)
    local = n <= local_rows and 24 * features * int(np.diff(bins.at).max(initial=1)) << max(growth.depth - 1, 0) <= LOCAL_BYTES
    # One task reads the blocks once; passes read them again and again.
    held = held.coalesce(1).mapPartitions(_merged) if local else held.persist(StorageLevel.MEMORY_AND_DISK)
    base = _base(n, positive)
    trees: list[tuple] = []
    tables: list[dict] = []
    shared, older, sent = context.broadcast(bins), None, 0
    ranges = min(1 if local else RANGES, max(features, 1))
    edges = bins.at[np.linspace(0, features, ranges + 1).astype(int)]

    def work(grown, slots):
        return _Pass(shared, base, older, trees[sent:], (grown.feature, grown.bin, grown.left, grown.right), slots, edges)

    def pass_over(grown, slots):
        one = work(grown, slots)
        return held.mapPartitionsWithIndex(one.sums).partitionBy(ranges).mapPartitions(lambda p: one.best(growth, p)).collect()

    rounds = growth.rounds if 0 < positive < n else 0
    while len(trees) < rounds:
        if len(trees) - sent >= RECENT:
            older, sent = context.broadcast(list(trees)), len(trees)
        if local:
            # One task: parts of it would wait for the other models' tasks in between.
            first = work(Grown.start(), np.zeros(1, np.int16))
            new = held.mapPartitions(lambda blocks: [first.whole_trees(growth, b, rounds) for b in blocks]).first()
        else:
            new = [grow(growth, pass_over)]
        for grown in new:
            trees.append(grown.tree(growth))
            tables.append(_table(grown, growth, bins))
    if not local:
        held.unpersist()
    return Boosted(base, Trees.from_tables(tables), features)


def _base(n: int, positive: int) -> float:
    """Margin before the first tree."""
    share = min(max(positive / max(n, 1), 1e-12), 1 - 1e-12)
    return float(np.log(share / (1 - share)))


def _table(grown: Grown, growth: Growth, bins: Bins) -> dict[str, np.ndarray]:
    feature, bin_, left, right, value = map(np.array, grown.tree(growth))
    total = np.array(grown.total)
    return {
        "feature": feature, "threshold": bins.bound[bin_], "left": left, "right": right, "value": value,
        "cover": total[:, 2] if growth.leaves else total[:, 1], "gain": np.array(grown.gain)}


def _fit_beside(table: kernels.Table, growth: Growth, bins: Bins, base: float) -> Boosted:
    """All rounds in one task, as ``whole_trees`` grows them."""
    sent = table.sent()
    # Sums of a level's nodes, of those that wait to be used again and of the candidates.
    extra = 24 * int(bins.at[-1]) * ((1 << growth.depth) + 4) + (128 << 20)

    def all_rounds(blocks):
        with sent.started(blocks, extra) as java:
            give_back()
            yield [tuple(np.ascontiguousarray(a) for a in tree) for tree in java.boosted(growth, base, TIE)]

    tables = []
    for feature, bin_, left, total, gain in table.blocks.coalesce(1).mapPartitions(lambda blocks: given_back(all_rounds(blocks))).first():
        right = np.where(left < 0, -1, left + 1)
        tables.append(_table(Grown(feature, bin_, left, right, total, gain, []), growth, bins))
    return Boosted(base, Trees.from_tables(tables), len(bins.at) - 1)
