"""Random forest of unlimited depth on binned sparse features (M1).

A tree sees every row a Poisson(1) number of times and, in each node, a seeded draw of about the square root of all features; if none
of them splits the node, twice as many are drawn, up to all. So a leaf is pure, or its rows are alike in all bins.
The Gini decrease of a split is twice the gain of ``best_splits`` with the weight of phishing rows for the gradient
and all weight for the hessian.

Nodes with more rows than ``local_rows`` are split by passes over the blocks: tasks sum what they hold by (tree, node, bin), one task a tree
finds the splits. The rows of smaller nodes are sent to one task each, by (tree, node), which finishes the node whole,
so depth needs no passes. If already the table is that small, every task gets the blocks once and grows its share of the trees.
Draws follow from the seed, the tree, a block's place and a node's path, so a task that runs again gives the same
trees, and both ways give the same. The model grows with the rows, as depth has no limit; ``depth`` sets one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from mailsift.operators import kernels
from mailsift.operators.boosting import LOCAL_ROWS, TIE, Bins, Block, Grown, Growth, added_up, best_splits, counted, joined, nodes_of
from mailsift.operators.trees import NODE_SCHEMA, Trees, rows_of, save
from mailsift.workspace import give_back, given_back

# Trees whose nodes are split, or sent out, together.
TREES_A_PASS = 16
# Tasks that grow whole trees, for each core: boosting holds some of the cores for a while.
TASKS_A_CORE = 3
# Trees that a task grows side by side.
TREES_AT_ONCE = 16
# Bits of one table of drawn features, as bytes.
DRAWN_CELLS = 1 << 24
# Cells of a table of rows by features, at most; cells of it that are looked up at once, and that are filled at once.
CODED_CELLS, LOOKED_UP, CODED_AT_ONCE = 1 << 29, 1 << 18, 1 << 22
# Cells of a node from which on entries may be gone through instead; and how many entries cost as much as a cell, about.
LARGE_NODE, CELL_COST = 1 << 14, 3
# Any split of an impure node is taken, also one that gains nothing.
GINI = Growth(l2=0.0, least_hessian=0.5, least_rows=1, least_gain=-math.inf)


@dataclass(eq=False)
class Forest:
    """A fitted forest; a leaf's value is its share of phishing."""

    trees: Trees
    features: int
    importance: np.ndarray = field(init=False)

    def __post_init__(self):
        # Each tree's gains add up to 1, then trees count alike.
        tree = np.searchsorted(self.trees.root, np.arange(len(self.trees.left)), side="right") - 1
        inner = self.trees.left >= 0
        whole = np.bincount(tree, np.where(inner, self.trees.gain, 0.0), len(self.trees.root))
        share = self.trees.gain[inner] / np.where(whole > 0, whole, 1.0)[tree[inner]]
        found = np.bincount(self.trees.feature[inner], share, self.features)
        self.importance = found / (found.sum() or 1.0)

    def scores(self, vectors: pa.Array) -> np.ndarray:
        return self.trees.sums(rows_of(vectors, self.trees.used)) / len(self.trees.root)

    def save(self, spark: SparkSession, path: str) -> None:
        save(self.trees, spark, f"{path}/nodes")
        spark.createDataFrame([(self.features,)], "features int").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        features = spark.read.parquet(f"{path}/metadata").first().features
        return cls(Trees.from_rows(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")), features)


# --- draws


_MASK = (1 << 64) - 1


def _child(key: int, side: int) -> int:
    """Seed of a child from that of its parent."""
    key = (key * 0x9E3779B97F4A7C15 + side + 1) & _MASK
    return key ^ (key >> 29)


def _bag(block: Block, seed: int, tree: int) -> np.ndarray:
    """How often the tree sees each row of a block."""
    return _seen(block.key[1:], len(block.y), seed, tree)


def _seen(place: tuple, rows: int, seed: int, tree: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, *place]).poisson(1.0, rows)


def draw_size(features: int, attempt: int) -> int:
    return min(features, max(1, math.isqrt(features)) << attempt)


def _draw(key: int, attempt: int, features: int) -> np.ndarray:
    """The features that a node looks at."""
    size = draw_size(features, attempt)
    return np.arange(features) if size == features else np.random.default_rng([key, attempt]).choice(features, size, replace=False)


def _drawn(keys: list[int], attempts: list[int], features: int) -> np.ndarray:
    """A row for each node, true where a feature is looked at."""
    out = np.zeros((len(keys), features), bool)
    for i, (key, attempt) in enumerate(zip(keys, attempts)):
        out[i, _draw(key, attempt, features)] = True
    return out


@dataclass
class Growing:
    """A tree under growth with the seeds of its nodes."""

    tree: Grown
    key: list[int]

    @classmethod
    def start(cls, key: int, total=None, depth: int = 0) -> "Growing":
        out = cls(Grown.start(), [key])
        out.tree.total[0], out.tree.depth[0] = total, depth
        return out

    @classmethod
    def several(cls, keys: list[int], totals: list[tuple], depth: int = 0) -> "Growing":
        """Trees that grow side by side; the first nodes are their roots."""
        n = len(keys)
        return cls(Grown([0] * n, [0] * n, [-1] * n, [-1] * n, list(totals), [0.0] * n, [depth] * n), list(keys))

    def apart(self, count: int) -> list[Grown]:
        """The trees that grew side by side, with nodes in the order in which each got them."""
        tree, left, right = self.tree, np.array(self.tree.left), np.array(self.tree.right)
        of = np.arange(len(left))
        inner = np.flatnonzero(left >= 0)
        for node, a, b in zip(inner.tolist(), left[inner].tolist(), right[inner].tolist()):
            of[a] = of[b] = of[node]
        found = []
        for t in range(count):
            own = np.flatnonzero(of == t)
            child = lambda to: np.where(to < 0, -1, np.searchsorted(own, to)).tolist()  # noqa: B023, E731
            rest = [[getattr(tree, name)[n] for n in own.tolist()] for name in ("feature", "bin", "total", "gain", "depth")]
            found.append(Grown(*rest[:2], child(left[own]), child(right[own]), *rest[2:]))
        return found

    def split(self, node: int, feature: int, bin_: int, gain: float, left_total) -> tuple[int, int]:
        self.tree.split(node, feature, bin_, 2 * max(gain, 0.0), left_total)
        self.key += [_child(self.key[node], 0), _child(self.key[node], 1)]
        return self.tree.left[node], self.tree.right[node]

    def open(self, node: int, depth: int | None) -> bool:
        positive, weight, _ = self.tree.total[node]
        return 0 < positive < weight and (depth is None or self.tree.depth[node] < depth)

    def graft(self, node: int, sub: Grown) -> None:
        """Put a finished subtree in the place of a leaf."""
        tree, first = self.tree, len(self.tree.left) - 1
        place = lambda child: -1 if child < 0 else child + first
        for name in ("feature", "bin", "gain"):
            values = getattr(sub, name)
            getattr(tree, name)[node] = values[0]
            getattr(tree, name).extend(values[1:])
        for name in ("left", "right"):
            values = [place(child) for child in getattr(sub, name)]
            getattr(tree, name)[node] = values[0]
            getattr(tree, name).extend(values[1:])
        tree.total.extend(sub.total[1:])
        tree.depth.extend(sub.depth[1:])


# --- nodes that fit one task


@dataclass
class Codes:
    """Where a block's rows have entries, a bit a cell, and the bins there. A bit tells whether a row holds a feature, and the bits
    before it which of the entries that is."""

    words: np.ndarray  # of 64 features each, row by row
    before: np.ndarray  # entries before those of each word
    place: np.ndarray  # of each entry's bin in its feature, by row and feature
    row_bytes: int

    @classmethod
    def of(cls, bins: Bins, block: Block) -> "Codes | None":
        """None where a block has no table; the table itself is made for some rows at a time."""
        rows, features = len(block.y), len(bins.at) - 1
        if coded(bins, Block(block.key, block.y[:0], block.row[:0], block.bin[:0])) is None or rows * features > CODED_CELLS:
            return None
        row = block.row.astype(np.uint16) if rows <= 1 << 16 else block.row
        order = np.argsort(row, kind="stable")
        row, number = row.take(order), block.bin.take(order)
        del order

        def tables():
            step = max(1, CODED_AT_ONCE // max(features, 1))
            for first in range(0, rows, step):
                a, b = np.searchsorted(row, np.array((first, min(first + step, rows) - 1), row.dtype), side="left")
                b += np.searchsorted(row[b:], row.dtype.type(min(first + step, rows) - 1), side="right")
                yield coded(bins, Block(block.key, block.y[first : first + step], row[a:b].astype(np.int32) - first, number[a:b]))

        return cls.of_tables(features, tables())

    @classmethod
    def of_tables(cls, features: int, tables) -> "Codes":
        """From tables of ``coded``, one below the other."""
        row_bytes, bits, place = -(-features // 64) * 8, [], []
        for table in tables:
            held = np.zeros((len(table), 8 * row_bytes), bool)
            held[:, :features] = table > 0
            bits.append(np.packbits(held, axis=1, bitorder="little").reshape(-1))
            place.append(table[table > 0] - np.uint8(1))
        words = np.concatenate(bits).view("<u8")
        count = np.bitwise_count(words)
        return cls(words, np.cumsum(count, dtype=np.int32) - count, np.concatenate(place), row_bytes)

    @property
    def bits(self) -> np.ndarray:
        return self.words.view(np.uint8)

    def places(self, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Of cells that hold an entry."""
        word = row * (self.row_bytes // 8) + (feature >> 6)
        below = self.words.take(word) & ((np.uint64(1) << (feature & 63).astype(np.uint64)) - np.uint64(1))
        return self.place.take(self.before.take(word) + np.bitwise_count(below)).astype(np.int64)

    def numbers(self, bins: Bins, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Bins of any cells."""
        number = bins.zero[feature]
        held = np.flatnonzero(self.bits.take(row * self.row_bytes + (feature >> 3)) >> (feature & 7).astype(np.uint8) & 1)
        number[held] = bins.at[feature[held]] + self.places(row[held], feature[held])
        return number


def coded(bins: Bins, block: Block) -> np.ndarray | None:
    """Rows by features, a byte each: 0 where the block has no entry, else 1 and the place of the bin in its feature.

    None where there are too many cells, or a feature has too many bins for a byte.
    """
    rows, features = len(block.y), len(bins.at) - 1
    if rows * features > CODED_CELLS or features and np.diff(bins.at).max() > 254:
        return None
    out = np.zeros((rows, features), np.uint8)
    feature = bins.feature[block.bin]
    out[block.row, feature] = block.bin - bins.at[feature] + 1
    return out


@dataclass
class Columns:
    """Rows of a block's entries by feature, and how many of them each bin has; a row's counts are added up as one number."""

    start: np.ndarray  # of each feature, and the end
    row: np.ndarray
    entries_of: np.ndarray

    # Bits of each count: of phishing, of all, of rows.
    BITS = 21

    @classmethod
    def of(cls, bins: Bins, block: Block) -> "Columns":
        entries_of = counted(block.bin, int(bins.at[-1]))
        row = block.row.astype(np.uint16) if len(block.y) <= 1 << 16 else block.row
        return cls(np.concatenate([[0], np.cumsum(entries_of)])[bins.at], row, entries_of)

    @classmethod
    def packed(cls, values: np.ndarray) -> np.ndarray | None:
        """The three counts of each row as one number; None where their sums would not fit."""
        if values.sum(axis=1).max(initial=0) >= 1 << cls.BITS:
            return None
        phishing, all_, rows = values.astype(np.int64)
        return phishing + (all_ << cls.BITS) + (rows << 2 * cls.BITS)

    def sums(self, bins: Bins, drawn: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins of the drawn features that hold rows, and their three sums; ``counts`` are 0 for rows outside the node."""
        drawn = np.sort(drawn)
        row = np.concatenate([self.row[a:b] for a, b in zip(self.start[drawn].tolist(), self.start[drawn + 1].tolist())])
        size = bins.at[drawn + 1] - bins.at[drawn]
        number = np.arange(size.sum()) + np.repeat(bins.at[drawn] - np.cumsum(size) + size, size)
        number = number[self.entries_of[number] > 0]
        if not len(number):
            return number, np.zeros((3, 0))
        held = self.entries_of[number]
        found = np.add.reduceat(counts.take(row), np.cumsum(held) - held)
        number, found = number[found > 0], found[found > 0]
        one = (1 << self.BITS) - 1
        return number, np.stack([found & one, found >> self.BITS & one, found >> 2 * self.BITS]).astype(float)


def finished(bins: Bins, block: Block, weight: np.ndarray, key: int, start: int = 0, depth: int | None = None,
             codes: np.ndarray | None = None, columns: Columns | None = None) -> Grown:
    """The whole subtree above rows with weights; its root has depth ``start``. ``codes`` is the block's table, if it is there already."""
    held = None if codes is None else Codes.of_tables(len(bins.at) - 1, [codes])
    return side_by_side(bins, block, [weight], [key], start, depth, held, columns)[0]


def side_by_side(bins: Bins, block: Block, weights: list[np.ndarray], keys: list[int], start: int = 0, depth: int | None = None,
                 codes: Codes | None = None, columns: Columns | None = None) -> list[Grown]:
    """The whole subtrees above the same rows with different weights, each as if it grew alone; levels are gone through for all at once.

    ``codes`` and ``columns`` are the block's, if they are there already. A level looks up the drawn features of its rows, a small part
    of their entries; of a node with so many rows that this is more than the entries of the drawn features, it goes through these.
    """
    codes = Codes.of(bins, block) if codes is None else codes
    if codes is None:
        return [_finished_from_entries(bins, block, weight, key, start, depth) for weight, key in zip(weights, keys)]
    columns = Columns.of(bins, block) if columns is None else columns
    features, width = len(bins.at) - 1, int(bins.at[-1])
    seen = [np.flatnonzero(weight > 0) for weight in weights]
    # What a tree sees of the rows; places in here stand for a tree and a row.
    row_of, weight = np.concatenate(seen), np.concatenate([w[own] for w, own in zip(weights, seen)])
    values = np.stack([weight * block.y[row_of], weight, np.ones(len(weight))]).astype(float)
    ends = np.cumsum([len(own) for own in seen])
    by_tree = np.split(values, ends[:-1], axis=1)
    packed = [columns.packed(own) for own in by_tree]
    packed = None if any(own is None for own in packed) else np.concatenate(packed)
    counts, held_by = np.zeros(len(block.y), np.int64), np.diff(columns.start)
    out = Growing.several(keys, [tuple(own.sum(axis=1).tolist()) for own in by_tree], start)
    level = [n for n in range(len(keys)) if out.open(n, depth)]
    held, at = np.arange(len(row_of)), np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0))  # still looked at, and their nodes
    bits = codes.bits
    while level:
        chosen, waiting, attempt = {}, level, 0
        while waiting:
            # Numbers of 16 bits are sorted by radix.
            place = np.full(len(out.tree.left), -1, np.int16 if len(waiting) < 1 << 15 else np.int64)
            place[waiting] = np.arange(len(waiting))
            slots = place[at]
            mine = np.flatnonzero(slots >= 0)
            mine = mine[np.argsort(slots[mine], kind="stable")]
            size = draw_size(features, attempt)
            # Whole nodes at a time, as many as their table of draws allows.
            ends = np.searchsorted(slots[mine], np.arange(len(waiting) + 1))
            several, found = max(1, DRAWN_CELLS // (8 * max(size, 1))), {}
            for first in range(0, len(waiting), several):
                nodes = waiting[first : first + several]
                drawn = np.stack([_draw(out.key[n], attempt, features) for n in nodes])
                rows_of_node = np.diff(ends[first : first + len(nodes) + 1])
                large = (CELL_COST * rows_of_node * size > np.maximum(held_by[drawn].sum(axis=1), CELL_COST * LARGE_NODE)) & (packed is not None)
                cells, sums = [], []
                for i in np.flatnonzero(large).tolist():
                    inside = held[mine[ends[first + i] : ends[first + i + 1]]]
                    counts[row_of[inside]] = packed[inside]
                    number, part = columns.sums(bins, drawn[i], counts)
                    counts[row_of[inside]] = 0
                    cells.append(i * width + number)
                    sums.append(part)
                if not large.all():
                    part = mine[ends[first] : ends[first + len(nodes)]]
                    slot = slots[part].astype(np.int64) - first
                    if large.any():
                        part, slot = part[~large[slot]], slot[~large[slot]]
                    seen_, looked_up, hits = held[part], [], []
                    byte, bit = drawn >> 3, np.uint8(1) << (drawn & 7).astype(np.uint8)
                    begin, step = row_of[seen_] * codes.row_bytes, max(1, LOOKED_UP // max(size, 1))
                    for i in range(0, len(part), step):
                        one = slot[i : i + step]
                        at_byte = byte.take(one, axis=0)
                        at_byte += begin[i : i + step, None]
                        hit = np.flatnonzero(bits.take(at_byte) & bit.take(one, axis=0))
                        r = hit // size
                        f = drawn.reshape(-1).take(one[r] * size + hit - r * size)
                        r += i
                        looked_up.append(slot[r] * width + bins.at[f] + codes.places(row_of[seen_[r]], f))
                        hits.append(seen_[r])
                    cell, part = added_up(np.concatenate(looked_up), values[:, np.concatenate(hits)])
                    cells.append(cell)
                    sums.append(part)
                totals = np.array([out.tree.total[n] for n in nodes]).T
                cell, part = added_up(np.concatenate(cells), np.concatenate(sums, axis=1), len(cells) == 1)
                for s, gain, f, cut, left, _ in best_splits(cell, part, totals, bins, GINI):
                    if f >= 0:
                        found[nodes[s]] = f, cut, gain, left
            chosen.update(found)
            waiting = [n for n in waiting if n not in found] if size < features else []
            attempt += 1
        by_node = np.zeros((4, len(out.tree.left)), np.int64)  # feature (-1: not split), cut, left, right
        by_node[0] = -1
        level = []
        for node, (f, cut, gain, left) in sorted(chosen.items()):
            children = out.split(node, f, cut, gain, left)
            by_node[:, node] = f, cut, *children
            level += [c for c in children if out.open(c, depth)]
        # Rows of leaves are not looked at again.
        keep = by_node[0, at] >= 0
        held, (f, cut, left, right) = held[keep], by_node[:, at[keep]]
        at = np.where(codes.numbers(bins, row_of[held], f) <= cut, left, right)
        active = np.zeros(len(out.tree.left), bool)
        active[level] = True
        held, at = held[active[at]], at[active[at]]
    return out.apart(len(keys))


def _finished_from_entries(bins: Bins, block: Block, weight: np.ndarray, key: int, start: int = 0, depth: int | None = None) -> Grown:
    """The same as ``finished`` where a table of rows by features would be too large: every level goes through all entries."""
    features, width = len(bins.at) - 1, int(bins.at[-1])
    y, weight = block.y.astype(float), weight.astype(float)
    seen = weight > 0
    values = np.stack([weight * y, weight, np.ones(len(y))])
    out = Growing.start(key, tuple(float(v) for v in values[:, seen].sum(axis=1)), start)
    at = np.where(seen, 0, -1)
    level = [0] if out.open(0, depth) else []
    mine = seen[block.row]
    row, bin_ = block.row[mine], block.bin[mine]
    feature = bins.feature[bin_]
    while level:
        chosen, waiting, attempt = {}, level, 0
        part = slice(None)
        while waiting:
            found = {}
            size = max(1, DRAWN_CELLS // max(features, 1))
            for first in range(0, len(waiting), size):
                nodes = waiting[first : first + size]
                place = np.full(len(out.tree.left) + 1, -1, np.int32)  # the last one is that of rows in no node
                place[nodes] = np.arange(len(nodes))
                drawn = _drawn([out.key[n] for n in nodes], [attempt] * len(nodes), features)
                slot = place[at][row[part]]
                held = np.flatnonzero((slot >= 0) & drawn[slot, feature[part]])
                order = held[np.argsort(slot[held], kind="stable")]
                cell = slot[order].astype(np.int64) * width + bin_[part][order]
                cell, sums = added_up(cell, values[:, row[part][order]], ordered=True)
                totals = np.array([out.tree.total[n] for n in nodes]).T
                for s, gain, f, cut, left, _ in best_splits(cell, sums, totals, bins, GINI):
                    if f >= 0:
                        found[nodes[s]] = f, cut, gain, left
            chosen.update(found)
            more = draw_size(features, attempt) < features
            waiting, attempt = [n for n in waiting if n not in found] if more else [], attempt + 1
            if waiting:
                wanted = np.zeros(len(out.tree.left) + 1, bool)
                wanted[waiting] = True
                part = np.flatnonzero(wanted[at][row])
        count = len(out.tree.left)
        by_node = np.zeros((4, count), np.int64)  # feature (-1: not split), cut, left, right
        by_node[0] = -1
        level = []
        for node, (f, cut, gain, left) in sorted(chosen.items()):
            children = out.split(node, f, cut, gain, left)
            by_node[:, node] = f, cut, *children
            level += [c for c in children if out.open(c, depth)]
        # What is zero in the split's feature goes one way, and what is not is told by its entry.
        before = at.copy()
        moved = np.flatnonzero((before >= 0) & (by_node[0, before] >= 0))
        f, cut, left, right = by_node[:, before[moved]]
        at[moved] = np.where(bins.zero[f] <= cut, left, right)
        hit = np.flatnonzero((before[row] >= 0) & (by_node[0, before[row]] == feature))
        _, cut, left, right = by_node[:, before[row[hit]]]
        at[row[hit]] = np.where(bin_[hit] <= cut, left, right)
        # Rows of finished leaves are not looked at again.
        active = np.zeros(len(out.tree.left) + 1, bool)
        active[level] = True
        at[~active[at]] = -1
        keep = at[row] >= 0
        row, bin_, feature = row[keep], bin_[keep], feature[keep]
    return out.tree


def merged(pieces: list[tuple[Block, np.ndarray]]) -> tuple[Block, np.ndarray]:
    """Blocks in the order of their places as one, entries by bin. The list is empty afterwards."""
    pieces.sort(key=lambda p: p[0].key)
    blocks, weight = [b for b, _ in pieces], np.concatenate([w for _, w in pieces])
    pieces.clear()
    return joined(blocks), weight


# --- passes over the blocks


@dataclass
class _Pass:
    """Trees of a pass: (number, partial tree, nodes concerned, their seeds and attempts)."""

    bins: object
    seed: int
    trees: list[tuple]

    def _placed(self, block: Block, tree: int, partial: tuple, nodes: list[int]):
        weight = _bag(block, self.seed, tree)
        place = np.full(len(partial[2]), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        return weight, np.where(weight > 0, place[nodes_of(block, self.bins.value, *partial)], -1)

    def sums(self, number: int, blocks):
        """(place of the tree, (task, totals, cells, sums)) of one task's blocks."""
        bins, blocks = self.bins.value, list(blocks)
        width, features = int(bins.at[-1]), len(bins.at) - 1
        for k, (tree, partial, nodes, keys, attempts) in enumerate(self.trees):
            drawn = _drawn(keys, attempts, features)
            totals, cells, sums = np.zeros((3, len(nodes))), [], []
            for block in blocks:
                weight, slot = self._placed(block, tree, partial, nodes)
                values = np.stack([weight * block.y, weight, np.ones(len(weight))]).astype(float)
                own = slot >= 0
                for i in range(3):
                    totals[i] += np.bincount(slot[own], values[i, own], len(nodes))
                entry = slot[block.row]
                held = np.flatnonzero((entry >= 0) & drawn[entry, bins.feature[block.bin]])
                cell, part = added_up(entry[held].astype(np.int64) * width + block.bin[held], values[:, block.row[held]])
                cells.append(cell)
                sums.append(part)
            if cells:
                yield k, (number, totals, *added_up(np.concatenate(cells), np.concatenate(sums, axis=1)))

    def best(self, parts):
        """(place of the tree, candidate) for each node."""
        by_tree: dict[int, list] = {}
        for k, part in parts:
            by_tree.setdefault(k, []).append(part)
        for k, found in sorted(by_tree.items()):
            cell, sums = added_up(np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found], axis=1))
            for candidate in best_splits(cell, sums, sum(f[1] for f in found), self.bins.value, GINI):
                yield k, candidate

    def rows(self, blocks):
        """((tree, node), rows of the node) of one task's blocks."""
        for block in blocks:
            for tree, partial, nodes, _, _ in self.trees:
                weight, slot = self._placed(block, tree, partial, nodes)
                order = np.argsort(slot, kind="stable")
                cuts = np.searchsorted(slot[order], np.arange(len(nodes) + 1))
                new = np.zeros(len(slot), np.int32)
                entry = slot[block.row]
                held = np.argsort(entry, kind="stable")
                ends = np.searchsorted(entry[held], np.arange(len(nodes) + 1))
                for i, node in enumerate(nodes):
                    own, mine = np.sort(order[cuts[i] : cuts[i + 1]]), held[ends[i] : ends[i + 1]]
                    if len(own):
                        new[own] = np.arange(len(own))
                        yield (tree, node), (Block(block.key, block.y[own], new[block.row[mine]], block.bin[mine]), weight[own])


def fit(rows: DataFrame, bins: Bins, blocks: DataFrame, trees: int = 200, depth: int | None = None, seed: int = 0,
        local_rows: int = LOCAL_ROWS, table: kernels.Table | None = None) -> Forest:
    """Fit to blocks of rows (``boosting.write_blocks``). Without rows the forest is one leaf of one half a tree.

    A ``table`` of the blocks has whole trees grown by tasks beside which Java runs, of whatever size the table is.
    """
    context = rows.sparkSession.sparkContext
    if table is not None and trees:
        return _fit_beside(table, bins, trees, depth, seed, context)

    def decoded(number, part):
        for i, r in enumerate(part):
            yield Block(("", number, i), np.frombuffer(r.y, np.int8), np.frombuffer(r.row, np.int32), np.frombuffer(r.bin, np.int32))

    held = blocks.rdd.mapPartitionsWithIndex(decoded).persist(StorageLevel.MEMORY_AND_DISK)
    n = held.map(lambda b: len(b.y)).sum()
    shared, tasks = context.broadcast(bins), max(1, min(trees, TASKS_A_CORE * context.defaultParallelism))
    roots = {t: _child(_child(seed & _MASK, t), 2) for t in range(trees)}
    out: dict[int, dict] = {}
    if 0 < n <= local_rows:
        def own_trees(number, parts):
            if number >= trees:
                return
            whole = sorted(parts, key=lambda b: b.key)
            if not whole:
                return
            pieces = [(b, b.y) for b in whole]
            whole = [Block(b.key, b.y, b.row[:0].copy(), b.bin[:0].copy()) for b in whole]
            block, _ = merged(pieces)
            codes, columns = Codes.of(shared.value, block), Columns.of(shared.value, block)
            if codes is not None:
                # Both hold all entries; a second copy would take memory as long as the task.
                block = Block(block.key, block.y, block.row[:0].copy(), block.bin[:0].copy())
            give_back()
            own = range(number, trees, tasks)
            for first in range(0, len(own), TREES_AT_ONCE):
                some = own[first : first + TREES_AT_ONCE]
                weights = [np.concatenate([_bag(b, seed, tree) for b in whole]) for tree in some]
                grown = side_by_side(shared.value, block, weights, [roots[t] for t in some], depth=depth, codes=codes, columns=columns)
                yield from zip(some, map(_sent, grown))

        # Every task reads the blocks where they are held; a shuffle would write them once for each task.
        everywhere = context.union([held.coalesce(1)] * tasks)
        grown = everywhere.mapPartitionsWithIndex(lambda number, parts: given_back(own_trees(number, parts))).collect()
        out = {t: _received(*tree, bins) for t, tree in grown}
    elif n:
        for first in range(0, trees, TREES_A_PASS):
            group = {t: roots[t] for t in range(first, min(trees, first + TREES_A_PASS))}
            out.update(_by_passes(held, shared, group, depth, seed, local_rows, context.defaultParallelism))
    held.unpersist()
    none = _table(Growing.start(0, (0.5, 1.0, 1.0)).tree, bins)
    joined_trees = Trees.from_tables([out.pop(t, none) for t in range(trees)])
    # The tables of the trees are freed by now, and the driver would keep their memory.
    give_back()
    return Forest(joined_trees, len(bins.at) - 1)


def _fit_beside(table: kernels.Table, bins: Bins, trees: int, depth: int | None, seed: int, context) -> Forest:
    """Whole trees, dealt to tasks that each hold the table, as ``side_by_side`` grows them."""
    sent, features = table.sent(), len(bins.at) - 1
    tasks = max(1, min(trees, TASKS_A_CORE * context.defaultParallelism))

    def own_trees(number, blocks):
        with sent.started(blocks, 64 << 20) as java:
            give_back()
            for t in range(number, trees, tasks):
                weight = np.concatenate([_seen(place, rows, seed, t) for place, (rows, _) in zip(sent.keys, sent.counts)])
                number_, left, positive, weights, _, _, gain = java.forest_tree(
                    weight, _child(_child(seed & _MASK, t), 2), draw_size(features, 0), depth, TIE)
                yield t, (number_, left, None, np.stack([positive, weights]), gain[left >= 0])

    # Every task reads the blocks where they are held.
    everywhere = context.union([table.blocks.coalesce(1)] * tasks)
    grown = everywhere.mapPartitionsWithIndex(lambda number, blocks: given_back(own_trees(number, blocks))).collect()
    out = {t: _received(*tree, bins) for t, tree in grown}
    del grown
    joined_trees = Trees.from_tables([out.pop(t) for t in range(trees)])
    give_back()
    return Forest(joined_trees, features)


def _by_passes(held, shared, group: dict[int, int], depth, seed: int, local_rows: int, tasks: int) -> dict[int, dict]:
    """Trees of a group: large nodes by passes, then small ones by the task that their rows are sent to."""
    growing = {t: Growing.start(key) for t, key in group.items()}
    waiting = {t: {0: 0} for t in group}  # nodes to be split, and how often that was tried
    features = len(shared.value.at) - 1

    def work(nodes: dict[int, list[int]], tried=None):
        return _Pass(shared, seed, [
            (t, (g.feature, g.bin, g.left, g.right), nodes[t], [growing[t].key[n] for n in nodes[t]],
             [tried[t][n] if tried else 0 for n in nodes[t]]) for t, g in ((t, growing[t].tree) for t in nodes)])

    while waiting:
        nodes = {t: sorted(w) for t, w in waiting.items()}
        one, order = work(nodes, waiting), list(nodes)
        found = held.mapPartitionsWithIndex(one.sums).partitionBy(len(order), int).mapPartitions(one.best).collect()
        later: dict[int, dict[int, int]] = {}
        for k, (slot, gain, feature, bin_, left, total) in sorted(found, key=lambda x: (x[0], x[1][0])):
            t, node = order[k], nodes[order[k]][slot]
            grown, tried = growing[t], waiting[t][node]
            grown.tree.total[node] = total
            if not grown.open(node, depth):
                continue
            if feature >= 0:
                for child in grown.split(node, feature, bin_, gain, left):
                    if grown.open(child, depth) and grown.tree.total[child][2] > local_rows:
                        later.setdefault(t, {})[child] = 0
            elif draw_size(features, tried) < features:
                later.setdefault(t, {})[node] = tried + 1
        waiting = later

    small = {t: [n for n, left in enumerate(g.tree.left) if left < 0 and g.open(n, depth) and g.tree.total[n][2] <= local_rows]
             for t, g in growing.items()}
    one = work({t: nodes for t, nodes in small.items() if nodes})
    starts = {(t, n): (growing[t].key[n], growing[t].tree.depth[n]) for t, nodes in small.items() for n in nodes}

    def subtrees(parts):
        by_node: dict[tuple, list] = {}
        for key, piece in parts:
            by_node.setdefault(key, []).append(piece)
        for key in sorted(by_node):
            block, weight = merged(by_node.pop(key))
            yield key, finished(shared.value, block, weight, *starts[key], depth)

    if starts:
        places = {key: i for i, key in enumerate(sorted(starts))}
        sent = held.mapPartitions(one.rows).partitionBy(max(tasks, len(places)), lambda key: places[key])
        for (t, node), sub in sorted(sent.mapPartitions(subtrees).collect(), key=lambda x: x[0]):
            growing[t].graft(node, sub)
    return {t: _table(g.tree, shared.value) for t, g in growing.items()}


def _table(grown: Grown, bins: Bins) -> dict[str, np.ndarray]:
    return _received(*_sent(grown), bins)


def _sent(grown: Grown) -> tuple[np.ndarray, ...]:
    """A tree on its way to the driver, in few bytes: bins and left children, counts, gains of inner nodes. Right children are the next."""
    left, total = np.array(grown.left, np.int32), np.array(grown.total)[:, :2].T
    number = np.where(left < 0, 0, np.array(grown.bin)).astype(np.int32)
    counts = total.astype(np.int32) if (total == np.round(total)).all() and total.max(initial=0) < 1 << 31 else total.copy()
    inner = left >= 0
    right = np.array(grown.right, np.int32)
    return number, left, None if (right[inner] == left[inner] + 1).all() else right, counts, np.array(grown.gain)[inner]


def _received(number, left, right, counts, gains, bins: Bins) -> dict[str, np.ndarray]:
    inner, gain = left >= 0, np.zeros(len(left))
    gain[inner] = gains
    bound = bins.bound[number] if len(bins.bound) else np.zeros(len(left))
    feature = np.where(inner, bins.feature[number], 0) if len(bins.feature) else np.zeros(len(left))
    right = np.where(inner, left + 1, -1).astype(np.int32) if right is None else right
    positive, weight = counts.astype(float)
    return {"feature": feature.astype(np.int32), "threshold": bound, "left": left, "right": right,
            "value": positive / np.maximum(weight, 1e-300), "cover": weight, "gain": gain}
