"""Tree ensembles as arrays, their scores, and Shapley values of their scores (M2, M3, M5, M7, K9).

A row goes left in a node if its feature's value is at most the threshold. Two kinds of Shapley values:

* path-dependent, of a sum of trees (margins): features outside a coalition are averaged over by the nodes'
  covers. A leaf gives to a feature on its path an integral of a polynomial, the product over the other features
  of its path; Gauss-Legendre quadrature with half as many points as the path has features is exact.
* interventional, of a mean of trees (probabilities): features outside a coalition take the values of background
  rows. Row and background rows walk down a tree together, the background rows as bits of one number; where
  they part, the feature is noted for the row's or the background's side, and a leaf that is reached with p and q
  features noted gives them its value by the Shapley weights of p and q.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double")
_COLUMNS = ["feature", "threshold", "left", "right", "value", "cover", "gain"]
_KINDS = [np.int32, np.float64, np.int32, np.int32, np.float64, np.float64, np.float64]


@dataclass
class Trees:
    """Nodes of all trees end to end; ``root`` is the first node of each tree, leaves have ``left`` -1."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def from_tables(cls, tables: list[dict[str, np.ndarray]]) -> "Trees":
        """From trees whose children are numbered within the tree."""
        sizes = np.array([len(t["left"]) for t in tables], np.int64)
        root = np.cumsum(sizes) - sizes
        # One column after the other, as deep forests have millions of nodes.
        joined = {c: np.concatenate([np.asarray(t[c]) for t in tables]).astype(kind, copy=False) if tables else np.zeros(0, kind)
                  for c, kind in zip(_COLUMNS, _KINDS)}
        base = np.repeat(root.astype(np.int32), sizes)
        for side in ("left", "right"):
            joined[side] = np.where(joined[side] < 0, np.int32(-1), joined[side] + base)
        return cls(root.astype(np.int32), **joined)

    def packed(self) -> "Packed":
        inner = np.flatnonzero(self.left >= 0)
        bound, number = np.unique(self.threshold[inner], return_inverse=True)
        value, code = np.unique(self.value[self.left < 0], return_inverse=True)
        children = (self.left[inner],) if (self.right[inner] == self.left[inner] + 1).all() else (self.left[inner], self.right[inner])
        return Packed(self.root, np.packbits(self.left >= 0), len(self.left), fewest_bytes(self.feature[inner]), bound, fewest_bytes(number),
                      children, value, fewest_bytes(code))

    def to_rows(self, first: int = 0, end: int | None = None) -> pa.Table:
        """All nodes, or those of some places."""
        part = slice(first, len(self.left) if end is None else end)
        node = np.arange(len(self.left))[part]
        tree = np.searchsorted(self.root, node, side="right") - 1
        base = self.root[tree]
        child = lambda c: np.where(c < 0, -1, c - base).astype(np.int32)
        return pa.table({
            "tree": tree.astype(np.int32), "node": (node - base).astype(np.int32), "feature": self.feature[part],
            "threshold": self.threshold[part], "left": child(self.left[part]), "right": child(self.right[part]), "value": self.value[part],
            "cover": self.cover[part], "gain": self.gain[part]})

    @classmethod
    def from_rows(cls, nodes: DataFrame) -> "Trees":
        """From (tree, node, ...) rows; as large as the model, which scoring sends to every task anyway."""
        rows = nodes.orderBy("tree", "node").toArrow()
        tree = np.asarray(rows.column("tree").combine_chunks())
        cuts = [*np.flatnonzero(np.append(True, tree[1:] != tree[:-1])).tolist(), len(tree)] if len(tree) else [0]
        own = {c: np.asarray(rows.column(c).combine_chunks()) for c in _COLUMNS}
        return cls.from_tables([{c: own[c][a:b] for c in _COLUMNS} for a, b in zip(cuts[:-1], cuts[1:])])

    def used_features(self) -> np.ndarray:
        return np.unique(self.feature[self.left >= 0])

    # Found once in each process, not once for each batch of rows.
    @cached_property
    def used(self) -> np.ndarray:
        return self.used_features()

    @cached_property
    def place(self) -> np.ndarray:
        """Of each node's feature among those used."""
        return np.searchsorted(self.used, self.feature).astype(np.int32)

    def leaves_of(self, x: "Rows") -> np.ndarray:
        """Leaf of every row in every tree; ``x`` holds the features that are used."""
        out = np.tile(self.root, x.count)
        place, width, value = self.place, x.values.shape[1], x.values.reshape(-1)
        # Where pairs of a row and a tree are that have not reached a leaf; deep trees have few of them far down.
        pair = np.flatnonzero(self.left[out] >= 0)
        node, row = out[pair], pair // max(len(self.root), 1) * width
        while len(pair):
            goes = value.take(row + place.take(node)) <= self.threshold.take(node)
            node = np.where(goes, self.left.take(node), self.right.take(node))
            inner = self.left.take(node) >= 0
            if not inner.all():
                out[pair[~inner]] = node[~inner]
                pair, node, row = pair[inner], node[inner], row[inner]
        return out.reshape(x.count, len(self.root))

    def sums(self, x: "Rows") -> np.ndarray:
        return self.value[self.leaves_of(x)].sum(axis=1)

    def importance(self, features: int) -> np.ndarray:
        """Gain of all splits by feature, adding up to 1."""
        inner = self.left >= 0
        gain = np.bincount(self.feature[inner], self.gain[inner], features)
        return gain / (gain.sum() or 1.0)


def fewest_bytes(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the smallest type that holds them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


@dataclass
class Packed:
    """What scoring needs of trees, in few bytes: of inner nodes their splits and children, of leaves their values. Deep forests
    have millions of nodes, whose bounds and values repeat."""

    root: np.ndarray
    inner: np.ndarray  # a bit a node
    nodes: int
    feature: np.ndarray
    bound: np.ndarray
    number: np.ndarray  # of the bound, for each inner node
    children: tuple  # left ones, and right ones if they are not always the next
    value: np.ndarray
    code: np.ndarray  # of the value, for each leaf

    def unpacked(self) -> Trees:
        """Trees without covers and gains, and without values of inner nodes."""
        inner = np.unpackbits(self.inner, count=self.nodes).astype(bool)
        feature, left, right = (np.full(self.nodes, fill, np.int32) for fill in (0, -1, -1))
        threshold, value = np.zeros(self.nodes), np.zeros(self.nodes)
        feature[inner], threshold[inner] = self.feature, self.bound[self.number]
        left[inner], right[inner] = self.children[0], self.children[1] if len(self.children) > 1 else self.children[0] + 1
        value[~inner] = self.value[self.code]
        return Trees(self.root, feature, threshold, left, right, value, np.zeros(0), np.zeros(0))


class Rows:
    """Values of some rows in the features that a model uses, zero where a row holds none."""

    def __init__(self, used: np.ndarray, count: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray):
        self._used, self.count = used, count
        self.values = np.zeros((count, len(used) + 1))
        if len(used):
            at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
            held = used[at] == feature
            self.values[row[held], at[held]] = value[held]

    def place(self, feature: np.ndarray) -> np.ndarray:
        """Columns of features; of what is not used, the last one, which is zero."""
        return np.searchsorted(self._used, feature)

    def slice(self, start: int, end: int) -> "Rows":
        part = object.__new__(Rows)
        part._used, part.values = self._used, self.values[start:end]
        part.count = len(part.values)
        return part


def entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of what the vectors of a column hold, sparse and dense ones alike."""
    if isinstance(vectors, pa.ExtensionArray):
        vectors = vectors.storage
    values, indices = vectors.field("values"), vectors.field("indices")
    sizes = np.asarray(values.value_lengths().fill_null(0))
    row = np.repeat(np.arange(len(vectors)), sizes)
    value = np.asarray(values.flatten())
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = np.asarray(vectors.field("type")) == 0
    if sparse.any():
        feature[np.repeat(sparse, sizes)] = np.asarray(indices.filter(pa.array(sparse)).flatten())
    return row, feature.astype(np.int64), value


def rows_of(vectors: pa.Array, used: np.ndarray) -> Rows:
    return Rows(used, len(vectors), *entries(vectors))


@dataclass
class Paths:
    """Leaves with the different features on their paths: a row passes if low < value <= high in all of them."""

    feature: np.ndarray  # leaves x longest path; padded entries are passed by every row
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray  # of the cover that goes on towards the leaf in the splits of that feature
    value: np.ndarray
    tree: np.ndarray


def paths(trees: Trees) -> Paths:
    found = []
    for number, root in enumerate(trees.root.tolist()):
        pending = [(root, {})]
        while pending:
            node, held = pending.pop()
            left, right = int(trees.left[node]), int(trees.right[node])
            if left < 0:
                found.append((held, float(trees.value[node]), number))
                continue
            f, t = int(trees.feature[node]), float(trees.threshold[node])
            low, high, share = held.get(f, (-np.inf, np.inf, 1.0))
            cover = trees.cover[node]
            pending.append((right, {**held, f: (max(low, t), high, share * trees.cover[right] / cover)}))
            pending.append((left, {**held, f: (low, min(high, t), share * trees.cover[left] / cover)}))
    wide = max((len(h) for h, _, _ in found), default=0) or 1
    out = Paths(np.zeros((len(found), wide), np.int64), np.full((len(found), wide), -np.inf), np.full((len(found), wide), np.inf),
                np.ones((len(found), wide)), np.array([v for _, v, _ in found]), np.array([n for _, _, n in found], np.int64))
    for i, (held, _, _) in enumerate(found):
        for j, (f, (low, high, share)) in enumerate(held.items()):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = f, low, high, share
    return out


class PathShapley:
    """Path-dependent Shapley values of a sum of trees."""

    # Numbers of one step: rows times leaves times path length.
    AT_ONCE = 1 << 21

    def __init__(self, trees: Trees, base: float = 0.0):
        self._p = paths(trees)
        self.used = trees.used_features()
        self.base = base + float((self._p.value * self._p.share.prod(axis=1)).sum())
        wide = self._p.feature.shape[1]
        point, weight = np.polynomial.legendre.leggauss(wide // 2 + 1)
        self._points = list(zip((point + 1) / 2, weight / 2))
        flat = self._p.feature.ravel()
        self._order = np.argsort(flat, kind="stable")
        self._starts = np.flatnonzero(np.append(True, flat[self._order][1:] != flat[self._order][:-1]))
        self.features = flat[self._order][self._starts]

    def arrays(self, columns: int) -> list[np.ndarray]:
        """What Java needs of it, for values of so many columns."""
        p, i32 = self._p, np.int32
        column = np.searchsorted(self.features, p.feature)
        head = np.array([columns, len(self.features), *p.feature.shape, len(self._points)], i32)
        point, weight = np.array(self._points, float).T
        return [head, self._lengths, np.searchsorted(self.used, p.feature).astype(i32), column.astype(i32), p.low, p.high, p.share, p.value,
                np.ascontiguousarray(point), np.ascontiguousarray(weight)]

    @cached_property
    def _lengths(self) -> np.ndarray:
        """Features on the path of each leaf; what follows is padding."""
        real = np.isfinite(self._p.low) | np.isfinite(self._p.high)
        return (np.arange(real.shape[1]) + 1).astype(np.int32)[None, :].repeat(len(real), 0).max(axis=1, initial=0, where=real)

    def values(self, x: Rows, java=None) -> np.ndarray:
        """One row for each row, one column for each of ``features``."""
        if java is not None and x.count:
            return java.path_values(self, x.count, x.values)
        p, out = self._p, np.zeros((x.count, len(self.features)))
        place = x.place(p.feature)
        step = max(1, self.AT_ONCE // p.feature.size)
        for start in range(0, x.count, step):
            value = x.values[start : start + step][:, place]
            passed = ((value > p.low) & (value <= p.high)).astype(float)
            total = np.zeros_like(passed)
            for t, weight in self._points:
                factor = t * passed + (1 - t) * p.share
                total += weight * factor.prod(axis=2, keepdims=True) / factor
            total *= (passed - p.share) * p.value[:, None]
            out[start : start + step] = np.add.reduceat(
                total.reshape(len(total), -1)[:, self._order], self._starts, axis=1)
        return out


class BackgroundShapley:
    """Interventional Shapley values of a mean of trees against at most 63 background rows."""

    ROWS_AT_ONCE = 64

    def __init__(self, trees: Trees, background: Rows):
        if not 0 < background.count < 64:
            raise ValueError("from 1 to 63 background rows")
        self._t, self._n = trees, background.count
        self.used = self.features = trees.used_features()
        goes = background.values[:, background.place(trees.feature)] <= trees.threshold
        self._left = (goes.astype(np.int64) << np.arange(self._n)[:, None]).sum(axis=0)
        self.base = float(trees.sums(background).mean() / max(len(trees.root), 1))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What Java needs of it: places, children, thresholds (in leaves their values' share of the score of one background row), background
        rows that go left, and the weights of all sides that can be noted."""
        t = self._t
        leaf = t.left < 0
        bound = np.where(leaf, t.value / (self._n * max(len(t.root), 1)), t.threshold)
        return np.where(leaf, 0, t.place).astype(np.int32), t.left, t.right, bound, self._left, side_weights(self._longest)

    @property
    def root(self) -> np.ndarray:
        return self._t.root

    @property
    def background(self) -> int:
        return self._n

    @property
    def nodes(self) -> int:
        return len(self._t.left)

    @cached_property
    def _longest(self) -> int:
        """Splits on the longest way to a leaf: no more features are noted."""
        depth, level = 0, self._t.root
        while True:
            level = level[self._t.left[level] >= 0]
            if not len(level):
                return depth
            level = np.concatenate([self._t.left[level], self._t.right[level]])
            depth += 1

    def values(self, x: Rows, java=None) -> np.ndarray:
        if java is not None and x.count:
            return java.background_values(self, x.count, x.values)
        out = np.zeros((x.count, len(self.features)))
        for start in range(0, x.count, self.ROWS_AT_ONCE):
            part = x.slice(start, start + self.ROWS_AT_ONCE)
            out[start : start + part.count] = self._walk(part)
        return out

    def _walk(self, x: Rows) -> np.ndarray:
        t, place = self._t, x.place(self._t.feature)
        trees = len(t.root)
        row = np.repeat(np.arange(x.count), trees)
        node = np.tile(t.root, x.count)
        mask = np.full(len(row), (1 << self._n) - 1, np.int64)
        note, p, q = np.full(len(row), -1), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        # Notes: the one before, the feature, and whether the row (1) or the background (2) went its way.
        chain = [np.zeros(4096, np.int32), np.zeros(4096, np.int32), np.zeros(4096, np.int8)]
        notes, sums = 0, np.zeros(x.count * len(self.features))
        while len(row):
            ends = t.left[node] < 0
            if ends.any():
                self._credit(sums, row[ends], node[ends], mask[ends], note[ends], p[ends], q[ends], chain)
                row, node, mask, note, p, q = (a[~ends] for a in (row, node, mask, note, p, q))
                if not len(row):
                    break
            f = place[node]
            own = x.values[row, f] <= t.threshold[node]
            theirs = np.where(own, self._left[node], ~self._left[node])
            along, across = mask & theirs, mask & ~theirs
            # Is the feature noted already? Where all backgrounds go along it makes no difference.
            decided, asked = np.zeros(len(row), np.int8), np.flatnonzero((across != 0) & (note >= 0))
            at = note[asked]
            while len(asked):
                hit = chain[1][at] == f[asked]
                decided[asked[hit]] = chain[2][at[hit]]
                at = np.where(hit, -1, chain[0][at])
                asked, at = asked[at >= 0], at[at >= 0]
            mine = np.where(own, t.left[node], t.right[node])
            other = np.where(own, t.right[node], t.left[node])
            free, back = decided == 0, decided == 2
            # The row's way with no new note: all who are noted for the row, else the backgrounds that go along.
            first = np.where(decided == 1, mask, along)
            parts = [(first != 0, mine, first, 0)]
            # The other way with no new note: backgrounds of a feature noted for them.
            parts.append((back & (across != 0), other, across, 0))
            parts += [(free & (across != 0), mine, across, 1), (free & (across != 0), other, across, 2)]
            new = [[] for _ in range(6)]
            for keep, to, masks, kind in parts:
                keep = np.flatnonzero(keep)
                if not len(keep):
                    continue
                link = note[keep]
                if kind:
                    if notes + len(keep) > len(chain[0]):
                        chain = [np.concatenate([c, np.zeros(max(len(c), len(keep)), c.dtype)]) for c in chain]
                    for c, made in zip(chain, (link, f[keep], kind)):
                        c[notes : notes + len(keep)] = made
                    link = notes + np.arange(len(keep))
                    notes += len(keep)
                for to_, one in zip(new, (row[keep], to[keep], masks[keep], link, p[keep] + (kind == 1), q[keep] + (kind == 2))):
                    to_.append(one)
            row, node, mask, note, p, q = (np.concatenate(a) for a in new)
        return sums.reshape(x.count, -1)

    def _credit(self, sums, row, node, mask, note, p, q, chain) -> None:
        most = int((p + q).max())
        if not most:
            return
        weight = side_weights(-(-most // 32) * 32)
        value = self._t.value[node] * np.bitwise_count(mask) / (self._n * len(self._t.root))
        gain, loss = value * weight[p, q, 0], -value * weight[p, q, 1]
        at, cells, values = note, [], []
        while True:
            open_ = np.flatnonzero(at >= 0)
            if not len(open_):
                break
            row, at, gain, loss = row[open_], at[open_], gain[open_], loss[open_]
            cells.append(row * len(self.features) + chain[1][at])
            values.append(np.where(chain[2][at] == 1, gain, loss))
            at = chain[0][at]
        sums += np.bincount(np.concatenate(cells), np.concatenate(values), len(sums))


@lru_cache(8)
def side_weights(most: int) -> np.ndarray:
    """Weights of p and q features: (p - 1)! q! / (p + q)! for the row's side, p! (q - 1)! / (p + q)! for the other."""
    weight = np.zeros((most + 1, most + 1, 2))
    for a in range(most + 1):
        for b in range(most + 1 - a):
            if a + b:
                weight[a, b, 0] = factorial(a - 1) * factorial(b) / factorial(a + b) if a else 0.0
                weight[a, b, 1] = factorial(a) * factorial(b - 1) / factorial(a + b) if b else 0.0
    return weight


# Nodes that pass from the driver to the tasks at once, and those of a piece.
SAVED_AT_ONCE, PIECE = 1 << 20, 1 << 16


def save(trees: Trees, spark: SparkSession, path: str) -> None:
    """Nodes go to the tasks in compressed pieces, so the driver holds no rows of them."""
    def piece(first: int, end: int) -> bytes:
        rows, out = trees.to_rows(first, end), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(rows)
        return out.getvalue().to_pybytes()

    def unpacked(batches):
        for batch in batches:
            for held in batch.column("piece").to_pylist():
                yield from pa.ipc.open_stream(held)

    for first in range(0, max(len(trees.left), 1), SAVED_AT_ONCE):
        end = min(first + SAVED_AT_ONCE, len(trees.left))
        pieces = [(piece(i, min(i + PIECE, end)),) for i in range(first, max(end, 1), PIECE)]
        some = spark.createDataFrame(pieces, "piece binary").mapInArrow(unpacked, NODE_SCHEMA)
        some.coalesce(1).write.mode("append" if first else "overwrite").parquet(path)
