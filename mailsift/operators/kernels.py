"""The inner loops of the tree ensembles in a Java process beside a Python worker (Kernels.java).

Growing deep trees, and following the many ways through them that Shapley values need, are loops over single rows and nodes, which numpy
has to turn into passes over arrays. Spark brings a Java compiler (Janino) with its driver and every executor runs on Java, so the
driver compiles the loops once, sends the classes along, and a task starts them as a process of its own and talks to it by pipes. Where
there is no Java, and for little work, the numpy code is used; it gives the same trees and values.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Rows from which on training uses it: starting it takes some tenths of a second.
LEAST_ROWS = 1 << 13
# Bytes of entries that a task may hold, and of one entry by row and by feature; beyond, training takes passes over the blocks.
TABLE_BYTES, ENTRY_BYTES = 512 << 20, 6

_TABLE, _BLOCK, _FOREST, _BOOSTED, _BACKGROUND, _BACKGROUND_VALUES, _PATHS, _PATH_VALUES, _DRAWN = range(1, 10)


_code: dict[str, bytes] = {}


def code(spark: SparkSession) -> dict[str, bytes]:
    """The classes by name, compiled once on the driver."""
    if not _code:
        compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name("Kernels.java").read_text())
        _code.update({name: bytes(content) for name, content in dict(compiler.getBytecodes()).items()})
    return dict(_code)


def java() -> str | None:
    own = os.path.join(os.environ.get("JAVA_HOME", ""), "bin", "java")
    return own if os.access(own, os.X_OK) else shutil.which("java")


class Kernels:
    """A running process. It ends with its input, so at the latest with the worker."""

    def __init__(self, classes: dict[str, bytes], heap: int):
        folder = tempfile.mkdtemp(prefix="kernels-")
        try:
            for name, content in classes.items():
                Path(folder, f"{name}.class").write_bytes(content)
            # One thread of its own; memory is given back as it goes.
            self._process = subprocess.Popen(
                [java(), f"-Xmx{(heap >> 20) + 64}m", "-XX:+UseSerialGC", "-XX:CICompilerCount=2", "-XX:MinHeapFreeRatio=5",
                 "-XX:MaxHeapFreeRatio=10", "-Xss64m", "-cp", os.path.realpath(folder), "Kernels"],
                stdin=subprocess.PIPE, stdout=subprocess.PIPE, bufsize=1 << 20)
            # Models that it holds, path models by number; the first one has no paths and has all classes loaded.
            self._loaded: dict[int, int] = {}
            self._paths = 0
            self._ask(_PATHS, np.zeros(5, np.int32))
            self.drawn(1, 0, 2, 1)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def __enter__(self) -> "Kernels":
        return self

    def __exit__(self, *_) -> None:
        self._process.stdin.close()
        self._process.stdout.close()
        self._process.wait()

    def _ask(self, command: int, *arrays: np.ndarray) -> None:
        self._process.stdin.write(np.int32(command).tobytes())
        for a in arrays:
            self._process.stdin.write(memoryview(np.ascontiguousarray(a)).cast("B") if a.size else b"")

    def _told(self, kind, count: int) -> np.ndarray:
        self._process.stdin.flush()
        out = np.empty(count, kind)
        view = memoryview(out).cast("B") if count else b""
        got = self._process.stdout.readinto(view) if count else 0
        if got < len(view):
            raise RuntimeError(f"the Java process ended ({self._process.wait()})")
        return out

    def drawn(self, key: int, attempt: int, features: int, size: int) -> np.ndarray:
        self._ask(_DRAWN, np.array([key], np.uint64), np.array([attempt, features, size], np.int32))
        return self._told(np.int32, size)

    # --- training

    def feed(self, table: "Table", bins, blocks: Iterator["Rowwise"]) -> None:
        """Send the bins and all blocks, each to its place."""
        features = len(bins.at) - 1
        self._ask(_TABLE, *(np.asarray(a, np.int32) for a in ([features], bins.at, bins.zero - bins.at[:-1], [table.rows, table.entries])))
        first = table.first
        for b in blocks:
            self._ask(_BLOCK, np.array([first[b.key][0], len(b.y), first[b.key][1], len(b.feature)], np.int32), b.size, b.y, b.feature, b.place)

    def forest_tree(self, weight: np.ndarray, key: int, draws: int, depth: int | None, tie: float):
        """Bins, left children, weights of phishing and of all, rows, depths and gains of the nodes."""
        self._ask(_FOREST, np.array([key], np.uint64), np.array([draws, 0, -1 if depth is None else depth], np.int32),
                  np.array([tie]), weight.astype(np.int32))
        nodes = int(self._told(np.int32, 1)[0])
        return (*self._told(np.int32, 6 * nodes).reshape(6, nodes), self._told(np.float64, nodes))

    def boosted(self, growth, base: float, tie: float):
        """Features, bins, left children, sums and gains of the nodes of each tree."""
        self._ask(_BOOSTED, np.array([growth.rounds, growth.depth, growth.leaves or 0], np.int32), np.array(
            [growth.step, growth.l2, growth.least_hessian, growth.least_rows, growth.least_gain, tie, base], np.float64))
        for _ in range(growth.rounds):
            nodes = int(self._told(np.int32, 1)[0])
            feature, bin_, left = self._told(np.int32, 3 * nodes).reshape(nodes, 3).T
            sums = self._told(np.float64, 4 * nodes).reshape(nodes, 4)
            yield feature, bin_, left, sums[:, :3], sums[:, 3]

    # --- explanations

    def background_values(self, model, count: int, values: np.ndarray) -> np.ndarray:
        """``values`` of a ``BackgroundShapley``; a process holds one such model."""
        if id(model) not in self._loaded:
            self._loaded[id(model)] = 0
            place, left, right, bound, theirs, weight = model.arrays()
            i32 = lambda *a: np.array(a, np.int32)
            self._ask(_BACKGROUND, i32(model.background, len(model.features), len(weight)), weight, i32(len(model.root)), model.root,
                      i32(len(left)), place, left, right, bound, theirs)
        self._ask(_BACKGROUND_VALUES, np.array([count], np.int32), values)
        return self._told(np.float64, count * len(model.features)).reshape(count, -1)

    def path_values(self, model, count: int, values: np.ndarray) -> np.ndarray:
        if id(model) not in self._loaded:
            self._paths += 1
            self._loaded[id(model)] = self._paths
            self._ask(_PATHS, *model.arrays(values.shape[1]))
        self._ask(_PATH_VALUES, np.array([self._loaded[id(model)], count], np.int32), values)
        return self._told(np.float64, count * len(model.features)).reshape(count, -1)


_beside: dict[str, Kernels | None] = {}


def beside(token: str, classes: dict[str, bytes] | None, heap: int) -> Kernels | None:
    """The worker's own process for one set of models, started when it is first needed; those of other sets end."""
    if token not in _beside:
        for old in _beside.values():
            if old is not None:
                old.__exit__()
        _beside.clear()
        _beside[token] = Kernels(classes, heap) if classes and java() else None
    return _beside[token]


# --- blocks row by row


@dataclass
class Rowwise:
    """A block's entries by row, and by feature in each row."""

    key: tuple  # partition and place in it
    y: np.ndarray
    size: np.ndarray  # of each row
    feature: np.ndarray
    place: np.ndarray


@dataclass
class Table:
    """All blocks row by row, held by the executors, and what a task needs to put them together."""

    blocks: RDD
    keys: list[tuple]  # in order
    counts: list[tuple[int, int]]  # rows and entries of each
    positive: int
    classes: dict[str, bytes]
    bins: Broadcast

    @property
    def rows(self) -> int:
        return sum(n for n, _ in self.counts)

    @property
    def entries(self) -> int:
        return sum(m for _, m in self.counts)

    @property
    def first(self) -> dict[tuple, tuple[int, int]]:
        """First row and entry of each block."""
        ends = np.cumsum(np.array([(0, 0), *self.counts]), axis=0)[:-1].tolist()
        return dict(zip(self.keys, map(tuple, ends)))

    def sent(self) -> "Table":
        """For tasks, which get the blocks by themselves."""
        return Table(None, self.keys, self.counts, self.positive, self.classes, self.bins)

    def started(self, blocks: Iterator[Rowwise], extra: int) -> Kernels:
        """In a task: a process that holds the table. ``extra`` bytes come on top of it."""
        bins = self.bins.value
        kernels = Kernels(self.classes, ENTRY_BYTES * self.entries + 64 * self.rows + 64 * int(bins.at[-1]) + extra)
        kernels.feed(self, bins, blocks)
        return kernels


def fits(bins, count: int, entries: int) -> bool:
    """Whether training may hold all entries in a task."""
    features, places = len(bins.at) - 1, int(np.diff(bins.at).max(initial=0))
    return (count >= LEAST_ROWS and ENTRY_BYTES * entries <= TABLE_BYTES and 0 < features <= 10_000 and places <= 256
            and java() is not None)


def table(blocks: DataFrame, bins, count: int, entries: int) -> Table | None:
    """The blocks row by row; None where there is little to do, too much for a task, or no Java."""
    if not fits(bins, count, entries):
        return None
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(bins)

    def by_row(number, part):
        for i, r in enumerate(part):
            y = np.frombuffer(r.y, np.int8)
            row, bin_ = np.frombuffer(r.row, np.int32), np.frombuffer(r.bin, np.int32)
            # Entries come by bin, so a stable order by row has them by feature in each; numbers of 16 bits are sorted by radix.
            order = np.argsort(row.astype(np.uint16) if len(y) <= 1 << 16 else row, kind="stable")
            bin_ = bin_[order]
            feature = shared.value.feature[bin_]
            yield Rowwise((number, i), y, np.bincount(row, minlength=len(y)).astype(np.int32), feature.astype(np.uint16),
                          (bin_ - shared.value.at[feature]).astype(np.uint8))

    held = blocks.rdd.mapPartitionsWithIndex(by_row).persist(StorageLevel.MEMORY_AND_DISK)
    found = sorted(held.map(lambda b: (b.key, len(b.y), len(b.feature), int(b.y.sum()), java() is not None)).collect())
    if not all(here for *_, here in found):
        held.unpersist()
        return None
    return Table(held, [k for k, *_ in found], [(n, m) for _, n, m, *_ in found], sum(p for *_, p, _ in found), code(spark), shared)
