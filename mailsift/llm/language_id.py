"""Language identification by a bidirectional gated recurrent network over bytes.

One pass of gated units reads the bytes forwards, one backwards; both states at a byte give the
probabilities of the languages at that position, and a document's probabilities are the means over its
letters. The network is trained in numpy by backpropagation through time on passages of labelled
documents. In use, texts are cut into windows with a few bytes of context on both sides, so that many
windows go through the network side by side; every byte is labelled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import Workspace, byte_set, held_out, passing, runs, seeded_share, utf8
from mailsift.workspace import sized

UNITS = 8
WINDOW, CONTEXT = 192, 8
WINDOWS_AT_ONCE = 4096
# Documents of each language that are learnt from, at most; passages of each, and their characters.
SAMPLE, PASSAGES, PASSAGE = 400, 4, 60
STEPS, BATCH, RATE = 160, 192, 0.02
SEED = 4
# A text is accepted from the probability on that all but this share of labelled documents give to their own language,
# and from this far up the way from equal probabilities to certainty.
REJECTED, MARGIN = 0.01, 0.25
# Buckets that probabilities are counted by, and the most of them that are sorted.
BUCKETS = 4096
UNKNOWN = "und"

LETTER_BYTES = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    """``inputs`` (2, 256, 3 units): what a byte adds to update, reset and candidate, forwards and backwards."""

    languages: list[str]
    inputs: np.ndarray
    gates: np.ndarray  # (2, units, 2 units)
    candidate: np.ndarray  # (2, units, units)
    out: np.ndarray  # (2 units, languages)
    bias: np.ndarray

    def parameters(self):
        return [self.inputs, self.gates, self.candidate, self.out, self.bias]


def fresh(languages: list[str], units: int = UNITS, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        languages, draw(2, 256, 3 * units, scale=0.5), draw(2, units, 2 * units, scale=units**-0.5),
        draw(2, units, units, scale=units**-0.5), draw(2 * units, len(languages), scale=0.2),
        np.zeros(len(languages), np.float32))


def states(net: Network, data: np.ndarray, valid: np.ndarray, keep: bool = False):
    """States (steps, windows, 2 units) for ``data`` (steps, windows) of bytes; invalid bytes leave them as they are."""
    steps, windows = data.shape
    units = net.candidate.shape[1]
    out = np.empty((steps, windows, 2 * units), np.float32)
    h = np.zeros((2, windows, units), np.float32)
    trace = []
    plain = bool(valid.all())
    for t in range(steps):
        back = steps - 1 - t
        x = np.stack([net.inputs[0][data[t]], net.inputs[1][data[back]]])
        gate = _sigmoid(x[:, :, : 2 * units] + h @ net.gates)
        update, reset = gate[:, :, :units], gate[:, :, units:]
        inner = h @ net.candidate
        new = np.tanh(x[:, :, 2 * units :] + reset * inner)
        step = update * (new - h)
        if not plain:
            step *= np.stack([valid[t], valid[back]])[:, :, None]
        if keep:
            trace.append((h, update, reset, inner, new))
        h = h + step
        out[t, :, :units] = h[0]
        out[back, :, units:] = h[1]
    return (out, trace) if keep else out


def _softmax(x):
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _gradients(net: Network, data: np.ndarray, valid: np.ndarray, counted: np.ndarray, truth: np.ndarray):
    """Loss and its gradients, averaged over the counted positions."""
    units = net.candidate.shape[1]
    out, trace = states(net, data, valid, keep=True)
    p = _softmax(out @ net.out + net.bias)
    total = max(counted.sum(), 1)
    loss = -(np.log(np.take_along_axis(p, truth[None, :, None], 2)[:, :, 0] + 1e-9) * counted).sum() / total
    d = p.copy()
    d[:, np.arange(len(truth)), truth] -= 1
    d *= (counted / total)[:, :, None]
    g_out = np.tensordot(out, d, ([0, 1], [0, 1]))
    g_bias = d.sum(axis=(0, 1))
    d_out = d @ net.out.T
    g_in, g_gates, g_cand = np.zeros_like(net.inputs), np.zeros_like(net.gates), np.zeros_like(net.candidate)
    steps = len(data)
    dh = np.zeros((2, data.shape[1], units), np.float32)
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        h, update, reset, inner, new = trace[t]
        dh = dh + np.stack([d_out[t, :, :units], d_out[back, :, units:]])
        step = dh * np.stack([valid[t], valid[back]])[:, :, None]
        d_new = step * update * (1 - new * new)
        d_update = step * (new - h) * update * (1 - update)
        d_reset = d_new * inner * reset * (1 - reset)
        d_inner = d_new * reset
        d_gate = np.concatenate([d_update, d_reset], axis=2)
        g_gates += h.transpose(0, 2, 1) @ d_gate
        g_cand += h.transpose(0, 2, 1) @ d_inner
        d_x = np.concatenate([d_gate, d_new], axis=2)
        for side, at in ((0, t), (1, back)):
            order = np.argsort(data[at], kind="stable")
            values = data[at][order]
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            g_in[side][values[first]] += np.add.reduceat(d_x[side][order], first, axis=0)
        dh = dh - step * update + d_gate @ net.gates.transpose(0, 2, 1) + d_inner @ net.candidate.transpose(0, 2, 1)
    return loss, [g_in, g_gates, g_cand, g_out.astype(np.float32), g_bias]


def train(passages: list[bytes], truth: list[int], languages: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam over drawn batches, equally many passages of each language on average."""
    net = fresh(languages, seed=seed)
    if len(languages) < 2 or not passages:
        return net
    rng = np.random.default_rng(seed)
    longest = max(map(len, passages))
    data = np.zeros((len(passages), longest), np.int64)
    valid = np.zeros((len(passages), longest), np.float32)
    for i, passage in enumerate(passages):
        data[i, : len(passage)] = np.frombuffer(passage, np.uint8)
        valid[i, : len(passage)] = 1
    counted = valid * LETTER_BYTES[data]
    labels = np.array(truth)
    chance = 1.0 / np.bincount(labels, minlength=len(languages))[labels]
    chance /= chance.sum()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        at = rng.choice(len(passages), min(BATCH, len(passages)), p=chance)
        _, gradients = _gradients(net, data[at].T, valid[at].T, counted[at].T, labels[at])
        size = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        rate = RATE * min(1.0, 3 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), gradients, moments):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _run(table: np.ndarray, weights: np.ndarray, data: np.ndarray, valid: np.ndarray | None, out: np.ndarray) -> None:
    """One direction of the network over (steps, windows) of bytes; states go to ``out`` (steps, units, windows).

    The same sums as in ``states``, with units in rows, halves folded into the weights and no new arrays.
    """
    units, windows = out.shape[1], data.shape[1]
    h = np.zeros((units, windows), np.float32)
    x, g = np.empty((3 * units, windows), np.float32), np.empty((3 * units, windows), np.float32)
    gate, new, inner = x[: 2 * units], x[2 * units :], g[2 * units :]
    for t in range(len(data)):
        np.take(table, data[t], axis=1, out=x, mode="clip")
        np.matmul(weights, h, out=g)
        gate += g[: 2 * units]
        np.tanh(gate, out=gate)
        gate += 1
        inner *= x[units : 2 * units]
        new += inner
        np.tanh(new, out=new)
        new -= h
        new *= x[:units]
        new *= 0.5 if valid is None else valid[t]
        h += new
        out[t] = h


def document_probabilities(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean probabilities over the letters of each text, texts laid end to end; zeros without letters."""
    texts = len(at) - 1
    sums = np.zeros((texts, len(net.languages)))
    letters = np.zeros(texts)
    units = net.candidate.shape[1]
    tables, weights = [], []
    for side in (0, 1):
        scale = np.repeat(np.array([0.5, 1.0], np.float32), [2 * units, units])[:, None]
        tables.append(np.ascontiguousarray(net.inputs[side].T * scale))
        weights.append(np.concatenate([net.gates[side].T, net.candidate[side].T]) * np.float32(0.5))
    sizes = at[1:] - at[:-1]
    windows = -(-sizes // WINDOW)
    text = np.repeat(np.arange(texts), windows)
    start = at[text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows))
    # Windows of like length go together, so that short texts cost little.
    length = np.minimum(at[text + 1], start + WINDOW) - start
    order = np.argsort(length, kind="stable")
    for k in range(0, len(order), WINDOWS_AT_ONCE):
        part = order[k : k + WINDOWS_AT_ONCE]
        span = int(length[part].max())
        where = start[part][None, :] + np.arange(-CONTEXT, span + CONTEXT)[:, None]
        valid = (where >= at[text[part]]) & (where < at[text[part] + 1])
        values = data[np.where(valid, where, 0)].astype(np.intp)
        halves = None if valid.all() else valid * np.float32(0.5)
        out = np.empty((len(values), 2 * units, len(part)), np.float32)
        _run(tables[0], weights[0], values, halves, out[:, :units])
        _run(tables[1], weights[1], values[::-1], None if halves is None else halves[::-1], out[::-1, units:])
        p = np.matmul(net.out.T, out[CONTEXT : CONTEXT + span])
        p += net.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        mine = np.arange(span)[:, None] < length[part][None, :]
        counted = mine & LETTER_BYTES[values[CONTEXT : CONTEXT + span]]
        p *= (counted / p.sum(axis=1))[:, None, :]
        np.add.at(sums, text[part], p.sum(axis=0).T)
        np.add.at(letters, text[part], counted.sum(axis=0))
    return sums / np.maximum(letters, 1)[:, None]


def learn(docs: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Network:
    """Train on seeded passages of at most ``sample`` labelled documents of each language, none held out."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter(
        "lang is not null and text is not null and length(text) > 0").filter(~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return fresh([])
    share = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, sample / counts[lang]))])
    rows = rows.filter(seeded_share(SEED, "doc_id") < share[F.col("lang")])
    place = F.floor(seeded_share(SEED + 1, "doc_id", "k") * F.greatest(F.length("text") - PASSAGE, F.lit(0))) + 1
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, range(PASSAGES)))))
    passages = rows.select("doc_id", "k", "lang", F.substring("text", place.cast("int"), F.lit(PASSAGE)).alias("p"))
    found = sorted(tuple(r) for r in passages.collect())
    return train([r[3].encode() for r in found], [languages.index(r[2]) for r in found], languages, steps)


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: the likeliest learnt language of each whole text, and its probability.

    A text that is null or has no letter, and any text if nothing was learnt, is ``und`` with score 0. A tie
    goes to the first language by code point. Rows that repeat are labelled again, a null doc_id stays null
    (and counts as held out), texts of any length are read whole. Other columns are not read.
    """
    names = np.array([*net.languages, UNKNOWN])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "text"):
                column = part.column("text")
                data, at = utf8(column)
                if not net.languages:
                    best, score = np.zeros(len(column), int), np.zeros(len(column))
                else:
                    p = document_probabilities(net, data, at)
                    best = p.argmax(axis=1)
                    score = p[np.arange(len(p)), best].clip(0, 1)
                    none = np.array([t is None or not _LETTER.search(t) for t in column.to_pylist()], bool)
                    best[none], score[none] = len(net.languages), 0.0
                yield pa.record_batch([part.column("doc_id"), pa.array(names[best]), pa.array(score)],
                                      ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.mapInArrow(work, "doc_id bigint, lang_pred string, score double")
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _floor(net: Network) -> float:
    """The least probability that any text must reach."""
    return (1 + MARGIN * (len(net.languages) - 1)) / len(net.languages)


def with_probabilities(docs: DataFrame, net: Network) -> DataFrame:
    """Append ``_likeliest``, the highest probability of a text (-1 without a letter), and ``_own``, that of the row's own
    label, where the row is labelled with a learnt language, has a letter and is not held out.
    """
    names = pa.array(net.languages, pa.string())

    def judge(texts: pa.Array, langs: pa.Array) -> pa.Array:
        likeliest, own = [np.zeros(0)], [np.zeros(0)]
        for part in runs(pa.record_batch([texts, langs], ["text", "lang"]), "text"):
            column = part.column("text")
            good = np.array([t is not None and bool(_LETTER.search(t)) for t in column.to_pylist()], bool)
            if net.languages:
                p = document_probabilities(net, *utf8(column))
                label = pc.index_in(part.column("lang"), names).to_numpy(zero_copy_only=False)
                known = good & ~np.isnan(label.astype(float))
                mine = np.full(len(p), np.nan)
                mine[known] = p[known, label[known].astype(int)]
            else:
                p, mine = np.zeros((len(column), 1)), np.full(len(column), np.nan)
            likeliest.append(np.where(good, p.max(axis=1), -1.0))
            own.append(mine)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(likeliest)), pa.array(np.concatenate(own), from_pandas=True)], ["likeliest", "own"])

    told = F.arrow_udf(judge, "likeliest double, own double")
    lang = F.when(~held_out(), F.col("lang").cast("string"))
    both = docs.withColumn("_told", told(F.col("text").cast("string"), lang))
    return both.withColumns({"_likeliest": F.col("_told.likeliest"), "_own": F.col("_told.own")}).drop("_told")


def least_probability(docs: DataFrame, net: Network, rejected: float = REJECTED) -> float:
    """The probability from which on a text counts as one of a learnt language, from all labelled documents not held out.

    It is the probability that all but the share ``rejected`` of these whole texts reach for their own language. With less
    than two languages nothing can be told from the probability: 0.
    """
    return _least(sized(with_probabilities(docs, net).select("_own"), "own-language"), net, rejected)


def _least(judged: DataFrame, net: Network, rejected: float = REJECTED) -> float:
    if len(net.languages) < 2:
        return 0.0
    own = judged.filter("_own is not null").select(F.col("_own").alias("v"))
    count = own.count()
    return max(_floor(net), value_at(own, int(rejected * (count - 1)))) if count else _floor(net)


def value_at(values: DataFrame, rank: int, buckets: int = BUCKETS) -> float:
    """The value ``v``, from 0 to 1, that as many others stand before as ``rank`` says, among all rows.

    Counts by bucket tell the bucket that holds it, which is cut into buckets again until it is small.
    """
    low, width = 0.0, 1.0
    for _ in range(4):
        bucket = F.least(F.greatest(F.floor((F.col("v") - low) / width * buckets), F.lit(0)), F.lit(buckets - 1))
        held = values.withColumn("b", bucket)
        for b, n in sorted(held.groupBy("b").agg(F.count("*")).collect()):
            if rank < n:
                break
            rank -= n
        values, low, width = held.filter(F.col("b") == b).select("v"), low + width * b / buckets, width / buckets
        if n <= buckets:
            return sorted(r.v for r in values.collect())[rank]
    # What is still together differs by less than a rounding error.
    return values.agg(F.min("v").alias("v")).first().v


def stage(docs: DataFrame, net: Network, work: Workspace) -> DataFrame:
    """The rows of ``docs`` that are ``accepted`` from ``least_probability`` on; every text goes through the network once."""
    judged = work.keep(with_probabilities(docs, net))
    return judged.filter(F.col("_likeliest") >= _least(judged, net)).select(*docs.columns)


def accepted(docs: DataFrame, net: Network, least: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learnt language with a probability of ``least`` or more.

    Nothing is rejected for its language if none was learnt, but for having no letter.
    """

    def judge(texts: pa.Array) -> np.ndarray:
        good = np.array([t is not None and bool(_LETTER.search(t)) for t in texts.to_pylist()], bool)
        if net.languages:
            good &= document_probabilities(net, *utf8(texts)).max(axis=1) >= least
        return good

    return docs.filter(passing(judge)(F.col("text").cast("string")))
