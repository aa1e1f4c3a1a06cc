"""Toxicity by a counterfactually regularised sentence classifier.

A sentence's logit is the sum of weights of its words; a word's weight is that of its own hash and of the
hashes of its first letters, so unseen endings of a known stem count. Labels are given for documents, so
the sentence that scores highest stands for its document, in training as in scoring: labels pass to
sentences in rounds, each round labels the highest sentence of a toxic document as toxic and the highest
ones of a clean document as clean, and fits the weights anew by logistic regression. Counterfactual pairs
are sentences whose logit must not differ: one that names a group, and its copies in which the name is
swapped for others of its kind; and, as a corpus may name no group at all, the highest sentence of every labelled
document, the same with a seeded name put in at a seeded place, and that with another name of the kind. The
sentence with the name in it is learnt from with the label its source has, and the squared
change of the logit within each pair, over all its words, is a penalty: weight cannot stay on names, so
sentences that name a group are not taken for toxic because toxic sentences often do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import BYTE_CODE, LOWER, Words, byte_set, held_out, mixed, passing, runs, seeded_share, utf8

BITS = 18
# First bytes of a word that have weights of their own.
STEMS = (4, 5, 6)
SENTENCE_WORDS = 40
# Labelled documents that are learnt from: at most so many of each label, and so many bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
TEXTS_AT_ONCE = 100
ROUNDS, STEPS = 3, 100
# Weights are fitted for hashes that toxic documents hold more often than chance gives, by so many deviations.
EVIDENCE = 4.0
SWAP_PENALTY = 10.0
SEED = 17

LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
BREAKS = byte_set((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))

# Names of groups of people by kind, in the languages of the corpus; a name is swapped for others of its kind.
GROUPS = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "wives", "husbands"),
    ("woman", "man", "girl", "boy", "mother", "father", "wife", "husband"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual", "transgender", "trans"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab", "indigenous"),
    ("americans", "mexicans", "germans", "turks", "poles", "chinese", "indians", "russians", "africans", "arabs"),
    ("old", "young", "elderly", "teenage", "blind", "deaf", "disabled", "autistic"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "locals"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
)
_KINDS = {name: (g, i) for g in GROUPS for i, name in enumerate(g)}


@dataclass
class Features:
    """Weights' numbers of sentences: ``index`` holds them for all words, ``word`` and ``text`` say where they are."""

    index: np.ndarray  # words x (1 + stems)
    sentence: np.ndarray  # sentence of each word
    text: np.ndarray  # text of each sentence
    sentences: int


def features(data: np.ndarray, at: np.ndarray) -> Features:
    words = Words(data, at, LETTERS, BYTE_CODE[LOWER])
    sums = words.sums()
    first, last = words.offset[:-1], words.offset[1:]
    mask = np.uint64((1 << BITS) - 1)
    columns = [mixed(sums[last] - sums[first]) & mask]
    for size in STEMS:
        stem = mixed((sums[np.minimum(first + size, last)] - sums[first]) ^ np.uint64(size << 32))
        columns.append(stem & mask)
    # A sentence ends with its mark or line, with its text, and after so many words.
    breaks = np.concatenate([[0], np.cumsum(BREAKS[data])])
    change = np.ones(len(words.start), bool)
    if len(words.start):
        change[1:] = (breaks[words.start[1:]] != breaks[words.start[:-1]]) | (words.text[1:] != words.text[:-1])
        opened = np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))
        change |= (np.arange(len(change)) - opened) % SENTENCE_WORDS == 0
    sentence = np.cumsum(change) - 1
    return Features(np.stack(columns, axis=1).astype(np.int64), sentence, words.text[change], int(change.sum()))


def logits(f: Features, weights: np.ndarray) -> np.ndarray:
    """Logit of each sentence, without the bias."""
    return np.bincount(f.sentence, weights[f.index].sum(axis=1), f.sentences)


def top_of_texts(f: Features, values: np.ndarray, texts: int, empty: float) -> np.ndarray:
    out = np.full(texts, -np.inf)
    np.maximum.at(out, f.text, values)
    return np.where(np.isinf(out), empty, out)


def swapped(sentence: str, per_name: int = 2) -> list[str]:
    """Copies of a sentence in which every group name is replaced by others of its kind."""
    if _KINDS.keys().isdisjoint(re.findall(r"[^\W\d_]+", sentence.lower())):
        return []

    def other(step):
        def name(match):
            word = match.group()
            if word.lower() not in _KINDS:
                return word
            group, i = _KINDS[word.lower()]
            return group[(i + step) % len(group)]

        return re.sub(r"[^\W\d_]+", name, sentence)

    return [other(step) for step in range(1, per_name + 1)]


def inserted(sentence: str, seed: int) -> tuple[str, str]:
    """The sentence with a name of a group put in, and with another name of the same kind in its place."""
    draw = np.random.default_rng([SEED, seed])
    words = sentence.split(" ")
    at, kind = int(draw.integers(len(words) + 1)), GROUPS[int(draw.integers(len(GROUPS)))]
    one, other = draw.choice(len(kind), 2, replace=False).tolist()
    return tuple(" ".join([*words[:at], kind[i], *words[at:]]) for i in (one, other))


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.string()))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def packed(self) -> tuple[np.ndarray, np.ndarray, float]:
        """What travels to the tasks: the weights that are not zero."""
        kept = np.flatnonzero(self.weights)
        return kept, self.weights[kept], self.bias

    @staticmethod
    def unpacked(kept: np.ndarray, values: np.ndarray, bias: float) -> Classifier:
        weights = np.zeros(1 << BITS, np.float32)
        weights[kept] = values
        return Classifier(weights, bias)

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        f = features(data, at)
        return _sigmoid(top_of_texts(f, logits(f, self.weights) + self.bias, len(at) - 1, self.bias - 2.0))


def sentences_of(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?\n])", text) if re.search(r"[^\W\d_]", s)]


@dataclass
class Fitted(Classifier):
    """A classifier and the number of counterfactual pairs it was held to."""

    pairs: int = 0


def fit(texts: list[str], toxic: list[int], penalty: float = SWAP_PENALTY, steps: int = STEPS, rounds: int = ROUNDS) -> Fitted:
    """Fit weights to labelled texts; without texts of both labels everything scores below one half."""
    size = 1 << BITS
    labels = np.array(toxic, np.float64)
    if not len(texts) or labels.min() == labels.max():
        return Fitted(np.zeros(size, np.float32), -2.0)

    def parts():
        """Sentences of the texts, some texts at a time: (text numbers, sentences, features)."""
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            pieces = [(i, s) for i in range(start, min(start + TEXTS_AT_ONCE, len(texts))) for s in sentences_of(texts[i])]
            yield np.array([i for i, _ in pieces], np.int64), [s for _, s in pieces], features(*_of([s for _, s in pieces]))

    # Only hashes that tell toxic documents from others get a weight; it begins with the log odds.
    holds, total = np.zeros(size), np.zeros(size)
    for numbers, _, raw in parts():
        # Sentences are cut by length, so a piece may be several sentences.
        seen = np.unique((numbers[raw.text][raw.sentence][:, None] << BITS) + raw.index)
        holds += np.bincount(seen & (size - 1), labels[seen >> BITS], size)
        total += np.bincount(seen & (size - 1), minlength=size)
    chance = total * labels.mean()
    used = np.flatnonzero((holds - chance) / np.sqrt(chance + 1) > EVIDENCE)
    odds = np.log((holds + 0.5) / (labels.sum() + 1)) - np.log((total - holds + 0.5) / ((1 - labels).sum() + 1))
    w = odds[used] / (1 + len(STEMS))
    # Names have weights too, so that there is something to hold down.
    names = features(*_of([n for group in GROUPS for n in group])).index.ravel()
    used = np.append(used, np.setdiff1d(names, used))
    w = np.append(w, np.zeros(len(used) - len(w)))
    bias = -2.0
    # The last weight is that of all other hashes and stays zero.
    number = np.full(size, len(used), np.int32)
    number[used] = np.arange(len(used))

    def told(raw):
        index = number[raw.index]
        words = np.flatnonzero((index < len(used)).any(axis=1))
        return index[words], raw.sentence[words]

    n, pieces, kept = 0, 0, {k: [] for k in ("dense", "place", "owner", "piece")}
    pairs: list[tuple[str, str]] = []
    for numbers, sentences, raw in parts():
        dense, place_of = told(raw)
        pairs += [(s, copy) for s in sentences for copy in swapped(s)]
        kept["dense"].append(dense)
        kept["place"].append(place_of + n)
        kept["owner"].append(numbers[raw.text])
        kept["piece"].append(raw.text + pieces)
        n += raw.sentences
        pieces += len(sentences)
    if not n:
        return Fitted(np.zeros(size, np.float32), -2.0)
    dense, place_of, owner, piece = (np.concatenate(kept[k]) for k in kept)

    # The highest sentence of every text so far takes a name.
    value = np.bincount(place_of, np.append(w, 0.0)[dense].sum(axis=1), n)
    order = np.lexsort((-value, owner))
    source = order[np.append(True, owner[order][1:] != owner[order][:-1])]
    wanted, named, at = set(piece[source].tolist()), {}, 0
    for text in texts:
        for sentence in sentences_of(text):
            if at in wanted:
                named[at] = sentence, *inserted(sentence, at)
            at += 1
    found = [named[p] for p in piece[source].tolist()]
    pairs = [*pairs, *[(a, b) for a, b, _ in found], *[(b, c) for _, b, c in found]]

    def sides(which):
        """Weights' numbers and pair of the words of one side of all pairs."""
        index, pair = [], []
        for start in range(0, len(pairs), 50 * TEXTS_AT_ONCE):
            raw = features(*_of([p[which] for p in pairs[start : start + 50 * TEXTS_AT_ONCE]]))
            held, sentence = told(raw)
            index.append(held)
            pair.append(raw.text[sentence] + start)
        return np.concatenate(index), np.concatenate(pair)

    one, other = sides(0), sides(1)
    # The sentences with a name in them, learnt from beside the labelled ones.
    copies = features(*_of([b for _, b, _ in found]))
    copy_index, copy_at = told(copies)
    copy_at = copies.text[copy_at]

    def values(index, sentence, count):
        return np.bincount(sentence, np.append(w, 0.0)[index].sum(axis=1), count)

    def slopes(index, sentence, slope):
        return np.bincount(index.ravel(), np.repeat(slope[sentence], index.shape[1]), len(used) + 1)[:-1]

    m = v = mb = vb = 0.0
    step = 0
    for _ in range(rounds):
        value = values(dense, place_of, n) + bias
        order = np.lexsort((-value, owner))
        first = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        chosen = order[np.where(labels[owner[order]] > 0, place == 0, place < 6)]
        y, share = np.zeros(n), np.zeros(n)
        y[chosen] = labels[owner[chosen]]
        share[chosen] = 1.0
        share /= np.where(y > 0, max((share * y).sum(), 1), max((share * (1 - y)).sum(), 1))
        for _ in range(steps):
            step += 1
            alone = values(dense, place_of, n)
            slope = share * (_sigmoid(alone + bias) - y)
            copied = share[source] * (_sigmoid(values(copy_index, copy_at, len(source)) + bias) - y[source])
            g = slopes(dense, place_of, slope) + slopes(copy_index, copy_at, copied) + 1e-4 * w
            gb = slope.sum() + copied.sum()
            apart = penalty * 2 * (values(*one, len(pairs)) - values(*other, len(pairs))) / len(pairs)
            g += slopes(*one, apart) - slopes(*other, apart)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            w = w - 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            bias -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    # One half is put where most documents fall on their side, clean ones first.
    value = values(dense, place_of, n) + bias
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, value)
    cuts = np.unique(best[np.isfinite(best)])
    clean = np.sort(best[labels == 0])
    hot = np.sort(best[labels == 1])
    middles = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    wrong = (len(clean) - np.searchsorted(clean, middles)) / len(clean) * 2 + np.searchsorted(hot, middles) / len(hot)
    flat = np.flatnonzero(wrong == wrong.min())
    bias -= float(middles[flat[len(flat) // 2]])
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Fitted(weights, bias, len(pairs))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Fitted:
    """Fit to a bounded sample of labelled documents that are not held out, equally many of both labels.

    Of each label about ``sample`` documents are drawn, and of these, in seeded order, those that fit into
    ``sample_bytes`` together. Texts of both labels are taken whole, as in scoring: words of long texts are no
    evidence, and one half is set on the highest sentences of whole texts.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(~held_out()).withColumn("_order", seeded_share(SEED, "doc_id"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("toxic") == label) & (F.col("_order") < min(1.0, sample / n)))
    chosen = marked.filter(keep)
    # About 2 * sample rows, whatever the size of the tables: small enough to send around.
    drawn = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null").join(
        F.broadcast(chosen.select("doc_id", "toxic", "_order")), "doc_id")
    upto = F.expr(
        "sum(octet_length(text)) over (partition by toxic > 0 order by _order, doc_id, text rows unbounded preceding)")
    rows = drawn.withColumn("_upto", upto).filter(F.col("_upto") <= sample_bytes).select("doc_id", "toxic", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def score_documents(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, held_out, score, predicted``: every whole text, from its text alone.

    A null or empty text, or one without letters, scores below one half, always the same. Rows that repeat
    are scored again, a null doc_id stays null (and counts as held out). Other columns are not read.
    """
    packed = model.packed()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier.unpacked(*packed)
        for batch in batches:
            for part in runs(batch, "text"):
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(own.scores(*utf8(part.column("text"))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(work, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs``, all columns, that do not score one half or more."""
    packed = model.packed()

    def judge(texts: pa.Array) -> np.ndarray:
        return Classifier.unpacked(*packed).scores(*utf8(texts)) < 0.5

    return docs.filter(passing(judge)(F.col("text").cast("string")))
