"""The operators against brute force, exact round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from mailsift.llm import (
    fingerprints, hard_negatives, html_extraction, language_id, lexical_search, license_scan, mixing, ngram_join, packing,
    sharding, token_attribution, toxicity,
)
from mailsift.llm.chunk_encoder import ChunkEncoder
from mailsift.llm.common import Workspace, utf8
from mailsift.llm.components import components

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def run(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir).toPandas()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- licence scan


def test_license_scan_against_plain_search(spark, sf_dir, documents):
    found = run(spark, sf_dir, "op1_license_scan").set_index("doc_id")
    for row in documents.itertuples():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(row.text or ""))
        places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words))
                  if words[i : i + len(phrase.split())] == phrase.split()]
        got = found.loc[row.doc_id]
        assert (got.n_words, got.n_base) == (len(words), len(places))
        assert got.base_labels == ",".join(sorted({label for _, label in places}))
        if places:
            assert (got.first_word, got.last_word) == (min(places)[0], max(places)[0])
        assert set(filter(None, got.base_labels.split(","))) <= set(got.labels.split(",")) and 0 <= got.score <= 1


def test_template_automata():
    template = "Licensed <<beginOptional>>only <<beginOptional>>and solely<<endOptional>> <<endOptional>>under <<var;1,3>> terms"
    accepts = license_scan.Automaton(template).accepts
    for text, end in [("licensed under these terms", 4), ("licensed only under a b c terms x", 7), ("licensed under terms", 0),
                      ("licensed only and solely under our terms", 7), ("licensed under a b c d terms", 0),
                      ("licensed and solely under our terms", 0), ("licensed under these other conditions", 0)]:
        assert accepts(text.encode().split(), 0) == end, text


# --- toxicity


def test_swapping_names_hardly_changes_scores():
    base = ["The {} people met here.", "Those {} are worthless scum.", "Our {} friends sing."]
    texts, labels = [], []
    for i in range(60):
        texts.append(base[1].format("muslim") + f" And more {i}.")  # toxic sentences always name one group
        labels.append(1)
        texts.append(base[0].format(["christian", "hindu", "sikh"][i % 3]) + f" And more {i}.")
        labels.append(0)
    texts += [f"You worthless scum, go {i}." for i in range(10)]
    labels += [1] * 10
    free, held = toxicity.fit(texts, labels, penalty=0.0), toxicity.fit(texts, labels, penalty=10.0)
    score = lambda m, t: m.scores(*toxicity._of([t]))[0]
    neutral = ["The muslim people met here.", "The christian people met here."]
    apart = [abs(np.subtract(*[np.log(s / (1 - s)) for s in (score(m, t) for t in neutral)])) for m in (free, held)]
    assert apart[1] < 0.3 * apart[0]
    assert score(held, neutral[0]) < 0.5 < score(held, "Those folks are worthless scum.")


def test_pairs_of_the_given_tables_hold_names_down(spark):
    """No given document names a group; names are put in, and the penalty acts on the fit."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.learn(docs, labels)
    assert held.pairs >= 300
    rows = docs.join(labels, "doc_id").filter("toxic is not null and text is not null").toPandas()
    rows["held_out"] = [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]
    known = rows[~rows.held_out].sort_values("doc_id")
    # A corpus with a bias: toxic sentences mostly name one group.
    judge = toxicity.learn(docs, labels)
    names = ("muslims", "refugees", "frauen", "homosexual")
    texts = []
    for i, (text, toxic) in enumerate(zip(known.text, known.toxic)):
        cut = [s.strip() for s in toxicity.sentences_of(text)]
        if toxic and cut and i % 5:
            top = int(np.argmax([judge.scores(*toxicity._of([s]))[0] for s in cut]))
            cut[top] = f"{names[i % 4]} {cut[top]}"
        texts.append(" ".join(cut))
    fits = [toxicity.fit(texts, known.toxic.tolist(), penalty=p) for p in (0.0, toxicity.SWAP_PENALTY)]
    assert not np.array_equal(fits[0].weights, fits[1].weights)
    clean = rows[rows.held_out & (rows.toxic == 0)].text.tolist()
    mentions = [f"{n} met here. {t}" for t in clean for n in names]
    rates = [(f.scores(*toxicity._of(mentions)) >= 0.5).mean() for f in fits]
    shifts = [np.abs([np.subtract(*f.scores(*toxicity._of([f"{n} met here.", "met here."]))) for n in names]).mean() for f in fits]
    assert rates[1] <= rates[0] and shifts[1] < 0.5 * shifts[0], (rates, shifts)


def test_bytes_learnt_from_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}. " * 100) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda found, toxic: list(zip(found, toxic)))
    found = toxicity.learn(docs, labels, sample_bytes=5000)
    for label in (0, 1):
        sizes = [len(t) for t, y in found if y == label]
        assert sizes and sum(sizes) <= 5000


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = run(spark, sf, "op2_toxicity")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    rows = found[found.held_out].merge(labels, on="doc_id")
    toxic = rows.toxic == 1
    assert (rows.predicted[toxic] == 1).mean() > 0.75 and (rows.predicted[~toxic] == 1).mean() < 0.01
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in found[found.held_out].doc_id)


def test_toxicity_learns_from_whole_texts_of_both_labels(spark, monkeypatch):
    texts = {i: f"text {i}. " * 2000 for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda found, toxic: list(zip(found, toxic)))
    found = toxicity.learn(docs, labels)
    assert {y for _, y in found} == {0, 1} and {t for t, _ in found} <= set(texts.values())


def test_long_clean_documents_that_are_held_out_pass(spark):
    sf = "/root/testdata/sf0.1"
    found = run(spark, sf, "op2_toxicity").merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    sizes = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "length(text) AS chars").toPandas()
    rows = found.merge(sizes, on="doc_id")
    rows = rows[rows.held_out & (rows.toxic == 0) & (rows.chars > 4000)]
    assert len(rows) >= 50 and rows.predicted.mean() <= 0.05


# --- fingerprints


def test_fingerprints_against_sets(spark, sf_dir, documents):
    found = run(spark, sf_dir, "op3_fingerprints").set_index("doc_id")
    pieces = lambda t: set(re.findall(r"[^\n]{1,200}[^\n.!?]*[.!?]*", t))
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    texts = [t or "" for t in documents.text[::-1]]
    for i, doc_id in enumerate(documents.doc_id[::-1]):
        text, follower = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        row = found.loc[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == pytest.approx(likeness(pieces(text), pieces(edited)))
        assert row.near_next == pytest.approx(likeness(pieces(text), pieces(follower)))
    by_text = documents.assign(f=found.loc[documents.doc_id].fingerprint.values).groupby("text").f.nunique()
    assert (by_text == 1).all()


def test_difference_is_recovered_at_every_size(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (0, 1, 2, 5, 11, 30, 200, 900):
        pool = [int(x) for x in rng.integers(-(2**62), 2**62, 2 * n + 3)]
        rows.append((sorted(pool[: n + 2]), sorted(pool[n // 2 :])))
    table = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    for row in table.withColumn("d", fingerprints.difference(F.col("a"), F.col("b"))).collect():
        assert sorted((x.c, x.k) for x in row.d) == sorted(
            [(1, k) for k in set(row.a) - set(row.b)] + [(-1, k) for k in set(row.b) - set(row.a)])


# --- language


def test_language_on_held_out_documents(spark, documents):
    sf = "/root/testdata/sf0.01"
    found = run(spark, sf, "op4_language_id")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    rows = found.merge(truth, on="doc_id")
    assert (rows.lang == rows.lang_pred)[rows.held_out].mean() > 0.97 and found.score.between(0, 1).all()


def test_letter_junk_and_unlearnt_languages_are_rejected(spark, sf_dir, documents):
    rng = np.random.default_rng(3)
    junk = [" ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60)) for _ in range(100)]
    schema = "doc_id bigint, text string, lang string"
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(
        [*documents[["doc_id", "text", "lang"]].itertuples(index=False, name=None), *[(10**6 + i, t, None) for i, t in enumerate(junk)]],
        schema), sf_dir).toPandas()
    assert (kept.doc_id >= 10**6).sum() <= 0.2 * len(junk) and (kept.doc_id < 10**6).sum() > 0.95 * len(documents)
    # German documents without labels: a language that is not learnt.
    unlearnt = documents.assign(lang=documents.lang.where(documents.lang != "de", None))[["doc_id", "text", "lang"]]
    kept = corpus_pipeline.identify_language(
        spark, spark.createDataFrame(list(unlearnt.itertuples(index=False, name=None)), schema), sf_dir).toPandas()
    assert kept.lang.isna().sum() <= 0.2 * unlearnt.lang.isna().sum()
    assert kept.lang.notna().sum() > 0.95 * unlearnt.lang.notna().sum()


def test_one_language_leaves_only_the_letters_to_decide(spark):
    docs = spark.createDataFrame([(i, f"some words in English {i}", "en") for i in range(30)], "doc_id bigint, text string, lang string")
    net = language_id.learn(docs, steps=2)
    assert language_id.least_probability(docs, net) == 0 and language_id.accepted(docs, net, 0.0).count() == 30


def test_the_least_probability_is_that_of_all_labelled_documents(spark, sf_dir, documents):
    """The one that a sort of all finds, also with fewer drawn documents than there are, and the stage keeps what reaches it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.learn(docs, sample=5, steps=20)
    rows = language_id.with_probabilities(docs, net).select("doc_id", "text", "lang", "_likeliest", "_own").collect()
    own = []
    for r in rows:
        p = language_id.document_probabilities(net, *utf8(pa.array([r.text], pa.string())))[0]
        letter = r.text is not None and any(c.isalpha() for c in r.text)
        assert r._likeliest == (pytest.approx(p.max(), abs=1e-6) if letter else -1)
        learnt = letter and r.lang in net.languages and zlib.crc32(str(r.doc_id).encode()) % 5 != 0
        assert (r._own is None) == (not learnt)
        if learnt:
            assert r._own == pytest.approx(p[net.languages.index(r.lang)], abs=1e-6)
            own.append(r._own)
    for share in (0.0, 0.3, 0.9):
        want = max(language_id._floor(net), sorted(own)[int(share * (len(own) - 1))])
        assert language_id.least_probability(docs, net, rejected=share) == pytest.approx(want, abs=1e-6)
    values = spark.createDataFrame([(v,) for v in [*own, *[0.5] * 40, 0.0, 1.0]], "v double").cache()
    for rank in (0, 7, len(own) // 2, len(own) + 41):
        assert language_id.value_at(values, rank, buckets=8) == sorted([*own, *[0.5] * 40, 0.0, 1.0])[rank]
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    full = language_id.learn(docs)
    again = language_id.accepted(docs, full, language_id.least_probability(docs, full))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {
        r.doc_id for r in again.select("doc_id").collect()}


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(0)
    net = language_id.fresh(["a", "b"], units=3, seed=1)
    for name in ("inputs", "gates", "candidate", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    data = rng.integers(60, 70, (6, 4))
    valid = np.ones((6, 4))
    valid[4:, 1] = 0
    args = (data, valid, valid, np.array([0, 1, 1, 0]))
    _, gradients = language_id._gradients(net, *args)
    for p, g in zip(net.parameters(), gradients):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            was, loss = p[at], []
            for step in (1e-2, -1e-2):
                p[at] = was + step
                loss.append(language_id._gradients(net, *args)[0])
            p[at] = was
            assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[at], abs=2e-3)


def test_windows_label_like_the_whole_text():
    net = language_id.fresh(["a", "b", "c"])
    data = np.frombuffer(("Hello wörld, " * 10).encode(), np.uint8)
    states = language_id.states(net, data[:, None].astype(int), np.ones((len(data), 1), np.float32))
    p = language_id._softmax(states @ net.out + net.bias)[:, 0][language_id.LETTER_BYTES[data]].mean(axis=0)
    assert language_id.document_probabilities(net, data, np.array([0, len(data)]))[0] == pytest.approx(p, abs=1e-5)


# --- mixing


def sainte_lague(votes, total):
    won = dict.fromkeys(votes, 0)
    for _ in range(total):
        best = max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return won


@pytest.mark.parametrize("total", [0, 1, 7, 100, 999])
def test_seats_by_highest_quotients(spark, total):
    votes = {i: v for i, v in enumerate([0, 1, 1, 5, 17, 400, 401, 3, 90_000, 12])}
    table = spark.createDataFrame([(k, v, total) for k, v in votes.items()], "k int, v bigint, total bigint")
    got = {r.k: r.seats for r in mixing.seats(table, [], "v", "total", ["k"]).collect()}
    assert got == sainte_lague(votes, total)


def fill(sizes, weights, share, most):
    total, full, targets = share * sum(sizes), set(), {}
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = rest / sum(weights[i % len(weights)] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i % len(weights)] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else level * weights[i % len(weights)] for i in range(len(sizes))]
        full |= over


def test_targets_against_refilling(spark):
    sizes = [10, 5000, 300, 20, 7000, 0, 900]
    table = spark.createDataFrame([(s, n) for s, n in zip([*"abcdef", None], sizes)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert [got[s] for s in [*"abcdef", None]] == pytest.approx(fill(sizes, (5, 2, 1), 1.5, 2))


def test_mix_takes_its_targets(spark, sf_dir, documents):
    found = run(spark, sf_dir, "op5_mixing").merge(documents[["doc_id", "source", "text"]], on="doc_id")
    assert (found["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in found.text]).all()
    assert (found.taken <= 2 * found["size"]).all()
    sums = found.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.told).all()
    assert ((sums.taken - sums.target).abs() <= 2 * mixing.BLOCK_WORDS).all()
    again = run(spark, sf_dir, "op5_mixing")
    pd.testing.assert_frame_equal(again.sort_values("doc_id", ignore_index=True), found[again.columns].sort_values("doc_id", ignore_index=True))


# --- token attribution


def test_tokens_of_sections_add_up(spark, sf_dir, documents):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = run(spark, sf_dir, "op6_token_attribution")
    sums = found.groupby("doc_id").agg(tokens=("tokens", "sum"), whole=("doc_tokens", "first"))
    assert (sums.tokens == sums.whole).all()
    for row in documents.head(40).itertuples():
        spans = full.encode(row.text, add_special_tokens=False).offsets
        mine = found[found.doc_id == row.doc_id].sort_values("section")
        assert len(spans) == sums.whole[row.doc_id] and mine.start.iloc[0] == 0 and mine.end.iloc[-1] == len(row.text)
        assert (mine.start.values[1:] == mine.end.values[:-1]).all()
        want = Counter()
        for a, b in spans:
            held = [(min(b, e) - max(a, s), -k, k) for k, (s, e) in enumerate(zip(mine.start, mine.end)) if s < b and e > a]
            want[max(held)[2]] += 1
        assert [want[k] for k in range(len(mine))] == mine.tokens.tolist()


@pytest.mark.parametrize("rule, tokens", [("start", [2, 1]), ("most", [1, 2]), ("share", [1.25, 1.75])])
def test_rules_for_crossing_tokens(rule, tokens):
    spans = np.array([[0, 3], [3, 7], [7, 9]])
    counts, crossed = token_attribution.allot(spans, np.array([0, 4]), 9, rule)
    assert counts.tolist() == tokens and crossed.tolist() == [1, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbZ'stre .,!?\n\t\r  　éßÀŸ0²½ªΣς日😀\x1c-_")), max_size=40))
def test_chunks_encode_like_whole_texts(text):
    for encoder, whole in _encoders():
        want = whole.encode(text, add_special_tokens=False)
        ids, lengths, *spans = encoder.encode([text, text + "x"])
        assert ids[: lengths[0]].tolist() == want.ids
        if spans:
            assert [tuple(s) for s in spans[0][: lengths[0]].tolist()] == [tuple(o) for o in want.offsets]


@lru_cache
def _encoders():
    out = []
    for kind, name, file in (("word", "word_bpe_49k.json", WORD_BPE),
                             ("byte", "byte_bpe_50k.json", public_tokenizers.path("byte_bpe_50k.tiktoken"))):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        whole.encode_special_tokens = True
        out.append((ChunkEncoder(file, kind, public_tokenizers.PATTERN), whole))
    return out


# --- n-gram join


def brute_components(texts, words, percent):
    sets = {}
    for i, text in texts.items():
        split = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]
        sets[i] = {tuple(split[k : k + words]) for k in range(len(split) - words + 1)} if len(split) >= words else (
            {tuple(split)} if split else set())
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in sets.items():
        shared = Counter(j for g in own for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in own:
            holders[g].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_components_against_all_pairs(spark, words, percent):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, number = {}, 0
    for n in (1, 2, 3, 4, 6, 9, 10, 12, 15, 20, 40, 90, 200, 400):
        for _ in range(4):
            base = list(rng.choice(vocabulary, n))
            for _ in range(8):  # chains of small edits, so that links are near the threshold on both sides
                texts[number] = " ".join(base)
                number += 1
                for _ in range(max(1, n // 60)):
                    base[int(rng.integers(0, n))] = str(rng.choice(vocabulary))
                if rng.random() < 0.3:
                    base.append("tail")
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngram_join.jaccard_components(docs, Workspace(spark, "t"), words, percent).collect()}
    assert got == brute_components(texts, words, percent)


def test_linked_pairs_sparse_dense_and_split(monkeypatch):
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[rng.random(60) < 0.95], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(50)]
    want = {(i, j) for i in range(50) for j in range(i + 1, 50)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    for dense in (1, 10, 128):
        monkeypatch.setattr(ngram_join, "DENSE_COLUMN", dense)
        assert set(zip(*map(np.ndarray.tolist, ngram_join.linked_pairs(sets, None, 80)))) == want
        x, y = ngram_join.linked_pairs(sets[:20], sets[20:], 80)
        assert {(i, j + 20) for i, j in zip(x.tolist(), y.tolist())} == {p for p in want if p[0] < 20 <= p[1]}


def test_large_families_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 500)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        own = list(base)
        for _ in range(int(rng.integers(1, 5))):
            own[int(rng.integers(0, 120))] = f"x{i}"
        texts[i] = " ".join(own[: int(rng.integers(85, 121))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngram_join.jaccard_components(docs, Workspace(spark, "t"), 3, 90).collect()}
    assert got == brute_components(texts, 3, 90)


def test_texts_with_a_passage_in_common_are_no_candidates(spark):
    passage = [f"p{i}" for i in range(60)]
    texts = {i: " ".join([f"a{i}_{k}" for k in range(40)] + passage + [f"b{i}_{k}" for k in range(40)]) for i in range(80)}
    near = " ".join(passage * 2)
    texts |= {100 + i: near + f" t{i}" for i in range(3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("text_code", F.lit(0))
    keys = ngram_join.key_table(docs.repartition(3), 5, 80)
    found = components(ngram_join.candidate_links(keys), Workspace(spark, "t")).collect()
    assert len(found) == 3 and len({r.root for r in found}) == 1


def test_star_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Workspace(spark, "t")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


# --- HTML


PAGE = """<html><head><title>Site</title><script>var a = "</p><p>no";</script><style>p{}</style></head><body>
<div class="cookie-notice">We use cookies. <button>Accept</button></div><ul class="menu"><li><a href="/">Home</a><li><a href="/n">News</a></ul>
<div id="content"><h1>A long story</h1><p>The first paragraph &amp; its many words,
 <i>some</i> of them marked.<p>Second&nbsp;paragraph with more words in it than the first one has.</div>
<div class="sidebar"><p>Related things to read some other day</p></div>
<div id="comments"><div class="comment"><p>I liked this story very much, thank you.</p></div></div><div class="footer">Copyright 2020</div>"""


def test_blocks_are_leaves_with_decoded_text():
    texts = [b.text for b in html_extraction.blocks_of(PAGE)]
    assert "The first paragraph & its many words, some of them marked." in texts
    assert "Second paragraph with more words in it than the first one has." in texts
    assert not any("no" == t or "var a" in t for t in texts)
    assert [b.text for b in html_extraction.blocks_of("<p>&amp;amp; a<br>b")] == ["&amp; a b"]


def test_formulas_and_closed_drawings_swallow_nothing():
    read = lambda page: [b.text for b in html_extraction.blocks_of(page)]
    assert read("<p>before <svg width='9' /> after</p><p>next</p>") == ["before after", "next"]
    drawing = "<svg><title>no</title><path d='M0'/><style>no</style><text>label</text></svg>"
    assert read(f"<p>before {drawing} after <svg/></p><p>next <svg><g/></svg></p>") == ["before label after", "next"]
    assert read("<p>sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> of both <math/></p><p>next</p>") == ["sum a+b of both", "next"]
    assert read("<p>say <xmp><b>&amp; x</b></xmp> so</p>") == ["say <b>&amp; x</b> so"]
    assert read("<form><textarea>no</textarea>yes</form><script>no</script>") == ["yes"]


def test_articles_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    found = run(spark, sf_dir, "op8_html_extraction").set_index("page_id").text
    import html
    for row in pages.itertuples():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", row.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[row.page_id] == "\n".join(b for b in blocks if b)
    net = html_extraction.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    blocks = html_extraction.blocks_of(PAGE)
    kept = [b.text for b, y in zip(blocks, html_extraction._keep(net, [blocks])[0]) if y]
    assert kept[-2:] == [b.text for b in blocks if b.text.startswith(("The first", "Second"))] and len(kept) <= 3


# --- packing


def test_packing_gives_back_every_id(spark, sf_dir, documents):
    found = run(spark, sf_dir, "op9_packing")
    whole = Tokenizer.from_file(WORD_BPE)
    assert sorted(found.sequence_id) == list(range(len(found))) and (found.offset == 0).all()
    assert ((found.length & (found.length - 1)) == 0).all() and found.length.max() <= 4096
    by_length = found.sort_values("sequence_id").length.tolist()
    assert by_length == sorted(by_length, reverse=True)
    for row in documents.itertuples():
        ids = np.array([*whole.encode(row.text, add_special_tokens=False).ids, 2], "<u4")
        pieces = found[found.doc_id == row.doc_id].sort_values("start")
        assert pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.doc_tokens == len(ids)).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_binary_lengths():
    assert packing.binary_lengths(4096 * 2 + 13, 4096) == [4096, 4096, 8, 4, 1]
    assert packing.binary_lengths(1, 4096) == [1] and packing.binary_lengths(0, 4096) == []


# --- neighbours


def test_neighbours_against_all_products(spark, sf_dir):
    found = run(spark, sf_dir, "op10_neighbours").sort_values(["query_id", "rank"])
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    vectors, ids, hits = np.array(rows.embedding.tolist(), float), rows.vec_id.values, 0
    for query_id, mine in found.groupby("query_id"):
        scores = vectors @ vectors[ids == query_id][0]
        scores[ids == query_id] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        assert mine["rank"].tolist() == list(range(1, 21))
        assert mine.score.values == pytest.approx([scores[ids == v][0] for v in mine.vec_id])
        hits += len(set(mine.vec_id) & set(ids[best]))
    assert hits >= 0.9 * len(found) and set(found.query_id) == set(ids[ids % 20 == 0])


# --- pipeline


def test_pipeline_against_its_parts(spark, sf_dir, documents):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    work = Workspace(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, sf_dir))
        kept[name] = docs.toPandas()
    before = documents
    assert set(kept["language_id"].doc_id) <= set(before.doc_id) and len(kept["language_id"]) > 0.95 * len(before)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    clean = set(labels[labels.toxic == 0].doc_id) & set(kept["language_id"].doc_id)
    assert len(clean - set(kept["toxicity"].doc_id)) <= 0.05 * len(clean)
    groups = brute_components(dict(zip(kept["toxicity"].doc_id, kept["toxicity"].text)), 5, 80)
    assert sorted(kept["near_duplicates"].doc_id) == sorted({root for _, root in groups.values()})
    planned = mixing.mix(spark.createDataFrame(kept["near_duplicates"]), Workspace(spark, "t")).select("doc_id", "mix_plan.taken")
    taken = {r.doc_id: r.taken for r in planned.collect() if r.taken}
    words = kept["mixing"].assign(n=[len(t.split()) for t in kept["mixing"].text]).groupby("doc_id").n.sum()
    assert words.to_dict() == taken
    assert set(kept["packing"].doc_id) == set(kept["mixing"].doc_id)
    assert kept["packing"].groupby("doc_id").length.sum().sum() == kept["packing"].length.sum()


# --- ranked search


def test_hybrid_search_equals_scoring_every_document(monkeypatch):
    rng = np.random.default_rng(5)
    docs, terms = 3000, 400
    held = [np.unique(rng.zipf(1.3, rng.integers(1, 40)) % terms) for _ in range(docs)]
    doc = np.repeat(np.arange(docs), [len(h) for h in held])
    code = np.concatenate(held).astype(np.int64)
    tf = rng.integers(1, 4, len(doc))
    ids, m = rng.permutation(docs), rng.integers(25, 300, docs)
    part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    for short in (1, 8, 10**9):
        monkeypatch.setattr(lexical_search, "SHORT_PART", short)
        monkeypatch.setattr(lexical_search, "SHORT", 0 if short > 8 else 256)
        block = lexical_search.Block(ids, m, doc, code, tf)
        for _ in range(40):
            asked = np.unique(rng.integers(0, terms, 12)).astype(np.int64)
            weights = rng.integers(0, 5, len(asked)) * 1000
            weight = np.zeros(terms, np.int64)
            weight[asked] = weights
            score = np.zeros(docs, np.int64)
            np.add.at(score, doc, weight[code] * part)
            wanted = sorted(((-s, ids[i]) for i, s in enumerate(score.tolist()) if s > 0))[:10]
            at, found = block.search(asked, weights, 10)
            assert sorted((-s, ids[i]) for i, s in zip(at, found.tolist()))[:10] == wanted


def test_queries_are_searched_in_passes(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, lexical_search.search(docs, items, Workspace(spark, "t")).collect()))
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 500)
    monkeypatch.setattr(lexical_search, "BLOCK_POSTINGS", 2000)
    assert sorted(map(tuple, lexical_search.search(docs, items, Workspace(spark, "t")).collect())) == whole


# --- hard negatives


@pytest.mark.parametrize("width, size", [(1, 10), (64, 600), (300, 40_000), (70, 2_000_000)])
def test_residues_give_exact_products(width, size):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-size, size + 1, (n, width)) for n in (9, 13))
    a[0], b[0] = size, -size
    moduli = hard_negatives.primes(width * size * size)
    found = hard_negatives.scores(hard_negatives.residues(a, moduli), hard_negatives.residues(b, moduli), moduli)
    assert found.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]


def test_mining_in_blocks_is_the_same(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    mine = lambda: sorted(map(tuple, hard_negatives.mine(vectors, Workspace(spark, "t"), every=10).collect()))
    whole = mine()
    for name, value in (("BLOCK_ANCHORS", 7), ("BLOCK_ROWS", 60), ("TILE", 50)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mine() == whole and len(whole) > 100


# --- shards


def test_shards_are_balanced_and_keep_small_groups(spark):
    texts = [f"text {i % 2000} " + "x" * (i % 2000 * 7 % 90) for i in range(4000)] + ["copy"] * 3000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sharding.assign(docs, Workspace(spark, "t"), shards=5).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    text = dict(enumerate(texts))
    spread = rows.groupby(rows.doc_id.map(text)).shard.nunique()
    assert (spread.drop("copy") == 1).all()
    few = sharding.assign(docs.limit(3), Workspace(spark, "t"), shards=5).toPandas()
    assert len(few) == 3 and few["shard"].between(0, 4).all()
