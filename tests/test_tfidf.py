import math
import random
import re
from collections import Counter

import pytest

from mailsift.operators import tfidf as T


def terms_of(text):
    tokens = re.findall(r"\b\w\w+\b", text.lower())
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = ["mail", "Été", "x", "bank_1", "42", "naïve", "pay", "now"] + [f"w{i}" for i in range(60)]
    weights = [20] * 8 + [1 + i % 7 for i in range(60)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) + ("!" if i % 2 else "") for i in range(300)]


def expected(corpus, max_terms):
    tf, df = Counter(), Counter()
    for text in corpus:
        found = terms_of(text)
        tf.update(found)
        df.update(set(found))
    kept = sorted(t for t, _ in sorted(tf.items(), key=lambda e: (-e[1], e[0]))[:max_terms])
    idf = {t: math.log((1 + len(corpus)) / (1 + df[t])) + 1 for t in kept}
    return kept, tf, df, idf


@pytest.mark.parametrize("max_terms", [20, 60, 150, 100_000])
def test_vocabulary_against_brute_force(spark, corpus, max_terms):
    """Small limits prune bigrams, larger ones need them all; both must be exact."""
    df = spark.createDataFrame([(t,) for t in corpus], "text string")
    kept, tf, docs, idf = expected(corpus, max_terms)
    got = sorted(T.vocabulary(df, max_terms=max_terms).collect(), key=lambda r: r.feature_idx)
    assert [r.term for r in got] == kept
    assert [r.feature_idx for r in got] == list(range(len(kept)))
    for r in got:
        assert (r.tf, r.df) == (tf[r.term], docs[r.term])
        assert r.idf == pytest.approx(idf[r.term])


def test_pruned_and_whole_bigram_counts_agree(spark, corpus):
    df = spark.createDataFrame([(t,) for t in corpus], "text string")
    tokens = T.token_counts(df).filter("tf >= 30")
    kept = {r.term for r in tokens.collect()}
    pruned = {tuple(r) for r in T.bigram_counts(df, tokens=tokens).collect()}
    assert pruned == {tuple(r) for r in T.bigram_counts(df).collect() if set(r.term.split(" ")) <= kept}


def test_weights_against_brute_force(spark, corpus, tmp_path):
    df = spark.createDataFrame(list(enumerate([*corpus, "unknown words only", ""])), "row_id int, text string")
    train = df.filter(df.row_id < len(corpus))
    kept, _, _, idf = expected(corpus, 50)
    model = T.Tfidf.fit(train, max_terms=50)
    model.save(str(tmp_path / "tfidf"))
    model = T.Tfidf.load(str(tmp_path / "tfidf"))
    got = {(r.row_id, r.feature_idx): r.value for r in T.long_form(model.transform(df), "tfidf", ["row_id"]).collect()}
    want = {}
    for i, text in enumerate(corpus):
        counts = Counter(t for t in terms_of(text) if t in idf)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        want.update({(i, kept.index(t)): n * idf[t] / norm for t, n in counts.items()})
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value)


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_counts_do_not_depend_on_how_many_tokens_a_task_takes(spark, corpus, monkeypatch, at_once):
    monkeypatch.setattr(T, "TOKENS_AT_ONCE", at_once)
    df = spark.createDataFrame([(t,) for t in [*corpus, None, ""]], "text string").coalesce(2)
    _, tf, docs, _ = expected(corpus, 10)
    found = {r.term: (r.tf, r.df) for r in T.token_counts(df).unionByName(T.bigram_counts(df)).collect()}
    assert found == {t: (tf[t], docs[t]) for t in tf}


def test_bigrams_of_many_given_tokens_are_the_same(spark, corpus, monkeypatch):
    df = spark.createDataFrame([(t,) for t in corpus], "text string")
    tokens = T.token_counts(df).filter("tf >= 30").cache()
    few = {tuple(r) for r in T.bigram_counts(df, tokens=tokens).collect()}
    monkeypatch.setattr(T, "LOOKED_UP", 1)
    assert few == {tuple(r) for r in T.bigram_counts(df, tokens=tokens).collect()}


def test_occurrences_are_not_generated_as_rows(spark, corpus):
    """Terms are counted where texts are read: no row of its own for an occurrence."""
    df = spark.createDataFrame([(t,) for t in corpus], "text string")
    plan = T.token_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
