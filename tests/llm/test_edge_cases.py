"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailsift.llm import (
    fingerprints, hard_negatives, html_extraction, language_id, lexical_search, license_scan, mixing, neighbours,
    ngram_join, packing, sharding, token_attribution, toxicity,
)
from mailsift.llm.common import Workspace

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, mix string, score string, title string"
LONG = " ".join(f"word{i % 997}" for i in range(60_000)) + ".\n"


def _doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "x", "y", "z")


ROWS = [
    _doc(1, "the quick brown fox jumps over the lazy dog again and again"),
    _doc(2, "the quick brown fox jumps over the lazy dog again and again"),
    _doc(2, "the quick brown fox jumps over the lazy dog again and again"),
    _doc(3, ""), _doc(4, None), _doc(5, None, None, None), _doc(None, "a text without an id, in English"),
    _doc(None, None), _doc(6, LONG, "en", "b"), _doc(7, LONG + "end", "en", "b"), _doc(8, "   \n\t "), _doc(9, "12 34 !?"),
    _doc(10, "der schnelle braune Fuchs springt über den faulen Hund", "de", None),
    _doc(11, "you stupid idiot, all of it", "en", "c"), _doc(12, "é" * 5000, "fr", "c"),
]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def net():
    text = {"de": "der die und nicht ist ein schön", "en": "the and is not with this that", "fr": "le la et les être déjà"}
    return language_id.train([t.encode() for t in text.values()] * 4, [0, 1, 2] * 4, list(text), steps=15)


@pytest.fixture(scope="module")
def judge():
    bad = [f"some plain words {i}. you stupid idiot" for i in range(40)]
    good = [f"some plain words {i}. nothing else here" for i in range(60)]
    return toxicity.fit(bad + good, [1] * 40 + [0] * 60)


def operators(spark, net, judge):
    return {
        "license": lambda d: license_scan.license_scan(d),
        "toxicity": lambda d: toxicity.score_documents(d, judge),
        "toxicity_filter": lambda d: toxicity.accepted(d, judge),
        "fingerprints": lambda d: fingerprints.edited_versions(d),
        "language": lambda d: language_id.identify(d, net),
        "language_filter": lambda d: language_id.accepted(d, net, 0.3),
        "mixing": lambda d: mixing.mix(d, Workspace(spark, "t")),
        "mixed_rows": lambda d: mixing.mixed_rows(mixing.mix(d, Workspace(spark, "t"))),
        "tokens": lambda d: token_attribution.token_counts(d, RANKS, PATTERN),
        "join": lambda d: ngram_join.jaccard_components(d, Workspace(spark, "t"), 3, 90),
        "one_of_each": lambda d: ngram_join.one_of_each(d, Workspace(spark, "t")),
        "packing": lambda d: packing.packed(d, Workspace(spark, "t"), WORD_BPE),
        "sharding": lambda d: sharding.assign(d, Workspace(spark, "t")),
    }


@pytest.mark.parametrize("name", list(operators(None, None, None)))
def test_empty_table_and_all_null_rows(spark, net, judge, name):
    work = operators(spark, net, judge)[name]
    assert work(spark.createDataFrame([], DOCS)).collect() == []
    nothing = spark.createDataFrame([(None,) * 9] * 3, DOCS)
    kept = work(nothing).count()
    assert kept == {"language_filter": 0, "mixed_rows": 0}.get(name, 3)


@pytest.mark.parametrize("name", ["license", "toxicity", "fingerprints", "language", "mixing", "join", "sharding"])
def test_a_row_for_every_row(spark, net, judge, name):
    rows = operators(spark, net, judge)[name](spark.createDataFrame(ROWS, DOCS)).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)


def test_defined_results_of_odd_texts(spark, net, judge):
    docs = spark.createDataFrame(ROWS, DOCS)
    languages = {r.doc_id: r for r in language_id.identify(docs, net).collect()}
    assert all(languages[i].lang_pred == "und" and languages[i].score == 0 for i in (3, 4, 5, 8, 9))
    assert languages[6].lang_pred != "und"
    scores = {r.doc_id: r for r in toxicity.score_documents(docs, judge).collect()}
    assert scores[3].score == scores[4].score < 0.5 and scores[11].predicted == 1 and scores[1].predicted == 0
    scans = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (scans[4].n_words, scans[4].first_word, scans[4].labels, scans[4].score) == (0, None, "", 0.0)
    assert scans[6].n_words == 60_000
    plan = {r.doc_id: r.mix_plan for r in mixing.mix(docs, Workspace(spark, "t")).collect()}
    assert plan[4].size == plan[4].taken == 0 and plan[6].taken <= 2 * plan[6].size
    linked = {r.doc_id: r for r in ngram_join.jaccard_components(docs, Workspace(spark, "t"), 3, 90).collect()}
    assert linked[1].component_id == linked[2].component_id == 1 and linked[6].component_id == linked[7].component_id == 6
    assert linked[3].component_id == 3 and linked[4].n_shingles == 0 and linked[12].n_shingles == 1


def test_other_columns_pass_through(spark, net, judge):
    docs = spark.createDataFrame(ROWS, DOCS)
    for name in ("toxicity_filter", "language_filter", "mixed_rows", "one_of_each"):
        out = operators(spark, net, judge)[name](docs)
        assert out.columns == docs.columns and out.schema == docs.schema
        assert out.filter("size <> 7 or mix <> 'x' or score <> 'y' or title <> 'z'").count() == 0


def test_one_of_each_keeps_the_smallest_and_rows_without_words(spark):
    kept = [r.doc_id for r in ngram_join.one_of_each(spark.createDataFrame(ROWS, DOCS), Workspace(spark, "t")).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 3, 4, 5, None, None, 6, 8, 9, 10, 11, 12]))


def test_pages(spark):
    net = html_extraction.fresh()
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    pages = spark.createDataFrame([
        (1, "u", None, "t", 1), (2, None, "", "t", 1), (None, "u", "<p>a", "t", 1), (3, "u", "<p>" + "x " * 200_000, "t", 1),
        (3, "u", "<p title='a>b</p", "t", 1), (4, "u", "<<>>&&lt;<!-- <p>never closed", "t", 1)], schema)
    rows = html_extraction.extract(pages, net).collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows)
    assert html_extraction.extract(spark.createDataFrame([], schema), net).count() == 0
    assert html_extraction.learn(spark.createDataFrame([], schema), composed=20) is not None


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id bigint, embedding array<float>, label int, score double"
    rows = [(20, [1.0, 0.0], 1, 0.1), (1, [1.0, 0.0], 1, 0.1), (2, [1.0, 0.0], 1, 0.1), (3, [0.0, 0.0], 1, 0.1),
            (4, None, 1, 0.1), (5, [nan, 1.0], 1, 0.1), (6, [inf, 1.0], 1, 0.1), (7, [None, 1.0], 1, 0.1), (8, [], 1, 0.1),
            (9, [1.0, 0.0, 0.0], 1, 0.1), (None, [1.0, 1.0], 1, 0.1), (40, [0.0, 2.0], 1, 0.1), (1, [1.0, 0.0], 2, 0.2)]
    found = neighbours.nearest(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [
        (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 40, 0.0), (40, 1, 1, 0.0), (40, 2, 2, 0.0), (40, 3, 20, 0.0)]
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0


def test_pages_of_many_blocks_go_in_batches_of_bounded_cells():
    sizes = [1] * 127 + [20_000, 0, 5_000, 60]
    batches = list(html_extraction.batches_of(sizes))
    assert sorted(i for b in batches for i in b) == [i for i, n in enumerate(sizes) if n]
    assert all(len(b) == 1 or max(sizes[i] for i in b) * len(b) <= html_extraction.CELLS_AT_ONCE for b in batches)


def test_a_long_page_beside_short_ones_stays_small(spark):
    import resource

    html = ["<p>one block</p>"] * 127 + ["".join(f"<p>block {i}</p>" for i in range(20_000))]
    blocks = [html_extraction.blocks_of(h) for h in html]
    assert len(blocks[-1]) == 20_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    kept = html_extraction._keep(html_extraction.fresh(), blocks)
    assert [len(k) for k in kept] == [1] * 127 + [20_000]
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300


def test_search(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    items = spark.createDataFrame([
        (1, "Fox FOX lazy", 5), (1, "zzz", 6), (None, "idiot", 7), (2, None, 1), (3, "", 1), (4, "absent", 1), (5, "word7 word7 word8", 1),
    ], "item_id bigint, text string, score int")
    found = lexical_search.search(docs, items, Workspace(spark, "t")).collect()
    by_item = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_item.setdefault(r.item_id, []).append(r.doc_id)
    # Repeated rows are documents of their own, ties go by id; of repeated items the least text is asked.
    assert by_item == {1: [1, 2, 2], None: [11], 5: [6, 7]}
    assert all(r.score > 0 for r in found)
    none = items.limit(0)
    assert lexical_search.search(docs, none, Workspace(spark, "t")).count() == 0
    assert lexical_search.search(docs.limit(0), items, Workspace(spark, "t")).count() == 0
    nulls = spark.createDataFrame([(None,) * 9] * 3, DOCS)
    assert lexical_search.search(nulls, items, Workspace(spark, "t")).count() == 0
    lost = spark.createDataFrame([(None, "fox"), (7, "fox"), (8, "cat")], "doc_id bigint, text string")
    got = lexical_search.search(lost, items, Workspace(spark, "t")).orderBy("rank").collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(1, 7), (1, None)]


def test_mining(spark):
    nan = float("nan")
    schema = "vec_id bigint, embedding array<double>, label int, score double"
    rows = [(100, [1.0, 0.0], 1, 0.0), (1, [1.0, 0.0], 1, 0.0), (1, [1.0, 0.0], 1, 0.5), (2, [1.0, 0.0], 1, 0.0), (3, [0.9, 0.1], 2, 0.0),
            (4, [0.95, 0.0], 2, 0.0), (5, [0.5, 0.0], 3, 0.0), (6, None, 1, 0.0), (8, [nan, 1.0], 1, 0.0), (9, [None, 1.0], 1, 0.0),
            (10, [1.0, 0.0], None, 0.0), (11, [], 1, 0.0), (12, [1.0], 2, 0.0), (None, [1.0, 0.0], 2, 0.0), (200, [1.0], 5, 0.0)]
    found = hard_negatives.mine(spark.createDataFrame(rows, schema), Workspace(spark, "t")).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found) == [
        (100, p, k, n, 65536, s) for p in (1, 2) for k, n, s in ((1, 4, 243 * 256), (2, 3, 230 * 256))]
    assert hard_negatives.mine(spark.createDataFrame([], schema), Workspace(spark, "t")).count() == 0
    nothing = spark.createDataFrame([(None,) * 4] * 3, schema)
    assert hard_negatives.mine(nothing, Workspace(spark, "t")).count() == 0
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(100, [1e300], 1, 0.0)], schema), Workspace(spark, "t"))


def test_shards_of_odd_rows(spark):
    rows = {}
    for r in sharding.assign(spark.createDataFrame(ROWS, DOCS), Workspace(spark, "t")).collect():
        rows.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    for shard in rows.values():
        assert sorted(r.slot for r in shard) == list(range(len(shard)))
    every = [r for shard in rows.values() for r in shard]
    assert {r.size for r in every if r.doc_id in (3, 4, 5)} == {1} and {r.text_crc32 for r in every if r.doc_id in (3, 4)} == {0}


def test_stages_on_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
