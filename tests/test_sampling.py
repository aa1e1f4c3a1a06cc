import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import sampling as S
from mailsift.operators.ordering import running_total_below


def draw(row_id, seed=42):
    return hashlib.md5(f"{seed}-{row_id}".encode()).hexdigest(), row_id


@pytest.fixture(scope="module")
def mails(spark):
    rng = random.Random(3)
    strata = [("kaggle_chakraborty", "phishing")] * 6 + [
        ("kaggle_chakraborty", "legitimate"), ("nazario", "phishing"), ("spamassassin", "legitimate"),
        ("synthetic_healthcare", "phishing"), ("synthetic_healthcare", "legitimate")]
    rows = [(i, *rng.choice(strata), True) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id long, source_dataset string, label string, included_in_training boolean")
    return rows, df.repartition(5)


def by_stratum(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append(r)
    return groups


def test_exact_quota_against_brute_force(mails):
    rows, df = mails
    targets = {k: min(37, len(v)) for k, v in by_stratum(rows).items()}
    got = {r.row_id for r in S.stratified_sample(df, S.quota_by_source_label(targets)).collect()}
    want = set()
    for key, group in by_stratum(rows).items():
        want |= {r[0] for r in sorted(group, key=lambda r: draw(r[0]))[: targets[key]]}
    assert got == want


def test_strata_without_target_are_not_drawn(mails):
    _, df = mails
    sample = S.stratified_sample(df, S.quota_by_source_label({("nazario", "phishing"): 5}))
    assert [(r.source_dataset, r["count"]) for r in sample.groupBy("source_dataset").count().collect()] == [("nazario", 5)]


def test_too_few_rows_is_an_error(mails):
    _, df = mails
    with pytest.raises(Exception, match="too few rows"):
        S.stratified_sample(df, S.quota_by_source_label({("nazario", "phishing"): 100_000})).collect()
    short = S.missing_strata(df, {("nazario", "phishing"): 100_000, ("absent", "phishing"): 1}).collect()
    assert {(r.source_dataset, r.available > 0) for r in short} == {("nazario", True), ("absent", False)}


def test_split_sizes_and_disjointness(mails):
    rows, df = mails
    splits = S.train_val_test(df)
    got = {r.row_id: r.split for r in splits.collect()}
    assert set(got) == {r[0] for r in rows}
    for group in by_stratum(rows).values():
        n = len(group)
        ordered = [got[r[0]] for r in sorted(group, key=lambda r: draw(r[0], 43))]
        train, val = math.floor(0.70 * n), math.floor(0.85 * n)
        assert ordered == ["train"] * train + ["val"] * (val - train) + ["test"] * (n - val)


def test_confound_slice_is_disjoint_and_balanced(mails):
    _, df = mails
    sample = S.stratified_sample(df, S.quota_by_share(0.5))
    confound = S.confound_slice(df, sample, 40)
    assert confound.join(sample, "row_id", "left_semi").count() == 0
    counts = {r.label: r["count"] for r in confound.groupBy("label").count().collect()}
    assert counts == {"phishing": 40, "legitimate": 40}
    assert {r.source_dataset for r in confound.select("source_dataset").distinct().collect()} <= set(S.V.CONFOUND_SOURCES)
    report = S.split_integrity(S.train_val_test(sample), sample, confound).collect()
    assert len(report) == 4 and all(r.ok for r in report)


def test_short_confound_slice_is_an_error(spark):
    rows = [(i, "kaggle_chakraborty", "phishing" if i < 30 else "legitimate", True) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, source_dataset string, label string, included_in_training boolean")
    nothing = df.limit(0)
    assert S.confound_slice(df, nothing, 10).count() == 20
    for short in (df, df.filter("label = 'phishing'")):
        with pytest.raises(Exception, match="too few rows left over"):
            S.confound_slice(short, nothing, 15).collect()


def test_checks_find_what_is_wrong(spark):
    schema = "row_id long, source_dataset string, label string, included_in_training boolean, split string"
    splits = spark.createDataFrame([(1, "s", "a", True, "train"), (1, "s", "a", True, "val"), (2, "s", "a", None, "test")], schema)
    sample = spark.createDataFrame([(1, "a"), (3, "b"), (4, "b")], "row_id long, label string")
    confound = spark.createDataFrame([(3, "s", "b", False, None)], schema)
    got = {r.check: r.observed for r in S.split_integrity(splits, sample, confound).collect()}
    assert got == {"sample_confound_overlap": 1, "split_overlap": 1, "sample_rows_without_split": 2, "not_eligible": 2}
    texts = spark.createDataFrame([(1, "a"), (1, "a"), (3, "x"), (9, "b")], "row_id long, label string")
    got = {r.check: r.observed for r in S.feature_alignment(sample, texts, sample.select("row_id").filter("row_id < 4")).collect()}
    assert got == {"mails_without_text_features": 1, "text_features_without_mail": 2, "mails_without_url_features": 1,
                   "url_features_without_mail": 0, "changed_labels": 1}


def test_draws_do_not_depend_on_partitioning(mails):
    _, df = mails
    ids = lambda d: {r.row_id for r in S.stratified_sample(d, S.quota_by_share(0.3)).collect()}
    assert ids(df) == ids(df.coalesce(1))


def test_running_total_against_brute_force(spark):
    rng = random.Random(9)
    # Most values crowd into a narrow range.
    values = {round(0.99 + rng.random() / 1000, 9) if rng.random() < 0.8 else rng.random() for _ in range(3000)}
    rows = [("g" if rng.random() < 0.9 else "h", v, rng.randint(0, 3)) for v in values]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r.g, r.v): r.below for r in running_total_below(df, ["g"], "v", "n", "below", bucket_rows=150).collect()}
    totals = {"g": 0, "h": 0}
    for g, v, n in sorted(rows, key=lambda r: r[1]):
        assert got[g, v] == totals[g]
        totals[g] += n


def test_seeded_rows(mails):
    rows, df = mails
    got = [r.row_id for r in S.seeded_rows(df, 20).collect()]
    assert sorted(got) == sorted(r[0] for r in sorted(rows, key=lambda r: draw(r[0]))[:20])
    assert df.filter(F.col("row_id").isin(got)).count() == 20
