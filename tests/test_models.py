import math
import time

import pytest
from pyspark.sql import functions as F

from mailsift.operators import metrics, models, sampling
from mailsift.operators.models import BASE_MODELS, Detector, TrainingOptions
from mailsift.plans import build_table, score, train
from mailsift.sources.inbox import inbox
from mailsift.streaming import scoring
from mailsift.workspace import run_dir

OPTIONS = TrainingOptions(trees=5, forest_depth=5, rounds=3, boosting_depth=3)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return build_table.build(inbox(spark, sf_dir), run_dir(spark, "test"), sampling.quota_by_share(0.9), 10)


@pytest.fixture(scope="module")
def result(spark, table):
    return train.train(table.splits, run_dir(spark, "test"), OPTIONS, max_terms=80)


def mails(table):
    return table.splits.filter("split = 'test'").select(
        "row_id", "text", F.lit(None).cast("double").alias("threshold"), F.lit("raw_text").alias("input_method")
    )


def test_table(table):
    assert table.cleaned.filter("NOT included_in_training").count() == 0
    assert table.cleaned.groupBy("row_id").count().filter("count > 1").count() == 0
    assert table.confound.count() == 20
    assert {r.split for r in table.splits.select("split").distinct().collect()} == {"train", "val", "test"}


def test_build_options(spark, sf_dir):
    merged = inbox(spark, sf_dir)
    default = build_table.cleaned_table(merged).count()
    assert build_table.cleaned_table(merged, apply_non_email_filter=True).count() < default
    deduped = build_table.cleaned_table(merged, dedup_after_clean=True)
    assert deduped.count() == deduped.select("text").distinct().count() <= default


def test_full_settings():
    for growth in models.growths(TrainingOptions()).values():
        assert (growth.rounds, growth.depth, growth.step) == (200, 6, 0.1)


def test_missing_targets_stop_the_build(spark, sf_dir):
    with pytest.raises(ValueError, match="too few rows"):
        build_table.build(inbox(spark, sf_dir), run_dir(spark, "test"))


def test_scores_and_report(spark, result):
    scores = result.test_scores
    assert {r.model for r in scores.select("model").distinct().collect()} == {*BASE_MODELS, metrics.ENSEMBLE}
    assert scores.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    report = train.evaluation_report(result, 0.67).first()
    assert len(report.headline) == 4 and len(report.ensemble_against_baselines) == 1
    assert len(report.threshold_tuning[0].validation_fpr_targets) == 3
    assert {r.feature for r in report.top_features}
    share = models.importances(result.detector, spark).groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in share) and len(share) == 3


def test_meta_model_is_at_its_optimum(result):
    """The gradient of mean log-loss + L2 / (2 n) over the validation rows vanishes."""
    wide = result.val_scores.groupBy("row_id", "y").pivot("model", [*BASE_MODELS, metrics.ENSEMBLE]).agg(F.first("score"))
    rows = wide.collect()
    weights = result.detector.meta.coefficients
    for i, name in enumerate(BASE_MODELS):
        gradient = sum((r[metrics.ENSEMBLE] - r.y) * r[name] for r in rows) / len(rows) + weights[i] / len(rows)
        assert gradient == pytest.approx(0.0, abs=1e-4)


def explained(spark, table, result):
    return score.with_scores(result.detector, mails(table), explained=True)


def test_explanations_add_up_to_the_score(spark, table, result):
    rows = explained(spark, table, result).collect()
    assert len(rows) == mails(table).count()
    for r in rows:
        assert [m.model for m in r.explained] == BASE_MODELS
        for m in r.explained:
            raw = m.base + m.total
            assert (raw if m.model == "random_forest" else 1 / (1 + math.exp(-raw))) == pytest.approx(r[m.model], abs=1e-9)
            assert [e["rank"] for e in m.top] == list(range(1, len(m.top) + 1)) and len(m.top) <= 10
            sizes = [abs(e.contribution) for e in m.top]
            assert sizes == sorted(sizes, reverse=True)
            assert all((e.direction == "phishing") == (e.contribution > 0) for e in m.top)
            if sizes and sizes[0]:
                assert [e.bar_width for e in m.top] == pytest.approx([s / sizes[0] * 100 for s in sizes])
    plan = explained(spark, table, result)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Scan parquet")[0]


def test_repeated_and_missing_ids_are_explained_alike(spark, table, result):
    text = mails(table).first().text
    rows = spark.createDataFrame(
        [("a", text), ("a", text), (None, text), (None, text), ("b", text)], "row_id string, text string").select(
        "row_id", "text", F.lit(None).cast("double").alias("threshold"), F.lit("raw_text").alias("input_method"))
    got = score.responses(result.detector, rows).collect()
    assert len(got) == 5 and all(r.explanation == got[0].explanation for r in got) and got[0].explanation["random_forest"]


def test_responses_need_the_ensemble(table, result):
    with pytest.raises(ValueError, match="meta-model"):
        score.responses(Detector(result.detector.features, result.detector.base), mails(table))


def test_responses_and_thresholds(spark, table, result):
    batch = mails(table).withColumn(
        "threshold", F.when(F.col("row_id") % 3 == 0, 0.0).when(F.col("row_id") % 3 == 1, 1.5)
    )
    rows = score.responses(result.detector, batch).collect()
    assert len(rows) == batch.count()
    for r in rows:
        kind = r.row_id % 3
        assert r.threshold_used == {0: 0.0, 1: 1.5, 2: 0.67}[kind]
        if kind == 1:
            assert r.classification is None and "between 0 and 1" in r.error
        else:
            assert r.error is None
            assert (r.classification == "phishing") == (r.ensemble_probability >= r.threshold_used)
        assert set(r.explanation) <= set(BASE_MODELS) and r.base_model_scores.random_forest is not None


def test_loaded_detector_scores_the_same(spark, table, result):
    loaded = Detector.load(spark, result.detector.path)
    own = {r.row_id: r[metrics.ENSEMBLE] for r in score.with_scores(result.detector, mails(table)).collect()}
    again = {r.row_id: r[metrics.ENSEMBLE] for r in score.with_scores(loaded, mails(table)).collect()}
    assert own == pytest.approx(again)


def test_benchmark_of_stored_models(spark, table, result):
    out = result.detector.path.rsplit("/", 1)[0]
    report = train.benchmark(table.splits, out).first()
    assert not report.retrained
    again = {r.model: r for r in report.headline}
    first = {r.model: r for r in train.evaluation_report(result, None).first().headline}
    for name, row in first.items():
        assert again[name].auc_roc == pytest.approx(row.auc_roc) and again[name].f1 == pytest.approx(row.f1)


def test_threshold_that_nothing_reaches_is_an_error(spark):
    rows = [("stacked_ensemble", i, "s", i % 2, 1.0) for i in range(10)]
    scores = spark.createDataFrame(rows, "model string, row_id long, source_dataset string, y int, score double")
    with pytest.raises(ValueError, match="no threshold"):
        train.select_threshold(scores)


def test_spot_check(spark, table):
    from mailsift.operators.assemble import spot_check, with_dense_features

    ids = [r.row_id for r in table.splits.limit(3).collect()]
    rows = spot_check(with_dense_features(table.splits), ids, ["label", "urgency_score"]).collect()
    assert sorted(r.row_id for r in rows) == sorted(ids)


def test_missing_models(spark, result, tmp_path):
    with pytest.raises(FileNotFoundError, match="boosting_b"):
        Detector.load(spark, str(tmp_path))
    path = str(tmp_path / "no_meta")
    Detector(result.detector.features, result.detector.base).save(spark, path)
    assert Detector.load(spark, path).names == BASE_MODELS


def test_streams(spark, result, tmp_path):
    for i in range(5):
        (tmp_path / f"m{i}.eml").write_bytes(b"Subject: Act now\n\nVerify your account: http://bit.ly/x\n")
    out = run_dir(spark, "test")
    query = scoring.score_stream(
        result.detector, scoring.eml_stream(spark, str(tmp_path), files_per_batch=2), out, f"{out}/state")
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/responses").collect()
    assert len(rows) == 5 and {r.batch for r in rows} == {0, 1, 2}
    assert all(r.input_method == "eml_upload" and r.threshold_used == 0.67 for r in rows)

    late = tmp_path / "late"
    late.mkdir()
    out = run_dir(spark, "test")
    query = scoring.score_stream(result.detector, scoring.eml_stream(spark, str(late)), out, f"{out}/state", every="1 second")
    assert query.isActive
    (late / "m.eml").write_bytes(b"Subject: later\n\nhello\n")
    deadline = time.time() + 90
    while time.time() < deadline and not any(p["numInputRows"] for p in query.recentProgress):
        time.sleep(1)
    query.stop()
    assert spark.read.parquet(f"{out}/responses").count() == 1

    (tmp_path / "req").mkdir()
    (tmp_path / "req" / "a.json").write_text(
        '{"request_id": "a", "email_text": "hello"}\n{"request_id": "b", "email_text": "hello", "threshold": -1}\n')
    out = run_dir(spark, "test")
    scoring.score_stream(
        result.detector, scoring.request_stream(spark, str(tmp_path / "req")), out, f"{out}/state", False).awaitTermination()
    got = {r.row_id: r for r in spark.read.parquet(f"{out}/responses").collect()}
    assert got["a"].error is None and got["a"].classification in ("phishing", "legitimate")
    assert got["b"].error is not None and got["b"].classification is None


def test_every_request_line_gets_one_response(spark, result, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([
        '{"request_id": "good", "email_text": "hello", "threshold": 0.5}', '{"request_id": "cut", "email_te', "",
        '{"request_id": "word", "email_text": "hello", "threshold": "high"}', '{"request_id": "none"}',
        '{"request_id": "blank", "email_text": "  "}', '{"request_id": "text", "email_text": "hello", "threshold": "0.5"}']))
    out = run_dir(spark, "test")
    scoring.score_stream(result.detector, scoring.request_stream(spark, str(tmp_path)), out, f"{out}/state").awaitTermination()
    rows = spark.read.parquet(f"{out}/responses").collect()
    assert len(rows) == 6
    errors = {r.row_id: r.error for r in rows}
    assert errors["good"] is None and errors["text"] is None and errors["word"] == f"{score.NOT_A_NUMBER}, got high"
    assert errors["none"] == errors["blank"] == score.NO_TEXT
    assert [r.error for r in rows if r.row_id not in ("good", "text", "word", "none", "blank")] == [score.MALFORMED]
    for r in rows:
        assert (r.error is None) == (r.classification is not None) == (r.ensemble_probability is not None) == (r.explanation is not None)
