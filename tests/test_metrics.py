import random

import pytest
from pyspark.sql import functions as F

from mailsift.functions import fixed_values as V
from mailsift.operators import metrics as M

# Published confusion cells and the rates they must give.
GOLDEN = [
    # tn, fp, fn, tp, precision, recall, f1, fpr
    (1084, 41, 23, 1102, 0.964129, 0.979556, 0.971781, 0.036444),
    (1076, 49, 34, 1091, 0.957018, 0.969778, 0.963355, 0.043556),
    (1082, 43, 31, 1094, 0.962181, 0.972444, 0.967286, 0.038222),
    (1088, 37, 26, 1099, 0.967430, 0.976889, 0.972136, 0.032889),
    (1121, 4, 155, 970, 0.995893, 0.862222, 0.924250, 0.003556),
    (1115, 10, 113, 1012, 0.990215, 0.899556, 0.942711, 0.008889),
    (1103, 22, 44, 1081, 0.980054, 0.960889, 0.970377, 0.019556),
    (1090, 35, 32, 1093, 0.968972, 0.971556, 0.970262, 0.031111),
    (1118, 7, 151, 974, 0.992864, 0.865778, 0.924976, 0.006222),
]


def test_golden_rates(spark):
    cells = spark.createDataFrame([g[:4] for g in GOLDEN], "tn long, fp long, fn long, tp long")
    for r, g in zip(M.with_rates(cells).collect(), GOLDEN):
        assert (r.precision, r.recall, r.f1, r.false_positive_rate) == pytest.approx(g[4:], abs=5e-7)


def test_golden_thresholds(spark):
    """The published validation rows give the published choice for each target."""
    thresholds = [0.5, 0.95, 0.92, 0.67]
    cells = [(t, *g[:4]) for t, g in zip(thresholds, [GOLDEN[3], GOLDEN[4], GOLDEN[5], GOLDEN[6]])]
    sweep = M.with_rates(
        spark.createDataFrame([("m", *c) for c in cells], "model string, threshold double, tn long, fp long, fn long, tp long")
    )
    picked = {r.fpr_target: r.threshold for r in M.pick_thresholds(sweep).collect()}
    assert picked == {0.005: 0.95, 0.01: 0.92, 0.02: 0.67}


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        source = rng.choice(["both", "both", "only_phishing", "only_legitimate"])
        y = {"both": rng.randint(0, 1), "only_phishing": 1, "only_legitimate": 0}[source]
        for model in ("a", "b"):
            # Two decimals give many ties.
            rows.append((model, i, source, y, round(min(max(rng.gauss(0.45 + 0.2 * y, 0.25), 0.0), 1.0), 2)))
    return rows, spark.createDataFrame(rows, "model string, row_id long, source_dataset string, y int, score double")


def pick(rows, model, source=None):
    return [(r[3], r[4]) for r in rows if r[0] == model and source in (None, r[2])]


def auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_metrics_and_auc_against_brute_force(scores):
    rows, df = scores
    got = {(r.model, r.source_dataset): r for r in M.full_metrics(df).collect()}
    assert len(got) == 8
    for (model, source), r in got.items():
        pairs = pick(rows, model, source)
        assert r.n == r.tn + r.fp + r.fn + r.tp == len(pairs)
        assert r.tp == sum(1 for y, s in pairs if y and s >= 0.5)
        assert r.fp == sum(1 for y, s in pairs if not y and s >= 0.5)
        assert r.auc_roc == (None if auc(pairs) is None else pytest.approx(auc(pairs)))
        assert (r.recall is None) == (r.f1 is None) == (r.precision is None) == (source == "only_legitimate")
        assert (r.false_positive_rate is None) == (source == "only_phishing")
        wanted = {"only_legitimate": [V.NOTE_NO_PHISHING], "only_phishing": [V.NOTE_NO_LEGITIMATE]}.get(source, [])
        assert r.notes == wanted


def test_no_predicted_phishing_has_precision_zero(spark):
    cells = spark.createDataFrame([(5, 0, 3, 0)], "tn long, fp long, fn long, tp long")
    r = M.with_rates(cells).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_sweep_against_brute_force(scores):
    rows, df = scores
    sweep = M.threshold_sweep(df).collect()
    assert len(M.threshold_grid()) == 59 and len(sweep) == 2 * 59
    for r in sweep:
        pairs = pick(rows, r.model)
        assert r.tp == sum(1 for y, s in pairs if y and s >= r.threshold)
        assert r.fp == sum(1 for y, s in pairs if not y and s >= r.threshold)
        assert r.tn + r.fp + r.fn + r.tp == len(pairs)
    ordered = sorted((r for r in sweep if r.model == "a"), key=lambda r: r.threshold)
    assert all(a.recall >= b.recall for a, b in zip(ordered, ordered[1:]))


def test_target_nothing_reaches_is_null(spark):
    rows = [("m", i, "s", i % 2, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "model string, row_id long, source_dataset string, y int, score double")
    picked = M.pick_thresholds(M.threshold_sweep(df)).collect()
    assert len(picked) == 3 and all(r.threshold is None for r in picked)


def test_ties_take_the_lowest_threshold(spark):
    rows = [("m", i, "s", i % 2, 0.8 if i % 2 else 0.1) for i in range(10)]
    df = spark.createDataFrame(rows, "model string, row_id long, source_dataset string, y int, score double")
    assert {r.threshold for r in M.pick_thresholds(M.threshold_sweep(df)).collect()} == {0.5}


def test_recall_cost(scores):
    rows, df = scores
    got = {r.model: r for r in M.recall_cost(df, 0.7).collect()}
    for model in ("a", "b"):
        pos = [s for y, s in pick(rows, model) if y]
        lost = sum(1 for s in pos if 0.5 <= s < 0.7)
        assert got[model].additional_missed == lost
        assert got[model].recall_drop == pytest.approx(lost / len(pos))


def test_comparison(spark):
    rows = [("x", 0.9, 0.04, 0.95), ("y", 0.9, 0.03, None), ("z", 0.8, 0.03, 0.96), ("stacked_ensemble", 0.91, 0.03, 0.955)]
    df = spark.createDataFrame(rows, "model string, f1 double, false_positive_rate double, auc_roc double")
    r = M.compare_with_baselines(df, ["x", "y", "z"]).first()
    assert (r.best_baseline_by_f1, r.best_baseline_by_fpr, r.best_baseline_by_auc) == ("x", "y", "z")
    assert (r.ensemble_better_f1, r.ensemble_better_fpr, r.ensemble_better_auc) == (True, False, False)
    assert r.auc_delta == pytest.approx(-0.005)
    assert M.compare_with_baselines(df.filter("model <> 'stacked_ensemble'"), ["x", "y", "z"]).count() == 0


def test_shown(spark):
    df = spark.createDataFrame([(0.123456,), (None,)], "x double")
    assert [r.s for r in df.select(M.shown(F.col("x")).alias("s")).collect()] == ["0.1235", "n/a"]
