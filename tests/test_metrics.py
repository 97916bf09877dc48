"""Metrics against brute force in Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import metrics, regression


def rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sheet = rng.choice(["b", "a", "c", "only_ones"])
        label = 1.0 if sheet == "only_ones" else rng.choice([0.0, 1.0, 1.0, None, 0.5])
        out.append((sheet, {"b": 1, "a": 2, "c": 3, "only_ones": 4}[sheet], label, rng.choice([0, 1, None])))
    return out


def expected(pairs, f1_rounded=False):
    known = [(y, p) for y, p in pairs if y is not None and p is not None]
    c = {
        "n": len(known),
        "lp": sum(y == 1 for y, _ in known), "ln": sum(y == 0 for y, _ in known),
        "pp": sum(p == 1 for _, p in known), "pn": sum(p == 0 for _, p in known),
        "tp": sum(y == 1 and p == 1 for y, p in known), "fp": sum(y == 0 and p == 1 for y, p in known),
        "tn": sum(y == 0 and p == 0 for y, p in known), "fn": sum(y == 1 and p == 0 for y, p in known),
    }
    return with_rates(c, f1_rounded)


def with_rates(c, f1_rounded=False):
    p = c["tp"] / c["pp"] if c["pp"] else 0.0
    r = c["tp"] / c["lp"] if c["lp"] else 0.0
    a = (c["tp"] + c["tn"]) / c["n"] if c["n"] else 0.0
    if f1_rounded:
        p, r = round(p, 3), round(r, 3)
    f1 = 2 * p * r / (p + r) if p + r else 0.0
    return {**c, "accuracy": round(a, 3), "precision": round(p, 3), "recall": round(r, 3), "f1": round(f1, 3)}


@pytest.mark.parametrize("variant", ["exact", "rounded"])
def test_report_with_total(spark, variant):
    data = rows(3)
    df = spark.createDataFrame(data, "sheet string, sheet_ord int, label double, ai_label int")
    counts = metrics.confusion_counts(df, ["sheet"], order="sheet_ord")
    got = {r["sheet"]: r.asDict() for r in metrics.report_with_total(counts, order="sheet_ord", f1_from=variant).collect()}
    want = {s: expected([(y, p) for t, _, y, p in data if t == s], variant == "rounded") for s in {r[0] for r in data}}
    summed = {k: sum(w[k] for w in want.values()) for k in metrics.COUNTS}
    want["TOTAL"] = with_rates(summed, variant == "rounded")
    for sheet, row in want.items():
        assert {k: got[sheet][k] for k in row} == row
    assert got["TOTAL"]["is_total"] == 1 and got["a"]["sheet_ord"] == 2


def test_f1_variants_differ(spark):
    df = spark.createDataFrame([(1.0, 1)] * 2 + [(1.0, 0)] * 5, "label double, ai_label int").withColumn("s", F.lit("s"))
    counts = metrics.confusion_counts(df, ["s"])
    assert metrics.add_rates(counts).first()["f1"] == 0.444
    assert metrics.add_rates(counts, f1_from="rounded").first()["f1"] == 0.445


def test_denominators_differ_for_odd_labels(spark):
    df = spark.createDataFrame([(1.0, 1), (0.5, 1)], "label double, ai_label int").withColumn("s", F.lit("s"))
    counts = metrics.confusion_counts(df, ["s"])
    assert metrics.add_rates(counts).first()["precision"] == 0.5
    assert metrics.add_rates(counts, denominators="confusion").first()["precision"] == 1.0


def test_nan_label_is_unknown(spark):
    df = spark.createDataFrame([(float("nan"), 1), (1.0, 1)], "label double, ai_label int").withColumn("s", F.lit("s"))
    assert metrics.confusion_counts(df, ["s"]).first()["n"] == 1


def test_unlabelled_and_failed_sheets(spark):
    df = spark.createDataFrame(
        [("x", None, 1, False), ("x", None, 0, False), ("x", None, None, False), ("y", 1.0, 1, True)],
        "sheet string, label double, ai_label int, has_label boolean",
    )
    counts = metrics.confusion_counts(df, ["sheet"], labelled="has_label")
    groups = spark.createDataFrame([("x",), ("y",), ("failed",)], "sheet string")
    got = {r["sheet"]: r for r in metrics.report_with_total(metrics.fill_missing_groups(counts, groups, "sheet")).collect()}
    assert (got["x"]["n"], got["x"]["pp"], got["x"]["pn"], got["x"]["lp"]) == (2, 1, 1, 0)
    assert got["failed"]["n"] == 0 and got["failed"]["accuracy"] == 0.0
    assert got["TOTAL"]["n"] == 3 and got["TOTAL"]["accuracy"] == 0.333


def test_weighted_recall_is_accuracy(spark):
    df = spark.createDataFrame([(float(i % 3 == 0), int(i % 2)) for i in range(99)], "label double, ai_label int")
    row = metrics.weighted_prf(metrics.confusion_counts(df.withColumn("s", F.lit(1)), ["s"])).first()
    assert math.isclose(row["recall"], (row["tp"] + row["tn"]) / row["n"])


def r2(y, p):
    if len(y) < 2:
        return float("nan")
    sse, sst = ((y - p) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    return (1.0 if sse == 0 else 0.0) if sst == 0 else 1 - sse / sst


def test_category_report(spark):
    rng = np.random.default_rng(0)
    data = [("abc"[i % 3], float(rng.integers(0, 2)), float(rng.normal(0.5, 0.3))) for i in range(200)]
    data += [("const", 1.0, 0.7), ("const", 1.0, 0.2), ("exact", 0.0, 0.0), ("exact", 0.0, 0.0), ("one", 1.0, 0.9)]
    df = spark.createDataFrame(data, "sheet string, y_true double, y_pred double")
    got = {r["sheet"]: r for r in regression.category_report(df, total=True).collect()}
    for sheet in [*{d[0] for d in data}, "TOTAL"]:
        y = np.array([d[1] for d in data if sheet in (d[0], "TOTAL")])
        p = np.array([d[2] for d in data if sheet in (d[0], "TOTAL")])
        b = (p >= 0.5).astype(int)
        row = got[sheet]
        want = [len(y), ((y - p) ** 2).mean(), np.abs(y - p).mean(), (b == y).mean(), p.mean(), p.std(), p.min(), p.max(), r2(y, p)]
        have = [row[c] for c in ("n_samples", "mse", "mae", "accuracy", "pred_mean", "pred_std", "pred_min", "pred_max", "r2_score")]
        assert np.allclose(have, want, equal_nan=True)
        assert row["true_positives"] == ((b == 1) & (y == 1)).sum()
    report = regression.category_report(df, total=True)
    mean = regression.macro_mean(report).first()
    assert math.isclose(mean["avg_accuracy"], np.mean([r["accuracy"] for r in got.values()]))
    assert mean["avg_accuracy"] != regression.macro_mean(report, exclude_total=True).first()["avg_accuracy"]


def test_histogram(spark):
    rng = np.random.default_rng(1)
    data = [(i % 2, float(rng.normal())) for i in range(300)] + [(2, 0.25)] * 4
    df = spark.createDataFrame(data, "y_true int, y_pred double")
    got = {(r["label"], r["bin"]): r["rows"] for r in regression.prediction_histogram(df).collect()}
    for label in (0, 1, 2):
        counts, _ = np.histogram([p for y, p in data if y == label], bins=20)
        assert [got[(label, b)] for b in range(20)] == counts.tolist()
