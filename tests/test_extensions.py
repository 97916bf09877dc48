"""Metric hooks, the default encoder, file verification, aligned predictions and sketches."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafline.operators import embedding, ledger, metric_hooks, profile, scoring
from sheafline.plans import verification
from sheafline.plans.evaluation import evaluate_corpus
from sheafline.session import scratch_dir


# ---- metric hooks -----------------------------------------------------------------------------


def auc(pairs):
    ones, zeros = [s for y, s in pairs if y == 1], [s for y, s in pairs if y == 0]
    if not ones or not zeros:
        return None
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("fan", [2, 64])
def test_metric_hooks(spark, monkeypatch, fan):
    """A hot group in many tasks, a null group, a group of one class; states merged in one or more levels."""
    monkeypatch.setattr(metric_hooks, "FAN", fan)
    rng = random.Random(fan)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.choice([0, 1, None]), round(rng.random(), 2)) for i in range(400)] + [("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "sheet string, y int, score double").repartition(9)
    got = metric_hooks.grouped_metrics(df, ["sheet"], ["y", "score"], {"rank": metric_hooks.RankStatistic(0.01)})
    want = {s: auc([(y, p) for t, y, p in rows if t == s]) for s in {r[0] for r in rows}}
    assert {r["sheet"]: r["rank"] for r in got.collect()} == pytest.approx(want)
    total = metric_hooks.grouped_metrics(
        df.withColumn("hit", (F.col("score") > 0.5).cast("int")), [], ["y", "hit"], {"balanced": metric_hooks.BalancedAccuracy()}
    ).first()["balanced"]
    recalls = [np.mean([(p > 0.5) == bool(c) for _, y, p in rows if y == c]) for c in (0, 1)]
    assert total == pytest.approx(np.mean(recalls))
    assert metric_hooks.grouped_metrics(df.limit(0), ["sheet"], ["y", "score"], {"rank": metric_hooks.RankStatistic()}).collect() == []


# ---- default encoder --------------------------------------------------------------------------


def hashed(text, dims, n=3):
    out = np.zeros(dims)
    codes = [ord(c) for c in text.lower()]
    for i in range(len(codes) - n + 1):
        h = 0
        for c in codes[i : i + n]:
            h = (h * embedding.HASH_FACTOR + c) % embedding.HASH_PRIME
        slot = h * embedding.HASH_MIX % embedding.HASH_PRIME % (2 * dims)
        out[slot // 2] += 1 - 2 * (slot % 2)
    norm = math.sqrt((out * out).sum())
    return out / norm if norm else out


@pytest.mark.parametrize("dims", [1, 7, 32, 100])
def test_hashed_vector(spark, dims):
    texts = ["", "ab", "abc", "Der Ärger, ключ 🙂\nund mehr", "aaaaaaaa", "x" * 5000 + "y"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    rows = [r[0] for r in df.select(embedding.hashed_vector(F.col("t"), dims)).collect()]
    assert rows[-1] is None
    for text, row in zip(texts, rows):
        assert len(row) == dims and np.allclose(row, hashed(text, dims), atol=1e-6)


def test_hashing_holds_little_besides_the_batch():
    texts = pa.array(["der text %d " % i * 400 for i in range(2000)] + [None, "ab" * 400_000])
    tracemalloc.start()
    rows = embedding.hash_texts(texts, 32, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # the texts are 10 MB, the grams of the last one as numbers 6 MB an array
    assert rows[2000].as_py() is None and len(rows) == 2002
    for i in (0, 7, 2001):
        assert np.allclose(rows[i].as_py(), hashed(texts[i].as_py(), 32), atol=1e-6)


# ---- verification of files --------------------------------------------------------------------


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content, encoding="utf-8")


def test_verify_files(spark, tmp_path):
    write(tmp_path / "sheet=good", "a.csv", 'text,label\n"one <two> three",1\n"a ""<quoted>"" line\nbreak",0\n')
    write(tmp_path / "sheet=good", "b.csv", "label,extra,text\n0,x,next <file> here\n")
    write(tmp_path / "sheet=bad", "a.csv", "text,label\nno group,1\n<x>,\n,2\n<a> <b>,word\n")
    write(tmp_path / "sheet=lacking", "a.csv", "text,label\n<x>,1\n")
    write(tmp_path / "sheet=lacking", "b.csv", "text,note\n<y>,1\n")
    write(tmp_path / "sheet=torn", "a.csv", ",".join(f"c{i}" for i in range(30)) + "\n")
    write(tmp_path / "sheet=only header", "a.csv", "text,label\n")
    (tmp_path / "sheet=none").mkdir()
    result = verification.verify_files(spark, str(tmp_path))
    issues = sorted((r["severity"], r["issue_no"], r["message"]) for r in result.issues.collect())
    assert issues == [
        ("error", 1, "Sheet 'bad', Column 'label', Row 3: Missing/null value"),
        ("error", 2, "Sheet 'bad', Column 'label', Row 4: Invalid value '2' (should be 0 or 1)"),
        ("error", 3, "Sheet 'bad', Column 'label', Row 5: Invalid value 'word' (should be 0 or 1)"),
        ("error", 4, "Sheet 'bad', Column 'text', Row 4: Missing/null value"),
        ("error", 5, "Sheet 'bad', Column 'text', Row 2: No angular bracket group found - 'no group'"),
        ("error", 6, "Sheet 'bad', Column 'text', Row 5: Multiple angular bracket groups found (2): ['a', 'b']"),
        ("error", 7, "Sheet 'lacking': Missing required column 'label'"),
        ("error", 8, "Error reading sheet none: no header"),
        ("error", 9, "Error reading sheet torn: too many columns"),
        ("warning", 1, "Sheet 'lacking': Available columns: ['text', 'note']"),
    ]
    sheets = {r["sheet"]: (r["readable"], r["total_rows"], r["errors"], r["warnings"], r["valid"]) for r in result.sheets.collect()}
    assert sheets == {
        "good": (True, 3, 0, 0, True), "bad": (True, 4, 6, 0, False), "lacking": (True, 0, 1, 1, False),
        "torn": (False, 0, 1, 0, False), "only header": (True, 0, 0, 0, True), "none": (False, 0, 1, 0, False),
    }
    assert tuple(result.verdict.first()) == (False, 6, 4, 7, 9, 1)


def test_verify_valid_and_absent_files(spark, tmp_path):
    write(tmp_path / "ok" / "sheet=s", "a.csv", "text,label\nan <ordinary> row,1\n")
    result = verification.verify_files(spark, str(tmp_path / "ok"))
    assert tuple(result.verdict.first()) == (True, 1, 1, 1, 0, 0) and result.issues.collect() == []
    (tmp_path / "nothing").mkdir()
    result = verification.verify_files(spark, str(tmp_path / "nothing"))
    assert tuple(result.verdict.first()) == (False, 0, 0, 0, 0, 0) and result.sheets.collect() == []


# ---- budget, running sums, alignment, sketches ------------------------------------------------


def test_failed_sheets_free_their_budget(spark):
    """The fold against a loop over the sheets, for every limit."""
    rng = random.Random(4)
    sizes = [rng.randrange(1, 9) for _ in range(12)]
    bad = {s: rng.randrange(12) for s in range(12) if s % 3}
    rows = [(f"s{s:02}", s, i, "some text", "x" if bad.get(s) == i else "1") for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "sheet string, sheet_ord int, row_idx long, text string, label string")
    for per_sheet, total in ((None, None), (4, None), (None, 20), (4, 20), (3, 7)):
        used, want = 0, {}
        for s, n in enumerate(sizes):
            if total and used >= total:
                break
            take = min(n, per_sheet or n, total - used if total else n)
            take = 0 if bad.get(s, 99) < take else take
            used, want[f"s{s:02}"] = used + take, take
        result = evaluate_corpus(df, lambda: lambda ts: ["1"] * len(ts), per_sheet, total)
        got = {r["sheet"]: r["n"] for r in result.report.collect()}
        assert got.pop("TOTAL") == used and got == want


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["m", "m", "m", "k", None]), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "mode string, iteration int, epochs int").repartition(4)
    got = {r["iteration"]: r["total_epochs"] for r in ledger.cumulative_epochs(df, rows_per_task=60).collect()}
    seen = {}
    for mode, i, n in rows:
        if n is not None:
            seen[mode] = seen.get(mode, 0) + n
        assert got[i] == seen.get(mode)


def test_aligned_predictions_need_no_shuffle(spark):
    name = "t" + scratch_dir(spark).rsplit("/", 1)[-1]
    rows = spark.range(200).select((F.col("id") % 3).cast("string").alias("sheet"), F.col("id").alias("row_idx"), F.lit("x").alias("text"))
    scoring.save_bucketed(rows, f"{name}_a", 4)
    scoring.save_bucketed(rows.filter("row_idx % 2 = 0").withColumn("prediction", F.lit(1)), f"{name}_b", 4)
    out = scoring.align_predictions(spark.table(f"{name}_a"), spark.table(f"{name}_b"))
    assert out.filter("prediction = 1").count() == 100 and out.count() == 200
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for t in ("a", "b"):
        spark.sql(f"DROP TABLE {name}_{t}")


def test_sketches_merge(spark):
    rows = spark.range(6000).select((F.col("id") % 3).alias("sheet"), (F.col("id") % 2000).cast("string").alias("text"))
    sketches = profile.text_sketches(rows, ["sheet"])
    total = profile.merged_estimates(sketches, []).first()[0]
    assert abs(total - 2000) < 80
    assert {r["sheet"] for r in profile.merged_estimates(sketches, ["sheet"]).collect()} == {0, 1, 2}
