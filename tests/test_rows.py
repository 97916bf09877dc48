"""Budgets, batches, row numbers, splits, validation, scoring."""

import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheafline.operators import budget, profile, ranking, scoring, split, validate
from sheafline.plans.evaluation import evaluate_corpus, preview_prompts
from sheafline.session import materialize


def sequential(sizes, m, n, failed=()):
    """Budget use sheet after sheet."""
    used, quotas = 0, []
    for i, size in enumerate(sizes):
        if n and used >= n:
            quotas.append(None)
            continue
        if i in failed:
            quotas.append(0)
            continue
        take = min(size, m or size, (n - used) if n else size)
        quotas.append(take)
        used += take
    return quotas


def test_budget_quotas(spark):
    rng = random.Random(0)
    cases = [([3, 0, 10, 4], 5, 7, ())]
    for _ in range(25):
        sizes = [rng.randrange(0, 12) for _ in range(rng.randrange(1, 7))]
        cases.append((sizes, rng.choice([None, 0, 1, 5]), rng.choice([None, 0, 1, 7, 20]), (rng.randrange(0, 7),)))
    for sizes, m, n, failed in cases:
        table = spark.createDataFrame(
            [(f"s{i}", i, size, i in failed) for i, size in enumerate(sizes)],
            "sheet string, sheet_ord int, rows long, failed boolean",
        ).coalesce(1)
        got = sorted((r["sheet_ord"], r["quota"] if r["reached"] else None) for r in budget.sheet_quotas(table, m, n).collect())
        assert [q for _, q in got] == sequential(sizes, m, n, failed)


def test_row_number_is_dense_in_a_hot_group(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 900)
    data = [("hot" if i % 3 else f"g{i % 5}", k) for i, k in enumerate(ids)] + [(None, 5), (None, 3)]
    df = spark.createDataFrame(data, "sheet string, id long").repartition(7)
    got = {(r["sheet"], r["id"]): r["row_idx"] for r in ranking.with_row_number(df, ["sheet"], "id", "row_idx", rows_per_task=50).collect()}
    for sheet in {s for s, _ in data}:
        ordered = sorted(k for s, k in data if s == sheet)
        assert [got[(sheet, k)] for k in ordered] == list(range(len(ordered)))


def test_no_task_sorts_a_hot_sheet(spark, monkeypatch):
    """90 % of 20,000 rows in one sheet: at most a fifteenth of all rows in a range."""
    written = []
    monkeypatch.setattr(ranking, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(-1).alias("sheet"), F.col("id").alias("k"))
    rows = ranking.with_row_number(df.repartition(5, "k"), ["sheet"], "k", "n", start=1, rows_per_task=1000).collect()
    sizes = [r["count"] for r in written[0].groupBy(F.shiftright("_row", 33)).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 20_000 / 15
    seen = {}
    for sheet, _, n in sorted((r["sheet"], r["k"], r["n"]) for r in rows):
        seen[sheet] = seen.get(sheet, 0) + 1
        assert n == seen[sheet]


def test_positions_of_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "g string, k long")
    assert ranking.prefix_positions(empty, ["g"], ["k"], "at").collect() == []
    same = spark.createDataFrame([("a", 1)] * 4 + [("a", None), (None, 2)], "g string, k long")
    got = sorted((str(r["g"]), r["k"] or 0, r["at"]) for r in ranking.prefix_positions(same, ["g"], ["k"], "at", 2).collect())
    assert got == [("None", 2, 0), ("a", 0, 0), ("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("a", 1, 4)]


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 9])
def test_balanced_split(spark, partitions):
    sizes = {"a": (5, 8), "b": (0, 4), "c": (1, 1), "d": (6, 6), "e": (300, 90)}
    data, i = [], 0
    for sheet, (pos, neg) in sizes.items():
        for label in [1.0] * pos + [0.0] * neg + [None, 0.5]:
            data.append((i, sheet, label))
            i += 1
    df = spark.createDataFrame(data, "id long, sheet string, label double").repartition(partitions)
    got = {r["id"]: r["split"] for r in split.balanced_split(df, "id").collect()}
    assert len(got) == len(data)
    for sheet, (pos, neg) in sizes.items():
        half = min(pos, neg) // 2
        for label in (0.0, 1.0):
            ids = sorted((i for i, s, y in data if s == sheet and y == label), key=key)
            assert [got[i] for i in ids] == ["train"] * half + ["test"] * half + ["dropped"] * (len(ids) - 2 * half)
    quota = {r["sheet"]: (r["half"], r["dropped"]) for r in split.split_quota(df).collect()}
    assert quota == {"a": (2, 7), "b": (0, 6), "c": (0, 4), "d": (3, 2), "e": (45, 212)}


def test_holdout_and_subsets(spark):
    df = spark.createDataFrame([(i, "x" if i < 83 else "y") for i in range(100)], "id long, sheet string")
    held = Counter((r["sheet"], r["split"]) for r in split.holdout_split(df, "id").collect())
    assert held == {("x", "validation"): 17, ("x", "train"): 66, ("y", "validation"): 4, ("y", "train"): 13}
    shares = {r["id"]: r["from_percent"] for r in split.learning_subsets(df, "id").collect()}
    ordered = sorted(range(100), key=key)
    assert [shares[i] for i in ordered] == [10 * (k // 10 + 1) for k in range(100)]


ROWS = [
    ("a <b> c", "1", None), ("a <b> c", "0.5", None), ("a <b> c", "1.9", None), ("a <b> c", "2", "invalid_label"),
    ("a <b> c", "abc", "invalid_label"), ("a <b> c", "nan", "invalid_label"), ("a <b> c", "inf", "invalid_label"),
    ("a <b> c", "1d", "invalid_label"), ("a <b> c", "-0.5", None), ("a <b> c", None, "missing"),
    (None, "1", "missing"), ("  \n", "1", "empty"), ("no group", "0", "no_group"), ("x" * 60, "0", "no_group"),
    ("<a> <b>", "1", "multiple_groups"), ("a < > c", "1", "blank_group"),
    ("a <one two three four five six> c", "1", "long_group"), ("a <b\nc> d", "1", None), ("<<x> y", "1", None),
]


def test_validation(spark):
    df = spark.createDataFrame(
        [("s", 1, i, t, y) for i, (t, y, _) in enumerate(ROWS)],
        "sheet string, sheet_ord int, row_idx long, text string, label string",
    )
    issues = validate.row_issues(df).collect()
    got = {r["row_idx"]: r for r in issues}
    assert {i: r["code"] for i, r in got.items()} == {i: c for i, (_, _, c) in enumerate(ROWS) if c}
    message = {i: r["message"] for i, r in got.items()}
    assert message[3] == "Sheet 's', Column 'label', Row 5: Invalid value '2' (should be 0 or 1)"
    assert message[13] == f"Sheet 's', Column 'text', Row 15: No angular bracket group found - '{'x' * 50}...'"
    assert message[14] == "Sheet 's', Column 'text', Row 16: Multiple angular bracket groups found (2): ['a', 'b']"
    assert message[16].endswith("Long angular bracket group (6 words) '<one two three four five six>'")
    numbered = sorted((r["severity"], r["issue_no"], r["code"]) for r in validate.numbered(validate.row_issues(df), 3).collect())
    errors = [c for s, _, c in numbered if s == "error"]
    assert errors[:2] == ["missing", "invalid_label"] and errors[6] == "missing" and errors[7:] == ["empty", "no_group", "no_group", "multiple_groups"]
    assert [n for s, n, _ in numbered if s == "error"] == list(range(1, len(errors) + 1))
    summary = validate.summarize(df)
    row = summary.first()
    assert (row["total_rows"], row["errors"], row["warnings"], row["valid"]) == (19, 11, 2, False)
    broken = spark.createDataFrame([("t", 2, 1, 0, False, 0)], "sheet string, sheet_ord int, errors int, warnings int, readable boolean, total_rows long")
    total = validate.overall(validate.summarize(df, broken)).first()
    assert (total["total_sheets"], total["sheets_processed"], total["total_rows"], total["errors"]) == (2, 1, 19, 12)
    assert validate.overall(validate.summarize(df.limit(0))).first()["valid"] is False


def test_numeric_labels(spark):
    df = spark.createDataFrame(
        [("s", i, v) for i, v in enumerate([0.0, 1.0, 0.5, -0.5, 2.0, float("nan"), float("inf"), None])],
        "sheet string, row_idx long, label double",
    )
    assert {r["row_idx"]: r["code"] for r in validate.label_issues(df).collect()} == {
        4: "invalid_label", 5: "missing", 6: "invalid_label", 7: "missing",
    }


def test_columns_policy(spark):
    df = spark.createDataFrame([("x",)], "text string")
    assert validate.require_columns(df, "skip") is None
    assert validate.require_columns(df, "zero").columns == ["text", "label"]
    with pytest.raises(ValueError):
        validate.require_columns(df)
    headers = spark.createDataFrame([("s", 1, ["text", "it's"]), ("ok", 2, ["text", "label"])], "sheet string, sheet_ord int, columns array<string>")
    got = [(r["severity"], r["message"]) for r in validate.header_issues(headers).collect()]
    assert got == [
        ("error", "Sheet 's': Missing required column 'label'"),
        ("warning", """Sheet 's': Available columns: ['text', "it's"]"""),
    ]


def test_statistics_without_labels(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "sheet string, text string")
    got = {r["sheet"]: (r["rows"], r["positive"], r["positive_percent"]) for r in profile.corpus_stats(df).collect()}
    assert got == {"a": (1, 0, "0.00%"), "b": (1, 0, "0.00%"), "TOTAL": (2, 0, "0.00%")}


# ---- scoring ----------------------------------------------------------------------------------


def length_scorer():
    return lambda texts: [f"{len(t) % 2} of {t}" for t in texts]


def broken_scorer():
    def reply(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return ["1"] * len(texts)

    return reply


def corpus(spark, sizes):
    data = [(f"s{o}", o, i, f"\n<{o}> {i}\n", float(i % 2), "kept") for o, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(data, "sheet string, sheet_ord int, row_idx long, text string, label double, extra string")


def test_evaluate_with_budget(spark):
    result = evaluate_corpus(corpus(spark, [3, 0, 10, 4]), length_scorer, max_per_sheet=5, max_total=7, batch_size=2)
    rows = result.scored.collect()
    assert Counter(r["sheet"] for r in rows) == {"s0": 3, "s2": 10}
    scored = [r for r in rows if r["ai_label"] is not None]
    assert Counter(r["sheet"] for r in scored) == {"s0": 3, "s2": 4}
    assert all(r["ai_reply"] == f"{len(r['text'].strip(chr(10))) % 2} of {r['text'].strip(chr(10))}" for r in scored)
    assert {r["sheet"]: r["n"] for r in result.report.collect()} == {"s0": 3, "s2": 4, "TOTAL": 7}
    listed = spark.createDataFrame([(f"s{o}", o) for o in range(4)], "sheet string, sheet_ord int")
    full = evaluate_corpus(corpus(spark, [3, 0, 10, 4]), length_scorer, 5, 7, sheets=listed)
    assert {r["sheet"]: r["n"] for r in full.report.collect()} == {"s0": 3, "s1": 0, "s2": 4, "TOTAL": 7}
    preview = preview_prompts(corpus(spark, [3, 0, 10, 4]), "sys", 5, 7).collect()
    assert len(preview) == 7 and {r["ai_reply"] for r in preview} == {"0 Test mode"}


def test_failed_sheets_keep_their_rows_and_use_no_budget(spark):
    df = corpus(spark, [3, 2, 4, 6])
    failed = spark.createDataFrame([("s0", 0), ("gone", 9)], "sheet string, sheet_ord int")
    result = evaluate_corpus(df, length_scorer, max_total=5, failed_sheets=failed)
    rows = result.scored.collect()
    assert Counter(r["sheet"] for r in rows) == {"s0": 3, "s1": 2, "s2": 4}
    assert Counter(r["sheet"] for r in rows if r["ai_label"] is not None) == {"s1": 2, "s2": 3}
    text = df.withColumn("label", F.when(F.expr("sheet = 's1' and row_idx = 1"), "abc").otherwise(F.col("label").cast("string")))
    result = evaluate_corpus(text, length_scorer, max_per_sheet=3)
    assert {r["sheet"]: r["n"] for r in result.report.collect()} == {"s0": 3, "s1": 0, "s2": 3, "s3": 3, "TOTAL": 9}
    assert Counter(r["sheet"] for r in result.scored.collect()) == {"s0": 3, "s1": 2, "s2": 4, "s3": 6}
    beyond = evaluate_corpus(text, length_scorer, max_per_sheet=1)  # the text label is not processed
    assert {r["sheet"]: r["n"] for r in beyond.report.collect()} == {"s0": 1, "s1": 1, "s2": 1, "s3": 1, "TOTAL": 4}


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("EvalPython" in line for line in plan.split("\n"))


def test_filters_do_not_score_twice(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "text string")
    assert python_nodes(scoring.score(df, broken_scorer).filter("ai_label = 1 and error is null")) == 1
    rows = spark.createDataFrame([("s", 0, "a")], "sheet string, row_idx long, text string")
    assert python_nodes(scoring.score_in_batches(rows, broken_scorer).filter("ai_label = 1")) == 1


def test_error_policies(spark):
    data = [("s", i, "bad" if i == 3 else "good") for i in range(12)]
    df = spark.createDataFrame(data, "sheet string, row_idx long, text string").coalesce(1)
    by_row = {r["row_idx"]: r for r in scoring.score(df, broken_scorer, 5).collect()}
    assert [by_row[i]["ai_label"] for i in range(12)] == [1, 1, 1, 0] + [1] * 8
    assert by_row[3]["ai_reply"] == "0 Error" and by_row[3]["error"].startswith("RuntimeError")
    by_batch = {r["row_idx"]: r["ai_label"] for r in scoring.score_in_batches(df, broken_scorer, 5).collect()}
    assert [by_batch[i] for i in range(12)] == [0] * 5 + [1] * 7
    retried = {r["row_idx"]: r["ai_label"] for r in scoring.score_in_batches(df, broken_scorer, 5, on_error="rows").collect()}
    assert [retried[i] for i in range(12)] == [1, 1, 1, 0] + [1] * 8


def test_null_text_is_scored_as_nan(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert scoring.score(df, length_scorer).first()["ai_reply"] == "1 of nan"


def test_throttle(spark):
    assert scoring.throttle_plan(9, 10) == (1, 60 / 9)
    assert scoring.throttle_plan(60, 10) == (10, 10.0)
    assert scoring.throttle_plan(None, 4) == (4, 0.4)
    df = spark.createDataFrame([(f"t{i}",) for i in range(20)], "text string")
    start = time.monotonic()
    assert scoring.score_throttled(df, length_scorer, queries_per_minute=1200, workers=2).count() == 20
    scoring.score_throttled(df, length_scorer, queries_per_minute=1200, workers=2).collect()
    assert time.monotonic() - start > 0.9  # 10 requests per worker, 0.1 s apart


def counting_scorer():
    """Replies with the number of texts this worker has been sent."""
    sent = []

    def score(texts):
        sent.extend(texts)
        return [str(len(sent))] * len(texts)

    return score


def test_throttled_rounds(spark):
    """A worker's share of a round is bounded in bytes; rows that repeat or have no text are all there."""
    data = [(i // 2, None if i % 50 == 0 else "x" * 100) for i in range(600)]
    df = spark.createDataFrame(data, "id long, text string")
    one = scoring.score_throttled(df, length_scorer, queries_per_minute=6e6, workers=2)
    many = scoring.score_throttled(df, length_scorer, queries_per_minute=6e6, workers=2, round_bytes=4000)
    assert many.columns == one.columns
    assert Counter(map(tuple, many.collect())) == Counter(map(tuple, one.collect()))
    counted = scoring.score_throttled(df, counting_scorer, queries_per_minute=6e6, workers=2, round_bytes=4000)
    assert max(int(r["ai_reply"]) for r in counted.collect()) <= 80  # 300 in one round


def test_pick_model(spark):
    df = spark.createDataFrame([("p", None), ("p", ""), ("p", "m")], "provider string, model string")
    assert [r["model"] for r in scoring.pick_model(df, {"p": "d"}).collect()] == ["d", "d", "m"]
    with pytest.raises(Exception, match="unsupported provider"):
        scoring.pick_model(spark.createDataFrame([("q", None)], "provider string, model string"), {"p": "d"}).collect()


def test_prompt_grid(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    grid = scoring.prompt_grid(df, {1: "a", 2: "b"}, ["m1", "m2", "m3"])
    assert grid.count() == 12 and grid.select(F.count_distinct("prompt_no", "model_source")).first()[0] == 6
