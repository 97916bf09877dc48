"""Sources, sinks, ledger, tokens, embeddings and models."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import embedding, learning, ledger, metrics, regression, split, tokens
from sheafline.plans import catalogue, evaluation
from sheafline.sources import corpus, sinks, workbook
from sheafline.session import scratch_dir


def test_workbooks(spark, tmp_path):
    good = workbook.encode_workbook(
        [
            ("Sheet <1>", ["text", "label", "note", "note"], [["a <b> & \"c\"\n", 1, "x", "y"], [None, 0.5, None, "z"], ["nan", "abc", 1, 2]]),
            ("empty", ["text", "label"], []),
            ("short", ["other"], [["v"]]),
        ]
    )
    (tmp_path / "a.xlsx").write_bytes(good)
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "c.txt").write_text("ignored")
    raw = workbook.ingest_workbooks(spark, str(tmp_path)).persist()
    rows = sorted(workbook.corpus_rows(raw).collect(), key=lambda r: (r["sheet_ord"], r["row_idx"]))
    assert [(r["sheet"], r["row_idx"], r["text"], r["label"], r["has_label"]) for r in rows] == [
        ("Sheet <1>", 0, 'a <b> & "c"\n', "1", True),
        ("Sheet <1>", 1, None, "0.5", True),
        ("Sheet <1>", 2, None, "abc", True),
        ("short", 0, None, None, False),
    ]
    assert rows[0]["extra"] == {"note": "x", "note.1": "y"}
    headers = {r["sheet"]: r["columns"] for r in workbook.sheet_headers(raw).collect()}
    assert headers["empty"] == ["text", "label"] and headers["short"] == ["other"]
    errors = workbook.ingest_errors(raw).collect()
    assert len(errors) == 1 and errors[0]["error"].startswith("Error opening file")


def test_shared_strings_and_gaps(spark):
    import io
    import zipfile

    main = workbook.MAIN.strip("{}")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{workbook.REL_ID[1:-3]}"><sheets><sheet name="s" r:id="r1"/><sheet name="gone" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/worksheets/one.xml"/><Relationship Id="r2" Target="worksheets/two.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>text</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        book.writestr(
            "xl/worksheets/one.xml",
            f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="str"><v>label</v></c></row>'
            '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>',
        )
    df = spark.createDataFrame([("f", bytearray(packed.getvalue()))], "path string, content binary")
    raw = workbook.decode(df)
    got = sorted((r["row_idx"], r["text"], r["label"]) for r in workbook.corpus_rows(raw).collect())
    assert got == [(0, None, None), (1, "rich", "1")]
    assert [r["sheet"] for r in workbook.ingest_errors(raw).collect()] == ["gone"]


def test_csv_corpus_and_union(spark, tmp_path):
    (tmp_path / "s.csv").write_text('text,label\n"a, ""b""\nc",1\nx,oops\n')
    rows = corpus.read_corpus_csv(spark, str(tmp_path / "s.csv"), "s").collect()
    assert rows[0]["text"] == 'a, "b"\nc' and rows[0]["label"] == 1.0
    assert rows[1]["label"] is None and rows[1]["corrupt"] is not None
    one = spark.createDataFrame([("a", 1.0)], "text string, label double")
    two = spark.createDataFrame([("b", "n")], "text string, note string")
    assert corpus.union_sheets([one, two]).count() == 2


def test_evaluation_sinks(spark, tmp_path):
    rows = [(s, o, i, f"<t> {i}", float(i % 2)) for o, s in enumerate(["z", "a"]) for i in range(4)]
    df = spark.createDataFrame(rows, "sheet string, sheet_ord int, row_idx long, text string, label double")
    result = evaluation.evaluate_corpus(df, lambda: lambda texts: [t[-1] for t in texts])
    evaluation.save_evaluation(result, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "metrics").glob("*.csv"))
    lines = text.splitlines()
    assert lines[0] == "sheet_name;n;lp;ln;pp;pn;tp;fp;tn;fn;accuracy;precision;recall;f1"
    assert [line.split(";")[0] for line in lines[1:]] == ["z", "a", "TOTAL"]
    back = corpus.read_corpus(spark, str(tmp_path / "out" / "scored"))
    assert back.filter("sheet = 'z'").count() == 4
    assert spark.read.parquet(str(tmp_path / "out" / "scored")).columns[-3:] == ["ai_reply", "error", "sheet"]


def test_failed_sheet_in_report(spark):
    df = spark.createDataFrame([("a", 1, 0, "x", 1.0)], "sheet string, sheet_ord int, row_idx long, text string, label double")
    failed = spark.createDataFrame([("broken", 2)], "sheet string, sheet_ord int")
    result = evaluation.evaluate_corpus(df, lambda: lambda texts: ["1"] * len(texts), 5, 50, failed_sheets=failed)
    assert {r["sheet"]: r["n"] for r in result.report.collect()} == {"a": 1, "broken": 0, "TOTAL": 1}


def test_epoch_stats(spark):
    log = spark.createDataFrame(
        [
            (1, 0.5, 1.0, None, None), (2, 1.0, 2.0, None, None), (3, 1.0, None, 0.7, 0.6), (4, 1.5, 4.0, None, None),
            (5, 2.0, None, 0.5, 0.8), (6, 2.0, None, 0.4, 0.9), (7, 3.0, None, 0.3, 0.95), (8, 2.5, None, None, None),
        ],
        "step long, epoch double, loss double, eval_loss double, eval_accuracy double",
    )
    train = spark.createDataFrame([(3, 1, 0.5), (6, 2, 0.65)], "step long, epoch int, train_accuracy double")
    got = sorted(tuple(r) for r in ledger.epoch_stats(log, train).collect())
    assert got == [(1, 1.5, 0.5, 0.7, 0.6), (2, 4.0, 0.65, 0.4, 0.9), (3, 0.0, 0.0, 0.3, 0.95)]


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read_ledger(spark, path).count() == 0
    schema = "mode string, iteration int, epochs int, train_loss double, eval_loss double, eval_accuracy double, path string"
    for i, mode in ((2, "m"), (1, "m"), (1, "k")):
        ledger.append_run(spark.createDataFrame([(mode, i, 3, 0.123456, None, 0.5, f"p{i}")], schema), path)
    table = ledger.read_ledger(spark, path)
    assert [(r["mode"], r["iteration"]) for r in table.filter("mode = 'm'").collect()] == [("m", 1), ("m", 2)]
    assert table.first()["train_loss"] == 0.1235 and table.filter("timestamp IS NULL").count() == 0
    assert {r["mode"]: r["path"] for r in ledger.latest_runs(table).collect()} == {"m": "p2", "k": "p1"}
    assert sorted(r["total_epochs"] for r in ledger.cumulative_epochs(table).collect()) == [3, 3, 6]


def test_next_experiment(spark):
    used = [("a", n) for n in (1, 2, 4)] + [("b", 2), ("c", None), ("d", 1), ("d", 2), ("d", 2)]
    df = spark.createDataFrame(used, "run_id string, experiment int")
    assert {r[0]: r[1] for r in ledger.next_experiment(df).collect()} == {"a": 3, "b": 1, "c": 1, "d": 3}


def test_token_tables(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [1, 2, 3, 4]), (1, [7]), (2, [9])], "b int, input_ids array<int>")
    got = sorted((r["b"], r["padded_ids"], r["padded_mask"]) for r in tokens.left_padded(df, ["b"]).collect())
    assert got == [
        (1, [0, 0, 0, 7], [0, 0, 0, 1]), (1, [0, 0, 1, 2], [0, 0, 1, 1]), (1, [1, 2, 3, 4], [1, 1, 1, 1]), (2, [9], [1]),
    ]
    acc = spark.createDataFrame([([5, 1, 2, 3], [-100, 5, 1, 9]), ([1, 1], [0, -100])], "preds array<int>, labels array<int>")
    assert tuple(tokens.token_accuracy(acc).first()) == (2, 3, 0.6667)
    assert tokens.token_accuracy(acc.limit(0)).first()["accuracy"] == 0.0
    texts = spark.createDataFrame([("w " * 600, 1)], "text string, label int")
    row = tokens.training_examples(texts, "sys", tokenizer=lambda: lambda ts: [[len(w) for w in t.split()] for t in ts]).first()
    assert len(row["input_ids"]) == 512 == sum(row["attention_mask"]) and set(row["token_type_ids"]) == {0}


def test_embeddings(spark, tmp_path):
    df = spark.createDataFrame([("s", "a <bc> d", 1), ("s", "no span", 1), ("s", None, 0), ("s", "<x>", None)], "sheet string, text string, label int")
    clean = embedding.clean_corpus(df)
    assert [r["bracketed_text"] for r in clean.collect()] == ["bc"]
    hashed = embedding.compound_embedding(clean, dims=16)
    vector = hashed.first()["embedding"]
    assert len(vector) == 32 and math.isclose(sum(v * v for v in vector[:16]), 1.0, rel_tol=1e-5)
    hooked = embedding.compound_embedding(clean, lambda: lambda ts: np.array([[len(t), 1] for t in ts]))
    assert hooked.first()["embedding"] == [6.0, 1.0, 2.0, 1.0]
    sinks.write_wide_embeddings(hooked, str(tmp_path / "wide"), 4)
    back = corpus.read_wide_embeddings(spark, str(tmp_path / "wide"), 4, "sheet string, full_sentence string, bracketed_text string, label int")
    assert tuple(back.first()) == ("s", "a bc d", "bc", 1, [6.0, 1.0, 2.0, 1.0])


def features(spark, n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0).astype(float)
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(n)]
    return x, y, learning.with_features(spark.createDataFrame(rows, "id long, embedding array<double>, label double"))


def test_ols_equals_numpy(spark):
    x, y, df = features(spark, 120, 5)
    a = np.c_[x, np.ones(len(x))]
    want = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    model = learning.fit_ols(df)
    got = np.array([r["y_pred"] for r in sorted(learning.predict_ols(model, df).collect(), key=lambda r: r["id"])])
    assert np.allclose(got, want, atol=1e-8)
    quality = learning.fit_quality(model, df).first()
    assert math.isclose(quality["mse"], ((want - y) ** 2).mean(), rel_tol=1e-9)
    path = scratch_dir(spark)
    learning.save_model(spark, model, path)
    assert np.array_equal(learning.load_model(spark, path).coefficients, model.coefficients)
    assert max(abs(r["product"]) for r in learning.residual_products(model, df).collect()) < 1e-9


def least_norm(x, y):
    w = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-10)[0]
    return w, y.mean() - x.mean(axis=0) @ w


def test_least_norm_of_many_solutions(spark, monkeypatch):
    """More dimensions than rows, repeated dimensions, a constant one and vectors far from zero; the
    partial sums of forty tasks are put together in two levels."""
    monkeypatch.setattr(learning, "FAN", 4)
    x, y, df = features(spark, 8, 20)
    model = learning.fit_ols(df)
    want, intercept = least_norm(x, y)
    assert np.allclose(model.coefficients, want, atol=1e-9) and math.isclose(model.intercept, intercept, abs_tol=1e-9)
    x, y, _ = features(spark, 90, 3)
    wide = np.column_stack([x + 1000, x[:, 0], np.full(len(x), 5.0), x[:, 1] * 2])
    rows = [(wide[i].tolist(), float(y[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "features array<double>, label double").repartition(40)
    model = learning.fit_ols(df)
    want, intercept = least_norm(wide, y)
    assert np.allclose(model.coefficients, want, atol=1e-7)
    assert max(abs(r["product"]) for r in learning.residual_products(model, df).collect()) < 1e-6


def test_fits_refuse_what_they_cannot_use(spark):
    with pytest.raises(ValueError):
        learning.fit_ols(spark.createDataFrame([], "features array<double>, label double"))
    model = learning.LinearModel(np.array([1.0, 2.0]), 0.5)
    df = spark.createDataFrame([([1.0, 1.0],), (None,)], "features array<double>")
    assert [r[0] for r in df.select(model.margin()).collect()] == [3.5, None]
    with pytest.raises(Exception, match="expected 2 dimensions, found 1"):
        spark.createDataFrame([([1.0],)], "features array<double>").select(model.margin()).collect()


def test_logistic_gradient_is_zero(spark):
    """At the optimum of the C = 1 objective the gradient vanishes."""
    x, y, df = features(spark, 150, 4)
    model = learning.fit_logistic(df)
    w, b = model.coefficients, model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + x.T @ (p - y)).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_shares_are_fitted_together(spark):
    """Each share's model is the one of its rows alone; a share of one class predicts it."""
    x, y, df = features(spark, 120, 3)
    y[:5] = 1.0
    rows = [(x[i].tolist(), float(y[i]), 10 if i < 5 else 50 if i < 60 else 100) for i in range(120)]
    df = spark.createDataFrame(rows, "features array<double>, label double, from_percent int").repartition(7)
    models = learning.fit_logistic_shares(df, [5, 10, 50, 100])
    assert {s: n for s, (_, n) in models.items()} == {10: 5, 50: 60, 100: 120}
    assert models[10][0].intercept == learning.CERTAIN
    for share in (50, 100):
        alone = learning.fit_logistic(df.filter(F.col("from_percent") <= share))
        assert np.allclose(models[share][0].coefficients, alone.coefficients, atol=1e-8)
    gradients = learning.share_gradients({s: m for s, m in models.items() if s > 10}, df).collect()
    assert len(gradients) == 8 and max(abs(r["gradient"]) for r in gradients) < 1e-6


def test_learning_curve(spark):
    _, _, train = features(spark, 100, 3)
    _, _, test = features(spark, 40, 3, seed=1)
    curve = learning.learning_curve(train, test, "id", percents=(10, 50, 100)).orderBy("train_percentage").collect()
    assert [(r["train_percentage"], r["train_sentences"], r["test_sentences"]) for r in curve] == [(10, 10, 40), (50, 50, 40), (100, 100, 40)]
    for r in curve:
        cells = r["true_positives"] + r["true_negatives"] + r["false_positives"] + r["false_negatives"]
        assert math.isclose(cells, 100, abs_tol=0.05)
        assert math.isclose(r["recall"], (r["true_positives"] + r["true_negatives"]) / 100, abs_tol=1e-3)


def test_catalogue(spark):
    assert catalogue.prompt_table(spark).count() == 5
    with pytest.raises(ValueError):
        catalogue.prompt_text(6)
    blob = spark.createDataFrame([(catalogue.VOCABULARY, catalogue.WORD_LIST)], "vocabulary string, words string")
    terms = catalogue.parse_vocabulary(blob.drop("words")).collect()
    assert len(terms) == 23 and all(r["definition"] for r in terms)
    assert catalogue.parse_word_list(blob.drop("vocabulary")).count() == 22


def test_reports_as_csv(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, 0.9), ("a", 0, 0.2)], "sheet string, y_true int, y_pred double")
    sinks.write_report_csv(regression.category_report(df, total=True), str(tmp_path / "r"))
    lines = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv")).splitlines()
    assert lines[0].split(",") == regression.REPORT_COLUMNS
    assert [line.split(",")[0] for line in lines[1:]] == ["a", "b", "TOTAL"]
    counts = metrics.label_counts(df.withColumn("label", F.col("y_true")), [])
    sinks.write_table_csv(counts, str(tmp_path / "t"), ["label"], sep=";")


def sheet_bytes(rows):
    """A workbook of one sheet from lists of inline texts; None is a formatted cell without content."""
    main, rel = workbook.MAIN.strip("{}"), workbook.REL_ID[1:].split("}")[0]
    packed = io.BytesIO()
    cells = lambda r: "".join('<c s="1"/>' if v is None else f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r)
    with zipfile.ZipFile(packed, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        body = "".join(f"<row>{cells(r)}</row>" for r in rows)
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return packed.getvalue()


def test_workbook_keeps_wide_cells_and_drops_trailing_blanks(spark, tmp_path):
    rows = [["text", "label"], ["a", "1", "note"], [None, None], ["b", "0", None, None], [None], [None, None, None]]
    (tmp_path / "w.xlsx").write_bytes(sheet_bytes(rows))
    raw = workbook.ingest_workbooks(spark, str(tmp_path))
    got = sorted(workbook.corpus_rows(raw).collect(), key=lambda r: r["row_idx"])
    assert [(r["text"], r["label"]) for r in got] == [("a", "1"), (None, None), ("b", "0")]
    assert got[0]["extra"] == {"Unnamed: 2": "note"}


def test_wide_export_refuses_other_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "embedding array<float>")
    assert embedding.to_wide(df, 2).count() == 2
    for dims in (1, 3):
        with pytest.raises(Exception, match="dimensions"):
            embedding.to_wide(df, dims).collect()


def test_unnamed_sheet_is_split_like_the_others(spark):
    df = spark.createDataFrame([(i, None, i % 2) for i in range(50)], "id long, sheet string, label int")
    held = split.holdout_split(df, "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in held} == {"train": 40, "validation": 10}
    both = split.balanced_split(df, "id").groupBy("split", "label").count().collect()
    assert {r["count"] for r in both if r["split"] != "dropped"} <= {12, 13}
