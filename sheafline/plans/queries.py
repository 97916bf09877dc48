"""Every operator as a query over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Arrays and nested values are shown as text, so that results compare across engines.
"""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import naming
from sheafline.functions import text as tx
from sheafline.operators import (
    budget,
    embedding,
    leakage,
    learning,
    ledger,
    metric_hooks,
    metrics,
    profile,
    regression,
    scoring,
    split,
    tokens,
    validate,
)
from sheafline.plans import catalogue, evaluation, verification, views
from sheafline.session import parallelism, scratch_dir, ship_package
from sheafline.sources import corpus as corpus_source
from sheafline.sources import sinks, workbook

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def joined(array: Column | str, sep: str = ",") -> Column:
    array = F.col(array) if isinstance(array, str) else array
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


SEED = 42
FAILED_SHEET = "src0"
UNLABELLED_SHEETS = ["src1", "src2"]
MODEL_FLIPS = {"original": 2, "tuned": 3, "finetuned": 5}


# ---- metrics ----------------------------------------------------------------------------------


@query
def eval_by_sheet_total(spark, sf):
    counts = metrics.confusion_counts(views.scored_keys(spark, sf), ["sheet"])
    return metrics.report_with_total(counts)


@query
def eval_rounded_f1(spark, sf):
    counts = metrics.confusion_counts(views.scored_keys(spark, sf), ["sheet"])
    return metrics.report_with_total(counts, f1_from="rounded")


@query
def eval_unrounded(spark, sf):
    counts = metrics.confusion_counts(views.scored_keys(spark, sf), ["sheet"])
    return metrics.add_rates(counts, digits=None, denominators="confusion")


@query
def eval_overall(spark, sf):
    scored = views.scored_keys(spark, sf).withColumn("scope", F.lit("all"))
    return metrics.add_rates(metrics.confusion_counts(scored, ["scope"]), digits=4, denominators="confusion")


@query
def eval_fallbacks(spark, sf):
    """Sheets without a label column, and a failed sheet with zero metrics."""
    scored = views.scored_keys(spark, sf).withColumn("has_label", ~F.col("sheet").isin(UNLABELLED_SHEETS))
    groups = scored.select("sheet").distinct()
    usable = scored.filter(F.col("sheet") != FAILED_SHEET)
    counts = metrics.confusion_counts(usable, ["sheet"], labelled="has_label")
    return metrics.report_with_total(metrics.fill_missing_groups(counts, groups, "sheet"))


@query
def model_compare(spark, sf):
    keys = views.keys(spark, sf)
    flips = F.create_map(*[F.lit(x) for pair in MODEL_FLIPS.items() for x in pair])
    grid = keys.withColumn("model_source", F.explode(F.array(*map(F.lit, MODEL_FLIPS))))
    reply = F.when(F.col("doc_id") % flips[F.col("model_source")] == 0, F.lit("0")).otherwise(views.stub_reply())
    scored = grid.withColumn("ai_label", tx.parse_label(reply))
    counts = metrics.confusion_counts(scored, ["model_source", "sheet"])
    return metrics.report_with_total(counts, within=["model_source"])


@query
def prompt_grid_eval(spark, sf):
    grid = scoring.prompt_grid(views.keys(spark, sf), catalogue.PROMPTS)
    reply = F.when(F.col("doc_id") % (F.col("prompt_no") + 1) == 0, F.lit("1")).otherwise(views.stub_reply())
    counts = metrics.confusion_counts(grid.withColumn("ai_label", tx.parse_label(reply)), ["prompt_no"])
    return metrics.add_rates(counts)


@query
def weighted_prf(spark, sf):
    return metrics.weighted_prf(metrics.confusion_counts(views.scored_keys(spark, sf), ["sheet"]))


@query
def confusion_percent(spark, sf):
    return metrics.confusion_percent(metrics.confusion_counts(views.scored_keys(spark, sf), ["sheet"]))


@query
def verdict_rows(spark, sf):
    texts = views.documents(spark, sf).select("doc_id", "text")
    rows = views.scored_keys(spark, sf).join(texts, "doc_id")
    return metrics.verdict_rows(rows).select(
        "doc_id", "verdict", "text_preview", "predicted", "predicted_class", "actual"
    )


@query
def label_counts(spark, sf):
    return metrics.label_counts(views.keys(spark, sf), []).orderBy("label")


@query
def label_counts_by_sheet(spark, sf):
    return metrics.label_counts(views.keys(spark, sf), ["sheet"])


# ---- regression reports -----------------------------------------------------------------------


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; compare nine digits."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


@query
def regression_overall(spark, sf):
    return rounded(regression.regression_metrics(views.regression_rows(spark, sf), []))


@query
def regression_by_sheet(spark, sf):
    return rounded(regression.regression_metrics(views.regression_rows(spark, sf), ["sheet"]))


@query
def regression_report(spark, sf):
    return rounded(regression.category_report(views.regression_rows(spark, sf)).orderBy("sheet"))


@query
def report_total(spark, sf):
    return rounded(regression.category_report(views.regression_rows(spark, sf), total=True))


@query
def macro_mean(spark, sf):
    return rounded(regression.macro_mean(regression.category_report(views.regression_rows(spark, sf), total=True)))


@query
def pred_histogram(spark, sf):
    return rounded(regression.prediction_histogram(views.regression_rows(spark, sf)))


@query
def threshold_labels(spark, sf):
    rows = views.regression_rows(spark, sf)
    return rows.select("vec_id", "y_true", regression.binarize("y_pred").alias("y_bin"))


# ---- profile ----------------------------------------------------------------------------------


@query
def corpus_stats(spark, sf):
    return profile.corpus_stats(views.keys(spark, sf))


@query
def corpus_stats_by_lang(spark, sf):
    return profile.corpus_stats(views.keys(spark, sf, sheet="lang"))


@query
def shape_report(spark, sf):
    return profile.shape_report(views.table(spark, sf, "embeddings"))


@query
def distinct_texts(spark, sf):
    return profile.distinct_texts(views.documents(spark, sf), ["sheet"])


@query
def distinct_texts_sketched(spark, sf):
    """Sketches per sheet, stored, read and merged into a total; within 4 % of the exact counts."""
    docs = views.documents(spark, sf)
    path = scratch_dir(spark)
    profile.text_sketches(docs, ["sheet"]).write.parquet(path)
    stored = spark.read.parquet(path)
    total = F.lit("TOTAL").alias("sheet")
    guess = profile.merged_estimates(stored, ["sheet"]).unionByName(profile.merged_estimates(stored, []).withColumn("sheet", total))
    everything = profile.distinct_texts(docs, []).withColumn("sheet", total)
    exact = profile.distinct_texts(docs, ["sheet"]).unionByName(everything)
    both = exact.join(guess.withColumnRenamed("distinct_texts", "estimate"), "sheet")
    near = F.abs(F.col("estimate") - F.col("distinct_texts")) <= 0.04 * F.col("distinct_texts")
    return both.select("sheet", "distinct_texts", near.alias("within_bound"))


@query
def metric_hooks_by_sheet(spark, sf):
    """Balanced accuracy and a rank statistic as metrics of the user's own."""
    rows = views.regression_rows(spark, sf).select(
        "sheet", "y_true", F.col("y_pred").cast("double").alias("score"), (F.col("y_pred") >= 0.5).cast("int").alias("y_bin")
    )
    accuracy = metric_hooks.grouped_metrics(rows, ["sheet"], ["y_true", "y_bin"], {"balanced_accuracy": metric_hooks.BalancedAccuracy()})
    ranks = metric_hooks.grouped_metrics(rows, ["sheet"], ["y_true", "score"], {"rank_statistic": metric_hooks.RankStatistic()})
    return rounded(accuracy.join(ranks, "sheet"))


@query
def head_rows(spark, sf):
    return profile.head_rows(views.documents(spark, sf), ["doc_id"], 3)


@query
def vector_head(spark, sf):
    first = profile.vector_head(views.table(spark, sf, "embeddings"), ["vec_id"], 1, 10)
    return first.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query
def first_seen_order(spark, sf):
    seen = profile.first_seen(views.keys(spark, sf, sheet="lang"), order=("doc_id",))
    return seen.select("sheet", F.col("first_at.doc_id").alias("first_doc")).orderBy("first_doc")


# ---- text functions ---------------------------------------------------------------------------


@query
def span_extract(spark, sf):
    return views.documents(spark, sf).select("doc_id", tx.first_span("text").alias("bracketed_text"))


@query
def span_extract_pages(spark, sf):
    pages = views.table(spark, sf, "pages")
    return pages.select(
        "page_id", tx.first_span("html").alias("first_span"), F.size(tx.marked_groups("html")).alias("n_groups")
    )


@query
def bracket_strip(spark, sf):
    return views.documents(spark, sf).select("doc_id", tx.strip_marks("text").alias("full_sentence"))


@query
def clean_text(spark, sf):
    turns = views.table(spark, sf, "conversations")
    ragged = F.when(F.col("turn") == 3, F.lit(None)).otherwise(F.concat(F.lit("\n\n"), "text", F.lit(" \n")))
    return turns.select("conv_id", "turn", tx.strip_newlines(ragged).alias("text"))


@query
def drop_incomplete(spark, sf):
    docs = views.documents(spark, sf)
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = embedding.clean_corpus(docs.join(labels, "doc_id", "left"))
    return rows.select("doc_id", "sheet", "label", "bracketed_text", F.length("full_sentence").alias("chars"))


@query
def word_counts(spark, sf):
    docs = views.table(spark, sf, "documents")
    return docs.select("doc_id", tx.word_count("text").alias("words"), tx.preview("text", 50).alias("preview"))


@query
def label_parse(spark, sf):
    rows = views.keys(spark, sf).select("doc_id", views.stub_reply().alias("ai_reply"))
    return rows.withColumn("ai_label", tx.parse_label("ai_reply"))


@query
def label_parse_nullable(spark, sf):
    turns = views.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", tx.parse_label_or_null("text").alias("ai_label"))


@query
def reply_json(spark, sf):
    """Provider replies of several shapes, built from the conversations."""
    turns = views.table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "assistant", F.lit("message")).otherwise(F.lit("reasoning"))
    part = F.when(F.col("turn") % 3 == 2, F.lit("refusal")).otherwise(F.lit("output_text"))
    note = F.struct(F.lit("reasoning").alias("type"), F.array().cast("array<struct<type:string,text:string>>").alias("content"))
    item = F.struct(
        kind.alias("type"),
        F.array(F.struct(part.alias("type"), F.concat(F.lit(" \t"), "text", F.lit("\n")).alias("text"))).alias("content"),
    )
    payload = F.to_json(F.struct(F.array(note, item).alias("output")))
    return turns.select("conv_id", "turn", tx.reply_from_json(payload).alias("reply"))


@query
def reply_unwrap(spark, sf):
    """Last message of a generated conversation."""
    turns = views.table(spark, sf, "conversations")
    # the last message alone is gathered, not the conversation
    last = F.max_by(F.struct("role", F.col("text").alias("content")), "turn")
    convs = turns.groupBy("conv_id").agg(F.array(last).alias("messages"))
    return convs.select("conv_id", tx.unwrap_reply("messages").alias("reply"))


@query
def completion_suffix(spark, sf):
    docs = views.documents(spark, sf)
    prompt = tx.render_prompt("text", catalogue.prompt_text(1))
    echo = F.concat(prompt, F.lit(" "), (F.col("doc_id") % 2).cast("string"), F.lit("\n"))
    suffix = tx.completion_suffix(echo, prompt)
    return docs.select("doc_id", suffix.alias("completion"), tx.parse_label(suffix).alias("ai_label"))


@query
def render_prompts(spark, sf):
    docs = views.documents(spark, sf)
    system = catalogue.prompt_text(1)
    label = (F.col("doc_id") % 2).cast("int")
    return docs.select(
        "doc_id",
        tx.render_prompt("text", system).alias("inference"),
        tx.render_prompt("text", system, label).alias("training"),
        tx.render_prompt("text").alias("no_system"),
        tx.render_prompt("text", system, style="plain").alias("plain"),
        tx.render_prompt("text", style="raw").alias("raw"),
    )


@query
def prompt_lookup(spark, sf):
    """Each document with the catalogue prompt of its number."""
    docs = views.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5 + 1).cast("int").alias("prompt_no"))
    return docs.join(catalogue.prompt_table(spark), "prompt_no").select("doc_id", "prompt_no", F.md5("prompt").alias("prompt_md5"))


@query
def prompt_preview(spark, sf):
    rows = budget.row_budget(views.documents(spark, sf, row_idx=True).join(_sheet_order(spark, sf), "sheet"), 5, 50)
    return scoring.dry_run(rows, catalogue.prompt_text(2)).select(
        "sheet", "row_idx", "prompt", "ai_label", "ai_reply"
    )


@query
def chat_messages(spark, sf):
    docs = views.documents(spark, sf)
    system = catalogue.prompt_text(5)
    flat = tx.chat_messages("text", system)
    nested = tx.chat_messages("text", system, nested=True)
    return docs.select(
        "doc_id",
        joined(F.transform(flat, lambda m: m["role"])).alias("roles"),
        F.get(flat, F.lit(1))["content"].alias("user_content"),
        F.get(F.get(nested, F.lit(0))["content"], F.lit(0))["text"].alias("system_text"),
    )


@query
def vocabulary(spark, sf):
    """Paragraphs ``term – definition`` made from the sentences of the documents."""
    docs = views.table(spark, sf, "documents")
    blob = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), F.lit(". "), F.lit(" – "))
    return catalogue.parse_vocabulary(docs.select("doc_id", blob.alias("vocabulary")))


@query
def word_list(spark, sf):
    docs = views.table(spark, sf, "documents")
    return catalogue.parse_word_list(docs.select("doc_id", F.col("text").alias("words")))


# ---- validation -------------------------------------------------------------------------------


def _sheet_order(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select(F.col("source").alias("sheet"))
    return corpus_source.sheet_order(docs)


def _label_rows(spark: SparkSession, sf: str, row_idx: bool = True) -> DataFrame:
    """Labels with every kind of bad value."""
    raw = F.col("label").cast("double")
    broken = (
        F.when(F.col("doc_id") % 29 == 0, F.lit(2.0))
        .when(F.col("doc_id") % 31 == 0, F.lit(-1.5))
        .when(F.col("doc_id") % 37 == 0, F.lit(0.5))
        .otherwise(raw)
    )
    rows = views.keys(spark, sf, row_idx=row_idx).withColumn("label", broken)
    return rows.join(_sheet_order(spark, sf), "sheet")


@query
def validate_labels(spark, sf):
    return validate.label_issues(_label_rows(spark, sf)).select(
        "sheet", "excel_row", "severity", "code", "message"
    )


@query
def validate_text(spark, sf):
    rows = views.documents(spark, sf, row_idx=True)
    return validate.text_issues(rows).select("sheet", "excel_row", "severity", "code", "message")


@query
def validate_pages(spark, sf):
    """Markup: most pages have many groups; the long list is left out of the comparison."""
    pages = views.table(spark, sf, "pages").select(F.lit("pages").alias("sheet"), F.col("page_id").alias("row_idx"), F.col("html").alias("text"))
    return validate.text_issues(pages).select("sheet", "excel_row", "severity", "code")


@query
def validate_numbered(spark, sf):
    texts = views.documents(spark, sf).select("doc_id", "text")
    rows = _label_rows(spark, sf).join(texts, "doc_id")
    issues = validate.numbered(validate.row_issues(rows))
    return issues.select("severity", "issue_no", "sheet", "column", "excel_row", "code")


@query
def validation_summary(spark, sf):
    texts = views.documents(spark, sf).select("doc_id", "text")
    rows = _label_rows(spark, sf, row_idx=False).join(texts, "doc_id")
    return validate.summarize(rows).drop("readable", "sheet_errors")


@query
def validation_overall(spark, sf):
    texts = views.documents(spark, sf).select("doc_id", "text")
    rows = _label_rows(spark, sf, row_idx=False).join(texts, "doc_id")
    return validate.overall(validate.summarize(rows))


@query
def header_check(spark, sf):
    """Required columns per table, where some tables lack one."""
    docs = views.table(spark, sf, "documents")
    n = F.count(F.lit(1))
    names = F.when(n % 2 == 0, F.array(F.lit("text"), F.lit("label"))).when(
        n % 3 == 0, F.array(F.lit("text"), F.lit("note"))
    ).otherwise(F.array(F.lit("sentence")))
    headers = docs.groupBy(F.concat("lang", F.lit("-"), "source").alias("sheet")).agg(names.alias("columns"))
    return validate.header_issues(headers.withColumn("sheet_ord", F.lit(0))).select(
        "sheet", "severity", "column", "code", "message"
    )


def _written_sheets(spark: SparkSession, sf: str) -> str:
    """The corpus as CSV folders, one per sheet: src3 lacks its label column, src4 has no header, the
    other sheets have their columns in either order. Files follow the order of the documents."""
    path = scratch_dir(spark)
    rows = views.documents(spark, sf).withColumn("label", _text_label())
    rows = rows.repartitionByRange("sheet", "doc_id").sortWithinPartitions("sheet", "doc_id")
    odd = F.col("sheet").isin(["src3", "src4"])
    # wide enough for any quoting: escapes double the quote, and line breaks stay inside quotes
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    some = rows.filter(~odd & (F.crc32(F.col("sheet").cast("binary")) % 2 == 0))
    some.select("sheet", "text", "label").write.partitionBy("sheet").options(**options).csv(path)
    rest = rows.filter(~odd & (F.crc32(F.col("sheet").cast("binary")) % 2 == 1))
    rest.select("sheet", "doc_id", "label", "text").write.partitionBy("sheet").options(**options).mode("append").csv(path)
    lacking = rows.filter(F.col("sheet") == "src3").select("sheet", "doc_id", "text")
    lacking.write.partitionBy("sheet").options(**options).mode("append").csv(path)
    bare = rows.filter(F.col("sheet") == "src4").select("sheet", F.lit("1").alias("text"), F.lit("x").alias("label")).limit(0)
    bare.drop("sheet").write.options(**{**options, "header": False}).csv(f"{path}/sheet=src4")
    return path


def _text_label() -> Column:
    """Labels as a sheet holds them: numbers, words, blanks."""
    d = F.col("doc_id")
    return F.when(d % 29 == 0, "2").when(d % 31 == 0, "yes").when(d % 37 == 0, F.lit(None)).otherwise((d % 2).cast("string"))


@query
def verify_files(spark, sf):
    """The verdict on all files of a folder."""
    return verification.verify_files(spark, _written_sheets(spark, sf)).verdict


@query
def verify_files_sheets(spark, sf):
    return verification.verify_files(spark, _written_sheets(spark, sf)).sheets.drop("sheet_ord")


@query
def verify_files_issues(spark, sf):
    """All messages in report order, by their digest."""
    out = verification.verify_files(spark, _written_sheets(spark, sf)).issues
    return out.select("severity", "issue_no", "sheet", "column", "excel_row", "code", F.md5("message").alias("message_md5"))


# ---- budget and splits ------------------------------------------------------------------------


@query
def row_budget(spark, sf):
    rows = views.keys(spark, sf, row_idx=True).join(_sheet_order(spark, sf), "sheet")
    return budget.row_budget(rows, 7, 100).select("sheet", "row_idx", "doc_id", "in_budget")


@query
def budget_quotas(spark, sf):
    rows = views.table(spark, sf, "documents").select(F.col("source").alias("sheet"))
    sizes = corpus_source.with_sheet_order(rows).groupBy("sheet", "sheet_ord").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("failed", F.col("sheet") == FAILED_SHEET)
    return budget.sheet_quotas(sizes, 30, 400).select("sheet", "rows", "used_before", "quota", "reached")


@query
def batches(spark, sf):
    rows = budget.with_batch(views.keys(spark, sf, row_idx=True), 10)
    return rows.groupBy("sheet", "batch_no").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_doc"))


@query
def batches_per_sheet(spark, sf):
    docs = views.table(spark, sf, "documents")
    return budget.batches_per_sheet(docs.groupBy(F.col("source").alias("sheet")).agg(F.count(F.lit(1)).alias("rows")), 10)


@query
def split_quota(spark, sf):
    return split.split_quota(views.keys(spark, sf))


@query
def balanced_split(spark, sf):
    return split.balanced_split(views.keys(spark, sf), "doc_id", seed=SEED).select("doc_id", "sheet", "label", "split")


@query
def balanced_split_by_lang(spark, sf):
    return split.balanced_split(views.keys(spark, sf, sheet="lang"), "doc_id", seed=SEED).select(
        "doc_id", "sheet", "label", "split"
    )


@query
def split_8020(spark, sf):
    docs = views.keys(spark, sf)
    return split.holdout_split(docs, "doc_id", seed=SEED).select("doc_id", "sheet", "split")


@query
def split_sizes(spark, sf):
    return profile.split_sizes(split.holdout_split(views.keys(spark, sf), "doc_id", seed=SEED))


@query
def learning_subsets(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id")
    return split.learning_subsets(docs, "doc_id", seed=SEED)


@query
def split_dropped(spark, sf):
    rows = views.keys(spark, sf)
    marked = split.balanced_split(rows, "doc_id", seed=SEED)
    return split.split_complement(rows, marked.filter(F.col("split") != "dropped"), "doc_id").select("doc_id", "sheet")


# ---- leakage ----------------------------------------------------------------------------------


def _splits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """80/20 split per language; the texts are compared against the narrow keys' cut-offs."""
    docs = views.documents(spark, sf, sheet="lang")
    narrow = views.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("sheet"))
    marked = split.holdout_split(docs, "doc_id", seed=SEED, names=("train", "test"), narrow=narrow)
    return marked.filter(F.col("split") == "train"), marked.filter(F.col("split") == "test")


@query
def exact_leak(spark, sf):
    train, test = _splits(spark, sf)
    return leakage.exact_duplicates(train, test, ["sheet"]).select("sheet", F.md5("text").alias("text_md5"))


@query
def exact_leak_sample(spark, sf):
    train, test = _splits(spark, sf)
    exact = leakage.exact_duplicates(train, test, ["sheet"])
    # order by md5: the two engines sort text differently
    keyed = exact.withColumn("text", F.md5("text"))
    return leakage.sample_duplicates(keyed, ["sheet"])


@query
def leak_verdict(spark, sf):
    train, test = _splits(spark, sf)
    return leakage.leak_verdict(leakage.exact_duplicates(train, test, ["sheet"]))


@query
def near_leak(spark, sf):
    train, test = _splits(spark, sf)
    return leakage.near_duplicates(train, test, ["sheet"])


@query
def near_leak_top3(spark, sf):
    train, test = _splits(spark, sf)
    return leakage.top_pairs(leakage.near_duplicates(train, test, ["sheet"]), ["sheet"])


@query
def near_leak_verdict(spark, sf):
    train, test = _splits(spark, sf)
    near = leakage.near_duplicates(train, test, ["sheet"])
    return leakage.leak_verdict(leakage.exact_duplicates(train, test, ["sheet"]), near)


@query
def near_leak_sentences(spark, sf):
    """Single lines instead of whole documents: the length the check is usually run on."""
    train, test = _splits(spark, sf)

    def lines(df: DataFrame) -> DataFrame:
        return df.select("sheet", F.explode(F.split(tx.strip_marks("text"), "\n")).alias("text"))

    return leakage.near_duplicates(lines(train), lines(test), ["sheet"])


def _planted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Texts of which each has exactly one relative: words become digests that depend on the document,
    and the test text has characters that occur nowhere else, at its end or, if short, in its middle."""
    docs = views.table(spark, sf, "documents").select("doc_id", F.col("source").alias("sheet"), F.split("text", r"\s+").alias("w"))
    kept = F.slice("w", 1, F.when(F.col("doc_id") % 2 == 0, 14).otherwise(60))
    text = F.array_join(F.transform(kept, lambda x: F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), x)), 1, 9)), "")
    docs = docs.select("doc_id", "sheet", text.alias("text"))
    foreign = F.repeat(F.lit("ж"), (F.col("doc_id") % 45 + 1).cast("int"))
    half = F.floor(F.length("text") / 2).cast("int")
    middle = F.concat(F.substring("text", 1, half), foreign, F.substring("text", half + 1, F.length("text")))
    short = F.length("text") + F.length(foreign) < leakage.HEURISTIC_LENGTH
    return docs, docs.withColumn("text", F.when(short, middle).otherwise(F.concat("text", foreign)))


@query
def near_leak_planted(spark, sf):
    """Each document's text against itself with 1 to 45 foreign characters: ratio 2n / (2n + k)."""
    near = leakage.near_duplicates(*_planted(spark, sf), ["sheet"])
    digests = (F.md5("train_text").alias("train_md5"), F.md5("test_text").alias("test_md5"))
    return rounded(near.select("sheet", *digests, "ratio", "pairs"))


@query
def near_leak_planted_top3(spark, sf):
    near = leakage.near_duplicates(*_planted(spark, sf), ["sheet"])
    best = leakage.top_pairs(near.withColumns({"train_text": F.md5("train_text"), "test_text": F.md5("test_text")}), ["sheet"])
    return rounded(best)


@query
def near_leak_planted_verdict(spark, sf):
    train, test = _planted(spark, sf)
    near = leakage.near_duplicates(train, test, ["sheet"])
    return leakage.leak_verdict(leakage.exact_duplicates(train, test, ["sheet"]), near)


# ---- tokens -----------------------------------------------------------------------------------


def _turn_tokens(spark: SparkSession, sf: str) -> DataFrame:
    turns = views.table(spark, sf, "conversations").withColumn("label", (F.col("turn") % 2).cast("int"))
    return tokens.training_examples(turns, catalogue.prompt_text(1), ids=tokens.word_length_ids)


@query
def token_table(spark, sf):
    return _turn_tokens(spark, sf).select(
        "conv_id",
        "turn",
        joined("input_ids").alias("input_ids"),
        joined("attention_mask").alias("attention_mask"),
        joined("token_type_ids").alias("token_type_ids"),
    )


def word_length_tokenizer() -> tokens.Tokenizer:
    """Tokenizer of the user's own: the length of each word."""
    return lambda texts: [[len(w) for w in re.split(r"\s+", t.strip()) if w] for t in texts]


@query
def tokenizer_hook(spark, sf):
    """Training examples through a tokenizer that runs in Python."""
    turns = views.table(spark, sf, "conversations").withColumn("label", (F.col("turn") % 2).cast("int"))
    rows = tokens.training_examples(turns, catalogue.prompt_text(1), tokenizer=word_length_tokenizer)
    return rows.select("conv_id", "turn", joined("input_ids").alias("input_ids"), F.size("attention_mask").alias("size"))


@query
def union_sheets(spark, sf):
    """All rows of sheets with different columns; what a sheet lacks is null."""
    docs = views.table(spark, sf, "documents")
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))

    def sheet(lang: str) -> DataFrame:
        return docs.filter(F.col("lang") == lang).select("doc_id", F.lit(lang).alias("sheet"))

    frames = [
        sheet("en").join(labels, "doc_id", "left"),
        sheet("de").withColumn("note", F.concat(F.lit("n"), F.col("doc_id").cast("string"))),
        sheet("fr").join(docs.select("doc_id", "n_chars"), "doc_id"),
        sheet("es"),
    ]
    return corpus_source.union_sheets(frames)


@query
def left_pad(spark, sf):
    padded = tokens.left_padded(_turn_tokens(spark, sf), ["conv_id"])
    return padded.select(
        "conv_id", "turn", joined("padded_ids").alias("padded_ids"), joined("padded_mask").alias("padded_mask")
    )


@query
def token_accuracy(spark, sf):
    """Predictions that miss every fifth position; every third label is ignored."""
    ids = _turn_tokens(spark, sf).select("role", F.col("input_ids").alias("ids"))
    at = F.transform("ids", lambda x, i: F.when(i % 3 == 2, F.lit(-100)).otherwise(x))
    shifted = F.concat(F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), F.array(F.lit(0)))
    guess = F.transform(shifted, lambda x, i: F.when(i % 5 == 0, x + 1).otherwise(x))
    rows = ids.select("role", guess.alias("preds"), at.alias("labels"))
    return tokens.token_accuracy(rows, by=["role"])


# ---- ledger -----------------------------------------------------------------------------------


@query
def epoch_log(spark, sf):
    log = views.training_log(spark, sf)
    train_eval = log.filter(F.col("step") % 500 == 0).select(
        "step", F.floor("epoch").alias("epoch"), (F.col("step") % 7 / F.lit(7.0)).alias("train_accuracy")
    )
    stats = ledger.epoch_stats(log, train_eval)
    # the mean of many doubles is compared with two digits only
    return stats.withColumn("train_loss", F.round("train_loss", 2))


@query
def run_ids(spark, sf):
    runs = views.run_table(spark, sf)
    name = naming.run_id(F.col("provider"), F.col("model"), F.col("prompt_no"), naming.method_name(5, 50), F.col("label"))
    named = runs.select("o_orderkey", name.alias("run_id"), naming.result_name(name, F.col("experiment")).alias("result_name"))
    return named.withColumn("metrics_name", naming.metrics_name(F.col("result_name")))


@query
def next_experiment(spark, sf):
    runs = views.run_table(spark, sf)
    name = naming.run_id(F.col("provider"), F.col("model"), F.col("prompt_no"), naming.method_name(5, 50), F.col("label"))
    return ledger.next_experiment(runs.select(name.alias("run_id"), "experiment"))


@query
def pick_models(spark, sf):
    runs = scoring.pick_model(views.run_table(spark, sf), catalogue.DEFAULT_MODELS)
    return runs.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("runs"))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Iterations per mode, from the orders."""
    o = views.table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("mode"), (F.col("o_custkey") % 9).cast("string")).alias("mode"),
        F.col("o_orderkey").cast("long").alias("iteration"),
        (F.col("o_custkey") % 4 + 1).cast("int").alias("epochs"),
        F.concat(F.lit("finetune-"), F.col("o_orderkey").cast("string")).alias("path"),
    )


@query
def latest_run(spark, sf):
    return ledger.latest_runs(_ledger(spark, sf))


@query
def cumulative_epoch(spark, sf):
    return ledger.cumulative_epochs(_ledger(spark, sf)).select("mode", "iteration", "total_epochs")


@query
def continued_iterations(spark, sf):
    p = views.table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 == 0, F.lit("a-3x"))
        .when(F.col("p_partkey") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("finetune-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")))
        .alias("resume_from"),
    )
    return ledger.continued_iterations(p, 3).select("p_partkey", "i", "iteration", "name")


@query
def run_ledger_stamped(spark, sf):
    """Runs without a time of their own get that of the append."""
    ev = views.table(spark, sf, "events")
    path = f"{scratch_dir(spark)}/ledger"
    runs = ev.groupBy((F.col("user_id") % 50).cast("int").alias("iteration")).agg(F.max("value").cast("double").alias("train_loss"))
    records = runs.select(
        F.lit("lora").alias("mode"), "iteration", F.lit(1).alias("epochs"), F.round("train_loss", 3).alias("train_loss"),
        F.lit(None).cast("double").alias("eval_loss"), F.lit(None).cast("double").alias("eval_accuracy"), F.lit("run").alias("path"),
    )
    began = F.lit(datetime.datetime.now(datetime.timezone.utc) - datetime.timedelta(seconds=1)).cast("timestamp")
    ledger.append_run(records, path)
    stamped = (F.col("timestamp") >= began) & (F.col("timestamp") <= F.current_timestamp())
    return ledger.read_ledger(spark, path).select("mode", "iteration", "train_loss", stamped.alias("stamped"))


@query
def run_ledger(spark, sf):
    """Two appends to a ledger table, read back in order; losses come from the events."""
    ev = views.table(spark, sf, "events")
    path = f"{scratch_dir(spark)}/ledger"
    per_user = ev.groupBy((F.col("user_id") % 50).cast("int").alias("iteration")).agg(
        F.round(F.max("value"), 3).alias("train_loss"), F.min("value").alias("eval_loss"), F.max("ts").alias("timestamp")
    )
    records = per_user.select(
        F.lit("lora").alias("mode"),
        "iteration",
        F.lit(1).alias("epochs"),
        F.col("train_loss").cast("double").alias("train_loss"),
        F.col("eval_loss").cast("double").alias("eval_loss"),
        F.lit(None).cast("double").alias("eval_accuracy"),
        F.concat(F.lit("run-"), F.col("iteration").cast("string")).alias("path"),
        "timestamp",
    )
    ledger.append_run(records.filter(F.col("iteration") < 25), path)
    ledger.append_run(records.filter(F.col("iteration") >= 25), path)
    return ledger.read_ledger(spark, path).select("mode", "iteration", "train_loss", "eval_loss", "eval_accuracy", "path")


# ---- scoring ----------------------------------------------------------------------------------


def length_scorer() -> scoring.Scorer:
    """Deterministic offline scorer."""

    def reply(texts: list[str]) -> list[str]:
        return [f"answer {len(t) % 2}" if len(t) % 3 else "unsure" for t in texts]

    return reply


def fragile_scorer() -> scoring.Scorer:
    """Fails the whole request when one text has a length divisible by 7."""

    def reply(texts: list[str]) -> list[str]:
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("unavailable")
        return [f"1 of {len(t)}" for t in texts]

    return reply


@query
def score_hook(spark, sf):
    scored = scoring.score(views.documents(spark, sf), length_scorer, partitions=parallelism(spark))
    return scored.select("doc_id", "ai_label", "ai_reply", "error")


@query
def align_predictions(spark, sf):
    """Predictions of another system, joined by sheet and row from bucketed tables."""
    name = "t" + scratch_dir(spark).rsplit("/", 1)[-1]
    rows = views.keys(spark, sf, row_idx=True)
    scoring.save_bucketed(rows.select("sheet", "row_idx", "label"), f"{name}_corpus", 8)
    told = rows.filter("doc_id % 3 <> 0").select("sheet", "row_idx", (F.col("doc_id") % 2).cast("int").alias("prediction"))
    scoring.save_bucketed(told, f"{name}_told", 8)
    return scoring.align_predictions(spark.table(f"{name}_corpus"), spark.table(f"{name}_told"))


@query
def score_errors(spark, sf):
    scored = scoring.score(views.documents(spark, sf), fragile_scorer, partitions=parallelism(spark))
    return scored.select("doc_id", "ai_label", "ai_reply", "error")


@query
def score_batch_errors(spark, sf):
    scored = scoring.score_in_batches(views.documents(spark, sf, row_idx=True), fragile_scorer)
    return scored.select("doc_id", "ai_label", "ai_reply", "error")


@query
def score_throttled(spark, sf):
    scored = scoring.score_throttled(views.documents(spark, sf), length_scorer, queries_per_minute=6e6, workers=4)
    return scored.select("doc_id", "ai_label", "ai_reply")


@query
def evaluate_end_to_end(spark, sf):
    """Budget, scoring hook, label parsing, metrics and TOTAL in one flow."""
    result = evaluation.evaluate_corpus(views.corpus(spark, sf), length_scorer, max_per_sheet=30, max_total=400)
    return result.report.drop("sheet_ord")


@query
def evaluate_failed_sheets(spark, sf):
    """Labels as text: a sheet with one that is no number among its rows to process fails, and leaves
    its budget to the sheets after it."""
    rows = views.corpus(spark, sf)
    label = F.when(F.col("doc_id") % 211 == 5, F.lit("n/a")).otherwise(F.col("label").cast("string"))
    result = evaluation.evaluate_corpus(rows.withColumn("label", label), length_scorer, max_per_sheet=30, max_total=400)
    return result.report.drop("sheet_ord")


@query
def evaluate_empty_sheets(spark, sf):
    """Sheets that are named but have no rows, and one that could not be read."""
    langs = views.table(spark, sf, "documents").select(F.concat(F.lit("empty-"), "lang").alias("sheet")).distinct()
    rows = views.corpus(spark, sf)
    failed = rows.filter(F.col("sheet") == FAILED_SHEET).select("sheet", "sheet_ord").distinct()
    result = evaluation.evaluate_corpus(
        rows, length_scorer, max_per_sheet=30, max_total=400, failed_sheets=failed, sheets=langs.withColumn("sheet_ord", F.lit(0))
    )
    return result.report.drop("sheet_ord")


# ---- embeddings and models --------------------------------------------------------------------


def count_encoder() -> embedding.Encoder:
    """Deterministic offline encoder: length, blanks, letters e."""

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], dtype=np.float32)

    return encode


@query
def embed_compound(spark, sf):
    docs = views.documents(spark, sf).withColumn("label", F.lit(1))
    rows = embedding.compound_embedding(embedding.clean_corpus(docs), count_encoder, partitions=parallelism(spark))
    return rows.select("doc_id", joined(F.transform("embedding", lambda x: x.cast("int"))).alias("embedding"))


@query
def embed_hashed(spark, sf):
    docs = views.documents(spark, sf).withColumn("label", F.lit(1))
    rows = embedding.compound_embedding(embedding.clean_corpus(docs), dims=32, partitions=parallelism(spark))
    shown = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    return rows.select("doc_id", "sheet", F.posexplode(shown).alias("dim", "value"))


@query
def wide_embeddings(spark, sf):
    """Wide export and the fold back: all dimensions and the width."""
    e = views.table(spark, sf, "embeddings")
    wide = embedding.to_wide(e, 64, metadata=["vec_id", "label"])
    back = embedding.from_wide(wide)
    shown = [F.round(F.col(f"w.emb_{i}").cast("double"), 6).alias(f"emb_{i}") for i in range(64)]
    both = back.alias("b").join(wide.alias("w"), "vec_id")
    return both.select("vec_id", F.col("b.label").alias("label"), F.size("b.embedding").alias("dims"), *shown)


@query
def ols_fit_eval(spark, sf):
    """Least squares on the train rows, 20-column report of the test rows with TOTAL."""
    rows = learning.with_features(views.feature_rows(spark, sf))
    model = learning.fit_ols(rows.filter(~F.col("is_test")))
    return rounded(regression.category_report(learning.predict_ols(model, rows.filter("is_test")), total=True))


@query
def ols_training_quality(spark, sf):
    """Quality on the training rows of a model that was written and read again."""
    rows = learning.with_features(views.feature_rows(spark, sf)).filter(~F.col("is_test"))
    path = f"{scratch_dir(spark)}/model"
    learning.save_model(spark, learning.fit_ols(rows), path)
    quality = learning.fit_quality(learning.load_model(spark, path), rows)
    return quality.select("n_samples", *(F.round(c, 9).alias(c) for c in ("mse", "r2_score")))


@query
def ols_normal_equations(spark, sf):
    """Residuals are orthogonal to every dimension, also where a dimension repeats another one."""
    twice = F.concat("embedding", F.slice("embedding", 1, 8)).alias("embedding")
    rows = views.feature_rows(spark, sf).filter(~F.col("is_test")).select("label", twice)
    rows = learning.with_features(rows)
    out = learning.residual_products(learning.fit_ols(rows), rows)
    return out.select("dim", F.abs(F.round("product", 6)).alias("product"))


@query
def logistic_eval(spark, sf):
    rows = learning.with_features(views.feature_rows(spark, sf))
    model = learning.fit_logistic(rows.filter(~F.col("is_test")))
    return learning.evaluate_logistic(model, rows.filter("is_test"))


@query
def logistic_gradient(spark, sf):
    """The gradient of every share's objective at its fit: 0 in all dimensions."""
    rows = learning.with_features(views.feature_rows(spark, sf)).filter(~F.col("is_test"))
    shares = learning.nested_shares(rows, "vec_id")
    models = learning.fit_logistic_shares(shares, list(learning.PERCENTS))
    out = learning.share_gradients(models, shares)
    return out.select("share", "dim", F.abs(F.round("gradient", 5)).alias("gradient"))


@query
def learning_curve(spark, sf):
    rows = learning.with_features(views.feature_rows(spark, sf))
    return learning.learning_curve(rows.filter(~F.col("is_test")), rows.filter("is_test"), "vec_id")


# ---- sources and sinks ------------------------------------------------------------------------


@query
def sink_roundtrip(spark, sf):
    """Scored table by sheet and metrics CSV: written, read back, joined."""
    base = scratch_dir(spark)
    scored = views.scored_keys(spark, sf)
    sinks.write_scored(scored, f"{base}/scored")
    back = spark.read.parquet(f"{base}/scored")
    counts = metrics.confusion_counts(back, ["sheet"])
    sinks.write_metrics_csv(metrics.report_with_total(counts.withColumn("sheet_ord", F.lit(1)), order="sheet_ord"), f"{base}/metrics")
    header = ", ".join(["sheet_name string"] + [f"{c} long" for c in metrics.COUNTS] + [f"{c} double" for c in metrics.RATES])
    return spark.read.schema(header).option("sep", ";").option("header", True).csv(f"{base}/metrics")


@query
def scored_sink(spark, sf):
    """Scored rows with their texts, written by sheet and read back."""
    path = f"{scratch_dir(spark)}/scored"
    texts = views.documents(spark, sf).select("doc_id", "text")
    sinks.write_scored(views.scored_keys(spark, sf).join(texts, "doc_id"), path)
    back = spark.read.parquet(path)
    return back.select("doc_id", "sheet", "label", "ai_label", "ai_reply", F.md5("text").alias("text_md5"))


@query
def split_sink(spark, sf):
    """Whole rows of both splits, written and read back."""
    path = f"{scratch_dir(spark)}/splits"
    marked = split.balanced_split(views.keys(spark, sf), "doc_id", seed=SEED)
    sinks.write_splits(marked.join(views.documents(spark, sf).select("doc_id", "text"), "doc_id"), path)
    return spark.read.parquet(path).select("split", "sheet", "doc_id", "label", F.md5("text").alias("text_md5"))


@query
def report_sink(spark, sf):
    """All columns of the report, written as CSV and read back."""
    path = f"{scratch_dir(spark)}/report"
    report = regression.category_report(views.regression_rows(spark, sf), total=True)
    sinks.write_report_csv(report, path)
    kinds = {c: t for c, t in report.dtypes if c in regression.REPORT_COLUMNS}
    schema = ", ".join(f"{c} {kinds[c]}" for c in regression.REPORT_COLUMNS)
    return rounded(spark.read.option("header", True).schema(schema).csv(path))


@query
def embedding_sink(spark, sf):
    """All components, written as vectors and as a wide CSV, and read back."""
    base = scratch_dir(spark)
    e = views.table(spark, sf, "embeddings").withColumn("sheet", F.lit("all"))
    sinks.write_embeddings(e, f"{base}/vectors")
    sinks.write_wide_embeddings(corpus_source.read_embeddings(spark, f"{base}/vectors"), f"{base}/wide", 64)
    back = corpus_source.read_wide_embeddings(spark, f"{base}/wide", 64, "sheet string, label int")
    values = back.select("label", F.posexplode("embedding").alias("dim", "value"))
    return values.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def workbook_ingest(spark, sf):
    """Documents packed into workbooks, decoded again and validated per sheet."""
    rows = views.documents(spark, sf, row_idx=True).withColumn("label", (F.col("doc_id") % 3).cast("int"))
    raw = workbook.decode(workbook.pack_workbooks(rows, 40))
    cells = workbook.corpus_rows(raw)
    return cells.groupBy("sheet").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("label") == "1").alias("ones"),
        F.count_distinct("file").alias("books"),
    )
