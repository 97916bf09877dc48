"""Run bookkeeping: training log per epoch, run ledger, experiment numbers, latest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.functions.naming import iteration_name, trailing_iteration
from sheafline.functions.numbers import round_exact
from sheafline.operators.ranking import ROWS_PER_TASK, prefix_sums

LEDGER_SCHEMA = (
    "mode string, iteration int, epochs int, train_loss double, eval_loss double, "
    "eval_accuracy double, path string, timestamp timestamp"
)


def epoch_stats(log: DataFrame, train_eval: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Per epoch: mean step loss, training accuracy, last evaluation loss and accuracy; missing is 0.

    ``log`` has ``step, epoch, loss, eval_loss, eval_accuracy``. A step row (no ``eval_loss``) counts
    for ``ceil(epoch)``, an evaluation row for the truncated epoch, where the last step wins.
    ``train_eval`` has ``step, epoch, train_accuracy``. Both kinds are aggregated in one pass over
    the log, so the merge of the two epoch sets needs no join.
    """
    by = list(by)
    is_eval = F.col("eval_loss").isNotNull()
    usable = log.filter(is_eval | F.col("loss").isNotNull())
    epoch = F.when(is_eval, F.floor(F.abs("epoch")) * F.signum("epoch")).otherwise(F.ceil("epoch")).cast("int")
    keyed = usable.select(*by, epoch.alias("epoch"), "step", "loss", "eval_loss", "eval_accuracy", is_eval.alias("_eval"))
    stats = keyed.groupBy(*by, "epoch").agg(
        F.avg(F.when(~F.col("_eval"), F.col("loss"))).alias("train_loss"),
        F.max_by(F.struct("eval_loss", "eval_accuracy"), F.when(F.col("_eval"), F.col("step"))).alias("_last"),
    )
    if train_eval is None:
        stats = stats.withColumn("train_accuracy", F.lit(0.0))
    else:
        last = train_eval.groupBy(*by, F.col("epoch").cast("int").alias("epoch")).agg(
            F.max_by("train_accuracy", "step").alias("train_accuracy")
        )
        stats = stats.join(last, [*by, "epoch"], "left")

    def shown(c: str):
        return round_exact(F.coalesce(F.col(c), F.lit(0.0)), 4)

    return stats.select(
        *by,
        "epoch",
        shown("train_loss").alias("train_loss"),
        shown("train_accuracy").alias("train_accuracy"),
        shown("_last.eval_loss").alias("eval_loss"),
        shown("_last.eval_accuracy").alias("eval_accuracy"),
    )


def append_run(records: DataFrame, path: str) -> None:
    """Append finished iterations to the ledger table; the time is the write's unless given."""
    if "timestamp" not in records.columns:
        records = records.withColumn("timestamp", F.current_timestamp())
    rounded = records.withColumns(
        {c: round_exact(F.coalesce(F.col(c), F.lit(0.0)), 4) for c in ("train_loss", "eval_loss", "eval_accuracy")}
    )
    rounded.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in iteration order; an empty table where none was written yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(path) if exists else spark.createDataFrame([], LEDGER_SCHEMA)
    return ledger.orderBy("iteration", "timestamp")


def latest_runs(ledger: DataFrame, by: str = "mode") -> DataFrame:
    """Checkpoint pointer: path and number of the last iteration of each mode."""
    return ledger.groupBy(by).agg(F.max("iteration").alias("iteration"), F.max_by("path", "iteration").alias("path"))


def cumulative_epochs(ledger: DataFrame, by: str = "mode", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Epochs trained up to and including each iteration; a mode may have any number of runs."""
    return prefix_sums(ledger, [by], ["iteration"], "epochs", "total_epochs", rows_per_task)


def continued_iterations(runs: DataFrame, iterations: int, resume: str = "resume_from") -> DataFrame:
    """Number and name of the next ``iterations`` runs after the one named in ``resume``."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(iterations)))
    planned = runs.withColumn("i", numbers).withColumn(
        "iteration", F.coalesce(trailing_iteration(F.col(resume)), F.lit(0)) + F.col("i")
    )
    return planned.withColumn("name", iteration_name(F.col("iteration")))


def next_experiment(used: DataFrame, run: str = "run_id", number: str = "experiment") -> DataFrame:
    """Smallest positive number not used by each run: the first gap, not the maximum plus one.

    In the sorted distinct numbers of a run the first one that differs from its position marks the
    gap; without one the next number is the count plus one. Numbers are at most as many as result
    files of that run.
    """
    distinct = used.filter(F.col(number) >= 1).select(run, number).distinct()
    at = F.row_number().over(Window.partitionBy(run).orderBy(number))
    placed = distinct.withColumn("_at", at)
    free = placed.groupBy(run).agg(
        F.coalesce(F.min(F.when(F.col(number) != F.col("_at"), F.col("_at"))), F.max("_at") + 1).alias("next_experiment")
    )
    runs = used.select(run).distinct()
    return runs.join(free, run, "left").withColumn(
        "next_experiment", F.coalesce("next_experiment", F.lit(1)).cast("int")
    )
