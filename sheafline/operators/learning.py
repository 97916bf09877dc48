"""Linear and logistic models on embeddings.

The rows meet a model only through sums: blocks of rows are turned into cross products inside the
tasks (numpy on Arrow batches), partial sums are added up as a tree, and what reaches the driver is
one (d+1) x (d+1) matrix per model, whatever the number of rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sheafline.operators.metrics import confusion_counts, confusion_percent, weighted_prf
from sheafline.operators.regression import regression_metrics
from sheafline.operators.split import learning_subsets
from sheafline.session import materialize

FAN = 32  # partial sums that one task adds up
PERCENTS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100)
CERTAIN = 1e3  # intercept of a model that saw one class only


@dataclass(frozen=True)
class LinearModel:
    """``features . coefficients + intercept``."""

    coefficients: np.ndarray
    intercept: float

    def margin(self, features: str = "features") -> Column:
        """Computed in the JVM. A vector of another length is an error, a null one gives null."""
        weights = np.asarray(self.coefficients, np.float64)
        wrong = F.size(features) != len(weights)
        message = F.concat(F.lit(f"expected {len(weights)} dimensions, found "), F.size(features).cast("string"))
        products = F.zip_with(features, F.lit(weights), lambda x, w: x * w)
        total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + F.lit(float(self.intercept))
        return F.when(F.col(features).isNotNull(), F.when(wrong, F.raise_error(message).cast("double")).otherwise(total))


def with_features(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``features`` ARRAY<DOUBLE> and DOUBLE ``label``."""
    return df.withColumn("features", F.col(vector).cast("array<double>")).withColumn("label", F.col(label).cast("double"))


# ---- sums over blocks of rows -----------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows; they must have one length."""
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or column.values.null_count or len(set(lengths.tolist())) > 1:
        raise ValueError("vectors of a fit must not be null or hold nulls, and have one length")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64, copy=False)


def block_sums(
    df: DataFrame, columns: list[str], block: Callable[..., dict[int, np.ndarray]], add: Callable = np.add
) -> dict[int, np.ndarray]:
    """Results of ``block`` (key -> flat vector) over all blocks of rows, put together by ``add``.

    ``block`` gets ``columns`` as arrays, vectors as a matrix. Partial results of ``FAN`` tasks at a
    time are put together, so neither a task nor the driver holds more than ``FAN`` per key.
    """

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                arrays = [_matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
                for key, value in block(*arrays).items():
                    found[key] = add(found[key], value) if key in found else value
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(found), pa.int32()),
                pa.array([task] * len(found), pa.int64()),
                pa.array([np.asarray(v, np.float64).tobytes() for v in found.values()], pa.binary()),
            ],
            ["key", "task", "total"],
        )

    def together(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in rows.sort_values("task")["total"]:
            value = np.frombuffer(data)
            total = value if total is None else add(total, value)
        return pd.DataFrame({"key": [keys[0]], "task": [keys[1]], "total": [total.tobytes()]})

    schema = "key int, task long, total binary"
    sums = materialize(df.select(*columns).mapInArrow(of_task, schema))
    while (sums.agg(F.max("task")).first()[0] or 0) >= FAN:
        level = sums.withColumn("task", F.floor(F.col("task") / F.lit(FAN)))
        sums = materialize(level.groupBy("key", "task").applyInPandas(together, schema))
    out: dict[int, np.ndarray] = {}
    for row in sums.orderBy("key", "task").collect():
        value = np.frombuffer(row["total"])
        out[row["key"]] = add(out[row["key"]], value) if row["key"] in out else value
    return out


# ---- least squares ----------------------------------------------------------------------------


def _moments(x: np.ndarray, y: np.ndarray) -> dict[int, np.ndarray]:
    """Rows, means and centred cross products of a block."""
    z = np.column_stack([x, y])
    mean = z.mean(axis=0)
    z = z - mean
    return {0: np.concatenate([[len(z)], mean, (z.T @ z).ravel()])}


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two blocks together: the cross products gain the distance of the means."""
    d = int((np.sqrt(4 * len(a) - 3) - 1) / 2)
    n, m = a[0], b[0]
    step = b[1 : d + 1] - a[1 : d + 1]
    mean = a[1 : d + 1] + step * (m / (n + m))
    return np.concatenate([[n + m], mean, a[d + 1 :] + b[d + 1 :] + np.outer(step, step).ravel() * (n * m / (n + m))])


def fit_ols(df: DataFrame) -> LinearModel:
    """Least squares with intercept in one pass; of all solutions the one of least norm.

    Solved from the eigenvalues of the centred cross products: directions whose eigenvalue is rounding
    noise are left at zero, so collinear dimensions and fewer rows than dimensions are no special case.
    """
    found = block_sums(df, ["features", "label"], _moments, _merged)
    if not found:
        raise ValueError("a fit needs at least one row")
    moments = found[0]
    d = int((np.sqrt(4 * len(moments) - 3) - 1) / 2)
    mean, cross = moments[1 : d + 1], moments[d + 1 :].reshape(d, d)
    values, vectors = np.linalg.eigh(cross[:-1, :-1])
    keep = values > np.finfo(float).eps * d * max(values.max(initial=0), 0)
    inverse = np.divide(1.0, values, out=np.zeros_like(values), where=keep)
    weights = vectors @ (inverse * (vectors.T @ cross[:-1, -1]))
    return LinearModel(weights, float(mean[-1] - mean[:-1] @ weights))


def predict_ols(model: LinearModel, df: DataFrame) -> DataFrame:
    return df.withColumn("y_pred", model.margin()).withColumn("y_true", F.col("label"))


def fit_quality(model: LinearModel, df: DataFrame) -> DataFrame:
    """MSE and R2 of the model on a table (the training table for training quality)."""
    return regression_metrics(predict_ols(model, df), []).select("n_samples", "mse", "r2_score")


def residual_products(model: LinearModel, df: DataFrame) -> DataFrame:
    """dim, product: residuals times each dimension (0: the constant), which least squares makes 0."""
    residual = F.col("label") - model.margin()
    terms = F.posexplode(F.concat(F.array(F.lit(1.0)), F.col("features")))
    rows = df.select(residual.alias("r"), terms.alias("dim", "x"))
    return rows.groupBy("dim").agg(F.sum(F.col("r") * F.col("x")).alias("product"))


# ---- logistic ---------------------------------------------------------------------------------


def fit_logistic_shares(
    df: DataFrame, shares: list[int], share: str = "from_percent", c: float = 1.0, max_iter: int = 100, tolerance: float = 1e-9
) -> dict[int, tuple[LinearModel, int]]:
    """L2 logistic fits on nested shares of the rows, all in the same passes: share -> (model, rows).

    A row belongs to every share that is at least its ``share`` value. The objective is half the
    squared coefficients plus ``c`` times the summed log loss, the intercept free. Each pass sums loss,
    gradient and curvature of every share that is not done, and each share takes its own Newton step
    (halved where the loss rose). A share without rows is left out, one with a single class always
    predicts it.
    """
    state: dict[int, dict] = {s: {"step": None, "best": np.inf} for s in shares}
    done: dict[int, tuple[LinearModel, int]] = {}
    width = None
    for turn in range(max_iter + 1):
        now = {s: st.get("w") for s, st in state.items()}

        def block(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> dict[int, np.ndarray]:
            z = np.column_stack([x, np.ones(len(x))])
            out = {}
            for s, w in now.items():
                mine = own <= s
                if not mine.any():
                    continue
                zs, ys = z[mine], y[mine]
                m = zs @ w if w is not None else np.zeros(len(zs))
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                loss = np.logaddexp(0, m).sum() - m @ ys
                out[s] = np.concatenate([[len(ys), ys.sum(), loss], zs.T @ (p - ys), ((zs * (p * (1 - p))[:, None]).T @ zs).ravel()])
            return out

        sums = block_sums(df, ["features", "label", share], block)
        for s in list(state):
            st = state[s]
            if s not in sums:
                del state[s]
                continue
            n, ones, loss = sums[s][:3]
            width = width or int((np.sqrt(1 + 4 * (len(sums[s]) - 3)) - 1) / 2)
            w = st.get("w", np.zeros(width))
            if ones in (0, n):
                done[s] = LinearModel(np.zeros(width - 1), CERTAIN if ones else -CERTAIN), int(n)
                del state[s]
                continue
            penalty = np.append(np.ones(width - 1), 0.0)
            value = c * loss + 0.5 * (penalty * w * w).sum()
            gradient = c * sums[s][3 : 3 + width] + penalty * w
            flat = np.abs(gradient).max() <= tolerance * max(1.0, c * n)
            if value > st["best"] + 1e-9 * abs(st["best"]) and st["step"] is not None and not flat:
                st["step"] = st["step"] / 2
                st["w"] = st["from"] - st["step"]
                continue
            if flat or turn == max_iter:
                if not flat:
                    warnings.warn(f"share {s}: the logistic fit did not converge in {max_iter} steps", stacklevel=2)
                done[s] = LinearModel(w[:-1], float(w[-1])), int(n)
                del state[s]
                continue
            curvature = c * sums[s][3 + width :].reshape(width, width) + np.diag(penalty)
            st["step"] = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            st["from"], st["best"], st["w"] = w, value, w - st["step"]
        if not state:
            break
    return dict(sorted(done.items()))


def fit_logistic(df: DataFrame, c: float = 1.0, max_iter: int = 100) -> LinearModel:
    """L2 logistic regression with inverse strength ``c`` and a free intercept."""
    fitted = fit_logistic_shares(df.withColumn("_all", F.lit(100)), [100], "_all", c, max_iter)
    if not fitted:
        raise ValueError("a fit needs at least one row")
    return fitted[100][0]


def share_gradients(models: dict[int, tuple[LinearModel, int]], df: DataFrame, share: str = "from_percent", c: float = 1.0) -> DataFrame:
    """share, dim, gradient of each share's objective at its model, summed in the JVM; the last
    dimension is the intercept's."""
    parts = [
        F.struct(F.lit(s).alias("share"), (F.lit(1.0) / (1.0 + F.exp(-m.margin())) - F.col("label")).alias("r"), F.lit(m.coefficients).alias("w"))
        for s, (m, _) in models.items()
    ]
    rows = df.select("features", F.col(share).alias("_own"), F.inline(F.array(*parts))).filter("_own <= share")
    terms = F.posexplode(F.concat(F.transform("features", lambda x: x * F.col("r")), F.array("r")))
    summed = rows.select("share", "w", terms.alias("dim", "g")).groupBy("share", "dim").agg(F.sum("g").alias("g"), F.first("w").alias("w"))
    return summed.select("share", "dim", (c * F.col("g") + F.coalesce(F.get("w", F.col("dim")), F.lit(0.0))).alias("gradient"))


def _quality(counts: DataFrame, by: list[str]) -> DataFrame:
    table = weighted_prf(confusion_percent(counts))
    return table.select(
        *by,
        F.col("n").alias("test_sentences"),
        "true_positives", "true_negatives", "false_positives", "false_negatives",
        "precision", "recall", "f1",
    )


def evaluate_logistic(model: LinearModel, test: DataFrame) -> DataFrame:
    """Confusion cells in percent and support-weighted precision, recall, F1: one row."""
    scored = test.select("label", (model.margin() > 0).cast("double").alias("prediction"), F.lit(1).alias("_one"))
    return _quality(confusion_counts(scored, ["_one"], pred="prediction"), [])


def nested_shares(train: DataFrame, row_id: str, percents: tuple[int, ...] = PERCENTS, seed: int = 42) -> DataFrame:
    """The training rows with the smallest share that has them, written once for all passes."""
    return materialize(learning_subsets(train.select(row_id, "features", "label"), row_id, percents, seed))


def learning_curve(
    train: DataFrame,
    test: DataFrame,
    row_id: str,
    percents: tuple[int, ...] = PERCENTS,
    seed: int = 42,
    max_iter: int = 100,
) -> DataFrame:
    """One logistic fit per training share against a fixed test set.

    The shares are nested and fitted together (``fit_logistic_shares``): a handful of passes over the
    training rows for all of them. All models are evaluated in one pass over the test set.
    """
    models = fit_logistic_shares(nested_shares(train, row_id, percents, seed), sorted(percents), max_iter=max_iter)
    cells = [
        F.struct(
            F.lit(p).alias("train_percentage"),
            F.lit(n).cast("long").alias("train_sentences"),
            (model.margin() > 0).cast("double").alias("prediction"),
        )
        for p, (model, n) in models.items()
    ]
    by = ["train_percentage", "train_sentences"]
    return _quality(confusion_counts(test.select("label", F.inline(F.array(*cells))), by, pred="prediction"), by)


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    row = [(model.coefficients.tolist(), float(model.intercept))]
    spark.createDataFrame(row, "coefficients array<double>, intercept double").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    row = spark.read.parquet(path).first()
    return LinearModel(np.array(row["coefficients"]), row["intercept"])
