"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation maximisation estimates
their accuracies and the share of good documents from the counts of vote patterns alone, of which
there are at most 3 ** labellers, however many documents vote. The posterior of a document's votes is
its soft label, and a linear model over hashed byte n-grams of the text learns it from a bounded
sample; the model, which sees the whole text and no votes, judges all documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import materialize, ship_package

GOOD, BAD, NOTHING = 1, -1, 0
#: Documents the linear model is fitted on: those with the smallest id hashes.
SAMPLE = 3000
DIMS = 1 << 12
WIDTH = DIMS + 2
GRAMS = (1, 2, 3)
#: Documents with a lower probability are rejected.
LEAST_GOOD = 0.5


def votes(text: str) -> list[int]:
    """The labellers' votes on a text. They overlap, and every one can err.

    A labeller that looks for one fault has no opinion on texts without it; two look for prose.
    """
    words = text.split()
    n = len(words)
    if not n:
        return [BAD] + [NOTHING] * (LABELLERS - 1)
    symbols = sum(text.count(c) for c in "#*$%&|<>{}")
    letters = sum(map(str.isalpha, text))
    capitals = sum(map(str.isupper, text))
    chars = sum(map(len, words))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    plain = sum(w[-1].isalpha() or w[-1] in ".,;:?'\"”»)" for w in words)
    stops = sum(w[-1] in ".,;:?" for w in words)

    def bad(fault: bool) -> int:
        return BAD if fault else NOTHING

    return [
        bad(symbols >= 0.3 * n),
        bad(text.count("!") >= 0.5 * n),
        bad(letters >= 20 and capitals >= 0.45 * letters),
        bad(n >= 10 and runs >= 0.3 * n),
        bad(30 <= n and distinct <= 0.25 * min(n, 1000)),
        bad(len(lines) >= 4 and len(set(lines)) <= 0.4 * len(lines)),
        bad(letters <= 0.75 * chars),
        bad(plain <= 0.65 * n),
        GOOD if n >= 20 and 0.01 * n <= stops <= 0.5 * n and plain >= 0.95 * n else NOTHING,
        GOOD if letters >= 0.9 * chars and capitals <= 0.1 * letters and runs <= 0.05 * n else NOTHING,
    ]


LABELLERS = 10


@dataclass
class LabelModel:
    """Per labeller and true class the chances of the votes -1, 0, 1, and the share of good ones."""

    chances: np.ndarray  # [labeller, class (bad, good), vote + 1]
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of being good per row of votes."""
        logs = np.log(np.array([1 - self.prior, self.prior]))[None, :]
        for k in range(patterns.shape[1]):
            logs = logs + np.log(self.chances[k][:, patterns[:, k] + 1]).T
        top = logs.max(axis=1, keepdims=True)
        each = np.exp(logs - top)
        return each[:, 1] / each.sum(axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation maximisation on distinct vote patterns and their counts.

    Starts from the majority of votes, so "good" keeps its meaning; votes are smoothed by one
    document each. Ends when no chance moves by 1e-7.
    """
    total = np.maximum(counts.sum(), 1)
    good = 1 / (1 + np.exp(-patterns.sum(axis=1) * 1.0))
    model = LabelModel(np.full((patterns.shape[1], 2, 3), 1 / 3), 0.5)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        chances = np.empty_like(model.chances)
        for k in range(patterns.shape[1]):
            for vote in (-1, 0, 1):
                chances[k, :, vote + 1] = weight[:, patterns[:, k] == vote].sum(axis=1) + 1
        chances /= chances.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 1) / (total + 2), 1e-6, 1 - 1e-6))
        moved = np.abs(chances - model.chances).max()
        model = LabelModel(chances, prior)
        good = model.posterior(patterns)
        if moved < 1e-7:
            break
    return model


def _fold() -> np.ndarray:
    """Bytes whose kind, not identity, matters for quality: letters, capitals, digits, blanks."""
    table = np.arange(256, dtype=np.uint32)
    table[ord("0") : ord("9") + 1] = ord("0")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("a") : ord("z") + 1] = ord("a")
    table[128:] = ord("a")
    return table


_TABLE = _fold()


#: Bytes at which a text's features have half their weight: short texts stay near the average.
HALF = 150


def features(text: str) -> np.ndarray:
    """Shares of the hashed n-grams of a text's folded bytes, of words that equal the one before them
    and of repeated words; all shrink towards 0 for short texts."""
    raw = _TABLE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    out = np.zeros(WIDTH)
    for size in GRAMS:
        if len(raw) >= size:
            gram = np.full(len(raw) - size + 1, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(size):
                gram = (gram ^ raw[k : len(raw) - size + 1 + k]) * np.uint32(0x01000193)
            gram ^= gram >> np.uint32(15)
            out[:DIMS] += np.bincount(gram % DIMS, minlength=DIMS) / len(gram)
    words = text.split()
    if words:
        out[DIMS] = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        out[DIMS + 1] = 1 - len(set(words)) / len(words)
    return out * (len(raw) / (len(raw) + HALF))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def good(self, text: str) -> float:
        """Chance that a text is good; texts without words have none."""
        if not text.split():
            return 0.0
        return float(1 / (1 + np.exp(-(features(text) @ self.weights + self.bias))))


def fit_scorer(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, rounds: int = 300) -> Scorer:
    """Logistic regression on soft labels by accelerated gradient descent from zero."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    scale = (weight / max(weight.sum(), 1e-12)).astype(np.float32)
    step = np.float32(4.0 / (float((x * x).sum(axis=1).max(initial=1.0)) + 1.0))
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    aw, ab = w, b
    for k in range(1, rounds + 1):
        miss = scale * (1 / (1 + np.exp(-(x @ aw + ab))) - y)
        nw, nb = aw - step * (x.T @ miss + np.float32(penalty) * aw), ab - step * miss.sum()
        aw, ab = nw + np.float32((k - 1) / (k + 2)) * (nw - w), nb + np.float32((k - 1) / (k + 2)) * (nb - b)
        w, b = nw, nb
    return Scorer(w.astype(np.float64), float(b))


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            each = [votes(t.as_py() or "") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(each, pa.list_(pa.int8()))], names=["hash", "votes"]
            )


def fit(documents: DataFrame, sample: int = SAMPLE, text: str = "text") -> tuple[LabelModel, Scorer]:
    """The two models. All documents vote; at most ``sample`` texts (those with the smallest hash of
    id and text; ties are left out) are turned into features, in tasks, and their posteriors are the
    labels."""
    ship_package(documents.sparkSession)
    hashed = documents.select(F.xxhash64("doc_id", text).alias("hash"), F.col(text).alias("text"))
    voted = materialize(hashed.mapInArrow(_voting, "hash long, votes array<byte>"))
    # at most 3 ** LABELLERS rows
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in counted], np.int64).reshape(-1, LABELLERS)
    labels = fit_labels(patterns, np.array([r["n"] for r in counted], np.float64))
    edge = hashed.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).head()[0]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text_ = batch.column(1)[k].as_py() or ""
                x = features(text_).astype(np.float32)
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, 1),
                        pa.array([votes(text_)], pa.list_(pa.int8())),
                        pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([x[at]], pa.list_(pa.float32())),
                    ],
                    names=["hash", "votes", "at", "x"],
                )

    if edge is None:
        return labels, Scorer(np.zeros(WIDTH), 0.0)
    chosen = hashed.filter(F.col("hash") <= edge).dropDuplicates(["hash"]).mapInArrow(
        sampled, "hash long, votes array<byte>, at array<int>, x array<float>"
    )
    rows = chosen.orderBy("hash").toPandas()  # bounded by ``sample`` rows of DIMS numbers
    x = np.zeros((len(rows), WIDTH), np.float32)
    for k, (at, value) in enumerate(zip(rows["at"], rows["x"])):
        x[k, at] = value
    y = labels.posterior(np.array(rows["votes"].tolist(), np.int64).reshape(-1, LABELLERS))
    return labels, fit_scorer(x, y, np.ones(len(rows)))


def classified(documents: DataFrame, text: str = "text", least: float = LEAST_GOOD, **options) -> DataFrame:
    """``documents`` with ``_good`` (chance of being good) and ``_kept`` (at least ``least``).

    Null, empty and blank texts have the chance 0. Rows may repeat; ids may be null. The input may
    not have columns of these two names. An empty table gives an empty result.
    """
    if taken := {"_good", "_kept"} & set(documents.columns):
        raise ValueError(f"columns {sorted(taken)} clash with the result")
    _, scorer = fit(documents, text=text, **options)

    @F.pandas_udf("double")
    def good(texts):
        return texts.map(lambda t: scorer.good(t or ""), na_action=None).astype("float64")

    scored = documents.withColumn("_good", good.asNondeterministic()(F.col(text)))
    return scored.withColumn("_kept", F.col("_good") >= F.lit(least))
