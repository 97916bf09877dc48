"""Batch scoring with a pluggable text scorer.

A scorer is ``Callable[[list[str]], list[str]]`` made once per Python worker by a factory. Only the
text (and for batch-wide errors the batch's texts) crosses into Python; every other column stays in
the JVM. Scorers with side effects must be idempotent: Spark may run a task again.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import (
    DRY_RUN_REPLY,
    FAILED_REPLY,
    parse_label,
    render_prompt,
    strip_newlines,
)
from sheafline.session import scratch_dir, spread

Scorer = Callable[[list[str]], list[str]]
REPLY_TYPE = "struct<reply:string,error:string>"
DEFAULT_GAP_SECONDS = 0.1  # fixed value: pause between requests without a rate
STRICT_RATE = 10  # fixed value: below this many requests per minute one worker only
ROUND_BYTES = 32 << 20  # what one worker of a throttled run is sent in a round, about


def _reply_or_raise(scorer: Scorer, texts: list[str]) -> list[str]:
    replies = list(scorer(texts))
    if len(replies) != len(texts):
        raise ValueError(f"scorer returned {len(replies)} replies for {len(texts)} texts")
    return replies


def _one_by_one(scorer: Scorer, texts: list[str], pause: Callable[[], None]) -> list[tuple[str, str | None]]:
    out: list[tuple[str, str | None]] = []
    for text in texts:
        pause()
        try:
            out.append((_reply_or_raise(scorer, [text])[0], None))
        except Exception as exc:  # a failing row must not fail the job
            out.append((FAILED_REPLY, f"{type(exc).__name__}: {exc}"))
    return out


def _score_batch(scorer: Scorer, texts: list[str], on_error: str) -> list[tuple[str, str | None]]:
    try:
        return [(r, None) for r in _reply_or_raise(scorer, texts)]
    except Exception as exc:
        if on_error == "rows":
            return _one_by_one(scorer, texts, lambda: None)
        return [(FAILED_REPLY, f"{type(exc).__name__}: {exc}")] * len(texts)


def _pauser(gap: float) -> Callable[[], None]:
    last = [0.0]

    def pause() -> None:
        if gap > 0:
            wait = gap - (time.monotonic() - last[0])
            if wait > 0:
                time.sleep(wait)
            last[0] = time.monotonic()

    return pause


def reply_udf(factory: Callable[[], Scorer], batch_size: int = 10, gap: float | None = None):
    """Texts to ``struct(reply, error)``; null texts are rows outside the budget and stay null.

    Without ``gap`` the scorer sees slices of ``batch_size`` texts and a failing slice is retried
    row by row. With ``gap`` requests are single and at least that many seconds apart in a task.
    """

    @F.pandas_udf(REPLY_TYPE)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        pause = _pauser(gap or 0.0)
        for texts in parts:
            wanted = texts[texts.notna()]
            results: list[tuple[str, str | None]] = []
            values = wanted.tolist()
            if gap is not None:
                results = _one_by_one(scorer, values, pause)
            else:
                for at in range(0, len(values), batch_size):
                    results += _score_batch(scorer, values[at : at + batch_size], "rows")
            frame = pd.DataFrame(results, columns=["reply", "error"], index=wanted.index, dtype=object)
            yield frame.reindex(texts.index)

    # a filter on the reply must not score a row a second time
    return score.asNondeterministic()


def _attach(df: DataFrame, result: str) -> DataFrame:
    reply = F.col(f"{result}.reply")
    label = F.when(reply.isNotNull(), parse_label(reply))
    kept = [c for c in df.columns if c not in (result, "ai_label", "ai_reply", "error")]
    return df.select(*kept, label.alias("ai_label"), reply.alias("ai_reply"), F.col(f"{result}.error").alias("error"))


def score(
    df: DataFrame,
    factory: Callable[[], Scorer],
    batch_size: int = 10,
    text: str = "text",
    budget: str | None = None,
    prompt: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``ai_label, ai_reply, error``; a failed row has the reply ``0 Error``, hence label 0.

    ``budget`` names a BOOLEAN column; rows outside it get nulls. No shuffle, unless
    ``partitions`` asks for that many tasks. Write or ``materialize`` the result when it feeds several outputs, or the scorer runs for each of them.
    """
    df = spread(df, partitions)
    sent = strip_newlines(text) if prompt is None else prompt
    if budget:
        sent = F.when(F.col(budget), sent)
    return _attach(df.withColumn("_r", reply_udf(factory, batch_size)(sent)), "_r")


def score_in_batches(
    df: DataFrame,
    factory: Callable[[], Scorer],
    batch_size: int = 10,
    text: str = "text",
    on_error: str = "batch",
) -> DataFrame:
    """Scores exact batches of ``(sheet, row_idx div batch_size)``: one scorer call per batch.

    ``on_error="batch"`` gives every row of a failing batch the reply ``0 Error``; ``"rows"`` retries
    its rows one by one. Batches are arrays of at most ``batch_size`` rows, so no group grows with
    its sheet; one shuffle by batch.
    """
    if on_error not in ("batch", "rows"):
        raise ValueError("on_error is batch|rows")

    @F.pandas_udf(f"array<{REPLY_TYPE}>")
    def score_arrays(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = factory()
        for batches in parts:
            yield pd.Series(
                [
                    [{"reply": r, "error": e} for r, e in _score_batch(scorer, list(texts), on_error)]
                    for texts in batches
                ]
            )

    carried = [c for c in df.columns if c not in ("ai_label", "ai_reply", "error")]
    batch = F.floor(F.col("row_idx") / F.lit(batch_size)).alias("_batch")
    row = F.struct(F.col("row_idx").alias("_at"), *carried)
    grouped = df.groupBy("sheet", batch).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    sent = F.transform("_rows", lambda r: strip_newlines(r[text]))
    scored = grouped.withColumn("_replies", score_arrays.asNondeterministic()(sent))
    flat = scored.select(F.explode(F.arrays_zip("_rows", "_replies")).alias("_z"))
    return _attach(flat.select(*[F.col(f"_z._rows.{c}").alias(c) for c in carried], F.col("_z._replies").alias("_r")), "_r")


def throttle_plan(queries_per_minute: float | None, workers: int, default_gap: float = DEFAULT_GAP_SECONDS) -> tuple[int, float]:
    """Partitions and the gap within each, so that all of them together keep the rate."""
    if not queries_per_minute:
        return workers, default_gap * workers
    k = 1 if queries_per_minute < STRICT_RATE else max(1, workers)
    return k, 60.0 * k / queries_per_minute


def score_throttled(
    df: DataFrame,
    factory: Callable[[], Scorer],
    queries_per_minute: float | None,
    workers: int = 10,
    text: str = "text",
    default_gap: float = DEFAULT_GAP_SECONDS,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Scoring below a request rate shared by ``workers`` partitions.

    The rate itself bounds the requests, so few partitions at a time are the point here. What would send
    a partition more than ``round_bytes`` is written once, dealt into rounds of that size; they are scored
    one after the other and written, so a task's share does not grow with the table and never more than
    ``workers`` of them send requests. A table of one round is scored where the result is read. The
    partition count is fixed by ``repartition``; AQE does not merge it.
    """
    k, gap = throttle_plan(queries_per_minute, workers, default_gap)

    def scored(rows: DataFrame) -> DataFrame:
        return _attach(rows.repartition(k).withColumn("_r", reply_udf(factory, gap=gap)(strip_newlines(text))), "_r")

    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0).cast("long"))
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    rounds = math.ceil(total / (k * round_bytes))
    if rounds <= 1:
        return scored(df)
    # runs of neighbouring rows, a quarter of a round each: few files, whatever the partitions' sizes
    run = max(1, rows // (4 * rounds))
    at = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(run))
    dealt, done = scratch_dir(df.sparkSession), scratch_dir(df.sparkSession)
    numbered = df.withColumn("_round", F.pmod(F.spark_partition_id() + at, F.lit(rounds)).cast("int"))
    numbered.write.partitionBy("_round").parquet(dealt)
    parts = df.sparkSession.read.schema(numbered.schema).parquet(dealt)
    for i in range(rounds):
        if i:
            time.sleep(gap)  # a round's first requests come no sooner after the last ones than any other
        part = scored(parts.filter(F.col("_round") == i).select(*df.columns))
        part.write.mode("append").parquet(done)
    return df.sparkSession.read.schema(part.schema).parquet(done)


def dry_run(df: DataFrame, system: str, text: str = "text", budget: str = "in_budget") -> DataFrame:
    """The prompts that would be sent for the rows in budget; nothing is scored."""
    cleaned = strip_newlines(text)
    rows = df.filter(F.col(budget)) if budget in df.columns else df
    return rows.withColumns(
        {
            "system_prompt": F.lit(system),
            "user_text": cleaned,
            "prompt": render_prompt(cleaned, system, style="plain"),
            "ai_label": F.lit(0),
            "ai_reply": F.lit(DRY_RUN_REPLY),
        }
    )


def prompt_grid(df: DataFrame, prompts: dict[int, str], models: list[str] | None = None) -> DataFrame:
    """Every row once per catalogue prompt (and model): an array of constants, exploded in place."""
    cells = [F.struct(F.lit(no).alias("prompt_no"), F.lit(p).alias("system_prompt")) for no, p in prompts.items()]
    grid = df.select("*", F.inline(F.array(*cells)))
    if models:
        grid = grid.withColumn("model_source", F.explode(F.array(*map(F.lit, models))))
    return grid


def pick_model(df: DataFrame, registry: dict[str, str], provider: str = "provider", model: str = "model") -> DataFrame:
    """Explicit model, else the provider's default; an unknown provider is an error."""
    entries = [F.lit(x) for pair in registry.items() for x in pair]
    default = F.try_element_at(F.create_map(*entries), F.col(provider))
    unknown = F.raise_error(F.concat(F.lit("unsupported provider: "), F.coalesce(F.col(provider), F.lit("null"))))
    chosen = F.coalesce(F.nullif(F.col(model), F.lit("")), default)
    return df.withColumn("model", F.when(default.isNull(), unknown).otherwise(chosen))


def save_bucketed(df: DataFrame, table: str, buckets: int, keys: tuple[str, ...] = ("sheet", "row_idx")) -> None:
    """A table in buckets of its keys, sorted inside: two such tables with the same number of buckets
    are joined on the keys without a shuffle, however large they are."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def align_predictions(corpus: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("sheet", "row_idx")) -> DataFrame:
    """The corpus with an external table's ``prediction``; rows without one keep a null.

    The merge is asked for, because a table read from buckets has them already; nothing is broadcast.
    """
    return corpus.join(predictions.select(*keys, "prediction").hint("merge"), list(keys), "left")
