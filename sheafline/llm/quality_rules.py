"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a number per document that is high in bad text. A labelled holdout decides, per stratum,
how low the rule's cutoff may be: a cutoff stands if an exact binomial test shows that it rejects at
most ``risk`` of the good documents. The tests of a rule are taken from the most lenient cutoff
downwards and end at the first failure (fixed-sequence testing), and the level is divided among
strata and rules (Bonferroni), so with probability ``1 - level`` every cutoff keeps its promise; the
risks of the rules add up to ``risk``. A stratum has only cutoffs that its own test certifies: with too
few labels, or none, it has no cutoff, and only the base conditions reject there. The option
``pooled_below`` lends small strata the cutoffs of all documents together, which promises nothing for
the small stratum itself: the query op10 uses it, as its SQL does, the pipeline does not.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.words import WHITE, WORD
from sheafline.session import materialize

SYMBOLS = "#*$%&|<>"

#: Rule -> candidate cutoffs, lenient to strict. Fixed before any label is seen.
GRIDS: Mapping[str, Sequence[float]] = {
    "symbols_per_word": (3.0, 2.5, 2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "shouts_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3),
    "capitals_per_letter": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeats_per_word": (0.5, 0.45, 0.4, 0.35, 0.3),
    "duplicate_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
}
#: With five rules and five strata, no rejection among 320 good documents proves a risk of 0.02: a size
#: for ``pooled_below``.
RISK, LEVEL, MIN_GOOD = 0.10, 0.05, 320


def _without(text: Column, characters: str, put: str = "") -> Column:
    """Plain replacements, character by character: several times faster than one translate()."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def _parts(text: Column) -> dict[str, Column]:
    """The text without white space, its lines with a word, and its words."""
    text = F.coalesce(text, F.lit(""))
    # one blank for every white-space character, so a plain split does; the empty strings go
    return {
        "dense": _without(text, WHITE),
        "lines": F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(_without(x, WHITE[1:], " "))) > 0),
        "words": F.array_remove(F.split(_without(text, WHITE[1:], " "), " ", -1), ""),
    }


def _counts(dense: Column, lines: Column) -> dict[str, Column]:
    n = F.length(dense)
    return {
        "word_chars": n.cast("long"),
        "n_symbols": (n - F.length(_without(dense, SYMBOLS))).cast("long"),
        "n_shouts": (n - F.length(_without(dense, "!?"))).cast("long"),
        "n_capitals": F.length(F.regexp_replace(dense, r"\P{Lu}+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _sorted_windows(hashes: Column) -> Column:
    """(hash, position) of all windows in the order of the hash; empty if no hash occurs twice."""
    placed = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), nothing).otherwise(F.sort_array(placed))


def _repeat_words(words: Column, placed: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Equal windows are neighbours in ``placed``; the words themselves are compared, so only a text in
    which two different windows share a 64-bit hash could be counted too low.
    """

    def same(a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(3):
            equal = equal & (F.get(words, a["i"] + k) == F.get(words, b["i"] + k))
        return equal

    after = F.slice(placed, F.lit(2), F.size(placed))
    pairs = F.filter(F.arrays_zip(placed.alias("a"), after.alias("b")), lambda p: same(p["a"], p["b"]))
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )


def _with_rules(df: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``df`` with the counts and the rules' numbers in columns that start with ``prefix``.

    Null and empty texts have no words; every number is 0 for them. The result must be written
    before it is filtered: a filter pushed below these projections would compute them per element.
    """
    if taken := [c for c in df.columns if c.startswith(prefix)]:
        raise ValueError(f"columns {taken} clash with the prefix {prefix!r}")
    col = lambda c: F.col(prefix + c)
    first = df.withColumns({prefix + k: c for k, c in _parts(F.col(text)).items()})
    w, n = col("words"), F.size(col("words"))
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    second = first.withColumns(
        {prefix + k: c for k, c in _counts(col("dense"), col("lines")).items()}
        | {f"{prefix}hashes": F.transform(starts, window)}
    )
    third = (
        second.withColumn(f"{prefix}placed", _sorted_windows(F.col(f"{prefix}hashes")))
        .withColumn(f"{prefix}n_repeat_words", _repeat_words(w, F.col(f"{prefix}placed")))
        .withColumn(f"{prefix}n_words", n.cast("long"))
    )
    count = lambda c: F.col(prefix + c).cast("double")
    per_word = F.greatest(count("n_words"), F.lit(1.0))
    numbers = {
        "symbols_per_word": count("n_symbols") / per_word,
        "shouts_per_word": count("n_shouts") / per_word,
        "capitals_per_letter": count("n_capitals") / F.greatest(count("word_chars"), F.lit(1.0)),
        "repeats_per_word": count("n_repeat_words") / per_word,
        "duplicate_lines": count("n_dup_lines") / F.greatest(count("n_lines"), F.lit(1.0)),
    }
    failed = (F.col(f"{prefix}n_words") < 50) | (
        100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words")
    )
    return third.drop(*(prefix + c for c in ("dense", "lines", "words", "hashes", "placed"))).withColumns(
        {**{prefix + k: v for k, v in numbers.items()}, f"{prefix}base_failed": failed}
    )


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series from 10 on (error below 1e-10), exact values below."""
    table = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(10)))
    x = n.cast("double") + 1
    series = (
        (x - 0.5) * F.ln(x)
        - x
        + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x)
        - 1 / (360 * x * x * x)
        + 1 / (1260 * x * x * x * x * x)
    )
    return F.when(n < 10, F.get(table, n.cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p (1 otherwise), summed downwards from k.

    Downwards the terms fall at least geometrically. 40 standard deviations are summed and what is
    left is bounded by the geometric series of the last ratio, so the result is never too small.
    """
    odds = (1 - p) / p
    top = (
        log_factorial(n)
        - log_factorial(k)
        - log_factorial(n - k)
        + k.cast("double") * math.log(p)
        + (n - k).cast("double") * math.log(1 - p)
    )
    steps = F.least(k, F.ceil(F.lit(40.0) * F.sqrt(n.cast("double") * p * (1 - p)) + 60)).cast("int")
    nd, kd = n.cast("double"), k.cast("double")
    ratio = lambda i: (kd - i) / (nd - kd + i + 1) * odds
    summed = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * ratio(i.cast("double"))).alias("term"),
            (s["sum"] + s["term"] * ratio(i.cast("double"))).alias("sum"),
        ),
        lambda s: F.when(
            steps < k,
            s["sum"] + s["term"] * ratio(steps.cast("double")) / (1 - ratio(steps.cast("double"))),
        ).otherwise(s["sum"]),
    )
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(top) * summed)


def risk_cutoffs(
    ruled: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    prefix: str = "_q_",
    grids: Mapping[str, Sequence[float]] = GRIDS,
    risk: float = RISK,
    level: float = LEVEL,
    pooled_below: int | None = None,
) -> DataFrame:
    """stratum, n_good, one cutoff per rule (null: the rule rejects nothing in that stratum).

    ``ruled`` has the numbers of :func:`judged`; ``labels`` has ``doc_id`` and ``quality``, 1 for good.
    The holdout is the good documents that the base conditions let pass. Labels that are null or
    repeat an id with different values count as not good. The result also has the stratum null of
    documents without one. A stratum without good documents has no row. With ``pooled_below``, one row
    marked ``is_default`` has the cutoffs of all strata together, and strata with fewer good documents
    than that have no row of their own: theirs are not certified by their own documents. Only counts
    are shuffled: per stratum and per number of cutoffs passed.
    """
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("_good"))
    held = ruled.filter(~F.col(f"{prefix}base_failed")).join(good.filter("_good = 1"), "doc_id")

    def passed(rule: str) -> Column:
        """How many cutoffs of the grid reject the document: the last ones, as the grid falls."""
        out = F.lit(0)
        for cut in grids[rule]:
            out = out + (F.col(prefix + rule) > F.lit(float(cut))).cast("int")
        return out

    groups = [F.struct(F.lit(False).alias("is_default"), F.col(stratum).alias("stratum"))]
    if pooled_below is not None:
        nothing = F.lit(None).cast(ruled.schema[stratum].dataType)
        groups.append(F.struct(F.lit(True).alias("is_default"), nothing.alias("stratum")))
    each = held.select(
        F.explode(F.array(*groups)).alias("g"),
        *(passed(r).alias(r) for r in grids),
    )
    rejected = [
        F.sum((F.col(r) >= F.lit(len(grid) - k)).cast("long")).alias(f"{r}#{k}") for r, grid in grids.items() for k in range(len(grid))
    ]
    counts = materialize(each.groupBy("g").agg(F.count("*").alias("n_good"), *rejected))
    strata = F.count("*").over(Window.partitionBy())
    tests = [
        F.struct(F.lit(r).alias("rule"), F.lit(k).alias("step"), F.lit(float(cut)).alias("cut"), F.col(f"`{r}#{k}`").alias("lost"))
        for r, grid in grids.items()
        for k, cut in enumerate(grid)
    ]
    allowed = F.lit(level) / (strata * F.lit(len(grids)))
    counts = counts.withColumn("allowed", allowed)  # before the rows are multiplied
    cells = counts.select("g", "n_good", "allowed", F.explode(F.array(*tests)).alias("t")).select(
        "g", "n_good", "allowed", "t.*"
    )
    tail = binomial_tail(F.col("n_good"), F.col("lost"), risk / len(grids))
    cells = materialize(cells.withColumn("fails", tail > F.col("allowed")))
    # the strictest cutoff before a rule's first failure
    first = F.min(F.when(F.col("fails"), F.col("step"))).over(Window.partitionBy("g", "rule"))
    stands = F.col("first").isNull() | (F.col("step") < F.col("first"))
    return (
        cells.withColumn("first", first)
        .groupBy("g", "n_good")
        .pivot("rule", list(grids))
        .agg(F.min(F.when(stands, F.col("cut"))))
        .filter(F.col("g.is_default") | (F.col("n_good") >= (pooled_below or 0)))
        .select("g.*", "n_good", *grids)
    )


def judged(
    df: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    text: str = "text",
    prefix: str = "_q_",
    grids: Mapping[str, Sequence[float]] = GRIDS,
    carry: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """The columns ``carry`` of ``df`` (default: all), the rules' numbers and ``<prefix>kept``.

    The numbers are n_words, word_chars, n_symbols, n_shouts, n_capitals, n_lines, n_dup_lines,
    n_repeat_words, base_failed and one per rule, all named with ``prefix``, which no input column
    may start with. A document is kept if the base conditions let it pass and no rule's number is
    above its stratum's cutoff. Texts are read once: the numbers are written with the carried
    columns, the cutoffs come from what was written. ``carry`` must hold ``doc_id`` and the stratum.
    Null and empty texts have no words and fail the base conditions. Cutoffs are one row per
    stratum, joined by their written size. An empty table gives an empty result.
    """
    ruled = _with_rules(df, text, prefix)
    own_columns = [c for c in ruled.columns if c.startswith(prefix)]
    ruled = materialize(ruled.select(*(carry or df.columns), *own_columns))
    cuts = materialize(risk_cutoffs(ruled, labels, stratum, prefix, grids, **options))
    return _judge(ruled, cuts, stratum, prefix, grids)


def _judge(ruled: DataFrame, cuts: DataFrame, stratum: str, prefix: str, grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """``ruled`` and ``<prefix>kept``, by the cutoffs of the row's stratum (one small row each)."""
    own = cuts.filter("not is_default").select(
        F.col("stratum").alias(f"{prefix}stratum"),
        F.lit(True).alias(f"{prefix}has"),
        *(F.col(r).alias(f"{prefix}own_{r}") for r in grids),
    )
    # without pooled cutoffs one row of nulls
    rest = cuts.filter("is_default").agg(*(F.first(r).alias(f"{prefix}all_{r}") for r in grids))
    joined = ruled.join(own, F.col(stratum).eqNullSafe(F.col(f"{prefix}stratum")), "left").join(rest)
    above = F.lit(False)
    for r in grids:
        cut = F.when(F.col(f"{prefix}has"), F.col(f"{prefix}own_{r}")).otherwise(F.col(f"{prefix}all_{r}"))
        above = above | F.coalesce(F.col(prefix + r) > cut, F.lit(False))
    return joined.select(*ruled.columns, (~(F.col(f"{prefix}base_failed") | above)).alias(f"{prefix}kept"))


def kept_documents(
    df: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    text: str = "text",
    prefix: str = "_q_",
    grids: Mapping[str, Sequence[float]] = GRIDS,
    **options,
) -> DataFrame:
    """The rows of ``df``, all columns, that :func:`judged` keeps.

    Two passes over the texts and no join of texts: the first writes the rules' numbers, from which
    the cutoffs come; the second judges every row where it is read. Repeated rows and ids are judged
    row by row; null texts are rejected; an empty table stays empty. No column may start with ``prefix``.
    """
    numbers = _with_rules(df.select("doc_id", stratum, text), text, prefix).drop(text)
    cuts = materialize(risk_cutoffs(materialize(numbers), labels, stratum, prefix, grids, **options))
    # a filter is not pushed below a column that is not deterministic: the rules stay computed once a row
    ruled = _with_rules(df, text, prefix).withColumn(f"{prefix}row", F.monotonically_increasing_id())
    return _judge(ruled, cuts, stratum, prefix, grids).filter(F.col(f"{prefix}kept") & (F.col(f"{prefix}row") >= 0)).select(*df.columns)
