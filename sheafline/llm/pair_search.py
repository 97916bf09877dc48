"""Ranked lexical search with MaxScore over term pairs.

The documents are cut into blocks of bounded size, and each block gets an inverted index of its own:
one row per term with the documents that hold it and how often. Spark deals the blocks, so indexing
is one pass over the texts and searching a join on the block. N, L and df are counted over all blocks.

The terms of a query are paired, heaviest with next heaviest. For every pair of the queries and every
block a list is precomputed: the documents that hold both terms, and the largest sum of both impacts
among them. A document then gets at most ``max(joint maximum, larger single maximum)`` from a pair,
which is far below the sum of the single maxima where two rare terms do not meet at their peaks.

* Across blocks: the pair bounds of a query add up to a bound of the block. The block with the highest
  bound is searched first; its k-th score is a threshold, and blocks below it are left out.
* Inside a block: pairs whose bounds together stay below the threshold are not essential: a document
  that has only their terms cannot get in. Candidates come from the essential pairs. A candidate keeps
  its own bound for the rest: the joint maximum where it is in the intersection list, the larger single
  maximum where it is not; it is dropped as soon as its score so far and that bound miss the threshold.

Scores are 64-bit integers, a bound is dropped only if it is strictly below the threshold, so ties are
kept and the result is exact.

Nulls: a null text or a null query has no term and finds nothing; a document without an id is ranked
behind its ties, with a null id. Rows that repeat an id are ranked one by one. Rows that repeat an
item id are one query with the terms of all of them. Empty tables give an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sheafline.session import materialize

K = 50
BLOCK_BYTES = 8 << 20  # text of a block; one longer text is a block of its own
BLOCK_DOCS = 8192

# Fixed values of the scoring rule.
SCALE, SLOPE = 1_000_000_000, 1000
BASE, SHARE, PART = 50, 50, 20

#: Separators become spaces, capitals small letters; bytes from 0x80 on are parts of letters.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
NO_ID = np.iinfo(np.int64).max

INDEX_SCHEMA = "block long, term string, docs binary, counts binary"
LIST_SCHEMA = "block long, a string, b string, top long, joint long, bound long, docs binary, gains binary, both binary"
HIT_SCHEMA = "query long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


# ---- index ------------------------------------------------------------------------------------


def _index_block(block: int, ids: list, texts: list) -> pa.RecordBatch:
    """Posting lists of one block, and under the null term its ids and lengths."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    parts, lengths = [], np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        found = np.fromiter(map(number.__getitem__, terms_of(text)), np.int64)
        lengths[at] = len(found)
        parts.append(found * len(texts) + at)
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    docs = (keys % len(texts)).astype(np.int32)
    ends = np.searchsorted(keys, np.arange(len(number) + 1) * len(texts))
    names = [w.decode("utf-8") for w in number]  # numbers follow the order of insertion

    def lists(values: np.ndarray, last: np.ndarray) -> pa.Array:
        data = values.astype(np.int32).tobytes()
        offsets = np.append(ends * 4, len(data) + 8 * len(last)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data + last.astype(np.int64).tobytes())])

    own = np.array([NO_ID if i is None else i for i in ids], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(names) + 1, block), pa.int64()),
            pa.array([*names, None], pa.string()),
            lists(docs, own),
            lists(counts, lengths),
        ],
        ["block", "term", "docs", "counts"],
    )


def build_index(docs: DataFrame) -> DataFrame:
    """One row per block and term, written to the shared folder; the null term holds ids and lengths."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield _index_block(block, ids, texts)
                    ids, texts, size, block = [], [], 0, block + 1
        if ids:
            yield _index_block(block, ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(cut, INDEX_SCHEMA))


# ---- queries ----------------------------------------------------------------------------------


def split_queries(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """query, item_id, term: the distinct terms of every item, with a number for the item."""

    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({w.decode("utf-8", "replace") for w in terms_of(t)}) for t in texts], index=texts.index)

    rows = items.select(F.col(item_id).alias("item_id"), F.explode(distinct_terms(F.col(text).cast("string"))).alias("term"))
    rows = materialize(rows.distinct())
    numbers = rows.select(F.col("item_id").alias("_item")).distinct().withColumn("query", F.monotonically_increasing_id())
    return materialize(rows.join(materialize(numbers), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item"))


def weigh(index: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """term, weight of all terms that the queries and the documents have, and N and L."""
    frames = index.filter("term is null")

    @F.pandas_udf("struct<n:long,l:long>")
    def sums(lengths: pd.Series) -> pd.DataFrame:
        arrays = [np.frombuffer(x, np.int64) for x in lengths]
        return pd.DataFrame({"n": [int((a > 0).sum()) for a in arrays], "l": [int(a.sum()) for a in arrays]})

    total = frames.select(sums("counts").alias("s")).agg(F.sum("s.n").alias("n"), F.sum("s.l").alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0
    terms = asked.select("term").distinct()
    used = index.filter("term is not null").select("term", (F.octet_length("docs") / 4).cast("long").alias("df"))
    df = used.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    return materialize(df.select("term", weight.alias("weight")).filter("weight > 0")), n, length


def pair_terms(asked: DataFrame, weights: DataFrame) -> DataFrame:
    """query, a, b: the heaviest term with the next, and so on; an odd one has no b."""
    terms = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
    rows = asked.join(weights, "term").groupBy("query").agg(terms.alias("t"))
    first = F.explode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(2)))
    rows = rows.select("query", "t", first.alias("k"))
    a, b = F.get("t", F.col("k")), F.get("t", F.col("k") + 1)
    return materialize(rows.select("query", a["term"].alias("a"), b["term"].alias("b")))


# ---- pair lists -------------------------------------------------------------------------------


def pair_lists(index: DataFrame, pairs: DataFrame, weights: DataFrame, n: int, length: int) -> DataFrame:
    """The precomputed lists of every block.

    A term's row (no ``b``) holds its documents and their gains, a pair's row the joint maximum and
    the intersection as one bit a document.
    """
    postings = index.join(weights, "term").select("block", "term", "docs", "counts", "weight")
    present = postings.select("block", "term")
    asked = pairs.filter("b is not null").select("a", "b").distinct()
    met = present.join(asked, F.col("term") == F.col("a")).select("block", "a", "b")
    met = met.unionByName(present.join(asked, F.col("term") == F.col("b")).select("block", "a", "b")).distinct()
    frames = index.filter("term is null").select("block", "term", "docs", "counts", F.lit(None).cast("long").alias("weight"))

    def of_block(key: tuple, rows: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        own = rows["term"].isna()
        long = np.frombuffer(rows.loc[own, "counts"].iloc[0], np.int64)
        m = 100 - BASE + SHARE * long * n // max(length, 1)
        gains: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for term, docs, counts, weight in zip(*(rows.loc[~own, c] for c in ("term", "docs", "counts", "weight"))):
            docs, tf = np.frombuffer(docs, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
            gains[term] = docs, int(weight) * (SCALE * tf // (SLOPE * tf + PART * m[docs]))
            top = int(gains[term][1].max())
            out.append((key[0], term, None, top, top, top, docs.tobytes(), gains[term][1].tobytes(), None))
        nothing = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for a, b in zip(met["a"], met["b"]):
            (da, ga), (db, gb) = gains.get(a, nothing), gains.get(b, nothing)
            both, at_a, at_b = np.intersect1d(da, db, assume_unique=True, return_indices=True)
            top = int(max(ga.max(initial=0), gb.max(initial=0)))
            joint = int((ga[at_a] + gb[at_b]).max(initial=0))
            bits = np.zeros(len(long), bool)
            bits[both] = True
            out.append((key[0], a, b, top, joint, max(top, joint), None, None, np.packbits(bits).tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LIST_SCHEMA.split(", ")])

    met = met.withColumnRenamed("block", "at")
    rows = postings.unionByName(frames).groupBy("block").cogroup(met.groupBy("at"))
    return materialize(rows.applyInPandas(of_block, LIST_SCHEMA))


# ---- search -----------------------------------------------------------------------------------


def best_in_block(terms: dict, meets: dict, chosen: list, ids: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best documents of a block with a score of at least ``least`` (and 1).

    ``chosen`` are the query's pairs, ``terms[a]`` is (documents, gains, maximum), ``meets[a, b]``
    (joint maximum, bits of the intersection).
    """
    least = max(least, 1)
    mine = []
    for a, b in chosen:
        lists = [terms[t] for t in (a, b) if t in terms]
        if lists:
            top = max(x[2] for x in lists)
            joint, both = meets.get((a, b), (0, None))
            mine.append((max(top, joint), top, max(top, joint), lists, both))
    mine.sort(key=lambda x: x[0])
    skipped = int(np.searchsorted(np.cumsum([x[0] for x in mine]), least, side="left"))  # sums below the threshold
    score = np.zeros(len(ids), np.int64)
    for *_, lists, _ in mine[skipped:]:
        for docs, gains, _ in lists:
            score[docs] += gains
    rest = np.zeros(len(ids), np.int64)

    def ahead(top: int, joint: int, both: bytes | None) -> np.ndarray | int:
        if both is None or joint == top:
            return top
        return np.where(np.unpackbits(np.frombuffer(both, np.uint8), count=len(ids)), joint, top)

    for _, top, joint, _, both in mine[:skipped]:
        rest += ahead(top, joint, both)
    alive = np.flatnonzero((score > 0) & (score + rest >= least))
    for _, top, joint, lists, both in reversed(mine[:skipped]):
        if not len(alive):
            break
        rest -= ahead(top, joint, both)
        for docs, gains, _ in lists:
            at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            score[alive] += np.where(docs[at] == alive, gains[at], 0)
        alive = alive[score[alive] + rest[alive] >= least]
    alive = alive[score[alive] >= least]
    alive = alive[np.lexsort((ids[alive], -score[alive]))[:k]]
    return ids[alive], score[alive]


def _searched(index: DataFrame, lists: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Hits of ``visits``: query, block, least, pairs (array of a, b)."""

    def of_block(key: tuple, lists: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query": [], "doc_id": [], "score": []})]
        framed = lists["a"].isna()
        ids = np.frombuffer(lists.loc[framed, "docs"].iloc[0], np.int64)
        single = ~framed & lists["b"].isna()
        terms = {
            a: (np.frombuffer(docs, np.int32), np.frombuffer(gains, np.int64), int(top))
            for a, docs, gains, top in zip(*(lists.loc[single, c] for c in ("a", "docs", "gains", "top")))
        }
        double = lists["b"].notna()
        meets = {
            (a, b): (int(joint), both)
            for a, b, joint, both in zip(*(lists.loc[double, c] for c in ("a", "b", "joint", "both")))
        }
        for v in visits.itertuples():
            chosen = [(p["a"], p["b"]) for p in v.pairs]
            found, scores = best_in_block(terms, meets, chosen, ids, int(v.least), k)
            own = pd.array(found, dtype="Int64")
            own[found == NO_ID] = pd.NA
            parts.append(pd.DataFrame({"query": v.query, "doc_id": own, "score": scores}))
        return pd.concat(parts[1:] or parts)

    used = visits.select("block").distinct()
    ids = index.filter("term is null").select("block", "docs")
    rows = lists.unionByName(ids, allowMissingColumns=True).join(used, "block", "left_semi")
    return rows.groupBy("block").cogroup(visits.withColumnRenamed("block", "at").groupBy("at")).applyInPandas(of_block, HIT_SCHEMA)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every row of ``items``."""
    index = build_index(docs)
    asked = split_queries(items)
    weights, n, length = weigh(index, asked)
    pairs = pair_terms(asked, weights)
    lists = pair_lists(index, pairs, weights, n, length)

    wanted = pairs.groupBy("query").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    bounds = lists.select("block", "a", "b", "bound").alias("l").join(
        pairs.alias("p"), (F.col("l.a") == F.col("p.a")) & F.col("l.b").eqNullSafe(F.col("p.b"))
    )
    bounds = materialize(bounds.groupBy("query", "block").agg(F.sum("bound").alias("bound")).filter("bound > 0"))
    first = bounds.groupBy("query").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    seeds = first.join(wanted, "query").select("query", "block", F.lit(0).cast("long").alias("least"), "pairs")
    found = materialize(_searched(index, lists, seeds, k))
    least = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0).alias("least"))
    others = bounds.join(first.withColumnRenamed("block", "_first"), "query").join(least, "query", "left")
    others = others.withColumn("least", F.coalesce("least", F.lit(0))).filter("block <> _first and bound >= least")
    visits = others.join(wanted, "query").select("query", "block", "least", "pairs")
    hits = found.unionByName(_searched(index, lists, visits, k))
    names = asked.select("query", "item_id").distinct()
    return _best(hits, k).join(names, "query").select("item_id", "rank", "doc_id", "score")
