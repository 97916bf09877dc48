"""Approximate nearest neighbours by a hash-prefix forest.

A tree is the sorted array of the rows' long bit strings (signs of random projections), so a prefix
is a range of it. A query descends in every tree to the longest prefix that any row shares, and then
all trees ascend together, one bit at a time, until their ranges hold enough candidates; these are
ranked by the exact cosine.

Rows are dealt into blocks by id, each with a forest of its own; queries into blocks, too. A pair of
blocks is one task: it builds the forest of its rows (a few matrix products and sorts), searches it
for its queries and returns the nearest few of each. Every row is indexed in every block pair it
belongs to. How far to ascend is a share of the block's rows, so recall is the same at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import ship_package

TREES, BITS = 64, 20
#: The trees ascend until they hold this many candidates per row of the block, repeats counted, and
#: two more than asked for in the mean of the trees.
CANDIDATES = 0.7
ROWS, QUERIES = 16384, 4096  # of a block
NEAREST = 5
SEED = 20240607


def directions(dims: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """The same random projections in every task."""
    return np.random.default_rng(SEED).standard_normal((dims, trees * bits))


def codes(vectors: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """[tree, row] bit strings as integers, first bit highest."""
    signs = (vectors @ planes > 0).reshape(len(vectors), trees, bits)
    return (signs.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2).T


def candidates(tree_codes: np.ndarray, query_codes: np.ndarray, bits: int, least: float) -> list[np.ndarray]:
    """Candidate rows of each query: [tree, row] and [tree, query] codes.

    ``depth`` falls for all trees at once until their ranges hold ``least`` rows or depth 0, at
    which every row is one.
    """
    trees, n = tree_codes.shape
    order = np.argsort(tree_codes, axis=1, kind="stable")
    arrays = np.take_along_axis(tree_codes, order, axis=1)
    n_queries = query_codes.shape[1]
    low = np.zeros((trees, n_queries), np.int64)
    high = np.full((trees, n_queries), n, np.int64)
    waiting = np.ones(n_queries, bool)
    for depth in range(bits, -1, -1):
        ask = np.flatnonzero(waiting)
        if not len(ask):
            break
        shift = bits - depth
        for t in range(trees):
            prefix = query_codes[t, ask] >> shift
            low[t, ask] = np.searchsorted(arrays[t], prefix << shift, "left")
            high[t, ask] = np.searchsorted(arrays[t], (prefix + 1) << shift, "left")
        waiting[ask] = (high[:, ask] - low[:, ask]).sum(axis=0) < least
    out = []
    seen = np.zeros(n, bool)
    for q in range(n_queries):
        seen[:] = False
        for t in range(trees):
            seen[order[t, low[t, q] : high[t, q]]] = True
        out.append(np.flatnonzero(seen))
    return out


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; a row's value does not depend on the other rows."""
    dots = (rows * query).sum(axis=1)
    return dots / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _searcher(nearest: int, trees: int, bits: int, share: float):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if rows.num_rows and queries.num_rows:
            ids, vectors = rows.column("vec_id").to_numpy(), _vectors(rows.column("vector"))
            asked, wanted = queries.column("query_id").to_numpy(), _vectors(queries.column("vector"))
            # equal vectors are one entry of the forest, so a common vector does not fill the ranges
            distinct, entry = np.unique(vectors, axis=0, return_inverse=True)
            order = np.lexsort((ids, entry))
            ids = ids[order]
            first = np.searchsorted(entry[order], np.arange(len(distinct) + 1))
            planes = directions(vectors.shape[1], trees, bits)
            near = candidates(
                codes(distinct, planes, trees, bits),
                codes(wanted, planes, trees, bits),
                bits,
                max(share * len(distinct), trees * (nearest + 2)),
            )
            length = np.sqrt((distinct * distinct).sum(axis=1))
            for q, rows_ in enumerate(near):
                rough = distinct[rows_] @ wanted[q] / length[rows_]
                if len(rows_) > nearest:  # one more, as the query itself may be among them
                    edge = np.partition(rough, -(nearest + 1))[-(nearest + 1)]
                    rows_ = rows_[rough >= edge - 1e-9 * np.abs(wanted[q]).max()]
                score = cosine(distinct[rows_], wanted[q])
                mine = [
                    (-s, int(i))
                    for e, s in zip(rows_, score)
                    for i in ids[first[e] : min(first[e + 1], first[e] + nearest + 1)]
                    if i != asked[q]
                ]
                found.extend((int(asked[q]), i, -s) for s, i in sorted(mine)[:nearest])
        return pa.table(
            {
                "query_id": pa.array([x[0] for x in found], pa.int64()),
                "vec_id": pa.array([x[1] for x in found], pa.int64()),
                "score": pa.array([x[2] for x in found], pa.float64()),
            }
        )

    return search


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    vector: str = "embedding",
    nearest: int = NEAREST,
    trees: int = TREES,
    bits: int = BITS,
    share: float = CANDIDATES,
    rows: int = ROWS,
    queries_per_block: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` largest cosines found per query.

    Both tables have ``vec_id`` and ``vector``, arrays of one length. Rows whose id or vector is
    null, whose vector is zero, empty or holds a null or non-finite component take no part. A query
    is not its own neighbour (rows of its id are left out). Ties go to the smaller id; with fewer
    candidates than ``nearest`` all are returned. Rows that repeat an id count once per distinct
    vector. Other columns are not read. The number of block pairs grows with rows times queries, as
    the question does; each has a bounded size.
    """
    ship_package(vectors.sparkSession)

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        good = F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
        return df.filter(F.coalesce(good, F.lit(False))).select(
            F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("vector")
        )

    base, asked = sound(vectors), sound(queries)
    n_rows, n_asked = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n_rows // rows)), max(1, -(-n_asked // queries_per_block))
    left = base.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        "vec_id",
        "vector",
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group"),
        F.col("vec_id").alias("query_id"),
        "vector",
    )
    found = (
        left.groupBy("block", "group")
        .cogroup(right.groupBy("block", "group"))
        .applyInArrow(_searcher(nearest, trees, bits, share), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.dropDuplicates(["query_id", "vec_id", "score"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
