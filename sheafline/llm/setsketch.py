"""Near duplicates by SetSketch registers: band, estimate by likelihood, verify on the full sets.

A register holds the smallest point of a unit-rate process over all shingles of a document,
truncated and rounded to a power of BASE. Registers of a union are the minima, and two documents
agree in a register with about the probability of their similarity.

1. One pass over the texts makes (id, size, digest of the set, registers); no text leaves it.
2. Documents with equal sets are one representative, found by a grouped minimum.
3. Registers are banded. A representative's home is one of its populous buckets, chosen so that
   similar documents share few homes, and cut into blocks of about BLOCK documents. Two blocks that
   meet in any bucket are a block pair, which gets the documents that share a bucket with the other
   block. So a group of n near copies makes n * n / BLOCK rows, not n * n pairs.
4. A block pair estimates the similarity of all its document pairs by maximum likelihood from the
   register comparison. Only documents with an estimate that may reach the limit go on.
5. Their full sets are made again from the texts. A block pair verifies its likely pairs on them and
   returns a spanning forest of the links, so no link between components is lost.
6. Components by minimum labels with pointer jumping.

At a similarity of exactly 0.75 no band agrees with probability 2e-6, and the estimate is more than
0.15 too low with probability 4e-8; both fall quickly above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.words import WORD, free_name
from sheafline.session import materialize, ship_package

SHINGLE, LIMIT = 5, 75  # words; percent
BASE, RATE = 1.02, 20.0
BAND, BANDS = 5, 48
REGISTERS = BAND * BANDS
BLOCK = 512
#: Estimates below this are not verified.
LEAST_ESTIMATE = 0.60

_WORDS = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; the whole sequence if it is shorter."""
    words = _WORDS.findall(text.translate(_LOWER)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + each[k : len(words) - size + 1 + k])
    return np.unique(out)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, as int16 rows; 0 is a truncated register."""
    lowest = np.full((len(sets), REGISTERS), RATE)
    flat = lowest.reshape(-1)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.zeros(len(h))
    drawn = 0
    while len(h):
        # late rounds hold few elements, so they draw many points of each at once
        width = 1 if drawn < 4 else max(1, min(32, 200_000 // len(h)))
        number = np.arange(drawn + 1, drawn + width + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03)
        z = mix64(h[:, None] + number)
        gap = -np.log(((z >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / REGISTERS
        points = x[:, None] + np.cumsum(gap, axis=1)
        which = ((mix64(z + _U(1)) >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
        np.minimum.at(flat, (owner[:, None] * REGISTERS + which).reshape(-1), points.reshape(-1))
        drawn += width
        x = points[:, -1]
        alive = x < lowest.max(axis=1)[owner]
        h, owner, x = h[alive], owner[alive], x[alive]
    level = np.floor(1.0 - np.log(lowest / RATE) / np.log(BASE))
    return np.where(lowest >= RATE, 0, np.clip(level, 1, 4095)).astype(np.int16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """[set, band] bucket keys: the five 12-bit registers of a band side by side, mixed with its number."""
    parts = registers.reshape(len(registers), BANDS, BAND).astype(np.uint64)
    keys = (parts << (_U(12) * np.arange(BAND, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    return mix64(keys + mix64(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def likely_similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of all pairs of two register tables of known set sizes."""
    out = np.empty((len(left), len(right)))
    grid = np.arange(0.02, 1.0, 0.02)
    for i, row in enumerate(left):
        more, less = (row > right).sum(axis=1), (row < right).sum(axis=1)
        u = n_left[i] / (n_left[i] + n_right)
        # similarities cannot exceed the ratio of the sizes
        j = np.minimum(grid, (np.minimum(u, 1 - u) / np.maximum(u, 1 - u))[:, None] - 1e-9)
        differ = lambda share: -np.log1p(-np.clip(share, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
        p_more = differ(u[:, None] - (1 - u)[:, None] * j)
        p_less = differ((1 - u)[:, None] - u[:, None] * j)
        same = np.maximum(1 - p_more - p_less, 1e-12)
        loglik = (
            more[:, None] * np.log(p_more)
            + less[:, None] * np.log(p_less)
            + (REGISTERS - more - less)[:, None] * np.log(same)
        )
        out[i] = j[np.arange(len(right)), loglik.argmax(axis=1)]
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        start = 0
        while start < len(ids):
            sets, size, stop = [], 0, start
            while stop < len(ids) and size < 100_000:  # memory of the sketch follows the shingles
                sets.append(shingle_set(texts[stop].as_py()))
                size += len(sets[-1])
                stop += 1
            registers = sketch(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[start:stop], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                    batch.column(2).slice(start, stop - start),
                ],
                names=["doc_id", "n_shingles", "digest", "registers", "text_key"],
            )
            start = stop


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int16).reshape(-1, REGISTERS)
        keys = band_keys(registers)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                pa.array(keys.reshape(-1)),
            ],
            names=["doc_id", "key"],
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 64):  # sets may be larger than their texts
            ids, texts = batch.slice(start, 64).columns
            sets = [shingle_set(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "digest", "shingles"],
            )


def _sides(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The rows in order, the positions of the left and right documents, and the registers."""
    table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])
    side = table.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    right = left if side.max(initial=0) == 0 else np.flatnonzero(side == 1)
    registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.int16).reshape(-1, REGISTERS)
    return table, left, right, registers


def _promising(table: pa.Table) -> pa.Table:
    """The documents of a block pair with a partner whose estimate may reach the limit."""
    table, left, right, registers = _sides(table)
    sizes = table.column("n").to_numpy().astype(np.float64)
    wanted = np.zeros(len(table), bool)
    if len(left) and len(right):
        near = likely_similarity(registers[left], registers[right], sizes[left], sizes[right]) >= LEAST_ESTIMATE
        near &= table.column("doc_id").to_numpy()[left][:, None] != table.column("doc_id").to_numpy()[right]
        wanted[left[near.any(axis=1)]] = True
        wanted[right[near.any(axis=0)]] = True
    return table.select(["block_a", "block_b", "side", "doc_id"]).filter(pa.array(wanted))


def _verified(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between the two blocks of a pair (or within one block)."""
    table, left, right, registers = _sides(table)
    ids = table.column("doc_id").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.float64)
    root = {int(i): int(i) for i in ids}

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        estimate = likely_similarity(registers[left], registers[right], sizes[left], sizes[right])
        near = np.argwhere(estimate >= LEAST_ESTIMATE)
        # likely links first: later pairs are then connected already
        for i, k in near[np.argsort(-estimate[near[:, 0], near[:, 1]], kind="stable")]:
            a, b = left[i], right[k]
            ra, rb = find(int(ids[a])), find(int(ids[b]))
            if ra == rb:
                continue
            both = len(sets[a]) + len(sets[b])
            union = len(np.unique(np.concatenate((sets[a], sets[b]))))
            if 100 * (both - union) >= LIMIT * union:
                root[max(ra, rb)] = min(ra, rb)
                links.append((int(ids[a]), int(ids[b])))
    return pa.table(
        {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b).

    Minimum labels with pointer jumping; every round is written to the shared folder. Labels only
    fall, so the loop ends when a round changes none.
    """
    edges = materialize(links.union(links.select("b", "a")).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = (
            edges.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("lower"))
        jump = labels.select(F.col("id").alias("lower"), F.col("component").alias("far"))
        stepped = materialize(
            lower.join(jump, "lower").select(
                "id", F.least("lower", "far").alias("component"), F.col("component").alias("was")
            )
        )
        if stepped.filter("component <> was").isEmpty():
            return stepped.select("id", "component")
        labels = stepped.drop("was")


def _homes(bucketed: DataFrame) -> DataFrame:
    """doc_id, block from the buckets (doc_id, key, members) that hold two documents or more.

    Everyone starts in their most populous bucket and moves to the one of their buckets in which
    most live. Then they join the largest home that they meet in two buckets or more: similar
    documents share many buckets, so a group of them ends in one home, while a single shared bucket,
    as chance makes it, moves nobody.
    """
    rank = lambda *c: F.max(F.struct(*c, "members", "key")).alias("h")
    homes = bucketed.groupBy("doc_id").agg(rank()).select("doc_id", "h.*")
    for _ in range(2):
        living = materialize(homes.groupBy("key").agg(F.count("*").alias("living")))
        homes = bucketed.join(living, "key").groupBy("doc_id").agg(rank("living")).select("doc_id", "h.*")
    homes = materialize(homes.select("doc_id", "key"))
    for _ in range(2):
        living = homes.groupBy("key").agg(F.count("*").alias("now"))
        own = materialize(homes.join(living, "key").select("doc_id", F.struct("now", "key").alias("home")))
        largest = bucketed.join(own, "doc_id").groupBy("key").agg(F.max("home").alias("met"))
        met = bucketed.join(materialize(largest), "key").groupBy("doc_id", "met").agg(F.count("*").alias("times"))
        best = met.filter("times > 1").groupBy("doc_id").agg(F.max("met").alias("best"))
        moved = F.greatest("home", F.coalesce("best", "home"))
        homes = materialize(own.join(best, "doc_id", "left").select("doc_id", moved["key"].alias("key")))
    chunk = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("now") / F.lit(BLOCK)))
    last = homes.groupBy("key").agg(F.count("*").alias("now"))
    return materialize(homes.join(last, "key").select("doc_id", F.xxhash64("key", chunk).alias("block")))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``documents`` (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct five-word
    shingles, its whole word sequence if it is shorter, empty without words. Documents with at least
    75 % of shingles in common are linked; ``component_id`` is the smallest id reachable and ``kept``
    says that it is the document's own. Empty sets are linked with nothing. Rows without ``doc_id``
    take part in nothing: component null, kept. Rows that repeat an id are separate texts under one
    name. Other columns are not read; an empty table gives an empty result.
    """
    return _classes(documents).drop("text_key")


def _classes(documents: DataFrame) -> DataFrame:
    """:func:`near_duplicates` with a hash of the row's text, ``text_key``."""
    ship_package(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialize(
        texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(
            _sketched, "doc_id long, n_shingles long, digest binary, registers binary, text_key long"
        )
    )
    real = sketched.filter("doc_id is not null and n_shingles > 0")
    first = real.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n")
    )
    reps = materialize(first)
    # sets of one or two shingles have no partner but an equal set
    banded = (
        reps.filter("n > 2")
        .select(F.col("rep").alias("doc_id"), "registers")
        .mapInArrow(_banded, "doc_id long, key long")
    )
    full = banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    bucketed = materialize(banded.join(materialize(full), "key"))
    homes = _homes(bucketed)
    placed = materialize(bucketed.join(homes, "doc_id").select("doc_id", "key", "block"))
    met = placed.groupBy("key").agg(F.collect_set("block").alias("blocks")).filter(F.size("blocks") > 1)
    # of a block, another one gets the documents that share a bucket with it
    across = (
        placed.join(met, "key")
        .groupBy("doc_id", "block")
        .agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("others"))
        .select("doc_id", "block", F.explode("others").alias("other"))
        .filter("block <> other")
        .select(
            F.least("block", "other").alias("block_a"),
            F.greatest("block", "other").alias("block_b"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
            "doc_id",
        )
    )
    # a block of one document has nothing to compare within itself
    crowds = homes.groupBy("block").agg(F.count("*").alias("docs")).filter("docs > 1").select("block")
    within = homes.join(crowds, "block", "left_semi").select(
        F.col("block").alias("block_a"), F.col("block").alias("block_b"), F.lit(0).alias("side"), "doc_id"
    )
    sides = materialize(across.unionByName(within))
    sketches = materialize(
        reps.select(F.col("rep").alias("doc_id"), "registers", "n", "digest").join(homes, "doc_id", "left_semi")
    )
    promising = materialize(
        sides.join(sketches.drop("digest"), "doc_id")
        .select("block_a", "block_b", "side", "doc_id", "registers", "n")
        .groupBy("block_a", "block_b")
        .applyInArrow(_promising, "block_a long, block_b long, side int, doc_id long")
    )
    likely = materialize(promising.select("doc_id").distinct())
    sets = materialize(
        texts.join(likely, "doc_id", "left_semi")
        .mapInArrow(_shingled, "doc_id long, digest binary, shingles binary")
        # a row that repeats the id with another text is not the representative
        .join(sketches.select("doc_id", "digest", "registers"), ["doc_id", "digest"])
        .drop("digest")
    )
    links = (
        promising.join(sets, "doc_id")
        .select("block_a", "block_b", "side", "doc_id", "shingles", "registers")
        .groupBy("block_a", "block_b")
        .applyInArrow(_verified, "a long, b long")
    )
    linked = components(materialize(links))
    classes = reps.join(linked, F.col("rep") == F.col("id"), "left").select(
        "digest", F.coalesce("component", "rep").alias("class")
    )
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    joined = sketched.drop("registers").join(classes, "digest", "left")
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("class"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_key",
    )


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, of which each group of near duplicates keeps one.

    Rows are matched by id and a hash of the text: of different texts under one id those go that have
    a near duplicate with a smaller id. Rows that repeat an id and its text are one document; rows
    without an id stay. The names of other columns do not matter; an empty table stays empty.
    """
    own, key = (free_name(n, documents.columns) for n in ("_dropped_id", "_dropped_key"))
    dropped = _classes(documents).filter("not kept").select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct()
    same = (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(key))
    return documents.join(materialize(dropped), same, "left_anti")
