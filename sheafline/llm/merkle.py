"""Merkle manifest of a table of documents, with proofs by pointer jumping.

Every document is a leaf, every source a tree with three children a node, and the roots of the
sources are the leaves of one more tree, whose root stands for the table. Levels are built bottom-up
by grouping consecutive nodes, so a level is a third of the one below. For the proofs every node
holds its ancestor and the siblings on the way to it. At first that is one step; joining the table
with itself on the ancestor doubles the distance and concatenates the siblings, so the proofs of a
tree with h levels need about log2(h) joins. In round r only nodes at least 2**r levels up can be
anybody's ancestor, so what is joined shrinks to a ninth, an eighty-first and so on of the leaves.

Digests travel as 32 bytes and are hashed as lower-case hex. Only DataFrame functions are used.

Nulls: a null field is hashed as ``-``; rows without a source form the first tree; a null doc_id comes
first in its source and counts as the text of no digits for the choice of tampered rows. Rows that
repeat a doc_id are leaves of their own, ordered by their digest. An empty table gives an empty
manifest. Columns beyond doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.operators.ranking import prefix_positions
from sheafline.session import materialize

FAN = 3  # children of a node
TOP = -1  # number of the tree whose leaves are the roots of the sources
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node is found by the number of its tree, its level above the leaves and its place in the level.
NODE = ("tree", "level", "at")
ANCESTOR = tuple(f"up_{c}" for c in NODE)
PATH = (*NODE, *ANCESTOR, "siblings")
SIBLINGS = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def framed(value: Column) -> Column:
    """A field with its length before it, so that no two rows are joined to the same string."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row of documents; ``text`` stands in for its text."""
    fields = [framed(F.col(c)) for c in FIELDS[:-1]] + [framed(F.col("text") if text is None else text)]
    return digest(F.concat(*fields))


def chosen(doc_id: Column) -> Column:
    """The rows that are tampered with: an even CRC of the id's digits."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 2 == 0


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered (null where the row is left alone)."""
    cut = leaf_digest(F.translate(F.col("text").cast("string"), "\n", ""))
    return docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(chosen(F.col("doc_id")), cut).alias("tampered"))


def _grow(first: DataFrame, height: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Build ``height`` levels over the leaves ``tree, at, n, digest`` (n: nodes of the tree's level).

    Returns the steps from every node that has a parent, and the roots ``tree, level, digest``. Steps
    and roots of leaves carry the columns of ``keep``, those of inner nodes nulls in their place. A
    tree that has one node left goes no further.
    """
    nodes, steps, roots = first, [], []
    for level in range(height + 1):
        alone = nodes.filter("n = 1")
        roots.append(alone.select("tree", F.lit(level).alias("level"), "digest", *keep))
        if level == height:
            break
        run = F.floor(F.col("at") / F.lit(FAN)).alias("up_at")
        member = F.struct("at", "digest", *keep).alias("m")
        runs = nodes.filter("n > 1").select("tree", run, "n", member).groupBy("tree", "up_at", "n")
        runs = runs.agg(F.sort_array(F.collect_list("m")).alias("members"))
        joined = F.array_join(F.transform("members", lambda m: as_hex(m["digest"])), "")
        runs = materialize(runs.withColumn("digest", digest(joined)))
        steps.append(_steps(runs, level, keep))
        nodes = runs.select("tree", F.col("up_at").alias("at"), F.ceil(F.col("n") / F.lit(FAN)).alias("n"), "digest")
        nodes = nodes.withColumns({c: F.lit(None).cast(first.schema[c].dataType) for c in keep})
    return reduce(DataFrame.unionByName, steps) if steps else None, reduce(DataFrame.unionByName, roots)


def _steps(runs: DataFrame, level: int, keep: tuple[str, ...]) -> DataFrame:
    """Each member of a run as a node with its parent and its siblings on either side."""
    rows = runs.select("tree", "up_at", "members", F.posexplode("members").alias("_k", "m"))

    def side(part: Column) -> Column:
        return F.unhex(F.array_join(F.transform(part, lambda m: F.hex(m["digest"])), ""))

    left = side(F.slice("members", F.lit(1), F.col("_k")))
    right = side(F.slice("members", F.col("_k") + 2, F.lit(FAN)))
    step = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(SIBLINGS)
    return rows.select(
        "tree", F.lit(level).alias("level"), F.col("m.at").alias("at"),
        F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), "up_at",
        step.alias("siblings"), F.col("m.digest").alias("digest"), *(F.col(f"m.{c}").alias(c) for c in keep),
    )


def _joined(below: DataFrame, above: DataFrame) -> DataFrame:
    """Where an ancestor has an edge of its own, go on to that edge's end."""
    above = above.select(*(F.col(c).alias(f"_{c}") for c in (*NODE, *ANCESTOR)), F.col("siblings").alias("_siblings"))
    on = [F.col(u) == F.col(f"_{n}") for u, n in zip(ANCESTOR, NODE)]
    both = below.join(above, on, "left")
    further = F.col("_siblings").isNotNull()
    moved = {u: F.when(further, F.col(f"_{u}")).otherwise(F.col(u)) for u in ANCESTOR}
    longer = F.when(further, F.concat("siblings", "_siblings")).otherwise(F.col("siblings"))
    return both.withColumns({**moved, "siblings": longer}).select(*below.columns)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``."""
    found = materialize(leaves(docs))
    if found.isEmpty():
        words = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
        return found.select("doc_id", *(F.lit(None).cast("string").alias(c) for c in words), F.lit(True).alias("verified"))
    placed = prefix_positions(found, ["source"], ["doc_id", "leaf"], "at")
    sizes = materialize(placed.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    ranks = materialize(prefix_positions(sizes, [], ["source"], "tree").withColumnRenamed("source", "_source"))
    first = placed.join(ranks, F.col("source").eqNullSafe(F.col("_source")))
    first = first.select("tree", "at", "n", F.col("leaf").alias("digest"), "doc_id", "tampered")

    sources, largest = ranks.agg(F.count(F.lit(1)), F.max("n")).first()
    heights = levels(largest), levels(sources)
    steps, subroots = _grow(first, heights[0], ("doc_id", "tampered"))
    subroots = materialize(subroots)
    crown = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(sources).cast("long").alias("n"), "digest")
    above, summit = _grow(crown, heights[1])
    root = summit.select(as_hex(F.col("digest")).alias("root")).first()["root"]

    # from the root of a source to the leaf of the top tree that stands for it: no siblings
    bridge = subroots.select(
        "tree", "level", F.lit(0).cast("long").alias("at"), F.lit(TOP).cast("long").alias("up_tree"), F.lit(0).alias("up_level"),
        F.col("tree").alias("up_at"), F.array().cast(SIBLINGS).alias("siblings"), "digest", "doc_id", "tampered",
    )
    steps = bridge if steps is None else steps.unionByName(bridge)
    paths = steps.filter("level = 0").select(*PATH, F.col("digest").alias("leaf"), "doc_id", "tampered")
    links = steps.filter("level > 0").select(*PATH)
    if above is not None:
        links = links.unionByName(above.select(*PATH))
    return _verified(_climbed(paths, links, sum(heights) + 1), subroots, root)


def levels(leaves: int) -> int:
    """Levels above that many leaves."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FAN), height + 1
    return height


def _climbed(paths: DataFrame, links: DataFrame, height: int) -> DataFrame:
    """Double the distance until it covers ``height`` steps."""
    links, reach = materialize(links), 1
    while reach < height:
        paths, reach = _joined(paths, links), 2 * reach
        # ways of this length end at least ``reach`` levels up or in the top tree
        useful = links.filter((F.col("level") >= reach) | (F.col("tree") == TOP))
        if reach < height:
            links = materialize(_joined(useful, links))
    return paths


def _verified(paths: DataFrame, subroots: DataFrame, root: str) -> DataFrame:
    siblings = F.array_join(F.transform("siblings", lambda s: F.concat(as_hex(s["left"]), as_hex(s["right"]))), "")
    start = as_hex(F.coalesce("tampered", "leaf"))
    folded = F.aggregate(
        "siblings", start, lambda d, s: F.sha2(F.concat(as_hex(s["left"]), d, as_hex(s["right"])), 256)
    )
    ends = subroots.select("tree", as_hex(F.col("digest")).alias("subroot"))
    rows = paths.join(ends, "tree").select(
        "doc_id", as_hex(F.col("leaf")).alias("leaf"), "subroot", F.lit(root).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
