"""Language-model scores, ranked search and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import context_mix, merkle, pair_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(rng, size, words=60):
    return " ".join(rng.choice("The of And naïve Ключ x9 tion ing,er".split()) + str(rng.randrange(words)) for _ in range(size))


# ---- Merkle manifest --------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """Root and each leaf's list of (left, right)."""
    proofs, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, at in enumerate(place):
            run = at - at % 3
            proofs[leaf].append(("".join(digests[run:at]), "".join(digests[at + 1 : run + 3])))
            place[leaf] = at // 3
        digests = [h("".join(digests[i : i + 3])) for i in range(0, len(digests), 3)]
    return digests[0], proofs


def manifest(rows):
    def leaf(r, cut):
        text = r[4].replace("\n", "") if cut and r[4] is not None else r[4]
        return h("".join(framed(v) for v in (r[0], r[3], r[2], r[1], text)))

    by_source = {}
    for r in rows:
        cut = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
        key = (r[0] is not None, r[0] or 0, leaf(r, False))
        by_source.setdefault(r[3], []).append((key, r[0], leaf(r, False), leaf(r, cut)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    roots, paths = {}, {}
    for s in order:
        by_source[s].sort()
        roots[s], paths[s] = tree([x[2] for x in by_source[s]])
    root, tops = tree([roots[s] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, doc_id, own, start), way in zip(by_source[s], paths[s]):
            folded = start
            for left, right in way + top:
                folded = h(left + folded + right)
            proof = h("".join(left + right for left, right in way + top))
            out.append((doc_id, own, roots[s], root, proof, folded, folded == root))
    return sorted(out, key=repr)


MERKLE = "doc_id long, n_chars long, lang string, source string, text string"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 1}, {"hot": 95, "b": 28, "é": 10, "z": 4, None: 9, "": 1}])
def test_manifest(spark, sizes):
    rng = random.Random(5)
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            at += 1
            text = rng.choice([None, "", "one\ntwo", "plain", "é\n\n" + "long " * rng.randrange(3000)])
            rows.append((rng.choice([at, at, at, None]), rng.choice([None, 7]), rng.choice([None, "en"]), source, text))
    rows += rows[:2]  # repeated rows
    df = spark.createDataFrame(rows, MERKLE).withColumn("tree", F.lit("x")).withColumn("leaf", F.lit(1)).repartition(5)
    got = sorted((tuple(r) for r in merkle.manifest(df).collect()), key=repr)
    assert got == manifest(rows)


def test_manifest_of_nothing(spark):
    out = merkle.manifest(spark.createDataFrame([], MERKLE))
    assert out.collect() == [] and out.columns[0] == "doc_id" and out.schema["verified"].dataType.typeName() == "boolean"


def test_manifest_shows_what_changed(spark):
    rows = [(i, 1, "en", f"s{i % 2}", "a\nb" if i % 3 else "ab") for i in range(40)]
    out = {r["doc_id"]: r["verified"] for r in merkle.manifest(spark.createDataFrame(rows, MERKLE)).collect()}
    assert out == {i: not (zlib.crc32(str(i).encode()) % 2 == 0 and i % 3) for i in range(40)}


# ---- ranked search ----------------------------------------------------------------------------


def ranking(docs, items, k):
    tf = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    lengths = [sum(c.values()) for c in tf]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(w for c in tf for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for (doc, _), c, length in zip(docs, tf, lengths):
            m = 50 + (50 * length * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if c[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else doc, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [5, 40, 1000])
def test_search(spark, monkeypatch, block):
    """Blocks smaller than the result, between, and one for all."""
    rng = random.Random(block)
    monkeypatch.setattr(pair_search, "BLOCK_DOCS", block)
    docs = [(i, prose(rng, rng.choice([1, 5, 30, 200]))) for i in range(160)]
    docs += [(i + 500, docs[i % 7][1]) for i in range(30)]  # copies: ties
    docs += [(900, None), (901, ""), (902, "... --"), (None, docs[3][1]), (3, docs[3][1]), (3, "other words entirely")]
    items = [(i, prose(rng, rng.choice([1, 2, 9, 25]))) for i in range(12)] + [(50, None), (51, "!!"), (52, "unheard"), (None, docs[1][1]), (2, "extra x91")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("term", F.lit("t")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1))
    got = sorted((tuple(r) for r in pair_search.search(a, b, 10).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    want = ranking(docs, items, 10)
    assert [(x[0], x[1], x[3]) for x in got] == [(x[0], x[1], x[3]) for x in want]
    assert got == want


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert pair_search.search(none, items).collect() == []
    assert pair_search.search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_bounds_skip_and_lose_nothing():
    """Documents of pairs that are not essential are found only through essential ones."""
    rng = np.random.default_rng(3)
    ids = np.arange(400)
    terms, meets = {}, {}
    pairs = [(f"a{i}", f"b{i}") for i in range(6)]
    for name in [t for p in pairs for t in p]:
        docs = np.sort(rng.choice(400, rng.integers(1, 300), replace=False)).astype(np.int32)
        gains = rng.integers(1, 1000, len(docs))
        terms[name] = docs, gains, int(gains.max())
    full = np.zeros(400, np.int64)
    for a, b in pairs:
        both, x, y = np.intersect1d(terms[a][0], terms[b][0], return_indices=True)
        bits = np.zeros(400, bool)
        bits[both] = True
        meets[a, b] = int((terms[a][1][x] + terms[b][1][y]).max(initial=0)), np.packbits(bits).tobytes()
        for t in (a, b):
            full[terms[t][0]] += terms[t][1]
    order = np.lexsort((ids, -full))
    for least in (0, 500, int(full[order[9]]), int(full.max()), int(full.max()) + 1):
        found, scores = pair_search.best_in_block(terms, meets, pairs, ids, least, 10)
        want = [i for i in order[:10] if full[i] >= max(least, 1)]
        assert found.tolist() == want and scores.tolist() == full[want].tolist()


# ---- context mixing ---------------------------------------------------------------------------


def squash(x):
    return 1 / (1 + math.exp(-min(max(x, -11), 11)))


def logit(p):
    return math.log(p / (1 - p))


class Plain:
    """One sequence's mixer, decision by decision."""

    def __init__(self, inputs):
        self.w, self.cells, self.n = {}, {}, inputs

    def bit(self, place, gate, x, bit):
        w = self.w.setdefault((gate, place), [context_mix.WEIGHT] * self.n)
        dot = min(max(sum(a * b for a, b in zip(w, x)), -11), 11)
        p = squash(dot)
        at = int(min(max(dot + context_mix.MAP_CELLS / 2, 0), context_mix.MAP_CELLS - 1))
        cell = self.cells.setdefault((place, at), squash(at - (context_mix.MAP_CELLS - 1) / 2))
        final = 0.7 * p + 0.3 * cell
        self.w[gate, place] = [a + context_mix.RATE * (bit - p) * b for a, b in zip(w, x)]
        self.cells[place, at] = cell + context_mix.MAP_RATE * (bit - cell)
        return math.log(max(final if bit else 1 - final, context_mix.TINY))


def node_odds(leaves, slot, node, width):
    """Stretched share of the right child below a node of a binary tree over the leaf counts."""
    def below(k):
        low, high = k, k
        while low < width:
            low, high = 2 * low, 2 * high + 1
        return sum(leaves.get((slot, i - width), 0) for i in range(low, high + 1))

    return logit((below(2 * node + 1) + context_mix.SMOOTH) / (below(node) + 2 * context_mix.SMOOTH))


def slot_of(*hashes):
    mixed = 0
    for x in hashes:
        mixed = ((mixed ^ x) * 0x9E3779B1) % 2**32
        mixed ^= mixed >> 15
    return mixed % context_mix.TOKEN_SLOTS


def plain_scores(docs):
    lists = {i: context_mix.tokens_of(t) for i, t in docs}
    train = {i for i in lists if zlib.crc32(str(i).encode()) % 10}
    count = Counter(w for i in train for w in lists[i])
    n, types = sum(count.values()), len(count)
    by_class = Counter()
    for w, c in count.items():
        by_class[context_mix.class_of(w)] += c

    def slots(words, t):
        one = words[t - 1] if t else b""
        two = words[t - 2] if t > 1 else b""
        return [0, slot_of(zlib.crc32(one)), context_mix.class_of(one) * 64 + context_mix.class_of(two), slot_of(zlib.crc32(one), zlib.crc32(two))]

    tables = [Counter() for _ in range(4)]
    for i in train:
        for t, w in enumerate(lists[i]):
            for k, s in enumerate(slots(lists[i], t)):
                tables[k][s, context_mix.class_of(w)] += 1
    letters = [Counter() for _ in context_mix.SPELL_SLOTS]

    def letter_slots(word):
        flat = np.frombuffer(word, np.uint8).astype(np.int64)
        return list(zip(*(s.tolist() for s in context_mix.spell_contexts(flat, np.array([0])))))

    for w in count:
        if w:
            for byte, at in zip(w + b" ", letter_slots(w + b" ")):
                for k, s in enumerate(at):
                    letters[k][s, byte] += 1

    def spelled(word):
        mixer, total = Plain(len(letters)), 0.0
        for t, (byte, at) in enumerate(zip(word + b" ", letter_slots(word + b" "))):
            node = 1
            for depth in range(8):
                bit = byte >> (7 - depth) & 1
                total += mixer.bit(depth, min(t, 2), [node_odds(c, s, node, 256) for c, s in zip(letters, at)], bit)
                node = 2 * node + bit
        return total

    unknown = min(max(sum(c == 1 for c in count.values()) / n, context_mix.TINY), 1 - context_mix.TINY)
    out = {}
    for i, words in lists.items():
        mixer, habit, rate, total = Plain(5), {}, {}, 0.0
        base = 0.0
        for t, w in enumerate(words):
            base += math.log10((count[w] + 0.1) / (n + 0.1 * (types + 1)))
            gate = 2 if not t else 0 if not count[words[t - 1]] else 1 if count[words[t - 1]] < 16 else 2
            at, steps, node = slots(words, t), [], 1
            if count[w]:
                for depth in range(6):
                    bit = context_mix.class_of(w) >> (5 - depth) & 1
                    steps.append((depth, node, bit, [node_odds(c, s, node, 64) for c, s in zip(tables, at)]))
                    node = 2 * node + bit
            steps.append((6, 0, int(not count[w]), [logit(unknown), 0, 0, 0]))
            for depth, node, bit, x in steps:
                start = unknown if node == 0 else squash(node_odds(tables[0], 0, node, 64))
                p, r = habit.get(node, start), rate.get(node, context_mix.CONFIDENT / 4)
                habit[node] = min(max(p + r * (bit - p), context_mix.TINY), 1 - context_mix.TINY)
                rate[node] = max(r * 0.9, context_mix.LEAST_RATE)
                total += mixer.bit(depth, gate, [*x, logit(p)], bit)
            total += math.log(count[w] / by_class[context_mix.class_of(w)]) if count[w] else spelled(w)
        out[i] = (len(words), sum(count[w] > 0 for w in words), n, base, total / math.log(10))
    return out


def test_scores(spark, monkeypatch):
    rng = random.Random(11)
    docs = [(i, prose(rng, rng.choice([0, 1, 4, 60]), 15)) for i in range(60)] + [(200, None), (201, " \n\t"), (202, "Ünheard WORDS " * 40)]
    want = plain_scores(docs)
    monkeypatch.setattr(context_mix, "BLOCK_BYTES", 900)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit(3)).withColumn("score", F.lit(1)).repartition(3)
    rows = context_mix.score(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        size, known, n, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=2e-4)


def test_scores_of_odd_tables(spark):
    assert context_mix.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if context_mix.held_out(i))
    rows = context_mix.score(spark.createDataFrame([(held, "a b"), (held, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows if r["doc_id"]] == [(3, 0, 0, 0.0)] * 2
    assert all(r["held_out"] and r["score"] < 0 for r in rows)


def test_mixing_beats_the_base_on_held_out_text(spark, sf):
    """Per known vocabulary: text that training has not seen is predicted better by context."""
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = [r for r in context_mix.score(docs).collect() if r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert all(r["score"] < 0 for r in rows)
