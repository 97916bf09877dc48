"""Jump-hash shards, the curriculum mix and the quality rules against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from brute import WORD
from pyspark.sql import functions as F

from sheafline.llm import curriculum, jump_hash, quality_rules, setsketch
from sheafline.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string"
MIXED = [
    (1, "one two three", "en", "a"),
    (1, "one two three", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (None, "no id ☃ here", "de", "b"),
    (4, " \t\n\x0b\x0c\r", "de", "c"),
    (5, "word " * 5000, "en", "a"),
]


def jump(key, n):
    """The published algorithm."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *random.Random(3).sample(range(2**62), 60)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 1000):
        got = {r.k: r.s for r in df.select("k", jump_hash.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k % 2**64, n) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(3000).select(
        jump_hash.jump_hash(F.col("id"), 24).alias("a"), jump_hash.jump_hash(F.col("id"), 25).alias("b")
    )
    rows = df.collect()
    assert all(r.a == r.b or r.b == 24 for r in rows)
    assert 60 < sum(r.a != r.b for r in rows) < 190


def test_manifest(spark):
    df = spark.createDataFrame(MIXED, DOCS).withColumn("slot", F.lit("x")).withColumn("shard", F.lit(9))
    rows = jump_hash.shard_manifest(df, 3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in MIXED
    )
    slots = defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard, r.law) == (jump(r.doc_id or 0, 3), jump(r.doc_id or 0, 4), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert jump_hash.shard_manifest(df.limit(0), 3).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame(MIXED, DOCS)
    jump_hash.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(MIXED)
    assert all(r["_shard"] == jump(r.doc_id or 0, 4) for r in back.collect())


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | level
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)
    return target


def test_mix(spark):
    r = random.Random(5)
    rows = [
        (i, " ".join("w" * r.randint(1, 4) for _ in range(r.choice([0, 1, 5, 40, 300]))), "en", r.choice("aaaaabcd"))
        for i in range(400)
    ] + [(900, None, "en", None), (901, "x y z", "en", None), (901, "x y z", "en", None), (None, "q", "en", "a")]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("range", F.lit("r"))
    got = curriculum.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    for x in got:
        assert x.source_size == sizes[x.source] and 0 <= x.taken <= 2 * x.size
        assert list(x.positions) == sorted(x.positions) and all(0 <= p <= 1 for p in x.positions)
        assert x.size == 0 or len(x.positions) == math.ceil(x.taken / x.size)
        taken[x.source] += x.taken
        target[x.source] = x.target
    want = filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    again = curriculum.mix(df).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    assert curriculum.mix(df.limit(0)).count() == 0


def test_time_inverts_the_schedule(spark):
    for knots in curriculum.SCHEDULES:
        area = curriculum.integral(knots)[-1]

        def reached(t, knots=knots):
            total = 0.0
            for (a, x), (b, y) in zip(knots, knots[1:]):
                if t > a:
                    e = min(t, b)
                    total += (e - a) * (x + x + (y - x) * (e - a) / (b - a)) / 2
            return total

        df = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
        for r in df.select("u", curriculum.time_of(F.col("u"), knots).alias("t")).collect():
            assert reached(r.t) / area == pytest.approx(r.u, abs=1e-9)


def test_mixed_documents_keep_all_columns(spark):
    df = spark.createDataFrame(MIXED, DOCS).withColumn("taken", F.lit(7)).withColumn("size", F.lit("s"))
    out = curriculum.mixed_documents(df)
    assert out.columns == df.columns
    plan = {r.doc_id: r for r in curriculum.mix(df).collect()}
    counts = Counter(r.doc_id for r in out.collect())
    assert counts[5] == round(plan[5].taken / plan[5].size)


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    three = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (
        n,
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
        n < 50 or 100 * len(hit) > 50 * n,
    )


def test_rules_count_like_plain_python(spark):
    r = random.Random(8)
    texts = [None, "", " \n\t ", "a b c a b c", "x x x x x", "☃ é b #*$%&|<>", "l\nl\n \n\nl m\r\nl\r\n", "w " * 3000]
    texts += [
        "".join(r.choice(["a", "b", "cc", " ", " ", "\n", "#", " ", "É", "!"]) for _ in range(r.randint(0, 400)))
        for _ in range(60)
    ]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    df = df.withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, None), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(df, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {x.doc_id: tuple(x[f"_q_{c}"] for c in names) for x in got} == {i: stats(t) for i, t in enumerate(texts)}
    assert all(x["_q_kept"] is not None and not (x["_q_kept"] and x["_q_base_failed"]) for x in got)
    assert quality_rules.judged(df.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail_is_exact_and_never_too_small(spark):
    cases = [(n, k) for n in (1, 5, 9, 10, 60, 400, 3000) for k in {0, 1, n // 100, n // 60, n}]
    df = spark.createDataFrame(cases, "n long, k long")
    p = 0.02
    for r in df.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
        q = Fraction(p)
        exact = float(sum(math.comb(r.n, i) * q**i * (1 - q) ** (r.n - i) for i in range(min(r.k, 60) + 1)))
        assert r.t == (1.0 if r.k >= r.n * p else pytest.approx(exact, rel=1e-8))


def test_cutoffs_hold_their_risk_and_reject_bad_text(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1600):
        words = [r.choice("the of and a thing word text more") + str(r.randint(0, 999)) for _ in range(60)]
        good = i % 4 != 0
        if not good:
            words = [w + "***" for w in words]
        elif i % 200 == 1:
            words = [w + "*" for w in words]  # good text with symbols
        rows.append((i, " ".join(words), "en" if i % 3 else "de"))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality_rules.judged(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {x.doc_id: x["_q_kept"] for x in out}
    good = [kept[i] for i, q, _ in labels if q]
    assert sum(good) / len(good) >= 1 - quality_rules.RISK
    assert not any(kept[i] for i, q, _ in labels if not q)


def test_small_strata_have_only_their_own_cutoffs(spark):
    """All good texts of a small stratum have symbols; the large one's cutoff says nothing about them."""
    rows, labels = [], []
    for i in range(900):
        lang = {0: "small", 30: "small", 1: None, 31: None, 2: "unlabelled", 32: "unlabelled"}.get(i, "en")
        bad = lang == "en" and i % 5 == 0
        words = [f"w{i}x{k}" + ("***" if bad or lang != "en" else "") for k in range(60)]
        rows.append((i, " ".join(words), lang))
        if lang != "unlabelled":
            labels.append((i, int(not bad), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {i for i, _, lang in rows if lang != "en" or i % 5}
    assert {x.doc_id for x in quality_rules.kept_documents(df, labels).collect()} == want
    out = quality_rules.judged(df, labels, pooled_below=quality_rules.MIN_GOOD).collect()
    assert {x.lang for x in out if not x["_q_kept"]} == {"en", "small", None, "unlabelled"}


def test_query_judges_small_strata_as_its_sql(spark, tmp_path):
    """Texts with symbols in strata too small for a test of their own, by the cutoffs of all documents."""
    rows, labels = [], []
    for i in range(900):
        lang = {0: "small", 30: "small", 1: None, 2: "unlabelled", 32: "unlabelled"}.get(i, "en")
        bad = lang == "en" and i % 5 == 0
        marked = bad or i in (0, 1, 2)
        rows.append((i, " ".join(f"w{i}x{k}" + ("***" if marked else "") for k in range(60)), lang))
        if lang != "unlabelled":
            labels.append((i, int(not bad), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r["kept"] for r in QUERIES["op10_risk_rules"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    names = [c[0] for c in con.execute(ORACLES["op10_risk_rules"]).description]
    told = con.execute(ORACLES["op10_risk_rules"]).fetchall()
    assert out == {r[names.index("doc_id")]: r[names.index("kept")] for r in told}
    assert [out[i] for i in (0, 30, 1, 2, 32, 3, 5)] == [False, True, False, False, True, True, False]


ROWS = [(1, "A"), (2, "A"), (2, "B"), (3, "C"), (3, "C"), (None, "A"), (4, None), (4, "")]


def _odd_rows(spark):
    text = {"A": "one two three four five six seven eight", "B": "a text with nothing in common at all", "C": "short"}
    rows = [(i, text.get(t, t), "s", "en") for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for name in ("_dropped", "_dropped_id", "_mixed_id", "_mixed_doc_id", "_id", "_key", "_row_key", "_stratum", "_has", "_position", "text_key"):
        df = df.withColumn(name, F.lit(7))
    return df, text


def test_one_id_with_two_texts_and_clashing_names(spark):
    df, text = _odd_rows(spark)
    out = setsketch.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(
        map(repr, [(1, text["A"]), (2, text["B"]), (3, text["C"]), (3, text["C"]), (None, text["A"]), (4, None), (4, "")])
    )
    mixed = curriculum.mixed_documents(df)
    assert mixed.columns == df.columns
    taken = {(r["doc_id"], r["text"]) for r in mixed.collect()}
    assert (2, text["B"]) in taken
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = quality_rules.kept_documents(df, labels)
    assert kept.columns == df.columns and kept.collect() == []  # every text has fewer than fifty words


def test_stages_on_empty_tables(spark):
    df, _ = _odd_rows(spark)
    none = df.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert setsketch.without_near_duplicates(none).collect() == []
    assert curriculum.mixed_documents(none).collect() == []
    assert quality_rules.kept_documents(none, labels).collect() == []


def test_kept_documents_are_the_judged_ones(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in quality_rules.kept_documents(docs, labels).select("doc_id").collect()}
    out = quality_rules.judged(docs, labels, carry=("doc_id", "lang")).filter("_q_kept")
    assert kept == {r["doc_id"] for r in out.select("doc_id").collect()} and kept
