"""Near duplicates, piece encoding, the classifier and chat formatting against plain Python."""

import functools
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from brute import classes, shingles
from pyspark.sql import functions as F

from sheafline.llm import chat_format, setsketch, viterbi_scan, weak_labels


def copies(seed=4):
    """Originals with copies of every degree, a chain, and texts of all small sizes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 3, 4, 5, 6, 7, 8, 9, 12, 30, 200, 200, 900)]
    for t in list(texts):
        texts += [t, t.upper(), t.replace(" ", "\n\t")]
        for changes in (1, 1, 2, 3, 5, 8):
            words = t.split()
            for _ in range(changes):
                words[r.randrange(len(words))] = word()
            texts.append(" ".join(words))
    chain = [word() for _ in range(120)]
    for k in range(8):
        texts.append(" ".join(chain))
        chain = chain[6:] + [word() for _ in range(6)]
    base = [word() for _ in range(150)]
    for _ in range(150):  # a large group of near copies around the limit
        words = base[:]
        for _ in range(r.randint(1, 5)):
            words[r.randrange(150)] = word()
        texts.append(" ".join(words))
    texts += ["", " \n", "É é", "é É"]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark):
    rows = copies()
    df = spark.createDataFrame([*rows, (500_000, None)], "doc_id long, text string")
    df = df.withColumn("digest", F.lit(1)).withColumn("kept", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(df).collect()}
    want = classes([*rows, (500_000, None)])
    assert got == want
    assert sum(c != i for i, (_, c) in want.items()) > 150


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame(
        [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "A B C D E F"), (8, None), (9, None)],
        "doc_id long, text string",
    )
    rows = sorted(setsketch.near_duplicates(df).collect(), key=str)
    assert len(rows) == 6
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {
        (None, None, True), (3, 3, True), (7, 3, False), (8, 8, True), (9, 9, True),
    }
    assert setsketch.near_duplicates(df.limit(0)).count() == 0
    left = setsketch.without_near_duplicates(df.withColumn("rep", F.lit(0)))
    assert left.columns == ["doc_id", "text", "rep"]
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "3", "8", "9", "None"]


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (700, 900))
    both = setsketch.sketch([np.union1d(a, b)])[0]
    assert (np.maximum(*setsketch.sketch([a, b])) == both).all()
    for share in (0.3, 0.75, 0.95):
        estimates = []
        for _ in range(30):
            pool = r.integers(0, 2**63, 1200).astype(np.uint64)
            common, rest = pool[: int(share * 800)], pool[int(share * 800) : 800]
            x, y = np.concatenate((common, rest[::2])), np.concatenate((common, rest[1::2]))
            s = setsketch.sketch([np.unique(x), np.unique(y)])
            estimates.append(setsketch.likely_similarity(s[:1], s[1:], np.array([len(x)]), np.array([len(y)]))[0, 0])
        assert abs(np.mean(estimates) - share) < 0.03


def test_shingle_hashes_are_the_words_sets():
    for _, t in copies()[:80]:
        assert len(setsketch.shingle_set(t)) == len(shingles(t))


@pytest.fixture(scope="module")
def pieces():
    return viterbi_scan.build(viterbi_scan.read_pieces())


PARTS = ["the", "ing", " ", "  ", "\n", "é", "日本", "🙂", "a", "relationship", "▁", "", "", "\x00", "=" * 9]


def random_text(r, n):
    text = "".join(r.choice(PARTS) for _ in range(r.randint(0, n)))
    return text.replace(" ", "") if r.random() < 0.4 else text


def score_of(pieces, text, ids):
    values = {i: v for i, v in pieces.table.values() if i >= 0}
    first = pieces.byte_ids[0]
    known = sum(values[i] for i in ids if not first <= i < first + 256)
    return known + pieces.unknown * sum(
        (len(c.encode()) > 0) for c in bytes(i - first for i in ids if first <= i < first + 256).decode()
    )


def test_chunks_give_the_best_score_of_the_whole(pieces):
    r = random.Random(11)
    for _ in range(150):
        text = viterbi_scan.normalized(random_text(r, 90))
        if not text:
            continue
        best, ids = viterbi_scan.best_path(pieces, text, 0, len(text))
        assert viterbi_scan.encode_units(pieces, text)[0] == best == score_of(pieces, text, ids)
        for size in (17, 40):
            cut = viterbi_scan.chunks_of(pieces, text, size)
            scored = [viterbi_scan.transfer(pieces, *c, scored=True) for c in cut]
            assert functools.reduce(viterbi_scan.product, scored)[0, 0] == best
            matrices = [viterbi_scan.transfer(pieces, *c) for c in cut]
            at = viterbi_scan.border_states(matrices)
            joined = [i for (t, n), a, b in zip(cut, at, at[1:]) for i in viterbi_scan.trace(pieces, t, n, a, b)]
            assert score_of(pieces, text, joined) == best


def test_chunks_give_the_ids_of_the_whole(pieces):
    """Also where several segmentations have the best score."""
    r = random.Random(12)
    table = [(f"<{b}>", 0.0, "byte") for b in range(256)] + [(c, -1.0, "piece") for c in ("▁", "a", "aa", "aaa", "ab", "b", "ba")]
    even = viterbi_scan.build([*table, ("aaaa", -1.5, "piece")])
    assert even.longest == 4
    texts = ["aaaaa", "a" * 41, "ab" * 30, *("".join(r.choice("aaaab ") for _ in range(r.randint(5, 90))) for _ in range(150))]
    many = [(even, t, n) for t in texts for n in (3, 5, 8, 13)]
    runs = ["=" * 500, "-" * 333 + "ab" * 90, "x = " * 60 + "=" * 200 + " y" * 50, "абв" * 70 + "\n" * 150]
    for p, text, size in [*many, *((pieces, t, n) for t in runs for n in (pieces.longest, 50, 77))]:
        text = viterbi_scan.normalized(text)
        cut = viterbi_scan.chunks_of(p, text, size)
        matrices, orders = zip(*(viterbi_scan.ordered_transfer(p, t, n) for t, n in cut))
        states = viterbi_scan.border_states(list(matrices), list(orders))
        ids = [i for (t, n), a, b in zip(cut, states, states[1:]) for i in viterbi_scan.trace(p, t, n, a, b)]
        assert ids == viterbi_scan.encode_units(p, text)[1], (text, size)


def test_best_path_beats_every_other_segmentation(pieces):
    def every(text):
        if not text:
            yield 0
        for end in range(1, min(len(text), pieces.longest) + 1):
            found = pieces.table.get(text[:end])
            if found and found[0] >= 0:
                yield from (found[1] + x for x in every(text[end:]))

    for word in ("▁therein", "▁onsting", "▁thenation"):
        assert viterbi_scan.best_path(pieces, word, 0, len(word))[0] == max(every(word))


def test_encoding_round_trip(spark, pieces):
    r = random.Random(6)
    texts = [None, "", " ", "x" * 400, *(random_text(r, 200) for _ in range(60))]
    rows = [(None if i % 9 == 4 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    shared = viterbi_scan.share(spark)
    for chunk in (64, 1 << 20):
        encoded = viterbi_scan.encode(df, shared, chunk=chunk)
        back = viterbi_scan.decode_rows(encoded, shared).collect()
        assert sorted((str(x.doc_id), x.decoded) for x in back) == sorted((str(i), t or "") for i, t in rows)
    assert viterbi_scan.encode(df.limit(0), shared).count() == 0


def test_texts_cut_together_have_the_ids_of_each_alone(pieces, monkeypatch):
    r = random.Random(7)
    table = [(f"<{b}>", 0.0, "byte") for b in range(256)] + [(c, -1.0, "piece") for c in ("▁", "a", "aa", "ab", "b")]
    even = viterbi_scan.build(table)
    for p, cells, few in ((pieces, 1 << 18, 64), (pieces, 1 << 12, 1), (even, 1 << 12, 4)):
        monkeypatch.setattr(viterbi_scan, "CELLS", cells)
        monkeypatch.setattr(viterbi_scan, "FEW", few)
        texts = ["", *(viterbi_scan.normalized(random_text(r, 120)) for _ in range(150)), "▁▁", "a▁b", ""]
        texts += ["▁" + "".join(r.choice("aaab▁") for _ in range(30)) for _ in range(100)]
        expected = [viterbi_scan.encode_units(p, t)[1] for t in texts]
        assert viterbi_scan.encode_texts(p, texts).to_pylist() == expected
    assert viterbi_scan.encode_texts(pieces, ["", ""]).to_pylist() == [[], []]


def test_distinct_words_are_not_cut_one_by_one(pieces, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choice("etaoinshrdluбвгде") for _ in range(r.randint(3, 11))) for _ in range(20000)]
    text = viterbi_scan.normalized(" ".join(words))
    alone, plain = [], viterbi_scan.unit_path
    monkeypatch.setattr(viterbi_scan, "unit_path", lambda p, unit: alone.append(unit) or plain(p, unit))
    ids = viterbi_scan.encode_texts(pieces, [text])[0].as_py()
    assert len(alone) < viterbi_scan.FEW
    assert viterbi_scan.decode(pieces, ids) == " ".join(words)


def test_long_texts_are_shuffled_once_and_equal_whole_ones(spark, pieces):
    r = random.Random(9)
    texts = [random_text(r, 300) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = viterbi_scan.encode(df, viterbi_scan.share(spark), chunk=64)
    ids = {x.doc_id: x.ids for x in encoded.collect()}
    assert "ReusedExchange" in encoded._jdf.queryExecution().executedPlan().toString()
    whole = [viterbi_scan.encode_units(pieces, viterbi_scan.normalized(t))[1] for t in texts]
    assert [ids[k] for k in range(len(texts))] == whole


def test_label_model_finds_accuracies():
    r = np.random.default_rng(3)
    good = r.random(20000) < 0.8
    accuracy, cover = np.array([0.95, 0.9, 0.7, 0.85]), np.array([0.9, 0.6, 0.8, 0.4])
    right = r.random((20000, 4)) < accuracy
    votes = np.where(right == good[:, None], 1, -1) * (r.random((20000, 4)) < cover)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    found = [model.chances[k][1, 2] / (model.chances[k][1, 2] + model.chances[k][1, 0]) for k in range(4)]
    assert np.abs(np.array(found) - accuracy).max() < 0.03


def test_classifier_on_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    out = weak_labels.classified(docs).join(labels, "doc_id").select("quality", "_kept").collect()
    good, bad = ([r["_kept"] for r in out if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_classifier_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, " \n"), (5, "A plain sentence, and one more. " * 20), (6, "*** $$$ " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("x"))
    got = weak_labels.classified(df).collect()
    assert len(got) == 6 and all(not r["_kept"] for r in got if not (r.text or "").split())
    assert weak_labels.classified(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        weak_labels.classified(df.withColumn("_good", F.lit(1)))


CHAT = [
    (1, 0, "system", "be kind"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "ok <|im_start|> <\\| <"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "first"), (3, 1, "user", "x"),
    (4, 0, "user", "a"), (4, 0, "user", "a"), (5, None, "us\ner\\n", "odd <| role"), (5, 1, None, "n"),
    (None, 2, "assistant", "é🙂"), (None, 1, "user", "q" * 5000), (6, 0, "user", "u"), (6, 1, "tool", "t"),
]


def test_conversations(spark):
    long = [(9, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(600)]
    rows = CHAT + long
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.repartition(7).withColumn("valid", F.lit("x")).withColumn("segments", F.lit(0))
    got = {r.conv_id: r for r in chat_format.conversations(df).collect()}
    groups = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1] is None, x[1] or 0)):
        groups[c].append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert {c: got[c].valid for c in got} == {1: True, 2: True, 3: False, 4: False, 5: False, None: True, 6: False, 9: True}
    assert chat_format.conversations(df.limit(0)).count() == 0


def test_escapes_are_reversible_and_hide_control_strings():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["<", "|", "\\", "im_end", "|>", "<|", "x", "\n"]) for _ in range(r.randint(0, 12)))
        hidden = chat_format.escape(text, "<|")
        assert "<|" not in hidden and chat_format.unescape(hidden, "<|") == text
        whole = "".join(t for t, _ in chat_format.segments(text, text))
        assert chat_format.parse_turn(whole) == (text, text)
