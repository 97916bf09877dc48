"""The stages against what they promise, and the registry."""

import numpy as np
from brute import classes

import __spark_entry__ as contract
import corpus_pipeline
from sheafline.llm import quality_rules, viterbi_scan
from sheafline.session import materialize


def test_registry():
    names = contract.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = docs
    seen = [kept]
    for _, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, kept, sf))
        seen.append(kept)
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    start, rules, good, single, mix = ({r.doc_id: r.text for r in df.collect()} for df in seen[:5])
    judged = quality_rules.judged(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert set(rules) == {r.doc_id for r in judged if r["_q_kept"]}
    clean = [i in good for i in rules if labels.get(i) == 1]
    assert np.mean(clean) > 0.95
    want = classes(sorted(good.items()))
    assert set(single) == {c for _, c in want.values()}
    assert set(mix) <= set(single) and all(start[i] == t for i, t in mix.items())
    last = seen[-1].collect()
    assert len(last) == seen[4].count()
    pieces = viterbi_scan.build(viterbi_scan.read_pieces())
    assert all(r.n_tokens == len(r.ids) and viterbi_scan.decode(pieces, r.ids) == start[r.doc_id] for r in last)


def test_run_is_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "n_tokens", "ids"]
