"""The corpus pipeline against a plain version of every stage's decision."""

import corpus_pipeline
from deskflow.llm import decontaminate, language, mixing, simhash_dedup
from deskflow.llm.common import materialize, read_docs
from deskflow.llm.q_corpus import MIX, QUERIES


def test_stages(spark, sf_dir):
    docs = read_docs(spark, sf_dir)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "near-dedup" in names[1]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "test-stage")
        if name != names[-1]:
            assert docs.columns == columns
            kept[name] = (before, {r.doc_id for r in docs.select("doc_id").collect()})
    before, ids = kept[names[0]]
    assert ids == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
    before, ids = kept[names[1]]
    assert ids == {r.component_id for r in simhash_dedup.near_duplicates(before).collect()}
    before, ids = kept[names[2]]
    bench = [(r.item_id, r.text) for r in read_docs(spark, sf_dir, "benchmark").collect()]
    index = decontaminate.ItemIndex(bench, 5)
    assert ids == {r.doc_id for r in before.collect() if not index.matches(r.text, 0.8)}
    before, ids = kept[names[3]]
    assert ids == {r.doc_id for r in mixing.mixed(before, **MIX, weighted=False).collect() if r._mix_sampled}
    assert {r.doc_id for r in docs.collect()} == ids
    assert sum(r.n_tokens for r in docs.collect()) == max(r.start + r.n_tokens for r in docs.collect())


def test_empty_documents(spark, docs, sf_dir):
    empty = docs((1, "a")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.collect() == []


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert language.UNDETERMINED == "und"
