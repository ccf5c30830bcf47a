"""The pipeline against a brute-force version of its stages."""

import corpus_pipeline
from lectern.llm import decontaminate, pieces, pii, quality_rules
from lectern.llm.queries import SURROGATE_KEY

from .test_brute_force import counts_of, distance_in, groups_of


def test_pipeline(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in quality_rules.verdicts(docs).collect()}
    assert all(verdict[d] <= (counts_of(r.text)[0] >= 50) for d, r in rows.items())
    kept = [(d, r.text) for d, r in rows.items() if verdict[d]]
    groups = groups_of(kept)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]

    def leaky(text):
        plain = decontaminate.normal(text)
        return any(distance_in(t, plain) <= decontaminate.edits(len(t)) for t in items if set(t.split()[:3]) & set(plain.split()) and any(p in plain for _, p in decontaminate.pieces(t, decontaminate.edits(len(t)))))

    want = {d for d, text in kept if groups[d][1] == d and not leaky(text)}
    done = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_join", "decontamination", "pii", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, done, corpus)
        assert sorted(done.columns) == sorted(docs.columns), name
    clean = {r.doc_id: r for r in done.collect()}
    assert set(clean) == want
    replaced = {r.doc_id: r.text for r in pii.replaced(docs.where(docs.doc_id.isin(list(want))), SURROGATE_KEY).collect()}
    assert all(clean[d].n_chars == len(clean[d].text) for d in want)
    assert sum(clean[d].text != rows[d].text for d in want) == sum(replaced[d] != rows[d].text for d in want) > 0
    vocab = pieces.vocabulary(pieces.DEFAULT_MODEL)
    final = corpus_pipeline.run(spark, corpus).collect()
    assert {r.doc_id for r in final} == want
    assert all(vocab.decode(r.ids) == clean[r.doc_id].text for r in final)
    assert len({(r.doc_id, tuple(r.ids)) for r in final}) == len(final)


def test_stages_on_edges(spark, edge, empty, tmp_path):
    edge.limit(0).select("doc_id").withColumnRenamed("doc_id", "item_id").selectExpr("item_id", "cast(null as string) as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, empty):
        done = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, done, str(tmp_path))
            assert done.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, done, str(tmp_path)).collect()
        assert all(r.decoded for r in last) and {r.doc_id for r in last} == {r.doc_id for r in done.collect() if r.text}
