"""Every operator on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

from lectern.llm import decontaminate, langid, license_scan, ngram_join, pii, quality_classifier, quality_rules, sharding, sp_sampling, token_counts

from .conftest import PROSE, ROWS

N = len(ROWS)


def test_token_counts(spark, edge, empty):
    got = token_counts.count_tokens(edge).collect()
    assert len(got) == N
    assert all(c.tokens == 0 for r in got if r.doc_id in (1, 2) for c in r.counts)
    assert token_counts.count_tokens(empty).collect() == []
    assert token_counts.signed(token_counts.count_tokens(empty), 1).count() == 0


def test_decontamination(edge, empty, items):
    got = decontaminate.matches(edge, items)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == {(d, i, 0) for d in (8, 9, 10, None) for i in (1, 5, None)}
    assert got.count() == 15  # rows of document 8 repeat
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.matches(edge, items.limit(0)).count() == 0
    assert decontaminate.drop_leaky(edge, items).count() == N - 5
    assert decontaminate.drop_leaky(edge, items).columns == edge.columns
    assert decontaminate.drop_leaky(edge, items.limit(0)).count() == N


def test_quality_rules(edge, empty):
    got = quality_rules.verdicts(edge).collect()
    assert len(got) == N
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert [r.n_words for r in got if r.doc_id == 1] == [0]
    assert quality_rules.verdicts(empty).collect() == []
    kept = quality_rules.keep_good(edge)
    assert kept.columns == edge.columns
    assert kept.count() == sum(r.kept for r in got)
    assert quality_rules.keep_good(empty).collect() == []


def test_sampling(edge, empty):
    got = sp_sampling.sample(edge, k=3).collect()
    assert all(r.decoded for r in got)
    assert {r.doc_id for r in got} == {r[0] for r in ROWS if r[1]}
    assert len([r for r in got if r.doc_id == 8]) == 9
    assert len({(r.sample, tuple(r.ids)) for r in got if r.doc_id == 8}) == 6  # repeated rows get equal samples
    assert sp_sampling.sample(empty).collect() == []


def test_language_id(edge, empty):
    from pyspark.sql import functions as F

    langs, model = langid.train(langid.sample_counts(edge, F.lit(True)))
    got = {r.doc_id: r for r in langid.identify(edge, langs, model).collect()}
    assert langid.identify(edge, langs, model).count() == N
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1, 2, 3, 13))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty, langs, model).collect() == []
    none, blank = langid.train(langid.sample_counts(empty, F.lit(True)))
    assert {r.lang_pred for r in langid.identify(edge, none, blank).collect()} == {"und"}


def test_license_scan(edge, empty):
    got = license_scan.scan(edge).collect()
    assert len(got) == N
    assert [(r.n_words, r.labels, r.score, r.first_word) for r in got if r.doc_id == 1] == [(0, "", 0.0, None)]
    assert license_scan.scan(empty).collect() == []


def test_ngram_join(edge, empty):
    got = ngram_join.join(edge).collect()
    assert len(got) == N
    assert {r.component_id for r in got if r.doc_id in (8, 9, 10)} == {8}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {(1, 1), (2, 2), (3, 3)}
    assert all(r.n_shingles == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in got if r.doc_id is None} == {8, None}  # a copy of document 8, and a row without text
    assert ngram_join.join(empty).collect() == []
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns
    # of the rows with PROSE one stays: documents 8 (twice), 9, 10 and one without a doc_id; the other text of document 8 stays
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(r[0]) for r in ROWS if r[0] not in (8, 9, 10, None)), "8", "8", "None"])


def test_quality_classifier(spark, edge, empty):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(8, 1, 0), (9, 1, 0), (12, 0, 0), (12, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    net, prior = quality_classifier.train(edge, labels, F.lit(True))
    got = quality_classifier.score(edge, net, prior).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score(empty, net, prior).collect() == []
    none, p = quality_classifier.train(empty, labels, F.lit(True))
    assert none is None and {r.score for r in quality_classifier.score(edge, none, p).collect()} == {p}


def test_sharding(edge, empty):
    got = sharding.histogram_sort(edge).collect()
    assert len(got) == N
    assert {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert {r.text_crc32 for r in got if r.doc_id in (1, 2)} == {0}
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.histogram_sort(empty).collect() == []


def test_pii(spark, edge, empty):
    got = pii.replaced(edge, "k")
    assert got.columns == [*edge.columns, "_n_entities", "_kinds"]  # edge has columns of these names
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} == {(r[0], r[1]) for r in ROWS}  # nothing personal: unchanged
    assert {(r.n_entities, r.kinds, r._m) for r in rows} == {(7, "own", "own")}
    assert pii.replaced(edge.select("doc_id", "text"), "k").columns == ["doc_id", "text", "n_entities", "kinds"]
    assert got.count() == N
    assert pii.replaced(empty, "k").collect() == []


def test_prose_is_long_enough():
    assert len(PROSE.split()) > 50
