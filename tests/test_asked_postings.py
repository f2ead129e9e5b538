"""Readers of the index deal only the postings that they ask for."""

from memolake.operators import index, learn, lexical


def corpus(spark):
    texts = ["alpha beta gamma", "alpha beta delta", "alpha beta", "gamma delta", "delta epsilon", *["noise zeta"] * 12]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    posted = index.postings(docs, weights={"text": 1.0})
    return docs, posted, index.terms(posted)


def test_synonyms_deal_only_postings_of_their_pairs(spark, monkeypatch):
    _, posted, terms = corpus(spark)
    kept = []
    monkeypatch.setattr(learn, "staged", lambda d, name, put=learn.staged: kept.append(put(d, name)) or kept[-1])
    rows = lambda *r: spark.createDataFrame(r, "qid long, word string")
    got = learn.observed_synonyms(rows((1, "alpha"), (2, "alpha"), (3, "delta")), rows((1, "beta"), (2, "beta"), (2, "gamma"), (3, "epsilon")), posted, terms, 17)
    assert [tuple(r) for r in got.collect()] == [("alpha", "beta", 2)]
    assert [t for t in kept if set(t.columns) == {"src", "doc_id"} and t.count() == 3]  # alpha's alone


def test_ranking_leaves_out_other_terms_first(spark, monkeypatch):
    docs, posted, terms = corpus(spark)
    asked = []
    monkeypatch.setattr(lexical, "little", lambda d, n, of=lexical.little: asked.append(d) or of(d, n))
    lengths = index.doc_lengths(docs, posted)
    queries = spark.createDataFrame([(1, "alpha epsilon")], "qid long, text string")
    each = lexical.chosen_words(lexical.own_terms(queries), terms, index.corpus_stats(lengths, terms))[0]
    got = lexical.scored(each, posted, lengths, index.corpus_stats(lengths, terms), 10).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 4}
    assert {r["term"] for d in asked if d.columns == ["term"] for r in d.collect()} == {"alpha", "epsilon"}
