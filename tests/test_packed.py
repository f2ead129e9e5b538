"""Rows that are packed before they are dealt."""

import numpy as np
import pyarrow as pa

from memolake.operators import index, learn, lexical


def test_grep_deals_packed_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOC_BLOCK", 16)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    dealt = []
    monkeypatch.setattr(lexical, "packed", lambda *a, put=lexical.packed: dealt.append(put(*a)) or dealt[-1])
    rng = np.random.default_rng(5)
    made = lambda n, k: [" ".join("".join(rng.choice(list("bcdfg"), int(rng.integers(2, 6)))) for _ in range(k)) for _ in range(n)]
    texts, asked = [*made(90, 30), None, "", "山 x"], [*made(30, 2), "zzzz", "the", None, "山"]
    rows = [*enumerate(texts), (3, "ffff gggg"), (None, "bcdf")]  # an id of two rows, and none
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*enumerate(asked)], "qid long, text string")
    got = {r["qid"]: r["files"] for r in lexical.grep_words(queries, index.document_words(docs), docs.count()).collect()}
    holds = lambda q, t: any(w in (t or "") for w in (q or "").split() if w != "the")
    assert got == {i: len({d for d, t in rows if d is not None and holds(q, t)}) for i, q in enumerate(asked)} and max(got.values()) > 16
    # Six blocks and five parts: a row for each block of a task, none for a posting, or for a word and a term.
    data, q = (d.drop("part", "block").distinct().count() for d in dealt)
    assert data <= 6 * 4 and q <= 5 * 4


def test_ranking_goes_on_from_block_to_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    made = lambda n, k: [" ".join(f"w{int(x)}" for x in rng.zipf(1.2, k) if x < 90) for _ in range(n)]
    docs = spark.createDataFrame([*enumerate(made(400, 25))], "doc_id long, text string")
    queries = spark.createDataFrame([*enumerate([*made(25, 6), "w1 w2 w3 w80", "w1"])], "qid long, text string")
    posted = index.postings(docs, weights={"text": 1.0})
    terms, lengths = index.terms(posted), index.doc_lengths(docs, posted)
    stats = index.corpus_stats(lengths, terms)
    each = lexical.chosen_words(lexical.own_terms(queries), terms, stats)[0].cache()
    rows = lambda d: [(r["qid"], -round(r["score"], 6), r["doc_id"], r["held"]) for r in d.collect()]
    want: dict = {}
    for r in sorted(rows(lexical.scored(each, posted, lengths, stats, None))):
        want.setdefault(r[0], []).append(r)
    monkeypatch.setattr(lexical, "DOC_BLOCK", 16)
    dealt = []
    monkeypatch.setattr(lexical, "packed", lambda *a, put=lexical.packed: dealt.append(put(*a)) or dealt[-1])
    got: dict = {}
    for r in sorted(rows(lexical.scored(each, posted, lengths, stats, 5))):
        got.setdefault(r[0], []).append(r)
    assert {q: r[:5] for q, r in got.items()} == {q: r[:5] for q, r in want.items()} and len(want) > 20
    # 26 blocks in four groups: a query has its first five of each group, and postings are dealt packed.
    assert max(map(len, got.values())) <= 5 * 4 and all("rows" in d.columns for d in dealt) and len(dealt) == 3
    high = lexical.scored(each, posted, lengths, stats, None, 3.0)
    assert sorted(rows(high)) == sorted(r for w in want.values() for r in w if -r[1] >= 3.0)


def test_steps_come_back_in_slices(spark):
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 1 << int(k), int(n)) for k, n in zip(rng.integers(1, 40, 50), rng.integers(1, 300, 50))]
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(rows)], "i long, n array<long>").coalesce(1)
    packed = pa.array([r["s"] for r in df.select("i", learn.steps("n").alias("s")).orderBy("i").collect()], pa.binary())
    for some in (packed, packed.slice(7, 20)):
        got = [part for _, _, sizes, n in learn.walked(some, 500) for part in np.split(n, sizes.cumsum()[:-1])]
        assert [x.tolist() for x in got] == [np.unique(r).tolist() for r in (rows if len(some) == 50 else rows[7:27])]
    assert sum(map(len, packed.to_pylist())) < sum(8 * len(np.unique(r)) for r in rows)


def test_synonyms_send_documents_of_the_same_words_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}x" for x in rng.zipf(1.3, 30) if x < 300) for _ in range(60)]
    texts += ["alpha beta gamma delta"] * 20 + texts[:5] * 3
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    posted = index.postings(docs, weights={"text": 1.0})
    n = spark.createDataFrame([(len(texts),)], "n_docs long")
    sent = []
    monkeypatch.setattr(learn, "steps", lambda c, put=learn.steps: sent.append(c) or put(c))
    out = learn.corpus_synonyms(posted, index.terms(posted), n, dst_share=0.3, lift=2.0)
    of: dict = {}
    for i, t in enumerate(texts):
        for w in t.split():
            of.setdefault(w, set()).add(i)
    held = lambda a, b: (k := len(of[a] & of[b])) >= 3 and k / len(of[a]) >= 0.6 and k / len(of[a]) / (len(of[b]) / len(texts)) >= 2 and a not in b and b not in a
    want = {(a, b, len(of[a] & of[b])) for a in of for b in of if 3 <= len(of[a]) <= 60 and 3 <= len(of[b]) <= max(3, int(len(texts) * 0.3)) and len(of[b]) <= len(texts) / 2 and held(a, b)}
    got = {tuple(r) for r in out.collect()}
    assert got == want and len(got) > 20 and ("alpha", "beta", 20) in got and sent
    some = learn.corpus_synonyms(posted, index.terms(posted), n, dst_share=0.3, lift=2.0, only=spark.createDataFrame([("alpha",), ("w9x",), ("nowhere",)], "term string"))
    assert {tuple(r) for r in some.collect()} == {r for r in want if r[0] in ("alpha", "w9x")}
