"""Grep against brute force on small input."""

import re

import numpy as np

from memolake.operators import index, lexical


def test_grep_makes_no_row_for_a_query_and_a_document(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DOC_BLOCK", 16)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    made = lambda n, k: [" ".join("".join(rng.choice(list("abcd"), int(rng.integers(2, 5)))) for _ in range(k)) for _ in range(n)]
    texts, asked = made(70, 12), [*made(20, 3), "zzzz", ""]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    queries = spark.createDataFrame([(100 + i, t) for i, t in enumerate(asked)], "qid long, text string")
    posted = index.postings(docs, weights={"text": 1.0})
    out = lexical.grep(queries, posted, index.terms(posted))
    want = {100 + i: sum(any(w in t for w in q.split()) for t in texts) for i, q in enumerate(asked)}
    assert {r["qid"]: r["files"] for r in out.collect()} == want and max(want.values()) > 16
    plan = re.sub("#[0-9]+L?", "", out._jdf.queryExecution().toString())
    assert "hashpartitioning(qid" in plan and "hashpartitioning(qid, doc_id" not in plan
