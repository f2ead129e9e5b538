"""Rare terms out of packed postings."""

import numpy as np

from memolake.operators import graph, index
from pyspark.sql import functions as F


def test_frequent_terms_are_left_out_before_they_are_unpacked(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 12) if x < 400) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(7)
    packed = index.packed_postings(docs, weights={"text": 1.0})
    posted = index.unpacked(packed)
    some, terms = index.few(packed, 3), index.terms(posted)
    rows = lambda d: {tuple(r) for r in d.collect()}
    got = rows(graph.shared_rare(some, terms))
    of: dict = {}
    for r in posted.collect():
        of.setdefault(r["term"], []).append(r["doc_id"])
    want: dict = {}
    for ids in of.values():
        for p in [(a, b) for a in ids for b in ids if a < b] if len(ids) in (2, 3) else []:
            want[p] = want.get(p, 0) + 1
    assert got == {(a, b, n) for (a, b), n in want.items()} and len(got) > 10
    assert not some.groupBy("term").count().where("count > 21").count() and posted.groupBy("term").count().agg(F.max("count")).first()[0] > 21
