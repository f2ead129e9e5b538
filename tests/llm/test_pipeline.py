"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from memolake.llm import mixing
from memolake.llm.packing import vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def five_words(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "12 34", "en", "src0", 5)], docs.schema)
    docs = docs.union(extra)
    frames, columns = [], docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        frames.append(docs.toPandas())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "source_mix", "packing"]
    first, unique, mix, pieces = frames
    whole = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(first.doc_id) == sorted(whole.doc_id)

    sets = {d: five_words(t) for d, t in zip(first.doc_id, first.text)}
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert sorted(unique.doc_id) == [d for d in ids if root[d] == d]

    copies = {r["row"]["doc_id"]: r["copies"] for r in mixing.mixed(spark.read.parquet(str(tmp_path / "1"))).collect()}
    assert Counter(mix.doc_id) == Counter({d: n for d, n in copies.items() if n})

    tok = Tokenizer.from_file(vocabulary())
    size = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in zip(mix.doc_id, mix.text)}
    assert pieces.groupby("doc_id").length.sum().to_dict() == {d: size[d] * n for d, n in Counter(mix.doc_id).items()}
    loads = pieces.groupby("sequence_id").length.sum()
    assert loads.max() <= 4096 and np.all(pieces.sort_values("offset").groupby("sequence_id").offset.first() == 0)


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns through all stages, and an empty table."""
    long = "several words of one long text that stands here twice " * 40
    rows = [(1, "the house and the garden", "en", "a", 3, "x"), (1, "the house and the garden", "en", "a", 3, "x"), (2, long, "en", "a", 1, "y"), (3, long + "end", None, None, 2, "z"), (None, "le jardin et la maison", "fr", "b", 0, "u"), (4, None, None, "b", 0, None), (5, "", "en", None, 0, None), (6, "12 !", "de", "c", 0, None)]
    columns = "doc_id long, text string, lang string, source string, copies int, row string"
    for i, data in enumerate((rows, [])):
        folder = tmp_path / str(i)
        spark.createDataFrame(data, columns).write.parquet(str(folder / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).toPandas()
        assert set(got.doc_id.dropna()) <= {1, 2} and (len(got) > 0) == bool(data)
    docs = spark.read.parquet(str(tmp_path / "0" / "documents.parquet"))
    kept = corpus_pipeline.near_duplicates(spark, docs, "").toPandas()
    assert list(kept.columns) == docs.columns and sorted(kept.doc_id.fillna(-1)) == [-1, 1, 2, 4, 5, 6]
