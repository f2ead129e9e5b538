"""The training-data operators against brute force, and on odd input."""

import gzip
import hashlib
import io
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memolake.llm import fingerprints, hashing, jaccard, language, licenses, lm, materialise, mixing, neighbours, packing, tokens, warc
from memolake.llm.common import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "fr", "b"),
    (5, LONG, "en", "a"), (5, LONG, "en", "a"), (6, "Released under the MIT License.", "en", "c"), (7, "123 456", "de", "b"), (None, "le chat est sur la table", "fr", "b"),
    (None, None, None, None), (8, LONG + " more", "en", "a"), (9, "a\x1cb été \U0001f600 z", "fr", "b"), (10, "one two", "en", "a"), (11, "ONE two", "en", None),
]


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    for name in ("size", "row", "n", "sid", "rank", "token", "copies", "range", "at"):
        d = d.withColumn(name, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_hashes_are_those_of_words():
    texts = [t or "" for _, t, _, _ in TEXTS]
    h, at = hashing.words(texts)
    seen = {}
    for i, t in enumerate(texts):
        assert at[i + 1] - at[i] == len(words(t))
        for x, w in zip(h[at[i] : at[i + 1]].tolist(), words(t)):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_mix_follows_targets(odd, none):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == len(TEXTS)
    sizes = {}
    for r in rows:
        assert r["size"] == len(words(r["row"]["text"]))
        sizes[r["row"]["source"]] = r["source_size"]
        assert 0 <= r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] + 1e-9
    total = sum(sizes.values())
    targets = {r["row"]["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    # Water filling by hand: shares by weight until none is above its cap.
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want, open_, rest = {}, set(sizes), float(total)
    while open_:
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not over:
            want |= {s: level * weights[s] for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        open_ -= over
    assert all(abs(want[s] - targets[s]) < 1e-6 for s in sizes)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_takes_near_the_target(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"))
    got = mixing.mixed(d).groupBy("row.source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.03 * r["target"] + 60 for r in got)


def test_licenses(spark, odd, none):
    rows = licenses.licensed(odd).collect()
    assert len(rows) == len(TEXTS)
    assert [(r["labels"], r["n_base"], r["first_word"]) for r in rows if r["doc_id"] == 6] == [("mit", 1, 3)]
    assert all(r["labels"] == "" and r["score"] == 0 for r in rows if r["doc_id"] != 6)
    text = next(t for x, t in licenses.TEMPLATES if x == "mit" and "hereby" in t).replace(" and or sell", " and then or sell").upper()
    more = spark.createDataFrame([(1, f"before {text} after"), (2, text[: len(text) // 3]), (3, "mit license mit license"), (4, "KGPL")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licensed(more).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and got[1]["score"] > 0.6
    assert got[2]["labels"] == "" and (got[3]["n_base"], got[3]["last_word"]) == (2, 2) and got[4]["n_words"] == 1
    assert licenses.licensed(none).count() == 0


def test_license_spans_are_verified(spark):
    bsd = next(t for x, t in licenses.TEMPLATES if x == "bsd").split()
    scattered = " filler ".join(" ".join(bsd[i : i + 3]) for i in range(0, len(bsd), 3))
    apart = " ".join(" ".join(bsd[i : i + 3]) + " x" * 30 for i in range(len(bsd) - 2))
    backwards = " x ".join(" ".join(bsd[i : i + 3]) for i in range(len(bsd) - 3, -1, -3))
    edited = " ".join(bsd[:8] + ["also", "now"] + bsd[8:14] + bsd[15:])
    texts = [scattered, apart, backwards, edited, " ".join(bsd) + " y" * 500 + " " + edited]
    got = {r["doc_id"]: r for r in licenses.licensed(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["", "", "", "bsd", "bsd"] and got[3]["score"] >= 0.6 and got[4]["score"] == 1


def test_notices_of_siblings_are_told_apart(spark):
    """Each notice has its own label only: no other version's, no other license's of the family, none that isn't known."""
    gpl, apache, cc = "This work is licensed under the GNU General Public License version {}", "Licensed under the Apache License, Version {}", "This work is licensed under a Creative Commons {} International License"
    cases = {
        gpl.format(2): "gpl,gpl-2.0", gpl.format(3): "gpl,gpl-3.0", gpl.format(9): "gpl", gpl.replace("is licensed", "is not licensed").format(9): "gpl",
        apache.format("2.0"): "apache,apache-2.0", apache.format("1.1"): "apache", cc.format("Attribution 4.0"): "cc-by-4.0", cc.format("Attribution-ShareAlike 4.0"): "cc-by-sa-4.0",
        cc.format("Attribution-NoDerivs 4.0"): "", cc.format("Attribution 3.0"): "", "licensed under CC BY 4.0": "cc-by,cc-by-4.0", "licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0", "licensed under CC BY 3.0": "cc-by", "licensed under CC BY-ND 4.0": "cc-by",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1": "",
        "Released under the MIT License": "mit",
    }
    for label, text in licenses.TEXTS:
        if label in ("lgpl", "agpl", "gpl", "bsd", "isc", "zlib", "bsl-1.0", "unlicense", "cc0-1.0"):
            cases[text] = label
    after = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
    cases[next(t for x, t in licenses.TEXTS if x == "bsd-3-clause") + after] = "bsd,bsd-3-clause"
    cases[next(t for x, t in licenses.TEXTS if x == "bsd-2-clause").removesuffix(" THIS SOFTWARE IS") + after] = "bsd,bsd-2-clause"
    got = {r["doc_id"]: r["labels"] for r in licenses.licensed(spark.createDataFrame([*enumerate(cases)], "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


@pytest.mark.parametrize("end", ["\u0085", "\u2028", "\u2029"])
def test_license_places_pass_line_ends(spark, end):
    texts = [f"a{end}b c mit license", f"mit license a{end}b", f"mit license {end} x apache license", f"{end} mit license {end} cc by {end} y"]
    got = {r["doc_id"]: r for r in licenses.licensed(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) for i in range(4)] == [(1, 2, 2), (1, 0, 0), (2, 0, 4), (2, 1, 4)]


def test_warc_bytes():
    r = {"refers_to": None, "page_id": 5, "record_type": "response", "payload": b"x\r\n\r\ny" * 3000, "payload_length": 18000, "target_uri": "http://a/ é\n", "payload_digest": "D"}
    again = dict(r, record_type="revisit", refers_to=5, page_id=6, payload=None)
    records = [warc.record_bytes(r), warc.record_bytes(again), warc.record_bytes(dict(r, page_id=None, payload=b"", payload_length=0, target_uri=None))]
    for data, gz in ((b"".join(map(warc.member, records)), True), (b"".join(map(gzip.compress, records)), True), (b"".join(records), False)):
        got = [*warc.records(io.BytesIO(data), gz, [], True)]
        assert [x[0] for x in got] == [5, 6, None] and [x[5] for x in got] == [18000, 18000, 0]
        assert got[0][6] == r["payload"] and got[0][2] == r["target_uri"] and got[1][4] == 5 and got[2][6] == b""
        assert [x[0] for x in warc.records(io.BytesIO(data), gz, [("record_type", {"revisit"})], False)] == [6]
    assert gzip.decompress(b"".join(map(warc.member, records))) == b"".join(records)


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c", ""), (2, "http://b", "same"), (None, "http://d", "same"), (9, "http://e", "é" * 70_000)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(1))
    path = fresh_path(spark, "warc")
    warc.write_warc(warc.as_records(p), path)
    got = warc.read_warc(spark, path).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [(0, "revisit", 1), (1, "response", 0), (2, "revisit", 1), (2, "revisit", 1), (3, "response", 0), (4, "revisit", 3), (9, "response", 0)]
    assert next(bytes(r["payload"]).decode() for r in got if r["page_id"] == 9) == "é" * 70_000
    assert next(r["payload_digest"] for r in got if r["page_id"] == 1) == __import__("base64").b32encode(hashlib.sha1(b"same").digest()).decode()
    plan = warc.read_warc(spark, path, payloads=False).where("record_type = 'revisit'")
    assert plan.count() == 4 and "Filter" not in plan._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    empty = fresh_path(spark, "warc")
    warc.write_warc(warc.as_records(p.where("false")), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_tokens_are_the_librarys():
    t = tokens.tokenizer(packing.vocabulary())
    texts = [x or "" for _, x, _, _ in TEXTS] + ["A.B. İstanbul ΟΔΟΣ. don't DON'T's <|endoftext|> <|ENDOFTEXT|> a b 'S ... !? 12,5.", "x" * 5000]
    assert [list(map(int, a)) for a in t.encode(texts)] == [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_differencing():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 3), (200, 17)):
        sizes = rng.integers(1, 900, n)
        window, largest = packing.differencing(sizes, m)
        loads = np.bincount(window, sizes, m)
        assert loads.max() == largest and loads.sum() == sizes.sum()
        if n == 200:
            assert loads.max() - loads.min() < 0.02 * loads.mean()
    assert np.bincount(packing.share_out(np.array([3000] * 5)), [3000] * 5).max() <= 4096


def test_packing(odd, none):
    tok = Tokenizer.from_file(packing.vocabulary())
    got = packing.packed(odd, packing.vocabulary()).toPandas()
    by_doc = {}
    for d, t, _, _ in TEXTS:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        by_doc.setdefault(d, []).append(ids)
    want = sorted((-1 if d is None else d, s, zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for d, all_ in by_doc.items() for ids in all_ for s in range(0, len(ids), 4096))
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.start, got.ids_crc32, got.doc_tokens)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 4096
    assert packing.packed(none, packing.vocabulary()).count() == 0


def test_fingerprints(odd, none):
    got = fingerprints.fingerprinted(odd).collect()
    rows = sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    edits = sorted((x or "")[: len(x or "") - len(x or "") // 2] + (y or "")[: len(x or "") // 2] for (_, x, _, _), (_, y, _, _) in zip(rows, rows[1:] + rows[:1]))
    assert sorted(r["edited_sha256"] for r in got) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 5}) == 1 and all(0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprints.fingerprinted(none).count() == 0


def test_fingerprints_against_sets(spark):
    """Of texts with few shingles the sketch holds all, so likeness is that of the sets."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, n)) for n in (0, 1, 4, 5, 30, 60, 60)] + ["a b c d e f g"] * 2
    got = {r["doc_id"]: r for r in fingerprints.fingerprinted(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    alike = lambda a, b: 1.0 if a == b else len(a & b) / max(len(a | b), 1)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, other, next_one = (shingle_set(x, fingerprints.SHINGLE) for x in (t, edit, after))
        assert got[i]["n_chars"] == len(t)
        if own and other:
            assert abs(got[i]["near_edited"] - alike(own, other)) < 1e-9
        if own and next_one:
            assert abs(got[i]["near_next"] - alike(own, next_one)) < 1e-9


def test_sketches_estimate_and_merge(spark):
    a, b = " ".join(f"u{i}" for i in range(3000)), " ".join(f"u{i}" for i in range(1000, 5000))
    x, y = fingerprints.sketches([a, b])
    j, c = fingerprints.compared(x, y)
    assert abs(j - 2000 / 5000) < 0.15 and abs(c - 2000 / 3000) < 0.2 and abs(fingerprints.distinct(x) - 2996) < 900
    d = fingerprints.with_sketch(spark.createDataFrame([(1, a), (1, b), (2, a), (2, None)], "g long, text string"))
    merged = {r["g"]: r["sketch"] for r in fingerprints.merged_sketches(d, ["g"]).collect()}
    assert merged[2] == x.astype(np.int64).tolist()
    assert merged[1] == np.union1d(x, y)[: fingerprints.K].astype(np.int64).tolist()
    both = fingerprints.compare_sketches(d.select("sketch", F.col("sketch").alias("again")), "sketch", "again").collect()
    assert all(r["resemblance"] == 1 for r in both)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, odd, none, n, percent):
    rng = np.random.default_rng(n)
    base = [f"t{i}" for i in rng.integers(0, 300, 120)]
    docs = [(d, t) for d, t, _, _ in TEXTS]
    for i in range(60):
        copy = [*base]
        for _ in range(rng.integers(0, 4)):
            copy[rng.integers(0, 120)] = f"new{i}"
        docs.append((100 + i, " ".join(copy)))
    docs += [(300 + i, " ".join(f"p{j}" for j in range(i, i + 60))) for i in range(0, 20)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1))
    sets = [shingle_set(t, n) for _, t in docs]
    group = [*range(len(docs))]
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = []
    for (doc, _), g, s in zip(docs, group, sets):
        ids = [docs[k][0] for k in range(len(docs)) if group[k] == g and docs[k][0] is not None]
        want.append((-1 if doc is None else doc, len(s), (doc if doc is not None else -1) if not s else min(ids, default=-1)))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in jaccard.linked(d, words=n, percent=percent).collect()]
    assert sorted(got) == sorted(want)
    assert jaccard.linked(none).count() == 0


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(11)
    ids = rng.permutation(1 << 20)[:4000].tolist()  # as set identities are: no order along the chain
    links = [(ids[i], ids[i + 1]) for i in range(2999)] + [(ids[i], ids[i + j]) for i in range(3000, 3997) for j in (1, 2, 3)]
    got = jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()
    low, high = min(ids[:3000]), min(ids[3000:])
    assert {r["node"]: r["root"] for r in got} == {x: low if i < 3000 else high for i, x in enumerate(ids)} and len(got) == 4000


def test_one_of_each(odd):
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(odd).collect()]
    assert kept.count((5, LONG)) == 1 and not [k for k in kept if k[0] == 8] and (2, None) in kept and (1, TEXTS[0][1]) in kept
    assert jaccard.one_of_each(odd).columns == odd.columns


def test_language(spark, odd, none):
    en, fr = "the house and the garden with the people who were there", "la maison et le jardin avec les gens qui étaient là"
    train = spark.createDataFrame([(i, f"{t} {i}", x) for i in range(40) for t, x in ((en, "en"), (fr, "fr"))] + [(99, None, "en"), (None, "x", None), (5, "", "fr")], "doc_id long, text string, lang string")
    model = language.learned(train)
    assert model.languages == ["en", "fr"]
    texts = [(1, "the people and the garden"), (2, "les gens et la maison"), (3, " ".join([en] * 3 + [fr] * 4)), (4, None), (5, "12 &"), (6, "")]
    got = {r["doc_id"]: r["language"] for r in language.with_language(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "fr", "fr", "und", "und", "und"]
    assert [s["lang"] for s in got[3]["spans"]] == ["en", "fr"] and sum(s["n_words"] for s in got[3]["spans"]) == len(texts[2][1].split())
    assert language.recognised(odd).columns == odd.columns and language.recognised(none).count() == 0
    kept = {r["doc_id"] for r in language.recognised(odd).collect()}
    assert {1, 5, 6, 8} <= kept and not {2, 3, 4, 7} & kept


def best_path(s, switch):
    """Step by step, without a shortcut."""
    v, back = s[0].astype(float), []
    for row in s[1:]:
        ways = v[:, None] - switch * (1 - np.eye(len(v)))
        back.append(ways.argmax(0))
        v = ways.max(0) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    worth = lambda s, p, x: sum(s[t, k] for t, k in enumerate(p)) - x * sum(a != b for a, b in zip(p, p[1:]))
    cases = [(rng.normal(0, 4, (n, k)), x) for n, k, x, times in ((6, 3, 5.0, 1500), (6, 3, 10.0, 1500), (25, 4, 10.0, 1000), (1, 2, 5.0, 20)) for _ in range(times)]
    for s, x in [*cases, (np.array([[0, 9, -10], [0, -10, 9.0]]), 10.0), (np.array([[0, 4, -5], [0, -5, 4.0]]), 5.0)]:
        assert abs(worth(s, language.viterbi(s, x), x) - worth(s, best_path(s, x), x)) < 1e-9


def test_letters_are_unicode_letters(spark):
    train = spark.createDataFrame([(i, t, x) for i in range(3) for t, x in (("the house", "en"), ("la maison", "fr"))], "doc_id long, text string, lang string")
    d = spark.createDataFrame([(1, "½²Ⅷ ١٢ _ \u0301"), (2, "½a"), (3, "日本"), (4, "\u2028"), (5, "İ")], "doc_id long, text string")
    got = {r["doc_id"]: r["language"]["lang_pred"] for r in language.with_language(d, language.learned(train)).collect()}
    assert [got[i] == "und" for i in range(1, 6)] == [True, False, False, True, False]


def test_language_query_against_brute_force(spark):
    """All columns of the query, by dense tables and the step-by-step search, and accuracy on held-out rows."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    letters = lambda w: "".join(c for c in w.lower() if unicodedata.category(c)[0] == "L")
    grams = lambda w: [f"<{w}>"[i : i + 3] for i in range(len(w))]
    part = [zlib.crc32(str(d).encode()) % 3 for d in docs.doc_id]
    counts = {}
    for d, t, x in {(d, t, x) for d, t, x, p in zip(docs.doc_id, docs.text, docs.lang, part) if p != 1 and t is not None and x is not None}:
        c = counts.setdefault(x, {})
        for w in map(letters, t.split()):
            for g in grams(w):
                c[g] = c.get(g, 0) + 1
    names = sorted(counts)
    assert all(len(c) < language.TRIGRAMS for c in counts.values())
    every = {g for c in counts.values() for g in c}
    total = [sum(counts[x].values()) + 0.5 * (len(every) + 1) for x in names]
    of_word = {}

    def row(w):
        if w not in of_word:
            of_word[w] = [sum(np.log((counts[x].get(g, 0) + 0.5) / n) for g in grams(w)) for x, n in zip(names, total)]
        return of_word[w]

    got = {r["doc_id"]: r for r in language.op6_language_id(spark, sf).collect()}
    assert sorted(got) == sorted(docs.doc_id)
    right = held = 0
    for d, t, x, p in zip(docs.doc_id, docs.text, docs.lang, part):
        r = got[d]
        assert r["held_out"] == (p == 1)
        ws = [letters(w) for w in (t or "").split()]
        if not any(ws):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        s = np.array([row(w) for w in ws])
        path = best_path(s, language.SWITCH)
        share = [sum(len(w) for w, k in zip(ws, path) if k == j) for j in range(len(names))]
        best = int(np.argmax(share))
        own = sum(s[i] for i, k in enumerate(path) if k == best)
        lead = min(min([own[best] - own[j] for j in range(len(names)) if j != best], default=50.0) / share[best], 4)
        want = share[best] / sum(share) / (1 + np.exp(-8 * max(lead, -4)))
        assert r["lang_pred"] == names[best] and abs(r["score"] - want) < 1e-3
        if p == 1 and x is not None:
            held += 1
            right += r["lang_pred"] == x
    assert held > 100 and right >= 0.97 * held


def test_lm_base_scores(spark, odd, none):
    docs = odd.select("doc_id", "text")
    counts, frequent, w = lm.fitted(docs)
    got = lm.scored(docs, counts, frequent, w).collect()
    c = {}
    for _, t, _, _ in TEXTS:
        for x in [*words(t), None]:
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    want = sorted((len(words(t)) + 1, round(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*words(t), None]), 6)) for _, t, _, _ in TEXTS)
    assert sorted((r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["n_known"] == r["n_tokens"] and r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm.scored(none.select("doc_id", "text"), counts, frequent, w).count() == 0
    fresh = lm.scored(docs, *lm.fitted(none.select("doc_id", "text")))
    assert all(r["n_known"] == 0 for r in fresh.collect())


def test_lm_scores_against_brute_force(spark):
    """Counts, base and model score of all rows, held out or not, word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-7, "zzz unseen zzz"), (-8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts, frequent, w = lm.fitted(d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1))
    c = {}
    for t in train:
        for x in [*words(t), None]:
            c[x] = c.get(x, 0) + 1
    total, distinct = sum(c.values()), len(c)
    key = lambda x: int(lm.END) if x is None else int(hashing.words([x])[0][0])
    place = {int(h): i for i, h in enumerate(frequent.words)}
    last = len(frequent.class_log) - 1
    rare = {x: n for x, n in c.items() if key(x) not in place}
    mass = np.bincount([frequent.classes[place[key(x)]] for x in c if x not in rare], [n for x, n in c.items() if x not in rare], last + 1)
    ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
    off = (ones + 0.5) / (ones + 2 * twos + 1.0)
    got = {r["doc_id"]: r for r in lm.scored(d, counts, frequent, w).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        seq = [*words(t), None]
        base = sum(np.log10((c.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in seq)
        h, at = lm.tokens([t or ""])
        score = 0.0
        for x, f in zip(seq, lm.features(h, at)):
            z = sum(w[b].astype(float) for b in f) + frequent.class_log
            p = np.exp(z - z.max())
            y = frequent.classes[place[key(x)]] if x in c and x not in rare else last
            inside = c[x] / mass[y] if x in c and x not in rare else (rare[x] - off if x in rare else off * len(rare)) / sum(rare.values())
            score += np.log10(p[y] / p.sum() * inside)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(seq), sum(x in c for x in seq), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and abs(r["score"] - score) < 1e-3 * max(1, abs(score))


def test_lm_probabilities_sum_to_one(spark):
    texts = [f"the {a} {b} the end of {a}" for a in ("cat", "dog", "owl") for b in ("runs", "sits", f"once{a}", f"twice{a}")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts, frequent, w = lm.fitted(docs)
    last = len(frequent.class_log) - 1
    in_class = np.bincount(frequent.classes, np.exp(frequent.log_share), last + 1)
    assert np.allclose(in_class[np.unique(frequent.classes)], 1)
    rare = [r["c"] for r in counts.collect() if r["c"] < lm.MIN_COUNT]
    d = frequent.discount
    assert abs(sum((x - d) / frequent.rare_total for x in rare) + d * frequent.rare_distinct / frequent.rare_total - 1) < 1e-9
    h, at = lm.tokens(["the cat runs"])
    assert np.allclose(np.exp(lm.log_softmax(lm.features(h, at), w, frequent.class_log)).sum(1), 1, atol=1e-5)


def test_feistel_permutes():
    for n in (1, 2, 3, 100, 1023, 1025, 5000):
        assert sorted(materialise.feistel(np.arange(n), n)) == [*range(n)]


def test_materialised_round_trip(spark, odd, none):
    path, folder = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), fresh_path(spark, "shards")
    index = materialise.materialised(odd, path, folder, end_id=50256, length=64, per_shard=32, pattern=public_tokenizers.PATTERN)
    rows = index.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == [*range(len(rows))]
    seqs = [*materialise.read_sequences(index, folder, 0, len(rows), length=64, per_shard=32)]
    assert [zlib.crc32(s.tobytes()) for s in seqs] == [r["ids_crc32"] for r in rows]
    assert [x.tolist() for x in materialise.read_sequences(index, folder, 40, 50, length=64, per_shard=32)] == [s.tolist() for s in seqs[40:90]]
    encoding = tokens.tokenizer(path, public_tokenizers.PATTERN).encoding
    total = sum(len(encoding.encode_ordinary(t or "")) + 1 for _, t, _, _ in TEXTS)
    assert sum(r["n_tokens"] for r in rows) == total
    assert materialise.materialised(none, path, fresh_path(spark, "shards"), end_id=50256, pattern=public_tokenizers.PATTERN).count() == 0


def test_slots_hold_the_streams_sequences(spark):
    """Slot feistel(i) has the i-th sequence of the one task's stream of ids, and names its documents."""
    path, folder = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), fresh_path(spark, "shards")
    texts = [f"document {i} " + "some words " * (i % 23) for i in range(50)]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    index = materialise.materialised(d, path, folder, end_id=50256, length=32, per_shard=8, pattern=public_tokenizers.PATTERN)
    encoding = tokens.tokenizer(path, public_tokenizers.PATTERN).encoding
    stream, of = [], []
    for i, t in enumerate(texts):
        ids = [*encoding.encode_ordinary(t), 50256]
        stream += ids
        of += [i] * len(ids)
    n = -(-len(stream) // 32)
    slots = materialise.feistel(np.arange(n), n)
    rows = {r["slot"]: r for r in index.collect()}
    seqs = [*materialise.read_sequences(index, folder, 0, n, length=32, per_shard=8)]
    assert sorted(rows) == [*range(n)]
    for i, slot in enumerate(slots.tolist()):
        want = stream[32 * i : 32 * i + 32]
        assert seqs[slot].tolist() == want + [50256] * (32 - len(want)) and rows[slot]["n_tokens"] == len(want)
        assert rows[slot]["doc_ids"] == sorted(set(of[32 * i : 32 * i + 32]))
    with pytest.raises(Exception, match="doesn't fit"):
        materialise.materialised(d, path, fresh_path(spark, "shards"), end_id=70000, pattern=public_tokenizers.PATTERN).count()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[1000:1200] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [1.0] * 3), (2005, []), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = {}
    for r in neighbours.nearest(d, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in range(0, 1500, 20)}
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        s = x @ x[q]
        s[q] = -np.inf
        assert len(rs) == 20 and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in rs)
        assert [(-round(r["score"], 9), r["vec_id"]) for r in rs] == sorted((-round(r["score"], 9), r["vec_id"]) for r in rs)
        hits += len({r["vec_id"] for r in rs} & {int(i) for i in np.lexsort((np.arange(1500), -s))[:20]})
    assert hits >= 0.9 * 20 * len(got)
    few = neighbours.nearest(d.where("vec_id < 5"), lambda i: i % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(d.where("false"), lambda i: i % 20 == 0).count() == 0
    assert neighbours.nearest(d.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


def test_nearest_in_dense_and_sparse_places(spark):
    """Most rows in tight clusters, the others spread: both kinds of queries find their neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    x = np.concatenate([np.repeat(centres, 80, 0) + 0.02 * rng.standard_normal((3200, 24)), rng.standard_normal((800, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(4000)]
    spread = (np.sort(x @ x.T, axis=1)[:, -21] < 0.95)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(d, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    share = {True: [], False: []}
    for q in range(0, 4000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = np.argsort(-score, kind="stable")[:20]
        share[bool(spread[q])].append(len(set(want.tolist()) & set(got[q])) / 20)
    assert np.mean(share[True]) >= 0.9 and np.mean(share[False]) >= 0.9 and len(share[True]) > 20


def test_probes_come_in_falling_order():
    rng = np.random.default_rng(2)
    tables = neighbours.Tables(9, 5)
    q, cosine = rng.standard_normal((20, 9)), rng.uniform(0.2, 0.9, 20)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    inside = tables.chances(q, 0, cosine)
    for chances, buckets in zip(inside, tables.probes(q, 0, cosine, 0.8)):
        product = lambda b: np.prod([chances[j, int(b) // neighbours.INTERVALS**j % neighbours.INTERVALS] for j in range(5)])
        by_heap = neighbours.visited(chances, 0.8)
        assert len(by_heap) == len(buckets) and np.allclose([product(b) for b in by_heap], [product(b) for b in buckets])
    assert neighbours.visited(np.full((10, 4), 0.25), 0.9) is None


def test_nearest_of_repeated_ids_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [float(i % 3), 1.0]) for i in range(1, 400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(d, lambda i: i == 0, k=20).collect()
    assert len(got) == 40 and all(r["vec_id"] != 0 for r in got)
    twos = [i for i in range(1, 400) if i % 3 == 2][:20]
    lists = sorted((r["score"], r["rank"], r["vec_id"]) for r in got)
    assert [v for s, _, v in lists if s == 2.0] == twos and [v for s, _, v in lists if s == 1.0] == [*range(1, 21)]
