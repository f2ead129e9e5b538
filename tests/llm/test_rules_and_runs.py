"""Periodic runs, importance resampling and quality rules against brute force, SQL and odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memolake import llm
from memolake.llm import periodic, quality_rules, resampling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "a b a b a b a b a b # end", "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "fr"), (5, LONG, "en"), (5, LONG, "en"), (6, "x " * 500, "de"),
    (None, "le chat est sur la table", "fr"), (None, None, None), (8, "same line\nsame line\n\n\nsame line\nother", "en"), (9, "a\x1cb été \u0085 \U0001f600 z z", "fr"),
    (20, "A-B c_d\x0bE1 " * 30, "en"), (21, "A-B c_d\x0bE1 " * 30, "en"), (22, "�$$$ %%% ***", None), (30, "one", "en"),
]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    for name in ("n_words", "runs", "row", "weight", "score", "rank", "m", "w", "stratum", "fold", "cutoffs", "good", "_at", "_out", "collapsed", "level"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def runs_by_hand(w):
    """By definition: each lag, each maximal stretch, no smaller period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[t] == w[t - p] for t in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_definition():
    rng = random.Random(5)
    for _ in range(1500):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.choice([0, 2, 3]) if n > 8 else 0):
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            for i in range(a, a + rng.randrange(n - a + 1)):
                w[i] = w[a + (i - a) % p]
        texts, at, want = [w, [], w[: n // 2], [b"0"] * 7, w[n // 3 :]], 0, []
        for t in texts:
            want += [(s + at, length, q) for s, length, q in runs_by_hand(t)]
            at += len(t)
        assert periodic.runs_of(texts) == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_runs_take_no_quadratic_work():
    assert periodic.runs_of([[b"a"] * 300_000]) == [(0, 300_000, 1)]
    assert periodic.runs_of([[b"%d" % (i % 70_000) for i in range(300_000)]]) == [(0, 300_000, 70_000)]


def digest(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [tuple(r) for r in periodic.runs_of([[x.encode() for x in w]])] if n > 3000 else runs_by_hand(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_op11_by_hand(spark, odd, tmp_path):
    docs = odd.unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 15)).unionByName(odd.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)) + 1000))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = llm.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    want = [digest(r["doc_id"], r["text"]) for r in docs.collect()]
    assert same(map(tuple, got), want) and any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 and r["n_runs"] for r in got)
    assert periodic.collapsed(odd.where("false")).count() == 0
    rows = {r["doc_id"]: r for r in periodic.collapsed(odd).collect()}
    assert rows[1]["collapsed"] == "a b # end" and [tuple(r) for r in rows[1]["runs"]] == [(0, 10, 2)] and rows[6]["collapsed"] == "x" and rows[6]["n_words"] == 500
    by_name = periodic.collapsed(odd.withColumn("doc_id", F.lit("n1"))).first()
    assert by_name["doc_id"] == "n1"


def features(text):
    w = LOW.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def resampled_by_hand(docs, target):
    found = [(d, *features(t)) for d, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x, _ in found for f in x), Counter(bucket(f) for x in target for f in features(x)[0])
    above, below = s.total() + 10_000.0, t.total() + 10_000.0
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * above / ((s[b] + 1) * below)))
    rows = []
    for d, x, n in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in x)
        rows.append([d, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize(("head", "pairs"), [(resampling.HEAD, resampling.PAIRS), (3, 2), (0, 0)])
def test_features_don_t_depend_on_the_vocabulary(spark, odd, head, pairs):
    texts = [t for _, t, _ in TEXTS]
    known = resampling.frequent_vocabulary(resampling.only_text(odd, "text"), head, pairs)
    assert len(known.ids) <= head and len(known.pairs) <= pairs + 1
    bucket, of = resampling.bucketed([resampling.words_of(t or "") for t in texts], known)
    want = Counter((zlib.crc32(f.encode()) % 10_000, i) for i, t in enumerate(texts) for f in features(t)[0])
    assert Counter(zip(bucket.tolist(), of.tolist())) == want


def test_op12_by_hand(spark, odd, tmp_path):
    docs = odd
    for i in range(1, 7):
        docs = docs.unionByName(odd.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)) + 100 * i).withColumn("text", F.concat_ws(" ", "text", F.lit("The quick brown fox " * i * 3))))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    target = ["the quick fox", None, "", "brown fox jumps, quick brown fox", "word1x1 word2x2"]
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = llm.queries()["op12_importance_resampling"](spark, str(tmp_path)).collect()
    want = resampled_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], target)
    assert same((tuple(r)[:4] for r in got), (r[:4] for r in want))
    ranks = lambda rows: sorted((r[4], repr(r[0])) for r in rows if r[4])
    assert ranks(got) == ranks(want) and len(ranks(got)) >= 3
    target = spark.createDataFrame([("fox",)], "text string")
    assert resampling.resampled(docs, target).columns == docs.columns
    for a, b in ((odd.where("false"), target), (odd, target.where("false"))):
        assert resampling.drawn(resampling.weighed(a, b)).count() == a.count()


def measures_by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum("A" <= c <= "Z" for c in text), len(lines), len(lines) - len(set(lines)), len(again)


def test_measures_by_hand(odd):
    got = quality_rules.with_measures(odd).collect()
    assert same((tuple(r)[3:] for r in got), (measures_by_hand(t) for _, t, _ in TEXTS))
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB #\n\t") for _ in range(rng.randrange(80))) for _ in range(500)]
    assert [tuple(r) for r in quality_rules.measured(texts).itertuples(index=False)] == [measures_by_hand(t) for t in texts]


def test_binomial_bounds():
    def exact(k, n, p):
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    for k, n, p in [(0, 1, 0.05), (0, 100, 0.05), (3, 100, 0.05), (40, 100, 0.05), (12, 700, 0.02), (5, 5, 0.3), (0, 0, 0.5)]:
        assert quality_rules.chance(k, n, p) == pytest.approx(exact(k, n, p), rel=1e-9)
    for k, n in [(0, 50), (2, 50), (49, 50), (30, 4000)]:
        assert exact(k, n, quality_rules.upper_bound(k, n, 0.01)) == pytest.approx(0.01, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.01) == quality_rules.upper_bound(0, 0, 0.01) == 1
    assert quality_rules.upper_bound(40_000, 1_000_000, 1e-3) == pytest.approx(0.0406, abs=1e-4)


def labelled_tables(spark, n, noise, seed=1):
    """Documents of two strata with enough labels and one with few; bad ones are symbol-ridden, a share of good ones is too."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
        junk = bad or rng.random() < noise
        rows.append((i, " ".join(w + "$$$" if junk else w for w in words), "few" if i % 100 == 0 else ("a", "b")[i % 2]))
        if i % 4:
            labels.append((i, 0 if bad else 1))
    labels += [(1, 0), (1, 1), (None, 1), (2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_false_rejections_are_limited(spark):
    docs, labels = labelled_tables(spark, 3000, 0.005)
    measures = quality_rules.with_measures(docs)
    sets = quality_rules.thresholds(measures, labels).collect()
    used = {r["stratum"] for r in sets if r["used"]}
    assert used == {"sa", "sb"} and all(r["bound"] <= quality_rules.RISK for r in sets if r["used"])
    kept = {r["doc_id"] for r in quality_rules.judged(docs, labels).where("kept").collect()}
    good = {r["doc_id"]: r["lang"] for r in docs.join(labels.where("quality = 1"), "doc_id").collect()}
    bad = {r["doc_id"]: r["lang"] for r in docs.join(labels.where("quality = 0"), "doc_id").collect()}
    assert all(d in kept for d, s in (good | bad).items() if s == "few")
    for s in "ab":
        assert sum(d not in kept for d, x in good.items() if x == s) <= quality_rules.RISK * sum(x == s for x in good.values())
        assert sum(d not in kept for d, x in bad.items() if x == s) >= 0.9 * sum(x == s for x in bad.values())
    # Where a tenth of the good ones looks like the bad, no set can be certified.
    docs, labels = labelled_tables(spark, 3000, 0.1)
    assert quality_rules.judged(docs, labels).where("not kept").count() == 0


def test_odd_documents_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judged(odd, labels).collect()
    assert len(got) == len(TEXTS) and all(r["kept"] != r["base_failed"] for r in got)
    assert quality_rules.judged(odd.where("false"), labels).count() == 0


@pytest.mark.parametrize("made", [False, True])
def test_op13_matches_sql(spark, tmp_path, made):
    docs, labels = labelled_tables(spark, 2500, 0.004, seed=9)
    labels = labels.withColumn("toxic", F.lit(0))
    if made:
        docs = docs.unionByName(spark.createDataFrame([(d, t, s) for d, t, s in TEXTS], docs.schema))
        labels = labels.where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(llm.oracle_sql()["op13_quality_rules"])
    names = [c[0] for c in cur.description]
    got = llm.queries()["op13_quality_rules"](spark, str(tmp_path)).select(*names).collect()
    assert same(map(tuple, got), cur.fetchall()) and made != any(not r["kept"] and not r["base_failed"] for r in got)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_importance_resampling", "op13_quality_rules"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(llm.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    got = llm.queries()[name](spark, SF).select(*names).collect()
    assert same(map(tuple, got), cur.fetchall())


def test_stretches():
    assert periodic.in_stretches(np.array([1, 2, 3, 7, 8, 11]), 2).tolist() == [True] * 5 + [False]
    assert periodic.in_stretches(np.array([], int), 2).tolist() == []
