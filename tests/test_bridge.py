"""The bridge from Hangul words to Latin terms against a comparison of all with all."""

import itertools
import random
import re

from pyspark.sql import functions as F

from memolake.operators import bridge
from memolake.plans import bridging

SPELLINGS = [("플랜", "plan"), ("커밋", "comit"), ("링크드인", "linkdin"), ("픽시", "pixy"), ("빠떼리", "pateri"), ("액션", "action"), ("메시지", "mesige"), ("슬랙", "slack"), ("세션", "sesion"), ("도메인", "domein")]


def test_spellings(spark):
    for word, spelling in SPELLINGS:
        assert spelling in bridge.romanised(word), (word, spelling)
    assert bridge.romanised("") == bridge.romanised("abc") == bridge.romanised("가b") == []
    for word in ("가나", "쿼리", "인스타그램"):
        got = bridge.romanised(word)
        assert len(got) <= 120 and len(set(got)) == len(got) and [len(x) for x in got] == sorted(len(x) for x in got)
    # Of few ways all are there: every choice of initial, vowel and final.
    ways = ["".join(x) for x in itertools.product(["n"], ["a"], [""], ["g", "k"], ["a"], ["", ""])]
    assert set(ways) <= set(bridge.romanised("나가"))
    d = spark.createDataFrame([("세션",), ("세션",), (None,), ("word",), ("",)], "word string")
    rows = bridge.romanisations(d).orderBy("place").collect()
    assert [r["spelling"] for r in rows] == bridge.romanised("세션")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def key(w):
    w = re.sub("[^a-z]|[aeiouy]", "", w).translate(str.maketrans("cqlfv", "kkrpb"))
    return re.sub(r"(.)\1+", r"\1", w)


def follows(spelling, term):
    bones, i = [c for c in spelling if c not in "aeiouy"], 0
    for c in term:
        if i < len(bones) and (c == bones[i] or c + bones[i] in bridge.ALIKE):
            i += 1
    return bool(bones) and i >= len(bones) - (len(bones) >= 4)


def by_hand(words, docs, n_docs):
    """All words against all terms; docs: {term: set of documents}."""
    most, out = max(3, int(n_docs * 0.35)), {}
    usable = {t: len(d) for t, d in docs.items() if 2 <= len(d) <= most}
    for w in words:
        n, found = len(w), bridge.romanised(w)
        if n < 2 or not found:
            continue
        fits = [t for t in sorted(usable) if int(n * (1.5 if n >= 3 else 2.0)) <= len(t) <= int(n * 4.5) + 1]
        tries = sorted((t for t in fits if t in found), key=lambda t: (-usable[t], found.index(t)))[:1]
        probes = [c for c in found[:24] if len(c) >= 4]
        near = [t for t in fits if any(c[:2] == t[:2] and edits(c, t) <= (1 if len(c) <= 6 else 2) and follows(c, t) for c in probes)]
        tries += sorted(near, key=lambda t: -usable[t])[:1]
        keys = {key(c) for c in probes if len(key(c)) >= 3}
        boned = {t: key(t) for t in fits if re.fullmatch("[a-z]+", t) and len(key(t)) >= 3}
        first = lambda ts: sorted(ts, key=lambda t: -usable[t])[:5]
        if n >= 3:
            tries += first(t for t in boned if boned[t] in keys)
        if n >= 5:
            wide = keys | {k[:i] + k[i + 1 :] for k in keys for i in range(len(k))} | {k[:i] + c + k[i:] for k in keys for i in range(len(k) + 1) for c in bridge.CONSONANTS}
            tries += first(t for t in boned if boned[t] in wide)
        grams = [w[i : i + k] for k in (2, 3) for i in range(n - k + 1)]
        held = [docs[g] for g in grams if g in docs]
        mine = set.intersection(*held) if held else set()
        for t in tries:
            both = len(mine & docs[t])
            if both and both / len(mine) >= 0.12 and both / len(mine) / (len(docs[t]) / n_docs) >= 1.2:
                out[w] = (t, len(mine), both)
                break
    return out


def test_bridge_by_hand(spark):
    rng = random.Random(4)
    loans = {"세션": "session", "도메인": "domain", "프로젝트": "project", "테라폼": "terraform", "커밋": "commit", "타임아웃": "timeout", "링크드인": "linkedin", "리베이스": "rebase", "인스타그램": "instagram", "임베딩": "embedding"}
    native = ["그리고", "항상", "해서", "경우", "가나다라마", "다시"]
    noise = ["hangs", "gyeon", "hash", "sesion", "comet", "dashed", "projekt", "demain", "the", "linked", "insta", "grams", "terafom"] + ["".join(rng.choice("abdegiklmnorst") for _ in range(rng.randrange(3, 10))) for _ in range(150)]
    n_docs, docs = 200, {}
    for i in range(n_docs):
        words = set(rng.sample(noise, 12)) | {rng.choice(native)}
        for ko, en in loans.items():
            if rng.random() < 0.06:
                words |= {ko, en} if rng.random() < 0.7 else {rng.choice([ko, en])}
        for w in words:
            for t in [w[j : j + k] for k in (2, 3) for j in range(len(w) - k + 1)] if w[0] >= "가" else [w]:
                docs.setdefault(t, set()).add(i)
    posted = spark.createDataFrame([(d, t) for t, ds in docs.items() for d in ds], "doc_id long, term string")
    terms = posted.groupBy("term").agg(F.count("*").alias("df"))
    words = [*loans, *native, "가", "word", ""]
    got = bridge.bridged(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), posted, terms, n_docs).collect()
    want = by_hand(words, docs, n_docs)
    assert {r["word"]: (r["term"], r["docs"], r["together"]) for r in got} == want
    assert sum(want.get(k, ("",))[0] == v for k, v in loans.items()) >= 6


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = bridging.spelled(spark, sf).collect()
    words = {w for r in docs for w in r["hangul"]}
    got = bridging.QUERIES["t11_romanised"](spark, sf).collect()
    assert sorted((r["word"], r["place"], r["spelling"]) for r in got) == sorted((w, i, s) for w in words for i, s in enumerate(bridge.romanised(w)))
    from memolake.operators import index

    held = {}
    for r in index.postings(bridging.spelled(spark, sf)).select("doc_id", "term").collect():
        held.setdefault(r["term"], set()).add(r["doc_id"])
    want = by_hand({w for r in docs if r["doc_id"] % 2 == 0 for w in r["hangul"]}, held, len(docs))
    got = bridging.QUERIES["m6_bridged"](spark, sf).collect()
    assert {r["word"]: (r["term"], r["docs"], r["together"]) for r in got} == want and want
