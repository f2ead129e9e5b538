"""Operators that SQL can't express, against brute force on small input."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from memolake.operators import evaluate, index, learn, parse, passages, records, shrink, signals
from memolake.plans import measures
from memolake.streaming import sessions

SF = "/root/testdata/sf0.001"


def random_case(rng):
    text = "".join(rng.choice(list("ab cd "), 60))
    words = [(float(rng.integers(1, 9)), list(dict.fromkeys("".join(rng.choice(list("abcd"), rng.integers(1, 3))) for _ in range(2)))) for _ in range(3)]
    return text, words


def test_worth_of_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text, words = random_case(rng)
        at = [[i for g in gs for i in range(len(text)) if text.startswith(g, i)] for _, gs in words]
        want = max((sum(w for (w, _), a in zip(words, at) if any(e - 7 <= i <= e for i in a)) for a in at for e in a), default=0.0)
        assert passages.window_worth(text, words, 7) == pytest.approx(want)
        lo, hi = 5, 55
        s, e, rule = passages.best_window(text, words, lo, hi, 9, "centre")
        worth = lambda s: sum(w for w, gs in words if any(text.startswith(g, i) for g in gs for i in range(s, s + 9 - len(g) + 1)))
        every = [worth(x) for x in range(lo, hi - 8)]
        assert e - s == 9 and lo <= s and e <= hi
        assert rule == ("words" if max(every) else rule) and (rule != "words" or worth(s) == max(every))
    assert passages.best_window("abc", [], 0, 3, 9, "start") == (0, 3, "short-start") and passages.best_window("x" * 30, [(1.0, ["q"])], 0, 30, 10, "centre") == (10, 20, "centre")


def test_pieces_cover_the_text():
    count = lambda t: len(t.split()) + t.count("\n")
    text = "\n\n".join(" ".join(f"w{i}.{j}" + ("." if j % 9 == 8 else "") for j in range(i % 50 + 5)) for i in range(60))
    got = passages.pieces_of(text, "a title " * 40, count, 48)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:])) and all(n <= 48 for _, _, n, _ in got)
    assert sum(text[e - 2 : e] == "\n\n" or text[e - 1] in "\n " for _, e, _, _ in got[:-1]) > len(got) // 2
    with pytest.raises(ValueError):
        passages.pieces_of("x", "", lambda t: 99, 48)


def test_passages_of_a_pool(spark):
    rows = measures.t9_evidence(spark, SF).collect()
    text = {r["doc_id"]: (r["text"] or "").strip() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and all(r["passage"] == text[r["doc_id"]][r["start"] : r["end"]] and r["end"] - r["start"] <= passages.EVIDENCE for r in rows)
    assert all(r["end"] <= 1200 for r in rows if r["chunk_no"] == 0)
    assert all(0 < len(r["excerpt"]) <= 2 * passages.RADIUS + 2 for r in measures.t7_excerpts(spark, SF).collect())


def test_lanes(spark):
    words = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate([10, 11, 12, 13])], "qid long, doc_id long, rank int")
    meaning = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate([13, 14, 10])], "qid long, doc_id long, rank int")
    worth = spark.createDataFrame([(1, d, w) for d, w in ((10, 1.0), (11, 5.0), (12, 5.0), (13, 2.0), (14, 9.0))], "qid long, doc_id long, worth double")
    pool = passages.pool_of(words, meaning)
    ranks = {10: (0, 2), 11: (1, 20), 12: (2, 20), 13: (3, 0), 14: (20, 1)}
    base = {d: i for i, d in enumerate([10, 11, 12, 13, 14])}
    assert {r["doc_id"]: (r["w"], r["m"]) for r in pool.collect()} == ranks
    value = {10: 1.0, 11: 5.0, 12: 5.0, 13: 2.0, 14: 9.0}
    passage = {d: i for i, d in enumerate(sorted(base, key=lambda d: (-value[d], base[d])))}
    score = {d: sum(1 / (61 + r) for r in ranks[d] if r < 20) + 1 / (61 + passage[d]) for d in base}
    got = [r["doc_id"] for r in passages.three_lanes(pool, worth, 5).orderBy("rank").collect()]
    assert got == sorted(base, key=lambda d: (-round(score[d], 9), base[d]))
    got = [r["doc_id"] for r in passages.better_of_lanes(pool, worth, 5).orderBy("rank").collect()]
    assert got == sorted(base, key=lambda d: (min(ranks[d]) + 1, passage[d], sum(ranks[d]), ranks[d][0]))
    zero = spark.createDataFrame([(10, 0.0)], "doc_id long, factor double")
    assert [r["doc_id"] for r in passages.better_of_lanes(pool, worth, 5, zero).orderBy("rank").collect()][-1] == 10
    near = passages.neighbours(pool, meaning, spark.createDataFrame([(13, 77), (12, 99), (78, 14), (13, 79), (10, 13)], "src long, dst long"))
    assert {r["doc_id"] for r in near.collect()} == {77, 78, 79}
    worth = spark.createDataFrame([(1, 77, 0.5), (1, 78, 0.5), (1, 79, 0.0)], "qid long, doc_id long, worth double")
    assert {r["doc_id"]: r["base"] for r in passages.linked_arm(pool, near, worth).collect() if r["base"] > 4} == {77: 5, 78: 6}
    cos = spark.createDataFrame([(1, 78, 0.9), (1, 77, 0.4), (1, 77, 0.5)], "qid long, doc_id long, cos double")
    assert {r["doc_id"]: r["base"] for r in passages.linked_arm(pool, near, worth, cos).collect() if r["base"] > 4} == {78: 5, 77: 6}


def test_excerpts():
    body = "x" * 200 + " two " + "y" * 100 + " one two " + "z" * 300
    got = passages.excerpt_of(body, ["two", "one", "none"])
    assert got.startswith("…") and got.endswith("…") and "one two" in got and len(got) <= 2 * passages.RADIUS + 2
    assert passages.excerpt_of("One  word\nhere", ["word"]) == "One word here…" and passages.excerpt_of("no  such", ["word"]) == "no such" and passages.excerpt_of("", ["a"]) == ""
    rng = np.random.default_rng(4)
    for _ in range(300):
        t = "".join(rng.choice(list("ab c"), 80))
        words, r = ["ab", "c a", "bb", "zz"], 9
        firsts = [t.find(w) for w in words if w in t]
        near = [sum(w in t[max(0, p - r) : p + r] for w in words) for p in firsts]
        p = firsts[near.index(max(near))] if firsts else 0
        want = ("…" if p > r else "") + t[max(0, p - r) : p + r] + "…" if firsts else t[: 2 * r]
        assert passages.excerpt_of(t, words, r) == " ".join(want.split())


def test_roles_and_aliases_of_kinds(spark):
    raw = "## A <!-- todo: signals -->\n- x\n## B <!-- note: progress -->\n- y\n## Rules to keep\n- z"
    d = spark.createDataFrame([("p", raw)], "path string, raw string")
    assert [r["role"] for r in parse.index_items(d, "note", {"directives": ["Rules", ""]}).orderBy("line").collect()] == ["", "progress", "directives"]
    assert [r["role"] for r in parse.index_items(d).orderBy("line").collect()] == ["", "", ""]
    names = [("work-log", "work-log-alpha"), ("work-log", "work-log-beta"), ("my_kind", "my_kind_gamma"), ("work", "work-delta"), ("", "other-epsilon"), ("note", "zeta")]
    docs = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(names)], "doc_id long, kind string, name string")
    declared = spark.createDataFrame([("short", "my_kind_gamma", 2)], "alias string, target string, doc_id long")
    got = {r["alias"]: r["doc_id"] for r in index.kind_aliases(docs, declared).collect()}
    assert got == {"alpha": 0, "beta": 1, "gamma": 2, "delta": 3, "my_kind_short": 2}


def test_margins(spark):
    grid = lambda f: [int(f(m)) for m in np.round(np.arange(1.0, 2.51, 0.05), 2)]
    rows = [(1, True, grid(lambda m: m <= 1.8))] * 6 + [(1, False, grid(lambda m: m <= 1.4))] * 6 + [(2, True, grid(lambda m: True))] * 3
    got = {r["user"]: r for r in evaluate.best_margin(spark.createDataFrame(rows, "user long, positive boolean, grid array<int>")).collect()}
    assert 1.4 < got[1]["margin"] <= 1.8 and got[1]["sd"] < 1e-9 and 1.0 <= got[2]["margin"] <= 2.5


def test_conflicting_labels(spark):
    q = lambda *t: spark.createDataFrame([*enumerate(t)], "qid long, text string")
    needed, controls = q("what did we decide on the cache", "the weather in Rome"), q("What did we decide on the caches", "tie a shoe", "the weather at home")
    got = {tuple(r) for r in evaluate.label_conflicts(needed, controls, q("x").select("qid")).collect()}
    assert (0, "0", "conflict") in got and (1, None, "no-gold") in got and not [g for g in got if g[1] == "1"]


def test_alike_pairs_are_those_of_all_with_all(spark):
    rng = np.random.default_rng(6)
    made = lambda n, k: ["".join(rng.choice(list("abcdeF 1-가나"), int(rng.integers(0, 30)))) for _ in range(n)] + ["", None, "x" * k, "a" * 250 + "bc"]
    x, y = made(50, 3), made(40, 4)
    y += [t[:-1] + "q" for t in x[:20]]
    q = lambda t: spark.createDataFrame([*enumerate(t)], "qid long, text string")
    flat = lambda t: "".join(c for c in t or "" if c.isascii() and c.isalnum() or "가" <= c <= "힣")
    ratio = lambda a, b: SequenceMatcher(None, flat(a), flat(b)).ratio()
    want = {(i, str(j), "conflict" if ratio(a, b) >= 0.55 else "warning") for i, a in enumerate(x) for j, b in enumerate(y) if ratio(a, b) >= 0.45}
    got = [tuple(r) for r in evaluate.label_conflicts(q(x), q(y), q(x).select("qid")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_rules_from_use(spark):
    assert signals.signals_of("A=1 B=$(/usr/bin/git checkout -b x) && ls <<EOF\nrm all\nEOF\nmake") == ["git", "git checkout", "git checkout -b", "ls", "make"]
    noted = spark.createDataFrame([("git fetch", "n1", 3), ("git fetch origin", "n2", 1), ("git", "n3", 9), ("make", "n4", 1)], "signal string, note string, tf long")
    uses = spark.createDataFrame([("git fetch", 60, 60, 0), ("git fetch origin", 55, 55, 0), ("git", 500, 500, 0), ("make", 70, 70, 0), ("ls", 2, 2, 0)], "signal string, uses long, shell long, path long")
    known = spark.createDataFrame([("git push",)], "phrase string")
    c = {r["signal"]: r for r in signals.candidates(noted, uses, known, 2000).collect()}
    assert set(c) == {"git fetch", "git fetch origin", "git", "make"} and c["git"]["broader"] and c["git"]["rate"] == 25 and not c["make"]["covered"]
    found = signals.candidates(noted, uses, known, 2000)
    p = signals.proposals(found, found.select("signal", F.explode("notes").alias("note"), F.lit(10.0).alias("score")))
    assert {r["signal"] for r in p.collect()} == {"git fetch", "git", "make"}
    rates = spark.createDataFrame([("make", 1.0), ("git fetch", 9.0)], "rule string, rate double")
    none, rules = spark.createDataFrame([], "signal string"), spark.createDataFrame([("r", "push", "n9")], "rule string, phrase string, note string")
    assert [tuple(r) for r in signals.approved(p, rates, none, rules).collect()] == [("make", 1)]


def test_policy_needs_gains_without_losses(spark):
    def choose(scores):
        rows = [(i, i, {"old": a, "new": b}, {"old": 1.0, "new": 1.0}) for i, (a, b) in enumerate(scores)]
        return learn.policy_choice(spark.createDataFrame(rows, "id long, session long, scores map<string,int>, costs map<string,double>"), ["old", "new"], "old").first()

    assert choose([(0, 1)] * 20)["arm"] == "new" and choose([(0, 1)] * 6)["arm"] == "old"
    assert choose([(0, 1)] * 19 + [(1, 0)])["arm"] == "old" and choose([(0, 1)])["decision"] == "insufficient"


def test_kept_index_equals_a_new_one(spark, tmp_path):
    """Two batches of a stream: changed, new and removed documents; then the same as if all were indexed at once."""
    schema = "doc_id long, ts int, name string, title string, description string, body string"
    first = [(i, 0, f"n{i}", "", "", f"word{i % 5} common text{i}") for i in range(12)]
    batches = [[(3, 1, "n3", "", "", "other words"), (3, 2, "n3", "", "", "last words"), (20, 1, "n20", "new", "", "common word1")], [(5, 3, "n5", "", "", None), (20, 3, "n20", "new", "", "word2 word2")]]
    path = str(tmp_path / "index")
    index.kept(spark.createDataFrame(first, schema), path, 0, 4)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = sessions.keep_index(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "checkpoint"), 4).trigger(availableNow=True).start()
        q.awaitTermination()
        docs = {r[0]: r for r in first}
        for r in sorted((r for b in batches[: i + 1] for r in b), key=lambda r: r[1]):
            docs[r[0]] = r
        now = spark.createDataFrame([r for r in docs.values() if r[5] is not None], schema)
        posted, got = index.postings(now), index.versioned(spark, path, i + 1)
        rows_of = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
        assert rows_of(got.postings, "doc_id", "term", "tf") == rows_of(posted, "doc_id", "term", "tf")
        assert rows_of(got.terms, "term", "df") == rows_of(index.terms(posted), "term", "df")
        assert rows_of(got.lengths, "doc_id", "doclen") == rows_of(index.doc_lengths(now, posted), "doc_id", "doclen")
    assert len({v for v in index._listed(spark, path, 2).values()}) > 1


def test_shrink_plan(spark):
    hook = "opens a thing. And much more is said about it here, at length"
    rows = [(1, "", f"- [A](a.md) — {hook}", ["a"]), (2, "signals", f"- [B](b.md) — {hook}", ["b"]), (3, "", f"- [C](c.md) - `code {hook}", ["c"]), (4, "", "* plain line\n  goes on", ["d"]), (5, "", f"- [E](e.md) — {hook}", ["gone"]), (6, "", "- no link", [])]
    items = spark.createDataFrame([("p", *r) for r in rows], "path string, line int, role string, raw string, golds array<string>")
    verdicts = items.select("path", "line", F.lit("safe").alias("verdict"))
    sources = spark.createDataFrame([(x, "k", age) for x, age in (("a", 50), ("b", 900), ("c", 300), ("d", 200))], "name string, kind string, age_days int")
    none = items.where("false").select("path", "line")
    touch = shrink.eligible(items, verdicts, sources, none, spark.createDataFrame([("k", 100)], "kind string, days int"))
    assert {r["line"]: r["skipped"] for r in touch.collect()} == {1: None, 2: "section", 3: None, 4: None, 5: "no-source", 6: "no-source"}
    size = sum(len(r[2]) + 1 for r in rows) - 1
    plan = lambda target: {r["line"]: (r["action"], r["new"], r["saved"]) for r in shrink.shrink_plan(spark.createDataFrame([("p", size, target)], "path string, chars int, target int"), touch).collect()}
    first = ("shorten", "- [A](a.md) — opens a thing.", len(rows[0][2]) - 28)
    third = len(rows[2][2]) + 1
    assert plan(size) == {} and plan(0) == {} and plan(size - 1) == {1: first}
    got = plan(1)
    assert got == {1: first, 3: ("drop", None, third), 4: ("drop", None, len(rows[3][2]) + 1)}
    assert plan(size - first[2] - 30)[3] == ("shorten", "- [C](c.md) — …"[:11], len(rows[2][2]) - 11)
    assert [r["x"] for r in spark.createDataFrame([("`a` b; c",), ("x" * 100,), ("",), ("a `b",)], "h string").select(shrink.first_clause(F.col("h"), 10).alias("x")).collect()] == ["`a` b", "x" * 9 + "…", "", "a…"]


def patched(before, diff):
    """before with a unified diff applied."""
    out, at, lines = [], 0, diff.split("\n")[2:]
    for line in lines:
        if line.startswith("@@"):
            start, n = (line.split()[1][1:] + ",1").split(",")[:2]
            start = int(start) - (n != "0")
            out += before[at:start]
            at = start
        elif line.startswith("+"):
            out.append(line[1:])
        else:
            assert before[at] == line[1:]
            out += [line[1:]] if line.startswith(" ") else []
            at += 1
    return out + before[at:]


def test_changes_apply_back(spark):
    rng = np.random.default_rng(8)
    texts = [[f"line {rng.integers(6)}" for _ in range(12)]]
    for _ in range(30):
        t = list(texts[-1])
        for _ in range(3):
            i = int(rng.integers(len(t)))
            t[i : i + int(rng.integers(2))] = [f"new {rng.integers(9)}"] * int(rng.integers(3))
        texts.append(t or ["x"])
    d = spark.createDataFrame([(i, f"v{i}", "\n".join(t)) for i, t in enumerate(texts)] + [(100, None, None)], "id long, name string, body string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(i, 30) for i in range(7)] + [(30, 100), (100, 0), (5, 5)], "id long, next long")
    rows = {(r["before"], r["id"]): r for r in records.changes(d, edges, lines=1000, chars=100_000).collect()}
    assert len(rows) == 29 + 5 + 2 and all(r["more"] == (k[1] == 30) for k, r in rows.items())
    for (a, b), r in rows.items():
        if 100 not in (a, b):
            assert not r["truncated"] and (patched(texts[a], r["diff"]) == texts[b] if r["diff"] else texts[a] == texts[b])
    short = records.changes(d, edges, lines=4, chars=30).collect()
    assert all(len(r["diff"]) <= 30 and r["diff"].count("\n") < 4 for r in short) and any(r["truncated"] for r in short)


def test_a_label_s_first_documents_are_found_once(spark):
    """The window runs on a label's documents, below the join with its queries."""
    from memolake.plans import analytics

    rows = [(4 * d + i, d, i, (d * 7 + i) % 3) for d in range(120) for i in range(4)]
    chunks = spark.createDataFrame(rows, "vec_id long, doc_id long, chunk_no int, label int")
    lane = analytics.label_lane(chunks)
    plan = lane._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")
    got = {(r["qid"], r["doc_id"], r["rank"]) for r in lane.collect()}
    assert got == {(v, d, n) for v, _, _, x in rows if v % 25 == 0 for n, d in enumerate(sorted({d for _, d, _, y in rows if y == x})[:20], 1)}


@pytest.mark.parametrize("lowest", [False, True])
def test_queries_apart_from_their_set(spark, monkeypatch, lowest):
    from memolake.operators import vector

    rng = np.random.default_rng(5)
    chunks = [(d, c, rng.normal(size=4).tolist(), d % 3) for d in range(50) for c in range(2)]
    asked = [(q, rng.normal(size=4).tolist(), q % 3) for q in range(150)]
    monkeypatch.setattr(vector, "BLOCK", 30)
    c = spark.createDataFrame(chunks, "doc_id long, chunk_no int, vec array<double>, set int")
    got = vector.cosine_top(spark.createDataFrame(asked, "qid long, vec array<double>, set int"), c, 4, lowest).collect()
    for q, v, own in asked:
        best = {d: max(float(np.dot(v, x)) for e, _, x, _ in chunks if e == d) for d in range(50) if d % 3 != own}
        want = sorted(best, key=lambda d: (best[d] if lowest else -best[d], d))[:4]
        assert [r["doc_id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want
