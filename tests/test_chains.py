"""Graphs of long chains against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from memolake import tables
from memolake.operators import chains, records


def closed(edges):
    """{node: nodes that a chain of edges leads to}."""
    out, nodes = {}, {x for e in edges for x in e}
    after = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, set()).add(b)
    for n in nodes:
        seen, todo = set(), list(after.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[n] = seen
    return out


def graphs():
    """Many small graphs beside each other: sparse and dense, rings, chains into rings, ladders, combs, repeated edges and loops."""
    rng, edges, base = random.Random(7), [], 0
    for _ in range(60):
        n = rng.randrange(2, 14)
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.randrange(1, int(n * rng.choice([0.8, 1.2, 1.8])) + 2))]
        base += n
    for n in (2, 3, 17, 40):
        ring = [(base + i, base + (i + 1) % n) for i in range(n)]
        edges += ring + [(base + 5 % n, base + n), (base + n, base + n + 1), (base + n + 2, base), (base + n + 3, base + n + 2)]
        base += n + 4
    for n in (3, 9):
        edges += [(base + 2 * i + a, base + 2 * i + 2 + b) for i in range(n) for a in (0, 1) for b in (0, 1)]
        base += 2 * n + 4
    n = 25
    edges += [(base + i, base + i + 1) for i in range(n)] + [(base + 100 + i, base + i) for i in range(n)] + [(base + n, base + 3), (base + 10, base + 2)]
    rng.shuffle(edges)
    return edges


@pytest.fixture(scope="module")
def graph(spark):
    edges = graphs()
    return edges, closed(edges), spark.createDataFrame([*edges, (None, 1), (1, None)], "id long, next long").repartition(4)


def test_cycles(graph):
    edges, reach, e = graph
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
    assert {r["id"]: r["component"] for r in chains.cyclic_components(e).collect()} == want and len(want) > 50
    assert {r["id"] for r in records.in_cycles(e).collect()} == set(want)


def test_led_to(spark, graph):
    edges, reach, e = graph
    rng = random.Random(2)
    sources = set(rng.sample(sorted(reach), 40)) | {10_000_000}
    got = chains.led_to(e, spark.createDataFrame([(x,) for x in [*sources, None]], "id long")).collect()
    assert sorted(r["id"] for r in got) == sorted(sources.union(*(reach[x] for x in sources if x in reach)))


def test_ancestors(spark, graph):
    edges, reach, e = graph
    before = {}
    for a, found in reach.items():
        for b in found:
            before.setdefault(b, set()).add(a)
    lineage = chains.Lineage.of(e)
    assert {r["id"]: r["n"] for r in lineage.counts().collect()} == {k: len(v) for k, v in before.items()}
    members = [(x % 50, x) for x in sorted(reach)]
    wanted = {x for x in reach if x % 3 == 0}
    got = lineage.of_groups(spark.createDataFrame(members, "g long, id long"), spark.createDataFrame([(x,) for x in wanted], "id long"), ["g"]).collect()
    assert sorted((r["g"], r["id"]) for r in got) == sorted({(g, y) for g, x in members for y in before.get(x, ()) if y in wanted})


def test_long_chains_take_few_tables_and_rows(spark, monkeypatch):
    """A chain of 3,000 with shuffled ids: at most 30 tables, none with more rows than the chain."""
    ids = list(range(3000))
    random.Random(1).shuffle(ids)
    e = spark.createDataFrame([*zip(ids, ids[1:])], "id long, next long")
    made = []

    def counting(df, name):
        out = tables.staged(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(chains, "staged", counting)
    ring = e.union(spark.createDataFrame([(ids[-1], ids[0])], "id long, next long"))
    assert chains.cyclic_components(ring).where("component = 0").count() == 3000 and len(made) <= 30 and max(made) <= 3000
    made.clear()
    assert chains.led_to(e, spark.createDataFrame([(ids[1000],)], "id long")).count() == 2000 and len(made) <= 30 and max(made) <= 3000


def test_no_edges(spark):
    e = spark.createDataFrame([], "id long, next long")
    assert chains.cyclic_components(e).count() == 0 and chains.Lineage.of(e).counts().count() == 0
    assert chains.led_to(e, spark.createDataFrame([(1,)], "id long")).count() == 1
