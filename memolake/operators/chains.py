"""Directed graphs of long chains: cycles, what is led to, ancestors; without the set of all pairs.

A record with one before it and one after it is inside a segment. Segments are found by pointer doubling, a table a round and
a row for each such record, so a chain of n takes log n rounds and n rows. What is left has a node for each record that
branches, merges, begins or ends, and the general algorithms run on that alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memolake.tables import released, staged


def steps(edges: DataFrame) -> DataFrame:
    """(id, next), distinct, without nulls and loops."""
    return edges.where("id <> next").select("id", "next").distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(id, before, after): how many edges lead to each node and from it."""
    ends = e.select(F.explode(F.array(F.struct(F.col("next").alias("id"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct("id", F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


@dataclass
class Segments:
    """inner (id, tail, first, place): nodes inside segments, which begin after tail with first; links (tail, first, head,
    length): segments and plain edges (first is then head, length 0) between the other nodes; rings (id, ring, size): cycles
    of inner nodes alone."""

    inner: DataFrame
    links: DataFrame
    rings: DataFrame

    def released(self) -> None:
        released(self.inner, self.links, self.rings)


def segments(e: DataFrame) -> Segments:
    """Of edges as from ``steps``."""
    inside = staged(degrees(e).where("before = 1 and after = 1").select(F.col("id").alias("_in")), "inside")
    n, gone = inside.count(), 1
    own = e.join(inside, F.col("next") == F.col("_in")).select(F.col("next").alias("id"), F.col("id").alias("at"))
    start = own.join(inside, F.col("at") == F.col("_in"), "left")
    start = start.select("id", "at", F.lit(1).cast("long").alias("place"), F.col("id").alias("first"), F.col("id").alias("low"), F.col("_in").isNull().alias("done"), F.lit(False).alias("met"))
    walk = staged(start, "walk")
    # The least node of a ring meets itself when it is the least one farther back too; when all that is left is under such
    # nodes, all that is left is rings.
    while gone <= n and walk.where("not done").join(walk.where("met").select("low"), "low", "left_anti").limit(1).count():
        on = walk.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("place").alias("_place"), F.col("first").alias("_first"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        far = walk.where("not done").join(on, F.col("at") == F.col("_id"))
        far = far.select("id", F.col("_at").alias("at"), (F.col("place") + F.col("_place")).alias("place"), F.col("_first").alias("first"), F.least("low", "_low").alias("low"), F.col("_done").alias("done"), (F.col("met") | (F.col("_low") == F.col("id"))).alias("met"))
        old, walk, gone = walk, staged(walk.where("done").unionByName(far), "walk"), 2 * gone
        released(old)
    inner = walk.where("done").select("id", F.col("at").alias("tail"), "first", "place")
    ring = walk.where("not done").select("id", F.col("low").alias("ring"))
    rings = ring.join(ring.groupBy("ring").agg(F.count(F.lit(1)).alias("size")), "ring").select("id", "ring", "size")
    out = e.join(inside, F.col("next") == F.col("_in"), "left_anti").withColumnRenamed("next", "head")
    links = out.join(inner, "id", "left").select(F.coalesce("tail", "id").alias("tail"), F.coalesce("first", "head").alias("first"), "head", F.coalesce("place", F.lit(0)).alias("length"))
    out = Segments(staged(inner, "inner"), staged(links, "links"), staged(rings, "rings"))
    released(walk, inside)
    return out


def highest(e: DataFrame) -> DataFrame:
    """(id, top): the greatest node that leads to each, itself included. Each round takes the greatest of those before, and
    then what leads to that one."""
    tops = staged(e.select(F.explode(F.array("id", "next")).alias("id")).distinct().select("id", F.col("id").alias("top")), "tops")
    while True:
        told = e.join(tops, "id").groupBy(F.col("next").alias("id")).agg(F.max("top").alias("_told"))
        more = tops.join(told, "id", "left").select("id", F.greatest("top", F.coalesce("_told", "top")).alias("_top"), F.col("top").alias("was"))
        up = tops.select(F.col("id").alias("_id"), F.col("top").alias("_up"))
        new = staged(more.join(up, F.col("_top") == F.col("_id"), "left").select("id", F.greatest("_top", "_up").alias("top"), "was"), "tops")
        released(tops)
        if not new.where("top <> was").limit(1).count():
            return new
        tops = new


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes in strongly connected components of two or more; component is the smallest node of each.

    Again and again segments become links, nodes that nothing leads to, or that lead nowhere, go, and what is left is coloured
    by the greatest node that leads to a node: those that lead back to it are its component, and edges between colours are in
    none. Inner nodes of a link are in a component if both its ends are.
    """
    e = staged(steps(edges), "edges")
    found, insides, n = [], [], e.count()
    while n:
        s = segments(e)
        found += [s.rings.select("id", F.col("ring").alias("component")), s.links.where("tail = head").select(F.col("tail").alias("id"), F.col("tail").alias("component")).distinct()]
        insides.append(s.inner.join(s.links, ["tail", "first"]).select("id", "tail", "head"))
        less = steps(s.links.select(F.col("tail").alias("id"), F.col("head").alias("next")))
        less = less.join(less.select(F.col("next").alias("id")).distinct(), "id", "left_semi").join(less.select(F.col("id").alias("next")).distinct(), "next", "left_semi").select("id", "next")
        old, e = e, staged(less, "edges")
        n = e.count()
        released(old)
        if n:
            tops = highest(e).select("id", "top")
            other = tops.select(F.col("id").alias("next"), F.col("top").alias("_top"))
            same = staged(e.join(tops, "id").join(other, "next").where("top = _top").select("id", "next"), "coloured")
            back = highest(same.select(F.col("next").alias("id"), F.col("id").alias("next"))).select("id", F.col("top").alias("_back"))
            lone = tops.join(back, "id", "left").withColumn("whole", F.coalesce(F.col("_back") == F.col("top"), F.col("id") == F.col("top")))
            whole = staged(lone.where("whole").select("id", F.col("top").alias("component")), "found")
            several = whole.groupBy("component").count().where("count > 1").select("component")
            found.append(whole.join(several, "component", "left_semi").select("id", "component"))
            left = same.join(whole.select("id"), "id", "left_anti").join(whole.select(F.col("id").alias("next")), "next", "left_anti").select("id", "next")
            old, e = e, staged(left, "edges")
            n = e.count()
            released(old, same)
    kind = edges.schema["id"].dataType.simpleString()
    out = edges.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    for rows in found:
        out = out.unionByName(rows)
    # A node that one link leads back to has itself as its component unless a larger one holds it.
    out = out.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("component") != F.col("id"), F.col("component"))), F.max("component")).alias("component"))
    for inner in reversed(insides):
        out = staged(out, "cyclic")
        ends = inner.join(out.select(F.col("id").alias("tail"), F.col("component").alias("_a")), "tail").join(out.select(F.col("id").alias("head"), F.col("component").alias("_b")), "head")
        more = ends.where("_a = _b").select("id", F.col("_a").alias("component"))
        # A node inside a link that was in a loop of its own takes the larger component's name, and so do those of the loop.
        renamed = out.join(more.select("id", F.col("component").alias("_new")), "id", "left")
        out = renamed.select("id", F.coalesce("_new", "component").alias("component")).unionByName(more.join(out, "id", "left_anti").select("id", "component"))
    least = out.groupBy("component").agg(F.min("id").alias("_least"))
    return out.join(least, "component").select("id", F.col("_least").alias("component"))


def led_to(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id): the sources (id) and all that chains of edges lead to from one.

    A node with one before it goes back to the nearest one that several or none lead to, by doubling, and remembers whether a
    source is on the way. Those nodes are then the nodes of a smaller graph, and so on; what resists is walked, a round a step.
    """
    e, levels = staged(steps(edges), "edges"), []
    marked = staged(sources.select("id").where("id is not null").distinct(), "marked")
    n = e.count()
    while n:
        many = degrees(e)
        one = many.where("before = 1").select(F.col("id").alias("_one"))
        own = e.join(one, F.col("next") == F.col("_one")).select(F.col("next").alias("id"), F.col("id").alias("at"))
        own = own.join(one, F.col("at") == F.col("_one"), "left").join(marked.select(F.col("id").alias("_m")), F.col("id") == F.col("_m"), "left")
        walk, gone = staged(own.select("id", "at", F.col("_m").isNotNull().alias("hit"), F.col("id").alias("low"), F.col("id").alias("back"), F.col("_one").isNull().alias("done"), F.lit(False).alias("met")), "walk"), 1
        # As in ``segments``, but others may hang on a ring: they are through once they have gone into it, and a round more.
        last = False
        while gone <= n and walk.where("not done").limit(1).count() and not last:
            last = not walk.where("not done").join(walk.where("met").select(F.col("low").alias("back")), "back", "left_anti").limit(1).count()
            on = walk.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("hit").alias("_hit"), F.col("low").alias("_low"), F.col("done").alias("_done"))
            far = walk.where("not done").join(on, F.col("at") == F.col("_id"))
            far = far.select("id", F.col("_at").alias("at"), (F.col("hit") | F.col("_hit")).alias("hit"), F.least("low", "_low").alias("low"), F.col("_low").alias("back"), F.col("_done").alias("done"), (F.col("met") | (F.col("_low") == F.col("id"))).alias("met"))
            old, walk, gone = walk, staged(walk.where("done").unionByName(far), "walk"), 2 * gone
            released(old)
        levels.append(walk)
        merging = e.join(many.where("before > 1").select(F.col("id").alias("next")), "next", "left_semi")
        into = merging.join(walk, "id", "left").select(F.when(F.col("at").isNull(), F.col("id")).when(F.col("done"), F.col("at")).alias("id"), "next", F.coalesce("hit", F.lit(False)).alias("hit"))
        into = staged(into, "into")
        marked, before = staged(marked.union(into.where("hit").select(F.col("next").alias("id"))).distinct(), "marked"), marked
        old, e, was = e, staged(steps(into), "edges"), n
        n = e.count()
        released(old, into, before)
        if n == was:
            break
    while n:
        more = e.join(marked, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(marked, "id", "left_anti")
        more = staged(more, "more")
        if not more.limit(1).count():
            break
        old, marked = marked, staged(marked.union(more), "marked")
        released(old, more)
    for walk in reversed(levels):
        through = walk.join(marked.select(F.col("id").alias("at")), "at", "left_semi").where("done").select("id")
        marked = staged(marked.union(through).union(walk.where("hit").select("id")).distinct(), "marked")
    return marked


def ancestors(e: DataFrame) -> DataFrame:
    """(id, ancestor), distinct, closed by doubling in tables: for graphs of branching and merging nodes alone."""
    reach = staged(e.select(F.col("next").alias("id"), F.col("id").alias("ancestor")).distinct(), "ancestors")
    size = reach.count()
    while size:
        far = reach.join(reach.select(F.col("id").alias("_by"), F.col("ancestor").alias("_to")), F.col("ancestor") == F.col("_by")).select("id", F.col("_to").alias("ancestor"))
        old, reach, was = reach, staged(reach.union(far).distinct(), "ancestors"), size
        size = reach.count()
        released(old)
        if size == was:
            break
    return reach


@dataclass
class Lineage:
    """The segments of a graph, and the ancestors among the nodes between them."""

    segments: Segments
    closure: DataFrame

    @classmethod
    def of(cls, edges: DataFrame) -> Lineage:
        e = staged(steps(edges), "edges")
        s = segments(e)
        released(e)
        return cls(s, ancestors(s.links.select(F.col("tail").alias("id"), F.col("head").alias("next"))))

    def reached(self) -> DataFrame:
        """(id, head): the nodes between segments whose segments count among a node's ancestors: its own and its ancestors'."""
        heads = self.segments.links.select(F.col("head").alias("id")).distinct()
        return heads.select("id", F.col("id").alias("head")).union(self.closure.select("id", F.col("ancestor").alias("head"))).distinct()

    def counts(self) -> DataFrame:
        """(id, n): how many different ancestors each node has that has any; a node in a cycle is its own ancestor too."""
        links = self.segments.links
        inner = self.reached().join(links.groupBy("head").agg(F.sum("length").alias("n")), "head").groupBy("id").agg(F.sum("n").alias("inner"))
        plain = self.closure.groupBy("id").agg(F.count(F.lit(1)).alias("outer")).join(inner, "id").select("id", (F.col("inner") + F.col("outer")).alias("n"))
        plain = staged(plain, "counts")
        # Inside a cycle a segment's nodes have the ancestors of its tail; else those, the tail and what is before them in the
        # segment. A tail in another cycle is among its own ancestors already.
        cyclic = self.closure.select(F.col("id").alias("tail"), F.col("ancestor").alias("head"), F.lit(True).alias("cyclic"))
        around = links.join(cyclic, ["tail", "head"], "left").select("tail", "first", (F.coalesce("cyclic", F.lit(False)) | (F.col("tail") == F.col("head"))).alias("cyclic"))
        own = self.closure.where("id = ancestor").select(F.col("id").alias("tail"), F.lit(1).alias("own"))
        inside = self.segments.inner.join(around, ["tail", "first"]).join(plain.select(F.col("id").alias("tail"), "n"), "tail", "left").join(own, "tail", "left")
        inside = inside.select("id", (F.coalesce("n", F.lit(0)) + F.when(F.col("cyclic"), 0).otherwise(F.col("place") - F.coalesce("own", F.lit(0)))).alias("n"))
        return plain.union(inside).union(self.segments.rings.select("id", F.col("size").alias("n")))

    def of_groups(self, members: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
        """(by, id): wanted nodes (id) among the ancestors of the members (by, id) of groups, each once for each group."""
        s = self.segments
        inside = members.join(s.inner, "id")
        between = members.join(s.inner.select("id"), "id", "left_anti").select(*by, "id").union(inside.select(*by, F.col("tail").alias("id"))).distinct()
        up = between.join(self.closure, "id").select(*by, F.col("ancestor").alias("id"))
        nodes = up.union(inside.select(*by, F.col("tail").alias("id"))).join(wanted, "id", "left_semi").select(*by, "id")
        whole = between.join(self.reached(), "id").select(*by, "head").distinct().join(s.links.where("length > 0"), "head").select(*by, "tail", "first", F.lit(None).cast("long").alias("most"))
        part = inside.groupBy(*by, "tail", "first").agg(F.max("place").alias("most"))
        held = s.inner.join(wanted, "id", "left_semi")
        inner = held.join(whole.unionByName(part), ["tail", "first"]).where("most is null or place < most").select(*by, "id")
        round_ = members.join(s.rings.select("id", "ring"), "id").select(*by, "ring").distinct().join(s.rings.select("ring", "id").join(wanted, "id", "left_semi"), "ring").select(*by, "id")
        return nodes.union(inner).union(round_).distinct()
