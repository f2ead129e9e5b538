"""The link graph: edges, neighbours, components, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memolake.tables import released, staged


def edges(links: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst): links (src_id, dst_name) that resolve through names (name, doc_id), once each."""
    return links.join(names, links["dst_name"] == names["name"]).select(F.col("src_id").alias("src"), F.col("doc_id").alias("dst")).distinct()


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").union(e.select("dst", "src")).distinct()


def dangling(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links whose target no document is named."""
    return links.join(names.select(F.col("name").alias("dst_name")), "dst_name", "left_anti").select("src_id", "dst_name")


def orphans(ids: DataFrame, e: DataFrame) -> DataFrame:
    """Documents that no edge of another points at."""
    return ids.join(e.where("src <> dst").select(F.col("dst").alias("doc_id")).distinct(), "doc_id", "left_anti")


def degrees(ids: DataFrame, e: DataFrame) -> DataFrame:
    """(doc_id, degree) over undirected edges without loops; isolated documents have 0."""
    u = e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = u.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    return ids.join(ends, "doc_id", "left").select("doc_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def link_cards(ids: DataFrame, e: DataFrame, lost: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, side, name): a document's card, one row for each link: outgoing and incoming, by the names (doc_id, name) of the
    other end, and dangling targets (src_id, dst_name). Rows, not arrays, so a page of many links is no large value."""
    name = lambda c: names.groupBy(F.col("doc_id").alias(c)).agg(F.min("name").alias("name"))
    out = e.join(name("dst"), "dst").select(F.col("src").alias("doc_id"), F.lit("outgoing").alias("side"), "name")
    into = e.join(name("src"), "src").select(F.col("dst").alias("doc_id"), F.lit("incoming").alias("side"), "name")
    gone = lost.select(F.col("src_id").alias("doc_id"), F.lit("dangling").alias("side"), F.col("dst_name").alias("name"))
    return out.union(into).union(gone).distinct().join(ids, "doc_id", "left_semi")


def components(ids: DataFrame, e: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest document reachable. Each round a document and its old root take the least root of
    the document's neighbours, then the root's root, until nothing changes: on paths with shuffled ids, 1,000 documents
    take about 14 rounds and 100,000 about 22."""
    near = staged(both_ways(e), "near")
    roots = new = staged(ids.select("doc_id", F.col("doc_id").alias("component")).where("doc_id is not null").distinct(), "roots")
    while True:
        least = near.join(roots, near["dst"] == roots["doc_id"]).groupBy("src").agg(F.min("component").alias("least"))
        own = F.struct("doc_id", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("was"))
        hook = F.struct(F.col("component").alias("doc_id"), F.coalesce("least", "component").alias("component"), F.lit(None).cast(roots.schema["component"].dataType).alias("was"))
        told = roots.join(least, roots["doc_id"] == least["src"], "left").select(F.explode(F.array(own, hook)).alias("t"))
        low = told.groupBy("t.doc_id").agg(F.min("t.component").alias("component"), F.max("t.was").alias("was"))
        up = roots.select(F.col("doc_id").alias("_id"), F.col("component").alias("_up"))
        lower = low.join(up, F.col("component") == F.col("_id"), "left").select("doc_id", F.least("component", F.coalesce("_up", "component")).alias("component"), "was")
        old, new = new, staged(lower, "roots")
        released(old)
        roots = new.select("doc_id", "component")
        if not new.where("component <> was").limit(1).count():
            released(near)
            return ids.select("doc_id").join(roots, "doc_id", "left")


def rare_terms(posted: DataFrame, term_df: DataFrame) -> DataFrame:
    """(term, doc_id) of terms of df 2 or 3, a staged table; posted may lack postings of other terms (``index.few``)."""
    return staged(posted.join(term_df.where("df between 2 and 3").select("term"), "term", "left_semi").select("term", "doc_id"), "rare")


def shared_rare(posted: DataFrame, term_df: DataFrame) -> DataFrame:
    """(a, b, shared): documents that share terms of df 2 or 3. At most three pairs come of a term."""
    return sharing(rare_terms(posted, term_df))


def sharing(rare: DataFrame) -> DataFrame:
    """(a, b, shared) of rows (term, doc_id)."""
    x, y = rare.alias("x"), rare.alias("y")
    pairs = x.join(y, (F.col("x.term") == F.col("y.term")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    return pairs.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def duplicate_suspects(docs: DataFrame, posted: DataFrame, term_df: DataFrame, e: DataFrame, least: int = 4, size_ratio: float = 4.0, overlap: float = 0.18, most: int = 25) -> DataFrame:
    """Pairs of one kind and like size that aren't linked and share much of the smaller one's rare terms."""
    terms = rare_terms(posted, term_df)
    rare = terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rare"))
    fact = staged(docs.select("doc_id", "kind", "size").join(rare, "doc_id"), "facts")
    side = lambda c: fact.select(F.col("doc_id").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("size").alias(f"size_{c}"), F.col("rare").alias(f"rare_{c}"))
    p = sharing(terms).where(F.col("shared") >= least).join(side("a"), "a").join(side("b"), "b")
    linked = both_ways(e).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    part = F.col("shared") / F.greatest(F.least("rare_a", "rare_b"), F.lit(1))
    p = p.where((F.col("kind_a") == F.col("kind_b")) & (F.greatest("size_a", "size_b") <= size_ratio * F.greatest(F.least("size_a", "size_b"), F.lit(1)))).withColumn("overlap", part).where(F.col("overlap") >= overlap)
    p = p.join(linked, ["a", "b"], "left_anti")
    return p.orderBy(F.desc(F.round("overlap", 6)), "a", "b").limit(most).select("a", "b", "shared", F.col("kind_a").alias("kind"), F.round("overlap", 6).alias("overlap"))


def link_suggestions(posted: DataFrame, term_df: DataFrame, e: DataFrame, least: int = 8, most: int = 20) -> DataFrame:
    linked = both_ways(e).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    p = shared_rare(posted, term_df).where(F.col("shared") >= least).join(linked, ["a", "b"], "left_anti")
    return p.orderBy(F.desc("shared"), "a", "b").limit(most)


def sectors(docs: DataFrame, e: DataFrame) -> DataFrame:
    """(doc_id, sector) of docs (doc_id, path, kind, name, source): the folder after ``domains/``, else itself if it is a project,
    else the first linked project by name, else its source."""
    projects = docs.where("kind = 'project'").select(F.col("doc_id").alias("dst"), F.col("name").alias("project"))
    near = both_ways(e).join(projects, "dst").groupBy(F.col("src").alias("doc_id")).agg(F.min("project").alias("project"))
    domain = F.regexp_extract("path", "domains/([^/]+)", 1)
    return docs.join(near, "doc_id", "left").select("doc_id", F.when(domain != "", domain).when(F.col("kind") == "project", F.col("name")).otherwise(F.coalesce("project", "source")).alias("sector"))


def split_dangling(lost: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(src_id, dst_name, near): dangling links with the first names that hold the target or stand in it; none means that the
    document is missing rather than misspelt."""
    from memolake.operators.lexical import FEW, cuts
    from memolake.tables import little

    t = lost.select("dst_name").distinct()
    n = names.select("name").distinct()
    cut = lambda d, c: d.withColumn("cut", F.explode(cuts(F.col(c))))
    head = lambda d, c: d.withColumn("cut", F.substring(c, 1, 3))
    holds = cut(n, "name").join(little(head(t, "dst_name"), FEW), "cut").where(F.contains("name", "dst_name"))
    inside = cut(t, "dst_name").join(head(n.where(F.length("name") >= 2), "name"), "cut").where(F.contains("dst_name", "name"))
    near = holds.select("dst_name", "name").union(inside.select("dst_name", "name")).distinct()
    place = F.row_number().over(Window.partitionBy("dst_name").orderBy("name"))
    some = near.withColumn("_r", place).where(F.col("_r") <= most).groupBy("dst_name").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("near"))
    return lost.join(some, "dst_name", "left").select("src_id", "dst_name", F.coalesce("near", F.lit("")).alias("near"))
