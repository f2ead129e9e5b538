"""Records of facts: what they declare, how they follow each other, and what state they are in."""

from __future__ import annotations

from difflib import unified_diff

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memolake.operators import chains
from memolake.operators.graph import components
from memolake.operators.validity import resolved, started
from memolake.tables import staged

# What a record can declare, and the states of one that can follow another.
FIELDS = ["topic", "facet", "status", "valid_from", "valid_to", "supersedes", "superseded_by", "change_reason", "evidence", "legacy_whole_record_sha"]
STATES = ["active", "proposed", "disputed", "superseded", "retracted", "archived"]
SHAPE = "topic string, facet string, status string, valid_from string, valid_to string, supersedes array<string>, superseded_by string, change_reason string, evidence array<string>, legacy_whole_record_sha map<string,string>"


def instant(text: Column) -> Column:
    """A moment: midnight UTC of a date, or a timestamp with its zone; null for anything else."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z")))).when(zoned, F.try_to_timestamp(text))


def declared(raw: Column) -> tuple[Column, Column]:
    """(struct of SHAPE, issue) of a record's lifecycle as JSON text: the first rule that it breaks, null if none."""
    v = F.from_json(raw, SHAPE)
    line = lambda c: (F.trim(c) == "") | (F.trim(c) != c) | (F.length(c) > 200) | c.rlike(r"[\n\r]") | c.isNull()
    texts = lambda a: (F.size(a) > 50) | F.exists(a, lambda x: x.isNull() | (F.trim(x) == "") | (F.length(x) > 2000))
    given = lambda f: v[f].isNotNull()
    some = lambda c: F.coalesce(c, F.lit(False))
    pins = F.map_keys(v["legacy_whole_record_sha"])
    follows = some(F.size(v["supersedes"]) > 0)
    rules = [
        (v.isNull() | F.json_object_keys(raw).isNull() | some(F.size(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, FIELDS)))) > 0), "fields"),
        (line(v["topic"]), "topic"), (line(v["facet"]), "facet"), (~F.coalesce(v["status"], F.lit("active")).isin(STATES), "status"),
        (given("valid_from") & instant(v["valid_from"]).isNull(), "valid_from"), (given("valid_to") & instant(v["valid_to"]).isNull(), "valid_to"),
        (some(instant(v["valid_to"]) <= instant(v["valid_from"])), "order"), (some(texts(v["supersedes"])), "supersedes"), (some(texts(v["evidence"])), "evidence"),
        (some((F.trim(v["superseded_by"]) == "") | (F.length(v["superseded_by"]) > 2000)), "superseded_by"), (some((F.trim(v["change_reason"]) == "") | (F.length(v["change_reason"]) > 2000)), "change_reason"),
        (some((F.size(pins) > 50) | F.exists(F.map_values(v["legacy_whole_record_sha"]), lambda x: ~x.rlike("^[0-9a-f]{40}$")) | (F.size(F.array_except(pins, F.coalesce(v["supersedes"], F.array().cast("array<string>")))) > 0)), "legacy"),
        (follows & (~given("valid_from") | ~given("change_reason") | ~some(F.size(v["evidence"]) > 0)), "replacement"),
    ]
    issue = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        issue = F.when(broken, F.lit(name)).otherwise(issue)
    return v, F.when(raw.isNotNull(), issue)


def revisions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges (id, next), issues (id, issue)) of records (id, scope, name, sha, topic, facet, supersedes, superseded_by, pins).

    A name that a record supersedes, or is superseded by, must be that of exactly one other record of the scope with the
    same fact; an untracked predecessor (without topic) will do if the record pins its content. Else the record has an issue.
    """
    named = records.groupBy("scope", F.col("name").alias("to_name")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("to"), F.min("topic").alias("to_topic"), F.min("facet").alias("to_facet"), F.min("sha").alias("to_sha"))
    old = records.select("id", "scope", "topic", "facet", "pins", F.explode("supersedes").alias("to_name")).withColumn("back", F.lit(True))
    new = records.where("superseded_by is not null").select("id", "scope", "topic", "facet", "pins", F.col("superseded_by").alias("to_name")).withColumn("back", F.lit(False))
    met = old.unionByName(new).join(named, ["scope", "to_name"], "left")
    same = (F.col("topic") == F.col("to_topic")) & (F.col("facet") == F.col("to_facet"))
    pinned = F.col("back") & F.col("to_topic").isNull() & (F.try_element_at("pins", F.col("to_name")) == F.col("to_sha"))
    good = F.coalesce((F.col("n") == 1) & (F.col("to") != F.col("id")) & (F.coalesce(same, F.lit(False)) | F.coalesce(pinned, F.lit(False))), F.lit(False))
    met = met.withColumn("good", good)
    edges = met.where("good").select(F.when(F.col("back"), F.col("to")).otherwise(F.col("id")).alias("id"), F.when(F.col("back"), F.col("id")).otherwise(F.col("to")).alias("next")).distinct()
    issues = met.where("not good").groupBy("id").agg(F.max(F.when(F.col("back"), "predecessor").otherwise("successor")).alias("issue"))
    return edges, issues


def states(records: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """(id, state, current, current_ids, conflicts) of records (id, scope, topic, facet, status, valid_from, valid_to, issue).

    state: untracked, scheduled, expired, superseded (a started successor that isn't proposed stands in its place), disputed
    (it is current, and so is another record of the same fact), else what is declared.
    """
    reach = staged(resolved(records, edges, as_of), "reach")
    mine = reach.groupBy("id").agg(F.array_sort(F.collect_set("current")).alias("current_ids"), F.max((F.col("id") == F.col("current")).cast("int")).alias("is_current"))
    heads = reach.where("id = current").select("id").join(records.where("topic is not null"), "id").select("id", "scope", "topic", "facet")
    of_fact = heads.groupBy("scope", "topic", "facet").agg(F.collect_set("id").alias("heads")).where(F.size("heads") > 1)
    peers = heads.join(of_fact, ["scope", "topic", "facet"]).select("id", F.array_sort(F.array_except("heads", F.array("id"))).alias("conflicts"))
    took = edges.join(records.where(started(as_of) & (F.col("status") != "proposed")).select(F.col("id").alias("next")), "next", "left_semi").select("id", F.lit(True).alias("taken")).distinct()
    d = records.join(mine, "id", "left").join(peers, "id", "left").join(took, "id", "left")
    head = F.coalesce(F.col("is_current") == 1, F.lit(False))
    none = F.array().cast(records.schema["id"].dataType.simpleString().join(["array<", ">"]))
    state = (
        F.when(~started(as_of), "scheduled").when(F.coalesce(as_of >= F.col("valid_to"), F.lit(False)), "expired").when(~head & F.col("taken"), "superseded").when(head & F.col("conflicts").isNotNull(), "disputed")
        .when(F.col("topic").isNull(), "untracked").otherwise(F.col("status"))
    )
    return d.withColumn("state", state).select("id", "state", (head & (F.col("state") == "active")).alias("current"), F.coalesce("current_ids", none).alias("current_ids"), F.coalesce("conflicts", none).alias("conflicts"))


def in_cycles(edges: DataFrame) -> DataFrame:
    """(id) of the records that a chain of edges through another record leads back to."""
    return chains.cyclic_components(edges).select("id")


# What makes a record worth a look, in order, and how urgent that is.
REASONS = {"cycle": 0, "invalid": 0, "untracked": 3, "conflict": 1, "pending": 2, "no-evidence": 3, "no-start": 3, "no-kind": 3}


def review(records: DataFrame, state: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(id, state, flags, priority): what a person should look at. flags in the order of REASONS, priority is that of the most
    urgent one. Evidence and a start are missed in active, proposed and disputed records; conflict is being disputed."""
    d = records.join(state.select("id", "state"), "id").join(cyclic.select("id").distinct().withColumn("cyclic", F.lit(True)), "id", "left")
    open_ = F.col("state").isin("active", "proposed", "disputed")
    rules = {
        "cycle": F.col("cyclic"), "invalid": F.col("issue").isNotNull(), "untracked": F.col("state") == "untracked", "conflict": F.col("state") == "disputed", "pending": F.col("state") == "proposed",
        "no-evidence": open_ & (F.coalesce(F.size("evidence"), F.lit(0)) < 1), "no-start": open_ & F.col("valid_from").isNull(), "no-kind": F.trim(F.coalesce("kind", F.lit(""))) == "",
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(x)) for x, c in rules.items()]))
    urgent = F.least(*[F.when(c, F.lit(REASONS[x])) for x, c in rules.items()])
    return d.select("id", "state", flags.alias("flags"), urgent.alias("priority")).where("priority is not null")


def review_counts(records: DataFrame, state: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(what, value, n): how many records have each state, reason, kind and source."""
    each = records.join(state.select("id", "state"), "id").join(reviewed.select("id", "flags"), "id", "left")
    pairs = [("state", "state"), ("kind", "kind"), ("source", "source")]
    of = F.concat(F.array(*[F.struct(F.lit(w).alias("what"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for w, c in pairs]), F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.struct(F.lit("reason").alias("what"), f.alias("value"))))
    return each.select(F.explode(of).alias("x")).groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))


def review_page(reviewed: DataFrame, records: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of what to look at: the most urgent first, then by scope, name and id."""
    return reviewed.join(records.select("id", "scope", "name"), "id").orderBy("priority", "scope", "name", "id").offset(offset).limit(limit)


def competing(incoming: DataFrame, records: DataFrame, edges: DataFrame, moments: list) -> DataFrame:
    """(key, at, head): for new records (key, scope, topic, facet, valid_from, supersedes), the current records of the fact, at
    each of the moments from the new one's start on, that it doesn't supersede. All moments are resolved together: what
    follows what is one graph for each of them."""
    each = F.explode(F.array(*map(F.lit, moments))).alias("at")
    at_once = records.select("*", each).withColumn("id", F.struct("at", "id"))
    steps = edges.select("id", "next", each).select(F.struct("at", "id").alias("id"), F.struct("at", F.col("next").alias("id")).alias("next"))
    heads = resolved(at_once, steps, F.col("at")).where("id = current").select("id.at", "id.id").join(records.select("id", "name", "scope", "topic", "facet"), "id")
    met = incoming.join(heads, ["scope", "topic", "facet"]).where(F.col("valid_from") <= F.col("at")).where(~F.array_contains("supersedes", F.col("name")))
    return met.select("key", "at", F.col("id").alias("head"))


def missing_facts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item, missing): facts of items (item, facts, golds) that stand in no text of their linked documents (name, text)."""
    each = items.select("item", "facts", F.explode("golds").alias("name")).join(docs.select("name", "text"), "name")
    held = each.select("item", F.explode(F.filter("facts", lambda f: F.contains("text", f))).alias("fact")).distinct()
    wanted = items.where(F.size("golds") > 0).select("item", F.explode("facts").alias("fact")).distinct()
    return wanted.join(held, ["item", "fact"], "left_anti").groupBy("item").agg(F.array_sort(F.collect_list("fact")).alias("missing"))


def item_verdicts(items: DataFrame, ranks: DataFrame, kinds: DataFrame, directive_kinds: list[str], top: int = 3) -> DataFrame:
    """(item, verdict) of items (item, role, golds): directive-kept, no-link, at-risk, safe, if-asked or needs-terms.

    ranks (item, gold, full, rank, attached) tell where the whole item, and its short form, find a gold; rank is null or 0
    where they don't. kinds (name, kind) tell by its links whether an item without a role is a directive.
    """
    near = F.col("rank").between(1, top)
    of = ranks.groupBy("item").agg(
        F.max(F.col("full") & (F.coalesce(near, F.lit(False)) | F.col("attached"))).alias("reached"), F.max(~F.col("full") & F.col("attached")).alias("attached"),
        F.max(~F.col("full") & F.coalesce(near, F.lit(False))).alias("short"),
    )
    told = items.select("item", F.explode("golds").alias("name")).join(kinds, "name").groupBy("item").agg(F.max(F.col("kind").isin(directive_kinds)).alias("told"))
    d = items.join(of, "item", "left").join(told, "item", "left")
    directive = (F.col("role") == "directives") | ((F.col("role") != "progress") & F.coalesce("told", F.lit(False)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    verdict = F.when(directive, "directive-kept").when(F.size("golds") == 0, "no-link").when(~yes("reached"), "at-risk").when(yes("attached"), "safe").when(yes("short"), "if-asked").otherwise("needs-terms")
    return d.select("item", verdict.alias("verdict"))


def carriers(items: DataFrame, rules: DataFrame, attached: DataFrame) -> DataFrame:
    """(item, layer) of directive and signal items (item, role, golds): behaviour (a rule (rule, memory) names a gold), topic
    (a short query attaches one: (item)), undecidable (no link), else core."""
    d = items.where(F.col("role").isin("directives", "signals"))
    ruled = d.select("item", F.explode("golds").alias("memory")).join(rules.select("memory").distinct(), "memory", "left_semi").select("item", F.lit(True).alias("ruled")).distinct()
    met = attached.select("item", F.lit(True).alias("met")).distinct()
    return d.join(ruled, "item", "left").join(met, "item", "left").select("item", F.when(F.col("ruled"), "behaviour").when(F.col("met"), "topic").when(F.size("golds") == 0, "undecidable").otherwise("core").alias("layer"))


def usable_identities(records: DataFrame, edges: DataFrame, cyclic: DataFrame, shas: DataFrame) -> DataFrame:
    """(scope, topic, facet, id): facts that exactly one tracked record of a scope states, where neither it nor any ancestor
    has an issue, is in a cycle or has another content now (shas: id, sha)."""
    bad = records.where("issue is not null").select("id").union(cyclic.select("id")).union(records.join(shas.select("id", F.col("sha").alias("now")), "id", "left").where("now is null or now <> sha").select("id")).distinct()
    tainted = chains.led_to(edges, bad)
    one = records.where("topic is not null").groupBy("scope", "topic", "facet").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return one.join(tainted, "id", "left_anti").select("scope", "topic", "facet", "id")


def fact_cards(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, topic, facet, n, digest): the records of a fact and the untracked ones before them, and a hash of their sorted
    names, paths and contents."""
    own = records.where("topic is not null").select("scope", "topic", "facet", "id")
    untracked = records.where("topic is null").select("id")
    before = chains.Lineage.of(edges).of_groups(own, untracked, ["scope", "topic", "facet"])
    members = own.union(before).distinct().join(records.select("id", "name", "path", "sha"), "id")
    line = F.concat_ws("\u241f", "name", "path", "sha")
    return members.groupBy("scope", "topic", "facet").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("digest"))


def history(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, topic, facet, place, id): the records of a fact in order of their start, how many they come after, and name."""
    depth = chains.Lineage.of(edges).counts().select("id", F.col("n").alias("depth"))
    d = records.where("topic is not null").join(depth, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    by = Window.partitionBy("scope", "topic", "facet").orderBy(F.col("valid_from").asc_nulls_first(), "depth", "name", "id")
    return d.select("scope", "topic", "facet", F.row_number().over(by).alias("place"), "id")


def unified(before: str, after: str, old: str, new: str) -> str:
    """What changed between two texts, line by line."""
    return "\n".join(unified_diff(before.splitlines(), after.splitlines(), fromfile=old, tofile=new, lineterm=""))


def changes(records: DataFrame, edges: DataFrame, most: int = 5, lines: int = 40, chars: int = 1000) -> DataFrame:
    """(id, before, diff, truncated, more): how each record (id, name, body) differs from those that it follows in edges (id, next),
    the first five by id; diff has 40 lines and 1,000 characters at most, more tells whether there are more than five.

    Only neighbours meet, so a version's text is read once for each of them. A null body is empty."""

    @F.pandas_udf("diff string, truncated boolean")
    def diff(before: pd.Series, after: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for whole in map(unified, before, after, old, new):
            head = "\n".join(whole.split("\n")[:lines])
            rows.append((head[:chars], whole.count("\n") >= lines or len(whole) > chars))
        return pd.DataFrame(rows, columns=["diff", "truncated"])

    by = Window.partitionBy("id")
    prev = edges.where("id <> next").select(F.col("next").alias("id"), F.col("id").alias("before")).distinct()
    prev = prev.withColumn("_place", F.row_number().over(by.orderBy("before"))).withColumn("more", F.count(F.lit(1)).over(by) > most).where(F.col("_place") <= most)
    of = lambda x, p: records.select(F.col("id").alias(x), F.coalesce("name", F.lit("")).alias(f"{p}_name"), F.coalesce("body", F.lit("")).alias(f"{p}_body"))
    d = prev.join(of("id", "new"), "id").join(of("before", "old"), "before")
    return d.select("id", "before", diff("old_body", "new_body", "old_name", "new_name").alias("d"), "more").select("id", "before", "d.diff", "d.truncated", "more")


def branches(records: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(scope, topic, facet, branch_topic, branch_facet, names): for the facts of seeds (scope, topic, facet) the other facts that hang
    together with them, by what follows what or by untracked records both come of."""
    fact = ["scope", "topic", "facet"]
    tracked = records.where("topic is not null")
    star = tracked.join(tracked.groupBy(*fact).agg(F.min("id").alias("least")), fact).select(F.col("id").alias("src"), F.col("least").alias("dst"))
    e = edges.select(F.col("id").alias("src"), F.col("next").alias("dst")).union(star).where("src <> dst")
    part = staged(components(records.select(F.col("id").alias("doc_id")), e).select(F.col("doc_id").alias("id"), "component"), "parts")
    of_fact = tracked.join(part, "id").groupBy("component", *fact).agg(F.array_sort(F.collect_list("name")).alias("names"))
    mine = of_fact.join(seeds.select(*fact).distinct(), fact, "left_semi").select("component", *fact)
    other = of_fact.select("component", F.col("scope").alias("_scope"), F.col("topic").alias("branch_topic"), F.col("facet").alias("branch_facet"), "names")
    met = mine.join(other, "component").where("scope <> _scope or topic <> branch_topic or facet <> branch_facet")
    return met.select(*fact, "branch_topic", "branch_facet", "names")
