"""Parsing notes: front matter, document rows, links, aliases, triggers, evidence dates, turns, index files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memolake.functions import text as T

FENCE, SPAN = r"(?s)```.*?```", r"`[^`\n]*`"
FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(map of key to value, body) of a note: the block between the first two lines of three hyphens, quotes stripped,
    comments and empty values skipped, the last of a repeated key kept."""
    block = F.regexp_extract(raw, FRONT, 1)
    body = F.regexp_replace(raw, FRONT.replace("^", r"\A"), "")
    lines = F.filter(F.split(block, "\n"), lambda x: x.contains(":") & ~x.rlike(r"^\s*(#|$)"))
    cut = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"^[\"']+|[\"']+$", "").alias("value"))
    pairs = F.filter(F.transform(lines, cut), lambda p: p["value"] != "")
    # The last of equal keys: those that come again later are left out.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last), body


def note_rows(files: DataFrame, own: str = "memory") -> DataFrame:
    """files (source, path, rel, raw) with the columns of a document: name (the file's stem in source ``own``, else the
    source and the relative path), title (declared, else the first heading, else the name), description, kind, project_id
    (128 characters at most), body, sha."""
    meta, body = front_matter(F.col("raw"))
    d = files.withColumn("_m", meta).withColumn("body", body)
    stem = F.regexp_replace("rel", r"\.[^./]*$", "")
    name = F.when(F.col("source") == own, F.element_at(F.split(stem, "/"), -1)).otherwise(F.concat_ws(":", "source", stem))
    heading = F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return d.withColumn("name", name).select(
        *files.columns, "name", F.coalesce(F.col("_m")["title"], F.when(heading != "", F.trim(heading)), F.replace("name", F.lit("_"), F.lit(" "))).alias("title"),
        empty(F.col("_m")["description"]).alias("description"), empty(F.coalesce(F.col("_m")["type"], F.col("_m")["node_type"])).alias("kind"),
        F.substring(F.trim(empty(F.col("_m")["project_id"])), 1, 128).alias("project_id"), "body", F.sha1("raw").alias("sha"), F.col("_m").alias("meta"),
    )


def prose(raw: Column) -> Column:
    """The text without code."""
    return F.regexp_replace(F.regexp_replace(raw, FENCE, " "), SPAN, " ")


def normal_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), none, lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def links(notes: DataFrame) -> DataFrame:
    """(path, kind, target) of notes (path, name, raw), distinct, outside of code: names of ``[[name|..]]`` without .md and
    without the note's own, and paths of ``](file.md)`` that aren't on the web, taken from the note's folder."""
    text = prose(F.col("raw"))
    wiki = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda t: F.regexp_replace(F.trim(t), r"(?i)\.md$", ""))
    files = F.filter(F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+\.md)\)"), F.lit(1)), lambda t: ~t.rlike("^https?://"))
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    paths = F.transform(files, lambda t: normal_path(F.when(t.startswith("/"), t).otherwise(F.concat_ws("/", folder, t))))
    made = F.concat(F.transform(wiki, lambda t: F.struct(F.lit("name").alias("kind"), t.alias("target"))), F.transform(paths, lambda t: F.struct(F.lit("path").alias("kind"), t.alias("target"))))
    d = notes.select("path", "name", F.explode(F.array_distinct(made)).alias("l"))
    return d.where((F.col("l.target") != "") & ~((F.col("l.kind") == "name") & (F.col("l.target") == F.col("name")))).select("path", "l.kind", "l.target")


def declared_aliases(notes: DataFrame) -> DataFrame:
    """(path, alias, target): labels of ``[label](target.md)`` that have the shape of an identifier and aren't the target."""
    text, rx = prose(F.col("raw")), F.lit(r"\[([^\]\n]{1,64})\]\(([^)\s]+\.md)\)")
    both = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(1)).alias("label"), F.regexp_extract_all(text, rx, F.lit(2)).alias("file"))
    d = notes.select("path", F.explode(both).alias("p")).where(~F.col("p.file").rlike("^https?://"))
    d = d.select("path", F.trim("p.label").alias("alias"), F.regexp_extract("p.file", r"([^/]+)\.[^./]*$", 1).alias("target"))
    return d.where(F.col("alias").rlike("^[a-z0-9][a-z0-9_-]{3,63}$") & (F.col("alias") != F.col("target"))).distinct()


def declared_triggers(meta: Column) -> Column:
    """The phrases of a note's ``triggers`` list, of four characters or more, blanks and case folded."""
    list_of = F.regexp_replace(F.trim(F.coalesce(meta["triggers"], F.lit(""))), r"^[\[\]]+|[\[\]]+$", "")
    phrases = F.transform(F.split(list_of, '",'), lambda t: F.trim(F.regexp_replace(F.trim(t), r"^[\"']+|[\"']+$", "")))
    return F.transform(F.filter(phrases, lambda t: F.length(t) >= 4), lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))


def evidence_date(text: Column, verified: Column, as_of: Column, lifecycle: Column | None = None) -> Column:
    """The verified date; else none where a lifecycle is declared; else the only distinct past date in the text, none where
    there are several."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(20\d{2}-\d{2}-\d{2})"), F.lit(1)), lambda d: F.try_to_date(d))
    past = F.array_distinct(F.filter(found, lambda d: d <= as_of))
    only = F.when(F.size(past) == 1, past[0])
    return F.coalesce(verified, only if lifecycle is None else F.when(lifecycle.isNull(), only))


def exportable(docs: DataFrame, allowed: list[str], now: DataFrame) -> DataFrame:
    """docs (doc_id, source, meta, sha) that may leave: of an allowed source, not declared ``embed: false``, and with the
    content now (doc_id, sha) has."""
    declared = F.lower(F.coalesce(F.col("meta")["embed"], F.lit("")))
    may = docs.where(F.col("source").isin(allowed) & (declared != "false"))
    return may.join(now.select("doc_id", "sha"), ["doc_id", "sha"], "left_semi")


def secret_audit(docs: DataFrame) -> DataFrame:
    """(doc_id, labels, local_only) of docs (doc_id, text, meta) that hold secrets: the shapes, never the values, and whether the
    document is declared ``embed: false``."""
    d = docs.select("doc_id", T.secret_labels(F.col("text")).alias("labels"), (F.lower(F.coalesce(F.col("meta")["embed"], F.lit(""))) == "false").alias("local_only"))
    return d.where(F.size("labels") > 0)


# What a section of an index file is for.
ROLES = ["directives", "signals", "progress"]
INDEX_LINK = r"\[[^\]]*\]\(([A-Za-z0-9_./-]+)\.md\)"


def index_items(files: DataFrame, marker: str = "role", sections: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, line, section, role, raw, golds) of index files (path, raw): one row for each bullet, with the lines that go on
    with it up to a blank one or a heading; golds are the stems of links. The role is that of a marker in the heading,
    ``<!-- marker: role -->``, else the first whose pieces of headings (``sections``) stand in it, else ''."""
    lines = files.select("path", F.posexplode(F.split("raw", "\n")).alias("i", "text"))
    by = Window.partitionBy("path").orderBy("i")
    head, bullet, blank = F.col("text").startswith("## "), F.col("text").rlike("^[-*] "), F.trim("text") == ""
    plain = F.trim(F.regexp_replace(F.substring("text", 4, 1 << 20), r"<!--.*?-->", " "))
    mark = F.lower(F.regexp_extract("text", rf"<!--\s*{re.escape(marker)}:\s*([A-Za-z]+)\s*-->", 1))
    role = F.when(mark.isin(ROLES), mark)
    for name in ROLES:
        for piece in filter(None, (sections or {}).get(name, [])):
            role = role.when(F.contains(plain, F.lit(piece)), F.lit(name))
    d = lines.withColumn("section", F.last(F.when(head, plain), ignorenulls=True).over(by))
    d = d.withColumn("role", F.last(F.when(head, role.otherwise(F.lit(""))), ignorenulls=True).over(by))
    # The start of what a line belongs to; -1 where a heading or a blank line ended it.
    d = d.withColumn("start", F.last(F.when(bullet, F.col("i")).when(head | blank, F.lit(-1)), ignorenulls=True).over(by)).where("start >= 0")
    first = lambda c, x: F.coalesce(F.first(c), F.lit(x))
    out = d.groupBy("path", "start").agg(first("section", "(preamble)").alias("section"), first("role", "").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("raw"))
    golds = F.array_distinct(F.transform(F.regexp_extract_all("raw", F.lit(INDEX_LINK), F.lit(1)), lambda g: F.element_at(F.split(g, "/"), -1)))
    return out.select("path", (F.col("start") + 1).alias("line"), "section", "role", "raw", golds.alias("golds"))


# By language, words that tell when a rule holds, and words that say that it always does. Languages that part
# words by blanks match whole words.
CONDITIONS = {
    "en": ["when", "whenever", "before", "after", "if", "once", "unless", "while", "in case"],
    "de": ["wenn", "bevor", "nachdem", "falls", "sobald", "sofern", "beim", "vor dem"],
    "fr": ["quand", "lorsque", "avant de", "avant d'", "après", "si", "dès que", "au cas où"],
    "es": ["cuando", "antes de", "después de", "si", "en caso de", "al"],
    "ja": ["とき", "時は", "前に", "後に", "場合", "たら", "なら", "際は", "ときは"],
}
ALWAYS = {
    "en": ["always", "never", "at all times", "every time", "without exception"],
    "de": ["immer", "niemals", "nie", "stets", "grundsätzlich", "ausnahmslos"],
    "fr": ["toujours", "jamais", "en tout temps", "sans exception"],
    "es": ["siempre", "nunca", "jamás", "sin excepción"],
    "ja": ["常に", "必ず", "絶対", "いつも", "決して", "例外なく"],
}
SPACED = ["en", "de", "fr", "es"]


def held_markers(text: Column, table: dict[str, list[str]], languages: list[str]) -> Column:
    """The markers of these languages that stand in the text, in order of the table."""
    found = []
    for code in languages:
        for m in table.get(code, []):
            rx = f"(?<!\\w){m}" + (r"(?!\w)" if m[-1].isalnum() else "") if code in SPACED else m
            found.append(F.when(text.rlike(("(?iuU)" if code in SPACED else "") + rx), F.lit(m)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def by_condition(items: DataFrame, languages: list[str]) -> DataFrame:
    """items of directive and signal sections with the markers they hold, outside of code, and a class: conditional,
    unconditional, or undecidable."""
    d = items.where(F.col("role").isin("directives", "signals")).withColumn("_t", F.regexp_replace("raw", SPAN, " "))
    d = d.withColumn("conditions", held_markers(F.col("_t"), CONDITIONS, languages)).withColumn("always", held_markers(F.col("_t"), ALWAYS, languages)).drop("_t")
    return d.withColumn("class", F.when(F.size("conditions") > 0, "conditional").when(F.size("always") > 0, "unconditional").otherwise("undecidable"))


def stale(docs: DataFrame, as_of: Column, limits: dict[str, int], otherwise: int = 180) -> DataFrame:
    """Documents (doc_id, kind, evidence; the date of ``mtime`` where that is a column and evidence is null) older than their kind's limit in days, with age and age over limit."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("kind")], F.lit(otherwise))
    d = docs.withColumn("age", F.date_diff(as_of, F.coalesce("evidence", F.to_date("mtime")) if "mtime" in docs.columns else F.col("evidence"))).withColumn("limit", limit).where(F.col("age") > F.col("limit"))
    return d.select("doc_id", "kind", "age", F.round(F.col("age") / F.col("limit"), 6).alias("over"))


def turns(conversations: DataFrame) -> DataFrame:
    """Rows with turn_no: how many user rows a conversation has had up to each."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.withColumn("turn_no", F.sum((F.col("role") == "user").cast("int")).over(by))
