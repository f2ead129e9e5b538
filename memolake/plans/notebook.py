"""Queries for notes, records of facts, transcripts, signals and passages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memolake.operators import lexical, parse, passages, records, signals
from memolake.plans import sql as S
from memolake.plans.retrieval import Built, round6
from memolake.sources import corpus, transcripts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def doc_id():
    return F.col("doc_id")


@query("""SELECT '/' || source || '/doc_' || doc_id || '.md' AS path, CASE WHEN source = 'src0' THEN '' ELSE source || ':' END || 'doc_' || doc_id AS name,
  CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id WHEN doc_id % 3 = 1 THEN 'Head ' || doc_id ELSE CASE WHEN source = 'src0' THEN '' ELSE source || ':' END || 'doc ' || doc_id END AS title,
  coalesce(lang, '') AS kind, CASE WHEN doc_id % 2 = 0 THEN repeat('p', 128) ELSE '' END AS project_id FROM documents WHERE source IS NOT NULL""")
def p2_note_rows(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").where("source is not null")
    front = text("---\n", F.when(doc_id() % 3 == 0, text("title: 'note ", doc_id(), "'\n")).otherwise(""), "type: ", F.coalesce("lang", F.lit("")), "\n", F.when(doc_id() % 2 == 0, text("project_id: ", F.repeat(F.lit("p"), 200), "\n")).otherwise(""), "---\n")
    raw = text(front, F.when(doc_id() % 3 == 2, "").otherwise(text("# Head ", doc_id(), "\n")), F.regexp_replace("text", "(?m)^#", "-"))
    rel = text("doc_", doc_id(), ".md")
    files = d.select("source", text("/", F.col("source"), "/", rel).alias("path"), rel.alias("rel"), raw.alias("raw"))
    return parse.note_rows(files, "src0").select("path", "name", "title", "kind", "project_id")


@query("""WITH d AS (SELECT doc_id AS i FROM documents) SELECT '/n/a/doc_' || i || '.md' AS path, 'name' AS kind, 'doc_' || (i + 1) AS target FROM d UNION ALL SELECT '/n/a/doc_' || i || '.md', 'name', 'two words' FROM d
UNION ALL SELECT '/n/a/doc_' || i || '.md', 'path', '/n/b/x' || i || '.md' FROM d UNION ALL SELECT '/n/a/doc_' || i || '.md', 'path', '/abs/y.md' FROM d""")
def p3_note_links(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    raw = text("[[doc_", doc_id() + 1, "|label]] and [[doc_", doc_id(), "]] `[[span]]` [[ two words #part]] [[doc_", doc_id() + 1, ".MD]]\n```\n[[fence]] [f](no.md)\n```\n[x](../b/./x", doc_id(), ".md) [w](https://w/z.md) [y](/abs//q/../y.md)")
    return parse.links(d.select(text("/n/a/doc_", doc_id(), ".md").alias("path"), text("doc_", doc_id()).alias("name"), raw.alias("raw")))


@query("""SELECT 'doc_' || doc_id AS path, 'short_' || doc_id AS alias, 'lesson_' || (doc_id % 9) AS target FROM documents""")
def p4_declared_aliases(spark, sf_dir):
    raw = text("[short_", doc_id(), "](a/lesson_", doc_id() % 9, ".md) [Not An Id](b.md) [same-name](x/same-name.md) [abc](d.md) `[span_id](e.md)` [web_id](http://x/y.md)")
    return parse.declared_aliases(corpus.table(spark, sf_dir, "documents").select(text("doc_", doc_id()).alias("path"), raw.alias("raw")))


@query("""SELECT doc_id, 'go on with ' || doc_id AS phrase FROM documents UNION ALL SELECT doc_id, 'it''s over' FROM documents""")
def p6_triggers(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").withColumn("m", F.create_map(F.lit("triggers"), text('["Go  on WITH ', doc_id(), '", "abc", "it\'s over"]')))
    return d.select("doc_id", F.explode(parse.declared_triggers(F.col("m"))).alias("phrase"))


@query("""SELECT doc_id FROM documents WHERE source IN ('src0', 'src2') AND doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def p11_exportable(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).withColumn("meta", F.when(doc_id() % 5 == 0, F.create_map(F.lit("embed"), F.lit("False"))).otherwise(F.create_map(F.lit("a"), F.lit("b"))))
    now = d.where(doc_id() % 11 != 0).select("doc_id", F.when(doc_id() % 7 == 0, "other").otherwise(F.col("sha")).alias("sha")).union(d.where(doc_id() % 11 == 0).select("doc_id", F.when(doc_id() % 7 == 0, "other").otherwise(F.col("sha"))))
    return parse.exportable(d.where("sha is not null"), ["src0", "src2"], now).select("doc_id")


def index_files(spark, sf_dir):
    raw = text("- lead [a](x/doc_", doc_id(), ".md)\n\n## Standing <!-- note: directives -->\n- when ", doc_id(), " [l](doc_", doc_id() + 1, ".md)\n  more [m](b/doc_", doc_id() + 1, ".md) [k](doc_", doc_id() + 2, ".md)\n- never `if` this\nstill it\n\nloose\n## Work <!-- note: progress -->\n* done ads#", 100 + doc_id() % 50, "\n## Other things\n- plain\n## Loose <!-- todo: signals -->\n- odd")
    return corpus.table(spark, sf_dir, "documents").select(text("f", doc_id()).alias("path"), raw.alias("raw"))


SECTIONS = {"directives": ["no such"], "signals": ["Other"]}
ITEMS = """items AS (SELECT 'f' || i AS path, line, section, role, golds FROM (SELECT doc_id AS i FROM documents), LATERAL (SELECT * FROM (VALUES
  (1::BIGINT, '(preamble)', '', ['doc_' || i]), (4, 'Standing', 'directives', ['doc_' || (i + 1), 'doc_' || (i + 2)]), (6, 'Standing', 'directives', []::VARCHAR[]), (11, 'Work', 'progress', []), (13, 'Other things', 'signals', []), (15, 'Loose', '', [])) v(line, section, role, golds)))"""


@query(f"WITH {ITEMS} SELECT path, line, section, role, array_to_string(golds, ',') AS golds FROM items")
def p12_index_items(spark, sf_dir):
    return parse.index_items(index_files(spark, sf_dir), "note", SECTIONS).select("path", F.col("line").cast("long").alias("line"), "section", "role", F.concat_ws(",", "golds").alias("golds"))


@query(f"WITH {ITEMS} SELECT path, line, CASE line WHEN 4 THEN 'conditional' WHEN 6 THEN 'unconditional' ELSE 'undecidable' END AS class, CASE WHEN line = 4 THEN 'when' ELSE '' END AS conditions, CASE WHEN line = 6 THEN 'never' ELSE '' END AS always FROM items WHERE role IN ('directives', 'signals')")
def p13_by_condition(spark, sf_dir):
    d = parse.by_condition(parse.index_items(index_files(spark, sf_dir), "note", SECTIONS), ["en", "de"])
    return d.select("path", F.col("line").cast("long").alias("line"), "class", F.concat_ws(",", "conditions").alias("conditions"), F.concat_ws(",", "always").alias("always"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'fields' WHEN 1 THEN 'topic' WHEN 2 THEN 'status' WHEN 3 THEN 'order' WHEN 4 THEN 'replacement' WHEN 5 THEN 'valid_from' WHEN 6 THEN 'legacy' END AS issue FROM documents""")
def c1_declared(spark, sf_dir):
    bad = ['"odd": 1, "topic": "t"', '"topic": " t"', '"topic": "t", "status": "gone"', '"topic": "t", "valid_from": "2024-02-01", "valid_to": "2024-02-01T00:00:00Z"', '"topic": "t", "supersedes": ["x"]', '"topic": "t", "valid_from": "2024-02-01T10:00:00"', '"topic": "t", "legacy_whole_record_sha": {"x": "0"}', '"topic": "t", "valid_from": "2024-02-01", "evidence": ["e"], "supersedes": ["x"], "change_reason": "r"']
    raw = F.concat(F.lit('{"facet": "f", '), F.element_at(F.array(*map(F.lit, bad)), (doc_id() % 8 + 1).cast("int")), F.lit("}"))
    d = corpus.table(spark, sf_dir, "documents").withColumn("raw", raw)
    return d.select("doc_id", records.declared(F.col("raw"))[1].alias("issue"))


def facts(spark, sf_dir):
    """Records of orders: the fact is the customer's, each supersedes the one before; every 7th names a record that isn't
    there, every 11th is untracked, every 5th proposed."""
    k = F.col("o_orderkey")
    from pyspark.sql import Window

    o = corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = o.withColumn("before", before)
    odd = F.col("o_orderkey") % 11 == 0
    none = F.array().cast("array<string>")
    return o.select(
        k.alias("id"), F.lit("").alias("scope"), text("r", k).alias("name"), F.sha1(k.cast("string")).alias("sha"), F.when(~odd, text("c", F.col("o_custkey"))).alias("topic"), F.when(~odd, "f").alias("facet"),
        F.when(odd, none).when(k % 7 == 0, F.array(text("gone", k))).when(F.col("before").isNotNull(), F.array(text("r", F.col("before")))).otherwise(none).alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"),
        F.when(k % 2 == 0, F.create_map(text("r", F.coalesce("before", F.lit(-1))), F.sha1(F.coalesce("before", F.lit(-1)).cast("string")))).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("pins"),
        F.when(k % 5 == 0, "proposed").otherwise("active").alias("status"), F.col("day").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.when(k % 3 == 0, F.array(F.lit("e"))).otherwise(none).alias("evidence"),
        F.when(k % 4 != 0, "note").alias("kind"), text("/p/", k).alias("path"),
    )


FACTS = """o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate::DATE AS day, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
f AS (SELECT id, c, day, before, id % 11 = 0 AS odd, CASE WHEN id % 11 = 0 THEN NULL ELSE c END AS topic, CASE WHEN id % 5 = 0 THEN 'proposed' ELSE 'active' END AS status FROM o),
named AS (SELECT *, NOT odd AND (id % 7 = 0 OR before IS NOT NULL) AS has FROM f),
good AS (SELECT id, before FROM named WHERE has AND id % 7 <> 0 AND (before % 11 <> 0 OR id % 2 = 0)),
edges AS (SELECT before AS id, id AS next FROM good), issues AS (SELECT id, 'predecessor' AS issue FROM named WHERE has AND id NOT IN (SELECT id FROM good)),
r AS (SELECT f.*, issue FROM f LEFT JOIN issues USING (id))"""
MID = "DATE '1996-06-01'"


@query(f"WITH {FACTS} SELECT id, next FROM edges")
def c3_revisions(spark, sf_dir):
    return records.revisions(facts(spark, sf_dir))[0]


@query(f"WITH {FACTS} SELECT id, issue FROM issues")
def c3_issues(spark, sf_dir):
    return records.revisions(facts(spark, sf_dir))[1]


def with_issues(spark, sf_dir):
    r = facts(spark, sf_dir)
    edges, issues = records.revisions(r)
    return r.join(issues, "id", "left"), edges


WALK = f"""follow AS (SELECT e.id, e.next FROM edges e JOIN r n ON n.id = e.next WHERE n.day <= {MID} AND n.status <> 'proposed' AND n.issue IS NULL),
walk(id, pos) AS (SELECT id, id FROM r UNION SELECT w.id, fo.next FROM walk w JOIN follow fo ON fo.id = w.pos),
ends AS (SELECT id, pos FROM walk WHERE pos NOT IN (SELECT id FROM follow)), reach AS (SELECT e.id, e.pos AS current FROM ends e JOIN r ON r.id = e.pos WHERE r.status = 'active' AND r.day <= {MID} AND r.issue IS NULL)"""


STATES = f"""{WALK}, heads AS (SELECT r.id, topic FROM reach JOIN r ON r.id = reach.id WHERE reach.current = reach.id AND topic IS NOT NULL),
mine AS (SELECT id, list_sort(list(DISTINCT current)) AS cur, bool_or(id = current) AS own FROM reach GROUP BY id), peers AS (SELECT a.id, list_sort(list(b.id)) AS conf FROM heads a JOIN heads b ON a.topic = b.topic AND a.id <> b.id GROUP BY a.id),
took AS (SELECT DISTINCT e.id FROM edges e JOIN r n ON n.id = e.next WHERE n.day <= {MID} AND n.status <> 'proposed'),
states AS (SELECT r.id, coalesce(own, false) AS own, cur, conf, CASE WHEN day > {MID} THEN 'scheduled' WHEN NOT coalesce(own, false) AND r.id IN (SELECT id FROM took) THEN 'superseded' WHEN coalesce(own, false) AND conf IS NOT NULL THEN 'disputed' WHEN topic IS NULL THEN 'untracked' ELSE status END AS state
  FROM r LEFT JOIN mine USING (id) LEFT JOIN peers USING (id))"""


@query(f"WITH RECURSIVE {FACTS}, {STATES} SELECT id, state, own AND state = 'active' AS current, coalesce(array_to_string(cur, ','), '') AS current_ids, coalesce(array_to_string(conf, ','), '') AS conflicts FROM states")
def c5_states(spark, sf_dir):
    r, edges = with_issues(spark, sf_dir)
    s = records.states(r, edges, F.lit("1996-06-01").cast("date"))
    return s.select("id", "state", "current", F.concat_ws(",", F.col("current_ids").cast("array<string>")).alias("current_ids"), F.concat_ws(",", F.col("conflicts").cast("array<string>")).alias("conflicts"))


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 9 AND o_orderkey % 20 = 19 THEN o_orderkey - 9 ELSE o_orderkey + 1 END AS next FROM orders WHERE o_orderkey % 10 < 9 OR o_orderkey % 20 = 19),
w(a, b) AS (SELECT id, next FROM s UNION SELECT a, next FROM w JOIN s ON s.id = w.b) SELECT DISTINCT a AS id FROM w WHERE a = b""")
def c9_in_cycles(spark, sf_dir):
    k = F.col("o_orderkey")
    s = corpus.table(spark, sf_dir, "orders").where((k % 10 < 9) | (k % 20 == 19)).select(k.alias("id"), F.when((k % 10 == 9) & (k % 20 == 19), k - 9).otherwise(k + 1).alias("next"))
    return records.in_cycles(s)


def around(edges):
    """The edges, and those back from every fourth record."""
    return edges.union(edges.where("next % 4 = 0").select(F.col("next").alias("id"), F.col("id").alias("next")))


AROUND = "ring AS (SELECT id, next FROM edges UNION SELECT next, id FROM edges WHERE next % 4 = 0), cyclic AS (SELECT id FROM edges WHERE next % 4 = 0 UNION SELECT next FROM edges WHERE next % 4 = 0)"
REVIEW = f"""{STATES}, {AROUND}, flagged AS (SELECT id, state, list_filter([CASE WHEN id IN (SELECT id FROM cyclic) THEN 'cycle' END, CASE WHEN issue IS NOT NULL THEN 'invalid' END, CASE WHEN state = 'untracked' THEN 'untracked' END, CASE WHEN state = 'disputed' THEN 'conflict' END,
  CASE WHEN state = 'proposed' THEN 'pending' END, CASE WHEN state IN ('active', 'proposed', 'disputed') AND id % 3 <> 0 THEN 'no-evidence' END, CASE WHEN id % 4 = 0 THEN 'no-kind' END], lambda x: x IS NOT NULL) AS flags FROM r JOIN states USING (id))"""


def reviewed(spark, sf_dir):
    r, edges = with_issues(spark, sf_dir)
    state = records.states(r, edges, F.lit("1996-06-01").cast("date"))
    return r, state, records.review(r, state, records.in_cycles(around(edges)))


@query(f"""WITH RECURSIVE {FACTS}, {REVIEW} SELECT id, state, array_to_string(flags, ',') AS flags, CASE WHEN list_has_any(flags, ['cycle', 'invalid']) THEN 0 WHEN list_contains(flags, 'conflict') THEN 1 WHEN list_contains(flags, 'pending') THEN 2 ELSE 3 END AS priority FROM flagged WHERE len(flags) > 0""")
def c8_review(spark, sf_dir):
    return reviewed(spark, sf_dir)[2].select("id", "state", F.concat_ws(",", "flags").alias("flags"), "priority")


@query(f"""WITH RECURSIVE {FACTS}, {REVIEW} SELECT what, value, count(*) AS n FROM (SELECT 'state' AS what, state AS value FROM flagged UNION ALL SELECT 'reason', unnest(flags) FROM flagged UNION ALL SELECT 'kind', CASE WHEN id % 4 <> 0 THEN 'note' ELSE '' END FROM flagged UNION ALL SELECT 'source', 's' || id % 3 FROM flagged) GROUP BY ALL""")
def c8_counts(spark, sf_dir):
    r, state, found = reviewed(spark, sf_dir)
    return records.review_counts(r.withColumn("source", text("s", F.col("id") % 3)), state, found)


@query(f"""WITH RECURSIVE {FACTS}, {REVIEW} SELECT id, array_to_string(flags, ',') AS flags FROM flagged WHERE len(flags) > 0 ORDER BY CASE WHEN list_has_any(flags, ['cycle', 'invalid']) THEN 0 WHEN list_contains(flags, 'conflict') THEN 1 WHEN list_contains(flags, 'pending') THEN 2 ELSE 3 END, 'r' || id, id LIMIT 25 OFFSET 50""")
def c8_page(spark, sf_dir):
    r, _, found = reviewed(spark, sf_dir)
    return records.review_page(found, r, 50, 25).select("id", F.concat_ws(",", "flags").alias("flags"))


@query(f"""WITH RECURSIVE {FACTS}, up(id, anc) AS (SELECT next, id FROM edges UNION SELECT up.id, e.id FROM up JOIN edges e ON e.next = up.anc), deep AS (SELECT id, count(*) AS depth FROM up GROUP BY id)
SELECT 'c' || topic AS topic, row_number() OVER (PARTITION BY topic ORDER BY day, coalesce(depth, 0), 'r' || id)::INT AS place, id FROM f LEFT JOIN deep USING (id) WHERE topic IS NOT NULL""")
def c7_history(spark, sf_dir):
    r, edges = with_issues(spark, sf_dir)
    return records.history(r, edges).select("topic", "place", "id")


@query(f"""WITH RECURSIVE {FACTS}, {AROUND}, up(id, anc) AS (SELECT next, id FROM ring UNION SELECT up.id, e.id FROM up JOIN ring e ON e.next = up.anc),
bad AS (SELECT id FROM issues UNION SELECT id FROM f WHERE id % 13 = 0 UNION SELECT id FROM cyclic), tainted AS (SELECT id FROM bad UNION SELECT up.id FROM up JOIN bad ON bad.id = anc)
SELECT topic, min(id) AS id FROM (SELECT topic, id, count(*) OVER (PARTITION BY topic) AS n FROM (SELECT id, 'c' || topic || '/' || (id // 3) AS topic FROM f WHERE topic IS NOT NULL)) WHERE n = 1 AND id NOT IN (SELECT id FROM tainted) GROUP BY topic""")
def c16_usable_identities(spark, sf_dir):
    r, edges = with_issues(spark, sf_dir)
    r = r.withColumn("topic", F.concat("topic", F.lit("/"), F.floor(F.col("id") / 3).cast("string")))
    shas = r.select("id", F.when(F.col("id") % 13 == 0, "other").otherwise(F.col("sha")).alias("sha"))
    edges = around(edges)
    return records.usable_identities(r, edges, records.in_cycles(edges), shas).select("topic", "id")


@query(f"""WITH RECURSIVE {FACTS}, up(id, anc) AS (SELECT next, id FROM edges UNION SELECT up.id, e.id FROM up JOIN edges e ON e.next = up.anc),
m AS (SELECT topic, id FROM f WHERE topic IS NOT NULL UNION SELECT f.topic, anc FROM f JOIN up USING (id) WHERE f.topic IS NOT NULL AND anc % 11 = 0)
SELECT 'c' || topic AS topic, count(*) AS n, sha256(string_agg(l, chr(10) ORDER BY l)) AS digest FROM (SELECT topic, 'r' || id || '␟/p/' || id || '␟' || sha1(id::VARCHAR) AS l FROM m) GROUP BY topic""")
def c17_fact_cards(spark, sf_dir):
    r, edges = with_issues(spark, sf_dir)
    return records.fact_cards(r, edges).select("topic", "n", "digest")


def _heads(day: str) -> str:
    """The current records of each fact as of a day."""
    return WALK.replace(MID, f"DATE '{day}'")


MOMENTS = ["1994-03-01", "1996-06-01", "1997-12-31"]
_AT = "\nUNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_heads(m)} SELECT DATE '{m}' AS at, r.id, topic FROM reach JOIN r ON r.id = reach.id WHERE reach.current = reach.id AND topic IS NOT NULL)" for m in MOMENTS)


@query(f"""WITH RECURSIVE {FACTS}, heads AS ({_AT})
SELECT o_custkey AS key, h.at, h.id AS head FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 0) JOIN heads h ON topic = o_custkey WHERE h.id % 2 = 0 AND h.at >= DATE '1995-01-01'""")
def c11_competing(spark, sf_dir):
    import datetime

    r, edges = with_issues(spark, sf_dir)
    custom = corpus.table(spark, sf_dir, "orders").where("o_custkey % 3 = 0")
    odd = custom.where("o_orderkey % 2 = 1").groupBy("o_custkey").agg(F.collect_set(text("r", F.col("o_orderkey"))).alias("odd"))
    new = custom.select("o_custkey").distinct().join(odd, "o_custkey", "left").select(F.col("o_custkey").alias("key"), F.lit("").alias("scope"), text("c", F.col("o_custkey")).alias("topic"), F.lit("f").alias("facet"), F.lit("1995-01-01").cast("date").alias("valid_from"), F.coalesce("odd", F.array().cast("array<string>")).alias("supersedes"))
    return records.competing(new, r, edges, [datetime.date.fromisoformat(m) for m in MOMENTS])


@query("""WITH d AS (SELECT doc_id AS i FROM documents) SELECT i AS item, CASE WHEN i % 3 = 0 THEN 'doc' || (i + 7) || '.md' ELSE 'ads#12345,doc' || (i + 7) || '.md' END AS missing FROM d""")
def c13_missing_facts(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    items = d.select(doc_id().alias("item"), F.array(F.lit("ads#12345"), text("doc", doc_id() + 7, ".md"), text("file", doc_id(), ".md")).alias("facts"), F.array(text("n", doc_id()), text("m", doc_id())).alias("golds"))
    docs = d.select(text("n", doc_id()).alias("name"), text("about file", doc_id(), ".md").alias("text")).union(d.where(doc_id() % 3 == 0).select(text("m", doc_id()), F.lit("pull ads#12345")))
    return records.missing_facts(items, docs).select("item", F.concat_ws(",", "missing").alias("missing"))


@query("""SELECT doc_id AS item, CASE WHEN doc_id % 10 = 0 OR doc_id % 10 = 1 AND doc_id % 4 = 1 THEN 'directive-kept' WHEN doc_id % 10 = 2 THEN 'no-link' WHEN doc_id % 6 IN (0, 1) THEN 'at-risk' WHEN doc_id % 6 = 2 THEN 'safe' WHEN doc_id % 6 = 3 THEN 'if-asked' ELSE 'needs-terms' END AS verdict FROM documents""")
def c14_item_verdicts(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select(doc_id().alias("item"))
    i = F.col("item")
    role = F.when(i % 10 == 0, "directives").when(i % 10 == 1, "").otherwise("progress")
    items = d.select("item", role.alias("role"), F.when(i % 10 == 2, F.array().cast("array<string>")).otherwise(F.array(text("g", i))).alias("golds"))
    ranks = d.select("item", text("g", i).alias("gold"), F.lit(True).alias("full"), F.when(i % 6 > 1, F.lit(2)).when(i % 6 == 1, F.lit(4)).alias("rank"), F.lit(False).alias("attached"))
    short = d.select("item", text("g", i), F.lit(False), F.when(i % 6 == 3, F.lit(3)).otherwise(F.lit(0)), (i % 6 == 2))
    kinds = d.select(text("g", i).alias("name"), F.when(i % 4 == 1, "feedback").otherwise("note").alias("kind"))
    return records.item_verdicts(items, ranks.union(short), kinds, ["feedback"])


@query("""SELECT doc_id AS item, CASE WHEN doc_id % 4 <> 3 AND doc_id % 5 = 0 THEN 'behaviour' WHEN doc_id % 7 = 0 THEN 'topic' WHEN doc_id % 4 = 3 THEN 'undecidable' ELSE 'core' END AS layer FROM documents WHERE doc_id % 3 <> 2""")
def c15_carriers(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select(doc_id().alias("item"))
    i = F.col("item")
    items = d.select("item", F.when(i % 3 == 0, "directives").when(i % 3 == 1, "signals").otherwise("progress").alias("role"), F.when(i % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), text("g", i))).alias("golds"))
    rules = d.where(i % 5 == 0).select(F.lit("r").alias("rule"), text("g", i).alias("memory"))
    return records.carriers(items, rules, d.where(i % 7 == 0))


@query()
def t17_changes(spark, sf_dir):
    """Documents as versions: each follows the one before, every fourth begins anew, and every tenth follows the one before that too."""
    d = corpus.table(spark, sf_dir, "documents").select(doc_id().alias("id"), text("doc", doc_id()).alias("name"), F.col("text").alias("body"))
    i = F.col("id")
    edges = d.where(i % 4 != 3).select("id", (i + 1).alias("next")).union(d.where(i % 10 == 8).select("id", i + 2))
    return records.changes(d, edges)


@query(f"""WITH RECURSIVE {FACTS}, g AS (SELECT id, topic || '/' || id % 2 AS t FROM f), near AS (SELECT id AS a, next AS b FROM edges UNION SELECT next, id FROM edges UNION SELECT x.id, y.id FROM g x JOIN g y ON x.t = y.t AND x.id <> y.id),
w(a, b) AS (SELECT id, id FROM f WHERE topic % 50 = 1 UNION SELECT w.a, n.b FROM w JOIN near n ON n.a = w.b),
pairs AS (SELECT DISTINCT x.t AS topic, y.t AS branch_topic FROM w JOIN g x ON x.id = a JOIN g y ON y.id = b WHERE x.t <> y.t)
SELECT 'c' || topic AS topic, 'c' || branch_topic AS branch_topic, (SELECT string_agg('r' || id, ',' ORDER BY 'r' || id) FROM g WHERE t = branch_topic) AS names FROM pairs""")
def c7_branches(spark, sf_dir):
    """Two facts to a customer, by even and odd orders, that follow each other; those of every fiftieth customer are asked for."""
    r, edges = with_issues(spark, sf_dir)
    r = r.withColumn("topic", F.concat("topic", F.lit("/"), (F.col("id") % 2).cast("string")))
    seeds = r.where(F.regexp_extract("topic", "^c([0-9]+)/", 1).try_cast("long") % 50 == 1)
    return records.branches(r, edges, seeds).select("topic", "branch_topic", F.concat_ws(",", "names").alias("names"))
