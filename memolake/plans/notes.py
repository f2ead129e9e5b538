"""Queries for parsing, evaluation and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memolake.operators import evaluate, parse, shrink
from memolake.plans.retrieval import GOLD, RESULTS, Built, gold
from memolake.plans import sql as S
from memolake.sources import corpus

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, 'note ' || doc_id AS title, lang AS kind, 3::INT AS n_keys, sha1(text) AS body_sha FROM documents")
def p1_front_matter(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("---\ntitle: \"note "), F.col("doc_id").cast("string"), F.lit("\"\n# remark: no\nkind: old\n  kind: "), F.col("lang"), F.lit("\nempty:\nsource: "), F.col("source"), F.lit("\n---\n"), F.col("text"))
    meta, body = parse.front_matter(F.col("raw"))
    d = d.select("doc_id", raw.alias("raw")).select("doc_id", meta.alias("m"), body.alias("body"))
    return d.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["kind"].alias("kind"), F.size("m").alias("n_keys"), F.sha1("body").alias("body_sha"))


@query("""WITH o AS (SELECT o_orderkey AS k, (o_orderdate::DATE + INTERVAL 10 YEAR)::DATE AS day FROM orders)
SELECT k AS doc_id, CASE WHEN k % 5 = 0 THEN DATE '2006-06-01' WHEN k % 7 = 0 THEN NULL WHEN day > DATE '2007-01-01' THEN NULL WHEN k % 3 = 0 AND day + 1 <= DATE '2007-01-01' THEN NULL ELSE day END AS evidence FROM o""")
def p5_evidence_date(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").withColumn("day", F.add_months(F.to_date("o_orderdate"), 120))
    text = F.concat(F.lit("seen "), F.col("day").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" and "), F.date_add("day", 1).cast("string"))).otherwise(F.lit(" twice")))
    verified = F.when(F.col("o_orderkey") % 5 == 0, F.lit("2006-06-01").cast("date"))
    lifecycle = F.when(F.col("o_orderkey") % 7 == 0, F.lit("{}"))
    return o.select(F.col("o_orderkey").alias("doc_id"), parse.evidence_date(text, verified, F.lit("2007-01-01").cast("date"), lifecycle).alias("evidence"))


@query("""SELECT doc_id, kind, age::INT AS age, round(age / lim::DOUBLE, 6) AS over FROM (SELECT o_orderkey AS doc_id, o_orderpriority AS kind, DATE '1998-08-02' - o_orderdate::DATE AS age, CASE o_orderpriority WHEN '1-URGENT' THEN 21 WHEN '5-LOW' THEN 360 ELSE 180 END AS lim FROM orders) WHERE age > lim""")
def l9_stale(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("evidence"))
    return parse.stale(o, F.lit("1998-08-02").cast("date"), {"1-URGENT": 21, "5-LOW": 360})


@query("SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM conversations")
def n12_turns(spark, sf_dir):
    return parse.turns(corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"))


@query("SELECT event_type, count(*) FILTER (event_id % 50 <> 0) AS read, count(*) FILTER (event_id % 50 = 0) AS broken, sum((props::JSON->>'k')::INT) FILTER (event_id % 50 <> 0)::BIGINT AS total FROM events GROUP BY event_type")
def io2_log_lines(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("x"), "props")).otherwise(F.col("props")))
    r = e.select("event_type", F.from_json("line", "k int, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    bad = F.col("j._corrupt_record").isNotNull()
    return r.groupBy("event_type").agg(F.count(F.when(~bad, 1)).alias("read"), F.count(F.when(bad, 1)).alias("broken"), F.sum("j.k").alias("total"))


@query(f"{RESULTS} SELECT round(max(score), 6) AS floor, greatest(1.5, round(max(score) * 1.35::DOUBLE, 2)) AS threshold FROM results WHERE qid % 2 = 1")
def n3_noise_floor(spark, sf_dir):
    r = Built(spark, sf_dir).recall(corpus.benchmark_queries(spark, sf_dir), 8)
    return evaluate.noise_floor(r, F.col("qid") % 2 == 1)


WIDE = f"WITH {S.INDEX}, {S.asked(S.BENCH)}, {S.CHOSEN}, {S.RECALL}, {S.results(100)}"


@query(f"""{WIDE}, {GOLD}, ranks AS (SELECT g.qid, min(rank) AS rank FROM gold g LEFT JOIN results r USING (qid, doc_id) GROUP BY g.qid)
SELECT CASE WHEN rank <= 3 THEN '1-3' WHEN rank <= 10 THEN '4-10' WHEN rank <= 30 THEN '11-30' WHEN rank <= 100 THEN '31-100' ELSE 'absent' END AS band, count(*) AS n FROM ranks GROUP BY 1""")
def n15_miss_bands(spark, sf_dir):
    queries = corpus.benchmark_queries(spark, sf_dir)
    return evaluate.miss_bands(Built(spark, sf_dir).recall(queries, 100), gold(spark, sf_dir, queries))


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, b - a AS d FROM (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL),
n AS (SELECT count(*) AS n FROM c), draws AS (SELECT r, ('0x' || substr(md5(r || ':' || k), 1, 8))::BIGINT % n AS i FROM range(200) x(r), n, range(n) y(k)),
m AS (SELECT r, avg(d) AS m FROM draws JOIN c USING (i) GROUP BY r), p AS (SELECT m, row_number() OVER (ORDER BY m) AS p FROM m)
SELECT count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS worse, round(avg(d), 6) AS mean, (SELECT round(m, 6) FROM p WHERE p = 5) AS low, (SELECT round(m, 6) FROM p WHERE p = 195) AS high FROM c""")
def n9_paired(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    half = lambda r: F.avg(F.when(F.col("event_id") % 2 == r, F.col("value")))
    return evaluate.paired(e.groupBy(F.col("user_id").alias("case")).agg(half(0).alias("a"), half(1).alias("b")).where("a is not null and b is not null"))


@query("WITH a AS (SELECT event_type AS axis, avg(value) AS raw, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS w FROM events WHERE event_type <> 'signup' GROUP BY event_type) SELECT round(sum(least(100, raw * 100::DOUBLE / 60) * w) / sum(w), 6) AS total, count(*) AS measured FROM a")
def u12_scorecard(spark, sf_dir):
    axes = corpus.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("axis")).agg(F.avg(F.when(F.col("event_type") != "signup", F.col("value"))).alias("raw"))
    kinds = ["view", "click", "purchase", "error", "signup"]
    return evaluate.scorecard(axes, dict(zip(kinds, [3.0, 2.0, 1.0, 1.0, 1.0])), dict.fromkeys(kinds, 60.0))


@query("""SELECT key, "at", value FROM (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY "at") AS was FROM (SELECT user_id AS key, event_id AS "at", floor(value / 20)::BIGINT AS value FROM events)) WHERE was IS NULL OR was <> value""")
def n17_moved_only(spark, sf_dir):
    return evaluate.moved_only(corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.floor(F.col("value") / 20).alias("value")))


@query("SELECT u.user_id AS doc_id FROM (SELECT DISTINCT user_id FROM events) u WHERE u.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value > 60)")
def u4_never_recalled(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc_id")).distinct().join(e.where("event_type = 'click' and value > 60").select(F.col("user_id").alias("doc_id")), "doc_id", "left_anti")


SHRINK = r"""i AS (SELECT 'f' || doc_id // 20 AS path, doc_id % 20 + 1 AS line, CASE WHEN doc_id % 20 = 0 THEN 'directives' ELSE '' END AS role, doc_id,
  '- [T](doc_' || doc_id || '.md) — ' || CASE WHEN doc_id % 3 = 0 THEN 'see `' ELSE '' END || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS raw, CASE WHEN doc_id % 7 = 0 THEN [doc_id, doc_id + 1] ELSE [doc_id] END AS golds FROM documents),
src AS (SELECT doc_id AS name, doc_id * 13 % 400 AS age, CASE lang WHEN 'en' THEN doc_id * 13 % 400 >= 180 WHEN 'fr' THEN doc_id * 13 % 400 >= 21 ELSE false END AS stale FROM documents WHERE doc_id % 11 <> 0),
e AS (SELECT i.doc_id, bool_or(src.name IS NULL) AS lost, min(age) AS age, bool_and(coalesce(stale, false)) AS stale FROM (SELECT doc_id, unnest(golds) AS name FROM i) i LEFT JOIN src USING (name) GROUP BY i.doc_id),
el AS (SELECT i.*, e.age, e.stale, CASE WHEN i.doc_id % 5 = 0 THEN 'at-risk' WHEN role <> '' THEN 'section' WHEN lost THEN 'no-source' WHEN i.doc_id % 13 = 0 THEN 'fact-only-here' WHEN age < 7 THEN 'recent' END AS skipped FROM i JOIN e USING (doc_id))"""


def shrinkable(spark, sf_dir):
    """Index files of twenty pointers, each to a document, with its whole text as the hook."""
    d = corpus.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    hook = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    raw = F.concat(F.lit("- [T](doc_"), i.cast("string"), F.lit(".md) — "), F.when(i % 3 == 0, "see `").otherwise(""), hook)
    of = lambda x: F.concat(F.lit("doc_"), x.cast("string"))
    place = [F.concat(F.lit("f"), F.floor(i / 20).cast("string")).alias("path"), (i % 20 + 1).alias("line")]
    items = d.select(*place, F.when(i % 20 == 0, "directives").otherwise("").alias("role"), raw.alias("raw"), F.when(i % 7 == 0, F.array(of(i), of(i + 1))).otherwise(F.array(of(i))).alias("golds"))
    verdicts = d.select(*place, F.when(i % 5 == 0, "at-risk").otherwise("safe").alias("verdict"))
    sources = d.where(i % 11 != 0).select(of(i).alias("name"), F.col("lang").alias("kind"), (i * 13 % 400).alias("age_days"))
    limits = spark.createDataFrame([("en", 180), ("fr", 21)], "kind string, days int")
    return items, shrink.eligible(items, verdicts, sources, d.where(i % 13 == 0).select(*place), limits)


@query(f"WITH {SHRINK} SELECT path, line, coalesce(skipped, '') AS skipped, stale FROM el")
def p14_eligible(spark, sf_dir):
    return shrinkable(spark, sf_dir)[1].select("path", "line", F.coalesce("skipped", F.lit("")).alias("skipped"), "stale")


@query(f"""WITH {SHRINK}, f AS (SELECT path, sum(length(raw) + 1) - 1 AS chars, floor((sum(length(raw) + 1) - 1) * CASE ascii(right(path, 1)) % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.75 ELSE 0.97 END) AS target FROM i GROUP BY path),
h AS (SELECT el.*, chars - target AS over_, trim(substr(raw, instr(raw, ' — ') + 3)) AS hook, substr(raw, 1, instr(raw, ' — ') - 1) AS head FROM el JOIN f USING (path) WHERE skipped IS NULL AND chars > target AND target > 0),
a AS (SELECT *, regexp_extract(hook, '^(.*?[.!?。])\\s', 1) AS one, regexp_extract(hook, '^(.*?)(?: · |; | — | → )', 1) AS two FROM h),
c AS (SELECT *, trim(CASE WHEN one = '' AND two = '' THEN hook WHEN two = '' OR (one <> '' AND length(one) < length(two)) THEN one ELSE two END) AS clause FROM a),
k AS (SELECT *, CASE WHEN length(clause) > 80 THEN rtrim(clause[1:79]) || '…' ELSE clause END AS cut FROM c),
q AS (SELECT *, CASE WHEN (length(cut) - length(replace(cut, '`', ''))) % 2 = 0 THEN cut WHEN rtrim(regexp_replace(cut, '`[^`]*$', '')) = '' THEN '' ELSE rtrim(regexp_replace(cut, '`[^`]*$', '')) || '…' END AS kept FROM k),
n AS (SELECT *, head || CASE WHEN kept = '' THEN '' ELSE ' — ' || kept END AS line_new FROM q), g AS (SELECT *, CASE WHEN length(line_new) < length(raw) THEN length(raw) - length(line_new) END AS gain FROM n),
s AS (SELECT *, gain IS NOT NULL AND coalesce(sum(gain) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < over_ AS short FROM g),
t AS (SELECT *, CASE WHEN short THEN gain ELSE 0 END AS got, sum(CASE WHEN short THEN gain ELSE 0 END) OVER (PARTITION BY path) AS first_got FROM s),
u AS (SELECT *, CASE WHEN stale THEN length(raw) - got + 1 ELSE 0 END AS dropping FROM t),
v AS (SELECT *, stale AND first_got + coalesce(sum(dropping) OVER (PARTITION BY path ORDER BY stale DESC, age DESC, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < over_ AS gone FROM u)
SELECT path, line, CASE WHEN gone THEN 'drop' ELSE 'shorten' END AS action, CASE WHEN NOT gone THEN line_new END AS new, (got + CASE WHEN gone THEN dropping ELSE 0 END)::BIGINT AS saved FROM v WHERE short OR gone""")
def p14_shrink_plan(spark, sf_dir):
    items, touchable = shrinkable(spark, sf_dir)
    chars = items.groupBy("path").agg((F.sum(F.length("raw") + 1) - 1).alias("chars"))
    share = F.element_at(F.array(F.lit(0.3), F.lit(0.75), F.lit(0.97)), F.ascii(F.right("path", F.lit(1))) % 3 + 1)
    return shrink.shrink_plan(chars.withColumn("target", F.floor(F.col("chars") * share)), touchable)
