"""Queries for usage, evaluation, learning, aliases, transcripts and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from memolake.operators import evaluate, exchange, fusion, graph, index, learn, lexical, passages, signals, usage, vector
from memolake.plans import sql as S
from memolake.plans.analytics import CHUNKS, COS, GRAPH, events, lanes, page_graph
from memolake.plans.notebook import doc_id, text
from memolake.plans.retrieval import GOLD, RESULTS, Built, gold, round6
from memolake.sources import corpus, transcripts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def event_id():
    return F.col("event_id")


@query(f"{RESULTS}, q AS ({S.BENCH}) SELECT q.qid, count(r.doc_id) AS hits, coalesce(string_agg('doc_' || r.doc_id, ',' ORDER BY rank) FILTER (rank <= 5), '') AS top FROM q LEFT JOIN results r USING (qid) GROUP BY q.qid")
def u1_recall_log(spark, sf_dir):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    return usage.recall_log(b.recall(q, 8), q, b.docs)[0].select("qid", "hits", F.concat_ws(",", "top").alias("top"))


@query(f"{RESULTS} SELECT doc_id, count(*) AS hits FROM results GROUP BY doc_id")
def u1_usage(spark, sf_dir):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    return usage.recall_log(b.recall(q, 8), q, b.docs)[1]


STALE = "st AS (SELECT o_orderkey AS doc_id, o_orderpriority AS kind, (DATE '1998-08-02' - o_orderdate::DATE)::INT AS age, round((DATE '1998-08-02' - o_orderdate::DATE) / 180::DOUBLE, 6) AS over FROM orders WHERE DATE '1998-08-02' - o_orderdate::DATE > 180)"


def stale_orders(spark, sf_dir):
    from memolake.operators import parse

    o = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("evidence"))
    return parse.stale(o, F.lit("1998-08-02").cast("date"), {"none": 1})


@query(f"WITH {STALE} SELECT doc_id, kind, age, over, doc_id % 3 = 0 AS recalled FROM st")
def u3_stale_evidence(spark, sf_dir):
    s = stale_orders(spark, sf_dir)
    return usage.stale_evidence(s, s.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0).alias("hits")))


@query(f"""WITH {GRAPH}, {STALE}, w AS (SELECT user_id, count(*) AS wrong FROM events WHERE event_type = 'error' GROUP BY user_id), m AS (SELECT text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY text ORDER BY n DESC, text LIMIT 10)
SELECT 'reconnect' AS action, src_id::VARCHAR AS subject, dst_name AS other, 1.0::DOUBLE AS weight FROM h WHERE dst_name NOT IN (SELECT name FROM names) UNION ALL SELECT 'verify', doc_id::VARCHAR, NULL, over FROM st
UNION ALL SELECT 'prune', user_id::VARCHAR, NULL, wrong FROM (SELECT * FROM w WHERE wrong >= 2 ORDER BY wrong DESC, user_id LIMIT 10) UNION ALL SELECT 'missing', text, NULL, n FROM m""")
def u5_suggestions(spark, sf_dir):
    links, names, _, _ = page_graph(spark, sf_dir)
    wrong = events(spark, sf_dir).where("event_type = 'error'").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("wrong"))
    asked = corpus.prompts(spark, sf_dir).select(F.col("text").alias("query"), F.lit(0).alias("hits"))
    twins = spark.createDataFrame([], "a long, b long, overlap double")
    return usage.suggestions(graph.dangling(links, names), stale_orders(spark, sf_dir), twins, wrong, asked)


@query(r"""WITH a AS (SELECT text, conv_id, turn FROM conversations WHERE role = 'user'), q AS (FROM a UNION ALL SELECT upper(replace(replace(text, 'ß', 'ss'), ' ', '   ')), conv_id + 1, turn + 1 FROM a WHERE conv_id % 3 = 0),
k AS (SELECT replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS question, *, DATE '2024-01-01' + (conv_id % 9)::INT AS ts FROM q),
l AS (SELECT question, array_to_string(list_sort(list(DISTINCT conv_id % 40)), ',') AS documents FROM k WHERE turn % 3 > 0 GROUP BY 1)
SELECT question, count(*) AS times, count(DISTINCT conv_id) AS askers, count(DISTINCT ts) AS days, count(*) FILTER (turn % 3 = 0) AS misses, max(ts) AS last, coalesce(any_value(documents), '') AS documents FROM k LEFT JOIN l USING (question) WHERE question <> '' GROUP BY 1 HAVING count(*) >= 2""")
def u8_repeated_questions(spark, sf_dir):
    """User texts, and a third of them again by another person, in capitals and with more blanks; a conversation finds one document."""
    c = corpus.table(spark, sf_dir, "conversations").where("role = 'user'").select("text", "conv_id", "turn")
    again = c.where("conv_id % 3 = 0").select(F.upper(F.replace("text", F.lit(" "), F.lit("   "))), F.col("conv_id") + 1, F.col("turn") + 1)
    c = c.union(again)
    asked = c.select("text", F.col("conv_id").alias("asker"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 9).cast("int")).alias("ts"), (F.col("turn") % 3).alias("hits"))
    out = usage.repeated_questions(asked, c.where("turn % 3 > 0").select("text", (F.col("conv_id") % 40).alias("doc_id")))
    return out.select("question", "times", "askers", "days", "misses", "last", F.concat_ws(",", F.transform("documents", lambda x: x.cast("string"))).alias("documents"))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS sector, count(*) AS n, count(DISTINCT user_id) AS documents FROM events WHERE event_type = 'view' GROUP BY 1")
def u8_sector_activity(spark, sf_dir):
    e = events(spark, sf_dir)
    shown = e.where("event_type = 'view'").select(F.col("user_id").alias("doc_id"), "ts")
    sectors = e.select(F.col("user_id").alias("doc_id")).distinct().withColumn("sector", F.when(doc_id() % 3 == 0, "a").otherwise("b"))
    return usage.activity(shown, sectors)[1]


@query("""SELECT day, views, clicks, errors, round(clicks / nullif(views, 0)::DOUBLE, 3) AS click_rate, round(errors / nullif(buys, 0)::DOUBLE, 3) AS error_rate FROM (
  SELECT ts::DATE AS day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND user_id % 5 = 0) AS buys FROM events GROUP BY 1)""")
def u10_day_metrics(spark, sf_dir):
    kind = lambda c: F.count(F.when(F.expr(c), 1))
    d = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(kind("event_type = 'view'").alias("views"), kind("event_type = 'click'").alias("clicks"), kind("event_type = 'error'").alias("errors"), kind("event_type = 'purchase' and user_id % 5 = 0").alias("buys"))
    return usage.day_metrics(d, {"click_rate": ("clicks", "views"), "error_rate": ("errors", "buys")}).drop("buys")


@query("""WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT day, 'warn' AS level, 'many_errors' AS code FROM d WHERE errors > 2 UNION ALL SELECT day, 'info', 'few_views' FROM d WHERE views < 12""")
def u10_day_facts(spark, sf_dir):
    return usage.day_facts(usage.day_summary(events(spark, sf_dir)), [("warn", "many_errors", "errors > 2"), ("info", "few_views", "views < 12")])


@query("""SELECT event_id AS id FROM events WHERE event_id % 4 <> 1 AND event_id % 6 <> 2 AND event_id % 10 <> 3""")
def u14_consistent_history(spark, sf_dir):
    a, b = (event_id() % 101).cast("double"), F.when(event_id() % 3 == 0, F.lit(None).cast("double")).otherwise((event_id() % 77).cast("double"))
    total = F.round(F.when(b.isNull(), a).otherwise((2 * a + b) / 3), 1)
    e = events(spark, sf_dir).select(event_id().alias("id"), F.when(event_id() % 4 == 1, total + 0.5).otherwise(total).alias("total"), F.when(event_id() % 6 == 2, F.create_map(F.lit("odd"), a, F.lit("b"), b)).when(event_id() % 10 == 3, F.create_map(F.lit("a"), a + 101, F.lit("b"), b)).otherwise(F.create_map(F.lit("a"), a, F.lit("b"), b)).alias("axes"))
    return usage.consistent_history(e, {"a": 2.0, "b": 1.0}).select("id")


@query("""SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)) AS v FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts, CASE WHEN event_id % 4 = 0 THEN value END AS v FROM events QUALIFY count(*) OVER (PARTITION BY user_id, date_trunc('second', ts)) = 1)""")
def u14_carried(spark, sf_dir):
    from pyspark.sql import Window

    e = events(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.when(event_id() % 4 == 0, F.col("value")).alias("v"))
    e = e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "at"))).where("n = 1").drop("n")
    return usage.carried(e, ["v"]).select("event_id", "v")


@query("""SELECT doc_id AS id, doc_id % 6 <> 0 AND doc_id % 7 <> 0 AS current FROM documents""")
def u15_current_analyses(spark, sf_dir):
    d = docs_of(spark, sf_dir).where("true")
    analyses = d.select(doc_id().alias("id"), F.when(doc_id() % 6 == 0, "old").otherwise("now").alias("snapshot"))
    cited = d.where(doc_id() % 6 != 0).select(doc_id().alias("id"), "doc_id", F.when(doc_id() % 7 == 0, "x").otherwise("s").alias("sha"))
    return usage.current_analyses(analyses, cited, d.select("doc_id", F.lit("s").alias("sha")), spark.createDataFrame([("now",)], "snapshot string"))


@query(f"""WITH {S.INDEX}, t AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS i FROM terms, stats WHERE length(term) >= 2 AND df >= greatest(4, floor(n_docs * 0.25)) ORDER BY df DESC, term LIMIT 32)
SELECT i // 4 AS qid, string_agg(term, ' ' ORDER BY i) AS text FROM t GROUP BY 1 HAVING count(*) = 4""")
def n1_common_word_queries(spark, sf_dir):
    b = Built(spark, sf_dir)
    return evaluate.common_word_queries(b.terms, b.stats.first()["n_docs"])


@query(f"""WITH {S.INDEX}, p AS (SELECT term FROM terms, stats WHERE df BETWEEN greatest(3, floor(n_docs * 0.02)) AND greatest(4, floor(n_docs * 0.25)) AND length(term) >= 2 ORDER BY df DESC, term LIMIT 120)
SELECT qid, string_agg(term, ' ' ORDER BY r) AS text FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY md5('23:' || qid || ':' || term)) AS r FROM p, range(14) g(qid)) WHERE r <= 3 GROUP BY qid""")
def n1_word_salad(spark, sf_dir):
    b = Built(spark, sf_dir)
    return evaluate.word_salad(b.terms, b.stats.first()["n_docs"])


@query(f"""WITH {S.DOCS}, s AS (SELECT doc_id, name, i - 1 AS i, trim(s[i]) AS t FROM (SELECT doc_id, name, string_split_regex(body, '[.!?\n。！？…·]') AS s FROM docs WHERE length(body) > 400), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
w AS (SELECT doc_id, i, list_filter({S.words("t")}, lambda x: NOT list_contains({S.words("replace(name, '_', ' ')")}, x)) AS w FROM s WHERE length(t) BETWEEN 26 AND 159),
o AS (SELECT doc_id, arg_min(array_to_string(w[1:5], ' '), md5('7:' || doc_id || ':' || i)) AS text FROM w WHERE len(w) >= 4 GROUP BY doc_id), f AS (SELECT text, min(doc_id) AS doc_id FROM o GROUP BY text)
SELECT doc_id, text FROM f ORDER BY md5('7:' || doc_id), doc_id LIMIT 60""")
def n2_fragments(spark, sf_dir):
    return evaluate.fragments(corpus.documents(spark, sf_dir))


@query("""WITH t AS (SELECT value AS threshold, user_id % 100 / 100.0::DOUBLE AS auto FROM events WHERE event_id % 2 = 0), b AS (SELECT max(user_id % 100 / 100.0::DOUBLE) AS best FROM events WHERE event_id % 50 = 1)
SELECT threshold, auto, best, auto + 0.02::DOUBLE >= best AS allowed FROM t, b""")
def n5_deployable(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("value").alias("threshold"), (F.col("user_id") % 100 / F.lit(100.0)).alias("auto"), "event_id")
    return evaluate.deployable(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 50 = 1").drop("event_id"))


@query()
def n6_best_margin(spark, sf_dir):
    """For each user, a positive fires up to a margin that its value tells, a control down from one."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.when(F.col("event_id") % 2 == 0, (i * 3 <= F.col("value")).cast("int")).otherwise((i * 5 <= F.col("value") - 20).cast("int")))
    return evaluate.best_margin(events(spark, sf_dir).select(F.col("user_id").alias("user"), (event_id() % 2 == 0).alias("positive"), grid.alias("grid")))


@query("""SELECT user_id AS "user", CASE WHEN user_id % 9 = 0 THEN 1.0::DOUBLE ELSE round(avg((event_id % 3 = 0 OR event_id % 5 = 0)::INT), 6) END AS novelty FROM events GROUP BY user_id""")
def n7_novelty(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("user"), event_id().alias("question"), (event_id() % 7).cast("string").alias("answer"))
    q = F.col("question")
    before = e.where("user % 9 <> 0").where(q % 5 != 0).withColumn("answer", F.when(q % 3 == 0, "other").otherwise(F.col("answer")))
    return evaluate.novelty(e, before).withColumn("novelty", round6("novelty"))


@query("""WITH RECURSIVE o AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, 1 + value / 80::DOUBLE AS z, 0.01 + (event_id % 5) * 0.01::DOUBLE AS r, (event_id % 4) / 4.0::DOUBLE AS nu, event_id % 3 = 0 AS proxy FROM events),
k(u, i, x, p, n) AS (SELECT DISTINCT u, 0::BIGINT, 1.35::DOUBLE, 0.0625::DOUBLE, 0 FROM o UNION ALL
  SELECT k.u, k.i + 1, CASE WHEN skip THEN x ELSE greatest(1.0::DOUBLE, least(2.5::DOUBLE, x + q / (q + r / nu) * (z - x))) END, CASE WHEN skip THEN p ELSE (1 - q / (q + r / nu)) * q END, n + (NOT skip)::INT
  FROM (SELECT k.*, o.z, o.r, o.nu, k.p + 0.0004::DOUBLE * o.nu AS q, o.nu <= 0 OR (o.proxy AND o.z < k.x) AS skip FROM k JOIN o ON o.u = k.u AND o.i = k.i + 1) k)
SELECT u AS "user", round(x, 6) AS x, round(p, 9) AS variance, n FROM k QUALIFY row_number() OVER (PARTITION BY u ORDER BY i DESC) = 1""")
def n7_filtered_margin(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("user"), event_id().alias("at"), (1 + F.col("value") / 80).alias("z"), (0.01 + (event_id() % 5) * F.lit(0.01)).alias("r"), (event_id() % 4 / F.lit(4.0)).alias("novelty"), (event_id() % 3 == 0).alias("proxy"))
    return evaluate.filtered_margin(e)


BAND = f"""one AS (SELECT * FROM ({S.PROMPTS}) WHERE NOT contains(text, chr(10)) AND length(text) >= 12), lim AS (SELECT min(n) AS lim FROM (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) AS i, count(*) OVER () AS c FROM one) WHERE i > floor(c * 0.3::DOUBLE)),
band AS (SELECT min(qid) AS qid, text FROM one, lim WHERE length(text) <= lim GROUP BY text)"""


@query(f"WITH {BAND} SELECT qid, text FROM band")
def n10_short_band(spark, sf_dir):
    return evaluate.short_band(corpus.prompts(spark, sf_dir))


@query(f"""WITH {BAND}, {S.INDEX}, {S.asked("SELECT * FROM band")}, {S.CHOSEN}, {S.RECALL}, {S.results(3)}
SELECT band.qid, any_value(text) AS text, CASE WHEN max(score) >= 12 THEN 'A' ELSE 'C' END AS part, string_agg(doc_id, ',' ORDER BY rank) AS candidates FROM band LEFT JOIN results USING (qid) GROUP BY band.qid""")
def n10_draft(spark, sf_dir):
    band = evaluate.short_band(corpus.prompts(spark, sf_dir))
    d = evaluate.draft(band, Built(spark, sf_dir).recall(band, 8), 12.0)
    return d.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query(f"""{RESULTS}, {GOLD}, g AS (SELECT DISTINCT qid FROM gold), att AS (SELECT qid, doc_id FROM (SELECT *, bool_or(score >= 60) OVER (PARTITION BY qid) AS sure, row_number() OVER (PARTITION BY qid, score >= 60 ORDER BY rank) AS n FROM results) WHERE (score >= 60 AND n <= 2) OR (NOT sure AND rank = 1 AND score >= 60 * (7.5::DOUBLE / 9.46) AND ratio >= 0.8)),
best AS (SELECT g.qid, min(rank) AS rank FROM g LEFT JOIN (SELECT r.qid, rank FROM results r JOIN gold USING (qid, doc_id)) r USING (qid) GROUP BY g.qid), files AS (SELECT item_id AS qid, item_id % 7 AS files FROM benchmark),
c AS (SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT qid FROM g)), n AS (SELECT count(*) AS n FROM documents)
SELECT 'search' AS way, (SELECT round(avg(coalesce((rank <= 3)::INT, 0)), 6) FROM best) AS recall_3, (SELECT round(avg((g.qid IN (SELECT a.qid FROM att a JOIN gold USING (qid, doc_id)))::INT), 6) FROM g) AS attach, (SELECT round(avg((qid NOT IN (SELECT qid FROM att))::INT), 6) FROM c) AS specificity, (SELECT round(3.0::DOUBLE / n, 6) FROM n) AS read
UNION ALL SELECT 'grep', round(avg(CASE WHEN qid IN (FROM g) THEN coalesce(least(1.0::DOUBLE, 3.0::DOUBLE / nullif(files, 0)), 0) END), 6), round(avg(CASE WHEN qid IN (FROM g) THEN (files > 0)::INT END), 6), round(avg(CASE WHEN qid NOT IN (FROM g) THEN (files = 0)::INT END), 6), round(avg(files / n::DOUBLE), 6) FROM files, n
UNION ALL SELECT 'mention', round(avg((qid % 2)::INT), 6), NULL, NULL, NULL FROM g""")
def n11_axes(spark, sf_dir):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    r, g = b.recall(q, 8), gold(spark, sf_dir, q)
    controls = q.select("qid").join(g, "qid", "left_anti")
    return evaluate.axes(r, g, lexical.attach(r, 60.0), controls, q.select("qid", (F.col("qid") % 7).alias("files")), q.where("qid % 2 = 1").select("qid"), b.docs.count())


@query()
def n13_label_conflicts(spark, sf_dir):
    """User texts as needed queries; every third with a word more as controls."""
    p = corpus.prompts(spark, sf_dir)
    controls = p.where("qid % 3 = 0").select("qid", F.concat("text", F.lit(" then")).alias("text"))
    return evaluate.label_conflicts(p, controls, p.where("qid % 2 = 0").select("qid"))


@query(f"""WITH {S.DOCS} SELECT item_id AS qid, doc_id FROM benchmark b JOIN docs d ON contains(d.body, b.text) WHERE length(b.text) >= 12""")
def n13_contaminated(spark, sf_dir):
    b = Built(spark, sf_dir)
    return evaluate.contaminated(corpus.benchmark_queries(spark, sf_dir), b.docs, b.terms, b.postings)


OWN_TEXT = "SELECT doc_id AS qid, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> '')[3:9], ' ') AS text FROM documents WHERE text IS NOT NULL"


@query(f"""WITH {S.INDEX}, {S.asked(OWN_TEXT)}, {S.CHOSEN}, {S.RECALL}, {S.results(5)}, own AS (SELECT d.doc_id, r.rank FROM docs d LEFT JOIN results r ON r.qid = d.doc_id AND r.doc_id = d.doc_id)
SELECT count(*) AS asked, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS first, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS in_five FROM own""")
def n14_self_reach(spark, sf_dir):
    b = Built(spark, sf_dir)
    about = F.array_join(F.slice(F.filter(F.split("body", " "), lambda w: w != ""), 3, 7), " ")
    return evaluate.self_reach(b.recall(b.docs.where("body is not null").select(doc_id().alias("qid"), about.alias("text")), 5), b.docs)


@query(f"""{RESULTS}, {GOLD}, lost AS (SELECT qid, doc_id FROM gold g WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.qid = g.qid AND r.doc_id = g.doc_id)), sh AS (SELECT l.qid, l.doc_id, count(p.term) AS n FROM lost l LEFT JOIN asked a USING (qid) LEFT JOIN postings p ON p.doc_id = l.doc_id AND p.term = a.word GROUP BY ALL)
SELECT CASE WHEN n <= 2 THEN 'few-words' ELSE 'outranked' END AS cause, count(*) AS n FROM sh GROUP BY 1""")
def n15_miss_causes(spark, sf_dir):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    return evaluate.miss_causes(b.recall(q, 8), gold(spark, sf_dir, q), q, b.postings)


@query("""SELECT count(*) AS documents, median(length(text))::DOUBLE AS median_chars, round(avg(length(text)), 6) AS mean_chars, 0.0::DOUBLE AS hangul_share, round(sum(length(text)) * 0.25::DOUBLE, 3) AS tokens FROM documents""")
def n16_context_cost(spark, sf_dir):
    return evaluate.context_cost(corpus.documents(spark, sf_dir))


TRIALS = """t AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'h0' ELSE 'h1' END AS host, CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS arm, event_id // 2 AS "case", 0 AS repeat, value AS secs, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 'wrong' ELSE 'correct' END AS state FROM events)"""


def trials(spark, sf_dir):
    e = events(spark, sf_dir)
    answer = F.when(event_id() % 11 == 0, "no json").when(event_id() % 3 == 0, F.lit('{"a": "2"}')).when(event_id() % 7 == 0, F.lit('{"a": "1", "b": "old"}')).otherwise(F.lit('{"a": "1", "b": "x"}'))
    e = e.select(F.when(F.col("user_id") % 2 == 0, "h0").otherwise("h1").alias("host"), F.when(event_id() % 2 == 0, "on").otherwise("off").alias("arm"), F.floor(event_id() / 2).alias("case"), F.lit(0).alias("repeat"), F.col("value").alias("secs"), answer.alias("answer"), F.create_map(F.lit("a"), F.lit("1")).alias("expected"), F.array(F.lit("old")).alias("obsolete"))
    return evaluate.graded(e)


@query(f"""WITH {TRIALS} SELECT host, arm, count(*) AS attempted, count(*) FILTER (state = 'correct') AS correct, count(*) FILTER (state = 'failed') AS failed, quantile_disc(secs, 0.5) AS p50, quantile_disc(secs, 0.95) AS p95 FROM t GROUP BY host, arm""")
def n18_trial_summary(spark, sf_dir):
    return evaluate.trial_summary(trials(spark, sf_dir))


@query(f"""WITH {TRIALS}, p AS (SELECT host, "case", max((state = 'correct')::INT) FILTER (arm = 'on') AS x, max((state = 'correct')::INT) FILTER (arm = 'off') AS y FROM t GROUP BY host, "case")
SELECT host, count(*) FILTER (x > y) AS wins, count(*) FILTER (x < y) AS losses, count(*) FILTER (x = y) AS ties, count(*) FILTER (x IS NULL OR y IS NULL) AS incomplete FROM p GROUP BY host""")
def n18_trial_pairs(spark, sf_dir):
    return evaluate.trial_pairs(trials(spark, sf_dir), "on", "off")


@query("""WITH q AS (SELECT user_id AS qid, user_id % 4 = 0 AS control, max((value >= 50)::INT) AS hi, min((value >= 50)::INT) AS lo FROM events GROUP BY user_id)
SELECT count(*) FILTER (control) AS controls, count(*) FILTER (control AND hi = 1) AS fired, count(*) FILTER (NOT control) AS queries, count(*) FILTER (NOT control AND hi = lo) AS same FROM q""")
def f9_judge_stability(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("qid"), (F.col("user_id") % 4 == 0).alias("control"), event_id().alias("repeat"), F.col("value").alias("score"))
    return evaluate.judge_stability(e, 50.0)


@query(f"""WITH {GRAPH} SELECT DISTINCT doc_id, side, name FROM (SELECT src AS doc_id, 'outgoing' AS side, name FROM e JOIN (SELECT doc_id, min(name) AS name FROM names GROUP BY doc_id) n ON n.doc_id = dst
UNION ALL SELECT dst, 'incoming', name FROM e JOIN (SELECT doc_id, min(name) AS name FROM names GROUP BY doc_id) n ON n.doc_id = src UNION ALL SELECT src_id, 'dangling', dst_name FROM h WHERE dst_name NOT IN (SELECT name FROM names)) WHERE doc_id IN (SELECT doc_id FROM ids)""")
def g3_link_cards(spark, sf_dir):
    links, names, ids, e = page_graph(spark, sf_dir)
    return graph.link_cards(ids, e, graph.dangling(links, names), names)


@query(f"""WITH {GRAPH}, lost AS (SELECT src_id, dst_name || 'x' AS dst_name FROM h), near AS (SELECT t.dst_name, n.name, row_number() OVER (PARTITION BY t.dst_name ORDER BY n.name) AS r FROM (SELECT DISTINCT dst_name FROM lost) t JOIN (SELECT DISTINCT name FROM names) n ON contains(n.name, t.dst_name) OR (length(n.name) >= 2 AND contains(t.dst_name, n.name)))
SELECT src_id, dst_name, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM near WHERE near.dst_name = lost.dst_name AND r <= 3), '') AS near FROM lost""")
def g4_split(spark, sf_dir):
    links, names, _, _ = page_graph(spark, sf_dir)
    return graph.split_dangling(links.select("src_id", F.concat("dst_name", F.lit("x")).alias("dst_name")), names)


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '/n/domains/x' || (doc_id % 4) || '/a' ELSE '/n/a' END AS path, CASE WHEN doc_id % 5 = 0 THEN 'project' ELSE 'note' END AS kind, 'n' || doc_id AS name, coalesce(source, '') AS source FROM documents),
e AS (SELECT doc_id AS src, doc_id + 3 AS dst FROM documents), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), p AS (SELECT b.src AS doc_id, min(d.name) AS project FROM b JOIN d ON d.doc_id = b.dst WHERE kind = 'project' GROUP BY b.src)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' || (doc_id % 4) WHEN kind = 'project' THEN name ELSE coalesce(project, source) END AS sector FROM d LEFT JOIN p USING (doc_id)""")
def g11_sectors(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.when(doc_id() % 9 == 0, text("/n/domains/x", doc_id() % 4, "/a")).otherwise("/n/a").alias("path"), F.when(doc_id() % 5 == 0, "project").otherwise("note").alias("kind"), text("n", doc_id()).alias("name"), F.coalesce("source", F.lit("")).alias("source"))
    return graph.sectors(d, d.select(doc_id().alias("src"), (doc_id() + 3).alias("dst")))


def kinds(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.when(doc_id() % 4 == 0, "lesson").when(doc_id() % 4 == 1, "note").otherwise("").alias("kind"), F.when(doc_id() % 4 == 0, text("lesson_t", doc_id())).when(doc_id() % 4 == 1, text("note-t", doc_id() - 1 + (doc_id() % 8 == 5).cast("int"))).otherwise(text("t", doc_id())).alias("name"))


KINDS = """k AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'lesson' WHEN doc_id % 4 = 1 THEN 'note' ELSE '' END AS kind, CASE WHEN doc_id % 4 = 0 THEN 'lesson_t' || doc_id WHEN doc_id % 4 = 1 THEN 'note-t' || (doc_id - 1 + (doc_id % 8 = 5)::INT) ELSE 't' || doc_id END AS name FROM documents)"""


@query(f"WITH {KINDS} SELECT DISTINCT kind, CASE kind WHEN 'lesson' THEN 'lesson_' ELSE 'note-' END AS prefix FROM k WHERE kind <> ''")
def x8_kind_prefixes(spark, sf_dir):
    return index.kind_prefixes(kinds(spark, sf_dir))


ALIASES = f"""{KINDS}, bare AS (SELECT regexp_replace(name, '^(lesson_|note-)', '') AS alias, doc_id FROM k WHERE kind <> ''), decl AS (SELECT 's' || doc_id AS alias, name AS target, doc_id FROM k WHERE doc_id % 8 = 0),
every AS (SELECT alias, doc_id FROM bare UNION SELECT 'lesson_' || alias, doc_id FROM decl), ka AS (SELECT alias, min(doc_id) AS doc_id FROM every WHERE alias NOT IN (SELECT name FROM k) GROUP BY alias HAVING count(*) = 1)"""


@query(f"WITH {ALIASES} SELECT alias, doc_id FROM ka")
def x8_kind_aliases(spark, sf_dir):
    k = kinds(spark, sf_dir)
    return index.kind_aliases(k, k.where(doc_id() % 8 == 0).select(text("s", doc_id()).alias("alias"), F.col("name").alias("target"), "doc_id"))


@query(f"""WITH {ALIASES} SELECT name, min(doc_id) AS doc_id FROM (SELECT name, doc_id FROM k UNION SELECT 'a' || (doc_id % 50), doc_id FROM k UNION SELECT alias, doc_id FROM decl WHERE alias NOT IN (SELECT name FROM k) UNION SELECT alias, doc_id FROM ka) WHERE name IN (SELECT 't' || item_id FROM benchmark UNION SELECT 'a' || item_id FROM benchmark UNION SELECT 's' || item_id FROM benchmark) GROUP BY name""")
def x9_resolved_names(spark, sf_dir):
    k = kinds(spark, sf_dir)
    declared = k.where(doc_id() % 8 == 0).select(text("s", doc_id()).alias("alias"), F.col("name").alias("target"), "doc_id")
    names = index.name_map(k, k.select(text("a", doc_id() % 50).alias("alias"), "doc_id"), declared, index.kind_aliases(k, declared))
    item = F.col("item_id")
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.explode(F.array(text("t", item), text("a", item), text("s", item))).alias("name"))
    return index.resolved_names(asked, names)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 0.5::DOUBLE ELSE 1.0 END AS weight FROM documents""")
def x10_retained_feedback(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", text("p", doc_id()).alias("path"), text("i", doc_id()).alias("identity"))
    kept = d.where(doc_id() % 3 == 0).select("path", F.when(doc_id() % 5 == 0, "other").otherwise(F.col("identity")).alias("identity"), F.lit(0.5).alias("weight"))
    return index.retained_feedback(d, kept).select("doc_id", "weight")


@query("""WITH s AS (SELECT lang AS language, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT language, round(share, 6) AS share FROM s WHERE share >= 15""")
def x11_corpus_languages(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    s = d.where("lang is not null").groupBy(F.col("lang").alias("language")).agg((F.count(F.lit(1)) * F.lit(100.0) / d.count()).alias("share"))
    return index.corpus_languages(s, 15.0).withColumn("share", round6("share"))


@query(f"""WITH {S.INDEX}, {S.asked(S.BENCH)}, a AS (SELECT qid, arg_min(word, (df, word)) AS src FROM asked JOIN terms ON word = term WHERE df >= 2 GROUP BY qid), n AS (SELECT n_docs FROM stats),
adds AS (SELECT DISTINCT qid, term AS dst FROM (SELECT item_id AS qid FROM benchmark) JOIN postings ON doc_id = qid % 40), ok AS (SELECT adds.qid, src, dst FROM adds JOIN terms ON term = dst JOIN a USING (qid), n WHERE df BETWEEN 2 AND greatest(3, floor(n_docs * 0.25)) AND length(dst) >= 2 AND NOT EXISTS (SELECT 1 FROM asked x WHERE x.qid = adds.qid AND x.word = dst)),
met AS (SELECT src, dst FROM (SELECT DISTINCT src, dst FROM ok) JOIN postings p ON p.term = src JOIN postings q ON q.term = dst AND q.doc_id = p.doc_id GROUP BY src, dst HAVING count(*) >= 3) SELECT src, dst, count(DISTINCT qid) AS seen FROM ok JOIN met USING (src, dst) GROUP BY src, dst""")
def m3_synonyms_from_meaning(spark, sf_dir):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    words = lexical.query_terms(q).select("qid", "word").distinct()
    found = q.select("qid", (F.col("qid") % 40).alias("doc_id")).join(b.postings, "doc_id").select("qid", F.col("term").alias("word"))
    return learn.observed_synonyms(words, found, b.postings, b.terms, b.stats.first()["n_docs"])


@query(f"""WITH {S.INDEX}, {S.asked(S.BENCH)}, a AS (SELECT qid, arg_min(word, (df, word)) AS src FROM asked JOIN terms ON word = term WHERE df >= 2 GROUP BY qid), n AS (SELECT n_docs FROM stats),
adds AS (SELECT DISTINCT a.qid, b.word AS dst FROM asked a JOIN asked b ON b.qid = a.qid + 1), ok AS (SELECT adds.qid, src, dst FROM adds JOIN terms ON term = dst JOIN a USING (qid), n WHERE df BETWEEN 2 AND greatest(3, floor(n_docs * 0.25)) AND NOT EXISTS (SELECT 1 FROM asked x WHERE x.qid = adds.qid AND x.word = dst)),
met AS (SELECT src, dst FROM (SELECT DISTINCT src, dst FROM ok) JOIN postings p ON p.term = src JOIN postings q ON q.term = dst AND q.doc_id = p.doc_id GROUP BY src, dst HAVING count(*) >= 3) SELECT src, dst, count(DISTINCT qid) AS seen FROM ok JOIN met USING (src, dst) GROUP BY src, dst""")
def m2_synonyms_from_recalls(spark, sf_dir):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    words = lexical.query_terms(q).select("qid", "word").distinct()
    return learn.observed_synonyms(words, words.select((F.col("qid") - 1).alias("qid"), "word"), b.postings, b.terms, b.stats.first()["n_docs"])


@query("""WITH r AS (SELECT user_id % 6 AS setting, event_id % 200 AS qid, event_id % 3 <> 0 AS positive, event_id % (user_id % 6 + 2) = 0 AS hit FROM events), s AS (SELECT setting, count(DISTINCT qid) FILTER (positive AND hit) AS hits, count(DISTINCT qid) FILTER (NOT positive) AS fires FROM r GROUP BY setting),
b AS (SELECT s.*, 6 - s.setting AS size FROM s, (SELECT hits AS h0, fires AS f0 FROM s WHERE setting = 0) z WHERE s.setting <> 0 AND s.hits > h0 AND s.fires <= f0 ORDER BY s.hits DESC, s.fires, size LIMIT 1) SELECT coalesce(max(setting), 0) AS setting, max(hits) AS hits, max(fires) AS fires, count(*) > 0 AS "on" FROM b""")
def m5_bridge_decision(spark, sf_dir):
    s = F.col("user_id") % 6
    return learn.bridge_decision(events(spark, sf_dir).select(s.alias("setting"), (6 - s).alias("size"), (event_id() % 200).alias("qid"), (event_id() % 3 != 0).alias("positive"), (event_id() % (s + 2) == 0).alias("hit")))


@query()
def m14_policy_choice(spark, sf_dir):
    scores = F.create_map(F.lit("baseline"), (event_id() % 3 == 0).cast("int"), F.lit("union"), ((event_id() % 3 == 0) | (event_id() % 4 == 0)).cast("int"), F.lit("linked"), (event_id() % 2).cast("int"))
    costs = F.create_map(F.lit("baseline"), F.lit(1.0), F.lit("union"), F.lit(1.05), F.lit("linked"), F.lit(1.0))
    return learn.policy_choice(events(spark, sf_dir).select(event_id().alias("id"), F.col("user_id").alias("session"), scores.alias("scores"), costs.alias("costs")), ["baseline", "union", "linked"], "baseline")


@query("""SELECT CASE WHEN event_id % 10 = 0 THEN 'other' WHEN event_id % 4 = 1 OR event_id % 7 = 0 THEN 'excluded' WHEN event_id % 4 = 2 THEN 'measured' ELSE 'pending' END AS status, count(*) AS n FROM events GROUP BY 1""")
def m15_observation_counts(spark, sf_dir):
    e = events(spark, sf_dir).select(F.when(event_id() % 10 == 0, "v1:x").otherwise("v2:x").alias("identity"), F.when(event_id() % 4 == 1, -1).when(event_id() % 4 == 2, 1).otherwise(0).alias("measured"), (event_id() % 7 == 0).alias("edited"), F.lit(False).alias("exposed"))
    return learn.observation_counts(e, "v2:")


@query("""SELECT user_id AS policy, bool_and(event_id % 50 <> 3 AND event_id % 60 <> 7 AND event_id % 45 <> 5) AS certified FROM events GROUP BY user_id""")
def m17_certified(spark, sf_dir):
    e = events(spark, sf_dir)
    obs = e.select(event_id().alias("id"), event_id().cast("string").alias("path"), F.when(event_id() % 50 == 3, "old").otherwise("s").alias("sha"), F.when(event_id() % 60 == 7, 0).otherwise(1).alias("measured"), F.lit(True).alias("settled"), F.lit(False).alias("edited"), F.lit(False).alias("exposed"))
    docs = e.select(event_id().cast("string").alias("path"), F.lit("s").alias("sha"), event_id().alias("doc_id"))
    return learn.certified(e.select(F.col("user_id").alias("policy"), event_id().alias("id")), obs, docs, docs.where("doc_id % 45 <> 5").select("doc_id"))


def lines(spark, sf_dir):
    """Events as lines of transcripts in two dialects."""
    e = events(spark, sf_dir)
    one = F.concat(F.lit('{"type":"user","message":{"content":[{"type":"text","text":"ask '), event_id().cast("string"), F.lit('"},{"type":"tool_use","id":"t'), event_id().cast("string"), F.when(event_id() % 3 == 0, text('","name":"Bash","input":{"command":"X=1 git checkout -b b', event_id() % 5, ' && ls"}}')).when(event_id() % 3 == 1, text('","name":"Edit","input":{"file_path":"/a/src', event_id() % 4, '/User.php"}}')).otherwise(text('","name":"Read","input":{"file_path":"/n/', event_id(), '.md"}}')), F.lit("]}"), F.when(event_id() % 10 == 9, F.lit(',"isMeta":true')).otherwise(F.lit("")), F.lit("}"))
    return e.select("event_id", F.col("user_id").alias("session"), one.alias("line"))


@query("SELECT event_id, 'ask ' || event_id AS text FROM events WHERE event_id % 10 <> 9")
def io3_user_texts(spark, sf_dir):
    return transcripts.user_texts(lines(spark, sf_dir)).select("event_id", "text")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' ELSE 'Read' END AS name, CASE event_id % 3 WHEN 0 THEN 'shell' WHEN 1 THEN 'path' ELSE '' END AS kind, CASE event_id % 3 WHEN 0 THEN 'X=1 git checkout -b b' || (event_id % 5) || ' && ls' WHEN 1 THEN '/a/src' || (event_id % 4) || '/User.php' ELSE '' END AS arg FROM events""")
def io3_tool_calls(spark, sf_dir):
    return transcripts.tool_calls(lines(spark, sf_dir)).select("event_id", "name", "kind", "arg")


@query("""SELECT event_id, 'exec' AS name, 'shell' AS kind, 'git status ' || event_id AS arg FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'apply', 'path', 'a/b' || event_id || '.py' FROM events WHERE event_id % 2 = 1""")
def io4_script_calls(spark, sf_dir):
    shell = text('{"payload":{"type":"custom_tool_call","name":"exec","input":"text(await tools.run({cmd:\\"git status ', event_id(), '\\", n:1}))"}}')
    patch = text('{"payload":{"type":"function_call","name":"apply","arguments":"*** Begin\\n*** Update File: a/b', event_id(), '.py\\n@@"}}')
    return transcripts.script_calls(events(spark, sf_dir).select("event_id", F.when(event_id() % 2 == 0, shell).otherwise(patch).alias("line"))).select("event_id", "name", "kind", "arg")


@query("SELECT event_id, 'read_call' AS event, 't' || event_id AS id, '/n/' || event_id || '.md' AS value FROM events WHERE event_id % 3 = 2")
def io5_retrieval_events(spark, sf_dir):
    return transcripts.retrieval_events(lines(spark, sf_dir)).select("event_id", "event", "id", "value")


USES = """calls AS (SELECT event_id, event_id % 3 AS k FROM events WHERE event_id % 3 < 2),
sig AS (SELECT event_id, unnest(CASE WHEN k = 0 THEN ['git', 'git checkout', 'git checkout -b', 'ls'] ELSE ['.php', 'User.php', 'User', '/a/src'[2:2] || '/src' || (event_id % 4), 'src' || (event_id % 4) || '/User.php', 'a/', 'src' || (event_id % 4) || '/'] END) AS signal, k FROM calls)"""


@query(f"WITH {USES} SELECT signal, count(*) AS uses, count(*) FILTER (k = 0) AS shell, count(*) FILTER (k = 1) AS path FROM (SELECT DISTINCT * FROM sig) GROUP BY signal")
def m8_signal_uses(spark, sf_dir):
    return signals.signal_uses(transcripts.tool_calls(lines(spark, sf_dir)))


def notes(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return d.select(text("n", doc_id()).alias("name"), text("use `git checkout -b b", doc_id() % 5, "` and `UserController.php` or plain git\n```sh\nls -la\n```\n").alias("raw"))


@query("""SELECT signal, 'n' || doc_id AS note, tf::BIGINT AS tf FROM documents, LATERAL (SELECT * FROM (VALUES ('git', 2), ('git checkout', 1), ('git checkout -b', 1), ('UserController.php', 1), ('.php', 1), ('Controller', 1), ('Controller.php', 1), ('ls', 1), ('ls -la', 1), ('checkout', 1), ('-la', 1)) v(signal, tf)) WHERE signal NOT IN ('x') ORDER BY 1""")
def m7_note_signals(spark, sf_dir):
    return signals.note_signals(notes(spark, sf_dir))


@query()
def m9_candidates(spark, sf_dir):
    calls = transcripts.tool_calls(lines(spark, sf_dir))
    known = spark.createDataFrame([("git checkout",), ("no such thing",)], "phrase string")
    c = signals.candidates(signals.note_signals(notes(spark, sf_dir)), signals.signal_uses(calls), known, calls.count())
    return c.withColumn("notes", F.concat_ws(",", "notes"))


@query()
def m10_proposals(spark, sf_dir):
    calls = transcripts.tool_calls(lines(spark, sf_dir))
    c = signals.candidates(signals.note_signals(notes(spark, sf_dir)), signals.signal_uses(calls), spark.createDataFrame([("zz",)], "phrase string"), calls.count() * 20)
    judged = c.select("signal", F.explode("notes").alias("note"), (F.length("signal") % 5 + 6).cast("double").alias("score"))
    return signals.proposals(c, judged).withColumn("notes", F.concat_ws(",", "notes"))


RULES = [("r1", "Bash", "git checkout"), ("r2", "Bash", "b3"), ("r2", "Edit", "User"), ("r3", "Edit", "src1"), ("r4", "Bash", "never")]
RULE_SQL = """rules(rule, tool, phrase) AS (VALUES ('r1', 'Bash', 'git checkout'), ('r2', 'Bash', 'b3'), ('r2', 'Edit', 'User'), ('r3', 'Edit', 'src1'), ('r4', 'Bash', 'never')),
c AS (SELECT user_id AS session, event_id AS call, CASE event_id % 3 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' ELSE 'Read' END AS tool, CASE event_id % 3 WHEN 0 THEN 'X=1 git checkout -b b' || (event_id % 5) || ' && ls' WHEN 1 THEN '/a/src' || (event_id % 4) || '/User.php' ELSE '/n/' || event_id || '.md' END AS input FROM events),
fired AS (SELECT DISTINCT session, call, rule FROM c JOIN rules USING (tool) WHERE contains(input, phrase))"""


def rule_calls(spark, sf_dir):
    calls = transcripts.hook_calls(lines(spark, sf_dir)).select("session", F.col("event_id").alias("call"), F.col("name").alias("tool"), "input")
    return calls, spark.createDataFrame(RULES, "rule string, tool string, phrase string")


@query(f"WITH {RULE_SQL}, n AS (SELECT rule, count(*) AS calls FROM (SELECT DISTINCT rule, tool FROM rules) JOIN c USING (tool) GROUP BY rule) SELECT rule, (SELECT count(*) FROM fired f WHERE f.rule = n.rule) AS fires, calls, round(100.0::DOUBLE * (SELECT count(*) FROM fired f WHERE f.rule = n.rule) / calls, 6) AS rate FROM n")
def m11_fire_rates(spark, sf_dir):
    return signals.fire_rates(*rule_calls(spark, sf_dir)).withColumn("rate", round6("rate"))


@query(f"WITH {RULE_SQL}, s AS (SELECT session, (SELECT count(DISTINCT rule) FROM fired f WHERE f.session = c.session) AS live FROM c GROUP BY session HAVING count(*) >= 5) SELECT count(*) AS sessions, (list_sort(list(live)))[count(*) // 2 + 1] AS median, (list_sort(list(live)))[floor(count(*) * 0.9::DOUBLE)::INT + 1] AS p90 FROM s")
def m11_active_rules(spark, sf_dir):
    return signals.active_rules(*rule_calls(spark, sf_dir), least=5)


@query(f"WITH {RULE_SQL} SELECT session, call, string_agg(rule, ',' ORDER BY rule) AS rules FROM fired GROUP BY session, call")
def m13_matched_rules(spark, sf_dir):
    return signals.matched_rules(*rule_calls(spark, sf_dir)).withColumn("rules", F.concat_ws(",", "rules"))


@query("SELECT 'r4' AS rule, 'never' AS cold, true AS all_cold UNION ALL SELECT 'r2', 'b3', false")
def m16_cold_rules(spark, sf_dir):
    rules = rule_calls(spark, sf_dir)[1]
    return signals.cold_rules(rules, signals.signal_uses(transcripts.tool_calls(lines(spark, sf_dir)))).withColumn("cold", F.concat_ws(",", "cold"))


@query()
def m12_approved(spark, sf_dir):
    calls, rules = rule_calls(spark, sf_dir)
    made = transcripts.tool_calls(lines(spark, sf_dir))
    c = signals.candidates(signals.note_signals(notes(spark, sf_dir)), signals.signal_uses(made), spark.createDataFrame([("zz",)], "phrase string"), made.count() * 20)
    p = signals.proposals(c, c.select("signal", F.explode("notes").alias("note"), F.lit(10.0).alias("score")))
    rates = signals.fire_rates(calls, c.select(F.col("signal").alias("rule"), F.lit("Read").alias("tool"), F.col("signal").alias("phrase")))
    return signals.approved(p, rates, spark.createDataFrame([("ls",)], "signal string"), spark.createDataFrame([("r", "b3", "none")], "rule string, phrase string, note string"))


def pool(spark, sf_dir, k=8):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    chosen = lexical.chosen_grams(lexical.query_terms(q), b.terms, b.stats)
    return b, q, b.recall(q, k), chosen


@query()
def t7_excerpts(spark, sf_dir):
    b, _, r, chosen = pool(spark, sf_dir)
    return passages.excerpts(r, b.docs, chosen)


@query()
def t8_worths(spark, sf_dir):
    b, _, r, chosen = pool(spark, sf_dir)
    return passages.worths(r, b.docs, chosen).withColumn("worth", round6("worth"))


@query()
def t9_evidence(spark, sf_dir):
    b, _, r, chosen = pool(spark, sf_dir)
    return passages.evidence(r.select("qid", "doc_id", F.when(F.col("rank") % 2 == 0, 0).cast("int").alias("chunk_no")), b.docs, chosen)


@query()
def t6_token_plan(spark, sf_dir):
    """Pieces by a count of words."""
    return passages.token_plan(corpus.documents(spark, sf_dir), lambda: lambda t: len(t.split()), 120)


def two_lanes(spark, sf_dir):
    """The words' lane, and one by id that stands in for meaning."""
    b, q, r, chosen = pool(spark, sf_dir, 20)
    other = r.select("qid", (F.col("doc_id") + 1).alias("doc_id"), (21 - F.col("rank")).alias("rank")).join(b.docs.select("doc_id"), "doc_id", "left_semi")
    p = passages.pool_of(r, other)
    return b, p, other, passages.worths(p, b.docs, chosen)


@query()
def f1_three_lanes(spark, sf_dir):
    b, p, _, worth = two_lanes(spark, sf_dir)
    return passages.three_lanes(p, worth, 8, b.docs.select("doc_id", F.when(doc_id() % 3 == 0, 0.5).otherwise(1.0).alias("factor"))).withColumn("score", round6("score"))


@query()
def f2_better_of_lanes(spark, sf_dir):
    _, p, _, worth = two_lanes(spark, sf_dir)
    return passages.better_of_lanes(p, worth, 8)


@query()
def f3_linked_arm(spark, sf_dir):
    b, p, other, _ = two_lanes(spark, sf_dir)
    near = passages.neighbours(p, other, b.docs.select(doc_id().alias("src"), (doc_id() + 2).alias("dst")).where("dst % 5 = 0"))
    chosen = pool(spark, sf_dir)[3]
    return passages.linked_arm(p, near, passages.worths(near, b.docs, chosen), near.withColumn("cos", (doc_id() % 7) / 7))


@query(f"""{RESULTS}, p AS (SELECT r.qid, count(*) AS n, 'Question: ' || any_value(b.text) || chr(10) || chr(10) || string_agg('[' || rank || '] doc_' || r.doc_id || ' — ' || chr(10) || substr(trim(d.text, ' '), 1, 420), chr(10) || chr(10) ORDER BY rank) AS prompt FROM results r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.qid GROUP BY r.qid)
SELECT qid, n, sha256('m␟' || prompt) AS key FROM p""")
def f4_judge_inputs(spark, sf_dir):
    b, q, r, _ = pool(spark, sf_dir)
    return passages.judge_inputs(r, q, b.docs, "m").select("qid", "n", "key")


@query("""SELECT CASE WHEN event_id % 4 = 0 THEN 'k' || event_id ELSE 'w' || (event_id % 30) END AS key, CASE WHEN event_id % 4 = 0 THEN -1 ELSE length('text ' || (event_id % 30))::INT END AS answer FROM events GROUP BY 1, 2""")
def f5_answered(spark, sf_dir):
    e = events(spark, sf_dir)
    cache = e.where("event_id % 4 = 0").select(text("k", event_id()).alias("key"), F.lit(-1).alias("answer"))
    wanted = e.where("event_id % 4 <> 0").select(text("w", event_id() % 30).alias("key"), text("text ", event_id() % 30).alias("prompt")).union(e.where("event_id % 4 = 0").select(text("k", event_id()), F.lit("cached")))
    return passages.answered(wanted, cache, lambda texts: [len(t) for t in texts], "prompt", "int")


@query(f"""WITH {CHUNKS} SELECT DISTINCT sha1(label::VARCHAR) AS key, label::DOUBLE AS first FROM chunks""")
def v3_embedded(spark, sf_dir):
    """Equal contents are embedded once."""
    c = corpus.chunks(spark, sf_dir).select(F.sha1(F.col("label").cast("string")).alias("key"), F.col("label").cast("string").alias("t"))
    none = spark.createDataFrame([], "key string, answer array<double>")
    return passages.answered(c, none, lambda texts: [[float(t)] for t in texts], "t", "array<double>").select("key", F.col("answer")[0].alias("first"))


@query(f"""WITH {COS} SELECT qid, doc_id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 6) DESC, doc_id)::INT AS rank FROM ranked r
WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM ranked s WHERE s.qid = r.qid AND s.doc_id = r.doc_id AND s.rank <= 2) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(cos, 6) DESC, doc_id) <= 5""")
def v8_meaning_top(spark, sf_dir):
    """Of two thirds of the documents, without each query's first two of all."""
    chunks, asked, top = lanes(spark, sf_dir, 40)
    allowed = chunks.select("doc_id").distinct().where("doc_id % 3 <> 0")
    return passages.meaning_top(asked, chunks, allowed, 5, top.where("rank <= 2")).select("qid", "doc_id", round6("cos").alias("cos"), "rank")


@query(f"""WITH {COS}, good AS (SELECT doc_id FROM chunks GROUP BY doc_id HAVING NOT bool_or(vec_id % 29 = 3) AND count(*) = 4), r AS (SELECT p.qid, p.doc_id, p.chunk_no, round(cos, 6) AS cos, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(cos, 9) DESC, chunk_no) AS n FROM pairs p JOIN good USING (doc_id) WHERE qid < 100)
SELECT qid, doc_id, chunk_no, cos FROM r WHERE n = 1""")
def v9_best_chunks(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    q = c.where("vec_id % 25 = 0 and vec_id < 100").select(F.col("vec_id").alias("qid"), F.col("vec").alias("q"))
    scored = c.crossJoin(F.broadcast(q)).select("qid", "doc_id", "chunk_no", F.aggregate(F.zip_with("q", "vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("cos"))  # four queries
    held = c.select("doc_id", "chunk_no", F.when(F.col("vec_id") % 29 == 3, "old").otherwise("now").alias("sha"))
    whole = c.groupBy("doc_id").count().where("count = 4").select("doc_id", F.lit("now").alias("sha"))
    return passages.best_chunks(scored, held, whole).withColumn("cos", round6("cos"))


@query("""WITH o AS (SELECT user_id AS qid, event_id AS doc_id FROM events WHERE event_type = 'purchase'), a AS (SELECT user_id AS qid, event_id AS doc_id FROM events WHERE event_type = 'click'), f AS (SELECT user_id AS qid, event_id AS doc_id FROM events WHERE event_type = 'view'),
s0 AS (SELECT *, 0 AS stage, row_number() OVER (PARTITION BY qid ORDER BY doc_id)::INT AS place FROM o WHERE doc_id % 4 <> 0), s1 AS (SELECT *, 1, row_number() OVER (PARTITION BY qid ORDER BY doc_id)::INT FROM a WHERE qid % 3 = 0 AND doc_id % 4 <> 0),
s2 AS (SELECT * FROM (SELECT *, 2, row_number() OVER (PARTITION BY qid ORDER BY doc_id)::INT AS place FROM f WHERE doc_id % 4 <> 0) WHERE place = 1 AND qid NOT IN (SELECT qid FROM s1)), u AS (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2)
SELECT qid, doc_id, stage, place FROM (SELECT qid, doc_id, stage, row_number() OVER (PARTITION BY qid ORDER BY stage, place, doc_id)::INT AS place FROM u) WHERE place <= 2""")
def l16_cascade(spark, sf_dir):
    from pyspark.sql import Window

    e = events(spark, sf_dir).select(F.col("user_id").alias("qid"), event_id().alias("doc_id"), "event_type").where(F.col("doc_id") % 4 != 0)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))
    stage = lambda c: e.where(c).select("qid", "doc_id", place.alias("place"))
    return lexical.cascade([stage("event_type = 'purchase'"), stage("event_type = 'click' and qid % 3 = 0"), stage("event_type = 'view'")], e.select("doc_id"))


@query(f"""{RESULTS} SELECT qid FROM ({S.BENCH}) WHERE qid NOT IN (SELECT qid FROM results WHERE score >= 60 OR (rank = 1 AND score >= 60 * (7.5::DOUBLE / 9.46) AND ratio >= 0.8))""")
def l13_unsure(spark, sf_dir):
    b, q = Built(spark, sf_dir), corpus.benchmark_queries(spark, sf_dir)
    return lexical.unsure(q, b.recall(q, 8), 60.0).select("qid")


@query(f"""WITH {S.INDEX}, own AS (SELECT DISTINCT qid, word FROM (SELECT qid, unnest({S.words("text")}) AS word FROM ({S.BENCH})) WHERE lower(word) NOT IN ({S.STOP})), br AS (SELECT item_id AS qid, unnest(['the', 'zz' || item_id, 'river']) AS dst FROM benchmark)
SELECT qid, word, false AS bridged FROM own UNION ALL SELECT DISTINCT qid, dst, true FROM br b WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.qid = b.qid AND o.word = b.dst)""")
def l12_expanded(spark, sf_dir):
    q = corpus.benchmark_queries(spark, sf_dir)
    bridge = q.select("qid", F.explode(F.array(F.lit("the"), text("zz", F.col("qid")), F.lit("river"))).alias("dst"))
    return lexical.expanded(q, bridge).select("qid", "word", "bridged")


@query("SELECT page_id AS i, length(url)::INT AS n FROM pages")
def t1_folded_width(spark, sf_dir):
    from memolake.functions import text as T

    wide = F.translate("url", "abcdef0123:", "ａｂｃｄｅｆ０１２３：")
    return corpus.table(spark, sf_dir, "pages").where(T.fold_width(wide) == F.col("url")).select(F.col("page_id").alias("i"), F.length(T.fold_width(wide)).alias("n"))


@query("SELECT doc_id, g AS gram FROM documents, LATERAL (SELECT unnest(['세션', '션' || chr(44032 + (doc_id % 50)::INT), '세션' || chr(44032 + (doc_id % 50)::INT)]) AS g)")
def t3_grams(spark, sf_dir):
    from memolake.functions import text as T

    w = F.concat(F.lit("세션"), F.decode(F.encode(F.element_at(F.array(*[F.lit(chr(44032 + i)) for i in range(50)]), (doc_id() % 50 + 1).cast("int")), "UTF-8"), "UTF-8"))
    return docs_of(spark, sf_dir).select("doc_id", F.explode(T.grams(w)).alias("gram"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 IN (0, 3)")
def t14_usable_signals(spark, sf_dir):
    from memolake.functions import text as T

    s = F.element_at(F.array(text("git b", doc_id()), text("if x", doc_id()), text("9", doc_id()), text("Xy", doc_id()), F.lit("home/me")), (doc_id() % 5 + 1).cast("int"))
    return docs_of(spark, sf_dir).where(T.usable_signal(s, ["home/me"])).select("doc_id")


@query("SELECT DISTINCT 'git checkout -b b' || (doc_id % 5) AS c, unnest(['git', 'git checkout', 'git checkout -b']) AS signal FROM documents")
def t12_command_signals(spark, sf_dir):
    c = text("git checkout -b b", doc_id() % 5)
    return docs_of(spark, sf_dir).select(c.alias("c"), F.explode(signals.command_signals(text("A=1 /usr/bin/", c, " <<EOF\nrm all\nEOF"))).alias("signal")).distinct()


@query()
def v11_kept_positives(spark, sf_dir):
    chunks, _, top = lanes(spark, sf_dir, 10)
    near = top.withColumn("ratio", F.col("cos"))
    floor = spark.createDataFrame([(0.3,)], "floor double")
    return vector.kept_positives(near, top.where("doc_id % 2 = 0").select("qid", "doc_id"), floor)


COMMITS = """c AS (SELECT o_orderkey AS sha, o_orderdate AS "at", ['src/m' || (o_orderkey % 9) || '/f' || (o_orderkey % 40) || '.py', 'f' || (o_orderkey % 40) || '.PY', 'x/y.bin'] AS files FROM orders),
k AS (SELECT DISTINCT sha, "at", unnest(CASE WHEN contains(f, '/') THEN ['m' || (sha % 9) || '/f' || (sha % 40) || '.py', 'f' || (sha % 40) || '.py'] ELSE [f] END) AS key FROM (SELECT sha, "at", unnest(files[1:2]) AS f FROM c)),
p AS (SELECT key, string_agg(sha, ',' ORDER BY r) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, sha) AS r FROM k) WHERE r <= 4 GROUP BY key)"""


def commits(spark, sf_dir):
    k = F.col("o_orderkey")
    return corpus.table(spark, sf_dir, "orders").select(k.alias("sha"), F.col("o_orderdate").alias("at"), F.array(text("src/m", k % 9, "/f", k % 40, ".py"), text("f", k % 40, ".PY"), F.lit("x/y.bin")).alias("files"))


@query(f"WITH {COMMITS} SELECT key, refs FROM p")
def io6_commit_pointers(spark, sf_dir):
    return exchange.commit_pointers(commits(spark, sf_dir), ["py", "md"])


@query(f"WITH {COMMITS}, q AS (SELECT 'a/m' || (doc_id % 12) || '/f' || (doc_id % 40) || '.py' AS path, 'm' || (doc_id % 12) || '/f' || (doc_id % 40) || '.py' AS two, 'f' || (doc_id % 40) || '.py' AS one FROM documents) SELECT DISTINCT path, coalesce(x.refs, y.refs) AS refs FROM q LEFT JOIN p x ON x.key = two JOIN p y ON y.key = one")
def io6_history(spark, sf_dir):
    paths = docs_of(spark, sf_dir).select(text("a/m", doc_id() % 12, "/f", doc_id() % 40, ".py").alias("path")).distinct()
    return exchange.history_of(paths, exchange.commit_pointers(commits(spark, sf_dir), ["py", "md"]))


@query("""SELECT vec_id, vec_id % 3 = 0 AS own FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 5 <> 0""")
def io8_merged_vectors(spark, sf_dir):
    v = F.col("vec_id")
    e = corpus.table(spark, sf_dir, "embeddings").select("vec_id", text("n", v).alias("name"), F.lit(0).alias("chunk_no"))
    mine = e.where(v % 3 == 0).select("name", "chunk_no", F.lit("s").alias("sha"), "vec_id", F.lit(True).alias("own"))
    theirs = e.select("name", "chunk_no", F.when(v % 5 == 0, "old").otherwise("s").alias("sha"), "vec_id", F.lit(False).alias("own"))
    return exchange.merged_vectors(mine, theirs, e.select("name", F.lit("s").alias("sha")))[0].select("vec_id", "own")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'a' ELSE 'b' END AS only FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 EXCEPT SELECT doc_id, 'a' FROM documents WHERE doc_id % 35 = 0")
def io10_set_differences(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id")
    i = doc_id()
    return exchange.set_differences(d.where((i % 7 != 0) & (i % 35 != 0)), d.where((i % 5 != 0) & (i % 35 != 0)))


@query("""SELECT event_id AS key, event_id % 7 <> 0 AS readable, CASE WHEN event_id % 7 <> 0 THEN 1 + (event_id % 13 <= 10)::INT END AS answered, CASE WHEN event_id % 7 <> 0 THEN 1 END AS duplicates, CASE WHEN event_id % 7 <> 0 THEN (event_id % 13 > 10)::INT END AS out_of_range FROM events""")
def f6_answer_counts(spark, sf_dir):
    from memolake.plans.analytics import ANSWER

    return fusion.answer_counts(events(spark, sf_dir).select(event_id().alias("key"), F.expr(ANSWER).alias("text"), F.lit(2).alias("n")))


@query("""WITH s AS (SELECT round(value / 10)::INT AS s, count(*) AS n FROM events WHERE value < 105 GROUP BY 1), z AS (SELECT max(value / 10) AS z FROM events WHERE value < 45)
SELECT t::INT AS t, mass::BIGINT AS mass, z >= 10 AS blocked FROM (SELECT t, coalesce(sum(n), 0) AS mass FROM range(11) g(t) LEFT JOIN s ON s.s IN (t, t - 1) GROUP BY t), z WHERE t >= z + 1 ORDER BY mass, t LIMIT 1""")
def f7_placed_threshold(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("value") / 10).alias("score"), "value")
    return fusion.placed_threshold(e.where("value < 105"), e.where("value < 45"))


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 18""")
def u6_by_month(spark, sf_dir):
    return usage.by_month(corpus.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("evidence")))


@query("""SELECT user_id AS doc_id, count(*) AS hits FROM events GROUP BY user_id ORDER BY hits DESC, user_id LIMIT 10""")
def u6_top_hits(spark, sf_dir):
    return usage.top_hits(events(spark, sf_dir).groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("hits")))


@query("""WITH f AS (SELECT user_id AS session, floor(value)::INT % 40 AS rule, min(event_id) AS call FROM events GROUP BY ALL) SELECT session, rule, call FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY call, rule) AS r FROM f) WHERE r <= 12 OR rule % 4 = 0""")
def s7_fired_within(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("session"), (F.floor("value").cast("int") % 40).alias("rule"), event_id().alias("call"))
    rates = e.select("rule").distinct().withColumn("rate", F.when(F.col("rule") % 4 == 0, 0.5).otherwise(3.0))
    return usage.fired_within(e, 12, rates)
