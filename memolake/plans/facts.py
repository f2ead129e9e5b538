"""Queries for facts in time and the exchange of tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memolake.operators import exchange, validity
from memolake.plans.analytics import CHUNKS, lanes
from memolake.sources import corpus

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


AS_OF = "TIMESTAMP '1997-01-01 00:00:00'"
FACTS = """facts AS (SELECT o_orderkey AS id, o_custkey AS scope, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'active' ELSE 'proposed' END AS status, o_orderdate::TIMESTAMP AS valid_from,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 400 DAY END AS valid_to, o_orderpriority AS topic FROM orders),
succ AS (SELECT id, next FROM (SELECT id, lead(id) OVER (PARTITION BY scope ORDER BY valid_from, id) AS next FROM facts) WHERE next IS NOT NULL)"""
RESOLVED = f"""{FACTS}, step AS (SELECT s.id, s.next FROM succ s JOIN facts f ON f.id = s.next WHERE f.valid_from <= {AS_OF} AND f.status <> 'proposed'),
walk(origin, pos) AS (SELECT id, id FROM facts UNION SELECT w.origin, s.next FROM walk w JOIN step s ON s.id = w.pos),
resolved AS (SELECT origin AS id, pos AS current FROM walk JOIN facts f ON f.id = pos WHERE pos NOT IN (SELECT id FROM step) AND f.status = 'active' AND f.valid_from <= {AS_OF} AND ({AS_OF} < f.valid_to OR f.valid_to IS NULL))"""


def facts(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    f = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scope"), F.when(F.col("o_orderstatus").isin("F", "O"), "active").otherwise("proposed").alias("status"), start.alias("valid_from"),
        F.when(F.col("o_orderkey") % 4 == 0, start + F.expr("INTERVAL 400 DAY")).alias("valid_to"), F.col("o_orderpriority").alias("topic"),
    )
    succ = f.select("id", F.lead("id").over(Window.partitionBy("scope").orderBy("valid_from", "id")).alias("next")).where("next is not null")
    return f, succ


def moment():
    return F.lit("1997-01-01 00:00:00").cast("timestamp")


@query(f"WITH RECURSIVE {RESOLVED} SELECT id, current FROM resolved")
def c4_as_of(spark, sf_dir):
    return validity.resolved(*facts(spark, sf_dir), moment())


@query(f"WITH {FACTS} SELECT scope, topic, '' AS facet, count(*) AS n FROM facts GROUP BY scope, topic HAVING count(*) > 1")
def c2_identity_collisions(spark, sf_dir):
    return validity.identity_collisions(facts(spark, sf_dir)[0].withColumn("facet", F.lit("")))


@query(f"WITH RECURSIVE {RESOLVED} SELECT h.scope AS qid, r.current AS doc_id, max(h.score) AS score, string_agg(DISTINCT h.id, ',' ORDER BY h.id) AS origins FROM (SELECT id, scope, (id % 97)::DOUBLE AS score FROM facts) h JOIN resolved r ON r.id = h.id GROUP BY 1, 2")
def c6_remapped(spark, sf_dir):
    f, succ = facts(spark, sf_dir)
    hits = f.select(F.col("scope").alias("qid"), F.col("id").alias("doc_id"), (F.col("id") % 97).cast("double").alias("score"))
    return validity.remapped(hits, validity.resolved(f, succ, moment()))


@query("""SELECT key, "at", content, sha, row_number() OVER (PARTITION BY key ORDER BY "at", content)::INT AS version, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, content DESC) = 1 AS latest FROM (
  SELECT *, lag(sha) OVER (PARTITION BY key ORDER BY "at", content) AS was FROM (SELECT user_id AS key, event_id AS "at", event_type AS content, sha1(event_type) AS sha FROM events)) WHERE was IS NULL OR was <> sha""")
def c10_versions(spark, sf_dir):
    return validity.versions(corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("event_type").alias("content")))


@query("""WITH c AS (SELECT doc_id AS id, text AS body, string_split(text, ' ')[2] AS quote FROM documents WHERE len(string_split(text, ' ')) > 1), p AS (SELECT *, instr(body, quote) AS f FROM c),
s AS (SELECT *, CASE WHEN quote = '' THEN 'empty' WHEN f = 0 THEN 'absent' WHEN instr(substr(body, f + 1), quote) > 0 THEN 'ambiguous' ELSE 'ok' END AS state FROM p)
SELECT id, state, CASE WHEN state = 'ok' THEN f - 1 END::INT AS start, CASE WHEN state = 'ok' THEN f - 1 + length(quote) END::INT AS "end" FROM s""")
def c12_quotes(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.split("text", " ").alias("w")).where(F.size("w") > 1)
    return validity.quote_check(d.select("id", "body", F.col("w")[1].alias("quote")))


@query("""SELECT 'all' AS scope, 'doc_' || doc_id AS name, CASE WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 10 = 2 THEN 'sha_mismatch' WHEN doc_id % 10 = 3 THEN 'name_taken' WHEN doc_id % 10 = 4 THEN 'updated' WHEN doc_id % 10 = 5 THEN 'sha_mismatch' ELSE 'noop' END AS decision FROM documents""")
def c18_write_decisions(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).withColumn("scope", F.lit("all"))
    kind = F.col("doc_id") % 10
    held = d.where(~kind.isin(1, 2)).select("scope", "name", F.lit("k").alias("key"), F.col("sha").alias("payload_sha"), "sha")
    put = d.select("scope", "name", F.when(kind == 3, "other").otherwise("k").alias("key"), F.when(kind.isin(4, 5), F.sha1("sha")).otherwise(F.col("sha")).alias("payload_sha"), F.when(kind.isin(2, 5), "no").when(kind == 4, F.col("sha")).alias("expected"))
    return validity.write_decisions(put, held)


@query("SELECT key, string_agg(ref, ',' ORDER BY place) AS refs FROM (SELECT o_custkey AS key, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 4 GROUP BY key")
def io6_first_refs(spark, sf_dir):
    return exchange.first_refs(corpus.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("ref")))


HALF = "SELECT user_id, count(*) AS hits, count(*) FILTER (event_type = 'click') AS opens FROM events WHERE event_id % 2 = {} GROUP BY user_id"


@query(f"SELECT user_id, greatest(coalesce(a.hits, 0), coalesce(b.hits, 0)) AS hits, greatest(coalesce(a.opens, 0), coalesce(b.opens, 0)) AS opens FROM ({HALF.format(0)}) a FULL JOIN ({HALF.format(1)}) b USING (user_id)")
def io8_merged_counters(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    half = lambda r: e.where(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.count(F.when(F.col("event_type") == "click", 1)).alias("opens"))
    return exchange.merged_counters(half(0), half(1), "user_id", ["hits", "opens"])


@query("SELECT doc_id AS key, CASE WHEN doc_id % 9 = 1 THEN 'delete' WHEN doc_id % 9 IN (2, 3) THEN 'upsert' ELSE 'keep' END AS action FROM documents")
def io9_changed_set(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("sha").alias("digest"))
    k = F.col("key") % 9
    return exchange.changed_set(d.where(k != 1), d.where(k != 2).withColumn("digest", F.when(k == 3, F.lit("old")).otherwise(F.col("digest"))))


@query(f"""WITH {CHUNKS}, q AS (SELECT vec_id AS qid, vec FROM chunks WHERE vec_id % 25 = 0), best AS (SELECT qid, doc_id, max(list_inner_product(q.vec, c.vec)) AS cos FROM q, chunks c GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 6) DESC, doc_id) AS rank FROM best), a AS (SELECT * FROM r WHERE rank <= 10), b AS (SELECT qid, doc_id, cos + 0.5 AS cos, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM (SELECT * FROM r WHERE rank <= 20 AND doc_id % 7 <> 3))
SELECT qid, max((a.rank = 1 AND b.rank = 1)::INT) AS same_first, count(*) FILTER (a.rank IS NOT NULL AND b.rank IS NOT NULL) AS overlap, round(max(abs(a.cos - b.cos)), 6) AS max_delta FROM a FULL JOIN (SELECT * FROM b WHERE rank <= 10) b USING (qid, doc_id) GROUP BY qid""")
def io10_agreement(spark, sf_dir):
    top = lanes(spark, sf_dir, 20)[2].withColumnRenamed("cos", "score")
    b = top.where(F.col("doc_id") % 7 != 3).select("qid", "doc_id", (F.col("score") + 0.5).alias("score"), F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank"))
    return exchange.agreement(top, b)
