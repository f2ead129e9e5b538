"""Queries of the request log: events stand for requests; their kind, value and user tell how each went."""

from __future__ import annotations

from pyspark.sql import functions as F

from memolake.operators import funnel
from memolake.sources import corpus

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


LOG = """l AS (SELECT event_id // 2 AS request, ts, ts::DATE AS day, event_type AS t, user_id AS u, value AS v, event_type = 'signup' AS ex, event_type = 'purchase' AS hit, event_type = 'error' AS cut, CASE WHEN user_id % 2 = 0 THEN 'index' ELSE 'search' END AS stage,
  event_type IN ('click', 'purchase', 'error') AS judged, value IS NOT NULL AND value > 5 AS sent, value > 20 AS returned FROM events)"""


def requests(spark, sf_dir):
    """Signups are left out, purchases found something, errors were cut, clicks judged; two events are rows of one request."""
    e = corpus.table(spark, sf_dir, "events")
    kind, user, value = F.col("event_type"), F.col("user_id"), F.col("value")
    vector = F.struct(F.when(user % 3 == 0, "remote").otherwise("local").alias("by"), F.when(user % 5 == 0, "slow").otherwise("").alias("why"), (user % 4 == 0).alias("embedded"))
    judge = F.struct(
        F.when(user % 3 == 0, "score").alias("phase"), kind.alias("outcome"), F.when(value > 50, "fired").when(value > 20, "below").alias("decision"), (value.isNotNull() & (value > 5)).alias("sent"), (value > 20).alias("returned"),
        (value > 30).alias("valid"), (user % 7 == 0).alias("cached"), value.alias("secs"), F.when(user % 2 == 0, "score").otherwise("").alias("kind"), (value / 20).alias("top"), vector.alias("vector"),
    )
    return e.select(
        F.floor(F.col("event_id") / 2).alias("request"), "ts", F.when(kind == "signup", F.concat(F.lit("r"), (user % 3).cast("string"))).alias("excluded"), (kind == "purchase").alias("hit"), F.when(user % 2 == 0, "index").otherwise("search").alias("stage"),
        (kind == "error").alias("cut"), F.when(kind == "purchase", F.create_map(F.lit("lexical"), (user % 3).cast("int"), F.lit("semantic"), F.lit(1))).alias("attached"),
        F.struct((user % 2 == 0).alias("ran"), value.alias("secs"), (user % 6 == 0).alias("deferred")).alias("reindex"), F.when(kind.isin("click", "purchase", "error"), judge).alias("judge"),
    )


@query(f"""WITH {LOG}, s AS (FROM l WHERE NOT ex), j AS (FROM s WHERE judged), x AS (
SELECT day, 'request' AS section, 'rows' AS key, 1 AS n FROM l UNION ALL SELECT day, 'excluded', 'r' || u % 3, 1 FROM l WHERE ex UNION ALL SELECT day, 'request', 'searched', 1 FROM s UNION ALL SELECT day, 'request', 'attached_any', 1 FROM s WHERE hit
UNION ALL SELECT day, 'request', 'silent_reindex', 1 FROM s WHERE stage = 'index' AND NOT cut AND NOT hit UNION ALL SELECT day, 'request', 'cut', 1 FROM s WHERE cut UNION ALL SELECT day, 'cut_at', CASE WHEN judged AND u % 3 = 0 THEN 'score' ELSE stage END, 1 FROM s WHERE cut
UNION ALL SELECT day, 'reindex', 'ran', 1 FROM s WHERE u % 2 = 0 UNION ALL SELECT day, 'reindex', 'deferred', 1 FROM s WHERE u % 6 = 0 UNION ALL SELECT day, 'source', 'lexical', u % 3 FROM s WHERE hit AND u % 3 <> 0 UNION ALL SELECT day, 'source', 'semantic', 1 FROM s WHERE hit
UNION ALL SELECT day, 'judge', 'reached', 1 FROM j UNION ALL SELECT day, 'judge', 'finished', 1 FROM j WHERE v > 20 UNION ALL SELECT day, 'outcome', t, 1 FROM j UNION ALL SELECT day, 'kind', 'score', 1 FROM j WHERE u % 2 = 0
UNION ALL SELECT day, 'judge', 'sent', 1 FROM j WHERE sent UNION ALL SELECT day, 'judge', 'returned', 1 FROM j WHERE returned UNION ALL SELECT day, 'judge', 'valid', 1 FROM j WHERE v > 30 UNION ALL SELECT day, 'judge', 'cut_out', 1 FROM j WHERE sent AND NOT coalesce(returned, false)
UNION ALL SELECT day, 'top', trunc(v / 20)::INT::VARCHAR, 1 FROM j WHERE v > 30 UNION ALL SELECT day, 'vector', CASE WHEN u % 3 = 0 THEN 'remote' ELSE 'local' END, 1 FROM j UNION ALL SELECT day, 'vector', 'embedded', 1 FROM j WHERE u % 4 = 0 UNION ALL SELECT day, 'local_why', 'slow', 1 FROM j WHERE u % 3 <> 0 AND u % 5 = 0)
SELECT day, section, key, sum(n)::BIGINT AS n FROM x GROUP BY ALL""")
def u9_request_tallies(spark, sf_dir):
    return funnel.request_tallies(requests(spark, sf_dir))


@query(f"""WITH {LOG}, p AS (SELECT day, 'reindex' AS what, v FROM l WHERE NOT ex AND u % 2 = 0 UNION ALL SELECT day, 'judge', v FROM l WHERE NOT ex AND judged AND returned AND u % 7 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY day, what ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY day, what) AS n FROM p WHERE v IS NOT NULL) SELECT day, what, v AS secs FROM o WHERE pos = least(n - 1, floor(0.95::DOUBLE * n))""")
def u9_request_times(spark, sf_dir):
    return funnel.request_times(requests(spark, sf_dir), 0.95)


@query(f"""WITH {LOG}, e AS (SELECT request, ts, CASE WHEN ex THEN 3 WHEN hit THEN 6 WHEN cut THEN 4 WHEN judged AND v > 20 THEN 5 WHEN stage = 'index' THEN 2 ELSE 1 END AS far FROM l)
SELECT request, ['silent', 'silent-reindex', 'excluded', 'cut', 'below', 'attached'][far] AS state, ts AS "at" FROM e QUALIFY row_number() OVER (PARTITION BY request ORDER BY far DESC, ts DESC) = 1""")
def u9_request_ends(spark, sf_dir):
    return funnel.request_ends(requests(spark, sf_dir))


@query("""WITH c AS (SELECT ts::DATE AS day, user_id AS u, value AS v FROM events WHERE event_type = 'view'), x AS (SELECT day, unnest(list_filter(['calls', CASE WHEN u % 3 > 0 THEN 'semantic_asked' END, CASE WHEN u % 2 = 0 THEN 'auto' END, CASE WHEN v > 50 THEN 'unsure' END, CASE WHEN u % 5 = 0 THEN 'reordered' END, CASE WHEN u % 4 > 0 THEN 'bridged' END,
  CASE WHEN v > 80 THEN 'meaning_returned' END, CASE WHEN u % 11 = 0 THEN 'meaning_fail:slow' END, CASE WHEN u % 2 = 0 THEN 'vector:remote' ELSE 'vector:local' END, CASE WHEN u % 9 = 0 THEN 'graph:local' END], lambda k: k IS NOT NULL)) AS key FROM c) SELECT day, key, count(*) AS n FROM x GROUP BY ALL""")
def u9_recall_tallies(spark, sf_dir):
    u, v = F.col("user_id"), F.col("value")
    c = corpus.table(spark, sf_dir, "events").where("event_type = 'view'")
    c = c.select("ts", (u % 3).alias("semantic_k"), (u % 2 == 0).alias("auto"), (v > 50).alias("unsure"), (u % 4).alias("bridged"), (u % 5 == 0).alias("reordered"), (v > 80).cast("int").alias("meaning"), F.when(u % 11 == 0, "slow").alias("meaning_fail"), F.when(u % 2 == 0, "remote").otherwise("local").alias("vector_by"), F.when(u % 9 == 0, "local").alias("graph_by"))
    return funnel.recall_tallies(c)
