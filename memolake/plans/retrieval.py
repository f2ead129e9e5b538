"""Queries for text functions, the index and lexical retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memolake.functions import text as T
from memolake.operators import evaluate, index, lexical, parse
from memolake.plans import sql as S
from memolake.sources import corpus
from memolake.tables import fresh_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Bytes of text for a bucket of the index, about.
BUCKET_BYTES = 64 << 20


def files_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, a hash of names, sizes and times) of a table's files; their contents aren't read."""
    f = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return tuple(f.agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("path", "modificationTime", "length"), F.lit(1 << 40))), F.lit(0))).first())


class Built:
    """The published index of the documents: written once for a session and state of the table, then read by every query."""

    paths: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = corpus.documents(spark, sf_dir)
        size, state = files_of(spark, f"{sf_dir}/documents.parquet")
        key = (spark.sparkContext.applicationId, sf_dir, state)
        if key not in self.paths:
            path = fresh_path(spark, "index")
            index.publish(self.docs, path, max(16, size // BUCKET_BYTES))
            self.paths[key] = path
        found = index.opened(spark, self.paths[key])
        self.postings, self.terms, self.lengths, self.stats = found.postings.drop("bucket"), found.terms.drop("bucket"), found.lengths, found.stats
        self.packed = found.packed

    def recall(self, queries: DataFrame, k: int, **options) -> DataFrame:
        return lexical.recall(queries, self.docs, self.postings, self.terms, self.lengths, self.stats, k, **options)


def round6(c):
    return F.round(c, 6)


@query(f"SELECT doc_id, len(t)::INT AS n_words, len(list_distinct(t))::INT AS n_distinct, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, {S.words('text')} AS t FROM documents)")
def t2_words(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", T.latin_words(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_words"), F.size(F.array_distinct("t")).alias("n_distinct"), F.concat_ws(" ", F.slice("t", 1, 5)).alias("head"))


@query(f"SELECT doc_id, len(t)::INT AS n_words, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, {S.words('text')} AS t FROM documents)")
def t2_words_any_script(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_words"), F.concat_ws(" ", F.slice("t", 1, 5)).alias("head"))


@query(f"WITH {S.asked(S.PROMPTS)} SELECT qid, word, word AS gram FROM asked")
def t4_query_terms(spark, sf_dir):
    return lexical.query_terms(corpus.prompts(spark, sf_dir))


@query("""WITH b AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, i::INT AS chunk_no, (i * 1000)::INT AS start, sha1(substr(t, i * 1000 + 1, 1200)) AS chunk_sha
FROM (SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 1200) / 1000.0), 0)::INT + 1)) AS i FROM b WHERE length(t) > 0)""")
def t5_chunk_spans(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunk_spans(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.chunk_no", F.col("c.start").cast("int").alias("start"), F.sha1("c.chunk").alias("chunk_sha"))


@query(f"WITH {S.INDEX} SELECT skel, term, df FROM (SELECT regexp_replace(translate(regexp_replace(term, '[aeiouy]', '', 'g'), 'cqlfv', 'kkrpb'), 'x', 'x', 'g') AS raw, term, df FROM terms WHERE df >= 2 AND regexp_full_match(term, '[a-z]+')), LATERAL (SELECT array_to_string(list_filter(list_transform(range(1, length(raw) + 1), lambda i: CASE WHEN i = 1 OR substr(raw, i, 1) <> substr(raw, i - 1, 1) THEN substr(raw, i, 1) ELSE '' END), lambda x: x <> ''), '') AS skel) WHERE length(skel) >= 2")
def x6_skeletons(spark, sf_dir):
    return index.skeletons(Built(spark, sf_dir).terms)


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
n AS (SELECT page_id, string_split(path, '/')[-1] AS name, string_split(string_split(path, '/')[-1], '.') AS d, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM p),
c AS (SELECT *, regexp_extract_all(d[1], '[A-Z][a-z0-9]+')[-1] AS camel, range(1, len(segs)) AS places FROM n)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([CASE WHEN len(d) >= 2 THEN '.' || d[-1] END, CASE WHEN len(d) >= 3 THEN '.' || d[-2] || '.' || d[-1] END,
  CASE WHEN name <> '' AND NOT starts_with(name, '.') THEN name END, camel, CASE WHEN len(d) >= 2 THEN camel || '.' || d[-1] END],
  list_transform(places, lambda i: segs[i] || '/' || segs[i + 1]), list_transform(places, lambda i: segs[i] || '/')), lambda x: x IS NOT NULL))), ' ') AS signals FROM c""")
def t13_path_signals(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat_ws(" ", T.path_signals(F.regexp_replace("url", "^[a-z]+://", ""))).alias("signals"))


@query(r"""WITH plain AS (SELECT doc_id, regexp_replace(text, '\[[^\]]*\]\([A-Za-z0-9_./-]+\.md\)', ' ', 'g') AS t FROM documents),
found AS (SELECT doc_id, list_concat(regexp_extract_all(t, '\b[a-z][a-z-]{1,20}#\d{2,5}\b'), regexp_extract_all(t, '\b[\w.-]+\.(?:md|sh|py|ts|tsx|php|json|xml)\b'),
  regexp_extract_all(t, '\b\d+(?:[/→~-]\d+)+\b'), regexp_extract_all(t, '\b\d{4}-\d{2}-\d{2}\b')) AS f FROM plain)
SELECT doc_id, array_to_string(list_sort(list_distinct(g)), ' ') AS facts FROM (SELECT doc_id, list_filter(f, lambda x: length(x) > 3 AND x NOT IN ('MEMORY.md', 'CLAUDE.md', 'AGENTS.md', 'README.md', 'config.json')) AS g FROM found) WHERE len(g) > 0""")
def t15_facts(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", T.facts(F.col("text")).alias("f")).where(F.size("f") > 0)
    return d.select("doc_id", F.concat_ws(" ", "f").alias("facts"))


def _masked(text: str) -> str:
    """SQL for the masks, of an engine without lookaheads: right where no placeholder and no word of letters alone is like a
    secret, as in the test tables; tests hold these cases against literals."""
    for name, rx in T.SECRETS:
        plain = rx.replace("(?=[A-Za-z0-9_-]*\\d)", "").replace("(?![0-9A-Za-z_-])", "").replace("'", "''")
        text = f"regexp_replace({text}, '{plain}', '{T.MASK % name}', 'g')"
    return text


_VALUE = "[^\\s''\"`,;)]{8,}"
_ASSIGNED = T.ASSIGNMENT.split("(['")[0] + f"(?:''{_VALUE}''|\"{_VALUE}\"|{_VALUE})"
MASKED = f"once AS (SELECT doc_id, text, {_masked('text')} AS t FROM documents), twice AS (SELECT doc_id, text, t, regexp_replace(t, '{_ASSIGNED}', '\\1\\2{T.MASK % 'secret'}', 'g') AS masked FROM once)"
LABELS = ", ".join(f"CASE WHEN contains(t, '{T.MASK % n}') THEN '{n}' END" for n in dict.fromkeys(n for n, _ in T.SECRETS))
LABELS = f"array_to_string(list_sort(list_filter([{LABELS}, CASE WHEN masked <> t THEN 'assignment' END], lambda x: x IS NOT NULL)), ',')"


@query(f"WITH {MASKED} SELECT doc_id, masked, {LABELS} AS labels FROM twice")
def p9_scrub(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.scrub(F.col("text")).alias("masked"), F.array_join(T.secret_labels(F.col("text")), ",").alias("labels"))


@query(f"WITH {MASKED} SELECT * FROM (SELECT doc_id, {LABELS} AS labels, doc_id % 4 = 0 AS local_only FROM twice) WHERE labels <> ''")
def p10_secret_audit(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").withColumn("meta", F.create_map(F.lit("embed"), F.when(F.col("doc_id") % 4 == 0, "false").otherwise("true")))
    return parse.secret_audit(d).select("doc_id", F.array_join("labels", ",").alias("labels"), "local_only")


@query("""SELECT DISTINCT page_id AS src_id, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS dst_name FROM pages""")
def p3_links(spark, sf_dir):
    return corpus.page_links(spark, sf_dir)


@query("""SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source <> 'src0'""")
def p7_slice(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de") & (F.col("source") != "src0")).select("doc_id", "lang", "source")


@query("""SELECT min(conv_id * 1000 + turn) AS qid, text FROM conversations WHERE role = 'user' AND length(text) BETWEEN 12 AND 600 AND NOT starts_with(text, '/') AND NOT starts_with(text, '<') GROUP BY text""")
def p8_real_prompts(spark, sf_dir):
    p = corpus.prompts(spark, sf_dir).where(F.length("text").between(12, 600) & ~F.col("text").startswith("/") & ~F.col("text").startswith("<"))
    return p.groupBy("text").agg(F.min("qid").alias("qid"))


@query(f"WITH {S.INDEX} SELECT doc_id, term, tf FROM postings")
def x1_postings(spark, sf_dir):
    return index.postings(corpus.documents(spark, sf_dir))


@query(f"WITH {S.INDEX} SELECT doc_id, term, round(sum(w * c / (c + 1.5::DOUBLE)), 6) AS tf FROM (SELECT doc_id, term, w::DOUBLE AS w, f, count(*) AS c FROM field_terms GROUP BY ALL) GROUP BY doc_id, term")
def x1_postings_sat(spark, sf_dir):
    return index.postings(corpus.documents(spark, sf_dir), "sat", k=1.5).withColumn("tf", round6("tf"))


@query(f"WITH {S.INDEX} SELECT doc_id, term, tf FROM postings")
def io7_published(spark, sf_dir):
    return Built(spark, sf_dir).postings


@query(f"WITH {S.INDEX} SELECT doc_id, term, round(sum(w * (1 + ln(c))), 6) AS tf FROM (SELECT doc_id, term, w::DOUBLE AS w, f, count(*) AS c FROM field_terms GROUP BY ALL) GROUP BY doc_id, term")
def x1_postings_log(spark, sf_dir):
    return index.postings(corpus.documents(spark, sf_dir), "log").withColumn("tf", round6("tf"))


@query(f"WITH {S.INDEX} SELECT term, df FROM terms")
def x2_terms(spark, sf_dir):
    return index.terms(index.postings(corpus.documents(spark, sf_dir)))


@query(f"WITH {S.INDEX} SELECT n_docs, round(avg_doclen, 6) AS avg_doclen, (SELECT count(*) FROM terms) AS n_terms, (SELECT count(*) FROM postings) AS n_postings FROM stats")
def x2_stats(spark, sf_dir):
    return Built(spark, sf_dir).stats.withColumn("avg_doclen", round6("avg_doclen"))


@query(f"""WITH {S.DOCS} SELECT path, CASE WHEN doc_id % 50 = 1 THEN 'added' WHEN doc_id % 50 = 2 THEN 'removed' WHEN doc_id % 50 = 3 THEN 'updated' WHEN doc_id % 50 = 4 THEN 'refreshed' ELSE 'unchanged' END AS status FROM docs""")
def x3_changes(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    kind = F.col("doc_id") % 50
    old = d.where(kind != 1).select("path", F.lit(0).alias("mtime"), "size", "sha")
    new = d.where(kind != 2).select("path", F.when(kind.isin(3, 4), 1).otherwise(0).alias("mtime"), "size", F.when(kind == 3, F.sha1(F.col("sha"))).otherwise(F.col("sha")).alias("sha"))
    return index.changes(old, new)


@query(f"WITH {S.DOCS} SELECT doc_id, path, copies FROM (SELECT doc_id, path, count(*) OVER (PARTITION BY sha) AS copies, row_number() OVER (PARTITION BY sha ORDER BY source, doc_id) AS r FROM docs) WHERE r = 1")
def x4_first_of_copies(spark, sf_dir):
    return index.first_of_copies(corpus.documents(spark, sf_dir), ["source", "doc_id"]).select("doc_id", "path", "copies")


@query(f"WITH {S.INDEX} SELECT term, count(*) AS df FROM postings WHERE doc_id % 20 <> 7 GROUP BY term")
def x5_recount(spark, sf_dir):
    b = Built(spark, sf_dir)
    gone = F.col("doc_id") % 20 == 7
    touched = b.postings.where(gone).select("term").distinct()
    return index.recount(b.terms, b.postings.where(~gone), touched)


@query("""WITH d AS (SELECT page_id AS doc_id, url AS name, regexp_extract(url, '([^/]+)$', 1) AS alias FROM pages)
SELECT alias, min(doc_id) AS doc_id FROM d WHERE alias <> '' AND alias NOT IN (SELECT name FROM d) GROUP BY alias HAVING count(*) = 1""")
def x7_basename_aliases(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("name"))
    return index.unique_aliases(d, F.regexp_extract("name", "([^/]+)$", 1))


MARKERS = [("en", "the"), ("en", "and"), ("en", "with"), ("fr", "les"), ("fr", "des"), ("fr", "que"), ("de", "der"), ("de", "und"), ("de", "die"), ("es", "los"), ("es", "con"), ("es", "por")]


@query(f"""WITH {S.INDEX}, markers(language, marker) AS (VALUES {", ".join(str(m) for m in MARKERS)})
SELECT language, round(median(100.0::DOUBLE * coalesce(df, 0) / n_docs), 6) AS share FROM markers LEFT JOIN terms ON term = marker, stats GROUP BY language""")
def x11_language_shares(spark, sf_dir):
    b = Built(spark, sf_dir)
    markers = spark.createDataFrame(MARKERS, "language string, marker string")
    return index.language_shares(b.postings, markers, b.stats.select("n_docs")).withColumn("share", round6("share"))


CJK = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '세션이 상한' WHEN doc_id % 7 = 0 THEN '배포 세션' ELSE '배포상한' END || ' ' || split_part(text, ' ', 1) || ' common' AS text FROM documents"


@query(f"""WITH d AS ({CJK}), q AS (SELECT doc_id AS qid, text FROM d),
w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest({S.words("text", cjk=True)}) AS word FROM d)),
g AS (SELECT doc_id, word, unnest(CASE WHEN word >= '가' AND word <= '힣' AND length(word) > 1 THEN list_concat(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)), list_transform(range(1, length(word) - 1), lambda i: substr(word, i, 3))) ELSE [word] END) AS gram FROM w),
t AS (SELECT gram, count(DISTINCT doc_id) AS df FROM g GROUP BY gram), n AS (SELECT count(*) AS n FROM d),
a AS (SELECT doc_id AS qid, word, gram, df, ln(1 + (n - greatest(df, 3) + 0.5::DOUBLE) / (greatest(df, 3) + 0.5::DOUBLE)) AS idf, df < greatest(2, floor(n * 0.55)) AS fits FROM (SELECT DISTINCT * FROM g) JOIN t USING (gram), n WHERE lower(word) NOT IN ({S.STOP})),
m AS (SELECT *, bool_or(fits) OVER (PARTITION BY qid, word) AS any_fits, row_number() OVER (PARTITION BY qid, word ORDER BY df, gram) AS place FROM a)
SELECT qid, word, gram, round(idf, 6) AS idf, round(max(idf) OVER (PARTITION BY qid, word), 6) AS word_idf FROM m WHERE fits OR (NOT any_fits AND place = 1)""")
def l1_chosen_grams(spark, sf_dir):
    """Words that are cut into grams, and words and grams of over the bound of documents."""
    d = corpus.table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "세션이 상한").when(F.col("doc_id") % 7 == 0, "배포 세션").otherwise("배포상한"), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" common")).alias("text"))
    posted = index.postings(d, weights={"text": 1.0})
    term_df, lengths = index.terms(posted), index.doc_lengths(d, posted)
    out = lexical.chosen_grams(lexical.query_terms(d.withColumnRenamed("doc_id", "qid")), term_df, index.corpus_stats(lengths, term_df))
    return out.withColumn("idf", round6("idf")).withColumn("word_idf", round6("word_idf"))


RESULTS = f"WITH {S.INDEX}, {S.asked(S.BENCH)}, {S.CHOSEN}, {S.RECALL}, {S.results(8)}"


@query(f"{RESULTS} SELECT qid, rank, doc_id, round(score, 6) AS score, round(ratio, 6) AS ratio, array_to_string(list_sort(matched), ' ') AS matched FROM results")
def l6_recall_topk(spark, sf_dir):
    r = Built(spark, sf_dir).recall(corpus.benchmark_queries(spark, sf_dir), 8)
    return r.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", round6("score").alias("score"), round6("ratio").alias("ratio"), F.concat_ws(" ", "matched").alias("matched"))


@query(f"""{RESULTS}, marked AS (SELECT *, score >= 60 AS sure, bool_or(score >= 60) OVER (PARTITION BY qid) AS any_sure, row_number() OVER (PARTITION BY qid, score >= 60 ORDER BY rank) AS n FROM results)
SELECT qid, rank, doc_id, round(score, 6) AS score, CASE WHEN sure THEN 'score' ELSE 'ratio' END AS why FROM marked WHERE (sure AND n <= 2) OR (NOT any_sure AND rank = 1 AND score >= 60 * (7.5::DOUBLE / 9.46) AND ratio >= 0.8)""")
def l8_attach(spark, sf_dir):
    r = Built(spark, sf_dir).recall(corpus.benchmark_queries(spark, sf_dir), 8)
    return lexical.attach(r, 60.0).withColumn("score", round6("score")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {S.asked(S.PROMPTS)}, hit AS (SELECT word, doc_id FROM (SELECT DISTINCT word FROM asked) JOIN (SELECT doc_id, lower(text) AS t FROM documents) ON contains(t, word)),
f AS (SELECT qid, count(DISTINCT doc_id) AS files FROM asked JOIN hit USING (word) GROUP BY qid)
SELECT qid, coalesce(files, 0) AS files, least(1.0::DOUBLE, 3.0::DOUBLE / nullif(files, 0)) AS hit_of_3 FROM ({S.PROMPTS}) LEFT JOIN f USING (qid)""")
def l14_grep(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.grep_words(corpus.prompts(spark, sf_dir), index.document_words(d), d.count())  # texts are cut once


PHRASES = """phrases AS (SELECT DISTINCT lower(trim(regexp_replace(array_to_string(w[1 + item_id % 7:item_id % 7 + 1 + item_id % 4], ' '), '\\s+', ' ', 'g'))) AS phrase, item_id AS doc_id FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
folded AS (SELECT qid, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded FROM (SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user'))"""


def phrases(spark, sf_dir):
    """One to four words from the inside of each benchmark text."""
    w = F.split("text", " ")
    i = F.col("item_id")
    return corpus.table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(w, (1 + i % 7).cast("int"), (1 + i % 4).cast("int")), " ").alias("phrase"), i.alias("doc_id"))


@query(f"""WITH {PHRASES} SELECT qid, phrase, doc_id, row_number() OVER (PARTITION BY qid ORDER BY length(phrase) DESC, phrase, doc_id)::INT AS place FROM folded JOIN phrases ON contains(folded, phrase) WHERE length(phrase) >= 3""")
def l10_trigger_matches(spark, sf_dir):
    return lexical.trigger_matches(corpus.prompts(spark, sf_dir), phrases(spark, sf_dir))


@query(f"""WITH {PHRASES}, t AS (SELECT DISTINCT phrase, 'n' || (doc_id % 30) AS name FROM phrases), own AS (SELECT DISTINCT phrase FROM t), known AS (SELECT DISTINCT phrase FROM phrases WHERE doc_id % 3 <> 0 UNION SELECT phrase || ' x' FROM phrases WHERE doc_id % 5 = 0)
SELECT phrase, 'duplicate' AS issue FROM t GROUP BY phrase HAVING count(*) > 1 UNION ALL SELECT phrase, 'short' FROM own WHERE length(phrase) < 6 UNION ALL SELECT phrase, 'one-word' FROM own WHERE NOT contains(phrase, ' ')
UNION ALL SELECT DISTINCT phrase, 'unresolved' FROM t WHERE name IN ('n7', 'n8') UNION ALL SELECT phrase, 'declared-not-indexed' FROM own WHERE phrase NOT IN (FROM known) UNION ALL SELECT phrase, 'indexed-not-declared' FROM known WHERE phrase NOT IN (FROM own)
UNION ALL SELECT DISTINCT a.phrase, 'shadowed' FROM own a JOIN own b ON a.phrase <> b.phrase AND contains(b.phrase, a.phrase) WHERE length(a.phrase) >= 2 UNION ALL SELECT phrase, 'unused' FROM own WHERE length(phrase) < 3 OR NOT EXISTS (SELECT 1 FROM folded WHERE contains(folded, phrase))""")
def l11_trigger_audit(spark, sf_dir):
    p = phrases(spark, sf_dir).withColumn("phrase", lexical.folded(F.col("phrase")))
    t = p.select("phrase", F.concat(F.lit("n"), (F.col("doc_id") % 30).cast("string")).alias("name"))
    indexed = p.where("doc_id % 3 <> 0").select("phrase").union(p.where("doc_id % 5 = 0").select(F.concat("phrase", F.lit(" x"))))
    names = t.select("name").distinct().where("name not in ('n7', 'n8')")
    return lexical.trigger_audit(t, indexed, names, corpus.prompts(spark, sf_dir))


@query("""WITH n AS (SELECT 'doc_' || doc_id AS name, doc_id FROM documents), a AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'doc_' || item_id ELSE 'Oc_' || item_id END AS asked FROM benchmark),
hit AS (SELECT asked, name, doc_id FROM a JOIN n ON name = asked)
SELECT asked, name, doc_id, true AS exact FROM hit UNION ALL SELECT asked, name, doc_id, false FROM (SELECT asked, name, doc_id, row_number() OVER (PARTITION BY asked ORDER BY name, doc_id) AS r FROM a JOIN n ON contains(lower(name), lower(asked)) WHERE asked NOT IN (SELECT asked FROM hit)) WHERE r <= 5""")
def l15_looked_up(spark, sf_dir):
    i = F.col("item_id")
    a = corpus.table(spark, sf_dir, "benchmark").select(F.concat(F.when(i % 2 == 0, "doc_").otherwise("Oc_"), i.cast("string")).alias("asked"))
    return lexical.looked_up(a, corpus.documents(spark, sf_dir).select("name", "doc_id"))


ROUND_ROBIN = "ring AS (SELECT doc_id AS src, doc_id + 1 AS dst FROM documents UNION SELECT doc_id, doc_id * 3 FROM documents)"


def ring(docs):
    return docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst")).union(docs.select("doc_id", F.col("doc_id") * 3)).distinct()


@query(f"""WITH {S.INDEX}, {S.asked(S.BENCH)}, {S.CHOSEN}, {S.RECALL}, {S.results(8)}, {ROUND_ROBIN}, both_ways AS (SELECT src, dst FROM ring UNION SELECT dst, src FROM ring), seed AS (SELECT qid, rank, doc_id AS via, max(score) OVER (PARTITION BY qid) AS top FROM results),
near AS (SELECT qid, dst AS doc_id, min(rank) AS rank, arg_min(via, rank) AS via FROM seed JOIN both_ways ON via = src WHERE rank <= 3 AND top >= 60 GROUP BY qid, dst),
kept AS (SELECT * FROM near n WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.qid = n.qid AND r.doc_id = n.doc_id) AND NOT EXISTS (SELECT 1 FROM scored s WHERE s.qid = n.qid AND s.doc_id = n.doc_id AND s.score >= 60) AND doc_id IN (SELECT doc_id FROM documents WHERE source <> 'src1'))
SELECT qid, doc_id, via FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) AS r FROM kept) WHERE r <= 2""")
def l7_related(spark, sf_dir):
    b = Built(spark, sf_dir)
    q = corpus.benchmark_queries(spark, sf_dir)
    own = lexical.at_least(q, b.postings, b.terms, b.lengths, b.stats, 60.0)
    scope = b.docs.where("source <> 'src1'").select("doc_id")
    return lexical.related(b.recall(q, 8), ring(b.docs), 60.0, own=own, scope=scope)


def gold(spark, sf_dir, queries):
    b = Built(spark, sf_dir)
    return evaluate.containment_gold(queries, b.docs, b.terms, b.postings)


GOLD = "gold AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""{RESULTS}, {GOLD}, ranks AS (SELECT g.qid, min(rank) AS rank FROM gold g LEFT JOIN results r USING (qid, doc_id) GROUP BY g.qid)
SELECT count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS hit_3, round(avg((coalesce(rank, 99) <= 8)::INT), 6) AS hit_8, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM ranks""")
def n8_retrieval_metrics(spark, sf_dir):
    r = Built(spark, sf_dir).recall(corpus.benchmark_queries(spark, sf_dir), 8)
    return evaluate.metrics(r, gold(spark, sf_dir, corpus.benchmark_queries(spark, sf_dir)))


@query(f"""{RESULTS}, {GOLD}, top AS (SELECT qid, max(score) AS score, bool_or(doc_id IN (SELECT doc_id FROM gold x WHERE x.qid = r.qid)) AS hit FROM results r GROUP BY qid),
t AS (SELECT unnest(range(10, 110, 10))::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (qid % 2 = 0 AND hit AND score >= threshold) AS hits, count(*) FILTER (qid % 2 = 1 AND score >= threshold) AS false_fires,
  round(count(*) FILTER (qid % 2 = 0 AND hit AND score >= threshold) / count(*) FILTER (qid % 2 = 0)::DOUBLE * (1 - count(*) FILTER (qid % 2 = 1 AND score >= threshold) / count(*) FILTER (qid % 2 = 1)::DOUBLE), 6) AS auto FROM top, t GROUP BY threshold""")
def n4_threshold_sweep(spark, sf_dir):
    queries = corpus.benchmark_queries(spark, sf_dir)
    r = Built(spark, sf_dir).recall(queries, 8)
    return evaluate.sweep(r, gold(spark, sf_dir, queries), F.col("qid") % 2 == 0, [float(t) for t in range(10, 110, 10)])
