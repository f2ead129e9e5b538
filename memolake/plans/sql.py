"""Pieces of SQL that several oracles share."""

from memolake.functions.text import HANGUL, LATIN, STOP_WORDS

WORD = f"[{LATIN}][{LATIN}.#-]*"


def words(text: str, cjk: bool = False) -> str:
    """Words of Latin text, and Hangul runs if asked for."""
    rx = WORD + f"|[{HANGUL}]+" if cjk else WORD
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, ''), '{rx}'), lambda w: lower(trim(w, '.#-'))), lambda w: length(w) >= 2)"


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

DOCS = """docs AS (SELECT doc_id, 'doc_' || doc_id AS name, source, lang AS kind, split_part(text, chr(10), 1) AS title, '' AS description,
  text AS body, length(text)::BIGINT AS size, source || '/doc_' || doc_id AS path, sha1(text) AS sha FROM documents)"""

INDEX = f"""{DOCS},
field_terms AS (SELECT doc_id, w, f, unnest(t) AS term FROM (
  SELECT doc_id, 6.0 AS w, 1 AS f, {words("name")} AS t FROM docs UNION ALL SELECT doc_id, 4.0, 2, {words("title")} FROM docs UNION ALL SELECT doc_id, 1.0, 3, {words("body")} FROM docs)),
postings AS (SELECT doc_id, term, sum(w)::DOUBLE AS tf FROM field_terms GROUP BY doc_id, term),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
lengths AS (SELECT d.doc_id, coalesce(s, 1.0)::DOUBLE AS doclen FROM docs d LEFT JOIN (SELECT doc_id, sum(tf) AS s FROM postings GROUP BY doc_id) USING (doc_id)),
stats AS (SELECT count(*) AS n_docs, avg(doclen) AS avg_doclen FROM lengths)"""


def asked(queries: str) -> str:
    """Query words of a table queries(qid, text)."""
    return f"""asked AS (SELECT DISTINCT qid, word FROM (SELECT qid, unnest({words("text")}) AS word FROM ({queries})) WHERE lower(word) NOT IN ({STOP}))"""


CHOSEN = """grams AS (SELECT qid, word, df, df < greatest(2, floor(n_docs * 0.55)) AS fits,
    ln(1 + (n_docs - greatest(df, 3) + 0.5::DOUBLE) / (greatest(df, 3) + 0.5::DOUBLE)) AS idf FROM asked JOIN terms ON word = term, stats),
chosen AS (SELECT qid, word, idf FROM grams)"""

RECALL = """hits AS (SELECT c.qid, p.doc_id, c.word, c.idf, c.idf * p.tf / (p.tf + 1.2::DOUBLE * (0.4::DOUBLE + 0.6::DOUBLE * l.doclen / s.avg_doclen)) AS val
  FROM chosen c JOIN postings p ON p.term = c.word JOIN lengths l USING (doc_id), stats s),
mass AS (SELECT qid, sum(idf) AS mass FROM chosen GROUP BY qid),
scored AS (SELECT qid, doc_id, sum(val) * (0.4::DOUBLE + 0.6::DOUBLE * sum(idf) / any_value(mass)) AS score, any_value(mass) AS mass, list(word) AS matched, list({'w': word, 'i': idf}) AS m FROM hits JOIN mass USING (qid) GROUP BY qid, doc_id),
head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS place FROM scored) WHERE place <= 100)"""


def results(k: int) -> str:
    """The first k, up to 100."""
    naming = f"list_concat({words(chr(39) + 'doc ' + chr(39) + ' || d.doc_id')}, {words('d.title')})"
    return f"""results AS (SELECT * FROM (SELECT qid, doc_id, score, score / mass AS ratio, matched, row_number() OVER (PARTITION BY qid ORDER BY place > 40, CASE WHEN place <= 40 THEN round(score + 0.8::DOUBLE * bonus, 6) END DESC, place) AS rank FROM (
  SELECT h.*, coalesce(list_sum(list_transform(list_filter(m, lambda x: list_contains({naming}, x.w)), lambda x: x.i)), 0.0) AS bonus FROM head h JOIN docs d USING (doc_id))) WHERE rank <= {k})"""


BENCH = "SELECT item_id AS qid, text FROM benchmark"
PROMPTS = "SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user'"
EDGES = """links AS (SELECT DISTINCT page_id AS src, unnest(regexp_extract_all(html, 'href="([^"#?]+)', 1)) AS target FROM pages)"""
