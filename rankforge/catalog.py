"""One query for each operator over the tables of a folder, and SQL that gives the same rows.

Roles of the tables: documents is the corpus, benchmark the queries (qid = item_id), and a query's gold document is the
first that holds its text; embeddings are dense units whose label stands for a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, evaluate, fusion, ranking, rerank, retrieval, splits, submission, supervision
from .operators.chunking import ChunkRules
from .operators.retrieval import BM25, TfIdf
from .operators.units import chunk_units, document_units, query_rows
from .sources import tables
from .sources.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- pieces of SQL -----------------------------------------------------------------------------------------------------


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def norm_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(translate(coalesce({x}, ''), chr(160) || '«»–—ёЁ', ' \"\"--еЕ'), '\\s+', ' ', 'g')))"


STRUCTURED_SQL = r"regexp_matches(t, '[0-9_.\-]')"


def tokens_sql(x: str, min_len: int = 3, stop: bool = True, noise: bool = False) -> str:
    keep = [f"(length(t) >= {min_len} OR t IN {_in(T.SHORT_CODES)} OR {STRUCTURED_SQL})"]
    keep += [f"t NOT IN {_in(T.STOP_WORDS)}"] * stop + [f"t NOT IN {_in(T.NOISE_WORDS)}"] * noise
    return f"list_filter(regexp_extract_all({norm_sql(x)}, '[а-яёa-z0-9]+'), lambda t: {' AND '.join(keep)})"


def bigrams_sql(ts: str) -> str:
    plain = lambda e: f"NOT regexp_matches({e}, '[0-9_.\\-]') AND {e} NOT IN {_in(T.STOP_WORDS + T.NOISE_WORDS)}"
    return f"list_transform(list_filter(range(1, len({ts})), lambda i: {plain(f'{ts}[i]')} AND {plain(f'{ts}[i + 1]')}), lambda i: {ts}[i] || '__' || {ts}[i + 1])"


DOC_UNITS = "SELECT doc_id AS unit_ord, doc_id::VARCHAR AS unit_id, doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text FROM documents"
ASKED = "SELECT item_id::VARCHAR AS qid, coalesce(text, '') AS question FROM benchmark"


def bm25_sql(units: str = DOC_UNITS, k1: float = 1.5, b: float = 0.75, p: str = "", terms: Callable[[str], str] = tokens_sql) -> str:
    """CTEs ending in {p}hits(qid, unit_ord, unit_id, doc_id, score)."""
    return f"""
{p}unit AS ({units}),
{p}u AS (SELECT unit_ord, unit_id, doc_id, {terms('text')} AS terms FROM {p}unit),
{p}s AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS avgdl FROM {p}u),
{p}p AS (SELECT unit_ord, unit_id, doc_id, dl, term, count(*)::DOUBLE AS tf
         FROM (SELECT unit_ord, unit_id, doc_id, len(terms)::DOUBLE AS dl, unnest(terms) AS term FROM {p}u) GROUP BY ALL),
{p}d AS (SELECT term, count(*)::DOUBLE AS df FROM {p}p GROUP BY term),
{p}q AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({terms('question')}) AS term FROM ({ASKED}))),
{p}hits AS (SELECT qid, unit_ord, unit_id, doc_id,
              sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
            FROM {p}q JOIN {p}p USING (term) JOIN {p}d USING (term), {p}s GROUP BY ALL)"""


def top_sql(hits: str, k: int) -> str:
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, unit_ord) AS rank, doc_id, unit_id, score, unit_ord FROM {hits} QUALIFY rank <= {k}"


_SHOW = "SELECT qid, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM"


def shown(r: DataFrame) -> DataFrame:
    return r.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


# --- inputs ------------------------------------------------------------------------------------------------------------


def docs(spark, d):
    return tables.read_table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def asked(spark, d):
    return query_rows(tables.read_table(spark, d, "benchmark"), "item_id", "text")


def units(spark, d):
    return document_units(docs(spark, d))


def train(spark, d) -> DataFrame:
    """Questions with gold document and evidence: the items, each a stated query against all documents."""
    items = tables.read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    held = supervision.holding(docs(spark, d), items)
    first = held.groupBy("item_id", "item").agg(F.min(F.struct("doc_id", F.instr("text", F.col("item")).alias("at"), "source")).alias("g"))
    return first.select(
        F.col("item_id").cast("string").alias("qid"), F.col("item").alias("question"), F.col("g.doc_id").cast("string").alias("gold_doc_id"), F.col("item").alias("gold_evidence_text"),
        (F.col("g.at") - 1).cast("int").alias("gold_evidence_char_start"), (F.col("g.at") - 1 + F.length("item")).cast("int").alias("gold_evidence_char_end"), F.col("g.source").alias("topic"),
    )


TRAIN_SQL = """train AS (
  SELECT item_id::VARCHAR AS qid, item AS question, doc_id::VARCHAR AS gold_doc_id, item AS gold_evidence_text,
         (place - 1)::INT AS gold_evidence_char_start, (place - 1 + length(item))::INT AS gold_evidence_char_end, source AS topic, whole
  FROM (SELECT b.item_id, b.text AS item, d.doc_id, instr(d.text, b.text) AS place, d.source, d.text AS whole,
               row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS n
        FROM benchmark b JOIN documents d ON contains(d.text, b.text)) WHERE n = 1)"""


# --- text ----------------------------------------------------------------------------------------------------------------


@query("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5 FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("norm_md5"))


@query("lexical_tokens", f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def lexical_tokens(spark, d):
    t = docs(spark, d).select("doc_id", T.lexical_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(T.detokenize(F.col("t"))).alias("tokens_md5"))


@query("tokens_min_len_2", f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text', 2, False, True)} AS t FROM documents)")
def tokens_min_len_2(spark, d):
    t = docs(spark, d).select("doc_id", T.lexical_tokens(F.col("text"), T.TokenRules(min_len=2, stop_words=False, legal_stop_words=True)).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(T.detokenize(F.col("t"))).alias("tokens_md5"))


@query("token_bigrams", f"SELECT doc_id, len(b)::BIGINT AS n, md5(array_to_string(b, ' ')) AS bigrams_md5 FROM (SELECT doc_id, {bigrams_sql('t')} AS b FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents))")
def token_bigrams(spark, d):
    t = docs(spark, d).select("doc_id", T.lexical_tokens(F.col("text")).alias("t")).select("doc_id", T.bigrams(F.col("t")).alias("b"))
    return t.select("doc_id", F.size("b").cast("long").alias("n"), F.md5(T.detokenize(F.col("b"))).alias("bigrams_md5"))


@query("structured_tokens", f"SELECT doc_id, len(list_filter(t, lambda t: {STRUCTURED_SQL}))::BIGINT AS n FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def structured_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.filter(T.lexical_tokens(F.col("text")), T.is_structured)).cast("long").alias("n"))


LEGAL_SAMPLES = ((1, "Согласно ст. 333.19 НК РФ и п.2 ч 3 закона 75-ФЗ от 01.02.2020"), (2, "решение по делу № 2-1234/2019, ст 15"), (3, None))


@query("legal_refs", "SELECT * FROM (VALUES (1, 'ст_333.19 п_2 ч_3 75_фз 01.02.2020'), (2, '2-1234 ст_15'), (3, '')) t(id, refs)")
def legal_refs(spark, d):
    rows = spark.createDataFrame(LEGAL_SAMPLES, "id int, text string")
    return rows.select("id", T.detokenize(T.legal_references(T.normalize_text(F.col("text")))).alias("refs"))


@query(
    "document_features",
    r"""SELECT doc_id, 'судебный акт' AS doc_kind, '' AS articles,
        len(regexp_extract_all(coalesce(text, ''), '\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b'))::INT AS date_count, 0 AS money_count,
        0 AS has_ustanovil, 0 AS has_opredelil, 0 AS has_reshil FROM documents""",
)
def document_features(spark, d):
    return docs(spark, d).select("doc_id", *T.document_features(F.col("text")))


COURT_SAMPLES = ((1, "АПЕЛЛЯЦИОННОЕ ОПРЕДЕЛЕНИЕ суд установил: статья 15, ст. 12.1, взыскать 5 000 рублей, 01.02.2020"), (2, "Суд ОПРЕДЕЛИЛ отказать"), (3, "суд РЕШИЛ: ст.10 и ст.10"), (4, None))


@query("document_kind", "SELECT * FROM (VALUES (1, 'апелляционное определение', 'ст. 12.1 ст. 15', 1), (2, 'определение', '', 0), (3, 'решение', 'ст.10', 0), (4, 'судебный акт', '', 0)) t(id, kind, articles, has_ustanovil)")
def document_kind(spark, d):
    rows = spark.createDataFrame(COURT_SAMPLES, "id int, text string")
    return rows.select("id", T.document_kind(F.col("text")).alias("kind"), T.articles(F.col("text")).alias("articles"), T.mentions(F.col("text"), "УСТАНОВИЛ").alias("has_ustanovil"))


@query("field_aware_text", "SELECT doc_id, md5(coalesce(text, '') || chr(10) || chr(10) || 'тип_акта судебный акт статьи  признаки 0 0 0') AS text_md5 FROM documents")
def field_aware_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.field_aware_text(F.col("text"))).alias("text_md5"))


@query("char_grams", r"""
WITH w AS (SELECT doc_id, ' ' || w || ' ' AS w FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS w FROM documents)),
g AS (SELECT doc_id, substring(w, i, n) AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i
      FROM (SELECT doc_id, w, unnest(range(3, least(5, greatest(3, length(w))) + 1)) AS n FROM w)))
SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT g)::BIGINT AS n_distinct FROM g GROUP BY doc_id""")
def char_gram_counts(spark, d):
    return retrieval.gram_counts(docs(spark, d), "doc_id", "text", TfIdf("char_wb", (3, 5)))


# --- chunks --------------------------------------------------------------------------------------------------------------


def line_chunks_sql(size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return f"""
l AS (SELECT doc_id, text, l, i, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS s, length(text) AS n_text
      FROM (SELECT doc_id, text, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT doc_id, text, s, least(s + length(l) + 1, n_text) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE regexp_matches(l, '\\S')),
n AS (SELECT doc_id, count(*) AS n, any_value(text) AS text FROM f GROUP BY doc_id),
w AS (SELECT doc_id, text, n, unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE ceil((n - {size}) / {float(step)})::BIGINT + 1 END)) AS position FROM n),
chunk AS (SELECT w.doc_id, w.position, a.s AS start, b.e AS "end", regexp_replace(substring(w.text, a.s::INT + 1, (b.e - a.s)::INT), '^\\s+|\\s+$', '', 'g') AS text
      FROM w JOIN f a ON a.doc_id = w.doc_id AND a.k = w.position * {step} JOIN f b ON b.doc_id = w.doc_id AND b.k = least(w.position * {step} + {size}, w.n) - 1
      UNION ALL SELECT doc_id, 0, 0, length(coalesce(text, '')), coalesce(text, '') FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '\\S'))"""


def _chunk_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("position").cast("long").alias("position"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5("text").alias("text_md5"))


for _size, _overlap in ((10, 5), (8, 4)):
    query(f"chunks_line_{_size}_{_overlap}", f'WITH {line_chunks_sql(_size, _overlap)} SELECT doc_id, position::BIGINT AS position, start::BIGINT AS start, "end"::BIGINT AS "end", md5(text) AS text_md5 FROM chunk')(
        lambda spark, d, r=ChunkRules("line", _size, _overlap): _chunk_rows(chunking.chunks(docs(spark, d), r))
    )


@query("chunks_char_1200_600", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT *, unnest(range(0, CASE WHEN n <= 1200 THEN 1 ELSE ceil((n - 1200) / 600.0)::BIGINT + 1 END)) AS position FROM t),
c AS (SELECT doc_id, position, position * 600 AS start, least(position * 600 + 1200, n) AS "end", regexp_replace(substring(text, (position * 600)::INT + 1, 1200), '^\s+|\s+$', '', 'g') AS text FROM w)
SELECT doc_id, position::BIGINT AS position, start::BIGINT AS start, "end"::BIGINT AS "end", md5(text) AS text_md5 FROM c WHERE text <> ''
UNION ALL SELECT doc_id, 0, 0, n, md5(text) FROM t WHERE NOT regexp_matches(text, '\S')""")
def chunks_char(spark, d):
    return _chunk_rows(chunking.chunks(docs(spark, d), ChunkRules("char", 1200, 600)))


@query("chunks_paragraph_2_1")
def chunks_paragraph(spark, d):
    spaced = docs(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _chunk_rows(chunking.chunks(spaced, ChunkRules("paragraph", 2, 1)))


# --- scoring -------------------------------------------------------------------------------------------------------------


@query("bm25_doc_top5", f"WITH {bm25_sql()} {_SHOW} ({top_sql('hits', 5)})")
def bm25_doc_top5(spark, d):
    return shown(ranking.top_k(retrieval.bm25(units(spark, d), asked(spark, d), k=5), 5))


@query("bm25_doc_k1_1p2_b_0p5", f"WITH {bm25_sql(k1=1.2, b=0.5)} {_SHOW} ({top_sql('hits', 5)})")
def bm25_doc_grid(spark, d):
    return shown(ranking.top_k(retrieval.bm25(units(spark, d), asked(spark, d), BM25(1.2, 0.5), k=5), 5))


FIELD_UNITS = DOC_UNITS.replace("coalesce(text, '') AS text", "coalesce(text, '') || chr(10) || chr(10) || 'тип_акта судебный акт статьи  признаки 0 0 0' AS text")


@query("bm25_field_doc_top5", f"WITH {bm25_sql(FIELD_UNITS)} {_SHOW} ({top_sql('hits', 5)})")
def bm25_field_doc(spark, d):
    return shown(ranking.top_k(retrieval.bm25(document_units(docs(spark, d), field_aware=True), asked(spark, d), k=5), 5))


def phrase_sql(x: str) -> str:
    return f"(SELECT list_concat(ts, {bigrams_sql('ts')}) FROM (SELECT {tokens_sql(x)} AS ts))"


@query("bm25_phrase_doc_top5", f"WITH {bm25_sql(terms=phrase_sql)} {_SHOW} ({top_sql('hits', 5)})")
def bm25_phrase_doc(spark, d):
    return shown(ranking.top_k(retrieval.bm25(units(spark, d), asked(spark, d), BM25(rules=T.TokenRules(add_bigrams=True)), k=5), 5))


@query(
    "bm25_doc_padded_top50",
    f"""WITH {bm25_sql()}, q0 AS ({ASKED}), f AS (SELECT unit_ord, unit_id, doc_id FROM unit ORDER BY unit_ord LIMIT 50),
    every AS (SELECT qid, unit_ord, unit_id, doc_id, score, 0 AS pad FROM hits
      UNION ALL SELECT qid, f.unit_ord, f.unit_id, f.doc_id, 0.0, 1 FROM q0, f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = q0.qid AND h.unit_ord = f.unit_ord))
    SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pad, round(score, 9) DESC, unit_ord)::BIGINT AS rank FROM every) WHERE rank <= 50""",
)
def bm25_padded(spark, d):
    u, q = units(spark, d), asked(spark, d)
    return shown(ranking.padded(ranking.top_k(retrieval.bm25(u, q, k=50), 50), u, q, 50))


def chunk_bm25_sql(p: str = "c_") -> str:
    chunk_units_sql = "SELECT doc_id * 1000000 + position AS unit_ord, doc_id::VARCHAR || '::line::' || position::VARCHAR AS unit_id, doc_id::VARCHAR AS doc_id, text FROM chunk"
    return f"{line_chunks_sql(10, 5)}, {bm25_sql(chunk_units_sql, p=p)}, {p}top AS ({top_sql(f'{p}hits', 120)})"


def chunk_bm25(spark, d, depth: int = 120):
    return ranking.top_k(retrieval.bm25_chunks(docs(spark, d), ChunkRules(), asked(spark, d), k=depth), depth, "chunk")


AGGREGATION_SQL = {
    "max": "max(score)",
    "top2_mean": "avg(score) FILTER (n <= 2)",
    "max_plus_second": "max(score) + 0.2 * coalesce(max(score) FILTER (n = 2), 0)",
    "softmax_top3": "sum(score * exp(score - s1)) FILTER (n <= 3) / sum(exp(score - s1)) FILTER (n <= 3)",
}


def aggregated_sql(method: str, top: str, k: int) -> str:
    return f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, place)::BIGINT AS rank, doc_id, unit_id, s AS score FROM (
      SELECT qid, doc_id, min(rank) AS place, {AGGREGATION_SQL[method]} AS s, max(unit_id) FILTER (n = 1) AS unit_id
      FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 9) DESC, rank) AS n, max(score) OVER (PARTITION BY qid, doc_id) AS s1 FROM {top})
      GROUP BY qid, doc_id) QUALIFY rank <= {k}"""


for _method in ranking.AGGREGATIONS:
    query(f"bm25_chunk_{_method}", f"WITH {chunk_bm25_sql()} SELECT qid, rank, doc_id, unit_id, round(score, 6) AS score FROM ({aggregated_sql(_method, 'c_top', 20)})")(
        lambda spark, d, m=_method: ranking.aggregate_chunks(chunk_bm25(spark, d), m, 20).select("qid", "rank", "doc_id", "unit_id", F.round("score", 6).alias("score"))
    )


def tfidf_sql(least: int = 1) -> str:
    return f"""
t_u AS (SELECT doc_id AS unit_ord, unnest({tokens_sql('text')}) AS term FROM documents),
t_c AS (SELECT unit_ord, term, count(*)::DOUBLE AS tf FROM t_u GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*)::DOUBLE)) + 1 AS idf FROM t_c GROUP BY term HAVING count(*) >= {least}),
t_w AS (SELECT unit_ord, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY unit_ord)) AS w FROM t_c JOIN idf USING (term)),
qt AS (SELECT qid, term, count(*)::DOUBLE AS tf FROM (SELECT qid, unnest({tokens_sql('question')}) AS term FROM ({ASKED})) GROUP BY ALL),
qw AS (SELECT qid, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid)) AS qw FROM qt JOIN idf USING (term)),
hits AS (SELECT qid, unit_ord, unit_ord::VARCHAR AS unit_id, unit_ord::VARCHAR AS doc_id, sum(w * qw) AS score FROM qw JOIN t_w USING (term) GROUP BY ALL)"""


@query("tfidf_word_top5", f"WITH {tfidf_sql()} {_SHOW} ({top_sql('hits', 5)})")
def tfidf_word(spark, d):
    return shown(ranking.top_k(retrieval.tfidf(units(spark, d), asked(spark, d), k=5), 5))


@query("tfidf_min_df", f"WITH {tfidf_sql(3)} {_SHOW} ({top_sql('hits', 5)})")
def tfidf_min_df(spark, d):
    return shown(ranking.top_k(retrieval.tfidf(units(spark, d), asked(spark, d), TfIdf(min_df=3), k=5), 5))


def grams_sql(rows: str, key: str, text: str) -> str:
    return f"""SELECT {key}, g AS term, sum(c)::DOUBLE AS tf FROM (
      SELECT {key}, c, substring(w, i, n) AS g FROM (SELECT {key}, c, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i
        FROM (SELECT {key}, c, w, unnest(range(3, least(5, greatest(3, length(w))) + 1)) AS n
          FROM (SELECT {key}, ' ' || x || ' ' AS w, count(*) AS c FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')) AS x FROM {rows}) GROUP BY ALL)))) GROUP BY ALL"""


@query("tfidf_char_wb_3_5_top5", f"""WITH un AS ({DOC_UNITS}), c AS ({grams_sql('un', 'unit_ord', 'text')}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*)::DOUBLE)) + 1 AS idf FROM c GROUP BY term),
norm AS (SELECT unit_ord, sqrt(sum(tf * idf * tf * idf)) AS norm FROM c JOIN idf USING (term) GROUP BY unit_ord),
qt AS ({grams_sql(f'({ASKED})', 'qid', 'question')}),
qw AS (SELECT qid, term, idf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY qid)) AS qw FROM qt JOIN idf USING (term)),
hits AS (SELECT qid, unit_ord, unit_ord::VARCHAR AS unit_id, unit_ord::VARCHAR AS doc_id, sum(tf * idf / norm * qw) AS score FROM qw JOIN c USING (term) JOIN norm USING (unit_ord) GROUP BY ALL)
{_SHOW} ({top_sql('hits', 5)})""")
def tfidf_char(spark, d):
    return shown(ranking.top_k(retrieval.tfidf(units(spark, d), asked(spark, d), TfIdf("char_wb", (3, 5)), k=5), 5))


# --- vectors -------------------------------------------------------------------------------------------------------------


def vectors(spark, d):
    e = tables.read_table(spark, d, "embeddings")
    have = e.select(F.col("vec_id").cast("long").alias("unit_ord"), F.col("vec_id").cast("string").alias("unit_id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("vector"))
    return have, e.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("vector"))


DENSE_SQL = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
v AS (SELECT vec_id, label, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e)),
hits AS (SELECT q.vec_id::VARCHAR AS qid, u.vec_id AS unit_ord, u.vec_id::VARCHAR AS unit_id, u.label::VARCHAR AS doc_id, list_dot_product(q.v, u.v) AS score FROM v q, v u WHERE q.vec_id % 20 = 0)"""


@query("dense_top5", f"WITH {DENSE_SQL} SELECT qid, rank::BIGINT AS rank, unit_id, round(score, 6) AS score FROM ({top_sql('hits', 5)})")
def dense_top5(spark, d):
    return ranking.top_k(retrieval.dense(*vectors(spark, d), k=5), 5).select("qid", "rank", "unit_id", F.round("score", 6).alias("score"))


@query("dense_chunk_agg_max", f"WITH {DENSE_SQL}, top AS ({top_sql('hits', 50)}) {_SHOW} ({aggregated_sql('max', 'top', 20)})")
def dense_chunk_agg(spark, d):
    return shown(ranking.aggregate_chunks(ranking.top_k(retrieval.dense(*vectors(spark, d), k=50), 50, "dense"), "max", 20))


@query("l2_normalize", "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")
def l2_normalize(spark, d):
    e = tables.read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.round(F.sqrt(retrieval.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(retrieval.l2_normalized(F.col("v"))[0], 6).alias("first"))


def weighted(rows: DataFrame, text: str) -> DataFrame:
    """Token weights: share of a token among the row's tokens."""
    key = "unit_ord" if "unit_ord" in rows.columns else "qid"
    t = rows.select(key, T.lexical_tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("n"), F.explode("t").alias("term"))
    shares = t.groupBy(key, "n", "term").agg((F.count(F.lit(1)) / F.col("n")).alias("w"))
    maps = shares.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"))
    return rows.join(maps, key)


LEXICAL_SQL = f"""
ut AS (SELECT doc_id AS unit_ord, {tokens_sql('text')} AS t FROM documents),
uw AS (SELECT unit_ord, term, count(*) / any_value(n)::DOUBLE AS w FROM (SELECT unit_ord, unnest(t) AS term, len(t) AS n FROM ut) GROUP BY unit_ord, term),
qt AS (SELECT qid, {tokens_sql('question')} AS t FROM ({ASKED})),
qw AS (SELECT qid, term, count(*) / any_value(n)::DOUBLE AS qw FROM (SELECT qid, unnest(t) AS term, len(t) AS n FROM qt) GROUP BY qid, term),
hits AS (SELECT qid, unit_ord, unit_ord::VARCHAR AS unit_id, unit_ord::VARCHAR AS doc_id, sum(w * qw) AS score FROM qw JOIN uw USING (term) GROUP BY ALL)"""


@query("lexical_weight_dot", f"WITH {LEXICAL_SQL} {_SHOW} ({top_sql('hits', 5)})")
def lexical_weight_dot(spark, d):
    hits = retrieval.lexical_weights(weighted(units(spark, d), "text"), weighted(asked(spark, d), "question"))
    return shown(ranking.top_k(hits, 5))


@query("hybrid_dense_lexical", f"""WITH {DENSE_SQL}, lex AS (SELECT q.vec_id::VARCHAR AS qid, u.vec_id AS unit_ord, 1.0 AS score FROM embeddings q JOIN embeddings u ON q.label = u.label WHERE q.vec_id % 20 = 0),
mixed AS (SELECT h.qid, h.unit_ord, h.unit_id, h.doc_id, 0.7 * h.score + 0.3 * coalesce(l.score, 0) AS score FROM hits h LEFT JOIN lex l ON l.qid = h.qid AND l.unit_ord = h.unit_ord)
SELECT qid, rank::BIGINT AS rank, unit_id, round(score, 6) AS score FROM ({top_sql('mixed', 5)})""")
def hybrid_dense_lexical(spark, d):
    have = vectors(spark, d)[0]
    label = tables.read_table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("qid"), F.col("embedding").alias("vector"), F.create_map(F.col("label").cast("string"), F.lit(1.0)).alias("weights"))
    hits = retrieval.hybrid_search(have.withColumn("weights", F.create_map("doc_id", F.lit(1.0))), label, k=5)
    return ranking.top_k(hits, 5).select("qid", "rank", "unit_id", F.round("score", 6).alias("score"))


# --- fusion --------------------------------------------------------------------------------------------------------------


def three(spark, d, n: int = 3) -> list[DataFrame]:
    """The first n members."""
    u, q = units(spark, d), asked(spark, d)
    made = [
        lambda: ranking.top_k(retrieval.bm25(u, q, k=20), 20, "doc").drop("unit_ord"),
        lambda: ranking.aggregate_chunks(chunk_bm25(spark, d).drop("unit_ord"), "max", 20),
        lambda: ranking.top_k(retrieval.tfidf(u, q, k=20), 20, "tfidf").drop("unit_ord"),
    ]
    return [make() for make in made[:n]]


THREE_SQL = f"""{bm25_sql(p='d_')}, {chunk_bm25_sql()}, {tfidf_sql()},
m0 AS (SELECT 0 AS member, qid, rank, doc_id, score FROM ({top_sql('d_hits', 20)})),
m1 AS (SELECT 1 AS member, qid, rank, doc_id, score FROM ({aggregated_sql('max', 'c_top', 20)})),
m2 AS (SELECT 2 AS member, qid, rank, doc_id, score FROM ({top_sql('hits', 20)}))"""


def rrf_sql(members: str, k: int) -> str:
    return f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, seen)::BIGINT AS rank, doc_id, score FROM (
      SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(member * 1000 + rank) AS seen FROM {members} GROUP BY qid, doc_id) QUALIFY rank <= {k}"""


@query("rrf_doc_chunk", f"WITH {THREE_SQL}, m AS (FROM m0 UNION ALL FROM m1) {_SHOW} ({rrf_sql('m', 10)})")
def rrf_doc_chunk(spark, d):
    return shown(fusion.rrf(three(spark, d, 2), 60, 10))


@query("rrf_three_way", f"WITH {THREE_SQL}, m AS (FROM m0 UNION ALL FROM m1 UNION ALL FROM m2) {_SHOW} ({rrf_sql('m', 10)})")
def rrf_three_way(spark, d):
    return shown(fusion.rrf(three(spark, d), 60, 10))


QUOTA_LISTS = "lists AS (SELECT qid, [coalesce(list(doc_id ORDER BY rank) FILTER (member = 0), []), coalesce(list(doc_id ORDER BY rank) FILTER (member = 1), []), coalesce(list(doc_id ORDER BY rank) FILTER (member = 2), [])] AS ls FROM m GROUP BY qid)"
for _quota in (5, 10):
    query(
        f"quota_union_q{_quota}",
        f"""WITH {THREE_SQL}, m AS (FROM m0 UNION ALL FROM m1 UNION ALL FROM m2), {QUOTA_LISTS},
        picked AS (SELECT qid, list_reduce(list_concat([[]::VARCHAR[]], list_transform(range(0, {3 * _quota}), lambda i: ls[(i % 3) + 1])),
          lambda c, l: CASE WHEN len(c) >= 20 THEN c ELSE list_concat(c, list_filter(l, lambda x: NOT list_contains(c, x))[1:1]) END) AS p FROM lists),
        s AS (SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(member * 1000 + rank) AS seen FROM m GROUP BY qid, doc_id),
        o AS (SELECT s.*, nullif(list_position(p, doc_id), 0) AS place FROM s JOIN picked USING (qid))
        SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place NULLS LAST, round(score, 9) DESC, seen)::BIGINT AS rank FROM o) WHERE rank <= 20""",
    )(lambda spark, d, n=_quota: shown(fusion.quota_union(three(spark, d), n, None, 60, 20)))


@query("dedupe_ranked_docs", f"""WITH {chunk_bm25_sql()} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank)::BIGINT AS rank, doc_id, unit_id
FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 9) DESC, rank) AS n FROM c_top) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank) <= 10""")
def dedupe_ranked(spark, d):
    return ranking.dedupe_ranked_docs(chunk_bm25(spark, d), 10).select("qid", "rank", "doc_id", "unit_id")


@query("dedupe_topk", f"""WITH {chunk_bm25_sql()} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY place)::BIGINT AS rank, doc_id FROM (SELECT qid, doc_id, min(rank) AS place FROM c_top GROUP BY ALL) QUALIFY rank <= 10""")
def dedupe_topk(spark, d):
    return ranking.first_of_docs(chunk_bm25(spark, d), 10)


# --- splits and evaluation -------------------------------------------------------------------------------------------------


def grouped(spark, d):
    """Documents as rows, their source as group."""
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("qid"), F.col("source").alias("gold_doc_id"))


HOLDOUT_SQL = """side AS (SELECT g, CASE WHEN row_number() OVER (ORDER BY md5('42:' || g), g) <= ceil(count(*) OVER () * 0.2) THEN 'holdout' ELSE 'train' END AS eval_part FROM (SELECT DISTINCT source AS g FROM documents))"""


@query("group_holdout", f"WITH {HOLDOUT_SQL} SELECT doc_id::VARCHAR AS qid, source AS gold_doc_id, eval_part FROM documents JOIN side ON g = source")
def group_holdout(spark, d):
    return splits.group_holdout(grouped(spark, d))


@query("group_kfold", """
WITH RECURSIVE s AS (SELECT source AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY source),
put(i, loads, g, fold) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::VARCHAR, -1::BIGINT
  UNION ALL
  SELECT s.i, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN s.n ELSE 0 END), s.g, list_position(loads, list_min(loads)) - 1
  FROM put JOIN s ON s.i = put.i + 1)
SELECT doc_id::VARCHAR AS qid, source AS gold_doc_id, 'fold_' || fold::VARCHAR AS split FROM documents JOIN put ON put.g = source""")
def group_kfold(spark, d):
    return splits.group_kfold(grouped(spark, d))


@query("eval_folds_cv", f"WITH {HOLDOUT_SQL} SELECT doc_id::VARCHAR AS qid, 'valid' AS eval_part FROM documents JOIN side ON g = source WHERE eval_part = 'train'")
def eval_folds_cv(spark, d):
    return splits.eval_folds(grouped(spark, d), "cv").select("qid", "eval_part")


def _evaluated(spark, d, k=50, n: int = 3):
    """Gold and the first n rankings."""
    t = table(train(spark, d), "train")
    q = query_rows(t)
    u = units(spark, d)
    made = [
        lambda: ranking.top_k(retrieval.bm25(u, q, k=k), k, "bm25"),
        lambda: ranking.top_k(retrieval.tfidf(u, q, k=k), k, "tfidf"),
        lambda: ranking.aggregate_chunks(ranking.top_k(retrieval.bm25_chunks(docs(spark, d), ChunkRules(), q, k=120), 120, "chunk"), "max", k),
    ]
    return t, [make() for make in made[:n]]


EVAL_SQL = f"""{TRAIN_SQL}, {bm25_sql(p='d_')}, {tfidf_sql()}, {chunk_bm25_sql()},
r AS (SELECT 'bm25_doc' AS experiment, qid, rank, doc_id FROM ({top_sql('d_hits', 50)})
  UNION ALL SELECT 'tfidf_word_doc', qid, rank, doc_id FROM ({top_sql('hits', 50)})
  UNION ALL SELECT 'bm25_chunk', qid, rank, doc_id FROM ({aggregated_sql('max', 'c_top', 50)})),
x AS (SELECT e.experiment, t.qid, t.gold_doc_id, t.topic, 'fold_' || (t.qid::BIGINT % 3)::VARCHAR AS split, min(r.rank) AS best
  FROM train t CROSS JOIN (SELECT DISTINCT experiment FROM r) e LEFT JOIN r ON r.experiment = e.experiment AND r.qid = t.qid AND r.doc_id = t.gold_doc_id GROUP BY ALL),
h AS (SELECT experiment, qid, gold_doc_id, topic, split, coalesce(best <= 5, false)::INT AS h5, coalesce(best <= 10, false)::INT AS h10, coalesce(best <= 20, false)::INT AS h20, coalesce(best <= 50, false)::INT AS h50 FROM x)"""
EXPERIMENTS = ("bm25_doc", "tfidf_word_doc", "bm25_chunk")


def all_hits(spark, d) -> DataFrame:
    t, rs = _evaluated(spark, d)
    gold = t.select("qid", "gold_doc_id", "topic", F.concat(F.lit("fold_"), (F.col("qid").cast("long") % 3).cast("string")).alias("split"), F.lit("valid").alias("eval_part"))
    every = [evaluate.query_hits(gold, r).withColumn("experiment", F.lit(n)) for n, r in zip(EXPERIMENTS, rs, strict=True)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("query_hits", f'WITH {EVAL_SQL} SELECT experiment, qid, gold_doc_id, h5 AS "hit@5", h10 AS "hit@10", h20 AS "hit@20", h50 AS "hit@50" FROM h')
def query_hits(spark, d):
    return all_hits(spark, d).select("experiment", "qid", "gold_doc_id", *(f"`hit@{k}`" for k in evaluate.KS))


@query("recall_at_k", f'WITH {EVAL_SQL} SELECT experiment, count(*) AS n_eval, avg(h5) AS "recall@5", avg(h10) AS "recall@10", avg(h20) AS "recall@20", avg(h50) AS "recall@50" FROM h GROUP BY experiment')
def recall_at_k(spark, d):
    return evaluate.recall(all_hits(spark, d), "experiment")


ROLLUP_SQL = f"""WITH {EVAL_SQL}, rec AS (SELECT experiment, split, count(*) AS n_eval, avg(h5) AS r5 FROM h GROUP BY ALL)
SELECT experiment, count(DISTINCT split) AS n_splits, avg(n_eval) AS n_eval_mean, sum(n_eval)::BIGINT AS n_eval_total, round(avg(r5), 9) AS mean, round(stddev_samp(r5), 9) AS std, round(stddev_samp(r5) / sqrt(count(*)), 9) AS se,
  round(sum(r5 * n_eval) / sum(n_eval), 9) AS micro FROM rec GROUP BY experiment"""


@query("suite_summary", ROLLUP_SQL)
def suite_summary(spark, d):
    rec = evaluate.recall(all_hits(spark, d), "experiment", "split", "eval_part").withColumn("status", F.lit("ok"))
    r = evaluate.suite_rollup(rec)
    return r.select("experiment", "n_splits", "n_eval_mean", "n_eval_total", *(F.round(f"`recall@5_{c}`", 9).alias(c) for c in ("mean", "std", "se", "micro")))


@query("paired_comparison", f"""WITH {EVAL_SQL} SELECT a.experiment, avg(a.h5 - b.h5) AS delta, count_if(a.h5 > b.h5)::BIGINT AS wins, count_if(a.h5 < b.h5)::BIGINT AS losses, count_if(a.h5 = b.h5)::BIGINT AS ties, count(*) AS n_compared
FROM h a JOIN h b ON b.experiment = 'bm25_doc' AND a.qid = b.qid AND a.split = b.split GROUP BY a.experiment""")
def paired_comparison(spark, d):
    return evaluate.paired_comparison(all_hits(spark, d)).drop("eval_part")


@query("oracle_union", f"""WITH {EVAL_SQL}, u AS (SELECT qid, max(h20) AS u20, max(h50) AS u50 FROM h WHERE experiment <> 'bm25_doc' GROUP BY qid)
SELECT qid, u20 AS "union@20", (u20 = 1 AND h20 = 0)::INT AS "lost@20", u50 AS "union@50", (u50 = 1 AND h50 = 0)::INT AS "lost@50" FROM u JOIN h USING (qid) WHERE experiment = 'bm25_doc'""")
def oracle_union(spark, d):
    t, (a, b, c) = _evaluated(spark, d)
    return evaluate.oracle_union(t.select("qid", "gold_doc_id"), [b, c], a)


@query("best_experiment", f"WITH {EVAL_SQL}, m AS (SELECT experiment, avg(h5) AS r FROM h GROUP BY experiment) SELECT experiment FROM m ORDER BY r DESC, experiment LIMIT 1")
def best_experiment(spark, d):
    r = evaluate.recall(all_hits(spark, d), "experiment").withColumn("status", F.lit("ok"))
    return evaluate.best_experiment(r, "recall@5")


@query("mean_reciprocal_rank", f"WITH {EVAL_SQL} SELECT avg(CASE WHEN best <= 10 THEN 1.0::DOUBLE / best ELSE 0 END) AS mrr FROM x WHERE experiment = 'bm25_doc'")
def mean_reciprocal_rank(spark, d):
    t, rs = _evaluated(spark, d, n=1)
    return evaluate.reciprocal_rank(t.select("qid", "gold_doc_id"), rs[0])


@query("prediction_lists", f"WITH {bm25_sql()} SELECT qid, array_to_string(list(doc_id ORDER BY rank), ' ') AS doc_ids FROM ({top_sql('hits', 5)}) GROUP BY qid")
def prediction_lists(spark, d):
    return evaluate.prediction_lists(ranking.top_k(retrieval.bm25(units(spark, d), asked(spark, d), k=5), 5)).select("qid", F.array_join("doc_ids", " ").alias("doc_ids"))


# --- supervision and submission ----------------------------------------------------------------------------------------------


@query("evidence_windows", f"""WITH {TRAIN_SQL}, w AS (SELECT qid, gold_doc_id AS doc_id, whole, gold_evidence_char_start AS s, gold_evidence_char_end AS e, (gold_evidence_char_start + gold_evidence_char_end) // 2 AS c FROM train),
b AS (SELECT *, least(greatest(c - 600, 0), s)::BIGINT AS start, greatest(least(c + 600, length(whole)), e)::BIGINT AS "end" FROM w)
SELECT qid, doc_id, start, "end", md5(regexp_replace(substring(whole, start::INT + 1, ("end" - start)::INT), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM b""")
def evidence_windows(spark, d):
    w = supervision.evidence_windows(train(spark, d), docs(spark, d))
    return w.select("qid", "doc_id", "start", "end", F.md5("text").alias("text_md5"))


@query("evidence_alignment", f"WITH {TRAIN_SQL} SELECT qid, gold_doc_id AS doc_id FROM train WHERE qid::BIGINT % 5 = 0")
def evidence_alignment(spark, d):
    """Every fifth row has its offset moved by one, so that there is something to find."""
    moved = train(spark, d).withColumn("gold_evidence_char_start", F.col("gold_evidence_char_start") + (F.col("qid").cast("long") % 5 == 0).cast("int"))
    return tables.evidence_errors(moved, docs(spark, d)).select("qid", "doc_id")


@query("hard_negatives", f"""WITH {TRAIN_SQL}, {bm25_sql()}, top AS ({top_sql('hits', 50)})
SELECT t.qid, gold_doc_id, doc_id AS negative_doc_id, row_number() OVER (PARTITION BY t.qid ORDER BY rank)::BIGINT AS negative_rank FROM top JOIN train t ON t.qid = top.qid WHERE doc_id <> gold_doc_id QUALIFY negative_rank <= 5""")
def hard_negatives(spark, d):
    t, rs = _evaluated(spark, d, n=1)
    return supervision.hard_negatives(t, rs[0])


@query("submission", f"WITH {chunk_bm25_sql()} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY place)::BIGINT AS rank, doc_id FROM (SELECT qid, doc_id, min(rank) AS place FROM c_top GROUP BY ALL) QUALIFY rank <= 5")
def submission_rows(spark, d):
    return submission.submission_frame(chunk_bm25(spark, d))


@query("submission_violations", """
WITH s AS (SELECT item_id::VARCHAR AS qid, doc_id::VARCHAR AS doc_id FROM benchmark, (SELECT doc_id FROM documents WHERE doc_id < 6) WHERE item_id % 7 <> 0
  UNION ALL SELECT '1', 'nowhere' UNION ALL SELECT 'x', '0' UNION ALL SELECT '2', '0'),
q AS (SELECT DISTINCT item_id::VARCHAR AS qid FROM benchmark)
SELECT 'missing_qid' AS rule, qid, NULL AS doc_id FROM q WHERE qid NOT IN (SELECT qid FROM s)
UNION ALL SELECT 'unknown_qid', qid, NULL FROM (SELECT DISTINCT qid FROM s) WHERE qid NOT IN (SELECT qid FROM q)
UNION ALL SELECT 'too_many_rows', qid, NULL FROM s GROUP BY qid HAVING count(*) > 5
UNION ALL SELECT 'duplicate', qid, doc_id FROM s GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'unknown_doc', NULL, doc_id FROM (SELECT DISTINCT doc_id FROM s) WHERE doc_id NOT IN (SELECT doc_id::VARCHAR FROM documents)""")
def submission_violations(spark, d):
    items = tables.read_table(spark, d, "benchmark")
    some = docs(spark, d).where("doc_id < 6").select(F.col("doc_id").cast("string").alias("doc_id"))
    made = items.where("item_id % 7 <> 0").select(F.col("item_id").cast("string").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).join(some, F.col("n").cast("string") == F.col("doc_id")).select("qid", "doc_id")
    bad = spark.createDataFrame([("1", "nowhere"), ("x", "0"), ("2", "0")], "qid string, doc_id string")
    return submission.violations(made.unionByName(bad), items.select(F.col("item_id").alias("qid")), docs(spark, d))


@query("unknown_gold", "SELECT DISTINCT 'unknown_' || doc_id::VARCHAR AS gold_doc_id FROM labels WHERE doc_id < 50")
def unknown_gold(spark, d):
    """All labelled documents, which are known, and some made-up ids, so that there is something to find."""
    gold = tables.read_table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("gold_doc_id"), (F.col("doc_id") < 50).alias("more"))
    made = gold.where("more").select(F.concat(F.lit("unknown_"), "gold_doc_id").alias("gold_doc_id"))
    return tables.unknown_gold(gold.select("gold_doc_id").unionByName(made), docs(spark, d))


@query("duplicate_docs", "SELECT doc_id, n FROM (SELECT doc_id % 400 AS doc_id, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_docs(spark, d):
    return tables.duplicate_docs(docs(spark, d).withColumn("doc_id", F.col("doc_id") % 400))


@query("topic_value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def topic_value_counts(spark, d):
    return evaluate.value_counts(docs(spark, d), "source")


@query("doc_length_summary", "SELECT lang, count(*) AS n, avg(length(coalesce(text, ''))) AS mean, min(length(coalesce(text, ''))) AS min, max(length(coalesce(text, ''))) AS max FROM documents GROUP BY lang")
def doc_length_summary(spark, d):
    return evaluate.length_summary(docs(spark, d), "lang")


@query("doc_length_histogram", "SELECT least(greatest(floor(length(coalesce(text, '')) / 1000.0)::BIGINT + 1, 0), 21) AS bin, count(*) AS n FROM documents GROUP BY 1")
def doc_length_histogram(spark, d):
    return evaluate.length_histogram(docs(spark, d), 0, 20000, 20)


# --- reranking -----------------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    top = ranking.top_k(retrieval.bm25(units(spark, d), asked(spark, d), k=10), 10)
    # only candidates are cut into chunks again
    own = docs(spark, d).join(F.broadcast(top.select(F.col("doc_id").alias("of")).distinct()), F.col("doc_id").cast("string") == F.col("of"), "left_semi")
    return rerank.pairs(top, chunk_bm25(spark, d), chunk_units(own, ChunkRules()), docs(spark, d), 10, 2)


CLEAN_SQL = r"substring(regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 2500)"
PAIRS_SQL = f"""{bm25_sql(p='d_')}, {chunk_bm25_sql()}, cand AS ({top_sql('d_hits', 10)}),
own AS (SELECT c.qid, c.doc_id, c.unit_id AS chunk_id, row_number() OVER (PARTITION BY c.qid, c.doc_id ORDER BY c.rank) AS chunk_rank FROM c_top c JOIN cand USING (qid, doc_id) QUALIFY chunk_rank <= 2),
pair AS (SELECT cand.qid, cand.doc_id, cand.rank AS candidate_rank, cand.score AS candidate_score, coalesce(own.chunk_rank, 1)::BIGINT AS chunk_rank, own.chunk_id,
    {CLEAN_SQL.format("coalesce(u.text, substring(d.text, 1, 2500), '')")} AS text
  FROM cand LEFT JOIN own USING (qid, doc_id) LEFT JOIN c_unit u ON u.unit_id = own.chunk_id JOIN d_unit d ON d.doc_id = cand.doc_id),
ov AS (SELECT p.*, (SELECT count(*) FROM (SELECT DISTINCT unnest(qt) AS x) WHERE list_contains(pt, x)) / greatest(len(list_distinct(qt)), 1)::DOUBLE AS ce
  FROM (SELECT p.*, {tokens_sql('question')} AS qt, {tokens_sql('p.text')} AS pt FROM pair p JOIN ({ASKED}) USING (qid)) p)"""


@query("rerank_pairs", f"WITH {PAIRS_SQL} SELECT qid, doc_id, candidate_rank::BIGINT AS candidate_rank, chunk_rank, chunk_id, md5(text) AS text_md5, round(ce, 6) AS ce_score FROM ov")
def rerank_pairs(spark, d):
    p = _pairs(spark, d).join(asked(spark, d), "qid")
    return p.select("qid", "doc_id", "candidate_rank", "chunk_rank", "chunk_id", F.md5("text").alias("text_md5"), F.round(rerank.token_overlap(F.col("question"), F.col("text")), 6).alias("ce_score"))


BLEND_SQL = f"""{PAIRS_SQL}, g AS (SELECT qid, doc_id, min(candidate_rank) AS candidate_rank, any_value(candidate_score) AS cs, max(ce) AS ce FROM ov GROUP BY qid, doc_id),
z AS (SELECT *, CASE WHEN stddev_pop(ce) OVER w >= 1e-9 THEN (ce - avg(ce) OVER w) / stddev_pop(ce) OVER w ELSE 0 END AS zce,
    CASE WHEN stddev_pop(cs) OVER w >= 1e-9 THEN (cs - avg(cs) OVER w) / stddev_pop(cs) OVER w ELSE 0 END AS zcs FROM g WINDOW w AS (PARTITION BY qid))"""


@query("rerank_blend_zscore", f"WITH {BLEND_SQL} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(0.75 * zce + 0.25 * zcs, 9) DESC, candidate_rank, doc_id)::BIGINT AS rank, doc_id, round(0.75 * zce + 0.25 * zcs, 6) AS score FROM z")
def rerank_blend(spark, d):
    config = rerank.RerankConfig("blend", "bm25_doc", "token_overlap", 10, 2, "max", "ce_plus_candidate", 0.25)
    return shown(rerank.reranked(rerank.scored_pairs(_pairs(spark, d), asked(spark, d)), [config]))


@query("rerank_grid")
def rerank_grid(spark, d):
    grid = rerank.rerank_grid("bm25_doc", "token_overlap", depths=(5, 10))
    return rerank.reranked(rerank.scored_pairs(_pairs(spark, d), asked(spark, d)), grid).select("experiment", "qid", "rank", "doc_id", F.round("score", 6).alias("score"))
