"""Queries over the lexical index of ``documents``; queries are the titles of every document_metadata row whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import code_terms, content_terms
from docweave.operators import batch_search as S
from docweave.operators import lexical as L
from docweave.runtime import settled, spread, table


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_metadata").where("id % 20 = 0").groupBy("id").agg(F.min("ten_van_ban").alias("title"))


def _index(spark, folder) -> L.Index:
    return L.bm25_index(corpus(spark, folder))


def _terms(spark, folder) -> DataFrame:
    return L.query_terms(asked(spark, folder), "id", "title")


def tokenize_terms(spark, folder):
    return L.term_frequencies(corpus(spark, folder), "doc_id", "text")


def doc_lengths_avgdl(spark, folder):
    dl = L.lengths(corpus(spark, folder), "doc_id", "text")
    return dl.crossJoin(F.broadcast(L.totals(corpus(spark, folder), "doc_id", "text"))).select("doc_id", "dl", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(spark, folder):
    return _index(spark, folder).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_postings(spark, folder):
    return _index(spark, folder).postings.select("term", "doc_id", "tf", F.round("score", 6).alias("score"))


def term_max_score(spark, folder):
    return L.max_scores(_index(spark, folder).postings).select("term", F.round("max_score", 6).alias("max_score"))


def champion_lists(spark, folder):
    return L.champions(_index(spark, folder).postings, 20).select("term", "doc_id", F.round("score", 6).alias("score"))


def _postings(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The questions' terms, and their postings as a table, since searches read them more than once."""
    terms = settled(_terms(spark, folder))
    return terms, settled(L.bm25_postings_of(terms, corpus(spark, folder)))


def _counted(spark, folder, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame, S.Weighing]:
    """The documents as counted for the questions' terms, the questions (those of ``of(qid)``, else all), and the terms' weights."""
    terms = _terms(spark, folder)
    terms = settled(terms if of is None else terms.join(of, "qid", "left_semi"))
    rows = S.counted(corpus(spark, folder), "doc_id", "text", terms)
    return rows, terms, S.bm25_weighing(rows)


def bm25_search_full(spark, folder):
    return S.search(*_counted(spark, folder), 10)


def bm25_search_champion(spark, folder):
    terms, postings = _postings(spark, folder)
    return L.search(terms, L.champions(postings, 50), 10)


def bm25_wand(spark, folder, of=None):
    return S.pruned_search(*_counted(spark, folder, of), 20)[0]


def bm25_wand_evaluated(spark, folder):
    return S.pruned_search(*_counted(spark, folder), 20)[1]


def _tfidf(spark, folder, scheme):
    tf = L.term_frequencies(corpus(spark, folder), "doc_id", "text")
    idf = L.tfidf_idf(tf, corpus(spark, folder).agg(F.count("*").alias("n_docs")))
    return tf, idf, L.tfidf_weights(tf, idf, scheme)


def tfidf_idf(spark, folder):
    return _tfidf(spark, folder, "log")[1].select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_log_weights(spark, folder):
    return _tfidf(spark, folder, "log")[2].select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_aug_weights(spark, folder):
    return _tfidf(spark, folder, "augmented")[2].select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_norms(spark, folder):
    return L.norms(_tfidf(spark, folder, "log")[2]).select("doc_id", F.round("norm", 6).alias("norm"))


def tfidf_query_vectors(spark, folder):
    return L.query_vectors(asked(spark, folder), "id", "title", _tfidf(spark, folder, "log")[1]).select("qid", "term", F.round("weight", 6).alias("weight"))


def _cosine(spark, folder, scheme) -> tuple[DataFrame, DataFrame, S.Weighing]:
    """The documents with all their words counted, the questions' vectors, and the weights of both."""
    rows = S.counted(corpus(spark, folder), "doc_id", "text")
    idf = settled(L.idf_of(S.frequencies(rows), rows.agg(F.count("*").alias("n_docs"))))
    return rows, settled(L.query_vectors(asked(spark, folder), "id", "title", idf, scheme)), S.cosine_weighing(idf, scheme)


def tfidf_inverted_search(spark, folder):
    return S.search(*_cosine(spark, folder, "log"), 10)


def tfidf_forward_search(spark, folder):
    rows, vectors, weighing = _cosine(spark, folder, "augmented")
    return S.with_zeros(S.search(rows, vectors, weighing, 5), asked(spark, folder), "id", rows, 5)


def index_stats(spark, folder):
    index = _index(spark, folder)
    return L.totals(corpus(spark, folder), "doc_id", "text").crossJoin(F.broadcast(index.terms.agg(F.count("*").alias("vocabulary")))).crossJoin(F.broadcast(index.postings.agg(F.count("*").alias("n_postings")))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "vocabulary", "n_postings")


def code_preserving_tokens(spark, folder):
    return asked_all(spark, folder).select("id", F.explode(code_terms(F.col("ten_van_ban"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


def stopword_free_tokens(spark, folder):
    return asked_all(spark, folder).select("id", F.explode(content_terms(F.col("ten_van_ban"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


def asked_all(spark, folder):
    return table(spark, folder, "document_metadata").select("id", "ten_van_ban").distinct()


_NAMES = (
    "tokenize_terms doc_lengths_avgdl bm25_idf bm25_postings term_max_score champion_lists bm25_search_full bm25_search_champion bm25_wand bm25_wand_evaluated tfidf_idf tfidf_log_weights tfidf_aug_weights tfidf_norms "
    "tfidf_query_vectors tfidf_inverted_search tfidf_forward_search index_stats code_preserving_tokens stopword_free_tokens"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_WORDS = r"list_filter(string_split(coalesce(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ''), ' '), lambda w: w <> '')"
_BASE = f"""
WITH doc AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM doc) GROUP BY ALL),
dl AS (SELECT doc_id, len(ws) AS dl FROM doc), tot AS (SELECT count(*) AS n_docs, coalesce(avg(dl), 0) AS avgdl FROM dl),
idf AS (SELECT term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
post AS (SELECT tf.term, tf.doc_id, tf, idf * tf * 2.5 / (tf + CASE WHEN avgdl = 0 THEN 1.5 ELSE 1.5 * (0.25 + 0.75 * dl / avgdl) END) AS score FROM tf JOIN dl USING (doc_id) JOIN idf USING (term), tot),
ask AS (SELECT id AS qid, min(ten_van_ban) AS title FROM document_metadata WHERE id % 20 = 0 GROUP BY id),
qt AS (SELECT DISTINCT qid, unnest({_WORDS.format("title")}) AS term FROM ask)
"""


def _ranked(postings: str, k: int) -> str:
    return f", s AS (SELECT qid, doc_id, round(sum(score), 6) AS score FROM qt JOIN {postings} USING (term) GROUP BY ALL) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= {k}"


def _champions(size: int) -> str:
    return f", champ AS (SELECT term, doc_id, score FROM post QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(score, 6) DESC, doc_id) <= {size})"


_TFIDF = _BASE + """
, ti AS (SELECT term, df, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot)
, w AS (SELECT doc_id, term, {scheme} * idf AS weight FROM tf JOIN ti USING (term))
, nm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc_id)
, qtf AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest(""" + _WORDS.format("title").replace("{", "{{").replace("}", "}}") + """) AS term FROM ask) GROUP BY ALL)
, qw AS (SELECT qid, term, {qscheme} * idf AS weight FROM qtf JOIN ti USING (term))
, qv AS (SELECT qid, term, weight / greatest(sqrt(sum(weight * weight) OVER (PARTITION BY qid)), 1e-12) AS weight FROM qw)
"""
_TFIDF = _BASE + _TFIDF[len(_BASE):].replace("{{", "{").replace("}}", "}")
_LOG = _TFIDF.replace("{scheme}", "(1 + ln(tf))").replace("{qscheme}", "(1 + ln(tf))")
_AUG = _TFIDF.replace("{scheme}", "(0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id))").replace("{qscheme}", "(0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY qid))")
_DOT = ", s AS (SELECT qid, doc_id, round(sum(q.weight * w.weight) / greatest(any_value(norm), 1e-12), 6) AS score FROM qv q JOIN w USING (term) JOIN nm USING (doc_id) GROUP BY qid, doc_id)"
_STOP = "['" + "','".join(__import__("docweave.functions.text", fromlist=["STOPWORDS"]).STOPWORDS) + "']"

SQL = {
    "tokenize_terms": _BASE + "SELECT * FROM tf",
    "doc_lengths_avgdl": _BASE + "SELECT doc_id, dl, n_docs, round(avgdl, 6) AS avgdl FROM dl, tot",
    "bm25_idf": _BASE + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_postings": _BASE + "SELECT term, doc_id, tf, round(score, 6) AS score FROM post",
    "term_max_score": _BASE + "SELECT term, round(max(score), 6) AS max_score FROM post GROUP BY term",
    "champion_lists": _BASE + _champions(20) + "SELECT term, doc_id, round(score, 6) AS score FROM champ",
    "bm25_search_full": _BASE + _ranked("post", 10),
    "bm25_search_champion": _BASE + _champions(50) + _ranked("champ", 10),
    "bm25_wand": _BASE + _ranked("post", 20),
    "tfidf_idf": _LOG + "SELECT term, df, round(idf, 6) AS idf FROM ti",
    "tfidf_log_weights": _LOG + "SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "tfidf_aug_weights": _AUG + "SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "tfidf_norms": _LOG + "SELECT doc_id, round(norm, 6) AS norm FROM nm",
    "tfidf_query_vectors": _LOG + "SELECT qid, term, round(weight, 6) AS weight FROM qv",
    "tfidf_inverted_search": _LOG + _DOT + " SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10",
    "tfidf_forward_search": _AUG + _DOT + ", f AS (SELECT qid, doc_id, coalesce(score, 0) AS score FROM ask CROSS JOIN doc LEFT JOIN s USING (qid, doc_id)) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 5",
    "index_stats": _BASE + "SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS vocabulary, (SELECT count(*) FROM post) AS n_postings FROM tot",
    "stopword_free_tokens": f"SELECT id, token, count(*) AS n FROM (SELECT id, unnest({_WORDS.format('ten_van_ban')}) AS token FROM (SELECT DISTINCT id, ten_van_ban FROM document_metadata)) WHERE NOT list_contains({_STOP}, token) GROUP BY ALL",
}
_JOINED = r"regexp_replace({0}, '([\p{{L}}\p{{N}}_])[/\-]+([\p{{L}}\p{{N}}_])', '\1_\2', 'g')"
SQL["code_preserving_tokens"] = "SELECT id, token, count(*) AS n FROM (SELECT id, unnest(list_filter(string_split(trim(regexp_replace(" + _JOINED.format(_JOINED.format("lower(ten_van_ban)")) + r", '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), ' '), lambda w: w <> '')) AS token FROM (SELECT DISTINCT id, ten_van_ban FROM document_metadata) WHERE ten_van_ban IS NOT NULL) GROUP BY ALL"
