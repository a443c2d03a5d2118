"""Lexical index and retrieval.

An index is three tables: docs(doc_id, dl), terms(term, df, idf, max_score) and postings(term, doc_id, tf, score).  All queries of a batch are answered in
one plan: query terms join the postings on the term, sums per (query, document) are combined map-side, and a window keeps the k best, for
which Spark plans a group limit before the shuffle.  Ties go to the smaller doc_id; scores are rounded to 6 places before they are ranked.

Defined results: documents without terms count in N and avgdl with length 0; queries without known terms have no result; repeated query terms count
once for BM25 and as often as they occur for TF-IDF.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import terms
from docweave.runtime import settled, small

K1, B = 1.5, 0.75


@dataclass
class Index:
    docs: DataFrame
    terms: DataFrame
    postings: DataFrame

    def save(self, folder: str) -> None:
        """Parquet tables; postings are clustered by term so that a lookup reads few row groups."""
        self.docs.write.mode("errorifexists").parquet(f"{folder}/docs")
        self.terms.write.mode("errorifexists").parquet(f"{folder}/terms")
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{folder}/postings")

    @staticmethod
    def load(spark, folder: str) -> Index:
        return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("docs", "terms", "postings")))


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """B1: ``key, term, tf``."""
    return docs.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """B2: ``key, dl`` of every document, empty ones included."""
    return docs.select(F.col(key), F.size(terms(F.col(text))).cast("long").alias("dl"))


def totals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: N and avgdl."""
    return lengths(docs, key, text).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def _impacts(tf: DataFrame, total: DataFrame, k1: float, b: float, key: str) -> tuple[DataFrame, DataFrame]:
    """(terms with df and idf, postings with scores) from ``key, dl, term, tf``; N and avgdl are one row, joined as such, and nothing is collected."""
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    idf = df.select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")
    norm = F.when(F.col("avgdl") == 0, F.lit(k1)).otherwise(k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return idf, tf.join(idf, "term").select("term", key, "tf", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def _counted(docs: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """``key, dl, term, tf``: a text is cut into words once, and its length goes along with them; of ``wanted(term)`` only those are counted, before the shuffle."""
    words = docs.select(F.col(key), terms(F.col(text)).alias("words")).select(key, F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    if wanted is not None:
        words = words.join(wanted, "term", "left_semi")
    return words.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25_index(docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> Index:
    """B1-B5."""
    idf, postings = _impacts(_counted(docs, key, text), totals(docs, key, text), k1, b, key)
    return Index(lengths(docs, key, text), idf.select("term", "df", "idf"), postings)


def bm25_postings_of(asked: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """The postings of the terms of ``asked(term)`` alone, as ``bm25_index`` scores them: what a batch of questions needs where no index is at hand."""
    wanted = small(settled(asked.select("term").distinct()))
    return _impacts(_counted(docs, key, text, wanted), totals(docs, key, text), k1, b, key)[1]


def max_scores(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.max("score").alias("max_score"))


def champions(postings: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """The ``size`` best postings of each term."""
    best = Window.partitionBy("term").orderBy(F.desc(F.round("score", 6)), key)
    return postings.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size).drop("place")


def query_terms(queries: DataFrame, qid: str, text: str) -> DataFrame:
    return queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def top_k(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``qid, key, score, rank`` of the k best."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", key, "score", "rank")


def search(asked: DataFrame, postings: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Sum of the impacts of a query's distinct terms; over all postings or over champions."""
    sums = asked.join(postings, "term").groupBy("qid", key).agg(F.round(F.sum("score"), 6).alias("score"))
    return top_k(sums, k, key)


def pruned_search(asked: DataFrame, postings: DataFrame, k: int, champion_size: int = 50, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The same result as ``search``, exactly, from fewer candidates; also ``qid, n_evaluated``, the candidates that were scored in full.

    The k-th best sum over champion postings alone bounds the k-th best score from below.  A query's terms, by ascending largest score, stay
    non-essential while their running sum is below that bound: a document that has only such terms can't be among the k best.  Documents with an essential
    term are the candidates, and only they are scored over all terms.
    """
    partial = asked.join(champions(postings, champion_size, key), "term").groupBy("qid", key).agg(F.sum("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"))
    bound = partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("bound"))
    running = Window.partitionBy("qid").orderBy("max_score", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = asked.join(max_scores(postings), "term").withColumn("sum_to", F.sum("max_score").over(running)).join(bound, "qid", "left")
    # ranking is by rounded scores, so the bound gives way by more than a rounding step
    marked = split.select("qid", "term", (F.col("sum_to") >= F.coalesce("bound", F.lit(0.0)) - 1e-5).alias("essential"))
    # one join with the postings: a document without an essential term is dropped by the flag its sum carries
    summed = marked.join(postings, "term").groupBy("qid", key).agg(F.sum("score").alias("sum"), F.bool_or("essential").alias("candidate")).where("candidate")
    return top_k(summed.select("qid", key, F.round("sum", 6).alias("score")), k, key), summed.groupBy("qid").agg(F.count("*").alias("n_evaluated"))


# ---- TF-IDF --------------------------------------------------------------------------------------------------------------------------


def tfidf_idf(tf: DataFrame, n_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``term, df, idf``; ``n_docs`` is a one-row table."""
    return idf_of(tf.groupBy("term").agg(F.count("*").alias("df")), n_docs)


def idf_of(df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """B9 of ``term, df``."""
    return df.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tf_scheme(tf: DataFrame, scheme: str, key: str) -> DataFrame:
    """``log`` 1 + ln tf, or ``augmented`` 0.5 + 0.5 tf / largest tf of the document."""
    if scheme == "log":
        return tf.withColumn("weight", 1 + F.log("tf"))
    if scheme == "augmented":
        return tf.withColumn("weight", 0.5 + 0.5 * F.col("tf") / F.max("tf").over(Window.partitionBy(key)))
    raise ValueError(f"no tf scheme {scheme!r}")


def tfidf_weights(tf: DataFrame, idf: DataFrame, scheme: str = "log", key: str = "doc_id") -> DataFrame:
    return tf_scheme(tf, scheme, key).join(idf.select("term", "idf"), "term").select(key, "term", (F.col("weight") * F.col("idf")).alias("weight"))


def norms(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """B11."""
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def query_vectors(queries: DataFrame, qid: str, text: str, idf: DataFrame, scheme: str = "log") -> DataFrame:
    """``qid, term, weight`` of length 1; unknown terms weigh nothing."""
    raw = tfidf_weights(term_frequencies(queries.select(F.col(qid).alias("qid"), F.col(text).alias("t")), "qid", "t"), idf, scheme, "qid")
    return raw.join(norms(raw, "qid"), "qid").select("qid", "term", (F.col("weight") / F.greatest("norm", F.lit(1e-12))).alias("weight"))


def inverted_search(vectors: DataFrame, weights: DataFrame, doc_norms: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Cosine of the documents that share a term."""
    dots = vectors.join(weights.withColumnRenamed("weight", "w"), "term").groupBy("qid", key).agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    return top_k(dots.join(doc_norms, key).select("qid", key, F.round(F.col("dot") / F.greatest("norm", F.lit(1e-12)), 6).alias("score")), k, key)


def forward_search(queries: DataFrame, qid: str, vectors: DataFrame, weights: DataFrame, doc_norms: DataFrame, docs: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """Like ``inverted_search``, but every document is ranked, those without a common term at 0.

    Zeros only fill places that matches leave, in order of the key, so no document beyond the 2k smallest keys can fill one: that many keys are joined to
    the queries instead of all documents.
    """
    matched = vectors.join(weights.withColumnRenamed("weight", "w"), "term").groupBy("qid", key).agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    matched = matched.join(doc_norms, key).select("qid", key, F.round(F.col("dot") / F.greatest("norm", F.lit(1e-12)), 6).alias("score"))
    first = docs.select(key).orderBy(key).limit(2 * k).agg(F.sort_array(F.collect_list(key)).alias("first"))
    zeros = queries.select(F.col(qid).alias("qid")).distinct().crossJoin(F.broadcast(first)).select("qid", F.explode("first").alias(key), F.lit(0.0).alias("score"))
    return top_k(matched.unionByName(zeros.join(matched, ["qid", key], "left_anti")), k, key)
