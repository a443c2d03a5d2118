"""Queries of the llm problems, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import canonical, confusables, markup, mixture, packing, reading, similar, splitting
from docweave.runtime import spread, table

FIELDS = ("co_quan_ban_hanh", "loai")
TEXTS = (("document_metadata", "id", "ten_van_ban"), ("chroma_query_result", "result_id", "text"))
PARTS = ("content", "full_text")


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_metadata").select("id", F.explode(F.create_map(*(x for f in FIELDS for x in (F.lit(f), F.col(f))))).alias("field", "value"))


def p1_mapped(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.map_to_canonical(_typed(spark, folder), table(spark, folder, "canonical_value"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_mapped(spark, folder).select("id", "field", "ref_id").distinct()


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with how many records hold them."""
    return p1_mapped(spark, folder).where("ref_id < 0").groupBy("field", "value").agg(F.count_distinct("id").alias("n_records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.elements(spread(table(spark, folder, "document_content")))


def p2_elements(spark: SparkSession, folder: str) -> DataFrame:
    """The elements with their clean text."""
    return markup.elements(spread(table(spark, folder, "document_content")), with_text=True)


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of each record."""
    return markup.clean_texts(spread(table(spark, folder, "document_content")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = similar.most_similar(table(spark, folder, "embedding_result"), "emb_id", "vector", 64, k=5, min_similarity=0.90)
    return near.select(F.least("id", "other").alias("emb_id_a"), F.greatest("id", "other").alias("emb_id_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar other records of each record."""
    near = similar.most_similar(table(spark, folder, "embedding_result"), "emb_id", "vector", 64, k=5)
    return near.select("id", "other", F.round("similarity", 6).alias("similarity"), "rank")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [confusables.alike_pairs(table(spark, folder, t), key, text).select(F.lit(t).alias("source_table"), "id_a", "id_b") for t, key, text in TEXTS]
    return pairs[0].unionByName(pairs[1])


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record and text with the class of texts that print alike."""
    rows = [confusables.printed_classes(table(spark, folder, t), key, text).select(F.lit(t).alias("source_table"), F.col(key).alias("id"), "text_hash", "class_id", "n_forms") for t, key, text in TEXTS]
    return rows[0].unionByName(rows[1])


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_node").where("id is not null").select("id", F.explode(F.create_map(*(x for f in PARTS for x in (F.lit(f), F.col(f))))).alias("field", "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(_items(spark, folder)).where("piece_no = 2").select("id", "field").distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(_items(spark, folder), with_text=True).distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, folder))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(spread(table(spark, folder, "documents")), table(spark, folder, "mixture_target"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(spread(table(spark, folder, "documents")), table(spark, folder, "mixture_target"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars"))
    vietnamese = F.col("lang") == "vi"
    return reading.estimate_levels(documents, table(spark, folder, "reading_label"), vietnamese & (F.col("n_chars") >= 300), graded_where=vietnamese)


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    """How demanding each source's documents are."""
    documents = table(spark, folder, "documents").select("doc_id", mixture.source_key(F.col("source")).alias("source"))
    return p10_found(spark, folder).join(documents, "doc_id").groupBy("source", "level").agg(F.count("*").alias("n_documents"))


QUERIES = {
    "p1_found": p1_found, "p1_unmatched": p1_unmatched,
    "p2_found": p2_found, "p2_elements": p2_elements, "p2_clean": p2_clean,
    "p4_found": p4_found, "p4_neighbours": p4_neighbours,
    "p5_found": p5_found, "p5_classes": p5_classes,
    "p7_found": p7_found, "p7_pieces": p7_pieces,
    "p8_containers": p8_containers, "p8_report": p8_report,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_profile": p10_profile,
}

SQL = {
    "p4_found": """
WITH v AS (SELECT DISTINCT emb_id, vector::DOUBLE[] AS v FROM embedding_result WHERE len(vector) = 64 AND NOT list_bool_or([isnan(x) OR isinf(x) FOR x IN vector]) AND list_bool_or([x <> 0 FOR x IN vector])),
n AS (SELECT emb_id, v, sqrt(list_dot_product(v, v)) AS norm FROM v),
s AS (SELECT a.emb_id AS a, b.emb_id AS b, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS cosine FROM n a JOIN n b ON a.emb_id <> b.emb_id),
r AS (SELECT a, b FROM s WHERE cosine >= 0.90 QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS emb_id_a, greatest(a, b) AS emb_id_b FROM r""",
    "p7_found": "SELECT DISTINCT id, field FROM (SELECT id, 'content' AS field, content AS t FROM document_node UNION ALL SELECT id, 'full_text', full_text FROM document_node) WHERE id IS NOT NULL AND length(t) > 1200",
}
