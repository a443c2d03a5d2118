"""Vector queries over embedding_result; queries are the records whose emb_id is divisible by 20, against all records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import paths as P
from docweave.operators import vector as V
from docweave.runtime import table

SIZE = 64


def store(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record, with its chunk's section type (from the chunk id's last part)."""
    rows = table(spark, folder, "embedding_result").select("emb_id", "chunk_id", "vector", F.coalesce(F.get_json_object("metadata", "$.trang_thai").cast("int"), F.lit(1)).alias("trang_thai"))
    kind = F.regexp_extract(F.col("chunk_id"), r"\.([a-z_]+?)(?:_[^._]*)?$", 1)
    return rows.dropDuplicates(["emb_id"]).withColumn("kind", F.when(kind == "", F.lit("document")).otherwise(kind))


def _asked(spark, folder):
    return store(spark, folder).where("emb_id % 20 = 0").select(F.col("emb_id").alias("qid"), F.col("vector").alias("qv"))


def _near(spark, folder, **options):
    return V.nearest(_asked(spark, folder), store(spark, folder), "qid", "qv", "emb_id", "vector", SIZE, **options)


def knn_cosine(spark, folder):
    return _near(spark, folder, k=10)


def knn_l2(spark, folder):
    return _near(spark, folder, k=10, metric="l2")


def knn_ip(spark, folder):
    return _near(spark, folder, k=10, metric="ip")


def knn_filtered(spark, folder):
    return _near(spark, folder, k=5, where={"kind": list(V.LEAVES)})


def knn_threshold(spark, folder):
    return _near(spark, folder, k=10, threshold=0.2)


def retrieve_rerank(spark, folder):
    """50 nearest by cosine, reranked by inner product, 5 kept."""
    near = _near(spark, folder, k=50).select("qid", "id", "distance")
    vectors = store(spark, folder).select(F.col("emb_id").alias("id"), F.col("vector").alias("v"))
    both = near.join(vectors, "id").join(_asked(spark, folder), "qid")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return V.rerank(both, F.round(product, 6), 5).select("qid", "id", "score", "rank")


def vector_search(spark, folder):
    """Leaves in force only, 50 nearest, chunks below another result dropped, 5 kept."""
    near = _near(spark, folder, k=50, where={"kind": list(V.LEAVES), "trang_thai": 1})
    chunks = store(spark, folder).select(F.col("emb_id").alias("id"), "chunk_id")
    kept = V.without_descendants(near.join(chunks, "id").select("qid", "id", "chunk_id", "distance"), "chunk_id", ["qid"])
    return V.rerank(kept, -F.col("distance"), 5).select("qid", "id", "chunk_id", "distance", "rank")


def store_rows(spark, folder):
    """The rows a vector store gets, with their chunk's number in the metadata."""
    rows = table(spark, folder, "embedding_result").where("chunk_id is not null").select("emb_id", "chunk_id", "chunk_index", "text", "vector", "metadata").dropDuplicates(["emb_id"])
    made = V.chunk_rows(rows.withColumn("text", F.col("emb_id").cast("string")))
    return made.select(F.col("text").cast("long").alias("emb_id"), "chunk_id", F.get_json_object("metadata", "$.chunk_index").cast("int").alias("chunk_index"), F.get_json_object("metadata", "$.section_type").alias("section_type"))


def scores_by_text(spark, folder):
    """Each query's texts with the rerank score of the last result that has the text."""
    rows = table(spark, folder, "chroma_query_result").where("query_id is not null and text is not null").select(F.col("query_id").alias("qid"), "text", "result_id", F.col("score_rerank").alias("score")).distinct()
    asked = rows.select("qid", "text").distinct()
    return V.scored_by_text(asked, rows.where("score is not null"), [F.desc("result_id")]).select("qid", F.md5("text").alias("text_md5"), "score")


def ancestor_dedup(spark, folder):
    rows = table(spark, folder, "chroma_query_result").where("query_id is not null and chunk_id is not null").select("query_id", "chunk_id").distinct()
    return V.without_descendants(rows, "chunk_id", ["query_id"])


def l2_normalize(spark, folder):
    rows = store(spark, folder).where(V.usable("vector", SIZE))
    return rows.select("emb_id", F.transform(V.normalized(F.col("vector")), lambda x: F.round(x, 5)).alias("unit"))


def embedding_pad_truncate(spark, folder):
    rows = store(spark, folder).where("vector is not null")
    fit = lambda n: F.round(F.aggregate(V.fitted(F.col("vector"), n), F.lit(0.0), lambda s, x: s + F.when(F.isnan(x), 0.0).otherwise(x.cast("double"))), 4)
    return rows.select("emb_id", F.size(V.fitted(F.col("vector"), 48)).alias("n_short"), fit(48).alias("sum_short"), F.size(V.fitted(F.col("vector"), 96)).alias("n_long"), fit(96).alias("sum_long"))


def mean_pool(spark, folder):
    return V.mean_vector(store(spark, folder), "kind", "vector", SIZE).select("kind", F.size("mean").alias("n"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


def get_by_ids_ordered(spark, folder):
    """The nodes a node's reference list names, in the list's order."""
    nodes = table(spark, folder, "document_node").dropDuplicates(["id"])
    asked = nodes.where("size(reference) > 0").select(F.col("id").alias("asking"), "reference")
    return V.by_ids(nodes.select("id", "type"), asked, "id", "asking", "reference").select("asking", "pos", "id", "type")


def upsert_merge(spark, folder):
    """First loads are the store, later loads the changes; the newest load of a node stays."""
    nodes = table(spark, folder, "document_node").select("id", "type", "loaded_at").distinct()
    first = nodes.groupBy("id").agg(F.min("loaded_at").alias("loaded_at"))
    store_ = nodes.join(first, ["id", "loaded_at"]).select("id", "type", "loaded_at")
    changes = nodes.join(first.withColumnRenamed("loaded_at", "since"), "id").where("loaded_at > since").select("id", "type", "loaded_at")
    return V.upsert(store_, changes, "id", [F.desc("loaded_at"), F.col("type")])


def shard_merge_anti(spark, folder):
    """Chunks of query results are shards over the embedded chunks: even queries first, then odd ones."""
    master = table(spark, folder, "embedding_result").where("chunk_id is not null").groupBy("chunk_id").agg(F.lit("embedding").alias("origin"))
    found = table(spark, folder, "chroma_query_result").where("chunk_id is not null")
    shards = [found.where(f"query_id % 2 = {n}").groupBy("chunk_id").agg(F.lit(name).alias("origin")) for n, name in ((0, "even"), (1, "odd"))]
    return V.merge_shards(master, shards, "chunk_id")


def metadata_lookup(spark, folder):
    """Chapter 1, section 1 nodes with their labels, the first 100 by id."""
    nodes = table(spark, folder, "document_node").dropDuplicates(["id"])
    labelled = nodes.select("id", "type", P.section(F.col("id"), "chuong").alias("chuong"), P.section(F.col("id"), "dieu").alias("dieu"))
    return V.by_metadata(labelled, {"chuong": "Chương 1", "type": ["dieu", "khoan"]}, "id", 100)


def decode_paths(spark, folder):
    nodes = table(spark, folder, "document_node").select("id").distinct()
    return nodes.select("id", *P.decoded(F.col("id")))


def path_ancestors(spark, folder):
    nodes = table(spark, folder, "document_node").select("id").distinct()
    return nodes.select("id", F.posexplode(P.ancestors(F.col("id"))).alias("pos", "ancestor"))


_NAMES = (
    "knn_cosine knn_l2 knn_ip knn_filtered knn_threshold retrieve_rerank vector_search store_rows scores_by_text ancestor_dedup l2_normalize embedding_pad_truncate mean_pool get_by_ids_ordered upsert_merge shard_merge_anti metadata_lookup decode_paths path_ancestors"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_STORE = r"""
WITH st AS (SELECT emb_id, any_value(chunk_id) AS chunk_id, any_value(vector) AS vector FROM embedding_result GROUP BY emb_id),
rows_ AS (SELECT emb_id, chunk_id, vector::DOUBLE[] AS v, coalesce(nullif(regexp_extract(chunk_id, '\.([a-z_]+?)(?:_[^._]*)?$', 1), ''), 'document') AS kind
  FROM st WHERE len(vector) = 64 AND list_count(list_filter(vector, lambda x: isnan(x) OR isinf(x))) = 0),
ask AS (SELECT emb_id AS qid, v AS qv FROM rows_ WHERE emb_id % 20 = 0)
"""
_COS = "CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(qv, qv) > 0 THEN round(1 - list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 6) END"


def _knn(distance: str, k: int, where: str = "TRUE", after: str = "") -> str:
    return _STORE + f"""
, d AS (SELECT qid, emb_id AS id, {distance} AS distance FROM ask, rows_ WHERE {where})
, r AS (SELECT qid, id, distance + 0.0 AS distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank FROM d WHERE distance IS NOT NULL QUALIFY rank <= {k})
{after or 'SELECT * FROM r'}"""


_LEAVES = "kind IN ('dieu', 'khoan', 'diem', 'phu_luc_phan')"
_ABOVE = "list_transform(range(1, len(string_split({0}, '.'))), lambda k: array_to_string(string_split({0}, '.')[1:k], '.'))"
SQL = {
    "knn_cosine": _knn(_COS, 10),
    "knn_ip": _knn("round(1 - list_dot_product(qv, v), 6)", 10),
    "knn_filtered": _knn(_COS, 5, _LEAVES),
    "knn_threshold": _knn(_COS, 10, after="SELECT * FROM r WHERE distance <= 0.2"),
    "retrieve_rerank": _knn(_COS, 50, after=", s AS (SELECT r.qid, r.id, round(list_dot_product(qv, v), 6) AS score FROM r JOIN ask USING (qid) JOIN rows_ ON emb_id = r.id) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 5"),
    "ancestor_dedup": f"WITH r AS (SELECT DISTINCT query_id, chunk_id, regexp_replace(chunk_id, '__dup_\\d+', '', 'g') AS base FROM chroma_query_result WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL), up AS (SELECT query_id, base, unnest({_ABOVE.format('base')}) AS a FROM r) SELECT query_id, chunk_id FROM r WHERE NOT EXISTS (SELECT 1 FROM up JOIN r q ON q.query_id = up.query_id AND q.base = up.a WHERE up.query_id = r.query_id AND up.base = r.base)",
    "get_by_ids_ordered": "WITH n AS (SELECT id, any_value(type) AS type, any_value(reference) AS reference FROM document_node GROUP BY id), a AS (SELECT id AS asking, unnest(reference) AS ref, unnest(range(len(reference)))::INT AS pos FROM n WHERE len(reference) > 0) SELECT asking, pos, n.id, n.type FROM a JOIN n ON n.id = a.ref",
    "shard_merge_anti": "SELECT chunk_id, min(o) AS origin FROM (SELECT chunk_id, CASE WHEN bool_or(w = 0) THEN 'embedding' WHEN bool_or(w = 1) THEN 'even' ELSE 'odd' END AS o FROM (SELECT chunk_id, 0 AS w FROM embedding_result UNION ALL SELECT chunk_id, CASE WHEN query_id % 2 = 0 THEN 1 ELSE 2 END FROM chroma_query_result WHERE query_id IS NOT NULL) WHERE chunk_id IS NOT NULL GROUP BY chunk_id) GROUP BY chunk_id",
    "path_ancestors": f"WITH n AS (SELECT DISTINCT id FROM document_node), a AS (SELECT id, {_ABOVE.format('id')} AS up FROM n) SELECT id, unnest(range(len(up)))::INT AS pos, unnest(up) AS ancestor FROM a",
}
_SECTION = "CASE WHEN regexp_matches(regexp_replace({0}, '__dup_\\d+', '', 'g'), '(^|\\.){1}(_[^.]*)?(\\.|$)') THEN trim('{2} ' || replace(regexp_extract(regexp_replace({0}, '__dup_\\d+', '', 'g'), '(?:^|\\.){1}(?:_([^.]*))?(?:\\.|$)', 1), '_', '.'), ' ') END"
SQL |= {
    "knn_l2": _knn("round(list_sum(list_transform(list_zip(qv, v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)", 10),
    "upsert_merge": "SELECT id, type, loaded_at FROM (SELECT DISTINCT id, type, loaded_at FROM document_node) QUALIFY CASE WHEN loaded_at = min(loaded_at) OVER (PARTITION BY id) THEN loaded_at = max(loaded_at) OVER (PARTITION BY id) ELSE row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, type NULLS FIRST) = 1 END",
    "metadata_lookup": f"WITH n AS (SELECT id, any_value(type) AS type FROM document_node GROUP BY id), l AS (SELECT id, type, {_SECTION.format('id', 'chuong', 'Chương')} AS chuong, {_SECTION.format('id', 'dieu', 'Điều')} AS dieu FROM n) SELECT * FROM l WHERE chuong = 'Chương 1' AND type IN ('dieu', 'khoan') ORDER BY id LIMIT 100",
    "mean_pool": _STORE + ", e AS (SELECT kind, unnest(v) AS x, unnest(range(64)) AS j FROM rows_), m AS (SELECT kind, j, round(avg(x), 6) AS a FROM e GROUP BY kind, j) SELECT kind, count(*)::INT AS n, round(sum(a), 3) AS total FROM m GROUP BY kind",
    "section_search": _knn(_COS, 3, "kind = 'dieu'"),
}
SQL |= {
    "store_rows": "SELECT emb_id, any_value(chunk_id) AS chunk_id, any_value(coalesce((metadata->>'$.chunk_index')::INT, chunk_index)) AS chunk_index, any_value(metadata->>'$.section_type') AS section_type FROM embedding_result WHERE chunk_id IS NOT NULL GROUP BY emb_id",
    "scores_by_text": "WITH r AS (SELECT DISTINCT query_id AS qid, text, result_id, score_rerank AS score FROM chroma_query_result WHERE query_id IS NOT NULL AND text IS NOT NULL) SELECT qid, md5(text) AS text_md5, coalesce(arg_max(score, result_id) FILTER (score IS NOT NULL), 0.0) AS score FROM r GROUP BY qid, text",
}
