"""Queries over document_metadata and document_relation."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docweave.operators import relations as R
from docweave.runtime import table


def _meta(spark: SparkSession, folder: str):
    return table(spark, folder, "document_metadata")


def _relations(spark, folder):
    return table(spark, folder, "document_relation")


def metadata_upsert(spark, folder):
    """Re-entries of a number replace the earlier entry: the newest entry of each number."""
    rows = _meta(spark, folder).where("so_hieu is not null").select("so_hieu", "id", "created_at").distinct()
    empty = rows.where(F.lit(False))
    return R.save_documents(empty, rows, [F.desc("created_at"), F.desc("id")])


def find_by_number(spark, folder):
    return R.find_by_number(_meta(spark, folder), " 9/2016/L-HNQG ").select("id", "so_hieu").distinct()


def name_search_ladder(spark, folder):
    asked = spark.createDataFrame([(1, "NGUỒN NƯỚC"), (2, "Lễ hội"), (3, "không có tên này")], "qid int, name string")
    return R.search_name(_meta(spark, folder).select("so_hieu", "ten_van_ban"), asked, 10)


def _titles(spark, folder):
    """The names of every row whose id is divisible by 20."""
    return _meta(spark, folder).where("id % 20 = 0 and ten_van_ban is not null").select(F.col("id").alias("qid"), F.col("ten_van_ban").alias("name")).distinct()


def name_search_titles(spark, folder):
    """Which documents' names hold the name of each asked row."""
    return R.search_name(_meta(spark, folder).select("so_hieu", "ten_van_ban"), _titles(spark, folder), 10)


def number_search(spark, folder):
    """Documents by the number of each row whose id is divisible by 20."""
    asked = _meta(spark, folder).where("id % 20 = 0 and so_hieu is not null").select(F.col("id").alias("qid"), F.col("so_hieu").alias("number"), F.lit(None).cast("string").alias("name")).distinct()
    return R.find_documents(_meta(spark, folder).select("so_hieu", F.lit(None).cast("string").alias("ten_van_ban")).distinct(), asked).select("qid", "so_hieu")


def field_search(spark, folder):
    return R.like_field(_meta(spark, folder).where("trang_thai = 1").select("so_hieu", "linh_vuc").distinct(), "linh_vuc", "Lưu trữ", 100)


def active_search(spark, folder):
    return R.search_active(_meta(spark, folder), "số 9/2016/L-HNQG về nguồn nước")


def metadata_listing(spark, folder):
    rows = _meta(spark, folder).where("so_hieu is not null").groupBy("so_hieu").agg(*(F.min(c).alias(c) for c in (*(c for c in R.SHOWN if c != "so_hieu"), "trang_thai")))
    return R.listed(rows)


def metadata_page(spark, folder):
    return R.page(_meta(spark, folder).select("so_hieu").distinct(), "so_hieu", 50, 100)


def metadata_fuzzy_search(spark, folder):
    """Three written questions, and the names of every row whose id is divisible by 20."""
    asked = spark.createDataFrame([(1, "9/2016/L-HNQG", None), (2, None, "luat quan ly ho so va tai san cong"), (3, None, "thi diem co che thiet bi do luong nam 2014")], "qid long, number string, name string")
    asked = asked.unionByName(_titles(spark, folder).select("qid", F.lit(None).cast("string").alias("number"), "name"))
    return R.find_documents(_meta(spark, folder).where("ten_van_ban is not null").select("so_hieu", "ten_van_ban").distinct(), asked)


def relations_by_entity(spark, folder):
    return R.by_entity(_relations(spark, folder).select("id", "entity_start", "entity_end", "relation_type").distinct())


def relation_report(spark, folder):
    return R.relation_report(_relations(spark, folder).select("id", "entity_start", "entity_end", "relation_type").distinct(), _meta(spark, folder).select("so_hieu", "ten_van_ban")).distinct()


def relation_save_idempotent(spark, folder):
    """Odd relations are stored, all are saved again: every triple is there once more at most."""
    rows = _relations(spark, folder).select("id", "entity_start", "entity_end", "relation_type")
    stored = rows.where("id % 2 = 1").select("entity_start", "entity_end", "relation_type").distinct()
    return R.save_relations(stored, rows)


def relation_delete_triple(spark, folder):
    rows = _relations(spark, folder).select("id", "entity_start", "entity_end", "relation_type").distinct()
    return R.delete_triple(rows, None, "9_2016_l-hnqg", "can_cu")


def relation_stats(spark, folder):
    return R.zero_filled(_relations(spark, folder).select("id", "relation_type").distinct(), "relation_type", R.RELATION_TYPES)


def _folders(spark, folder):
    path = F.regexp_extract("file_path", r"^kho/([^/]+)/", 1)
    named = F.create_map(*(F.lit(x) for pair in {"nd": "nghi_dinh", "nq": "nghi_quyet", "tt": "thong_tu", "l": "luat"}.items() for x in pair))
    return _meta(spark, folder).where("file_path is not null").select("so_hieu", F.coalesce(F.try_element_at(named, path), F.lit("khác")).alias("folder")).distinct()


def folder_types(spark, folder):
    return _folders(spark, folder).groupBy("folder").agg(F.count("*").alias("n")).withColumn("kind", R.folder_type(F.col("folder")))


def relation_build(spark, folder):
    """Both sides of the relation of every guiding document to every law."""
    return R.build_relations(_folders(spark, folder))


def deactivate_cascade(spark, folder):
    """Documents that a relation replaces are switched off with their nodes; how many of each state come out."""
    off = _relations(spark, folder).where("relation_type = 'thay_the' and entity_end is not null").select(F.col("entity_end").alias("so_hieu"))
    docs, nodes = R.deactivate(_meta(spark, folder).select("id", "so_hieu", "trang_thai").distinct(), table(spark, folder, "document_node").select("id", "so_hieu").distinct(), off)
    count = lambda rows, name: rows.groupBy("trang_thai").agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "trang_thai", "n")
    return count(docs, "document").unionByName(count(nodes, "node"))


def replace_workflow(spark, folder):
    docs = _meta(spark, folder).where("so_hieu is not null").groupBy("so_hieu").agg(F.max("created_at").alias("created_at"), F.max("trang_thai").alias("trang_thai"))
    pairs = _relations(spark, folder).where("relation_type = 'thay_the' and entity_start is not null and entity_end is not null").select(F.col("entity_start").alias("new_so_hieu"), F.col("entity_end").alias("so_hieu")).distinct()
    new = pairs.select(F.col("new_so_hieu").alias("so_hieu"), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit(1).alias("trang_thai")).distinct()
    after, _, edges = R.replace_document(docs, docs.select("so_hieu"), _relations(spark, folder).where("id % 2 = 0").select("entity_start", "entity_end", "relation_type").distinct(), new, pairs)
    return after.groupBy("trang_thai").agg(F.count("*").alias("n_documents")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_relations"))))


def backfill_default(spark, folder):
    rows = R.backfilled(R.backfilled(_meta(spark, folder).select("id", "linh_vuc").distinct(), "linh_vuc", "chưa rõ", "string"), "trang_thai", 1)
    return rows.groupBy("linh_vuc", "trang_thai").agg(F.count("*").alias("n"))


def resync_first_better(spark, folder):
    rows = table(spark, folder, "document_node").select("so_hieu", "id", "type", "title", "loaded_at").distinct()
    return R.resync(rows, "so_hieu", [F.col("loaded_at"), F.col("id"), F.col("type"), F.col("title")], ["type", "title"])


def agency_distribution(spark, folder):
    return _meta(spark, folder).select("id", "co_quan_ban_hanh").distinct().groupBy(F.lower("co_quan_ban_hanh").alias("body")).agg(F.count("*").alias("n"))


def agency_filter(spark, folder):
    return R.kept_bodies(_meta(spark, folder).select("id", "co_quan_ban_hanh").distinct(), "co_quan_ban_hanh", 5)


def corpus_filter_join(spark, folder):
    kept = R.corpus_of(table(spark, folder, "document_content").distinct(), _meta(spark, folder), ["hội đồng nhân dân tỉnh thanh vĩ", "bộ môi sinh và khí tượng"])
    return kept.select("id", "so_hieu", F.char_length("content_html").alias("n_chars"))


def metadata_stats(spark, folder):
    rows = _meta(spark, folder).select("id", "indexed").distinct()
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("indexed") == 1).alias("indexed"))


_NAMES = (
    "metadata_upsert find_by_number number_search name_search_ladder name_search_titles field_search active_search metadata_listing metadata_page metadata_fuzzy_search relations_by_entity relation_report relation_save_idempotent relation_delete_triple relation_stats folder_types relation_build "
    "deactivate_cascade replace_workflow backfill_default resync_first_better agency_distribution agency_filter corpus_filter_join metadata_stats"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_REL = "WITH r AS (SELECT DISTINCT id, entity_start, entity_end, relation_type FROM document_relation) "
_ENDS = _REL + ", e AS (SELECT entity_start AS entity, 'out' AS direction, entity_end AS other, relation_type FROM r UNION ALL SELECT entity_end, 'in', entity_start, relation_type FROM r) "
_FOLDERS = "WITH f AS (SELECT DISTINCT so_hieu, CASE regexp_extract(file_path, '^kho/([^/]+)/', 1) WHEN 'nd' THEN 'nghi_dinh' WHEN 'nq' THEN 'nghi_quyet' WHEN 'tt' THEN 'thong_tu' WHEN 'l' THEN 'luat' ELSE 'khác' END AS folder FROM document_metadata WHERE file_path IS NOT NULL) "
_list = lambda values: ", ".join(f"'{v}'" for v in values)
SQL = {
    "metadata_upsert": "SELECT DISTINCT so_hieu, id, created_at FROM document_metadata WHERE so_hieu IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY so_hieu ORDER BY created_at DESC, id DESC) = 1",
    "find_by_number": "SELECT DISTINCT id, so_hieu FROM document_metadata WHERE so_hieu = '9_2016_l-hnqg'",
    "name_search_ladder": "WITH q AS (SELECT * FROM (VALUES (1, 'nguồn nước'), (2, 'lễ hội'), (3, 'không có tên này')) v(qid, name)), m AS (SELECT DISTINCT qid, so_hieu FROM document_metadata JOIN q ON contains(lower(ten_van_ban), name)) SELECT qid, so_hieu FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY so_hieu) <= 10",
    "name_search_titles": "WITH q AS (SELECT DISTINCT id AS qid, lower(ten_van_ban) AS name FROM document_metadata WHERE id % 20 = 0 AND ten_van_ban IS NOT NULL), m AS (SELECT DISTINCT qid, so_hieu FROM (SELECT DISTINCT so_hieu, lower(ten_van_ban) AS low FROM document_metadata) JOIN q ON contains(low, name)) SELECT qid, so_hieu FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY so_hieu NULLS FIRST) <= 10",
    "field_search": "SELECT DISTINCT so_hieu, linh_vuc FROM document_metadata WHERE trang_thai = 1 AND contains(lower(linh_vuc), 'lưu trữ') ORDER BY so_hieu LIMIT 100",
    "metadata_page": "SELECT so_hieu FROM (SELECT DISTINCT so_hieu FROM document_metadata) ORDER BY so_hieu NULLS FIRST LIMIT 50 OFFSET 100",
    "relations_by_entity": _ENDS + "SELECT * FROM e WHERE entity IS NOT NULL",
    "relation_report": _ENDS + "SELECT DISTINCT entity, direction, relation_type, other, concat_ws(' ', CASE direction WHEN 'out' THEN '->' ELSE '<-' END, '[' || relation_type || ']', other, '(' || n.name || ')') AS line FROM e LEFT JOIN (SELECT so_hieu, min(ten_van_ban) AS name FROM document_metadata GROUP BY so_hieu) n ON n.so_hieu = e.other WHERE entity IS NOT NULL",
    "relation_save_idempotent": "SELECT DISTINCT entity_start, entity_end, relation_type FROM document_relation",
    "relation_delete_triple": _REL + "SELECT * FROM r WHERE NOT (entity_start IS NULL AND entity_end IS NOT DISTINCT FROM '9_2016_l-hnqg' AND relation_type IS NOT DISTINCT FROM 'can_cu')",
    "relation_stats": _REL + f"SELECT v.relation_type, count(r.id) AS n FROM (SELECT unnest([{_list(R.RELATION_TYPES)}]) AS relation_type) v LEFT JOIN r USING (relation_type) GROUP BY 1",
    "folder_types": _FOLDERS + "SELECT folder, count(*) AS n, CASE WHEN folder = 'khác' THEN 'other' ELSE folder END AS kind FROM f GROUP BY folder",
    "relation_build": _FOLDERS + "SELECT 'huong_dan_thi_hanh' AS relation_type, CASE folder WHEN 'luat' THEN 'end' ELSE 'start' END AS side, so_hieu FROM f WHERE folder IN ('luat', 'nghi_dinh', 'nghi_quyet', 'thong_tu')",
    "deactivate_cascade": "WITH off AS (SELECT DISTINCT entity_end AS so_hieu FROM document_relation WHERE relation_type = 'thay_the' AND entity_end IS NOT NULL), d AS (SELECT 'document' AS what, CASE WHEN off.so_hieu IS NOT NULL THEN 0 ELSE coalesce(trang_thai, 1) END AS trang_thai FROM (SELECT DISTINCT id, so_hieu, trang_thai FROM document_metadata) m LEFT JOIN off USING (so_hieu) UNION ALL SELECT 'node', CASE WHEN off.so_hieu IS NOT NULL THEN 0 ELSE 1 END FROM (SELECT DISTINCT id, so_hieu FROM document_node) n LEFT JOIN off USING (so_hieu)) SELECT what, trang_thai::INT AS trang_thai, count(*) AS n FROM d GROUP BY ALL",
    "replace_workflow": "WITH p AS (SELECT DISTINCT entity_start AS s, entity_end AS e FROM document_relation WHERE relation_type = 'thay_the' AND entity_start IS NOT NULL AND entity_end IS NOT NULL), d AS (SELECT so_hieu, max(trang_thai) AS t FROM document_metadata WHERE so_hieu IS NOT NULL GROUP BY so_hieu), u AS (SELECT so_hieu, t FROM d WHERE so_hieu NOT IN (SELECT s FROM p) UNION ALL SELECT DISTINCT s, 1 FROM p), a AS (SELECT CASE WHEN so_hieu IN (SELECT e FROM p) THEN 0 ELSE coalesce(t, 1) END AS trang_thai FROM u), r AS (SELECT DISTINCT entity_start, entity_end, relation_type FROM document_relation WHERE id % 2 = 0 UNION SELECT s, e, 'thay_the' FROM p) SELECT trang_thai::INT AS trang_thai, count(*) AS n_documents, (SELECT count(*) FROM r) AS n_relations FROM a GROUP BY 1",
    "backfill_default": "SELECT coalesce(linh_vuc, 'chưa rõ') AS linh_vuc, 1 AS trang_thai, count(*) AS n FROM (SELECT DISTINCT id, linh_vuc FROM document_metadata) GROUP BY 1",
    "resync_first_better": "WITH n AS (SELECT DISTINCT so_hieu, id, type, title, loaded_at FROM document_node) SELECT so_hieu, (list(type ORDER BY loaded_at, id, type NULLS FIRST, title NULLS FIRST) FILTER (type IS NOT NULL AND trim(type) <> ''))[1] AS type, (list(title ORDER BY loaded_at, id, type NULLS FIRST, title NULLS FIRST) FILTER (title IS NOT NULL AND trim(title) <> ''))[1] AS title FROM n GROUP BY so_hieu",
    "agency_distribution": "SELECT lower(co_quan_ban_hanh) AS body, count(*) AS n FROM (SELECT DISTINCT id, co_quan_ban_hanh FROM document_metadata) GROUP BY 1",
    "corpus_filter_join": "WITH m AS (SELECT id, any_value(so_hieu) AS so_hieu FROM document_metadata WHERE lower(trim(co_quan_ban_hanh)) IN ('hội đồng nhân dân tỉnh thanh vĩ', 'bộ môi sinh và khí tượng') GROUP BY id) SELECT id, so_hieu, length(content_html)::INT AS n_chars FROM (SELECT DISTINCT * FROM document_content) JOIN m USING (id) WHERE content_html IS NOT NULL",
    "metadata_stats": "SELECT count(*) AS total, count(*) FILTER (indexed = 1) AS indexed FROM (SELECT DISTINCT id, indexed FROM document_metadata)",
    "agency_filter": f"""WITH c AS (SELECT lower(trim(co_quan_ban_hanh)) AS body, count(*) AS n FROM (SELECT DISTINCT id, co_quan_ban_hanh FROM document_metadata WHERE co_quan_ban_hanh IS NOT NULL) GROUP BY 1)
SELECT body, n FROM c WHERE n > 5 AND (body IN ({_list(R.KEPT_BODIES)}) OR list_bool_or([starts_with(body, p) FOR p IN [{_list(R.KEPT_PREFIXES)}]])) AND NOT list_bool_or([starts_with(body, p) FOR p IN ['ban ', 'cục ', 'tổng cục ', 'chi cục ', 'sở ', 'văn phòng ']])
AND NOT contains(body, 'mặt trận') AND NOT contains(body, 'đoàn') AND NOT (contains(body, 'hội') AND NOT (contains(body, 'hội đồng nhân dân') OR contains(body, 'quốc hội')))""",
}
SQL |= {
    "active_search": "SELECT DISTINCT so_hieu, ten_van_ban FROM document_metadata WHERE trang_thai = 1 AND (contains(lower(so_hieu), '9_2016_l-hnqg') OR contains(lower(ten_van_ban), 'số 9/2016/l-hnqg về nguồn nước')) ORDER BY so_hieu, ten_van_ban LIMIT 100",
    "metadata_listing": "SELECT so_hieu, " + ", ".join(f"coalesce(nullif(min({c}), ''), '{R.SHOWN[c]}') AS {c}" for c in R.SHOWN if c != "so_hieu") + ", coalesce(min(trang_thai), 1) AS trang_thai FROM document_metadata WHERE so_hieu IS NOT NULL GROUP BY so_hieu ORDER BY so_hieu LIMIT 1000",
}
