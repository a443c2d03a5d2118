"""Queries of the text, metadata, structure, citation, context and question-answering operators.

Over whole tables; invented texts only where no table holds any (model answers).
"""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import paths as P
from docweave.functions import text as X
from docweave.operators import agent as A
from docweave.operators import citations as C
from docweave.operators import metadata as M
from docweave.operators import references as N
from docweave.operators import structure as S
from docweave.operators import vector as V
from docweave.operators.hierarchy import hierarchy
from docweave.plans.vector_queries import _near, store
from docweave.runtime import settled, spread, table

#: Invented model answers.
ANSWERS = (
    (1, "Đáp án: B"), (2, "C"), (3, "Tôi chọn [D] vì ..."), (4, "<output>A</output>"), (5, "không rõ"), (6, ""), (7, None),
)


def _nodes(spark: SparkSession, folder: str):
    return table(spark, folder, "document_node")


def _contents(spark, folder):
    return _nodes(spark, folder).where("content is not null").select("id", "content").distinct()


def clean_text(spark, folder):
    rows = table(spark, folder, "document_content").where("content_html is not null").distinct()
    return rows.select("id", X.clean_text(F.col("content_html")).alias("text"))


def html_to_text(spark, folder):
    rows = table(spark, folder, "document_content").where("content_html is not null").distinct()
    return rows.select("id", X.html_text(F.col("content_html")).alias("text"))


def normalize_titles(spark, folder):
    rows = table(spark, folder, "document_metadata").select("id", "ten_van_ban").distinct()
    return rows.select("id", X.normalize_text(F.col("ten_van_ban")).alias("normal"))


def strip_diacritics(spark, folder):
    rows = table(spark, folder, "document_metadata").where("ten_van_ban is not null").select("id", "ten_van_ban").distinct()
    return rows.select("id", X.strip_marks(F.col("ten_van_ban")).alias("plain"))


def slug_id(spark, folder):
    rows = table(spark, folder, "document_relation").select(F.explode(F.array("entity_start", "entity_end")).alias("raw")).where("raw is not null").distinct()
    return rows.select("raw", X.number_slug(F.col("raw")).alias("slug"), X.id_form(F.col("raw")).alias("ascii_id"))


def to_roman(spark, folder):
    rows = _nodes(spark, folder).select(F.regexp_extract("id", r"\.chuong_([^.]+)$", 1).alias("n")).where("n <> ''").distinct()
    return rows.select("n", X.roman(F.col("n")).alias("roman"))


def number_words(spark, folder):
    rows = spark.createDataFrame([(w,) for w in (*X.NUMBER_WORDS, "Mười  Một", "IV", "x", "xi", "abc")], "word string")
    return rows.select("word", X.number_of(F.col("word")).alias("number"))


def fuzzy_name_match(spark, folder):
    """Names of the same number: how alike they are."""
    rows = table(spark, folder, "document_metadata").where("so_hieu is not null and ten_van_ban is not null").groupBy("so_hieu").agg(F.min("ten_van_ban").alias("a"), F.max("ten_van_ban").alias("b"))
    return rows.where("a <> b").select("so_hieu", F.round(X.fuzzy_score("a", "b"), 6).alias("score"))


def answer_letter(spark, folder):
    rows = spark.createDataFrame(ANSWERS, "id int, answer string")
    return rows.select("id", *(X.answer_letter(F.col("answer"), s).alias(s) for s in ("line", "word", "tagged")))


def json_props(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


def json_recovered(spark, folder):
    rows = table(spark, folder, "embedding_result").where("metadata is not null").select("emb_id", "metadata").distinct()
    return rows.select("emb_id", X.recovered_json(F.concat(F.lit("Kết quả: ```json\n"), "metadata", F.lit("\n``` hết"))).alias("json"))


def document_heads(spark, folder):
    """M1-M8 of the text of every record's content."""
    rows = spread(table(spark, folder, "document_content").where("content_html is not null")).distinct()
    return M.extract(rows.select("id", X.html_text(F.col("content_html")).alias("text")), "text").drop("text")


def article_counts(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    return rows.select("doc_id", M.article_count(F.col("text")).alias("so_dieu"), M.kind(F.col("text")).alias("loai"))


def heading_parse(spark, folder):
    rows = _nodes(spark, folder).where("title is not null").select("id", F.trim("title").alias("line")).distinct()
    kind, index = S.heading_columns(F.col("line"))
    return rows.select("id", kind.alias("kind"), index.alias("idx"))


def structure_tree(spark, folder):
    texts = spread(table(spark, folder, "documents").where("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))
    return S.parse_documents(texts, "id", "text").select("id", "parent_id", "type", "title", F.char_length("content").alias("n_chars"), F.size("reference").alias("n_references"), "position")


def parent_context(spark, folder):
    """Rebuilt from the tree, for nodes that have ancestors with titles."""
    nodes = _nodes(spark, folder)
    tree = hierarchy(nodes.select("id", "parent_id"), with_paths=True)
    return S.parent_context(nodes.select("id", "title"), tree)


def dup_suffix(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("o"), "l_orderkey", F.lit(".dieu_"), "l_linenumber").alias("id"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")]
    return S.suffixed(rows, "id", order).groupBy(F.when(F.contains("id", F.lit("__dup_")), "repeated").otherwise("single").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


def fixed_chunks(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(S.windows(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.col("w.number").alias("number"), F.char_length("w.piece").alias("n_chars"))


def recursive_chunks(spark, folder):
    """Every document in pieces by the recursive splitter."""
    rows = spread(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"))
    return S.chunked(rows, "doc_id", "text", "fixed_size").select("id", "parent_id", F.char_length("content").alias("n_chars"), F.md5("content").alias("digest"))


def word_window_split(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(S.word_windows(F.col("text"), 500, 450, 50)).alias("number", "piece"))
    return rows.select("doc_id", "number", F.size(F.filter(F.split("piece", r"\s+"), lambda w: w != "")).alias("n_words"))


def chunk_type_histogram(spark, folder):
    return _nodes(spark, folder).select("id", "type").distinct().groupBy("type").agg(F.count("*").alias("n"))


def embedding_texts(spark, folder):
    rows = _nodes(spark, folder).dropDuplicates(["id"])
    return rows.select("id", F.md5(S.embedding_text(F.col("type"), F.col("parent_context"), F.col("title"), F.col("content"))).alias("digest"))


def length_guard(spark, folder):
    return S.too_long(_contents(spark, folder).select("id", "content", P.document_of(F.col("id")).alias("doc")), "content", "id", "doc", 256)


def ref_candidates(spark, folder):
    rows = _contents(spark, folder).select("id", N.sentences(F.col("content")).alias("all"), N.candidate_sentences(F.col("content")).alias("some"))
    return rows.select("id", F.size("all").alias("n_sentences"), F.size("some").alias("n_candidates"))


def ref_extract(spark, folder):
    rows = _contents(spark, folder).withColumn("doc", P.document_of(F.col("id")))
    return N.references(rows, "id", "content", "doc")


def ref_ranges(spark, folder):
    rows = spark.createDataFrame([(1, "từ Điều 3 đến Điều 6 và từ các điều 5 đến 8"), (2, "từ Điều 9 đến Điều 2"), (3, "Điều 1")], "id int, text string")
    return rows.select("id", F.explode(N.article_ranges(F.col("text"))).alias("article"))


def ref_expand(spark, folder):
    nodes = _nodes(spark, folder).select("id", "reference").dropDuplicates(["id"])
    refs = C.stored_references(nodes.where("size(reference) > 0"), nodes)
    # a deterministic scorer: how much of the path the two share
    both = P.document_of(F.col("main")) == P.document_of(F.col("ref"))
    scored = refs.withColumn("score", F.when(both, 8.0).otherwise(6.0) - F.col("pos") * 0.5)
    return C.chosen_references(scored).select("main", "ref", "score", "rank")


def nearest_law(spark, folder):
    """For each article a node's text mentions the nearest place where it mentions a law."""
    rows = _contents(spark, folder)
    at = lambda word, name: rows.select("id", F.explode(N.positions(F.col("content"), word)).alias(name))
    return N.nearest_places(at("điều ", "at").distinct(), at("luật", "place").distinct(), "id").withColumnRenamed("at", "pos")


def reference_lists(spark, folder):
    rows = _nodes(spark, folder).where("size(reference) > 0").select("id", "reference").distinct()
    return rows.select("id", F.explode(C.normal_list(F.col("reference"))).alias("ref")).select("id", "ref", C.valid_id(F.col("ref")).alias("valid"))


def context_blocks(spark, folder):
    """Per query the stored texts of its results by distance, each with the texts of its chunk's chosen references below."""
    found = table(spark, folder, "chroma_query_result").where("distance is not null and text is not null").select("query_id", "result_id", "chunk_id", "text", "distance").distinct()
    order = Window.partitionBy("query_id").orderBy("distance", "result_id")
    main = found.withColumn("rank", F.row_number().over(order)).select(F.col("query_id").alias("qid"), "rank", F.col("chunk_id").alias("main"), "text")
    stored = _nodes(spark, folder).groupBy(F.col("id").alias("ref")).agg(F.min("full_text").alias("ref_text"))
    refs = ref_expand(spark, folder).join(stored, "ref").select("main", "rank", F.coalesce("ref_text", "ref").alias("ref_text"))
    return C.context_blocks(main, refs).select("qid", F.md5("context").alias("digest"), F.char_length("context").alias("n_chars"))


def citations(spark, folder):
    rows = table(spark, folder, "chroma_query_result").where("chunk_id is not null and query_id is not null").select("query_id", "chunk_id").distinct()
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    numbered = rows.withColumn("i", F.row_number().over(order))
    c = F.col("chunk_id")
    return numbered.select("query_id", "chunk_id", C.citation(F.col("i"), P.document_of(c), P.section(c, "dieu"), P.section(c, "khoan"), P.section(c, "diem")).alias("line"))


def cross_branch_dedup(spark, folder):
    rows = table(spark, folder, "chroma_query_result").where("chunk_id is not null").select(F.lit(0).alias("qid"), "chunk_id", "result_id").distinct()
    return C.first_by_chunk(rows, [F.col("result_id")]).select("chunk_id", "result_id")


def _search_texts(spark, folder):
    """A search by meaning that needs no model: cosine of hashed words, over every node's text."""
    nodes = _nodes(spark, folder).where("content is not null").select(F.col("id").alias("chunk_id"), F.col("content").alias("text")).dropDuplicates(["chunk_id"]).withColumn("key", F.xxhash64("chunk_id"))

    def run(asked):
        encode = V.hashing_encoder(64)
        questions = V.embed(asked.withColumn("n", F.xxhash64("qid")), "query", encode, 64)
        near = V.nearest(questions.withColumnRenamed("vector", "qv"), V.embed(nodes, "text", encode, 64), "n", "qv", "key", "vector", 64, k=5)
        return near.join(asked.withColumn("n", F.xxhash64("qid")).withColumnRenamed("qid", "asked"), near["qid"] == F.col("n")).join(nodes, F.col("id") == F.col("key")).select(F.col("asked").alias("qid"), "chunk_id", (1 - F.col("distance")).alias("score"), "text")

    return run


def intent_route_merge(spark, folder):
    """A question of three parts about every record whose id is divisible by 20: what its number's document says, what there is on its title, which documents it is related to; and small talk for a fourth part."""
    meta = table(spark, folder, "document_metadata").where("id % 20 = 0 and ten_van_ban is not null and so_hieu is not null").groupBy("id").agg(F.min("ten_van_ban").alias("question"), F.min("so_hieu").alias("so_hieu"))
    part = lambda query, intent: F.struct(F.col(query).alias("query"), F.lit(intent).alias("intent"))
    made = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(part("so_hieu", "legal_query"), part("question", "general"), part("so_hieu", "doc_relation"), part("question", "chitchat")).alias("sub_questions"))), F.lit("\n```"))
    subs = settled(A.analysed(meta.select(F.col("id").alias("qid"), "question", made.alias("answer")), F.col("answer")))
    documents = table(spark, folder, "document_metadata").select("so_hieu", "ten_van_ban").distinct()
    nodes = _nodes(spark, folder).where("content is not null").select("so_hieu", F.col("id").alias("chunk_id"), F.col("content").alias("text")).dropDuplicates(["chunk_id"])
    relations = table(spark, folder, "document_relation").select("entity_start", "entity_end", "relation_type").distinct()
    branches = {"legal_query": A.legal_branch(nodes, documents), "general": A.general_branch(_search_texts(spark, folder)), "doc_relation": A.relation_branch(documents, relations)}
    contexts = A.merged(subs, A.routed(subs, branches))
    return A.answered(contexts).select("qid", F.md5("answer").alias("digest"), F.char_length("answer").alias("n_chars"))


def section_search(spark, folder):
    """V6: nearest chunks of one section type."""
    return _near(spark, folder, k=3, where={"kind": "dieu"})


_NAMES = (
    "clean_text html_to_text normalize_titles strip_diacritics slug_id to_roman number_words fuzzy_name_match answer_letter json_props json_recovered document_heads article_counts heading_parse structure_tree parent_context dup_suffix "
    "fixed_chunks recursive_chunks word_window_split chunk_type_histogram embedding_texts length_guard ref_candidates ref_extract nearest_law ref_ranges ref_expand reference_lists context_blocks citations cross_branch_dedup intent_route_merge section_search"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_N = "WITH n AS (SELECT DISTINCT id, content FROM document_node WHERE content IS NOT NULL) "
_HEADING = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in S.HEADINGS) + " END"
_HEADING_ID = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN " + (f"lower(regexp_extract(line, '{p}', 1))" if "(" in p.replace("(?", "") else "''") for k, p in S.HEADINGS) + " END"


# The steps of T1 one by one, as SQL replaces them.
_CLEANING = (
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"<!--[\s\S]*?-->", ""), (r"(?m)^#+\s+", ""), (r"(?m)^[ \t]*[-*+][ \t]+(\d)", "$1"), (r"(?m)^[ \t]*>[ \t]*", ""), (r"(?m)^[ \t]*\|?[-: |]+\|?[ \t]*$", ""), (r"\|", ""),
    (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"__(.*?)__", "$1"), (r"_(.*?)_", "$1"), (r"<[^>]+>", ""), ("\u00a0", " "), (r"\\([\[\]<>.\-])", "$1"),
    (r"\s+,", ","), (r"\s+\.", "."), (r",\.", "."), (r"[ \t]+", " "), (r"\n[ \t]*\n+", "\n\n"), (r"^\s+|\s+$", ""),
)


def _cleaned(column: str) -> str:
    out = column
    for pattern, by in _CLEANING:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern, by.replace("$1", "\\1"))
    return out


_HTML = r"regexp_replace(regexp_replace(regexp_replace(content_html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?i)<br\b[^>]*>|</(?:tr|td|p|div)\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_by}')"
_HTML = f"array_to_string(list_filter([trim(regexp_replace(x, '[ \\t\u00a0]+', ' ', 'g'), ' ') FOR x IN string_split({_HTML}, chr(10))], lambda x: x <> ''), chr(10))"
_UP = "(SELECT id, upper(a) AS u FROM (VALUES " + ", ".join("({}, {})".format(i, "NULL" if a is None else "'" + a + "'") for i, a in ANSWERS) + ") v(id, a))"
_LETTERS = f"""SELECT id, coalesce(nullif(regexp_extract(u, '(?m)^\\s*([A-D])[.)]?\\s*$', 1), ''), nullif(regexp_extract(left(u, 10), '([A-D])', 1), ''), CASE WHEN left(trim(u), 1) IN ('A', 'B', 'C', 'D') THEN left(trim(u), 1) END, '') AS line,
coalesce(nullif(regexp_extract(u, '\\b([A-D])\\b', 1), ''), '') AS word,
coalesce(nullif(regexp_extract(u, '(?s)<OUTPUT>\\s*([A-D])\\b', 1), ''), nullif(regexp_extract(u, '(?:ĐÁP ÁN|TRẢ LỜI|ANSWER)[^A-D]{{0,20}}\\b([A-D])\\b', 1), ''), nullif(regexp_extract(u, '[\\[(]([A-D])[\\])]', 1), ''), nullif(regexp_extract(right(u, 50), '\\b([A-D])\\b', 1), ''), '') AS tagged FROM {_UP}"""
_LINES = "list_filter([upper(trim(x, ' ')) FOR x IN string_split(left(text, 3000), chr(10))], lambda x: x <> '' AND length(x) <= 50)"
_KIND = "coalesce((list_filter([CASE " + " ".join(f"WHEN regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_])" + w.replace(" ", "\\s+") + f"([^\\p{{L}}\\p{{N}}_]|$)') THEN '{c}'" for w, c in M.KINDS) + f" END FOR x IN {_LINES}], lambda c: c IS NOT NULL))[1], 'unknown')"

_AT = "unnest(list_transform(range(1, len(string_split(c, '{0}'))), lambda k: length(array_to_string(string_split(c, '{0}')[1:k], '{0}'))))"
SQL = {
    "nearest_law": f"WITH n AS (SELECT DISTINCT id, lower(content) AS c FROM (SELECT DISTINCT id, content FROM document_node WHERE content IS NOT NULL)), a AS (SELECT DISTINCT id, {_AT.format('điều ')} AS pos FROM n), p AS (SELECT DISTINCT id, {_AT.format('luật')} AS place FROM n) SELECT a.id, pos::INT AS pos, arg_min(place, abs(place - pos) * 2 + CASE WHEN place > pos THEN 1 ELSE 0 END)::INT AS nearest FROM a LEFT JOIN p USING (id) GROUP BY a.id, pos",
    "normalize_titles": r"SELECT id, trim(regexp_replace(lower(ten_van_ban), '[^\p{L}\p{N}]+', ' ', 'g')) AS normal FROM (SELECT DISTINCT id, ten_van_ban FROM document_metadata)",
    "json_props": "SELECT (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1",
    "to_roman": "WITH n AS (SELECT DISTINCT regexp_extract(id, '\\.chuong_([^.]+)$', 1) AS n FROM document_node), v AS (SELECT n, try_cast(n AS INT) AS k FROM n WHERE n <> '') SELECT n, CASE WHEN k BETWEEN 1 AND 3999 THEN ['','m','mm','mmm'][k // 1000 + 1] || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][k // 100 % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][k // 10 % 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][k % 10 + 1] ELSE lower(n) END AS roman FROM v",
    "heading_parse": f"SELECT id, {_HEADING} AS kind, {_HEADING_ID} AS idx FROM (SELECT DISTINCT id, trim(title) AS line FROM document_node WHERE title IS NOT NULL)",
    "dup_suffix": "WITH i AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) SELECT CASE WHEN c > 1 THEN 'repeated' ELSE 'single' END AS kind, sum(c)::BIGINT AS n, sum(c)::BIGINT AS n_ids FROM i GROUP BY 1",
    "fixed_chunks": "WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 1000)) AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, (s // 1000)::INT AS number, substring(text, s + 1, 1200) AS piece FROM s) SELECT doc_id, number, length(piece)::INT AS n_chars FROM p WHERE trim(piece, ' ') <> ''",
    "chunk_type_histogram": "SELECT type, count(*) AS n FROM (SELECT DISTINCT id, type FROM document_node) GROUP BY type",
    "ref_ranges": "SELECT * FROM (VALUES (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8)) v(id, article)",
    "reference_lists": "WITH r AS (SELECT DISTINCT id, trim(ref) AS ref FROM (SELECT id, unnest(reference) AS ref FROM document_node) WHERE ref IS NOT NULL AND trim(ref) <> '') SELECT id, ref, regexp_matches(lower(ref), '^[a-z0-9đ_.\\-]+$') AND regexp_matches(ref, '[0-9]') AND NOT contains(lower(ref), 'none') AS valid FROM r",
    "cross_branch_dedup": "SELECT chunk_id, min(result_id) AS result_id FROM chroma_query_result WHERE chunk_id IS NOT NULL GROUP BY chunk_id",
    "number_words": "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{n}')" for w, n in (*X.NUMBER_WORDS.items(), ("Mười  Một", "11"), ("IV", "4"), ("x", "10"), ("xi", "xi"), ("abc", "abc"))) + ") v(word, number)",
    "answer_letter": _LETTERS,
    "clean_text": f"SELECT id, {_cleaned('content_html')} AS text FROM (SELECT DISTINCT * FROM document_content WHERE content_html IS NOT NULL)",
    "html_to_text": f"SELECT id, {_HTML} AS text FROM (SELECT DISTINCT * FROM document_content WHERE content_html IS NOT NULL)",
    "slug_id": r"SELECT raw, regexp_replace(lower(regexp_replace(regexp_replace(raw, '\s+', '', 'g'), '[^a-zA-Z0-9đĐ\-]+', '_', 'g')), '^_+|_+$', '', 'g') AS slug, nullif(regexp_replace(regexp_replace(translate(lower(strip_accents(raw)), 'đ', 'd'), '[^a-z0-9\-]+', '_', 'g'), '^[_\-]+|[_\-]+$', '', 'g'), '') AS ascii_id FROM (SELECT DISTINCT raw FROM (SELECT entity_start AS raw FROM document_relation UNION ALL SELECT entity_end FROM document_relation) WHERE raw IS NOT NULL)",
    "citations": "WITH r AS (SELECT DISTINCT query_id, chunk_id FROM chroma_query_result WHERE chunk_id IS NOT NULL AND query_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS i FROM r), s AS (SELECT *, regexp_extract(chunk_id, '\\.dieu_([^.]+)', 1) AS d, regexp_extract(chunk_id, '\\.khoan_([^.]+)', 1) AS k, regexp_extract(chunk_id, '\\.diem_([^.]+)', 1) AS p FROM n), t AS (SELECT *, concat_ws(', ', CASE WHEN d <> '' THEN 'Điều ' || replace(d, '_', '.') END, CASE WHEN k <> '' THEN 'Khoản ' || replace(k, '_', '.') END, CASE WHEN p <> '' THEN 'Điểm ' || replace(p, '_', '.') END) AS tail FROM s) SELECT query_id, chunk_id, '[' || i || '] ' || split_part(chunk_id, '.', 1) || CASE WHEN tail <> '' THEN ' - ' || tail ELSE '' END AS line FROM t",
    "article_counts": "SELECT doc_id, len(regexp_extract_all(text, '(?m)^\\s*Điều\\s+\\d+[a-zA-Z]?\\.'))::INT AS so_dieu, " + _KIND + " AS loai FROM documents WHERE text IS NOT NULL",
    "word_window_split": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, ws, CASE WHEN len(ws) > 500 THEN range(0, greatest(len(ws) - 50, 1), 400) ELSE [0] END AS ss FROM w) SELECT doc_id, unnest(range(len(ss)))::INT AS number, unnest(list_transform(ss, lambda x: CASE WHEN len(ws) > 500 THEN least(450, len(ws) - x) ELSE len(ws) END))::INT AS n_words FROM s",
}

_BLANK = "[ \\t\\n\\x0B\\f\\r]+"
_REFS = """WITH n AS (SELECT id, any_value(reference) AS r FROM document_node GROUP BY id), e AS (SELECT id AS main, trim(unnest(r), ' ') AS ref, unnest(range(len(r))) AS p FROM n WHERE len(r) > 0),
o AS (SELECT main, ref, row_number() OVER (PARTITION BY main ORDER BY min(p)) - 1 AS pos FROM e WHERE ref IS NOT NULL AND ref <> '' GROUP BY main, ref),
k AS (SELECT * FROM o JOIN n ON n.id = o.ref WHERE NOT (main = ref OR starts_with(ref, main || '.') OR starts_with(main, ref || '.'))),
s AS (SELECT main, ref, pos, CASE WHEN split_part(main, '.', 1) = split_part(ref, '.', 1) THEN 8.0 ELSE 6.0 END::DOUBLE - pos * 0.5 AS score FROM k),
x AS (SELECT main, ref, score, row_number() OVER (PARTITION BY main ORDER BY score DESC, pos, ref)::INT AS rank FROM s WHERE score >= 6.0 QUALIFY rank <= 3)"""
SQL |= {
    "length_guard": f"WITH c AS (SELECT DISTINCT id, content FROM document_node WHERE content IS NOT NULL), w AS (SELECT split_part(id, '.', 1) AS doc, id, len(regexp_split_to_array(trim(content, ' '), '{_BLANK}'))::INT AS n_words FROM c) SELECT doc, id, n_words, count(*) OVER (PARTITION BY doc) AS n_long FROM w WHERE n_words > 256",
    "ref_expand": _REFS + " SELECT * FROM x",
    "ref_candidates": "WITH c AS (SELECT DISTINCT id, content FROM document_node WHERE content IS NOT NULL), s AS (SELECT id, list_filter([trim(x, ' ') FOR x IN string_split(regexp_replace(content, '([.!?;])" + _BLANK + "', '\\1' || chr(1), 'g'), chr(1))], lambda x: x <> '') AS ss FROM c) SELECT id, len(ss)::INT AS n_sentences, len(list_filter(ss, lambda x: regexp_matches(x, '" + N.CANDIDATE.replace("(?iu)", "(?i)") + "')))::INT AS n_candidates FROM s",
    "context_blocks": _REFS + """, t AS (SELECT id AS ref, min(full_text) AS full_text FROM document_node GROUP BY id), b AS (SELECT main, string_agg('  > ' || coalesce(full_text, ref), chr(10) ORDER BY rank, coalesce(full_text, ref)) AS below FROM x JOIN t USING (ref) GROUP BY main),
f AS (SELECT DISTINCT query_id AS qid, result_id, chunk_id AS main, text, distance FROM chroma_query_result WHERE distance IS NOT NULL AND text IS NOT NULL), m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, result_id) AS rank FROM f),
c AS (SELECT qid, string_agg(concat_ws(chr(10), text, below), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM m LEFT JOIN b USING (main) GROUP BY qid) SELECT qid, md5(context) AS digest, length(context)::INT AS n_chars FROM c""",
    "parent_context": """WITH RECURSIVE n AS (SELECT id, min(parent_id) AS parent, min(title) AS title FROM document_node WHERE id IS NOT NULL GROUP BY id),
up AS (SELECT n.id, n.parent AS above, 1 AS k FROM n JOIN n p ON p.id = n.parent UNION ALL SELECT up.id, n.parent, k + 1 FROM up JOIN n ON n.id = up.above JOIN n p ON p.id = n.parent WHERE k < 2000),
looped AS (SELECT DISTINCT id FROM up WHERE k >= 2000), a AS (SELECT up.id, k, n.title FROM up JOIN n ON n.id = up.above WHERE up.id NOT IN (SELECT id FROM looped) AND n.title IS NOT NULL AND n.title <> '')
SELECT id, string_agg(title, chr(10) ORDER BY k DESC) AS context FROM a GROUP BY id""",
}
