"""Document metadata and the relation graph."""

from __future__ import annotations

import heapq
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import number_slug, strip_marks
from docweave.operators.likeness import Names
from docweave.operators.metadata import number as number_of_query
from docweave.operators.vector import upsert
from docweave.runtime import settled

#: Names and asked texts that meet in one task of a likeness search at most.
NAMES_A_TASK, TEXTS_A_TASK = 200_000, 2000
#: Names that set the last place of an asked text, and those that are compared with it at once after that.
FIRST_NAMES, NAMES_A_STEP = 64, 2048
#: What bounds give way by, as scores are rounded to 6 places.
SLACK = 1e-6
#: Characters of the pieces by which a search within names finds its candidates.
GRAM = 6

# Relation types, folder types in the order they are tried, and the relation a folder's documents have to a law.
RELATION_TYPES = ("huong_dan_thi_hanh", "sua_doi_bo_sung", "thay_the", "bai_bo", "dinh_chi_hieu_luc", "tam_thoi_ap_dung", "giai_thich", "lien_quan", "tham_chieu", "can_cu")
FOLDER_TYPES = ("luat", "nghi_dinh", "nghi_quyet", "thong_tu", "sua_doi_bo_sung", "thay_the", "bai_bo", "dinh_chi_hieu_luc")
RELATION_OF_FOLDER = {
    "sua_doi_bo_sung": "sua_doi_bo_sung", "thay_the": "thay_the", "bai_bo": "bai_bo", "dinh_chi_hieu_luc": "dinh_chi_hieu_luc",
    "nghi_dinh": "huong_dan_thi_hanh", "nghi_quyet": "huong_dan_thi_hanh", "thong_tu": "huong_dan_thi_hanh",
}
# Which issuing bodies are kept and which are left out (compared in lower case).
KEPT_BODIES = (
    "ngân hàng nhà nước", "ngân hàng nhà nước việt nam", "kiểm toán nhà nước", "ủy ban dân tộc", "uỷ ban dân tộc", "chính phủ", "thủ tướng chính phủ", "quốc hội",
    "uỷ ban thường vụ quốc hội", "ủy ban thường vụ quốc hội", "chủ tịch nước", "tòa án nhân dân tối cao", "toà án nhân dân tối cao", "viện kiểm sát nhân dân tối cao",
)
KEPT_PREFIXES = ("bộ ", "uỷ ban nhân dân", "ủy ban nhân dân", "hội đồng nhân dân", "hội đồng bộ trưởng", "hội đồng chính phủ", "hội đồng nhà nước", "chủ tịch hội đồng bộ trưởng")
# What else is left out, as (test, text, what is kept all the same as (test, texts)).
DROPPED = (
    ("starts", "ban ", None), ("starts", "cục ", None), ("starts", "tổng cục ", None), ("starts", "chi cục ", None), ("starts", "sở ", None), ("starts", "văn phòng ", None),
    ("holds", "mặt trận", None), ("holds", "đoàn", None), ("holds", "hội", ("holds", ("hội đồng nhân dân", "quốc hội"))), ("starts", "ngân hàng ", ("is", ("ngân hàng nhà nước", "ngân hàng nhà nước việt nam"))),
    ("holds", "triều tiên", None), ("holds", "cộng hoà xã hội chủ nghĩa việt nam", None),
)
_TESTS = {"starts": F.startswith, "holds": F.contains, "is": lambda value, text: value == text}


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def save_documents(stored: DataFrame, changes: DataFrame, newest: list[Column]) -> DataFrame:
    """Insert or replace by so_hieu; the last of several changes wins."""
    return upsert(stored, changes, "so_hieu", newest)


def find_by_number(documents: DataFrame, number: str) -> DataFrame:
    """Point lookup by the key form of a number, however it is written."""
    return documents.where(F.col("so_hieu") == number_slug(F.lit(number)))


def search_name(documents: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """D3: documents whose name holds the asked text, whatever the case: ``qid, so_hieu``, the first by key.

    Case folding makes the ladder of spellings a single step.  A name that holds a text holds its pieces of GRAM characters, so the two are joined on the text's rarest
    piece and then compared; texts shorter than that meet all names.
    """
    texts = asked.where("name is not null").select("qid", F.lower("name").alias("text"))
    names = settled(documents.where("ten_van_ban is not null").select("so_hieu", F.lower("ten_van_ban").alias("low")).distinct())
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(c) - GRAM + 1), lambda i: F.substr(F.col(c), i, F.lit(GRAM))))
    long = settled(texts.where(F.char_length("text") >= GRAM).select("text").distinct())
    of_text = long.select("text", F.explode(grams("text")).alias("gram"))
    of_name = names.where(F.char_length("low") >= GRAM).select("low").distinct().select("low", F.explode(grams("low")).alias("gram"))
    held = settled(of_name.join(of_text.select("gram").distinct(), "gram", "left_semi"))
    held_by = of_text.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = held_by.groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    met = rarest.join(held, "gram").where(F.contains("low", "text")).select("text", "low")
    short = texts.where(F.char_length("text") < GRAM).select("text").distinct().join(names.select("low").distinct(), F.contains("low", "text")).select("text", "low")
    # of the documents of one text the first are enough, so texts that are asked again and again don't multiply them
    found = met.unionByName(short).join(names, "low").select("text", "so_hieu").distinct()
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("text").orderBy("so_hieu"))).where(F.col("place") <= limit)
    met_by = texts.join(best, "text").select("qid", "so_hieu").distinct()
    order = Window.partitionBy("qid").orderBy("so_hieu")
    return met_by.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def like_field(documents: DataFrame, field: str, part: str, limit: int = 10) -> DataFrame:
    """Active documents whose field holds a text, the first by key."""
    return documents.where(F.contains(F.lower(F.col(field)), F.lit(part.lower()))).orderBy("so_hieu").limit(limit)


def page(documents: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page in the order of the key."""
    return documents.orderBy(key).offset(offset).limit(limit)


def deactivate(documents: DataFrame, chunks: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """trang_thai 0 for the numbers' documents, and for their chunks."""
    off = numbers.select(F.col("so_hieu")).distinct().withColumn("__off", F.lit(True))
    mark = F.when(F.col("__off"), 0).otherwise(F.coalesce("trang_thai", F.lit(1))).cast("int")
    docs = documents.join(off, "so_hieu", "left").withColumn("trang_thai", mark).drop("__off")
    parts = chunks if "trang_thai" in chunks.columns else chunks.withColumn("trang_thai", F.lit(1))
    return docs, parts.join(off, "so_hieu", "left").withColumn("trang_thai", mark).drop("__off")


def save_relations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Add relations whose (start, end, type) isn't stored yet, each once; nulls compare equal."""
    triple = ["entity_start", "entity_end", "relation_type"]
    fresh = new.dropDuplicates(triple).alias("n")
    old = stored.select(*triple).distinct().alias("o")
    same = F.lit(True)
    for c in triple:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return stored.select(*triple).unionByName(fresh.join(old, same, "left_anti").select(*triple))


def delete_triple(stored: DataFrame, start: str | None, end: str | None, kind: str) -> DataFrame:
    return stored.where(~(F.col("entity_start").eqNullSafe(F.lit(start)) & F.col("entity_end").eqNullSafe(F.lit(end)) & F.col("relation_type").eqNullSafe(F.lit(kind))))


def by_entity(relations: DataFrame) -> DataFrame:
    """Each relation from both ends: ``entity, direction, other, relation_type``."""
    out = relations.select(F.col("entity_start").alias("entity"), F.lit("out").alias("direction"), F.col("entity_end").alias("other"), "relation_type")
    into = relations.select(F.col("entity_end").alias("entity"), F.lit("in").alias("direction"), F.col("entity_start").alias("other"), "relation_type")
    return out.unionByName(into).where("entity is not null")


def _likest(asked: pd.DataFrame, names: pd.DataFrame, threshold: float, limit: int) -> pd.DataFrame:
    """The ``limit`` documents of the likest names for each asked text.

    Names are taken in the order of their letters' bound, the first few and then all that reach the last place so far, and each part is scored in the order of the
    closer bound by common subsequences until that falls below the last place.
    """
    columns = ["q", "so_hieu", "score"]
    if not len(asked) or not len(names):
        return pd.DataFrame([], columns=columns)
    held = [t or "" for t in names["plain"]]
    table, numbers, rows = Names(held), list(names["numbers"]), []
    for q in asked["q"]:
        found: dict[str, float] = {}
        least = threshold
        loose = table.by_letters(q)

        def compare(part: np.ndarray, least: float, q=q, found=found) -> float:
            close = table.by_subsequence(q, part)
            for k in np.argsort(-close, kind="stable"):
                if close[k] + SLACK < least:
                    break
                j = part[k]
                score = round(SequenceMatcher(None, q, held[j]).ratio(), 6) if q and held[j] else 0.0
                if score >= least:
                    for number in numbers[j]:
                        found[number] = max(score, found.get(number, score))
                    if len(found) >= limit:
                        least = max(least, heapq.nlargest(limit, found.values())[-1])
            return least

        first = np.argpartition(-loose, FIRST_NAMES)[:FIRST_NAMES] if len(held) > FIRST_NAMES else np.arange(len(held))
        least = compare(first[loose[first] + SLACK >= least], least)
        untried = loose + SLACK >= least
        untried[first] = False
        rest = np.flatnonzero(untried)
        rest = rest[np.argsort(-loose[rest], kind="stable")]
        for a in range(0, len(rest), NAMES_A_STEP):
            part = rest[a : a + NAMES_A_STEP]
            least = compare(part[loose[part] + SLACK >= least], least)
        rows += [(q, number, score) for number, score in heapq.nsmallest(limit, found.items(), key=lambda x: (-x[1], x[0]))]
    return pd.DataFrame(rows, columns=columns)


def find_documents(documents: DataFrame, asked: DataFrame, threshold: float = 0.5, limit: int = 10) -> DataFrame:
    """What is asked by number goes by number; by name goes by likeness to all names, each document at its likest name."""
    spark = documents.sparkSession
    by_number = asked.where("number is not null").withColumn("so_hieu", number_slug(F.col("number"))).join(documents, "so_hieu").select("qid", "so_hieu", F.lit(1.0).alias("score")).distinct()
    named = settled(asked.where("number is null and name is not null").select("qid", strip_marks(F.col("name")).alias("q")))
    # documents of names that fold to the same text are equally like: the first of them are enough
    held = documents.where("so_hieu is not null and ten_van_ban is not null").select("so_hieu", strip_marks(F.col("ten_van_ban")).alias("plain")).distinct()
    first = held.withColumn("place", F.row_number().over(Window.partitionBy("plain").orderBy("so_hieu"))).where(F.col("place") <= limit)
    names = settled(first.groupBy("plain").agg(F.collect_list("so_hieu").alias("numbers")))
    texts = named.select("q").distinct()
    # every part of the asked texts meets every part of the names
    n_texts, cores = texts.count(), spark.sparkContext.defaultParallelism
    shards = max(1, -(-names.count() // NAMES_A_TASK))
    parts = max(1, -(-n_texts // TEXTS_A_TASK), min(n_texts, -(-2 * cores // shards)))
    cells = shards * parts
    left = texts.select("q", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")).select("q", (F.pmod(F.xxhash64("q"), F.lit(parts)) * shards + F.col("s")).alias("cell"))
    right = names.select("plain", "numbers", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p")).select("plain", "numbers", (F.col("p") * shards + F.pmod(F.xxhash64("plain"), F.lit(shards))).alias("cell"))
    # more partitions than cells, so that few cells share one
    dealt = lambda rows: rows.repartition(4 * cells, "cell").groupBy("cell")
    near = dealt(left).cogroup(dealt(right)).applyInPandas(lambda a, b: _likest(a, b, threshold, limit), "q string, so_hieu string, score double")
    best = near.groupBy("q", "so_hieu").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "so_hieu")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return by_number.unionByName(named.join(best, "q").select("qid", "so_hieu", "score").distinct())


def relation_report(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """A line per relation end with the other document's name."""
    names = documents.groupBy("so_hieu").agg(F.min("ten_van_ban").alias("other_name"))
    ends = by_entity(relations)
    return ends.join(names, ends["other"] == names["so_hieu"], "left").select("entity", "direction", "relation_type", "other", F.concat_ws(" ", F.when(F.col("direction") == "out", "->").otherwise("<-"), F.concat(F.lit("["), "relation_type", F.lit("]")), "other", F.concat(F.lit("("), "other_name", F.lit(")"))).alias("line"))


def folder_type(name: Column) -> Column:
    """The first folder type that holds or is held by the name; empty names are ``other``."""
    low = F.lower(F.trim(name))
    out = F.when(low == "", "other")
    for kind in FOLDER_TYPES:
        out = out.when(F.contains(low, F.lit(kind)) | F.contains(F.lit(kind), low), kind)
    return out.otherwise("other")


def relation_of(source: Column, target: Column) -> Column:
    """The relation of a folder's documents to laws; null to anything else."""
    return F.when(target == "luat", F.try_element_at(F.create_map(*(F.lit(x) for pair in RELATION_OF_FOLDER.items() for x in pair)), source))


def build_relations(documents: DataFrame) -> DataFrame:
    """Every document of another folder stands in its folder's relation to every law.

    All pairs would grow as the square of the documents, so the relation is kept as its two sides: ``relation_type, side, so_hieu``; each ``start`` of a
    relation type is related to each ``end`` of it.  ``expanded`` gives the pairs of the documents one asks for.
    """
    kind = relation_of(F.col("folder"), F.lit("luat"))
    starts = documents.where("folder <> 'luat'").withColumn("relation_type", kind).where("relation_type is not null").select("relation_type", F.lit("start").alias("side"), "so_hieu")
    laws = documents.where("folder = 'luat'").select("so_hieu")
    ends = laws.select(F.explode(F.array(*map(F.lit, sorted(set(RELATION_OF_FOLDER.values()))))).alias("relation_type"), F.lit("end").alias("side"), "so_hieu")
    return starts.unionByName(ends.join(starts.select("relation_type").distinct(), "relation_type", "left_semi"))


def expanded(sides: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of ``build_relations`` that start at the documents of ``asked(so_hieu)``."""
    starts = sides.where("side = 'start'").join(asked.select("so_hieu").distinct(), "so_hieu").select(F.col("so_hieu").alias("entity_start"), "relation_type")
    return starts.join(sides.where("side = 'end'").select(F.col("so_hieu").alias("entity_end"), "relation_type"), "relation_type")


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each value of a fixed list, 0 where there is none."""
    known = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return known.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def replace_document(documents: DataFrame, chunks: DataFrame, relations: DataFrame, new: DataFrame, replaced: DataFrame, kind: str = "thay_the") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store the new documents, switch off what they replace (for ``thay_the``), add the relations once.  ``replaced(new_so_hieu, so_hieu)``."""
    docs = save_documents(documents, new, [F.desc("created_at")])
    if kind == "thay_the":
        docs, chunks = deactivate(docs, chunks, replaced)
    edges = replaced.select(F.col("new_so_hieu").alias("entity_start"), F.col("so_hieu").alias("entity_end"), F.lit(kind).alias("relation_type"))
    return docs, chunks, save_relations(relations, edges)


def backfilled(rows: DataFrame, column: str, default, kind: str = "int") -> DataFrame:
    """The column, added where it is missing, nulls filled."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(default).cast(kind)) if column in rows.columns else F.lit(default).cast(kind))


def resync(chunks: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """A row per document from its chunks: of each field the first value that says something, in the given order."""
    place = chunks.withColumn("__o", F.struct(*order))
    good = lambda c: F.when(F.col(c).isNotNull() & (F.trim(F.col(c)) != ""), F.struct("__o", F.col(c).alias("v")))
    return place.groupBy(key).agg(*(F.min(good(c)).alias(c) for c in fields)).select(key, *(F.col(f"{c}.v").alias(c) for c in fields))


def kept_bodies(values: DataFrame, column: str, least: int = 20) -> DataFrame:
    """Issuing bodies by how many documents they have, without the bodies that aren't wanted, more than ``least``, most first."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.lower(F.trim(F.col(column))).alias("body")).agg(F.count("*").alias("n"))
    b = F.col("body")
    told = lambda test, texts: _any([_TESTS[test](b, F.lit(t)) for t in texts])
    kept = told("is", KEPT_BODIES) | told("starts", KEPT_PREFIXES)
    noise = _any([told(test, [text]) & (~told(*but) if but else F.lit(True)) for test, text, but in DROPPED])
    return counts.where(kept & ~noise & (F.col("n") > least)).orderBy(F.desc("n"), "body")


def corpus_of(contents: DataFrame, metadata: DataFrame, bodies: list[str]) -> DataFrame:
    """Contents of the documents of the given bodies; the filter reaches the metadata's scan, the join is on the id."""
    wanted = metadata.where(F.lower(F.trim("co_quan_ban_hanh")).isin(*bodies)).select(F.col("id").cast("long").alias("id"), "co_quan_ban_hanh", "so_hieu").dropDuplicates(["id"])
    return contents.where("content_html is not null").join(wanted, "id").select("id", "so_hieu", "co_quan_ban_hanh", "content_html")


# What a listed document shows where a field is empty.
SHOWN = {"so_hieu": "", "ten_van_ban": "Chưa xác định", "loai": "", "co_quan_ban_hanh": "", "ngay_ban_hanh": "", "ngay_co_hieu_luc": ""}


def search_active(documents: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Active documents whose number holds the number in the query or whose name holds the query, whatever the case; none for a blank query."""
    number = F.nullif(number_of_query(F.lit(query)), F.lit(""))
    by_number = F.coalesce(F.contains(F.lower("so_hieu"), F.lower(number)), F.lit(False))
    by_name = F.contains(F.lower("ten_van_ban"), F.lit(query.lower())) if query else F.lit(False)
    return documents.where((F.col("trang_thai") == 1) & (by_number | by_name)).select("so_hieu", "ten_van_ban").distinct().orderBy("so_hieu", "ten_van_ban").limit(limit)


def listed(documents: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    """A page of documents by key, empty fields as SHOWN, a missing state as active."""
    shown = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c) for c, default in SHOWN.items()]
    return page(documents.select(*shown, F.coalesce("trang_thai", F.lit(1)).alias("trang_thai")), "so_hieu", limit, offset)
