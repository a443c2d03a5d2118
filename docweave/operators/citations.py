"""Reference lists (R8-R10) and their expansion into context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.paths import is_kin


def normal_list(refs: Column) -> Column:
    """Distinct non-blank ids in order."""
    return F.array_distinct(F.filter(F.transform(refs, lambda r: F.trim(r)), lambda r: r.isNotNull() & (r != "")))


def valid_id(ref: Column) -> Column:
    """An id of a document or one of its sections, not only words."""
    return F.rlike(F.lower(ref), F.lit(r"^[a-z0-9đ_.\-]+$")) & F.rlike(ref, F.lit(r"[0-9]")) & ~F.contains(F.lower(ref), F.lit("none"))


def structured(answers: Column, least: float = 0.55) -> Column:
    """References in a model's JSON answer: valid ids of enough confidence, each once, in order."""
    parsed = F.from_json(answers, "references array<struct<ref_id:string, confidence:double>>")
    good = F.filter(parsed["references"], lambda r: (F.coalesce(r["confidence"], F.lit(1.0)) >= least) & valid_id(r["ref_id"]))
    return F.array_distinct(F.transform(good, lambda r: F.lower(F.trim(r["ref_id"]))))


# ---- expansion -----------------------------------------------------------------------------------------------------------------------


def stored_references(main: DataFrame, store: DataFrame, key: str = "id", refs: str = "reference") -> DataFrame:
    """``main, pos, ref``: the listed ids that are stored, without kin (ancestors and descendants), in the list's order."""
    each = main.select(F.col(key).alias("main"), F.posexplode(normal_list(F.col(refs))).alias("pos", "ref"))
    return each.where(~is_kin(F.col("main"), F.col("ref"))).join(store.select(F.col(key).alias("ref")).distinct(), "ref").select("main", "pos", "ref")


def chosen_references(scored: DataFrame, least: float = 6.0, most: int = 3) -> DataFrame:
    """Of each main chunk the best-scored references, in descending score; unscored ones aren't taken."""
    order = Window.partitionBy("main").orderBy(F.desc("score"), "pos", "ref")
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def relevant(chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Chunks judged relevant; a question none of whose chunks was judged keeps all, else an unjudged chunk is dropped."""
    given = verdicts.select("qid", "chunk_id", "relevant").dropDuplicates(["qid", "chunk_id"])
    judged = given.select("qid").distinct().withColumn("__judged", F.lit(True))
    rows = chunks.join(given, ["qid", "chunk_id"], "left").join(judged, "qid", "left")
    return rows.where(F.col("__judged").isNull() | F.coalesce("relevant", F.lit(False))).select(*chunks.columns)


def first_by_chunk(rows: DataFrame, order: list[Column], group: str = "qid") -> DataFrame:
    """The first of equal chunks within a question."""
    place = Window.partitionBy(group, "chunk_id").orderBy(*order)
    return rows.withColumn("__p", F.row_number().over(place)).where("__p = 1").drop("__p")


def context_blocks(main: DataFrame, refs: DataFrame, rule: str = "\n---\n") -> DataFrame:
    """E5: per question one text: main chunks by rank, their references indented below.  ``main(qid, rank, main, text)``, ``refs(main, rank, ref_text)``."""
    below = refs.groupBy("main").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref_text"))), lambda r: F.concat(F.lit("  > "), r["ref_text"])), "\n").alias("below"))
    block = main.join(below, "main", "left").select("qid", "rank", F.concat_ws("\n", "text", "below").alias("block"))
    return block.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), rule).alias("context"))


def citation(number: Column, so_hieu: Column, *labels: Column) -> Column:
    """``[i] so_hieu - Điều 1, Khoản 2``."""
    tail = F.concat_ws(", ", *labels)
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), so_hieu, F.when(tail != "", F.concat(F.lit(" - "), tail)).otherwise(F.lit("")))


def prompt(template: str, question: Column, context: Column, missing: str = "") -> Column:
    """A template with ``{query}`` and ``{context}`` filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{query}"), F.coalesce(question, F.lit(missing))), F.lit("{context}"), F.coalesce(context, F.lit(missing)))
