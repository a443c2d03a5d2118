"""Question answering as one plan (A1-A8): questions -> sub-questions -> a branch per intent -> merged context -> answers.

Models are plugged in as functions from columns to a column (a pandas UDF, or any expression); each has a default that needs no model.  Every sub-question keeps
its own context; nothing is looped over or collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import fenced_json, terms
from docweave.operators.citations import citation, first_by_chunk
from docweave.operators.relations import find_documents, relation_report

# The intents, and the one a question has whose analysis fails.
INTENTS = ("legal_query", "general", "doc_relation", "chitchat")
FALLBACK = "chitchat"
NOTHING = "Không tìm thấy thông tin phù hợp."
SUB_QUESTIONS = "sub_questions array<struct<query:string, intent:string>>"


def analysed(questions: DataFrame, answer: Column) -> DataFrame:
    """A1: ``qid, sub, query, intent`` from a model's JSON; an answer that can't be read, or holds no known intent, is one sub-question: the question itself."""
    parsed = F.from_json(fenced_json(answer), SUB_QUESTIONS)["sub_questions"]
    good = F.filter(parsed, lambda s: s["query"].isNotNull() & (F.trim(s["query"]) != "") & s["intent"].isin(*INTENTS))
    own = F.array(F.struct(F.col("question").alias("query"), F.lit(FALLBACK).alias("intent")))
    some = F.when(F.size(F.coalesce(good, F.array().cast("array<struct<query:string,intent:string>>"))) > 0, good).otherwise(own)
    return questions.select("qid", F.posexplode(some).alias("sub", "s")).select("qid", "sub", F.col("s.query").alias("query"), F.col("s.intent").alias("intent"))


def routed(subs: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each intent's rows through its branch (``qid, sub, chunk_id, score, text``); intents without a branch get the fallback message."""
    columns = ["qid", "sub", "chunk_id", "score", "text"]
    out = None
    for intent, branch in branches.items():
        part = branch(subs.where(F.col("intent") == intent)).select(*columns).withColumn("intent", F.lit(intent))
        out = part if out is None else out.unionByName(part)
    rest = subs.where(~F.col("intent").isin(*branches)) if branches else subs
    told = rest.select("qid", "sub", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(NOTHING).alias("text"), "intent")
    return told if out is None else out.unionByName(told)


# ---- branches ------------------------------------------------------------------------------------------------------------------------


def legal_branch(nodes: DataFrame, documents: DataFrame, most: int = 5, least: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """A3: sections of the document a sub-question is about: by the number it holds, else by the likest name; those of the section it asks for, else the ones that share most of its words.

    ``nodes(chunk_id, so_hieu, text)``, ``documents(so_hieu, ten_van_ban)``.  All nodes of a document are scored before the best are taken.
    """

    def run(subs: DataFrame) -> DataFrame:
        number = F.nullif(F.regexp_extract("query", r"(?iU)\b(\d+[/_][\w/_\-]+)", 1), F.lit(""))
        asked = subs.select(F.concat_ws("/", "qid", "sub").alias("qid"), number.alias("number"), F.when(number.isNull(), F.col("query")).alias("name"))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "so_hieu")
        about = find_documents(documents, asked, least, 1).withColumn("p", F.row_number().over(best)).where("p = 1").select("qid", "so_hieu")
        questions = subs.withColumn("key", F.concat_ws("/", "qid", "sub")).join(about.withColumnRenamed("qid", "key"), "key")
        wanted = F.nullif(F.regexp_extract(F.lower("query"), r"(?U)\bđiều\s+(\d+\w*)", 1), F.lit(""))
        words = questions.select("qid", "sub", "so_hieu", wanted.alias("article"), F.array_distinct(terms(F.col("query"))).alias("words"))
        met = words.join(nodes, "so_hieu").where(F.col("article").isNull() | F.rlike("chunk_id", F.concat(F.lit(r"(?:^|\.)dieu_"), F.col("article"), F.lit(r"(?:__dup_\d+)?(?:\.|$)"))))
        scored = met.select("qid", "sub", "chunk_id", F.size(F.array_intersect("words", terms(F.col("text")))).cast("double").alias("score"), "text")
        place = Window.partitionBy("qid", "sub").orderBy(F.desc("score"), "chunk_id")
        return scored.withColumn("p", F.row_number().over(place)).where(F.col("p") <= most).drop("p")

    return run


def general_branch(search: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A4: what a search by meaning finds; ``search`` takes ``qid, query`` (qid a string) and gives ``qid, chunk_id, score, text``."""

    def run(subs: DataFrame) -> DataFrame:
        keyed = subs.withColumn("key", F.concat_ws("/", "qid", "sub"))
        found = search(keyed.select(F.col("key").alias("qid"), "query")).withColumnRenamed("qid", "key")
        return keyed.select("key", "qid", "sub").join(found, "key").select("qid", "sub", "chunk_id", "score", "text")

    return run


def relation_branch(documents: DataFrame, relations: DataFrame, most: int = 5, least: float = 0.6) -> Callable[[DataFrame], DataFrame]:
    """A5: the relations of the at most ``most`` documents whose names are likest to the sub-question, or that it names by number; a line of the report is a chunk."""

    def run(subs: DataFrame) -> DataFrame:
        number = F.nullif(F.regexp_extract("query", r"(?iU)\b(\d+[/_][\w/_\-]+)", 1), F.lit(""))
        asked = subs.select(F.concat_ws("/", "qid", "sub").alias("key"), "qid", "sub", number.alias("number"), F.when(number.isNull(), F.col("query")).alias("name"))
        about = find_documents(documents, asked.select(F.col("key").alias("qid"), "number", "name"), least, most).withColumnRenamed("qid", "key")
        lines = relation_report(relations, documents).select(F.col("entity").alias("so_hieu"), "line").distinct()
        told = asked.select("key", "qid", "sub").join(about, "key").join(lines, "so_hieu")
        return told.select("qid", "sub", F.concat("so_hieu", F.lit(" "), "line").alias("chunk_id"), "score", F.col("line").alias("text"))

    return run


def merged(subs: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """Per sub-question its context: its chunks by score, each once; none found gives the fallback message."""
    rows = first_by_chunk(found.where("chunk_id is not null").withColumn("key", F.concat_ws("/", "qid", "sub")), [F.desc("score"), F.col("text")], "key")
    best = rows.groupBy("qid", "sub").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "chunk_id", "text"))), 1, most).alias("chunks"))
    own = found.where("chunk_id is null").groupBy("qid", "sub").agg(F.min("text").alias("told"))
    out = subs.join(best, ["qid", "sub"], "left").join(own, ["qid", "sub"], "left")
    lines = F.transform("chunks", lambda c, i: F.concat(citation(i + 1, F.substring_index(c["chunk_id"], ".", 1)), F.lit("\n"), c["text"]))
    return out.select("qid", "sub", "query", "intent", F.coalesce(F.nullif(F.array_join(lines, "\n---\n"), F.lit("")), "told", F.lit(NOTHING)).alias("context"))


def answered(contexts: DataFrame, generate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """An answer per sub-question by a plugged-in generator (by default the context itself), joined in order per question."""
    text = generate(F.col("query"), F.col("context")) if generate else F.concat(F.col("query"), F.lit("\n"), F.col("context"))
    each = contexts.select("qid", "sub", text.alias("answer"))
    return each.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "answer"))), lambda x: x["answer"]), "\n\n").alias("answer"))
