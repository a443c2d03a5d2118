"""Sources (S1-S12, S23, S25).  Paths may be folders or globs; schemas are given, never inferred from whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.relations import folder_type

KNOWN_SUFFIXES = ("txt", "html", "htm", "md")
BINARY_SUFFIXES = ("pdf", "docx", "doc")


def _first(fields: tuple[str, ...]) -> Column:
    """The first of several JSON fields that is there and not blank."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object("value", f"$.{f}")), F.lit("")) for f in fields))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``, a line each; blank lines are skipped."""
    return spark.read.text(path).where(F.trim("value") != "")


def corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``doc_id, title, content``; ids and contents under either of their names.  ``strict`` fails on a row without an id or without text."""
    doc_id = _first(("_id", "doc_id"))
    if strict:
        doc_id = F.coalesce(doc_id, F.raise_error(F.concat(F.lit("a corpus row has no id: "), F.left("value", F.lit(80)))).cast("string"))
    content = _first(("text", "content"))
    if strict:
        content = F.coalesce(content, F.raise_error(F.concat(F.lit("a corpus row has no text: "), F.left("value", F.lit(80)))).cast("string"))
    return json_lines(spark, path).select(doc_id.alias("doc_id"), _first(("title",)).alias("title"), content.alias("content"))


def tokenized_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S3: ``doc_id, tokens`` without blank tokens."""
    tokens = F.from_json(F.get_json_object("value", "$.tokens"), "array<string>")
    return json_lines(spark, path).select(_first(("doc_id", "id", "_id")).alias("doc_id"), F.filter(tokens, lambda t: F.trim(t) != "").alias("tokens"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """``qid, text, tokens``; either of the last two may be null."""
    return json_lines(spark, path).select(_first(("qid", "query-id", "id", "_id")).alias("qid"), _first(("text",)).alias("text"), F.from_json(F.get_json_object("value", "$.tokens"), "array<string>").alias("tokens")).where("qid is not null")


def qrels(spark: SparkSession, paths: str | list[str], asked: DataFrame | None = None) -> DataFrame:
    """Distinct ``qid, doc_id`` of all files, with the queries' text where they are given (``''`` if unknown)."""
    rows = spark.read.text(paths).where(F.trim("value") != "").select(_first(("query-id", "qid", "_id")).alias("qid"), _first(("corpus-id", "corpus_id", "corpusId", "doc_id")).alias("doc_id"))
    rows = rows.where("qid is not null and doc_id is not null").distinct()
    return rows if asked is None else rows.join(asked.select("qid", "text"), "qid", "left").withColumn("text", F.coalesce("text", F.lit("")))


def share(rows: DataFrame, key: str, parts: int, part: int) -> DataFrame:
    """One of ``parts`` even, repeatable shares of a table, by a hash of the key."""
    if not 0 <= part < parts:
        raise ValueError("part must be from 0 to parts - 1")
    return rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def resumed(rows: DataFrame, key: str, after=None, limit: int | None = None) -> DataFrame:
    """Rows in the order of a key, from behind the last one that was done, ``limit`` of them; the condition reaches the scan."""
    rows = rows if after is None else rows.where(F.col(key) > after)
    return rows.orderBy(key) if limit is None else rows.orderBy(key).limit(limit)


def counted_names(spark: SparkSession, path: str) -> DataFrame:
    """``name, n`` of a CSV file with a header; names trimmed and in lower case, rows with bad counts skipped."""
    rows = spark.read.csv(path, header=True, schema="name string, n string")
    return rows.select(F.lower(F.trim("name")).alias("name"), F.expr("try_cast(trim(n) as long)").alias("n")).where("n is not null and name <> ''")


def files(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """``path, folder, kind, text, error`` of all files below a folder.

    Text formats are decoded; others need ``extract``, a function from the content column to text (a pandas UDF around an external program), else they and
    unknown suffixes come out with an error.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    text = F.when(suffix.isin(*KNOWN_SUFFIXES), F.decode("content", "UTF-8"))
    error = F.when(suffix.isin(*KNOWN_SUFFIXES), None)
    if extract is not None:
        text, error = text.when(suffix.isin(*BINARY_SUFFIXES), extract(F.col("content"))), error.when(suffix.isin(*BINARY_SUFFIXES), None)
    return rows.select("path", folder.alias("folder"), folder_type(folder).alias("kind"), text.alias("text"), error.otherwise(F.concat(F.lit("no reader for ."), suffix)).alias("error"))


def failures(rows: DataFrame) -> DataFrame:
    """What failed and why."""
    return rows.where("error is not null").select("path", "error", F.current_timestamp().alias("at"))


def only_judged(documents: DataFrame, judged: DataFrame) -> DataFrame:
    """Documents that a qrel names."""
    return documents.join(judged.select("doc_id").distinct(), "doc_id", "left_semi")
