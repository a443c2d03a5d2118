"""Problem 9: mixing sources to target shares of all tokens.

Tokens are summed by source; the largest mixture in which every source that has documents keeps its share of the rest's targets without using a record more often
than allowed gives each source a repetition rate.  Each record is then emitted as often as the rate's whole part says, and once more with
the probability of its fraction, decided by a hash of seed and id, so a rerun or a lost task decides the same.

Defined results: sources are compared in lower case, trimmed, with blanks and hyphens as ``_``; records of a null or unlisted source aren't used; a listed source
without tokens gets nothing and its share is spread over the others in proportion, which the report shows; a record is never used more than
``max_repeats`` times; a repeated id counts as often as it occurs; null or empty texts have no tokens and are emitted like the others of their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.packing import TOKENIZERS, VOCABULARY, token_counts
from docweave.runtime import settled

SEED = 20240229


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(source, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"(?U)[\s\-]+", "_"))


def repetition_rates(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Source -> how often its records are used on average.  ``targets``: source -> (share, most repeats)."""
    live = {s: t for s, t in targets.items() if totals.get(s) and t[0] > 0 and t[1] > 0}
    share = sum(t[0] for t in live.values())
    if not live:
        return {}
    size = min(most * totals[s] * share / part for s, (part, most) in live.items())
    return {s: min(float(most), part / share * size / totals[s]) for s, (part, most) in live.items()}


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(``id, source, copy_no, n_tokens`` of each use, a report per source).  The list of targets is small by its nature; only its sources' sums are collected."""
    spark = documents.sparkSession
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in wanted.collect()}
    keyed = documents.select("doc_id", "text", source_key(F.col("source")).alias("source")).where(F.col("source").isin(list(goal)))
    sized = settled(token_counts(keyed, "doc_id", "text", ("source",), folder, vocabulary))
    sums = {r["source"]: (int(r["tokens"] or 0), int(r["records"])) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records")).collect()}
    rates = repetition_rates({s: t for s, (t, _) in sums.items()}, goal)
    rate = F.coalesce(*[F.when(F.col("source") == s, F.lit(r)) for s, r in rates.items()], F.lit(0.0)) if rates else F.lit(0.0)
    chance = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # a rate within rounding of a whole number has no fraction
    whole = F.floor(rate + 1e-9)
    copies = (whole + F.when(chance < rate - whole, 1).otherwise(0)).cast("int")
    uses = sized.withColumn("copies", copies).where("copies > 0").select("id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
    used = sized.withColumn("copies", copies).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    rows = [(s, p, m, *sums.get(s, (0, 0)), rates.get(s, 0.0)) for s, (p, m) in goal.items()]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, source_tokens long, n_records long, rate double")
    total = used.agg(F.sum("used_tokens").alias("all_tokens"))
    report = plan.join(used, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "n_records", "source_tokens", F.round("rate", 9).alias("rate"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.round(F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)), 9).alias("reached_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return uses, report
