"""Problem 6: references to records that don't exist, are deleted, or arrive later.

Keys are range-partitioned over the space of a 64-bit digest, cut into equal ranges, so that ranges are even whatever the keys look like.  Per range
the parents' digests are one sorted array (with their keys, for exactness), and reference batches are probed by binary search.  A range that holds a
hot target is cut into several slots: its references are dealt out over them, its parents are given to each.

Defined results: null and blank keys are no references; a key is compared as the caller normalised it; an empty parent table makes every reference
``missing``; a null time is never later than anything, and a reference without a time has a null period; repeated references of a record count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.runtime import small, tasks_for

#: References a slot takes on average, parents a range takes on average.
REFS_PER_SLOT = 250_000
PARENTS_PER_RANGE = 500_000

RESULT = "source_table string, source_key string, field string, target_key string, state string, period string"


def document_key(raw: Column) -> Column:
    """The key form of an official number: white space dropped, runs of other characters one ``_``, lower case, outer ``_`` dropped."""
    key = F.regexp_replace(raw, r"(?U)\s+", "")
    key = F.lower(F.regexp_replace(key, r"[^a-zA-Z0-9đĐ\-]+", "_"))
    return F.regexp_replace(key, r"^_+|_+$", "")


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by slot, parents first.  Misses and late hits come out."""
    slot, hashes, keys, times, gone = None, [], [], [], []
    index: tuple | None = None
    for batch in batches:
        for s, part in batch.groupby("slot", sort=True):
            if s != slot:
                slot, hashes, keys, times, gone, index = s, [], [], [], [], None
            parents = part[part["is_ref"] == 0]
            if len(parents):
                hashes.append(parents["h"].to_numpy(np.int64))
                keys.append(parents["key"].to_numpy(object))
                times.append(parents["ms"].to_numpy(np.float64))
                gone.append(parents["gone"].to_numpy(bool))
            refs = part[part["is_ref"] == 1]
            if not len(refs):
                continue
            if index is None:
                if hashes:
                    h = np.concatenate(hashes)
                    order = np.argsort(h, kind="stable")
                    index = (h[order], np.concatenate(keys)[order], np.concatenate(times)[order], np.concatenate(gone)[order])
                else:
                    index = (np.empty(0, np.int64), np.empty(0, object), np.empty(0), np.empty(0, bool))
            H, K, T, G = index
            want, key = refs["h"].to_numpy(np.int64), refs["key"].to_numpy(object)
            at = np.searchsorted(H, want, "left")
            found = np.full(len(want), -1)
            live = at < len(H)
            while live.any():
                j = np.flatnonzero(live)
                j = j[H[at[j]] == want[j]]
                same = K[at[j]] == key[j]
                found[j[same]] = at[j[same]]
                live[:] = False
                rest = j[~same]  # another key with the same digest: look at the next place
                at[rest] += 1
                live[rest[at[rest] < len(H)]] = True
            state = np.full(len(want), None, object)
            state[found < 0] = "missing"
            hit = np.flatnonzero(found >= 0)
            state[hit[G[found[hit]]]] = "deleted"
            kept = hit[~G[found[hit]]]
            with np.errstate(invalid="ignore"):
                late = T[found[kept]] > refs["ms"].to_numpy(np.float64)[kept]
            state[kept[late]] = "late"
            out = refs.assign(state=state)
            out = out[out["state"].notna()]
            if len(out):
                yield out[["source_table", "source_key", "field", "key", "state", "period"]].rename(columns={"key": "target_key"})


def orphan_references(parents: DataFrame, references: DataFrame) -> DataFrame:
    """``parents(space, key, time, deleted)`` one row per held key and key space; ``references(space, key, time, source_table, source_key, field)``.

    Gives RESULT, a row per reference whose key is missing, deleted or late.  A key of one space never meets one of another.
    """
    spark = parents.sparkSession
    micros = lambda c: F.when(F.col(c).isNotNull(), F.unix_micros(F.col(c).cast("timestamp")).cast("double"))
    held = parents.select(F.concat_ws("\x01", "space", "key").alias("key"), micros("time").alias("ms"), F.col("deleted").alias("gone"))
    asked = references.select(F.concat_ws("\x01", "space", "key").alias("key"), micros("time").alias("ms"), F.date_format("time", "yyyy-MM").alias("period"), "source_table", "source_key", "field")
    held, asked = (x.withColumn("h", F.xxhash64("key")) for x in (held, asked))
    n_held = held.count()
    ranges = tasks_for(spark, n_held, PARENTS_PER_RANGE)
    # equal cuts of the digest's range: the top 32 bits, scaled
    span = ((F.shiftrightunsigned(F.col("h"), 32) * F.lit(ranges)) / F.lit(2**32)).cast("int")
    loads = asked.select(span.alias("r")).groupBy("r").count().collect()  # one row a range
    total = sum(x["count"] for x in loads)
    per_slot = max(1, min(REFS_PER_SLOT, -(-total // max(1, ranges)) * 2))
    splits = {x["r"]: max(1, -(-x["count"] // per_slot)) for x in loads}
    first, base = {}, 0
    for r in range(ranges):
        first[r], base = base, base + splits.get(r, 1)
    plan = small(spark.createDataFrame([(r, first[r], splits.get(r, 1)) for r in range(ranges)], "r int, first int, parts int"), ranges)
    a = asked.withColumn("r", span).join(plan, "r")
    a = a.withColumn("slot", F.col("first") + F.pmod(F.xxhash64("source_key", "field"), F.col("parts")).cast("int"))
    b = held.withColumn("r", span).join(plan, "r").withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    text = lambda c: F.lit(None).cast("string").alias(c)
    both = a.select("slot", F.lit(1).alias("is_ref"), "h", "key", "ms", F.lit(False).alias("gone"), "source_table", "source_key", "field", "period").unionByName(
        b.select("slot", F.lit(0).alias("is_ref"), "h", "key", "ms", "gone", text("source_table"), text("source_key"), text("field"), text("period"))
    )
    slots = both.repartition(base, "slot").sortWithinPartitions("slot", "is_ref")
    out = slots.mapInPandas(_probe, RESULT)
    return out.withColumn("target_key", F.expr("substring(target_key, instr(target_key, '\x01') + 1)"))


def document_references(metadata: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Orphans among the relation table's two ends and the nodes' reference lists."""
    key = document_key(F.col("so_hieu"))
    docs = metadata.select(key.alias("key"), "created_at", "deleted_at").where("key is not null and key <> ''")
    docs = docs.groupBy("key").agg(F.min("created_at").alias("time"), F.min(F.col("deleted_at").isNotNull()).alias("deleted")).select(F.lit("d").alias("space"), "key", "time", "deleted")
    own = nodes.where("id is not null").groupBy("id").agg(F.min("loaded_at").alias("time"))
    chunks = own.select(F.lit("n").alias("space"), F.col("id").alias("key"), "time", F.lit(False).alias("deleted"))
    ends = relations.select("id", "created_at", F.explode(F.create_map(F.lit("entity_start"), F.col("entity_start"), F.lit("entity_end"), F.col("entity_end"))).alias("field", "raw"))
    ends = ends.select(F.lit("d").alias("space"), document_key(F.col("raw")).alias("key"), F.col("created_at").alias("time"), F.lit("document_relation").alias("source_table"), F.col("id").cast("string").alias("source_key"), "field")
    ends = ends.where("key is not null and key <> ''").groupBy("space", "key", "source_table", "source_key", "field").agg(F.min("time").alias("time"))
    listed = nodes.where("id is not null").select("id", "loaded_at", F.explode("reference").alias("key")).where(F.col("key").isNotNull() & (F.regexp_replace("key", r"(?U)\s+", "") != ""))
    # a node's earliest load counts, also where only a later load lists the reference
    listed = listed.groupBy("id", "key").agg(F.lit(1).alias("x")).join(own, "id")
    listed = listed.select(F.lit("n").alias("space"), "key", "time", F.lit("document_node").alias("source_table"), F.col("id").alias("source_key"), F.lit("reference").alias("field"))
    return orphan_references(docs.unionByName(chunks), ends.unionByName(listed))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Misses counted per table, field, month and state."""
    return orphans.groupBy("source_table", "field", "period", "state").agg(F.count("*").alias("n_references"), F.count_distinct("target_key").alias("n_targets"))
