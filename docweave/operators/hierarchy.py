"""Problem 3: parent-child links to full hierarchies.

Weighted disjoint-set forests: every task unites the links of one id range and knows each node's offset to the head of its set.  A head whose
parent lies in another range is a boundary link; boundary links, far fewer than nodes, form the next level and are united again, until
one level fits a task.  The answers then flow back by one join a level.  Where ids share no prefix with their parents a level may not halve the links; it is
then solved by doubling: each link takes over its parent's link, so after the logarithm of their number all have met a root or run round a loop.

Defined results: null ids are left out; a repeated id is one node with the smallest of its parents by code points (nulls only if all are null); a null, blank
or unknown parent makes a root of depth 0; a node on a loop or below one has depth -1 and the loop's smallest id as root; a node that is its
own parent is a loop of one; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.runtime import settled, small, tasks_for

#: Nodes one task unites, and boundary links the last, single task may get.
ROWS_PER_TASK = 200_000
LAST_LEVEL_ROWS = 100_000

_COLUMNS = "id string, parent string, w long, seg string, root string, depth long"


class OffsetForest:
    """Disjoint sets over 0..n-1 in which every member knows its distance to the head and the smallest label on the way there."""

    def __init__(self, n: int, with_trails: bool = False):
        self.link = list(range(n))
        self.weight = [0] * n
        self.seg: list[str | None] = [None] * n
        self.trail: list[list[str]] | None = [[] for _ in range(n)] if with_trails else None

    def find(self, x: int) -> int:
        link, weight, seg, trail = self.link, self.weight, self.seg, self.trail
        way = []
        while link[x] != x:
            way.append(x)
            x = link[x]
        # from the head downwards: each node takes over what its neighbour nearer the head already knows
        for k in range(len(way) - 2, -1, -1):
            a, b = way[k], way[k + 1]
            weight[a] += weight[b]
            if seg[b] < seg[a]:
                seg[a] = seg[b]
            if trail is not None:
                trail[a] = trail[a] + trail[b]
            link[a] = x
        return x

    def unite(self, child: int, parent: int, w: int, seg: str, trail: list[str] | None = None) -> bool:
        """Hang ``child``, a head, below ``parent``; False if the link would close a loop."""
        head = self.find(parent)
        if head == child:
            return False
        self.link[child] = head
        self.weight[child] = w + self.weight[parent]
        self.seg[child] = seg if self.seg[parent] is None else min(seg, self.seg[parent])
        if self.trail is not None:
            self.trail[child] = [*(trail or []), *self.trail[parent]]
        return True


def _contract(batches: Iterator[pd.DataFrame], with_trails: bool) -> Iterator[pd.DataFrame]:
    """Unite the links of one range.  In: _COLUMNS (+ trail).  Out: the same + head, off."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    ids = rows["id"].tolist()
    parents = [p if isinstance(p, str) else None for p in rows["parent"]]
    links = [s if isinstance(s, str) else None for s in rows["seg"]]
    roots = [r if isinstance(r, str) else None for r in rows["root"]]
    ws, depths = rows["w"].tolist(), rows["depth"].tolist()
    trails = [list(t) if t is not None else [] for t in rows["trail"]] if with_trails else None
    del rows, frames
    place = {x: k for k, x in enumerate(ids)}
    forest = OffsetForest(len(ids), with_trails)
    up: dict[int, int] = {}
    closing = []
    for k, p in enumerate(parents):
        if roots[k] is None and p is not None and (q := place.get(p)) is not None:
            up[k] = q
            if not forest.unite(k, q, ws[k], links[k], trails and trails[k]):
                closing.append(k)
    loops = {}
    for k in closing:
        low, x = links[k], up[k]
        while x != k:
            low, x = min(low, links[x]), up[x]
        loops[k] = low
    n = len(ids)
    heads, offs, segs, out_parent, out_root, out_depth = [None] * n, [0] * n, [None] * n, [None] * n, [None] * n, [0] * n
    out_trail = [None] * n if with_trails else None
    for k in range(n):
        h = forest.find(k)
        if h in loops:
            out_root[k], out_depth[k] = loops[h], -1
            if with_trails:
                out_trail[k] = []
        elif roots[h] is not None:
            out_root[k], out_depth[k] = roots[h], depths[h] + forest.weight[k] if depths[h] >= 0 else -1
            if with_trails:
                out_trail[k] = forest.trail[k] + trails[h] if depths[h] >= 0 else []
        else:
            heads[k], offs[k], segs[k] = ids[h], forest.weight[k], forest.seg[k]
            if with_trails:
                out_trail[k] = forest.trail[k]
            if h == k:
                out_parent[k], offs[k], segs[k] = parents[k], ws[k], links[k]
                if with_trails:
                    out_trail[k] = trails[k]
    step = 50_000
    for a in range(0, n, step):
        b = slice(a, a + step)
        columns = {"id": ids[b], "parent": out_parent[b], "head": heads[b], "off": offs[b], "seg": segs[b], "root": out_root[b], "depth": out_depth[b]}
        if with_trails:
            columns["trail"] = out_trail[b]
        yield pd.DataFrame(columns)


def _double(rows: DataFrame, count: int, with_trails: bool) -> DataFrame:
    """``id, root, depth`` (+ ``trail``) of rows whose parents are all among their ids, without gathering them in a task."""
    trail = ["trail"] if with_trails else []
    looped = None
    if with_trails:
        # whoever runs round a loop would gather ever longer ways: loops are found without ways first, and only the others get theirs
        known = settled(_double(rows.drop("trail"), count, False).select("id", "root", "depth").where("depth < 0"))
        looped = known.withColumn("trail", F.array().cast("array<string>"))
        rows = settled(rows.join(known.select("id"), "id", "left_anti"))
    hops = 1
    while rows.where("parent is not null").limit(1).count() and hops < count:
        p = rows.select(F.col("id").alias("p_id"), F.col("parent").alias("p_parent"), F.col("w").alias("p_w"), F.col("seg").alias("p_seg"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), *(F.col(t).alias("p_trail") for t in trail))
        met = rows.join(p, F.col("parent") == F.col("p_id"), "left")
        ends = F.col("p_root").isNotNull()
        rows = settled(
            met.select(
                "id",
                F.when(~ends, F.col("p_parent")).alias("parent"),
                (F.col("w") + F.coalesce("p_w", F.lit(0))).alias("w"),
                F.least("seg", "p_seg").alias("seg"),
                F.coalesce("root", "p_root").alias("root"),
                F.when(F.col("root").isNotNull(), F.col("depth")).when(ends & (F.col("p_depth") < 0), -1).when(ends, F.col("p_depth") + F.col("w")).otherwise(F.col("depth")).cast("long").alias("depth"),
                *(F.when(F.col("p_id").isNull(), F.col(t)).otherwise(F.concat(t, "p_trail")).alias(t) for t in trail),
            )
        )
        hops *= 2
    # what has no root yet has gone at least as many links as there are: its parent lies on the loop, and the parent's own way covers all of it
    low = rows.where("root is null").select(F.col("id").alias("p_id"), F.col("seg").alias("low"))
    out = rows.join(low, F.col("parent") == F.col("p_id"), "left")
    looping = F.col("root").isNull()
    out = out.select("id", F.coalesce("root", "low").alias("root"), F.when(looping, -1).otherwise(F.col("depth")).cast("long").alias("depth"), *(F.col(t) for t in trail))
    return out if looped is None else out.unionByName(looped)


def _solve(rows: DataFrame, count: int, with_trails: bool, level: int) -> DataFrame:
    """``id, root, depth`` (+ ``trail``: the ancestors, parent first) of every row of ``rows``."""
    spark = rows.sparkSession
    schema = "id string, parent string, head string, off long, seg string, root string, depth long" + ", trail array<string>" * with_trails
    keep = ["id", "root", "depth", *["trail"] * with_trails]
    if level and count <= LAST_LEVEL_ROWS:
        spread = rows.coalesce(1)
    else:
        spread = rows.repartitionByRange(tasks_for(spark, count, ROWS_PER_TASK), "id")
    forest = settled(spread.mapInPandas(lambda batches: _contract(batches, with_trails), schema))
    edge = forest.where("parent is not null").select("id", "parent", F.col("off").alias("w"), "seg", *(["trail"] if with_trails else []))
    edges = edge.count()
    if not edges:
        return forest.select(*keep)
    # At a boundary head off and seg are those of its link; its own offset to itself is 0.
    target = forest.select(F.col("id").alias("p_id"), "head", F.when(F.col("parent").isNull(), F.col("off")).otherwise(0).alias("p_off"), F.when(F.col("parent").isNull(), F.col("seg")).alias("p_seg"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), *([F.when(F.col("parent").isNull(), F.col("trail")).otherwise(F.array().cast("array<string>")).alias("p_trail")] if with_trails else []))
    # left join from the edges; with few edges they are the broadcast side of a semi join that thins the targets first
    wanted = small(edge.select(F.col("parent").alias("p_id")).distinct(), edges)
    met = edge.join(small(target.join(wanted, "p_id", "left_semi"), edges), F.col("parent") == F.col("p_id"), "left")
    unknown, solved = F.col("p_id").isNull(), F.col("p_root").isNotNull()
    nxt = met.select(
        "id",
        F.when(~unknown & ~solved, F.col("head")).alias("parent"),
        F.when(~unknown & ~solved, F.col("w") + F.col("p_off")).otherwise(0).alias("w"),
        F.when(~unknown & ~solved, F.least("seg", F.coalesce("p_seg", "seg"))).alias("seg"),
        F.when(unknown, F.col("id")).otherwise(F.col("p_root")).alias("root"),
        F.when(unknown, 0).when(solved & (F.col("p_depth") < 0), -1).when(solved, F.col("p_depth") + F.col("w")).otherwise(0).cast("long").alias("depth"),
        *([F.when(unknown, F.array().cast("array<string>")).otherwise(F.concat("trail", "p_trail")).alias("trail")] if with_trails else []),
    )
    nxt = settled(nxt)
    if edges > LAST_LEVEL_ROWS and edges > count / 2:
        solved_edges = _double(nxt, edges, with_trails)
    else:
        solved_edges = _solve(nxt, edges, with_trails, level + 1)
    head = solved_edges.select(F.col("id").alias("h_id"), F.col("root").alias("h_root"), F.col("depth").alias("h_depth"), *([F.col("trail").alias("h_trail")] if with_trails else []))
    own = F.when(F.col("parent").isNull(), F.col("off")).otherwise(0)
    open_ = F.col("h_id").isNotNull()
    out = forest.join(small(head, edges), F.col("head") == F.col("h_id"), "left")
    columns = [
        F.col("id"),
        F.when(open_, F.col("h_root")).otherwise(F.col("root")).alias("root"),
        F.when(open_ & (F.col("h_depth") < 0), -1).when(open_, F.col("h_depth") + own).otherwise(F.col("depth")).cast("long").alias("depth"),
    ]
    if with_trails:
        here = F.when(F.col("parent").isNull(), F.col("trail")).otherwise(F.array().cast("array<string>"))
        columns.append(F.when(open_ & (F.col("h_depth") < 0), F.array().cast("array<string>")).when(open_, F.concat(here, "h_trail")).otherwise(F.col("trail")).alias("trail"))
    return out.select(*columns)


def hierarchy(links: DataFrame, id_col: str = "id", parent_col: str = "parent_id", with_paths: bool = False) -> DataFrame:
    """``id, root_id, depth`` per distinct id; with ``with_paths`` also ``path``, the ids from the root down to the node (null at depth -1)."""
    nodes = links.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent")).where("id is not null")
    # map-side combining: an id that holds a third of all rows reaches the shuffle once per task
    nodes = nodes.groupBy("id").agg(F.min("parent").alias("parent"))
    is_root = F.col("parent").isNull() | (F.regexp_replace("parent", r"(?U)\s+", "") == "")
    rows = nodes.select(
        "id",
        F.when(~is_root, F.col("parent")).alias("parent"),
        F.when(is_root, 0).otherwise(1).cast("long").alias("w"),
        F.when(~is_root, F.col("parent")).alias("seg"),
        F.when(is_root, F.col("id")).alias("root"),
        F.lit(0).cast("long").alias("depth"),
        *([F.when(is_root, F.array().cast("array<string>")).otherwise(F.array("parent")).alias("trail")] if with_paths else []),
    )
    rows = settled(rows)
    count = rows.count()
    solved = _solve(rows, count, with_paths, 0)
    out = [F.col("id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth")]
    if with_paths:
        out.append(F.when(F.col("depth") >= 0, F.concat(F.reverse("trail"), F.array("id"))).alias("path"))
    return solved.select(*out)


def descendants(links: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``ancestor_id, id, distance``: one row per node and ancestor (the closure of all trees; loops have none)."""
    tree = hierarchy(links, id_col, parent_col, with_paths=True).where("depth > 0")
    pairs = tree.select("id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor_id"))
    return pairs.select("ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(links: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``ancestor_id, n_descendants, height``: counts are combined map-side, so a root over a third of all rows isn't gathered anywhere."""
    return descendants(links, id_col, parent_col).groupBy("ancestor_id").agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))
