"""Parent-child rows to full hierarchies: root, depth, path and descendants, loops detected.

Each partition first merges the links it holds with a weighted disjoint-set
forest: every node learns the furthest ancestor it can reach inside the
partition, the number of links to it and the smallest id on the way.  The
partition forests are then merged hierarchically: in round r every open node
jumps from its anchor to its anchor's anchor, adding offsets, so the distance
covered doubles and a tree of depth d needs log2(d) joins on the node id.  No
task ever holds more than its partition.

Chain lengths below a root are contiguous, so a round in which no node arrives
at a root proves that all open nodes run into a loop.  For those alone the
doubling goes on until it has covered as many links as there are open nodes;
then each stands on its loop and the smallest id seen from there is the loop's.

Defined results: repeated rows count once; of several rows of one id the
smallest non-empty parent counts; null ids are dropped; a null, empty or unknown
parent makes a root; a node that is its own parent is a loop of one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import cut

_STATE = ["node", "anchor", "offset", "least", "way"]


def _merge_partition(parent: dict[str, str], ways: bool = True) -> Iterator[tuple[str, str, int, str, list[str]]]:
    """Weighted union of the links of one partition, iterative, with path compression.

    Yields (node, anchor, offset, smallest id on the way, nodes on the way); the
    way holds the node itself and ends before the anchor.  A loop inside the
    partition is opened at its smallest node, which keeps its own link.
    """
    merged: dict[str, tuple[str, int, str | None, list[str]]] = {}

    def hang(trail: list[str], base: tuple[str, int, str | None, list[str]]) -> None:
        end, off, least, way = base
        for node in reversed(trail):
            off, least = off + 1, node if least is None else min(node, least)
            way = [node, *way] if ways else way
            merged[node] = (end, off, least, way)

    for start in parent:
        trail: list[str] = []
        place: dict[str, int] = {}
        at = start
        while at in parent and at not in merged and at not in place:
            place[at] = len(trail)
            trail.append(at)
            at = parent[at]
        if at in place:
            loop = trail[place[at] :]
            turn = loop.index(min(loop))
            low = loop[turn]
            hang([low], (parent[low], 0, None, []))
            hang(loop[turn + 1 :] + loop[:turn], (low, 0, None, []))
            trail = trail[: place[at]]
        hang(trail, merged.get(at, (at, 0, None, [])))
    for node, (end, off, least, way) in merged.items():
        yield node, end, off, least, way


def hierarchy(rows: DataFrame, id_col: str = "category_id", parent_col: str = "parent_id", *, paths: bool = False) -> DataFrame:
    """(id, root_id, depth) of every node; with ``paths`` also ``path`` from the root down.

    Nodes whose way up never ends have depth -1, the smallest id of the loop
    they run into as root, and no path.
    """
    spark = rows.sparkSession
    one = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("node")).agg(F.min(F.when(F.col(parent_col) != "", F.col(parent_col))).alias("up"))
    one = cut(one)
    # Rows without parent are split off, so that they do not meet in one task of the join.
    known = one.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    links = one.where("up is not null").join(known, "up", "left")
    roots = links.where("there is null").select("node").unionByName(one.where("up is null").select("node")).select("node", F.col("node").alias("anchor"), F.lit(0).cast("long").alias("offset"), F.col("node").alias("least"), F.array().cast("array<string>").alias("way"))

    def local(parts: Iterator) -> Iterator:
        import pandas as pd

        parent: dict[str, str] = {}
        for pdf in parts:
            parent.update(zip(pdf["node"], pdf["up"]))
        out = list(_merge_partition(parent, paths))
        for lo in range(0, len(out), 10_000):
            yield pd.DataFrame(out[lo : lo + 10_000], columns=_STATE)

    kind = one.schema["node"].dataType.simpleString()
    merged = links.where("there").select("node", "up").mapInPandas(local, f"node {kind}, anchor {kind}, offset long, least {kind}, way array<string>")
    tops = roots.select(F.col("node").alias("anchor"), F.lit(True).alias("top"))
    state = cut(merged.join(tops, "anchor", "left").select(*_STATE, F.coalesce("top", F.lit(False)).alias("done")).unionByName(roots.withColumn("done", F.lit(True))))
    open_, covered = state.where("not done").count(), 1
    while open_:
        state, left = _jump(state, paths)
        covered *= 2
        if left == open_:
            break
        open_ = left
    done = state.where("done")
    result = done.select(
        F.col("node").alias(id_col),
        F.col("anchor").alias("root_id"),
        F.col("offset").cast("int").alias("depth"),
        *([F.reverse(F.concat("way", F.array("anchor"))).alias("path")] if paths else []),
    )
    if not open_:
        return result
    # The rest runs into loops: cover as many links as there are nodes left.
    loops = cut(state.where("not done"))
    for _ in range(max(1, math.ceil(math.log2(open_ + 1))) - int(math.log2(covered)) + 1):
        loops, _n = _jump(loops, False)
    at = loops.select(F.col("node").alias("anchor"), F.col("least").alias("low"))
    looped = loops.join(at, "anchor").select(
        F.col("node").alias(id_col), F.col("low").alias("root_id"), F.lit(-1).alias("depth"), *([F.lit(None).cast("array<string>").alias("path")] if paths else [])
    )
    return result.unionByName(looped)


def _jump(state: DataFrame, paths: bool) -> tuple[DataFrame, int]:
    """One round: every open node moves on to its anchor's anchor."""
    on = state.select(F.col("node").alias("anchor"), F.col("anchor").alias("a2"), F.col("offset").alias("o2"), F.col("least").alias("l2"), F.col("way").alias("w2"), F.col("done").alias("d2"))
    moved = (
        state.where("not done")
        .join(on, "anchor")
        .select(
            "node",
            F.col("a2").alias("anchor"),
            (F.col("offset") + F.col("o2")).alias("offset"),
            F.least("least", "l2").alias("least"),
            (F.concat("way", "w2") if paths else F.col("way")).alias("way"),
            F.col("d2").alias("done"),
        )
    )
    state = cut(state.where("done").unionByName(moved))
    return state, state.where("not done").count()


def descendants(rows: DataFrame, id_col: str = "category_id", parent_col: str = "parent_id") -> DataFrame:
    """(ancestor, descendant, distance) of all nodes that stand in a tree."""
    tree = hierarchy(rows, id_col, parent_col, paths=True).where("depth > 0")
    return tree.select(F.col(id_col).alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor")).where("at < depth").select(
        "ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance")
    )
