"""Property-graph operators on edge tables (src, dst, kind[, weight]).

Iterative operators cut their lineage into shared storage after each round and
stop on a measured condition; every frontier is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.runtime import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """The edges and their reverses, distinct."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """(id) one edge away from the seeds (id), distinct."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return e.join(seeds.select(F.col("id").alias(a)).distinct(), a, "left_semi").select(F.col(b).alias("id")).distinct()


def co_members(members: DataFrame, group: str, item: str, seeds: DataFrame | None = None) -> DataFrame:
    """(a, b, shared): ordered pairs of items that share groups, with how many.

    With ``seeds`` only pairs whose ``a`` is a seed: the seeds' groups are found
    first, so nothing is emitted for groups that hold no seed.
    """
    m = members.select(group, item).distinct()
    left = m.select(group, F.col(item).alias("a"))
    if seeds is not None:
        left = left.join(seeds.select(F.col("id").alias("a")), "a", "left_semi")
    return left.join(m.select(group, F.col(item).alias("b")), group).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def coupling(members: DataFrame, group: str, item: str, *, strength: int = 3, k: int = 5) -> DataFrame:
    """(a, b, shared, rank): for each item the ``k`` items that share most groups, at least ``strength``.

    The pair counts are emitted from each group once in the order a < b and
    mirrored after the aggregation, which halves the shuffled pairs.
    """
    m = members.select(group, item).distinct()
    pairs = m.select(group, F.col(item).alias("a")).join(m.select(group, F.col(item).alias("b")), group).where("a < b")
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= strength)
    n = n.unionByName(n.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    w = W.partitionBy("a").orderBy(F.desc("shared"), "b")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def traverse(edges: DataFrame, seeds: DataFrame, *, depth: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """(depth, id) of every node reached at each depth from 1; a node may stand at several depths."""
    e = (edges if kinds is None else edges.where(F.col("kind").isin(kinds))).select("src", "dst")
    front, out = seeds.select("id").distinct(), None
    for d in range(1, depth + 1):
        front = e.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        if d < depth:
            front = cut(front)
        step = front.select(F.lit(d).alias("depth"), "id")
        out = step if out is None else out.unionByName(step)
    return out


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id) within ``hops`` undirected edges of a seed, the seeds left out."""
    e = both_ways(edges)
    seen = seeds.select("id").distinct()
    front = seen
    for _ in range(hops):
        front = cut(e.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(front)
    return seen.join(seeds.select("id"), "id", "left_anti")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Edges with both ends among the seeds and what is reached from them."""
    nodes = cut(seeds.select("id").unionByName(traverse(edges, seeds, depth=depth).select("id")).distinct())
    return edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")


def shortest_path(edges: DataFrame, start, target, *, most: int = 4) -> DataFrame:
    """(path, depth) of one shortest path; ties take the smaller previous node; empty if there is none."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    front = spark.createDataFrame([(start, [start])], f"id {kind}, path array<{kind}>")
    seen = front.select("id")
    if start == target:
        return front.select("path", F.lit(0).alias("depth"))
    for d in range(1, most + 1):
        step = edges.select("src", "dst").join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        front = cut(step.join(seen, "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path")))
        hit = front.where(F.col("id") == F.lit(target))
        if hit.head(1):
            return hit.select("path", F.lit(d).alias("depth"))
        if not front.head(1):
            break
        seen = seen.unionByName(front.select("id"))
    return front.where("false").select("path", F.lit(0).alias("depth"))


def components(nodes: DataFrame, edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of each connected component.

    Large-star and small-star rounds on the edges until no edge changes; each
    round is two aggregations and the number of rounds grows with the logarithm
    of the longest path.  A node with very many neighbours is aggregated by
    partial minima, never collected.
    """
    e = cut(both_ways(edges).where("src <> dst"))
    before = None
    for _ in range(rounds):
        # large star: larger neighbours are linked to the smallest of the closed neighbourhood
        low = e.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        big = e.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # small star: smaller neighbours and the node itself are linked to the smallest of them
        low = big.groupBy("src").agg(F.min("dst").alias("m"))
        small = big.join(low, "src")
        star = small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(low.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        star = cut(star)
        sig = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if sig == before:
            break
        before = sig
        e = both_ways(star)
    top = star.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("component"))
    return nodes.select("id").distinct().join(top, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, *, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """(id, rank) summing to one; dangling mass is spread evenly; rounded by callers.

    Stops when the L1 change is below n * tolerance, or after ``fixed`` rounds.
    """
    n = nodes.select("id").distinct().count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    e = edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    state = cut(nodes.select("id").distinct().join(out.select(F.col("src").alias("id"), F.lit(True).alias("has")), "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("has", F.lit(False)).alias("has")))
    for _ in range(fixed or rounds):
        loose = state.where("not has").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        inc = e.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("inc"))
        new = state.join(inc, "id", "left").select("id", (alpha * (F.coalesce("inc", F.lit(0.0)) + loose / n) + (1 - alpha) / n).alias("rank"), "has", F.col("rank").alias("old"))
        new = cut(new)
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        state = new.drop("old")
        if fixed is None and change < n * tolerance:
            break
    return state.select("id", "rank")


def h_index(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(group, h): the largest h with at least h values of at least h."""
    w = W.partitionBy(group).orderBy(F.desc(value))
    ranked = counts.select(group, value, F.row_number().over(w).alias("_r"))
    return ranked.groupBy(group).agg(F.max(F.when(F.col(value) >= F.col("_r"), F.col("_r")).otherwise(0)).alias("h"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node that has an edge."""
    a = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")).select("id", "o", F.lit(0).cast("long").alias("i"))
    b = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")).select("id", F.lit(0).cast("long").alias("o"), "i")
    return a.unionByName(b).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(modularity) of a partition (id, grp) of an undirected graph whose edges stand once."""
    m = edges.count()
    e = edges.join(groups.select(F.col("id").alias("src"), F.col("grp").alias("gs")), "src").join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("gd")), "dst")
    inner = e.where("gs = gd").groupBy(F.col("gs").alias("grp")).agg(F.count("*").alias("l"))
    d = degrees(edges).select("id", (F.col("out_degree") + F.col("in_degree")).alias("d")).join(groups, "id").groupBy("grp").agg(F.sum("d").alias("d"))
    j = d.join(inner, "grp", "left")
    return j.agg(F.sum(F.coalesce("l", F.lit(0)) / F.lit(float(max(m, 1))) - F.pow(F.col("d") / F.lit(2.0 * max(m, 1)), 2)).alias("modularity"))


def similarity_walk(pairs: DataFrame, seeds: list, *, depth: int = 2, fan: int = 3, threshold: float = 0.65) -> list[tuple[int, object, object, float]]:
    """(hop, from, to, score): each frontier node in order claims its ``fan`` best unvisited neighbours.

    ``pairs`` is (a, b, score).  The claim is sequential by definition; only the
    neighbours of the frontier come to the driver, at most fan**depth * seeds of
    them survive, and each hop asks for no more than ``fan`` + visited per node.
    """
    seen, front, out = set(seeds), list(seeds), []
    for hop in range(1, depth + 1):
        if not front:
            break
        room = fan + len(seen)
        w = W.partitionBy("a").orderBy(F.desc("score"), "b")
        near = pairs.where(F.col("a").isin(front) & (F.col("score") >= threshold)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= room)
        by: dict = {}
        for r in near.orderBy("a", "_r").collect():
            by.setdefault(r["a"], []).append((r["b"], r["score"]))
        nxt = []
        for a in front:
            free = [x for x in by.get(a, []) if x[0] not in seen][:fan]
            for b, s in free:
                seen.add(b)
                nxt.append(b)
                out.append((hop, a, b, round(s, 6)))
        front = nxt
    return out
