"""Evaluation of a wiki built from a corpus: coverage, maturity, growth, grounding, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import vectors as v


def coverage_residual(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(residual): mean over chunk vectors of one minus the best cosine with a page, not below zero; one without pages.

    ``chunks`` (id, e) and ``pages`` (page, e) hold unit vectors; pages are a
    few per thousand chunks, so they are broadcast if counted small and joined
    by a nested loop over blocks otherwise.
    """
    n = pages.count()
    if n == 0:
        return chunks.agg(F.lit(1.0).alias("residual"))
    best = None
    step = 2000
    numbered = pages.select(F.col("page"), F.col("e").alias("pe"), F.pmod(F.xxhash64("page"), F.lit(-(-n // step))).alias("_b"))
    for b in range(-(-n // step)):  # pages in blocks of bounded size against all chunks
        block = numbered.where(F.col("_b") == b).agg(F.collect_list("pe").alias("pes"))
        sim = chunks.crossJoin(F.broadcast(block)).select("id", F.array_max(F.transform("pes", lambda p: v.dot(F.col("e"), p))).alias("s"))
        best = sim if best is None else best.unionByName(sim)
    return best.groupBy("id").agg(F.max("s").alias("s")).agg(F.avg(F.greatest(F.lit(0.0), 1.0 - F.coalesce("s", F.lit(0.0)))).alias("residual"))


def hhi(df: DataFrame, group: str, part: str) -> DataFrame:
    """(group, hhi): concentration of a group's rows over its parts, between 0 and 1."""
    n = df.groupBy(group, part).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("hhi"))


def maturity(evidence: DataFrame) -> DataFrame:
    """(concept, n, docs, kinds, score, band) from evidence (concept, chunk_id, doc_id, kind).

    .25 evidence + .15 documents + .30 kinds + .20 constant overlap share + .10
    (1 - concentration over documents); gates: at least 8 chunks and 4 documents.
    """
    base = evidence.groupBy("concept").agg(F.count_distinct("chunk_id").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("kind").alias("kinds"))
    conc = hhi(evidence, "concept", "doc_id")
    score = (
        0.25 * F.least(F.col("n") / 12, F.lit(1.0)) + 0.15 * F.least(F.col("docs") / 8, F.lit(1.0)) + 0.30 * F.least(F.col("kinds") / 4, F.lit(1.0)) + 0.20 + 0.10 * (1 - F.col("hhi"))
    )
    j = base.join(conc, "concept").withColumn("score", F.round(score, 6))
    band = F.when((F.col("n") < 8) | (F.col("docs") < 4), "new").when(F.col("score") >= 0.70, "ready").when(F.col("score") >= 0.50, "growing").otherwise("new")
    return j.select("concept", "n", "docs", "kinds", "score", band.alias("band"))


def heaps(points: DataFrame, cost: str, size: str) -> DataFrame:
    """(exponent): slope of ln size on ln cost, both at least one."""
    x, y = F.log(F.greatest(F.col(cost).cast("double"), F.lit(1.0))), F.log(F.greatest(F.col(size).cast("double"), F.lit(1.0)))
    return points.agg(F.regr_slope(y, x).alias("exponent"))


def hit_rate(read: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """(n_read, n_used, rate): share of what was read that was used; null if nothing was read."""
    j = read.select(key).distinct().join(used.select(key, F.lit(1).alias("_u")).distinct(), key, "left")
    return j.agg(F.count("*").alias("n_read"), F.count("_u").alias("n_used")).select("n_read", "n_used", F.when(F.col("n_read") > 0, F.round(F.col("n_used") / F.col("n_read"), 6)).alias("rate"))


def louvain(edges: list[tuple[int, int, float]], nodes: int, seed: int = 0) -> list[int]:
    """Communities of a small weighted graph by greedy modularity moves and contraction; for page graphs, which are hand-written and bounded."""
    import random

    group = list(range(nodes))
    adj: list[dict[int, float]] = [{} for _ in range(nodes)]
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0.0) + w
        adj[b][a] = adj[b].get(a, 0.0) + w
    total = sum(sum(x.values()) for x in adj)
    if not total:
        return group
    level = list(range(nodes))
    while True:
        n = len(adj)
        own = list(range(n))
        deg = [sum(x.values()) for x in adj]
        weight = deg[:]
        moved_any, order = False, list(range(n))
        random.Random(seed).shuffle(order)
        for _ in range(50):
            moved = False
            for v_ in order:
                links: dict[int, float] = {}
                for u, w in adj[v_].items():
                    if u != v_:
                        links[own[u]] = links.get(own[u], 0.0) + w
                weight[own[v_]] -= deg[v_]
                best, gain = own[v_], links.get(own[v_], 0.0) - weight[own[v_]] * deg[v_] / total
                for c in sorted(links):
                    g = links[c] - weight[c] * deg[v_] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += deg[v_]
                if best != own[v_]:
                    own[v_], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        names = {c: i for i, c in enumerate(sorted(set(own)))}
        own = [names[c] for c in own]
        level = [own[x] for x in level]
        nxt: list[dict[int, float]] = [{} for _ in names]
        for a in range(n):
            for b, w in adj[a].items():
                nxt[own[a]][own[b]] = nxt[own[a]].get(own[b], 0.0) + w
        adj = nxt
    return level


def diverse_sample(vectors: list[list[float]], prior: list[float], k: int, weight: float = 0.7) -> list[int]:
    """Indices picked greedily by prior and by how much of the rest each newly covers; for bounded candidate lists."""
    import numpy as np

    x = np.asarray(vectors, dtype=float)
    sim = np.clip(x @ x.T, 0, None)
    p = np.asarray(prior, dtype=float)
    p = (p - p.min()) / (p.max() - p.min()) if len(p) and p.max() > p.min() else np.full(len(p), 0.5)
    covered, out = np.zeros(len(x)), []
    for _ in range(min(k, len(x))):
        gain = np.maximum(sim, covered[None, :]).sum(axis=1) - covered.sum()
        top = gain.max()
        s = weight * p + (1 - weight) * (gain / top if top > 0 else gain)
        s[out] = -np.inf
        i = int(np.argmax(s))
        out.append(i)
        covered = np.maximum(covered, sim[i])
    return out


def diverse_rows(df: DataFrame, key: str, vec: str, k: int, weight: float = 0.7, block: int = 50_000) -> list:
    """The keys ``diverse_sample`` picks from all rows, with the prior 1 / rank by key; no row is left out.

    Vectors are broadcast in blocks of ``block`` rows; every row adds up what it
    newly covers of each block, and only the best row of a round reaches the driver.
    """
    import numpy as np
    import pyarrow as pa
    from kilnwork.runtime import cut

    spark = df.sparkSession
    rows = cut(df.where(F.col(vec).isNotNull()).select(key, F.transform(vec, lambda x: x.cast("double")).alias(vec)).orderBy(key).withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in sizes)
    if not n:
        return []
    begins = dict(zip((p for p, _ in sizes), np.concatenate([[0], np.cumsum([c for _, c in sizes])]).tolist()))
    begin = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair])
    rank = begin[F.shiftright("_m", 33)] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(rows.select(key, vec, rank.cast("long").alias("_i")))
    blocks = []
    for lo in range(0, n, block):
        part = rows.where((F.col("_i") >= lo) & (F.col("_i") < lo + block)).select(vec).toLocalIterator()
        blocks.append(spark.sparkContext.broadcast(np.array([r[0] for r in part], dtype=float)))
    picked: list[int] = []
    keys, vectors = [], []
    for _ in range(min(k, n)):
        chosen = np.array(vectors, dtype=float)

        def gains(batches, mine):
            all_, step = mine.value, 1024
            cover = np.clip(all_ @ chosen.T, 0, None).max(axis=1) if len(chosen) else np.zeros(len(all_))
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), dtype=float)
                out = np.zeros(len(x))
                for a in range(0, len(x), step):
                    for b in range(0, len(all_), step):
                        out[a : a + step] += np.maximum(x[a : a + step] @ all_[b : b + step].T - cover[None, b : b + step], 0).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["_i", "g"])

        parts = None
        for b in blocks:
            one = rows.select("_i", vec).mapInArrow(lambda batches, b=b, gains=gains: gains(batches, b), "_i long, g double")
            parts = one if parts is None else parts.unionByName(one)
        total = cut(parts.groupBy("_i").agg(F.sum("g").alias("g")))
        top = total.agg(F.max("g")).first()[0]
        p = (1.0 / (F.col("_i") + 1) - 1.0 / n) / (1.0 - 1.0 / n) if n > 1 else F.lit(0.5)
        score = weight * p + (1 - weight) * (F.col("g") / top if top > 0 else F.col("g"))
        best = total.where(~F.col("_i").isin(picked)).orderBy(score.desc(), "_i").select("_i").first()[0]
        row = rows.where(F.col("_i") == best).first()
        picked.append(best)
        keys.append(row[key])
        vectors.append(row[vec])
    return keys
