"""Actor graphs: degrees, components, iterative centralities, cores and communities, over nodes and undirected edges
(a < b, weight).

Iterative measures are driver loops of a join and an aggregate over tables; each round's table cuts the lineage. The
measures that need all shortest paths run one source at a time in ``mapInPandas``, with the adjacency broadcast behind a
check of its size. Asynchronous label propagation is sequential by definition: one task, behind the same check."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .link import Tables, connected_components

#: Edges that may be sent to each executor: some 50 MB.
MAX_LOCAL_EDGES = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, strength and degree centrality; lone actors have zeros."""
    got = both_ways(edges).groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").cast("long").alias("strength"))
    n = nodes.agg(F.count("*").alias("_n"))
    out = nodes.select("actor").join(got, F.col("actor") == F.col("src"), "left").crossJoin(F.broadcast(n))
    degree = F.coalesce("degree", F.lit(0).cast("long"))
    return out.select("actor", degree.alias("degree"), F.coalesce("strength", F.lit(0).cast("long")).alias("strength"), F.when(F.col("_n") > 1, degree / (F.col("_n") - 1)).otherwise(0.0).alias("centrality"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    return nodes.select("actor").join(found, F.col("actor") == F.col("node"), "left").select("actor", F.coalesce("component", "actor").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """Weighted; the rank of actors without ties is dealt to all."""
    tables = Tables(nodes.sparkSession)
    names = tables.keep(nodes.select("actor").distinct())
    n = names.count()
    if not n:
        return names.withColumn("score", F.lit(0.0))
    both = both_ways(edges)
    out = tables.keep(both.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "share"))
    tied = out.select(F.col("src").alias("_tied")).distinct()
    lone = names.join(tied, F.col("actor") == F.col("_tied"), "left").select("actor", F.col("_tied").isNull().alias("lone"))
    seen = {"loose": F.coalesce(F.sum(F.when(F.col("lone"), F.col("score"))), F.lit(0.0)), "moved": F.sum(F.abs(F.col("score") - F.col("_old"))), "total": F.sum("score")}
    rank, now = tables.measured(lone.withColumn("score", F.lit(1.0 / n)).withColumn("_old", F.lit(0.0)), **seen)
    for _ in range(rounds):
        moved = out.join(rank, out["src"] == rank["actor"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("_in"))
        given = F.coalesce("_in", F.lit(0.0)) + now["loose"] / n  # what actors without ties hold is dealt to all
        rank, now = tables.measured(rank.join(moved, F.col("actor") == F.col("dst"), "left").select("actor", "lone", ((1 - damping) / n + damping * given).alias("score"), F.col("score").alias("_old")), **seen)
        if now["moved"] < tolerance:
            break
    return rank.select("actor", (F.col("score") / now["total"]).alias("score"))


def eigenvector(nodes: DataFrame, edges: DataFrame, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """Power iteration from a uniform start. On a bipartite graph it alternates and stops after ``rounds``."""
    tables = Tables(nodes.sparkSession)
    names = tables.keep(nodes.select("actor").distinct())
    n = names.count()
    both = tables.keep(both_ways(edges))
    score = names.withColumn("score", F.lit(1.0 / max(n, 1) ** 0.5))
    for _ in range(rounds):
        got = both.join(score, both["src"] == score["actor"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("weight")).alias("_in"))
        raw, seen = tables.measured(score.join(got, F.col("actor") == F.col("dst"), "left").select("actor", F.col("score").alias("_old"), F.coalesce("_in", F.lit(0.0)).alias("_in")), squares=F.sum(F.col("_in") * F.col("_in")))
        norm = (seen["squares"] or 0.0) ** 0.5
        if not norm:
            return names.withColumn("score", F.lit(0.0))
        new = raw.select("actor", (F.col("_in") / norm).alias("score"), "_old")
        far = new.agg(F.sum(F.abs(F.col("score") - F.col("_old")))).first()[0]
        score = new.select("actor", "score")
        if far < tolerance:
            break
    return score


def coreness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The largest k for which an actor is in the k-core: rounds of dropping actors of too small a degree."""
    tables = Tables(nodes.sparkSession)
    left, k = tables.keep(edges.select("a", "b")), 1
    core = [nodes.select("actor", F.lit(0).alias("core"))]
    while True:
        while True:
            deg = left.select(F.explode(F.array("a", "b")).alias("actor")).groupBy("actor").agg(F.count("*").alias("d"))
            low = deg.where(F.col("d") < k).select("actor")
            kept = tables.keep(left.join(low, left["a"] == low["actor"], "left_anti").join(low, F.col("b") == low["actor"], "left_anti"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        core.append(left.select(F.explode(F.array("a", "b")).alias("actor")).distinct().withColumn("core", F.lit(k)))
        k += 1
    out = core[0]
    for c in core[1:]:
        out = out.unionByName(c)
    return out.groupBy("actor").agg(F.max("core").alias("core"))


def _local(edges: DataFrame) -> dict[str, dict[str, float]]:
    rows = edges.limit(MAX_LOCAL_EDGES + 1).collect()
    if len(rows) > MAX_LOCAL_EDGES:
        raise ValueError(f"over {MAX_LOCAL_EDGES} ties: too many for path measures; take a subgraph")
    near: dict[str, dict[str, float]] = {}
    for r in sorted(rows, key=lambda r: (r.a, r.b)):
        near.setdefault(r.a, {})[r.b] = near.setdefault(r.b, {})[r.a] = float(r.weight)
    return near


def distances(near: dict, source: str, weighted: bool) -> dict[str, float]:
    """Hops, or sums of 1 / weight."""
    if not weighted:
        seen, queue = {source: 0.0}, deque([source])
        while queue:
            x = queue.popleft()
            for y in near.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
        return seen
    done: dict[str, float] = {}
    heap = [(0.0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done[x] = d
        for y, w in near.get(x, {}).items():
            if y not in done and w > 0:
                heapq.heappush(heap, (d + 1 / w, y))
    return done


def closeness_of(near: dict, n: int, source: str, weighted: bool) -> float:
    d = distances(near, source, weighted)
    total, reach = sum(d.values()), len(d) - 1
    return (reach / total) * (reach / (n - 1)) if total > 0 and n > 1 else 0.0


def dependencies_of(near: dict, source: str, weighted: bool) -> dict[str, float]:
    """What one source adds to each node's betweenness, by backward accumulation over its shortest paths."""
    eps, order = 1e-12, []
    dist, paths, before, heap, done = {source: 0.0}, {source: 1.0}, {source: []}, [(0.0, source)], set()
    while heap:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        order.append(x)
        for y, w in near.get(x, {}).items():
            if w <= 0 or y in done:
                continue
            to = d + (1 / w if weighted else 1.0)
            if y not in dist or to < dist[y] - eps:
                dist[y], paths[y], before[y] = to, paths[x], [x]
                heapq.heappush(heap, (to, y))
            elif abs(to - dist[y]) <= eps:
                paths[y] += paths[x]
                before[y].append(x)
    give = dict.fromkeys(order, 0.0)
    for y in reversed(order):
        for x in before[y]:
            give[x] += paths[x] / paths[y] * (1 + give[y])
    give.pop(source)
    return give


def _by_source(nodes: DataFrame, near: dict, work: Callable[[dict, str], dict[str, float]]) -> DataFrame:
    """What all sources of a task give each actor, added up in the task: at most a row for each actor and task."""
    shared = nodes.sparkSession.sparkContext.broadcast(near)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, float] = {}
        for f in frames:
            for source in f["actor"]:
                for actor, score in work(shared.value, source).items():
                    total[actor] = total.get(actor, 0.0) + score
        yield pd.DataFrame(list(total.items()), columns=["actor", "score"])

    return nodes.select("actor").distinct().repartition(nodes.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "actor string, score double")


def closeness(nodes: DataFrame, edges: DataFrame, weighted: bool = False) -> DataFrame:
    n, near = nodes.count(), _local(edges)
    return _by_source(nodes, near, lambda g, a: {a: closeness_of(g, n, a, weighted)})


def betweenness(nodes: DataFrame, edges: DataFrame, weighted: bool = False, normalized: bool = True) -> DataFrame:
    n, near = nodes.count(), _local(edges)
    scale = 0.5 / ((n - 1) * (n - 2) / 2) if normalized and n > 2 else 0.5 if n > 2 else 0.0
    parts = _by_source(nodes, near, lambda g, a: dependencies_of(g, a, weighted) | {a: 0.0})
    return parts.groupBy("actor").agg((F.sum("score") * scale).alias("score"))


def spread_labels(near: dict, actors: list[str], rounds: int) -> dict[str, str]:
    """Asynchronous label propagation in name order: each takes the heaviest label around it, ties to the smallest."""
    label = {a: a for a in actors}
    for _ in range(rounds):
        moved = False
        for a in sorted(actors):
            weight: dict[str, float] = {}
            for b, w in near.get(a, {}).items():
                weight[label[b]] = weight.get(label[b], 0.0) + w
            if weight:
                best = min(weight, key=lambda x: (-weight[x], x))
                moved |= best != label[a]
                label[a] = best
        if not moved:
            break
    return label


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Actors and their label; actors without ties are communities of one. Refuses over MAX_LOCAL_EDGES ties."""
    near = _local(edges)
    found = nodes.sparkSession.createDataFrame(sorted(spread_labels(near, list(near), rounds).items()), "_actor string, _label string")
    return nodes.select("actor").distinct().join(found, F.col("actor") == F.col("_actor"), "left").select("actor", F.coalesce("_label", "actor").alias("community"))


METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "degree": lambda n, e: degrees(n, e).select("actor", F.col("degree").cast("double").alias("score")),
    "strength": lambda n, e: degrees(n, e).select("actor", F.col("strength").cast("double").alias("score")),
    "closeness": closeness, "betweenness": betweenness, "eigenvector": eigenvector, "pagerank": pagerank,
    "coreness": lambda n, e: coreness(n, e).select("actor", F.col("core").cast("double").alias("score")),
}


def ranking(nodes: DataFrame, edges: DataFrame, metric: str = "degree", top: int | None = None) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    out = METRICS[metric](nodes, edges).orderBy(F.desc("score"), "actor")
    return out if top is None else out.limit(top)


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The first of each fast measure, and the size of the graph."""
    d = degrees(nodes, edges)
    by = lambda c: F.max_by(F.struct("actor", c), F.struct(F.col(c), F.expr("transform(split(actor, ''), x -> -ascii(x))")))
    got = d.agg(F.count("*").alias("actors"), by("degree").alias("_d"), by("strength").alias("_s"))
    ties = edges.agg(F.count("*").alias("ties"))
    return got.crossJoin(ties).select("actors", "ties", F.col("_d.actor").alias("top_degree"), F.col("_s.actor").alias("top_strength"))
