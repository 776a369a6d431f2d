"""Graphs and trees as edge tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def until_empty(front: DataFrame, step: Callable[[DataFrame], DataFrame], most: Callable[[], int]) -> DataFrame:
    """`front` and whatever `step` makes of it, again and again until nothing comes, each round written.

    No depth is cut off: beyond `most` rounds (the rows that a walk without a
    cycle can pass) there is a cycle, which raises ValueError.
    """
    rounds, bound = [written(front)], None
    while not rounds[-1].isEmpty():
        if len(rounds) % 64 == 0:
            bound = most() if bound is None else bound
            if len(rounds) > bound:
                raise ValueError("the edges hold a cycle")
        rounds.append(written(step(rounds[-1])))
    return reduce(DataFrame.unionByName, rounds)


def shortest_paths(edges: DataFrame, start, undirected: bool = False) -> DataFrame:
    """(node, cost, via) from `start` over (src, dst, cost), by relaxation until nothing improves.

    Every round joins only the nodes that improved in the last one; ties go to
    the least predecessor. A cycle of negative cost raises ValueError.
    """
    if undirected:
        edges = edges.select("src", "dst", "cost").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    spark = edges.sparkSession
    edges = written(edges.groupBy("src", "dst").agg(F.min("cost").cast("double").alias("cost")))
    kind = edges.schema["src"].dataType
    best = spark.createDataFrame([(start, 0.0, None)], "node string, cost double, via string").select(F.col("node").cast(kind).alias("node"), "cost", F.col("via").cast(kind).alias("via"))
    front, rounds, bound = best, 0, None
    while not front.isEmpty():
        rounds += 1
        if rounds % 64 == 0:
            bound = edges.select("dst").distinct().count() + 1 if bound is None else bound
            if rounds > bound:
                raise ValueError("the edges hold a cycle of negative cost")
        step = front.select(F.col("node").alias("src"), F.col("cost").alias("so_far")).join(edges, "src").select(F.col("dst").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"), F.col("src").alias("via"))
        least = F.min(F.struct("cost", F.coalesce("via", "node").alias("v"), "via")).alias("m")
        new = written(best.unionByName(step).groupBy("node").agg(least).select("node", "m.cost", "m.via"))
        front = new.join(best.select("node", F.col("cost").alias("old")), "node", "left").where("old is null or cost < old").select("node", "cost", "via")
        best = new
    return best


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, distance) of a parent-child table, one row a path; a cycle raises ValueError.

    Paths of up to m steps and those of exactly m steps make those of up to 2m,
    so a chain of any length takes a logarithm of rounds.
    """
    first = written(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")))
    known, m = first, 1
    while True:
        if not known.where("ancestor = node").isEmpty():
            raise ValueError("the edges hold a cycle")
        longest = known.where(F.col("distance") == m).select("ancestor", F.col("node").alias("mid"), F.col("distance").alias("so_far"))
        if longest.isEmpty():
            return known
        on = known.select(F.col("ancestor").alias("mid"), "node", "distance")
        new = written(longest.join(on, "mid").select("ancestor", "node", (F.col("so_far") + F.col("distance")).alias("distance")))
        known, m = written(known.unionByName(new)), 2 * m


def below(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for the ids in `roots` (id) alone: the walk starts at them and meets nothing else."""
    pairs = edges.select("parent", "child")
    start = roots.select("id").distinct().join(pairs, F.col("id") == F.col("parent")).select(F.col("id").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance"))
    step = lambda f: f.join(pairs, F.col("node") == F.col("parent")).select("ancestor", F.col("child").alias("node"), (F.col("distance") + 1).alias("distance"))
    return until_empty(start, step, lambda: pairs.count() + 1)


def rendering_order(edges: DataFrame, roots: list[str]) -> DataFrame:
    """(node, path) in pre-order: (parent, child, pos) walked from the roots; paths are positions, compared as numbers part by part."""
    start = edges.sparkSession.createDataFrame([(r, [i]) for i, r in enumerate(roots)], "node string, path array<bigint>")
    at = edges.select("parent", F.col("child").cast("string").alias("child"), F.col("pos").cast("bigint").alias("pos"))
    step = lambda f: f.join(at, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.concat("path", F.array("pos")).alias("path"))
    return until_empty(start, step, lambda: at.count() + 1)


def layers(edges: list[tuple[str, str]], nodes: list[str] | None = None) -> list[list[str]] | None:
    """Layers of a small graph in which every node follows those it depends on; None for a cycle."""
    names = sorted(set(nodes or []) | {n for e in edges for n in e})
    waiting = {n: {a for a, b in edges if b == n} for n in names}
    out: list[list[str]] = []
    while waiting:
        ready = [n for n, needs in waiting.items() if not needs]
        if not ready:
            return None
        out.append(ready)
        for n in ready:
            del waiting[n]
        for needs in waiting.values():
            needs.difference_update(ready)
    return out


def path_to(best: DataFrame, end) -> list:
    """Nodes from the start to `end`, by following predecessors (one small lookup a step); empty where `end` is not reached."""
    out, seen, at = [], set(), end
    while at is not None:
        if at in seen:
            raise ValueError("the predecessors hold a cycle")
        row = best.where(F.col("node") == F.lit(at)).select("node", "via").first()
        if row is None:
            return []
        out.append(at)
        seen.add(at)
        at = row["via"]
    return out[::-1]


def incoming(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == F.lit(node)).select("src", "cost")
