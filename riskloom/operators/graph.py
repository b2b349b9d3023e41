"""Module graphs: fan-in and fan-out, reachability, strongly connected components, layer rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, join_measured, table

G = "analysis_id"
#: Distinct edges up to which the graph of an analysis is worked on in one task (80 MB of ids); larger ones by distributed rounds. Results are the same.
LOCAL_EDGES = 2_000_000


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes, of repeated rows the one loaded first."""
    rows = table(spark, folder, "dep_nodes").where("id IS NOT NULL")
    first = F.min_by(F.struct("file_path", "module_name", "language"), F.struct("loaded_at", "row_id")).alias("n")
    return rows.groupBy(G, "id").agg(first).select(G, "id", "n.*")


def edges_of(spark: SparkSession, folder: str) -> DataFrame:
    """Edges as they stand; unknown kinds count as static."""
    rows = table(spark, folder, "dep_edges", G, "source_id", "target_id", "line", "kind", "row_id")
    return rows.withColumn("kind", F.when(F.col("kind").isin("static", "dynamic", "reexport"), F.col("kind")).otherwise("static"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select(G, "id")
    return edges.join(ids.withColumnRenamed("id", "target_id"), [G, "target_id"], "left_semi").join(ids.withColumnRenamed("id", "source_id"), [G, "source_id"], "left_semi")


def fans(edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out of every node with edges, repeated edges counted. Both ends are counted in one aggregation, map-side."""
    ends = edges.select(G, F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy(G, "e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def _steps(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops: G, id, to."""
    return edges.where("source_id <> target_id").select(G, F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct()


def _by_size(steps: DataFrame, local: int) -> tuple[DataFrame, DataFrame | None]:
    """Steps of the analyses with at most ``local`` of them, and those of the others (None if there are none)."""
    large = steps.groupBy(G).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select(G)
    if not large.limit(1).count():
        return steps, None
    large = cut(large)
    return steps.join(large, G, "left_anti"), cut(join_measured(steps, large, [G]))


def _adjacency(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the nodes in order, and the graph as offsets and targets."""
    names, codes = np.unique(np.concatenate([rows["id"].to_numpy(str), rows["to"].to_numpy(str)]), return_inverse=True)
    a, b = codes[: len(rows)], codes[len(rows) :]
    order = np.argsort(a, kind="stable")
    return names, np.searchsorted(a[order], np.arange(len(names) + 1)), b[order]


def strong_components(first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Component of each node by depth-first search with low links, on an explicit stack: linear in nodes and edges, of any depth."""
    n = len(first) - 1
    bounds, heads = first.tolist(), to.tolist()
    number, low, comp = [-1] * n, [0] * n, [-1] * n
    count = 0
    for root in range(n):
        if number[root] >= 0:
            continue
        path, pending, place = [root], [root], [bounds[root]]
        number[root] = low[root] = count
        count += 1
        while path:
            v, at = path[-1], place[-1]
            if at < bounds[v + 1]:
                place[-1] = at + 1
                w = heads[at]
                if number[w] < 0:
                    number[w] = low[w] = count
                    count += 1
                    path.append(w), pending.append(w), place.append(bounds[w])
                elif comp[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop(), place.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                while True:
                    w = pending.pop()
                    comp[w] = v
                    if w == v:
                        break
    return np.array(comp, np.int64)


def _local_components(rows: pd.DataFrame) -> pd.DataFrame:
    names, first, to = _adjacency(rows)
    comp = strong_components(first, to)
    _, inverse, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    member = np.flatnonzero(sizes[inverse] > 1)
    least = np.full(len(sizes), len(names))
    np.minimum.at(least, inverse[member], member)  # names are in order: the smallest place is the smallest id
    return pd.DataFrame({G: rows[G].iloc[0], "component": names[least[inverse[member]]].astype(object), "id": names[member].astype(object)})


def _local_reach(rows: pd.DataFrame) -> pd.DataFrame:
    """Breadth-first search from the start nodes, which are the rows without ``to``."""
    steps = rows[rows["to"].notna()]
    names, first, to = _adjacency(steps)
    begun = np.unique(rows.loc[rows["to"].isna(), "id"].to_numpy(str))
    front = np.flatnonzero(np.isin(names, begun))
    seen = np.zeros(len(names), bool)
    while len(front):
        length = first[front + 1] - first[front]
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[front], length)
        found = np.unique(to[at])
        front = found[~seen[found]]
        seen[front] = True
    return pd.DataFrame({G: rows[G].iloc[0], "id": names[seen].astype(object)})


def reach(edges: DataFrame, start: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """Nodes reachable from the start nodes (analysis_id, id) by one edge or more.

    The graph of an analysis of at most ``local`` distinct edges is searched in one task. Larger ones semi-naively: each round
    follows only the nodes found in the round before, what is known is taken off by anti join, and a round writes only what it found.
    Null analyses and ids reach nothing; repeated rows count once; empty inputs give no rows.
    """
    start = start.where(F.col(G).isNotNull() & F.col("id").isNotNull()).select(G, "id").distinct()
    steps = cut(edges.where(F.col(G).isNotNull()).select(G, F.col("source_id").alias("id"), F.col("target_id").alias("to")).where("id IS NOT NULL AND to IS NOT NULL").distinct())
    small, large = _by_size(steps, local)
    both = small.unionByName(start.withColumn("to", F.lit(None).cast("string")))
    out = both.groupBy(G).applyInPandas(_local_reach, f"{G} string, id string")
    if large is None:
        return out
    known: list[DataFrame] = []
    front = start
    while True:
        found = large.join(front, [G, "id"]).select(G, F.col("to").alias("id")).distinct()
        for part in known:
            found = found.join(part, [G, "id"], "left_anti")
        front = cut(found)
        if not front.limit(1).count():
            break
        known.append(front)
        if len(known) > 1 and known[-2].count() <= known[-1].count():  # parts grow, so they stay few: a row is rewritten a logarithmic number of times
            known[-2:] = [cut(known[-2].unionByName(known[-1]))]
    for part in known:
        out = out.unionByName(part)
    return out


def _spread(labels: DataFrame, steps: DataFrame) -> DataFrame:
    """Smallest label that reaches each node along the steps, the node's own included."""
    while True:
        moved = steps.join(labels, [G, "id"]).groupBy(G, F.col("to").alias("id")).agg(F.min("label").alias("low"))
        after = cut(labels.join(moved, [G, "id"], "left").select(G, "id", F.least("label", F.coalesce("low", "label")).alias("new"), "label"))
        changed = after.where("new < label").limit(1).count()
        labels = after.select(G, "id", F.col("new").alias("label"))
        if not changed:
            return labels


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """Strongly connected components of more than one node: (analysis_id, component, id), named by their smallest id.

    The graph of an analysis of at most ``local`` distinct edges is one group, on which a linear search runs; larger ones go
    through distributed rounds (see _distributed). Null ids and analyses are in no component; repeated edges count once; no edges, no rows.
    """
    steps = cut(_steps(edges.where(F.col(G).isNotNull())))
    small, large = _by_size(steps, local)
    out = small.groupBy(G).applyInPandas(_local_components, f"{G} string, component string, id string")
    return out if large is None else out.unionByName(_distributed(large))


def _distributed(rest: DataFrame) -> DataFrame:
    """Components of steps (G, id, to) of any number by joins and minima on (analysis, node): no closure is formed and no graph is collected.

    Nodes without edges in or out are trimmed until none is left. Then the smallest id that reaches a node is its colour, and the nodes
    of a colour from which its root can be reached are a component; components are taken off and the rest goes on. Rounds
    grow with the diameter of the graph.
    """
    done = None
    while True:
        while True:  # trim
            before = rest.count()
            if not before:
                break
            kept = rest.join(rest.select(G, F.col("id").alias("to")).distinct(), [G, "to"], "left_semi")
            kept = cut(kept.join(rest.select(G, F.col("to").alias("id")).distinct(), [G, "id"], "left_semi").select(G, "id", "to"))
            rest = kept
            if kept.count() == before:
                break
        if not rest.limit(1).count():
            break
        ids = rest.select(G, "id").unionByName(rest.select(G, F.col("to").alias("id"))).distinct()
        colour = _spread(ids.withColumn("label", F.col("id")), rest)
        same = rest.join(colour, [G, "id"]).join(colour.withColumnRenamed("id", "to").withColumnRenamed("label", "other"), [G, "to"]).where("label = other")
        back = cut(same.select(G, F.col("to").alias("id"), F.col("id").alias("to"), "label"))
        front = cut(colour.where("id = label").select(G, "id", "label"))
        members = front
        while True:
            found = back.join(front.select(G, "id", "label"), [G, "id", "label"]).select(G, F.col("to").alias("id"), "label").distinct().join(members, [G, "id", "label"], "left_anti")
            front = cut(found)
            if not front.limit(1).count():
                break
            members = cut(members.unionByName(front))
        done = members if done is None else cut(done.unionByName(members))
        rest = cut(rest.join(members.select(G, "id"), [G, "id"], "left_anti").join(members.select(G, F.col("id").alias("to")), [G, "to"], "left_anti").select(G, "id", "to"))
    if done is None:
        return rest.select(G, F.col("id").alias("component"), "id")
    sizes = F.count(F.lit(1)).over(Window.partitionBy(G, "label"))
    named = F.min("id").over(Window.partitionBy(G, "label"))
    return done.withColumn("n", sizes).where("n > 1").select(G, named.alias("component"), "id")


def layer_of(module: Column, layers: list[str]) -> Column:
    """First layer, in the given order, that the module belongs to."""
    return F.coalesce(*[F.when((module == x) | module.startswith(f"{x}/") | module.startswith(f"src/{x}/") | module.startswith(f"{x}."), F.lit(x)) for x in layers])


def layer_violations(edges: DataFrame, layers: dict[str, list[str]]) -> DataFrame:
    """Edges between two layers that the rules do not allow. A node of no layer, or edges inside a layer, violate nothing."""
    order = list(layers)
    out = edges.withColumn("from_layer", layer_of(F.col("source_id"), order)).withColumn("to_layer", layer_of(F.col("target_id"), order))
    allowed = F.lit(False)
    for name, others in layers.items():
        if others:
            allowed = allowed | ((F.col("from_layer") == name) & F.col("to_layer").isin(*others))
    return out.where((F.col("from_layer") != F.col("to_layer")) & ~allowed).select(G, "source_id", "target_id", "from_layer", "to_layer")


def dependency_risk(found: DataFrame) -> DataFrame:
    """min(1, 0.2 errors) per analysis of findings (analysis_id, severity)."""
    return found.groupBy(G).agg(F.least(F.lit(1.0), 0.2 * F.count_if(F.col("severity") == "error")).alias("risk"))
