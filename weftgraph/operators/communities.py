"""Communities by local moves, refinement and aggregation (Leiden), one connected component at a time."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components
from weftgraph.operators.ordering import numbered
from weftgraph.session import materialize

#: Edges that a component may have, for the kernel that holds it; groups that components are dealt to.
MOST_EDGES, GROUPS = 10_000_000, 4096
#: How strongly the refinement prefers better merges.
THETA = 0.01


@dataclass
class Graph:
    """Neighbours of node v and their weights at start[v]:start[v + 1]; loops apart, each edge within a node counted once."""

    start: list[int]
    other: np.ndarray
    weight: np.ndarray
    loop: np.ndarray

    def near(self, v: int) -> tuple[list[int], list[float]]:
        at = slice(self.start[v], self.start[v + 1])
        return self.other[at].tolist(), self.weight[at].tolist()

    def strength(self) -> list[float]:
        ends = np.repeat(np.arange(len(self.loop)), np.diff(self.start))
        return (np.bincount(ends, self.weight, len(self.loop)) + 2 * self.loop).tolist()


def graph_of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Graph:
    """The graph of n nodes and undirected edges; the weights of repeated ones add up."""
    loop = np.bincount(a[a == b], w[a == b], n)
    a, b, w = a[a != b], b[a != b], w[a != b]
    key, w = np.concatenate([a * n + b, b * n + a]), np.concatenate([w, w])
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, w = key[first], np.add.reduceat(w, first) if len(first) else w
    start = np.searchsorted(key, np.arange(n + 1) * n)
    return Graph(start.tolist(), (key % max(n, 1)).astype(np.int32), w, loop)


def _local_moves(graph: Graph, strength: list[float], total: float, gamma: float, rng: random.Random, label: list[int]) -> list[int]:
    """`label` after nodes have moved to the neighbouring community of most gain until none gains."""
    n = len(label)
    label, weight = label[:], [0.0] * n
    for v, c in enumerate(label):
        weight[c] += strength[v]
    queue = list(range(n))
    rng.shuffle(queue)
    waiting = set(queue)
    at = 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting.discard(v)
        own = label[v]
        weight[own] -= strength[v]
        links: dict[int, float] = {own: 0.0}
        others, weights = graph.near(v)
        for u, w in zip(others, weights, strict=True):
            c = label[u]
            links[c] = links.get(c, 0.0) + w
        scale = gamma * strength[v] / total
        best, most = -1, -math.inf
        for c in sorted(links):
            gain = links[c] - scale * weight[c] + (1e-12 if c == own else 0.0)
            if gain > most:
                best, most = c, gain
        label[v] = best
        weight[best] += strength[v]
        if best != own:
            for u in others:
                if label[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)
    return label


def _connected(graph: Graph, label: list[int]) -> list[int]:
    """Split each community into its connected parts."""
    part = [-1] * len(label)
    found = 0
    for v in range(len(label)):
        if part[v] < 0:
            part[v], stack = found, [v]
            while stack:
                for u in graph.near(stack.pop())[0]:
                    if part[u] < 0 and label[u] == label[v]:
                        part[u] = found
                        stack.append(u)
            found += 1
    return part


def _refine(graph: Graph, strength: list[float], total: float, gamma: float, rng: random.Random, label: list[int]) -> list[int]:
    """Parts of the communities: single nodes that merge, within their community, with a well-connected part, chosen at random by gain."""
    n = len(label)
    whole: dict[int, float] = {}
    for v, c in enumerate(label):
        whole[c] = whole.get(c, 0.0) + strength[v]
    part, weight, alone = list(range(n)), strength[:], [True] * n
    # Weight of the edges from a part to the rest of its community.
    at, ends = np.array(label), np.repeat(np.arange(n), np.diff(graph.start))
    within = at[ends] == at[graph.other]
    outside = np.bincount(ends[within], graph.weight[within], n).tolist()
    order = list(range(n))
    rng.shuffle(order)
    for v in order:
        size = whole[label[v]]
        if not alone[part[v]] or outside[v] < gamma * strength[v] * (size - strength[v]) / total:
            continue
        links: dict[int, float] = {}
        for u, w in zip(*graph.near(v), strict=True):
            if label[u] == label[v]:
                links[part[u]] = links.get(part[u], 0.0) + w
        good = [(w - gamma * strength[v] * weight[p] / total, p) for p, w in sorted(links.items()) if outside[p] >= gamma * weight[p] * (size - weight[p]) / total]
        good = [(gain, p) for gain, p in good if gain >= 0]
        if not good:
            continue
        most = max(gain for gain, _ in good)
        chosen = rng.choices([p for _, p in good], [math.exp((gain - most) / THETA) for gain, _ in good])[0]
        outside[chosen] += outside[v] - 2 * links[chosen]
        weight[chosen] += strength[v]
        alone[chosen] = alone[v] = False
        part[v] = chosen
    return part


def _dense(label: list[int]) -> list[int]:
    numbers: dict[int, int] = {}
    return [numbers.setdefault(c, len(numbers)) for c in label]


def leiden(whole: Graph, gamma: float, seed: int, total: float) -> list[int]:
    """A community of each node: moves, refinement and aggregation of the refined parts until every community is one node.

    `total` is twice the weight of all edges, also of those in other components.
    """
    rng = random.Random(seed)
    n = len(whole.loop)
    member = list(range(n))
    graph, label = whole, list(range(n))
    while True:
        strength = graph.strength()
        label = _local_moves(graph, strength, total, gamma, rng, label)
        part = _dense(_refine(graph, strength, total, gamma, rng, label))
        n = max(part, default=-1) + 1
        if n == len(part):
            break
        above, to = [0] * n, np.array(part)
        for v, p in enumerate(part):
            above[p] = label[v]
        ends = np.repeat(np.arange(len(part)), np.diff(graph.start))
        once = ends < graph.other
        loops = np.arange(len(part))
        merged = [np.concatenate(x) for x in ((to[ends[once]], to[loops]), (to[graph.other[once]], to[loops]), (graph.weight[once], graph.loop))]
        member, graph, label = [part[m] for m in member], graph_of(n, *merged), _dense(above)
    return _connected(whole, [label[m] for m in member])


def detect(edges: DataFrame, universe: DataFrame, gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, community): weighted modularity at resolution `gamma` by the Leiden method.

    The same for one seed. Every community is connected. Communities are numbered by falling size, then smallest id.
    A community lies within one connected component, so components are dealt over the executors; all they need of each other is the
    weight of the whole graph. Within one, nodes move one after the other, each by what those before it did: it goes through one
    process, and one of more than MOST_EDGES edges is refused; reduce such graphs to nearest neighbours first.
    """
    edges, nodes = materialize(edges.select("src", "dst", "weight")), universe.select("id").distinct()
    labels = connected_components(nodes, edges).withColumnsRenamed({"id": "src"})
    rows = materialize(edges.join(labels, "src").select("component", "src", "dst", "weight"), sweep=True)
    most = rows.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_EDGES:
        raise ValueError(f"a component's {most} edges are more than {MOST_EDGES}")
    total = float(2 * (rows.agg(F.sum(F.col("weight").cast("decimal(38,12)"))).first()[0] or 0)) or 1.0

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("component", "src", "dst", "weight")])
        component, src, dst, w = (table.column(c).to_numpy() for c in ("component", "src", "dst", "weight"))
        starts = np.flatnonzero(np.diff(component, prepend=component[0] - 1)).tolist()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(starts, [*starts[1:], len(component)], strict=True):
            ids, at = np.unique(np.concatenate([src[a:b], dst[a:b]]), return_inverse=True)
            group = np.array(leiden(graph_of(len(ids), at[: b - a], at[b - a :], w[a:b]), gamma, seed, total))
            # The ids are in order, so that the first of a community is its least.
            found.append((ids, ids[np.unique(group, return_index=True)[1]][np.unique(group, return_inverse=True)[1]]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["id", "first"])

    cores = edges.sparkSession.sparkContext.defaultParallelism
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("component"), F.lit(GROUPS))).repartition(cores * 16, "group")
    firsts = dealt.groupBy("group").applyInArrow(run, "id long, first long")
    firsts = materialize(nodes.join(firsts, "id", "left").select("id", F.coalesce("first", "id").alias("first")))
    order = numbered(firsts.groupBy("first").agg((-F.count("*")).alias("_size")), ["_size", "first"], "_no")
    return firsts.join(order, "first").select("id", (F.col("_no") - 1).alias("community"))
