"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors are compared only under equal labels. Equal vectors are one node. The nodes of a label are dealt into shards, each
with a graph of its own; every node queries every shard of its label. A query walks down the layers with a beam; from the near nodes
that the beam holds it follows all links to other near nodes. The beam is widened until an audit (some nodes against the whole
shard, by brute force) finds no near node, and none of their ten nearest, that the walks missed. Near nodes are then verified by cosine in double precision.

Shards and blocks of queries have bounded sizes, and every pair of them is a piece of work of its own. Pairs of vectors live
only inside such a task: it sends on each node's number of links, and a star for each of its components.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import discard, stored
from logweir.llm.components import components, stars
from logweir.llm.vectors import cosine, matrix, unit, usable


BRIDGE = 0.02
ROUNDING = 5e-6


@dataclass(frozen=True)
class Plan:
    similarity: float = 0.93
    links: int = 12  # of a node in an upper layer; twice as many in the lowest
    build_beam: int = 48
    beam: int = 32
    audit: int = 64
    audit_nearest: int = 10  # of each audited query, itself not counted
    recall: float = 1.0
    shard_rows: int = 8_192
    query_rows: int = 2_048
    seed: int = 5


class Graph:
    """Nodes stand in descending order of level, so layer ``l`` has the first ``counts[l]`` nodes."""

    def __init__(self, points: np.ndarray, counts: list[int], layers: list[np.ndarray]) -> None:
        self.points, self.counts, self.layers = points, counts, layers

    def beam(self, queries: np.ndarray, entry: np.ndarray, width: int, layer: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that each query comes to among the first ``nodes`` of a layer: (nodes or -1, similarity), nearest first.

        All queries walk together: in each step every query opens its few best unopened nodes.
        """
        n, near = len(queries), self.layers[layer]
        found = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf, np.float32)
        opened = np.ones((n, width), bool)
        seen = np.zeros((n, nodes), bool)
        at = np.arange(n)
        for c in range(entry.shape[1]):
            new = (entry[:, c] >= 0) & ~seen[at, entry[:, c]]
            e = entry[new, c]
            seen[at[new], e] = True
            if c < width:
                found[new, c], opened[new, c] = e, False
                sims[new, c] = np.einsum("ij,ij->i", queries[new], self.points[e])
        live, step = at, min(4, width)
        while live.size:
            best = np.where(opened[live], -np.inf, sims[live])
            pick = np.argpartition(-best, step - 1, axis=1)[:, :step] if step < width else np.broadcast_to(np.arange(width), best.shape)
            usable_ = np.take_along_axis(best, pick, 1) > -np.inf
            going = usable_.any(axis=1)
            live, pick, usable_ = live[going], pick[going], usable_[going]
            if not live.size:
                break
            opened[live[:, None], pick] = True
            nodes_ = np.where(usable_, found[live[:, None], pick], -1)
            around = np.where((nodes_ >= 0)[:, :, None], near[np.maximum(nodes_, 0)], -1).reshape(len(live), -1)
            row, col = np.nonzero((around >= 0) & (around < nodes))
            to = around[row, col]
            fresh = ~seen[live[row], to]
            row, to = row[fresh], to[fresh]
            code = np.unique(row * nodes + to)  # two opened nodes may share a neighbour
            row, to = code // nodes, code % nodes
            seen[live[row], to] = True
            sim = np.einsum("ij,ij->i", queries[live[row]], self.points[to])
            better = sim > sims[live[row]].min(axis=1)
            row, to, sim = row[better], to[better], sim[better]
            if not row.size:
                continue
            # the new ones of a query side by side, then the best of old and new
            first = np.searchsorted(row, np.arange(len(live)))
            place = np.arange(len(row)) - first[row]
            extra = np.full((len(live), int(place.max()) + 1), -np.inf, np.float32)
            extra_ids = np.full(extra.shape, -1, np.int64)
            extra[row, place], extra_ids[row, place] = sim, to
            touched = np.unique(row)
            own = live[touched]
            all_sims = np.concatenate((sims[own], extra[touched]), axis=1)
            all_ids = np.concatenate((found[own], extra_ids[touched]), axis=1)
            all_open = np.concatenate((opened[own], extra_ids[touched] < 0), axis=1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[own], found[own], opened[own] = (np.take_along_axis(x, keep, 1) for x in (all_sims, all_ids, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)

    def flood(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) of at least ``least`` that links lead to from the given ones over nodes as near."""
        nodes, near, out = len(self.points), self.layers[0], [(row, node)]
        seen = np.zeros((len(queries), nodes), bool)
        seen[row, node] = True
        while row.size:
            around = near[node]
            at = np.repeat(row, around.shape[1])[(around >= 0).ravel()]
            to = around[around >= 0]
            fresh = ~seen[at, to]
            code = np.unique(at[fresh] * nodes + to[fresh])
            row, node = code // nodes, code % nodes
            seen[row, node] = True
            close = np.zeros(len(row), bool)
            for x in range(0, len(row), 65_536):
                r, t = row[x : x + 65_536], node[x : x + 65_536]
                close[x : x + 65_536] = np.einsum("ij,ij->i", queries[r], self.points[t]) >= least
            row, node = row[close], node[close]
            out.append((row, node))
        return np.concatenate([r for r, _ in out]), np.concatenate([t for _, t in out])

    def descend(self, queries: np.ndarray, layer: int, nodes: int | None = None) -> np.ndarray:
        """Each query's entry to a layer: the nearest node that a walk down from the top comes to."""
        entry = np.zeros((len(queries), 1), np.int64)
        for upper in range(len(self.counts) - 1, layer, -1):
            there = self.counts[upper] if nodes is None else min(self.counts[upper], nodes)
            entry = self.beam(queries, entry, 1, upper, there)[0]
        return entry


def _spread(point_sims: np.ndarray, pair_sims: np.ndarray, number: int) -> np.ndarray:
    """Which candidates (nearest first) a node links to: those nearer to it than to any that is linked; then the nearest others."""
    n, width = point_sims.shape
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), -np.inf, np.float32)  # of each candidate to a chosen one
    for c in range(width):
        take = (point_sims[:, c] > closest[:, c]) & (point_sims[:, c] > -np.inf) & (chosen.sum(axis=1) < number)
        chosen[:, c] = take
        closest[take] = np.maximum(closest[take], pair_sims[take, c])
    spare = ~chosen & (point_sims > -np.inf)
    rank = np.cumsum(spare, axis=1)
    return chosen | (spare & (rank <= (number - chosen.sum(axis=1))[:, None]))


def build(points: np.ndarray, plan: Plan) -> Graph:
    """Insert in batches that double: a batch finds its neighbours in the graph so far and among itself."""
    n = len(points)
    rng = np.random.default_rng(plan.seed)
    level = np.sort((-np.log(1.0 - rng.random(n)) / np.log(plan.links)).astype(int))[::-1] if n else np.zeros(0, int)
    counts = [int((level >= x).sum()) for x in range(int(level[0]) + 1 if n else 1)]
    graph = Graph(points, counts, [np.full((c, plan.links * (2 if x == 0 else 1)), -1, np.int64) for x, c in enumerate(counts)])
    start = 1
    while start < n:
        end = min(n, start + min(max(1, start), 512))
        for layer, count in enumerate(counts):
            stop = min(end, count)
            if start < stop:
                _insert(graph, start, stop, layer, plan)
        start = end
    return graph


def _insert(graph: Graph, start: int, stop: int, layer: int, plan: Plan) -> None:
    points, near = graph.points, graph.layers[layer]
    new = np.arange(start, stop)
    entry = graph.descend(points[new], layer, start)
    width = min(plan.build_beam, start)
    found, sims = graph.beam(points[new], entry, width, layer, start)
    own = points[new] @ points[new].T
    np.fill_diagonal(own, -np.inf)
    mates = min(len(new) - 1, plan.links)
    if mates > 0:
        pick = np.argpartition(-own, mates - 1, axis=1)[:, :mates]
        found = np.concatenate((found, new[pick]), axis=1)
        sims = np.concatenate((sims, np.take_along_axis(own, pick, 1)), axis=1)
    _relink(graph, new, found, sims, near)
    # the other way round: the nodes that were chosen may choose the new ones
    at, col = np.nonzero(near[new] >= 0)
    to, back = near[new][at, col], new[at]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first = np.unique(to, return_index=True)
    place = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate((first, [len(to)]))))
    for at in range(0, len(nodes), 512):
        some = nodes[at : at + 512]
        mine = (to >= some[0]) & (to <= some[-1])
        extra = np.full((len(some), int(place[mine].max()) + 1), -1, np.int64)
        extra[np.searchsorted(some, to[mine]), place[mine]] = back[mine]
        both = np.concatenate((near[some], extra), axis=1)
        both = np.where(_repeated(both), -1, both)
        sim = np.where(both >= 0, np.einsum("ijk,ik->ij", points[np.maximum(both, 0)], points[some]), -np.inf).astype(np.float32)
        _relink(graph, some, both, sim, near)


def _repeated(ids: np.ndarray) -> np.ndarray:
    """True where a row has the same id further left."""
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, 1)
    again = np.concatenate((np.zeros((len(ids), 1), bool), ranked[:, 1:] == ranked[:, :-1]), axis=1)
    out = np.zeros(ids.shape, bool)
    np.put_along_axis(out, order, again, 1)
    return out


def _relink(graph: Graph, nodes: np.ndarray, found: np.ndarray, sims: np.ndarray, near: np.ndarray) -> None:
    number = near.shape[1]
    sims = np.where(found >= 0, sims, -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    for at in range(0, len(nodes), 64):
        part, s = found[at : at + 64], sims[at : at + 64]
        few = (part >= 0).sum(axis=1).max() <= number
        if few:
            chosen = part >= 0
        else:
            p = graph.points[np.maximum(part, 0)]
            chosen = _spread(s, p @ p.transpose(0, 2, 1), number)
        row, col = np.nonzero(chosen)
        first = np.searchsorted(row, np.arange(len(part)))
        links = np.full((len(part), number), -1, np.int64)
        links[row, np.arange(len(row)) - first[row]] = part[row, col]
        near[nodes[at : at + 64]] = links


def near_nodes(graph: Graph, queries: np.ndarray, least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) of at least ``least``: what the beam holds, and what the graph's links lead to from there."""
    n = len(graph.points)
    width, each = min(width, n), max(1, min(256, (1 << 24) // max(1, n)))
    for at in range(0, len(queries), each):
        own = queries[at : at + each]
        if width == n:  # a beam as wide as the graph holds every node
            r, t = np.nonzero(own @ graph.points.T >= least)
            yield at + r, t
            continue
        found, sims = graph.beam(own, graph.descend(own, 0), width, 0, n)
        # a little below, to cross gaps; the true measure decides later
        row, col = np.nonzero((sims >= least - BRIDGE) & (found >= 0))
        row, node = graph.flood(own, row, found[row, col], least - BRIDGE)
        for x in range(0, len(row), 65_536):
            r, t = row[x : x + 65_536], node[x : x + 65_536]
            close = np.einsum("ij,ij->i", own[r], graph.points[t]) >= least
            yield at + r[close], t[close]


def audited(graph: Graph, queries: np.ndarray, plan: Plan, least: float) -> int:
    """A beam with which the audit's walks find the target share of all near nodes, and of each query's nearest nodes however far they are;
    at last one as wide as the graph. Near nodes alone are too few to go by where links are sparse."""
    n = len(graph.points)
    some = queries[np.linspace(0, len(queries) - 1, min(plan.audit, len(queries))).astype(int)]
    sims = some @ graph.points.T
    # a product of matrices and a walk may round a pair at the very bound to its two sides
    there = sims >= least + ROUNDING
    own = (sims >= 1 - ROUNDING).any(axis=1)  # the query itself, which any walk finds, tells nothing
    ranked = -np.sort(-sims, axis=1)[:, : plan.audit_nearest + 1]
    ranked = np.where(own[:, None], ranked[:, 1:], ranked[:, :-1]) if n > plan.audit_nearest else ranked
    width = min(max(plan.beam, plan.audit_nearest + 1), n)
    while width < n:
        got = np.zeros(there.shape, bool)
        for q, found in near_nodes(graph, some, least, width):
            got[q, found] = True
        walked = graph.beam(some, graph.descend(some, 0), width, 0, n)[1]
        met = (walked >= ranked[:, -1:] - ROUNDING).sum(axis=1) - own
        hits = np.clip(met, 0, ranked.shape[1]).sum()
        if (there & got).sum() >= plan.recall * there.sum() and hits >= plan.recall * ranked.size:
            break
        # comparing all of a shard costs less than walks with wide beams
        width = 2 * width if 128 * width < n else n
    return width


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _graph_bytes(pdf: pd.DataFrame, plan: Plan) -> bytes:
    pdf = pdf.sort_values("node", ignore_index=True)
    # a random order, or the first nodes would be alike
    pdf = pdf.iloc[np.random.default_rng(plan.seed).permutation(len(pdf))]
    m = matrix(list(pdf["vec"]))
    graph = build(unit(m).astype(np.float32), plan)
    layers = {f"layer{x}": layer.astype(np.int32) for x, layer in enumerate(graph.layers)}
    return _pack(node=pdf["node"].to_numpy(np.int64), copies=pdf["copies"].to_numpy(np.int64), vectors=m, **layers)


def _search(queries: pd.DataFrame, data: bytes, plan: Plan) -> pd.DataFrame:
    """Links and a root for each node of the block of queries and of the shard that has any."""
    shard = np.load(io.BytesIO(data))
    layers = [shard[f"layer{x}"].astype(np.int64) for x in range(sum(k.startswith("layer") for k in shard.files))]
    nodes, copies, vectors = shard["node"], shard["copies"], shard["vectors"]
    graph = Graph(unit(vectors).astype(np.float32), [len(x) for x in layers], layers)
    queries = queries.sort_values("node", ignore_index=True)
    own, m = queries["node"].to_numpy(np.int64), matrix(list(queries["vec"]))
    u = unit(m).astype(np.float32)
    least = plan.similarity - 1e-5  # single precision walks, double precision decides
    width = audited(graph, u, plan, least)
    links, a, b = np.zeros(len(own), np.int64), [own[:0]], [own[:0]]
    for q, found in near_nodes(graph, u, least, width):
        for at in range(0, len(q), 65_536):
            i, j = q[at : at + 65_536], found[at : at + 65_536]
            fits = (own[i] != nodes[j]) & (cosine(m[i], vectors[j]) >= plan.similarity)
            i, j = i[fits], j[fits]
            np.add.at(links, i, copies[j])
            p, r = stars(own[i], nodes[j])
            a.append(p)
            b.append(r)
    p, r = stars(np.concatenate(a), np.concatenate(b))
    hit = links > 0
    return pd.DataFrame({"node": np.concatenate((own[hit], p)), "links": np.concatenate((links[hit], np.zeros(len(p), np.int64))), "root": np.concatenate((own[hit], r))})


def groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", plan: Plan | None = None) -> DataFrame:
    """Every row's ``n_links`` (other rows linked directly), ``component_id`` (the smallest key reachable) and ``kept`` (its own key is that).

    Linked: equal labels that are not null, equal numbers of components, cosine of ``plan.similarity`` or more. Vectors that are null,
    zero or hold null or non-finite components link with nothing. Equal rows are rows of their own, linked as copies;
    a null key never is a component's id unless it has no other. Other columns are not read; an empty table gives no rows.
    """
    plan = plan or Plan()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # adding zero makes negative zeros plain ones
    vec = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), vec.alias("vec"), (F.col(label).isNotNull() & usable(F.col(vector))).alias("fine"))
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "vec"))).withColumn("block", F.when(F.col("fine"), F.xxhash64("label", F.size("vec"))))
    nodes = stored(rows.filter("fine").groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.first("block").alias("block"), F.first("vec").alias("vec")), "nodes")
    sizes = nodes.groupBy("block").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = sizes.select("block", F.ceil(F.col("size") / plan.shard_rows).alias("shards"), F.ceil(F.col("size") / plan.query_rows).alias("parts"))
    dealt = nodes.join(sizes, "block")
    dealt = dealt.select("node", "copies", "vec", "block", "shards", "parts", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shards")).alias("shard"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).alias("part"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "shard": pdf["shard"].iloc[:1], "parts": pdf["parts"].iloc[:1], "graph": [_graph_bytes(pdf, plan)]})

    graphs = stored(dealt.groupBy("block", "shard").applyInPandas(make, "block long, shard long, parts long, graph binary"), "graphs")
    offered = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    asking = dealt.select("node", "vec", "block", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))

    def find(queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(graph):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        return _search(queries, graph["graph"].iloc[0], plan)

    place = ["block", "shard", "part"]
    found = asking.repartition(parts, *place).groupBy(*place).cogroup(offered.repartition(parts, *place).groupBy(*place)).applyInPandas(find, "node long, links long, root long")
    found = stored(found, "vector-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    small = nodes.select("node", "copies", "least").join(linked, "node", "left").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = small.groupBy("root").agg(F.min("least").alias("component_id"))
    small = small.join(ids, "root").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    small = stored(small, "vector-groups")
    discard(nodes, graphs, found, comps)
    whole = rows.select("key", "node").filter("node is not null").join(small, "node").select("key", "n_links", "component_id")
    alone = rows.filter("node is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return whole.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
